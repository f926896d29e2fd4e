"""Writers. A target that exists is never overwritten."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.sources.scans import checked


def write_csv(df: DataFrame, path: str, gzip: bool = False, sep: str = ",", by: list[str] | None = None) -> None:
    out = df.write.mode("errorifexists").option("quote", '"').option("escape", '"').option("emptyValue", "").option("compression", "gzip" if gzip else "none")
    (out.partitionBy(*by) if by else out).csv(path, header=True, sep=sep)


def write_jsonl(df: DataFrame, path: str, gzip: bool = False, by: list[str] | None = None) -> None:
    out = df.write.mode("errorifexists").option("compression", "gzip" if gzip else "none").option("ignoreNullFields", False)
    (out.partitionBy(*by) if by else out).json(path)


def nested(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """One row a key with its other columns as a sorted array of structs; for keys of bounded size."""
    rest = [c for c in df.columns if c != key and c not in order]
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *rest))).alias(name))


#: The submission's opening tags, which have no closing ones, its two verdicts, for labels 0 and 1, and a comment's length.
OPEN, VERDICT, VERDICTS, LENGTH = "<комментарий>", "<вердикт>", ("бан", "не бан"), (50, 300)


def well_formed(answer: Column) -> Column:
    """Whether an answer is a comment of allowed length and a verdict, in the submission's form."""
    return answer.rlike(f"(?s)^{OPEN}.{{{LENGTH[0]},{LENGTH[1]}}}{VERDICT}(?:{'|'.join(VERDICTS)})\\z")


def rendered(comment: Column, label: Column) -> Column:
    """The answer of a comment and a label; a comment of another length or with tags in it, or another label, raises."""
    ok = F.length(comment).between(*LENGTH) & ~comment.contains(OPEN) & ~comment.contains(VERDICT) & label.isin(0, 1)
    return checked(F.concat(F.lit(OPEN), comment, F.lit(VERDICT), F.when(label == 1, VERDICTS[1]).otherwise(VERDICTS[0])), ok, "not a submission")


def parsed(answer: Column) -> list[Column]:
    """comment, verdict and label of an answer; null where it has another form."""
    form = f"(?s)^{OPEN}(.*){VERDICT}({'|'.join(VERDICTS)})\\z"
    part = lambda i: F.when(well_formed(answer), F.regexp_extract(answer, form, i))
    return [part(1).alias("comment"), part(2).alias("verdict"), F.when(well_formed(answer), (part(2) == VERDICTS[1]).cast("int")).alias("label")]


def table_digest(df: DataFrame) -> DataFrame:
    """rows and digest: a sum of row hashes, so it depends on the rows but on no order of them."""
    row = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.sum(row).cast("string").alias("digest"))


def self_hashed(payload: dict) -> str:
    """Canonical JSON of a payload with the sha256 of the rest of it."""
    canonical = lambda p: json.dumps(p, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    rest = {k: v for k, v in payload.items() if k != "sha256"}
    return canonical(rest | {"sha256": hashlib.sha256(canonical(rest).encode()).hexdigest()})


def verified(text: str) -> dict:
    payload = json.loads(text)
    if json.loads(self_hashed(payload))["sha256"] != payload.get("sha256"):
        raise ValueError("the payload isn't the one that was hashed")
    return payload
