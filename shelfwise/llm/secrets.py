"""Secret scans with corpus-wide ownership frequency.

A scan of each text gives certain spans (assignments, access keys, long hexadecimal runs) and further
candidates (prefixed tokens, signed tokens, private keys, high-entropy strings). The hash of every candidate's
value is counted over all documents and all owners: a value that many owners or many different documents hold is a
copied example; one that few hold looks live. Documents stand for repositories, for which the tables have no column.
Live-looking further candidates add spans; certain spans stay, with their verdict.

Null text counts as empty. A document without an owner is an owner of its own. Documents of equal text count as one
where documents are counted: a text that is copied whole doesn't make its secrets examples. Repeated rows keep their
rows. Texts of any length are scanned whole. Empty tables give no rows. Columns of any name pass through unread.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.batches import map_beside, packed
from shelfwise.llm.spans import Span, Taken
from shelfwise.llm.tables import cut_lineage, salted_lookup

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "vendor", "signed", "private", "entropy"]
#: From so many distinct owners on, a value is a widely copied example.
EXAMPLE_OWNERS = 4
#: Or from so many different documents on: more than owners, since one owner may keep a live value in some files.
EXAMPLE_DOCUMENTS = 8

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: The longest runs are what + finds, so a least length in the pattern keeps the same matches and none is retried.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
MORE = {
    "vendor": re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,}|npm_[A-Za-z0-9]{30,})"),
    "signed": re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "private": re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]{40,}-----END [A-Z ]{0,30}PRIVATE KEY-----"),
    "entropy": re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+={0,2}+(?![A-Za-z0-9+/_=-])"),
}
#: What any of the further patterns needs.
HINT = re.compile(r"[A-Za-z0-9+/_-]{24}|xox[abprs]-|sk_live_|eyJ|glpat-|PRIVATE KEY")


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def base_spans(text: str) -> list[tuple[Span, str]]:
    """The certain spans and the values that they hold."""
    found = [(("assign", *m.span()), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(("access", *m.span()), m[0]) for m in ACCESS.finditer(text)]
    return found + [(("hex", *m.span()), m[0]) for m in HEX.finditer(text)]


def more_spans(text: str, taken: list[Span]) -> list[tuple[Span, str]]:
    """Further candidates that overlap no certain span and no earlier candidate."""
    out: list[tuple[Span, str]] = []
    if HINT.search(text) is None:
        return out
    used = Taken(taken)
    for kind, pattern in MORE.items():
        for m in pattern.finditer(text):
            v = m[0]
            if kind == "entropy" and not (any(map(str.isupper, v)) and any(map(str.islower, v)) and any(map(str.isdigit, v)) and entropy(v) >= 3.8):
                continue
            if used.claim(*m.span()):
                out.append(((kind, *m.span()), v))
    return out


def value_hash(value: str) -> int:
    """64 bits of a value, as a signed number: values themselves go nowhere."""
    return int.from_bytes(hashlib.sha256(value.encode("utf-8", "replace")).digest()[:8], "big", signed=True)


FOUND = "found array<struct<kind string, start bigint, stop bigint, hash bigint>>"


def candidates(rows: DataFrame) -> DataFrame:
    """rows: kept, owner, copy and text. kept, owner, copy and found, an array of all candidates of the row."""

    def make():
        def row(text):
            base = base_spans(text or "")
            both = base + more_spans(text or "", [s for s, _ in base])
            return ([{"kind": k, "start": a, "stop": b, "hash": value_hash(v)} for (k, a, b), v in both],)

        return row

    return map_beside(rows, ["kept", "owner", "copy"], ["text"], FOUND, make)


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_documents and n_owners, from rows (owner, copy, hash): counted before each shuffle, so no value is hot."""
    holder = lambda by, c: F.struct(F.lit(by).alias("by"), F.col(c).cast("string").alias("name"))
    held = found.select("hash", F.explode(F.array(holder("document", "copy"), holder("owner", "owner"))).alias("h")).select("hash", "h.*").distinct()
    return held.groupBy("hash").agg(F.count_if(F.col("by") == "document").alias("n_documents"), F.count_if(F.col("by") == "owner").alias("n_owners"))


SPANS = "array<struct<start:bigint,rank:bigint,stop:bigint,kind:string,live:boolean>>"


def scan(rows: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_documents: int = EXAMPLE_DOCUMENTS) -> DataFrame:
    """rows: kept, owner and text. kept and spans, by start, then kind as listed: an array of struct(start, rank, stop, kind, live)
    of every certain span and of every further candidate that looks live. Rows without candidates take part in no shuffle."""
    found = candidates(rows.select("kept", F.col("owner").cast("string").alias("owner"), F.xxhash64("text").alias("copy"), "text"))
    found = cut_lineage(found.withColumn("row", F.monotonically_increasing_id()))
    each = found.where(F.size("found") > 0).select("row", F.coalesce("owner", F.concat(F.lit("\0"), "row")).alias("owner"), "copy", F.explode("found").alias("f"))
    each = each.select("row", "owner", "copy", "f.*")
    few = (F.col("n_owners") < example_owners) & (F.col("n_documents") < example_documents)
    live = ownership(each.select("owner", "copy", "hash")).where(few).select("hash", F.lit(True).alias("live"))
    judged = salted_lookup(each, live, "hash", "row").withColumn("live", F.coalesce("live", F.lit(False)))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    spans = judged.where(F.col("live") | F.col("kind").isin(BASE)).groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "stop", "kind", "live"))).alias("spans")
    )
    none = F.array().cast(SPANS)
    some = found.where(F.size("found") > 0).select("kept", "row").join(spans, "row", "left").select("kept", F.coalesce("spans", none).alias("spans"))
    return found.where(F.size("found") == 0).select("kept", none.alias("spans")).unionByName(some)


def spans_text(spans, kinds: list[str] | None = None):
    """kind:start:end of an array of spans, joined by commas."""
    if kinds:
        spans = F.filter(spans, lambda s: s["kind"].isin(kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """Id, n_assign, n_access, n_hex, base_sha256, spans, and n_live, the spans of all kinds whose values look live."""
    found = scan(df.select(F.struct(F.col(id_col)).alias("kept"), F.col(owner_col).alias("owner"), F.col(text_col).alias("text")), example_owners)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select(
        f"kept.{id_col}", *map(count, BASE), F.sha2(spans_text(F.col("spans"), BASE), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("bigint").alias("n_live"),
    )


MASK = "[SECRET]"


def masked(text: str | None, live: list[tuple[int, int]]) -> str | None:
    """The text with a mask in place of each range; what overlaps is one range."""
    before = len(text) if text else 0
    for a, b in sorted(set(live), reverse=True):
        if a < before:
            text = text[:a] + MASK + text[min(b, before) :]
            before = a
    return text


def redact(df: DataFrame, text_col: str = "text", owner_col: str = "source", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """All rows and columns, live-looking values masked in the text; copied examples and all else stay. Null text stays null."""
    found = scan(packed(df, owner=owner_col, text=text_col), example_owners)
    live = F.filter("spans", lambda s: s["live"])
    hidden = map_beside(
        found.where(F.size(live) > 0).select("kept", F.col("kept").getField(text_col).alias("text"), live.alias("live")), ["kept"], ["text", "live"], "text string",
        lambda: lambda text, live: (masked(text, [(s["start"], s["stop"]) for s in live]),),
    )
    hidden = hidden.select(F.col("kept").withField(f"`{text_col}`", F.col("text")).alias("kept"))
    return found.where(F.size(live) == 0).select("kept").unionByName(hidden).select("kept.*")
