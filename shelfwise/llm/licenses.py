"""License scans by ordered signature rules, in column functions only.

Text is normalised to lower-case words with one space between. A text without any stem of the signatures is done.
Of the hundreds of rules those whose keyword the text holds are matched, each at every word where it can start;
a detection that lies within another of higher priority, or of equal priority and earlier rule, is suppressed.
Base rules always stay.

Null, empty and wordless texts have no words and no detections. Long texts are scanned whole; what a text costs grows
with its words, for each rule that it holds, and with its detections times the root of their number. Rows are judged
each by itself, repeated ones too. Empty tables give no rows; only the named columns are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.batches import ascii_lower
from shelfwise.llm.license_rules import BASE, RULES, STEMS

BASE_PRIORITY = 9


def rules() -> list[tuple[int, str, int, str, str]]:
    """Order, label, priority, keyword and pattern of each rule, base rules first."""
    rows = [(label, BASE_PRIORITY, phrase, phrase) for label, phrase in BASE]
    for line in RULES.strip().splitlines():
        label, priority, keyword, pattern = (x.strip() for x in line.split(" | "))
        rows.append((label, int(priority), keyword, pattern))
    return [(i, *r) for i, r in enumerate(rows)]


def normalised(text: Column) -> Column:
    """'| word word ': a mark, and each word with one space before it and one behind the last."""
    spaced = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.concat(F.lit("| "), F.trim(spaced), F.lit(" "))


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, " ", ""))


def rule_table() -> Column:
    """The rules as an array of structs."""
    q = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr("array(" + ", ".join(f"struct({i} AS id, {q(label)} AS label, {p} AS priority, {q(k)} AS keyword, {q(f' (?:{x})(?= )')} AS pattern)" for i, label, p, k, x in rules()) + ")")


NOTHING = "array<struct<start:int,stop:int,priority:int,id:int,label:string>>"
MARK = "\u0001"


def once(value: Column, use) -> Column:
    """The array use(value), with the value computed one time however often it is read."""
    return F.flatten(F.transform(F.array(value), use))


def detections(text: Column) -> Column:
    """An array of struct(start, stop, priority, id, label) of all matches in normalised text; start and stop count words."""
    gate = reduce(lambda a, b: a | b, [F.contains(text, F.lit(s)) for s in STEMS])
    some = F.filter(rule_table(), lambda r: F.contains(text, r["keyword"]))

    def of_rule(r: Column) -> Column:
        # Cut before each place where the rule matches: pieces begin with a match. A match that runs on into the next ends there.
        return once(F.split(text, F.concat(F.lit("(?="), r["pattern"], F.lit(")")), F.lit(-1)), lambda pieces: F.when(F.size(pieces) > 1, placed(pieces, r)).otherwise(F.array().cast(NOTHING)))

    def placed(pieces: Column, r: Column) -> Column:
        # The word before a cut gets a mark; its place among the words, which the text's own mark precedes, is the match's start.
        words = F.split(F.array_join(pieces, MARK), " ")
        starts = F.filter(F.transform(words, lambda w, i: F.when(F.endswith(w, F.lit(MARK)), i)), lambda i: i.isNotNull())
        one = lambda at, length: F.struct(at.alias("start"), (at + length).alias("stop"), r["priority"].alias("priority"), r["id"].alias("id"), r["label"].alias("label"))
        length = lambda p: F.coalesce(spaces(F.regexp_substr(F.concat(p, F.lit(" ")), r["pattern"])), spaces(p))
        return F.zip_with(starts, F.slice(pieces, 2, F.size(pieces) - 1), lambda at, p: one(at, length(p)))

    return F.when(gate, F.flatten(F.transform(some, of_rule))).otherwise(F.array().cast(NOTHING))


#: Detections that are compared one by one, at least; more are cut into chunks of about the root of their number.
CHUNK = 64


def surviving(found: Column) -> Column:
    """Detections that lie within none of higher priority, nor within one of equal priority that is longer or earlier.

    In order of start, longest first, then of priority and rule, whatever beats a detection comes before it; so it is
    enough to know how far those before its chunk reach, by priority, and to look at its own chunk.
    """
    place = lambda d: F.struct(d["start"].alias("start"), (-d["stop"]).alias("back"), (-d["priority"]).alias("rank"), d["id"].alias("id"), d.alias("d"))
    ordered = F.transform(F.array_sort(F.transform(found, place)), lambda o: o["d"])
    base = lambda d: d["priority"] == BASE_PRIORITY

    def kept(o: Column) -> Column:
        width = F.greatest(F.lit(CHUNK), F.ceil(F.sqrt(F.size(o)))).cast("int")

        def of_chunk(k: Column) -> Column:
            chunk = F.slice(o, k * width + 1, width)
            before = F.slice(o, F.lit(1), k * width)
            reach = F.transform(F.sequence(F.lit(1), F.lit(BASE_PRIORITY)), lambda p: F.array_max(F.transform(F.filter(before, lambda e: e["priority"] >= p), lambda e: e["stop"])))

            def beaten(d: Column, by: Column) -> Column:
                longer = lambda e: (e["stop"] - e["start"]) > (d["stop"] - d["start"])
                within = lambda e: (e["start"] <= d["start"]) & (d["stop"] <= e["stop"])
                beats = lambda e: within(e) & ((e["priority"] > d["priority"]) | ((e["priority"] == d["priority"]) & (longer(e) | (~longer(e) & (e["id"] < d["id"])))))
                return F.coalesce(F.element_at(by, d["priority"]) >= d["stop"], F.lit(False)) | F.exists(chunk, beats)

            return once(reach, lambda by: F.filter(chunk, lambda d: base(d) | ~beaten(d, by)))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(o) - 1) / width).cast("int")), of_chunk))

    return F.when(F.size(found) > 1, once(ordered, kept)).otherwise(found)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, n_words, n_base, first_word, last_word, base_labels, labels and score: of the surviving detections the best priority, over 9."""
    words = df.select(F.col(id_col), normalised(F.col(text_col)).alias("text_"))
    found = words.select(id_col, F.when(F.col("text_") == "|  ", 0).otherwise(spaces(F.col("text_")) - 1).alias("n_words"), detections(F.col("text_")).alias("found"))
    kept = found.select(id_col, "n_words", F.filter("found", lambda d: d["priority"] == BASE_PRIORITY).alias("base"), surviving(F.col("found")).alias("kept"))
    starts = F.transform("base", lambda d: d["start"])
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda d: d["label"]))), ",")
    best = F.coalesce(F.array_max(F.transform("kept", lambda d: d["priority"])), F.lit(0)) / F.lit(float(BASE_PRIORITY))
    return kept.select(
        id_col, F.col("n_words").cast("bigint").alias("n_words"), F.size("base").cast("bigint").alias("n_base"), F.array_min(starts).cast("bigint").alias("first_word"),
        F.array_max(starts).cast("bigint").alias("last_word"), labels("base").alias("base_labels"), labels("kept").alias("labels"), best.alias("score"),
    )
