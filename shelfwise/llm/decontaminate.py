"""Benchmark decontamination.

Every window of 13 consecutive words of a benchmark item (a shorter item is one window) is a pattern of an
Aho-Corasick automaton over normalised text; one scan of a document's normalised text finds all windows, and
their places map back to its words and to the original text. Patterns beyond AUTOMATON_BYTES go to further automata,
and each of those is one more pass over the texts. An automaton is built once a worker, not once a task.

Words are runs of ASCII letters and digits and of all non-ASCII characters, A-Z lower-cased. Null and wordless
texts have no words, no hits and aren't contaminated; null or wordless items have no windows. Rows that repeat
are judged each by itself. Items that share an id count as one item. A text of any length is scanned whole. Empty tables
give no rows, an empty benchmark no hits. Columns of any name pass through beside those that are read.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.batches import map_beside, packed

WINDOW_WORDS = 13
#: A document is contaminated when this share of its words lies inside windows, as hit * MANY >= words.
MANY = 20
#: Bytes of patterns in one automaton, counted as below; measured, an automaton takes 25 times that memory.
AUTOMATON_BYTES = 8 << 20

#: ASCII letters and digits as lower case, every other ASCII byte as a space; bytes of longer characters stay.
WORD_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(WORD_BYTES).split()


def windows(item: str | None, size: int = WINDOW_WORDS) -> list[bytes]:
    """The patterns of an item: words with one space before, between and behind."""
    w = words(item)
    return [b" " + b" ".join(w[i : i + size]) + b" " for i in range(max(1, len(w) - size + 1))] if w else []


def automaton(patterns: dict[str, tuple[int, list[str]]]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for p, value in patterns.items():
        out.add_word(p, (len(p), *value))
    out.make_automaton()
    return out


def hits(auto: ahocorasick.Automaton, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, disjoint ascending word ranges inside windows (end exclusive), and ids of the items found."""
    found = words(text)
    if not found:
        return 0, [], set()
    joined = (b" " + b" ".join(found) + b" ").decode("utf-8", "replace")
    ranges: list[tuple[int, int]] = []
    items: set[str] = set()
    starts = None
    for end, (length, n, ids) in auto.iter(joined):
        if starts is None:
            starts = np.flatnonzero(np.frombuffer(joined.encode("utf-32-le"), np.uint32) == 32)
        first = int(np.searchsorted(starts, end - length + 1))
        items.update(ids)
        ranges.append((first, first + n))
    return len(found), merged(ranges), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as character ranges of the original text."""
    kept = [i for i, c in enumerate(text) if ord(c) > 127 or c.isalnum()]
    begins = [i for n, i in enumerate(kept) if not n or kept[n - 1] != i - 1]
    ends = [i + 1 for n, i in enumerate(kept) if n + 1 == len(kept) or kept[n + 1] != i + 1]
    return [(begins[a], ends[b - 1]) for a, b in ranges]


_automata: dict[str, ahocorasick.Automaton] = {}


def kept_automaton(key: str, patterns: dict[str, tuple[int, list[str]]]) -> ahocorasick.Automaton | None:
    """The last block's automaton is kept between a worker's tasks."""
    if patterns and key not in _automata:
        _automata.clear()
        _automata[key] = automaton(patterns)
    return _automata.get(key)


def pattern_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW_WORDS):
    """The distinct patterns, in dictionaries of bounded size."""
    block: dict[str, tuple[int, list[str]]] = {}
    used = 0
    for key, text in benchmark.select(id_col, text_col).dropna().toLocalIterator():
        for p in windows(text, size):
            p = p.decode("utf-8", "replace")
            if p not in block:
                if used > AUTOMATON_BYTES:
                    yield block
                    block, used = {}, 0
                block[p] = (p.count(" ") - 1, [])
                used += len(p) + 64
            if str(key) not in block[p][1]:
                block[p][1].append(str(key))
                used += 16
    yield block


FOUND = "n_words bigint, ranges array<array<bigint>>, items array<string>, spans array<array<bigint>>, contaminated boolean"


def find(rows: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """rows: kept and text. kept, n_words, ranges (disjoint word ranges inside windows), items (sorted ids as strings),
    spans (the ranges as character ranges of the original text) and contaminated."""
    out = rows.select("kept", "text", F.lit(None).cast("array<array<bigint>>").alias("ranges"), F.lit(None).cast("array<string>").alias("items"))
    for block in pattern_blocks(benchmark, size=size):
        shared = rows.sparkSession.sparkContext.broadcast(block)
        key = hashlib.sha256(repr(sorted(block.items())).encode("utf-8", "replace")).hexdigest()

        def make(shared=shared, key=key):
            auto = kept_automaton(key, shared.value)

            def row(text, ranges, items):
                n, more, ids = hits(auto, text) if auto else (len(words(text)), [], set())
                ranges = merged([*map(tuple, ranges or []), *more])
                hit = sum(b - a for a, b in ranges)
                return n, ranges, sorted({*(items or []), *ids}), spans(text, ranges) if ranges else [], hit > 0 and hit * MANY >= n

            return row

        out = map_beside(out.select("kept", "text", "ranges", "items"), ["kept", "text"], ["text", "ranges", "items"], FOUND, make)
    return out.drop("text")


def digests(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW_WORDS) -> DataFrame:
    """Id, n_words, n_hit, n_items, items_sha256 of the sorted item ids joined by commas, and contaminated."""
    found = find(df.select(F.struct(F.col(id_col)).alias("kept"), F.col(text_col).alias("text")), benchmark, size)
    hit = F.aggregate("ranges", F.lit(0).cast("bigint"), lambda a, r: a + r[1] - r[0])
    return found.select(
        f"kept.{id_col}", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def drop_contaminated(df: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """The rows that aren't contaminated, with all their columns."""
    return find(packed(df, text="text"), benchmark, size).where("not contaminated").select("kept.*")
