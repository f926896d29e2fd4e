"""A rule engine for evidence: ordered rules over clauses give one quoted span and concept, or a reason why not."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "status string, concept string, quote string, start int, end int"
CLAUSE = re.compile(r"[^.!?;\n]+")


@dataclass(frozen=True)
class Rule:
    """A concept of one verdict. Direct rules go before indirect ones, more specific before less."""

    concept: str
    pattern: str
    verdict: int
    direct: bool = True
    specificity: int = 0


def clauses(text: str) -> Iterator[tuple[int, int]]:
    """Offsets of clauses, without the blanks around."""
    for m in CLAUSE.finditer(text):
        whole = m.group()
        if whole.strip():
            yield m.start() + len(whole) - len(whole.lstrip()), m.start() + len(whole.rstrip())


def safe_quote(quote: str, least: int, most: int) -> bool:
    return least <= len(quote) <= most and not re.search(r"[<>\x00-\x1f]", quote)


def best_evidence(text: str | None, verdict: int | None, rules: list[Rule], least: int = 8, most: int = 300) -> tuple:
    """SAFE with concept, quote and offsets; else EMPTY, UNKNOWN_VERDICT, CONTRADICTED, ABSENT or UNSAFE.

    CONTRADICTED: a direct rule of the other verdict matches and none of this one does. Of several candidates the
    direct, the specific, the short and the early go first, in this order.
    """
    nothing = (None, None, None, None)
    if not text or not text.strip():
        return ("EMPTY", *nothing)
    if verdict not in (0, 1):
        return ("UNKNOWN_VERDICT", *nothing)
    found, against, unsafe = [], False, False
    for start, end in clauses(text):
        part = text[start:end]
        for rule in rules:
            if not re.search(rule.pattern, part, re.IGNORECASE):
                continue
            if rule.verdict != verdict:
                against |= rule.direct
            elif safe_quote(part, least, most):
                found.append((not rule.direct, -rule.specificity, end - start, start, rule.concept, part, end))
            else:
                unsafe = True
    if found:
        _, _, _, start, concept, quote, end = min(found)
        return "SAFE", concept, quote, start, end
    return ("CONTRADICTED" if against else "UNSAFE" if unsafe else "ABSENT", *nothing)


def extract(df: DataFrame, row_id: str, text: str, verdict: str, rules: list[Rule]) -> DataFrame:
    """row_id with status, concept, quote, start and end of each row's evidence."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [best_evidence(t, None if pd.isna(v) else int(v), rules) for t, v in zip(frame[text], frame[verdict])]
            out = pd.DataFrame(found, columns=["status", "concept", "quote", "start", "end"]).astype({"start": "Int32", "end": "Int32"})
            out.insert(0, row_id, frame[row_id].to_numpy())
            yield out

    kind = df.schema[row_id].dataType.simpleString()
    return df.select(row_id, text, verdict).mapInPandas(run, f"`{row_id}` {kind}, " + SCHEMA)
