"""Text forms that no built-in expresses: character references, compatibility forms, case folding. Arrow batches."""

from __future__ import annotations

import difflib
import html
import re
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from shelfwise.functions import text as T

#: Types as objects: workers import this module, and have no session to read a type's text with.
SPANS = ArrayType(StructType().add("start", IntegerType()).add("end", IntegerType()))


@F.pandas_udf(StringType())
def dereferenced(text: pd.Series) -> pd.Series:
    """Character references as the characters that they name."""
    return text.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def compatible(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKC")


@F.pandas_udf(StringType())
def compatible_folded(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKC").str.casefold()


def canonical(text: Column) -> Column:
    """As T.normalized, of all character references and with compatibility forms joined; these two steps alone are Python."""
    return T.cleaned(compatible(T.untagged(dereferenced(T.filled(text)))))


#: White space that a split at blanks knows, beside what \\s stands for.
BLANKS = "[\\s\\x1c-\\x1f\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


def case_folded(text: Column) -> Column:
    """Compatibility forms joined, case folded, white space collapsed."""
    return F.trim(F.regexp_replace(compatible_folded(T.filled(text)), BLANKS, " "))


@F.pandas_udf(DoubleType())
def alike(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two texts, 0 to 1."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b)])


@F.pandas_udf(SPANS)
def sentences(text: pd.Series) -> pd.Series:
    """Offsets of sentences: up to and with a run of . ! ? or a line's end, without the blanks around."""
    spans = lambda t: [{"start": m.start(), "end": m.end()} for m in re.finditer(r"[^\s.!?][^.!?\n]*[.!?]*", t or "")]
    return text.map(spans, na_action=None)


@F.pandas_udf(DoubleType())
def normal_quantile(share: pd.Series) -> pd.Series:
    """Where the standard normal distribution has so much below it; each distinct share is looked up once a batch."""
    known = {p: NormalDist().inv_cdf(min(max(p, 1e-9), 1 - 1e-9)) for p in share.dropna().unique()}
    return share.map(known)
