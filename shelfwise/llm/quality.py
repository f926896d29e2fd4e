"""Quality classifier: a sparse ensemble of rules over statistics of a text.

Statistics are column expressions. Boosted small trees are grown on a bounded sample of labelled rows; every path
from a root to a node is a rule, a conjunction of thresholds; a lasso on the logistic loss keeps few rules with
weights; and rules are compiled back to column expressions, so scoring runs inside Spark without Python.

Null and empty texts have statistics of nothing and are scored as such. Whole texts count, whatever their length.
With no labels, or one class only, every score is that class's share. Rows that repeat get equal scores. Labels
that are neither 0 nor 1 aren't learned from. Empty tables give no rows. Columns of any name pass through unread.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.batches import held_out, packed

#: Labelled rows that are learned from, at most: those with the smallest hashes.
SAMPLE_ROWS = 4000
TREES, DEPTH, BINS = 24, 3, 32
#: A document with a smaller score is rejected.
THRESHOLD = 0.3


def statistics(text: Column) -> Column:
    """A struct of doubles."""
    text = F.coalesce(text, F.lit(""))
    n = F.length(text).cast("double")
    kept = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("double")
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    lines = F.split(text, "\n")
    many = F.size(words).cast("double")
    share = lambda x, of: F.when(of > 0, x / of).otherwise(0.0)
    return F.struct(
        n.alias("chars"), many.alias("words"), share(n, many).alias("word_length"),
        share(F.size(F.array_distinct(words)).cast("double"), many).alias("distinct"),
        share(F.size(F.array_distinct(lines)).cast("double"), F.size(lines).cast("double")).alias("distinct_lines"),
        share(kept(r"[^\p{Lu}]+"), n).alias("upper"), share(kept(r"[\p{L}\s]+"), n).alias("not_letters"),
        share(kept("[^|]+"), n).alias("bars"), share(kept("[^0-9]+"), n).alias("digits"), share(kept(r"[^%&$#*!@<>{}]+"), n).alias("marks"),
        share(kept(r"[^.,;:?]+"), many).alias("stops"),
    )


NAMES = ("chars", "words", "word_length", "distinct", "distinct_lines", "upper", "not_letters", "bars", "digits", "marks", "stops")


Condition = tuple[int, float, bool]  # statistic, threshold, whether above it


@dataclass
class Ensemble:
    """Rules, each a conjunction of conditions, with a weight; bias: the logit without any."""

    rules: list[tuple[tuple[Condition, ...], float]]
    bias: float

    def score(self, stats: Column) -> Column:
        logit = F.lit(float(self.bias))
        for conditions, weight in self.rules:
            holds = F.lit(True)
            for at, threshold, above in conditions:
                value = stats[NAMES[at]]
                holds = holds & ((value > threshold) if above else (value <= threshold))
            logit = logit + F.when(holds, F.lit(float(weight))).otherwise(0.0)
        return 1 / (1 + F.exp(-logit))


def covers(x: np.ndarray, conditions: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for at, threshold, above in conditions:
        out &= x[:, at] > threshold if above else x[:, at] <= threshold
    return out


def grow(x: np.ndarray, codes: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, least: int) -> tuple[list[tuple[Condition, ...]], np.ndarray]:
    """The paths of one tree of Newton steps, and its value for each row."""
    paths: list[tuple[Condition, ...]] = []
    value = np.zeros(len(x))

    def split(rows: np.ndarray, path: tuple[Condition, ...]) -> None:
        if path:
            paths.append(path)
        g, h = gradient[rows], hessian[rows]
        value[rows] = g.sum() / (h.sum() + 1.0)
        if len(path) == DEPTH or len(rows) < 2 * least:
            return
        best = (1e-6, None)
        for f in range(x.shape[1]):
            bins = len(cuts[f]) + 1
            c = codes[rows, f]
            left_g, left_h, left_n = (np.cumsum(np.bincount(c, w, bins))[:-1] for w in (g, h, None))
            if not len(left_g):
                continue
            gain = left_g**2 / (left_h + 1) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + 1) - g.sum() ** 2 / (h.sum() + 1)
            gain[(left_n < least) | (len(rows) - left_n < least)] = -1
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (f, k))
        if best[1]:
            f, k = best[1]
            above = codes[rows, f] > k
            split(rows[~above], (*path, (f, float(cuts[f][k]), False)))
            split(rows[above], (*path, (f, float(cuts[f][k]), True)))

    split(np.arange(len(x)), ())
    return paths, value


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic loss with an absolute penalty on weights, by accelerated proximal gradients."""
    n = len(y)
    w, b = np.zeros(z.shape[1]), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    rate = 4.0 * n / (np.linalg.norm(z, 2) ** 2 + n) if z.size else 1.0
    at_w, at_b, t = w, b, 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(z @ at_w + at_b))) - y
        new = at_w - rate * (z.T @ error) / n
        new = np.sign(new) * np.maximum(0, np.abs(new) - rate * penalty)
        new_b = at_b - rate * error.mean()
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        at_w, at_b = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    return w, b


def train(x: np.ndarray, y: np.ndarray, penalty: float = 2e-3) -> Ensemble:
    if len(y) == 0 or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
        return Ensemble([], float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    codes = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
    logit, found = np.zeros(len(y)), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-logit))
        paths, value = grow(x, codes, cuts, y - p, p * (1 - p), max(3, len(y) // 200))
        logit += 0.4 * value
        found |= dict.fromkeys(paths)
    distinct: dict[bytes, tuple[Condition, ...]] = {}
    for path in sorted(found, key=len):
        distinct.setdefault(covers(x, path).tobytes(), path)
    paths = list(distinct.values())
    z = np.stack([covers(x, p) for p in paths], axis=1).astype(float) if paths else np.zeros((len(y), 0))
    w, b = lasso(z, y, penalty)
    return Ensemble([(p, v) for p, v in zip(paths, w.tolist()) if abs(v) > 1e-4], b)


def fit(df: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> Ensemble:
    chosen = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    chosen = chosen.select(id_col, F.col(label_col).cast("int").alias("label_")).orderBy(F.xxhash64(id_col), id_col, "label_").limit(rows)
    sample = df.select(id_col, F.col(text_col).alias("text_")).join(F.broadcast(chosen), id_col)
    got = sample.orderBy(F.xxhash64(id_col, "text_"), "label_").limit(rows).select(statistics(F.col("text_")).alias("s"), "label_").select("s.*", "label_").collect()
    data = np.array([tuple(r) for r in got], float).reshape(-1, len(NAMES) + 1)
    return train(data[:, :-1], data[:, -1])


def scored(rows: DataFrame, model: Ensemble) -> DataFrame:
    """rows: kept and text. kept and score.

    The score is the element of an array, generated beside the row: a filter on it stays above, and the optimiser can't
    put the statistics into that filter once for each condition of each rule.
    """
    if not model.rules:
        return rows.select("kept", F.lit(1 / (1 + float(np.exp(-model.bias)))).alias("score"))
    counted = rows.select("kept", statistics(F.col("text")).alias("statistics"))
    return counted.select("kept", F.explode(F.array(model.score(F.col("statistics")))).alias("score"))


def digests(df: DataFrame, model: Ensemble, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Id, held_out, score and predicted."""
    out = scored(df.select(F.col(id_col).alias("kept"), F.col(text_col).alias("text")), model)
    return out.select(F.col("kept").alias(id_col), held_out(F.col("kept")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_accepted(df: DataFrame, model: Ensemble, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that aren't rejected, with all their columns."""
    return scored(packed(df, text=text_col), model).where(F.col("score") >= threshold).select("kept.*")
