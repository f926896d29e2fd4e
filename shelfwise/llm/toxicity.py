"""Toxicity: a bidirectional gated recurrent network with attention pooling, over character and word inputs.

A word's input joins what is known of the word and of its character n-grams: log-odds of the label, counted
over documents, and embeddings that are learned with the network. The network reads windows of 32 words; every
text is scored in windows that start every 8 words, each sharing 24 with the next, and its score is that of its worst window,
calibrated on documents. Training is in numpy, on a bounded sample of labelled rows, whose whole texts are read, and the
same for the same rows.

Null, empty and wordless texts get the score of a window without words. Long texts have as many windows as
their words need. With no labels, or one class only, every score is that class's share. Repeated rows get
equal scores. Labels that are neither 0 nor 1 aren't learned from. Empty tables give no rows. Only the named columns are
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.batches import held_out, map_slices
from shelfwise.llm.decontaminate import words

#: Labelled rows that are learned from, at most: those with the smallest hashes, up to so many bytes of text together.
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 64 << 20
#: Words of a window, and from one window's start to the next's.
WINDOW, STRIDE = 32, 8
#: Words with an embedding of their own, at most: those of the greatest log-odds; the others have their n-grams'.
EMBEDDED_WORDS = 20_000
HIDDEN, LEARNED, GRAM_BUCKETS, GRAMS = 8, 3, 1 << 15, (3, 4, 5)
INPUT = 2 + LEARNED + 2 + LEARNED
#: Steps of the optimiser, at least, and windows of a step.
STEPS, BATCH_WINDOWS = 150, 256
#: Kinds of windows, and the part of a step's that they make: a clean text's worst, a toxic one's worst, and clean ones in order.
PLAIN = 2
SHARES = {0: 2, 1: 8, PLAIN: 3}
KNOWN_WORDS, BATCH = 200_000, 4096


def gram_buckets(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each word its n-grams' buckets, and which places hold one: arrays of a row for each word."""
    longest = max(map(len, batch)) + 2
    raw = np.frombuffer(b"".join(b"^" + w + b"$" + b"\0" * (longest - 2 - len(w)) for w in batch), np.uint8).reshape(len(batch), longest).astype(np.uint64)
    size = np.array([len(w) + 2 for w in batch])
    found, valid = [], []
    for n in GRAMS:
        many = longest - n + 1
        if many < 1:
            continue
        h = np.full((len(batch), many), n, np.uint64)
        for k in range(n):
            h = (h ^ raw[:, k : k + many]) * np.uint64(0x100000001B3)
        found.append(((h ^ (h >> np.uint64(29))) % np.uint64(GRAM_BUCKETS)).astype(np.int32))
        valid.append(np.arange(many)[None, :] + n <= size[:, None])
    return np.concatenate(found, axis=1), np.concatenate(valid, axis=1)


def by_length(batch: list[bytes]) -> list[np.ndarray]:
    """Places of words of like length, so that one long word makes no large array; very long words one by one."""
    size = np.array([len(w) for w in batch])
    out = [np.flatnonzero((size > a) & (size <= b)) for a, b in ((-1, 8), (8, 16), (16, 32), (32, 64))]
    return [p for p in out if p.size] + [np.array([i]) for i in np.flatnonzero(size > 64)]


def log_odds(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int, prior: float) -> np.ndarray:
    """Of a document of class 1 holding it against one of class 0, shrunk to nothing for what few documents hold."""
    ratio = n_neg / n_pos
    return np.log((pos + prior) / (n_pos + 2 * prior)) - np.log((neg + prior * ratio) / (n_neg + 2 * prior * ratio))


@dataclass
class Model:
    word_odds: dict[bytes, float] = field(default_factory=dict)
    gram_odds: np.ndarray = None
    word_rows: dict[bytes, int] = field(default_factory=dict)
    p: dict[str, np.ndarray] = field(default_factory=dict)
    scale: tuple[float, float] = (1.0, 0.0)
    constant: float | None = None

    def inputs(self, batch: list[bytes]) -> np.ndarray:
        """A row for each word."""
        out = np.zeros((len(batch), INPUT), np.float32)
        w = np.array([self.word_odds.get(x, 0.0) for x in batch])
        out[:, 0], out[:, 1] = w, [x in self.word_odds for x in batch]
        out[:, 2 : 2 + LEARNED] = self.p["words"][[self.word_rows.get(x, 0) for x in batch]]
        for at in by_length(batch):
            b, ok = gram_buckets([batch[i] for i in at])
            odds = np.where(ok, self.gram_odds[b], 0.0)
            c = 2 + LEARNED
            out[at, c], out[at, c + 1] = odds.max(axis=1), odds.min(axis=1)
            out[at, c + 2 :] = (self.p["grams"][b] * ok[..., None]).sum(axis=1) / ok.sum(axis=1, keepdims=True)
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def direction(p: dict, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
    """Hidden states [T, B, H] of one direction; x: projected inputs [T, B, 3H]."""
    steps, many = x.shape[:2]
    h = np.zeros((many, HIDDEN), np.float32)
    out = np.empty((steps, many, HIDDEN), np.float32)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        zr = sigmoid(x[t, :, : 2 * HIDDEN] + h @ p[f"u{d}"])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(x[t, :, 2 * HIDDEN :] + (r * h) @ p[f"v{d}"])
        new = n + z * (h - n)
        m = mask[t][:, None]
        new = h + m * (new - h)
        if keep is not None:
            keep.append((t, h, z, r, n, m))
        out[t] = h = new
    return out


def forward(p: dict, projected: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logits; projected: [T, B, 6H]."""
    both = [direction(p, d, projected[:, :, k * 3 * HIDDEN : (k + 1) * 3 * HIDDEN], mask, None if keep is None else keep.setdefault(d, [])) for k, d in enumerate("fb")]
    h = np.concatenate(both, axis=2)
    a = h @ p["attend"]
    a = np.where(mask > 0, a, -1e9)
    a = np.exp(a - a.max(axis=0))
    a *= mask
    a /= np.maximum(a.sum(axis=0), 1e-9)
    pooled = (a[:, :, None] * h).sum(axis=0)
    if keep is not None:
        keep.update(h=h, a=a, pooled=pooled)
    return pooled @ p["out"] + p["bias"][0]


def backward(p: dict, x: np.ndarray, mask: np.ndarray, keep: dict, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the weights, and of the inputs x [T, B, INPUT]."""
    g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("words", "grams")}
    h, a = keep["h"], keep["a"]
    g["out"], g["bias"] = keep["pooled"].T @ d_logit, np.array([d_logit.sum()], np.float32)
    d_pooled = d_logit[:, None] * p["out"][None, :]
    d_a = (h * d_pooled[None]).sum(axis=2)
    d_s = a * (d_a - (a * d_a).sum(axis=0))
    g["attend"] = np.einsum("tb,tbh->h", d_s, h)
    d_h = a[:, :, None] * d_pooled[None] + d_s[:, :, None] * p["attend"]
    d_x = np.zeros_like(x)
    for k, d in enumerate("fb"):
        carry = np.zeros((x.shape[1], HIDDEN), np.float32)
        for t, before, z, r, n, m in reversed(keep[d]):
            carry = carry + d_h[t, :, k * HIDDEN : (k + 1) * HIDDEN]
            new, through = carry * m, carry * (1 - m)
            d_n = new * (1 - z) * (1 - n * n)
            d_z = new * (before - n) * z * (1 - z)
            rh = d_n @ p[f"v{d}"].T
            d_r = rh * before * r * (1 - r)
            d_zr = np.concatenate([d_z, d_r], axis=1)
            g[f"v{d}"] += (r * before).T @ d_n
            g[f"u{d}"] += before.T @ d_zr
            d_in = np.concatenate([d_zr, d_n], axis=1)
            g[f"w{d}"] += x[t].T @ d_in
            g[f"b{d}"] += d_in.sum(axis=0)
            d_x[t] += d_in @ p[f"w{d}"].T
            carry = through + new * z + rh * r + d_zr @ p[f"u{d}"].T
    return g, d_x


def windows_of(n: int) -> range:
    """Where the windows of a text of n words start; a text without words has one."""
    return range(0, max(1, n - WINDOW + STRIDE if n > WINDOW else 1), STRIDE)


def odds_of(docs: list[set[bytes]], grams: dict[bytes, np.ndarray], label: np.ndarray) -> tuple[dict[bytes, float], np.ndarray]:
    """Log-odds of the words that three documents hold, and of n-grams."""
    n = [int((label == 0).sum()), int((label == 1).sum())]
    of_words: list[dict[bytes, int]] = [{}, {}]
    of_grams = np.zeros((2, GRAM_BUCKETS))
    for d, y in zip(docs, label):
        for w in d:
            of_words[y][w] = of_words[y].get(w, 0) + 1
        if d:
            of_grams[y, np.unique(np.concatenate([grams[w] for w in d]))] += 1
    kept = [w for w in {*of_words[0], *of_words[1]} if of_words[0].get(w, 0) + of_words[1].get(w, 0) >= 3]
    pos, neg = (np.array([of_words[y].get(w, 0) for w in kept], float) for y in (1, 0))
    prior = max(1.0, 0.5 * n[1] ** 0.5)
    return dict(zip(kept, log_odds(pos, neg, max(1, n[1]), max(1, n[0]), prior))), log_odds(of_grams[1], of_grams[0], max(1, n[1]), max(1, n[0]), prior)


def drawn(kind: np.ndarray, rng: np.random.Generator, steps: int) -> Iterator[np.ndarray]:
    """Batches of windows, in which each kind has its share; of a kind every window comes once before any comes twice."""
    held = {k: np.flatnonzero(kind == k) for k in SHARES}
    order = {k: np.zeros(0, int) for k in SHARES}
    for _ in range(steps):
        parts = []
        for k, share in SHARES.items():
            n = min(BATCH_WINDOWS // share, len(held[k]) * 8)
            while len(order[k]) < n:
                order[k] = np.concatenate([order[k], rng.permutation(held[k])])
            parts.append(order[k][:n])
            order[k] = order[k][n:]
        yield np.concatenate(parts)


def train(texts: list[str], labels: list[int], rounds: int = 6, seed: int = 5, rate: float = 0.02) -> Model:
    """A network for labelled texts. Log-odds that it learns from come from the other half of the documents."""
    label = np.array(labels, int)
    if len(set(labels)) < 2:
        return Model(constant=float(np.mean(label)) if labels else 0.0)
    rng = np.random.default_rng(seed)
    order = sorted(range(len(texts)), key=lambda i: hashlib.md5((texts[i] or "").encode("utf-8", "replace")).digest())
    docs, label = [words(texts[i]) for i in order], label[order]
    sets = [set(d) for d in docs]
    everything = sorted(set().union(*sets))
    grams: dict[bytes, np.ndarray] = {}
    for at in by_length(everything) if everything else []:
        b, ok = gram_buckets([everything[i] for i in at])
        grams.update((everything[i], b[k][ok[k]]) for k, i in enumerate(at))
    model = Model(*odds_of(sets, grams, label))
    often = sorted(model.word_odds, key=lambda w: (-abs(model.word_odds[w]), w))[:EMBEDDED_WORDS]
    model.word_rows = {w: i + 1 for i, w in enumerate(often)}
    f32 = lambda *shape, s=0.3: rng.normal(0, s, shape).astype(np.float32)
    p = {"words": f32(len(often) + 1, LEARNED, s=0.05), "grams": f32(GRAM_BUCKETS, LEARNED, s=0.05), "attend": f32(2 * HIDDEN), "out": f32(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
    for d in "fb":
        p |= {f"w{d}": f32(INPUT, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32), f"u{d}": f32(HIDDEN, 2 * HIDDEN), f"v{d}": f32(HIDDEN, HIDDEN)}
    model.p = p

    # Windows: of each text the one around the word of the greatest odds, which is looked for in the whole text, and of a
    # clean text all of it, window beside window; the other windows of a toxic text may be clean.
    half = np.arange(len(docs)) % 2
    chosen: list[tuple[list[bytes], int, int]] = []
    crossed = []
    for side in (0, 1):
        other = Model(*odds_of([s for s, x in zip(sets, half) if x != side], grams, label[half != side]), model.word_rows, p)
        crossed.append(other)
        best = {w: max(other.word_odds.get(w, 0.0), float(other.gram_odds[grams[w]].max())) for w in everything}
        for i in np.flatnonzero(half == side):
            d = docs[i]
            worst = max(range(len(d)), key=lambda k: best[d[k]], default=0)
            at = max(0, min(worst - WINDOW // 2, len(d) - WINDOW))
            chosen.append((d[at : at + WINDOW], 1 if label[i] else 0, side))
            chosen += [(d[s : s + WINDOW], PLAIN, side) for s in range(0, 0 if label[i] else len(d), WINDOW)]
    distinct = sorted({w for c, _, _ in chosen for w in c})
    number = {w: i + 1 for i, w in enumerate(distinct)}
    fixed = []
    for other in crossed:
        fixed.append(np.concatenate([np.zeros((1, INPUT), np.float32), other.inputs(distinct)]) if distinct else np.zeros((1, INPUT), np.float32))
    ids = np.zeros((len(chosen), WINDOW), int)
    for k, (c, _, _) in enumerate(chosen):
        ids[k, : len(c)] = [number[w] for w in c]
    kind, side = np.array([c[1] for c in chosen]), np.array([c[2] for c in chosen])
    y = (kind == 1).astype(np.float32)
    rows = np.array([0] + [model.word_rows.get(w, 0) for w in distinct])
    grams_of = [np.zeros(1, np.int32), *(grams[w] for w in distinct)]
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    step, c = 0, 2 + LEARNED
    for b in drawn(kind, rng, max(STEPS, rounds * 2 * len(docs) // BATCH_WINDOWS)):
        used, inverse = np.unique(ids[b], return_inverse=True)
        x = np.stack([fixed[0][ids[b]], fixed[1][ids[b]]])[side[b], np.arange(len(b))]
        x[:, :, 2:c] = p["words"][rows[ids[b]]]
        size = np.array([len(grams_of[i]) for i in used])
        places = np.concatenate([grams_of[i] for i in used])
        of_used = np.add.reduceat(p["grams"][places], np.cumsum(size) - size) / size[:, None]
        x[:, :, c + 2 :] = of_used[inverse.reshape(len(b), WINDOW)]
        x, mask = np.ascontiguousarray(x.transpose(1, 0, 2)), (ids[b].T > 0).astype(np.float32)
        projected = np.concatenate([x @ p[f"w{d}"] + p[f"b{d}"] for d in "fb"], axis=2)
        keep: dict = {}
        d_logit = ((sigmoid(forward(p, projected, mask, keep)) - y[b]) / len(b)).astype(np.float32)
        g, d_x = backward(p, x, mask, keep, d_logit)
        d_x = (d_x * mask[..., None]).transpose(1, 0, 2).reshape(-1, INPUT)
        g["words"] = np.zeros_like(p["words"])
        np.add.at(g["words"], rows[ids[b]].ravel(), d_x[:, 2:c])
        of_words = np.zeros((len(used), LEARNED), np.float32)
        np.add.at(of_words, inverse.ravel(), d_x[:, c + 2 :])
        g["grams"] = np.zeros_like(p["grams"])
        np.add.at(g["grams"], places, np.repeat(of_words / size[:, None], size, axis=0).astype(np.float32))
        step += 1
        for k, v in g.items():
            m = moments[k]
            m[0] = 0.9 * m[0] + 0.1 * v
            m[1] = 0.99 * m[1] + 0.01 * v * v
            p[k] -= (rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    # Scale and shift of the worst window's logit, by gradient steps on the documents, each scored with the other half's odds.
    z = np.zeros(len(docs))
    for s, other in enumerate(crossed):
        at = np.flatnonzero(half == s)
        z[at] = Scorer(other).logits([docs[i] for i in at])
    a, b = 1.0, 0.0
    for _ in range(400):
        error = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30))) - label
        a = min(2.0, max(0.5, a - 0.05 * float((z * error).mean())))
        b -= 0.2 * float(error.mean())
    model.scale = (a, b)
    return model


class Scorer:
    """Scores texts; projections of words that were met are kept."""

    def __init__(self, model: Model):
        self.model, self.p = model, model.p
        self.rows: dict[bytes, int] = {}
        self.projections = np.zeros((1, 6 * HIDDEN), np.float32)

    def numbers(self, docs: list[list[bytes]]) -> list[list[int]]:
        if len(self.rows) > KNOWN_WORDS:
            self.rows, self.projections = {}, self.projections[:1]
        new = list(set().union(*docs).difference(self.rows)) if docs else []
        if new:
            x = self.model.inputs(new)
            first = len(self.projections)
            self.projections = np.concatenate([self.projections, np.concatenate([x @ self.p[f"w{d}"] + self.p[f"b{d}"] for d in "fb"], axis=1)])
            self.rows.update(zip(new, range(first, first + len(new))))
        get = self.rows.__getitem__
        return [list(map(get, d)) for d in docs]

    def logits(self, docs: list[list[bytes]]) -> np.ndarray:
        """The greatest logit of each text's windows."""
        numbers = self.numbers(docs)
        flat = np.fromiter((i for d in numbers for i in d), np.int64, sum(map(len, numbers)))
        flat = np.concatenate([flat, np.zeros(WINDOW, np.int64)])
        size = np.array([len(d) for d in docs])
        many = np.maximum(1, -(-np.maximum(0, size - WINDOW) // STRIDE) + 1)
        doc = np.repeat(np.arange(len(docs)), many)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * STRIDE
        first = np.repeat(np.cumsum(size) - size, many) + start
        left = np.minimum(WINDOW, np.repeat(size, many) - start)
        out = np.full(len(docs), -np.inf)
        for at in range(0, len(doc), BATCH):
            f, n = first[at : at + BATCH], left[at : at + BATCH]
            steps = np.arange(max(1, int(n.max())))[:, None]
            mask = (steps < n[None, :]).astype(np.float32)
            ids = np.where(mask > 0, flat[np.minimum(f[None, :] + steps, len(flat) - 1)], 0)
            np.maximum.at(out, doc[at : at + BATCH], forward(self.p, self.projections[ids], mask))
        return out

    def scores(self, texts: list[str | None]) -> list[float]:
        if self.model.constant is not None:
            return [self.model.constant] * len(texts)
        a, b = self.model.scale
        z = a * self.logits([words(t) for t in texts]) + b
        return (1 / (1 + np.exp(-np.clip(z, -60, 60)))).tolist()


def labelled_sample(df: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """Texts and labels of at most `rows` labelled rows that aren't held out, those of the smallest hashes of their ids.

    Of these the texts of the smallest hashes, as far as SAMPLE_BYTES go: that much and no more comes to the driver.
    """
    chosen = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    chosen = chosen.select(id_col, F.col(label_col).cast("int").alias("label_")).orderBy(F.xxhash64(id_col), id_col, "label_").limit(rows)
    sample = df.select(id_col, F.col(text_col).alias("text_")).join(F.broadcast(chosen), id_col).select("text_", "label_", F.xxhash64("text_").alias("hash_"))
    sample = sample.orderBy("hash_", "label_").limit(rows)
    so_far = F.sum(F.coalesce(F.octet_length("text_"), F.lit(0))).over(Window.orderBy("hash_", "label_").rowsBetween(Window.unboundedPreceding, 0))
    return sample.withColumn("so_far_", so_far).where(F.col("so_far_") <= SAMPLE_BYTES).select("text_", "label_")


def fit(df: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> Model:
    sample = labelled_sample(df, labels, label_col, id_col, text_col, rows).collect()
    return train([r[0] or "" for r in sample], [r[1] for r in sample])


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Id, held_out, score and predicted of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)
        return lambda keys, texts: list(zip(keys, scorer.scores(texts)))

    kind = df.schema[id_col].dataType.simpleString()
    out = map_slices(df.select(id_col, text_col), f"`{id_col}` {kind}, score double", make, limit=2 << 20)
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
