"""Every stage of the pipeline against a plain version of it, on what the stage before kept."""

import itertools
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from shelfwise.llm import bpe, neardup, quality, queries, secrets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before the first stage and after each, by doc_id."""
    docs, out = queries.table(spark, SF, "documents"), []
    out.append({r.doc_id: r for r in docs.collect()})
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        out.append({r.doc_id: r for r in docs.collect()})
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "secret scans", "byte-level BPE"]
    first = next(iter(stages[0].values()))
    assert all(r.__fields__ == first.__fields__ for held in stages[1:5] for r in held.values())


def numbers(text):
    """The statistics of a text by plain counting."""
    text = text or ""
    words, lines = [w for w in re.split(r"\s+", text, flags=re.A) if w], text.split("\n")
    share = lambda x, of: x / of if of else 0.0
    count = lambda f: sum(map(f, text))
    letter = lambda c: c.isalpha() or c in " \t\n\x0b\f\r"
    return [len(text), len(words), share(len(text), len(words)), share(len(set(words)), len(words)), share(len(set(lines)), len(lines)),
            share(count(str.isupper), len(text)), share(count(lambda c: not letter(c)), len(text)), share(text.count("|"), len(text)),
            share(count(lambda c: "0" <= c <= "9"), len(text)), share(count(lambda c: c in "%&$#*!@<>{}"), len(text)), share(count(lambda c: c in ".,;:?"), len(words))]


def test_quality(spark, stages):
    model = quality.fit(queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels"))
    x = np.array([numbers(r.text) for r in stages[0].values()], float)
    logit = model.bias + sum((w * quality.covers(x, c) for c, w in model.rules), np.zeros(len(x)))
    assert set(stages[1]) == {i for i, z in zip(stages[0], logit) if 1 / (1 + np.exp(-z)) >= quality.THRESHOLD}


def test_near_duplicates(stages):
    sets = {i: neardup.shingles(r.text) for i, r in stages[1].items()}
    group = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and group[a] != group[b]:
            low, high = sorted((group[a], group[b]))
            group.update({i: low for i, g in group.items() if g == high})
    assert set(stages[2]) == set(group.values())


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_decontamination(spark, stages):
    windows = set()
    for r in queries.table(spark, SF, "benchmark").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    stay = set()
    for i, r in stages[2].items():
        w = words(r.text)
        hit = {k for n in {len(x) for x in windows} for s in range(len(w) - n + 1) if tuple(w[s : s + n]) in windows for k in range(s, s + n)}
        if not hit or 20 * len(hit) < len(w):
            stay.add(i)
    assert set(stages[3]) == stay


def test_secrets(stages):
    found, owners, texts = {}, defaultdict(set), defaultdict(set)
    for i, r in stages[3].items():
        base = secrets.base_spans(r.text or "")
        found[i] = base + secrets.more_spans(r.text or "", [s for s, _ in base])
        for _, value in found[i]:
            owners[value].add(r.source if r.source is not None else ("alone", i))
            texts[value].add(r.text)
    assert set(stages[4]) == set(stages[3])
    for i, r in stages[4].items():
        live = {v for _, v in found[i] if len(owners[v]) < secrets.EXAMPLE_OWNERS and len(texts[v]) < secrets.EXAMPLE_DOCUMENTS}
        covered = [(a, b) for (_, a, b), v in found[i] if v in live]
        before = stages[3][i].text
        if not covered:
            assert r.text == before
            continue
        hidden = np.zeros(len(before), bool)
        for a, b in covered:
            hidden[a:b] = True
        plain = "".join(c for c, h in zip(before, hidden) if not h)
        assert r.text.replace(secrets.MASK, "") == plain and secrets.MASK in r.text and r.n_chars == len(r.text)


def test_encoding(stages):
    with open(public_tokenizers.path(queries.VOCABULARY), "rb") as f:
        ranks = bpe.Codec(f.read(), public_tokenizers.PATTERN).ranks
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert set(stages[5]) == set(stages[4])
    for i, r in stages[5].items():
        assert r.ids == known.encode_ordinary(stages[4][i].text or "") and r.round_trip and r.n_tokens == len(r.ids)
