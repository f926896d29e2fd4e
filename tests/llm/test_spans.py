"""Personal data and secrets against plain expressions over whole tables, and the field against enumeration."""

import hashlib
import itertools
import math
import random
import re

import pytest

from shelfwise.llm import pii, queries, secrets

SF = "/root/testdata/sf0.001"
PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub("[^0-9]", "", m[0])) <= 19 and luhn(re.sub("[^0-9]", "", m[0]))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15),
}
SECRETS = {
    "assign": (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
}


def luhn(digits):
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(map(int, str(2 * int(d)))) for d in even)) % 10 == 0


def spans(text, kinds):
    found = [(m.start(), list(kinds).index(k), k, m.end()) for k, (pattern, fits) in kinds.items() for m in re.finditer(pattern, text or "") if fits(m)]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found)), {k: sum(f[2] == k for f in found) for k in kinds}


@pytest.mark.parametrize("name, kinds", [("op7_pii", PII), ("op10_secrets", SECRETS)])
def test_base_spans_of_documents(spark, name, kinds):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.QUERIES[name](spark, SF).collect():
        want, many = spans(texts[r.doc_id], kinds)
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert {k: r[f"n_{k}"] for k in kinds} == many
        assert set(want.split(",")) - {""} <= set(r.spans.split(","))


def test_base_spans_of_odd_texts():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice(["4111", "1111", " ", "-", "+", "(", ")", ".", "555", "12", "a", "0"]) for _ in range(rng.randint(0, 14)))
        want, _ = spans(text, PII)
        assert ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(pii.base_spans(text), key=lambda s: (s[1], list(PII).index(s[0])))) == want
    for _ in range(3000):
        text = "".join(rng.choice(["token", "API_KEY", "apikey", "=", ": ", "'", '"', "abcd", "AKIA", "Z9Z9Z9Z9", "deadbeef", "x", "\n"]) for _ in range(rng.randint(0, 14)))
        want, _ = spans(text, SECRETS)
        assert ",".join(f"{k}:{a}:{b}" for (k, a, b), _ in sorted(secrets.base_spans(text), key=lambda s: (s[0][1], list(SECRETS).index(s[0][0])))) == want


def segmentations(n, segments):
    """Every way to lay out segments, each with a kind, over the tokens."""
    flat = [(i, j, a, b, f) for j, held in enumerate(segments) for i, a, b, f in held]

    def of(start):
        yield ()
        for i, j, a, b, f in flat:
            if i >= start:
                for kind in pii.KINDS:
                    for rest in of(j):
                        yield ((kind, a, b, f), *rest)

    return list(of(0))


@pytest.mark.parametrize("text, before", [("555-123-4567", "call"), ("1.2.3.4 7654321", ""), ("a1@b.de 1234567", "mail")])
def test_field_equals_enumeration(text, before):
    """The best segmentation, the likelihood and its gradient, against all segmentations."""
    rng = random.Random(9)
    field = pii.Field()
    n, segments = field.segments(text, before)
    for f in {x for held in segments for *_, found in held for x in found}:
        for kind in pii.KINDS:
            field.weights[kind, f] = rng.uniform(-1, 0.6)
    every = segmentations(n, segments)
    score = lambda s: sum(field.score(k, f) for k, _, _, f in s)
    best = max(every, key=score)
    assert field.decode(text, before) == [(k, a, b) for k, a, b, _ in best] or math.isclose(score(best), sum(field.score(k, f) for k, a, b in field.decode(text, before) for held in segments for _, x, y, f in held if (x, y) == (a, b)))
    gold = rng.choice(every)
    spans_of = {(k, a, b) for k, a, b, _ in gold}
    log_z = math.log(sum(math.exp(score(s)) for s in every))
    total = {}
    value = field.gradient(text, before, spans_of, lambda key, d: total.__setitem__(key, total.get(key, 0.0) + d))
    assert math.isclose(value, score(gold) - log_z, abs_tol=1e-9)
    p = [math.exp(score(s) - log_z) for s in every]
    for key in itertools.islice(sorted(total), 40):
        count = lambda s: sum(k == key[0] and key[1] in f for k, _, _, f in s)  # noqa: B023, E731
        assert math.isclose(total[key], count(gold) - sum(w * count(s) for w, s in zip(p, every)), abs_tol=1e-4)


def test_field_on_texts():
    """Precision and recall over generated texts that training didn't see."""
    rng, field = random.Random(77), pii.train()
    found = right = wanted = 0
    for _ in range(400):
        text, before, gold = pii.generated(rng)
        whole = f"{before} {text} end" if before else f"{text} end"
        shift = len(before) + 1 if before else 0
        base, added = pii.spans(field, whole)
        got, want = set(base) | set(added), {(k, a + shift, b + shift) for k, a, b in gold}
        found, right, wanted = found + len(got), right + len(got & want), wanted + len(want)
    assert right / found > 0.85 and right / wanted > 0.9, (right, found, wanted)


def test_long_hexadecimal_runs_hold_no_card():
    token = "faf2116c4111111111111111aa01c2d3e4f5a6b7"
    assert [s for s in pii.spans(pii.train(), f'token = "{token}" x')[1] if s[0] == "card"] == []


def test_ownership_of_planted_secrets(spark):
    """A value that owners share is an example; one that few hold is live, and its further spans show."""
    shared, own = "ghp_" + "aB3dE5fG7hJ9" * 3, "ghp_" + "zY8xW6vU4tS2" * 3
    rows = [(i, f"{i} use {shared} here", f"s{i % 6}") for i in range(12)] + [(100, f"mine {own}.", "s1"), (101, f"again {own}.", "s2"), (102, f"none {own[:20]}", None)]
    got = {r.doc_id: (r.spans, r.n_live) for r in secrets.digests(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i] == ("", 0) for i in range(12))
    assert got[100] == (f"vendor:5:{5 + len(own)}", 1) and got[101][1] == 1
