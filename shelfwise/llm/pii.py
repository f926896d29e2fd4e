"""Personal data by patterns and a semi-Markov conditional random field.

Patterns give the certain spans. The field looks at islands: neighbouring words that hold a digit or an at sign.
Its segments are whole spans of an island's tokens, scored by features of the whole span (groups of digits,
separators, check digits, the word before); dynamic programming over bounded segments chooses boundaries and
types together. It is trained here, by its exact gradient, on generated islands. What it finds beside the
certain spans is added; certain spans stay.

Null and empty text give no spans. A text of any length is read whole: an island of any length is decoded in
time linear in its tokens. A segment, as the method asks, is bounded: SEGMENT_TOKENS and SEGMENT_CHARS. Words without a
digit or at sign are in no island, so the field finds no names. Repeated rows are judged each by itself. Empty tables
give no rows; only the named columns are read.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import DataFrame

from shelfwise.llm.batches import map_rows
from shelfwise.llm.spans import Span, Taken, digest, joined

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "ssn", "iban"]
OTHER = "other"

LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A failing run of digits fails from each of its places, so matches start at none but its first.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from the at signs: in linear time."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    return out


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    out = emails(text)
    if re.search("[0-9]", text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        out += [("card", *m.span()) for m in CARD.finditer(text) if 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return out


#: An island: neighbouring words with a digit or at sign in each, one space between, and up to a comma or quote.
ISLAND = re.compile(r"""[^\s,;|"'<>0-9@]{0,64}[0-9@][^\s,;|"'<>]*(?:\x20[^\s,;|"'<>0-9@]{0,64}[0-9@][^\s,;|"'<>]*)*""")
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|(?s:.)")
BEFORE = re.compile(r"([A-Za-z]{1,20})[^A-Za-z0-9]{0,4}\Z")
#: Tokens and characters of the longest segment.
SEGMENT_TOKENS, SEGMENT_CHARS = 20, 48

def word_before(text: str, at: int) -> str:
    m = BEFORE.search(text[max(0, at - 24) : at])
    return m[1].lower() if m else ""


SHAPE = re.compile(r"[0-9]+|[A-Za-z]+")


def features(span: str, before: str) -> list[str]:
    """Of a whole span and the word before it."""
    digits = digits_of(span)
    shape = SHAPE.sub(lambda m: ("d" if m[0][0] <= "9" else "a") + str(min(len(m[0]), 9)), span)
    groups = "-".join(str(len(g)) for g in re.findall("[0-9]+", span))
    out = ["bias", f"groups {groups}", f"separators {''.join(sorted({c for c in span if not c.isalnum()}))}", f"digits {len(digits)}", f"before {before}"]
    if len(shape) <= 24:
        out.append(f"shape {shape}")
    if "@" in span:
        out.append("at")
        out.append("address" if re.fullmatch(r"[\w.%+-]+@[\w-]+(\.[\w-]+)+", span, re.A) else "broken at")
    elif re.search("[a-z]", span):
        out.append("small letters")
    if 13 <= len(digits) <= 19:
        out.append("check holds" if luhn(digits) else "check fails")
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", span, re.A):
        out.append("octets" if all(int(p) <= 255 for p in span.split(".")) else "large octets")
    if re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9\x20]{10,36}", span, re.A):
        compact = span.replace(" ", "")
        out.append("account" if int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1 else "no account")
    return out


class Field:
    """Weights of (kind, feature); a token outside all spans weighs nothing."""

    def __init__(self) -> None:
        self.weights: dict[tuple[str, str], float] = defaultdict(float)

    def segments(self, text: str, before: str) -> tuple[int, list[list[tuple[int, int, int, list[str]]]]]:
        """Number of tokens, and for each end the candidate segments: first token, start, end and features."""
        tokens = [m.span() for m in TOKEN.finditer(text)]
        out: list[list[tuple[int, int, int, list[str]]]] = [[] for _ in range(len(tokens) + 1)]
        for j in range(1, len(tokens) + 1):
            end = tokens[j - 1][1]
            if not text[end - 1].isalnum() or end < len(text) and text[end].isalnum():
                continue
            for i in range(j - 1, max(-1, j - 1 - SEGMENT_TOKENS), -1):
                start = tokens[i][0]
                if end - start > SEGMENT_CHARS:
                    break
                if not (text[start].isalnum() and not (start and text[start - 1].isalnum()) or text[start] in "+("):
                    continue
                span = text[start:end]
                many = len(digits_of(span))
                if "@" in span or 7 <= many <= 34 or span.count(".") == 3 and many >= 4:
                    word = word_before(text, start) if i else before
                    out[j].append((i, start, end, features(span, word)))
        return len(tokens), out

    def score(self, kind: str, found: list[str]) -> float:
        w = self.weights
        return sum(w.get((kind, f), 0.0) for f in found)

    def decode(self, text: str, before: str) -> list[Span]:
        """The best segmentation's spans."""
        n, segments = self.segments(text, before)
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for i, a, b, found in segments[j]:
                for kind in KINDS:
                    s = best[i] + self.score(kind, found)
                    if s > best[j]:
                        best[j], back[j] = s, (i, (kind, a, b))
        out, j = [], n
        while j:
            if back[j]:
                out.append(back[j][1])
                j = back[j][0]
            else:
                j -= 1
        return out[::-1]

    def gradient(self, text: str, before: str, gold: set[Span], add) -> float:
        """Calls add(weight, d log-likelihood) and returns the log-likelihood of the gold spans."""
        n, segments = self.segments(text, before)
        scored = [[(i, k, f, self.score(k, f), (k, a, b) in gold) for i, a, b, f in s for k in KINDS] for s in segments]
        forth, back = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
        forth[0] = back[n] = 0.0
        for j in range(1, n + 1):
            forth[j] = sum_exp([forth[j - 1], *(forth[i] + s for i, _, _, s, _ in scored[j])])
        into: list[list[float]] = [[] for _ in range(n + 1)]
        for j in range(n, 0, -1):
            if into[j]:
                back[j] = sum_exp([back[j], *into[j]]) if j == n else sum_exp(into[j])
            into[j - 1].append(back[j])
            for i, _, _, s, _ in scored[j]:
                into[i].append(back[j] + s)
        whole, gold_score = forth[n], 0.0
        for j in range(1, n + 1):
            for i, k, f, s, is_gold in scored[j]:
                p = math.exp(min(0.0, forth[i] + s + back[j] - whole))
                gold_score += s * is_gold
                if abs(is_gold - p) > 1e-6:
                    for x in f:
                        add((k, x), is_gold - p)
        return gold_score - whole


def sum_exp(values: list[float]) -> float:
    top = max(values)
    return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))


def generated(rng: random.Random) -> tuple[str, str, set[Span]]:
    """An island, the word before it and its spans."""
    digit = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))
    split = lambda s, sizes, by: by.join(s[sum(sizes[:i]) : sum(sizes[: i + 1])] for i in range(len(sizes)))
    kind = rng.choice([*KINDS, "phone", OTHER, OTHER, OTHER, OTHER])
    before = rng.choice(["", "", word()])
    if kind == "email":
        text = f"{word()}{rng.choice(['', '.' + word(), digit(2)])}@{word()}.{rng.choice(['com', 'org', 'net', 'example.com'])}"
    elif kind == "ip":
        text = ".".join(str(rng.randint(0, 255)) for _ in range(4))
    elif kind == "card":
        text = rng.choice("3456") + digit(14)
        text += next(d for d in "0123456789" if luhn(text + d))
        text = rng.choice([text, split(text, [4, 4, 4, 4], " "), split(text, [4, 4, 4, 4], "-")])
    elif kind == "phone":
        a, b, c = digit(3), digit(3), digit(4)
        text = rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digit(2)} {a} {b} {c}", f"+{digit(1)}-{a}-{b}-{c}", f"00{digit(2)} {a} {b} {c}"])
        before = rng.choice([before, "phone", "tel", "call", "mobile", "fax"])
    elif kind == "ssn":
        text = split(digit(9), [3, 2, 4], "-")
        before = rng.choice([before, "ssn", "security"])
    elif kind == "iban":
        body = "".join(rng.choice(["DE", "FR", "GB", "ES"])) + "00" + digit(18)
        check = 98 - int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97
        text = body[:2] + f"{check:02d}" + body[4:]
        text = rng.choice([text, split(text, [4, 4, 4, 4, 4, 2], " ")])
        before = rng.choice([before, "iban", "account"])
    else:
        wrong = rng.choice("3456") + digit(14)
        wrong += next(d for d in "0123456789" if not luhn(wrong + d))
        text = rng.choice([
            digit(rng.randint(7, 20)), f"20{digit(2)}-{digit(2)}-{digit(2)}", f"{digit(2)}.{digit(2)}.20{digit(2)}", f"{digit(1)}.{digit(2)}.{digit(1)}.{digit(4)}", wrong,
            f"{digit(3)} {digit(3)} {digit(3)}", f"{digit(2)} {digit(4)} {digit(2)}", f"@{word()}{digit(3)}", f"{word()}@{word()}", f"{digit(1)}.{digit(7)}", f"{digit(8)}-{digit(4)}-{digit(4)}-{digit(12)}",
            f"{digit(4)}-{digit(4)}", f"{digit(4)}-{digit(2)}-{digit(2)} {digit(2)}:{digit(2)}:{digit(2)}", f"v{digit(1)}.{digit(1)}.{digit(2)} {digit(6)}", f"{rng.randint(256, 999)}.{digit(1)}.{digit(1)}.{digit(1)}", "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([8, 32, 40]))),
        ])
        return text, before, set()
    head = rng.choice(["", "", f"{digit(rng.randint(1, 4))} ", f"{word()}{digit(1)} "])
    tail = rng.choice(["", "", ".", ")", f" {digit(rng.randint(1, 2))}{word()}"])
    if kind in ("card", "phone", "iban", "ssn"):
        head = ""
    return head + text + tail, before, {(kind, len(head), len(head) + len(text))}


def train(islands: int = 240, rounds: int = 6, seed: int = 7, rate: float = 0.25, decay: float = 1e-3) -> Field:
    """A field fitted by AdaGrad on the log-likelihood of generated islands."""
    rng, field = random.Random(seed), Field()
    data = [generated(rng) for _ in range(islands)]
    squares: Counter = Counter()
    for _ in range(rounds):
        rng.shuffle(data)
        for text, before, gold in data:
            total: Counter = Counter()

            def add(key, d, total=total):
                total[key] += d

            field.gradient(text, before, gold, add)
            for key, d in total.items():
                d -= decay * field.weights[key]
                squares[key] += d * d
                field.weights[key] += rate * d / math.sqrt(squares[key])
    field.weights = dict(field.weights)
    return field


def spans(field: Field, text: str | None) -> tuple[list[Span], list[Span]]:
    """Certain spans, and those that the field adds beside them."""
    text = text or ""
    base = base_spans(text)
    added, used = [], Taken(base)
    for m in ISLAND.finditer(text):
        if len(m[0]) >= 7:
            for kind, a, b in field.decode(m[0], word_before(text, m.start())):
                if used.claim(a + m.start(), b + m.start()):
                    added.append((kind, a + m.start(), b + m.start()))
    return base, added


def scan(df: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, n_email, n_ip, n_card, n_phone and base_sha256 of the certain spans, and spans, all of them."""
    shared = df.sparkSession.sparkContext.broadcast(dict((field or train()).weights))

    def make():
        model = Field()
        model.weights = shared.value

        def row(key, text):
            base, added = spans(model, text)
            many = Counter(k for k, _, _ in base)
            return (key, *(many[k] for k in BASE), digest(base, KINDS), joined(base + added, KINDS))

        return row

    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"
    return map_rows(df.select(id_col, text_col), schema, make)
