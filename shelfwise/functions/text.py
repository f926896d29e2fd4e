"""Canonical forms, keys and fingerprints of text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The alphabet that canonical text keeps, and named characters that markup escapes.
KEPT = "0-9a-zа-я"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def filled(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def unescaped(text: Column) -> Column:
    for name, value in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(value))
    return text


def untagged(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", " ")


def cleaned(text: Column) -> Column:
    """Lower case, yo as ye, other characters than the kept ones as single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), "ё", "е"), f"[^{KEPT}]+", " "))


def normalized(text: Column) -> Column:
    """No markup, lower case, yo as ye, other characters as single spaces."""
    return cleaned(untagged(unescaped(filled(text))))


def light(text: Column) -> Column:
    """Lower case, yo as ye, white space collapsed; markup and punctuation stay."""
    return F.trim(F.regexp_replace(F.translate(F.lower(filled(text)), "ё", "е"), r"\s+", " "))


def digit_masked(text: Column) -> Column:
    """Normalised text whose numbers, with a decimal part or without, are '#'."""
    plain = F.regexp_replace(unescaped(filled(text)), "<[^>]+>", " ")
    masked = F.regexp_replace(F.translate(F.lower(plain), "ё#", "е "), r"[0-9]+(?:[.,][0-9]+)*", "#")
    return F.trim(F.regexp_replace(masked, f"[^#{KEPT}]+", " "))


def composed(name: Column, description: Column) -> Column:
    """The name twice and the description, a line each."""
    return F.concat_ws("\n", filled(name), filled(name), filled(description))


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(normalized(text), " "), "")


def token_signature(text: Column, least: int = 3) -> Column:
    """Sorted distinct tokens of at least `least` characters."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(tokens(text), lambda t: F.length(t) >= least))), " ")


def once(value: Column, use) -> Column:
    """use(value) with the value computed one time, however often a lambda in use reads it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def windows(items: Column, width: int, between: str) -> Column:
    """Distinct runs of `width` neighbours, joined: shifted arrays are zipped, so the cost is linear."""
    many = F.size(items) - width + 1
    out = F.slice(items, 1, many)
    for k in range(1, width):
        out = F.zip_with(out, F.slice(items, k + 1, many), lambda a, b: F.concat(a, F.lit(between), b))
    return F.when(many > 0, F.array_distinct(out)).otherwise(F.array().cast("array<string>"))


def char_shingles(text: Column, width: int = 3) -> Column:
    """Distinct character windows of text padded by two spaces; empty text has none."""
    nothing = F.array().cast("array<string>")
    padded = lambda t: F.filter(F.split(F.concat(F.lit("  "), t, F.lit("  ")), ""), lambda x: x != "")
    return once(normalized(text), lambda t: F.when(t == "", nothing).otherwise(once(padded(t), lambda chars: windows(chars, width, ""))))


def word_shingles(text: Column, width: int = 5) -> Column:
    """Distinct windows of words; fewer words have none."""
    return once(tokens(text), lambda w: windows(w, width, " "))


def compacted(text: Column, budget: int) -> Column:
    """A text over budget keeps its first 70 % and its last characters around an ellipsis."""
    text, mark = filled(text), " … "
    head = int(budget * 0.7)
    tail = budget - head - len(mark)
    cut = F.concat(F.rtrim(F.substring(text, 1, head)), F.lit(mark), F.ltrim(F.expr("''") if tail <= 0 else F.substring(text, -tail, tail)))
    return F.when(F.length(text) <= budget, text).otherwise(cut)


def stable_rank(*parts: Column) -> Column:
    """32 hex digits whose order is that of the first 128 bits of sha256 over parts joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 32)


def capped_count(text: Column, pattern: str, cap: int = 3) -> Column:
    return F.least(F.lit(cap), F.size(F.regexp_extract_all(filled(text), F.lit(pattern), F.lit(0))))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def piecewise(score: Column, threshold: Column) -> Column:
    """A threshold in (0, 1) maps to a half, each side linearly."""
    low = 0.5 * score / threshold
    high = 0.5 + 0.5 * (score - threshold) / (1 - threshold)
    return F.when(score < threshold, low).otherwise(high)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, floor: float = 1e-12) -> Column:
    return dot(a, b) / (F.greatest(F.sqrt(dot(a, a)), F.lit(floor)) * F.greatest(F.sqrt(dot(b, b)), F.lit(floor)))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def ocr_form(text: Column) -> Column:
    """Lower case, yo as ye, other characters as single spaces; markup is text like any other."""
    return F.trim(F.regexp_replace(F.replace(F.lower(filled(text)), F.lit("ё"), F.lit("е")), "[^0-9a-zа-я]+", " "))


def masked_quantity(name: Column, words: int = 3, letters: int = 10) -> Column:
    """Numbers that stand alone are '#', mixed tokens stay; empty unless one is masked beside enough words and letters."""
    parts = F.filter(F.split(ocr_form(name), " "), lambda t: t != "")

    def form(w: Column) -> Column:
        alpha = F.filter(w, lambda t: t.rlike("^[a-zа-я]+$"))
        masked = F.transform(w, lambda t: F.when(t.rlike("^[0-9]+$"), "#").otherwise(t))
        enough = F.array_contains(masked, "#") & (F.size(alpha) >= words) & (F.length(F.array_join(alpha, "")) >= letters)
        return F.when(enough, F.array_join(masked, " ")).otherwise("")

    return once(parts, form)


def falsy_to_empty(value: Column) -> Column:
    """Of a number: null and zero are empty; anything else is its text, 'nan' too."""
    return F.when(F.isnan(value), "nan").when(value.isNull() | (value == 0), "").otherwise(value.cast("string"))


def nan_to_empty(value: Column) -> Column:
    return F.when(value.isNull() | F.isnan(value), "").otherwise(value.cast("string"))


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def strict_boolean(text: Column) -> Column:
    """True and false by their exact names; any other text is an error when it is read."""
    return F.when(text == "true", True).when(text == "false", False).otherwise(F.raise_error(F.concat(F.lit("no boolean: "), F.coalesce(text, F.lit("null")))).cast("boolean"))


def normalized_with_yo(text: Column) -> Column:
    """As normalized, but yo stays a letter of its own."""
    return F.trim(F.regexp_replace(F.lower(untagged(filled(text))), f"[^{KEPT}ё]+", " "))


def masked_name(name: Column, words: int = 3, letters: int = 10) -> Column:
    """The name with masked numbers; empty unless one is masked beside enough words and letters."""

    def form(w: Column) -> Column:
        alpha = F.filter(w, lambda t: (t != "#") & t.rlike("[a-zа-я]"))
        enough = (F.size(alpha) >= words) & (F.length(F.regexp_replace(F.array_join(alpha, ""), "[^a-zа-я]", "")) >= letters) & F.array_contains(w, "#")
        return F.when(enough, F.array_join(w, " ")).otherwise("")

    return once(F.split(digit_masked(name), " "), form)


def full_text(name: Column, description: Column) -> Column:
    """Normalised name and description, a line each; empty only if both are."""
    a, b = normalized(name), normalized(description)
    return F.when((a == "") & (b == ""), "").otherwise(F.concat_ws("\n", a, b))


def gated_features(name: Column, description: Column) -> tuple[Column, Column]:
    """Distinct words of three letters or with a digit, and distinct pairs of neighbours of seven letters together."""
    words = F.concat(tokens(name), tokens(name), tokens(description))
    long = lambda a, b: F.when(F.length(a) + F.length(b) >= 7, F.concat(a, F.lit(" "), b))
    pairs = lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), long)
    return F.array_distinct(F.filter(words, lambda t: (F.length(t) >= 3) | t.rlike("[0-9]"))), once(words, lambda w: F.array_distinct(F.array_compact(pairs(w))))


def word_bound_ngrams(text: Column, least: int, most: int) -> Column:
    """Runs of `least` to `most` characters of each word between blanks, padded by one; a padded word shorter than a run counts once."""

    def of_word(w: Column) -> Column:
        run = lambda p, n: F.transform(F.sequence(F.lit(0), F.greatest(F.length(p) - n, F.lit(0))), lambda i: F.substring(p, i + 1, n))
        sizes = lambda p: F.filter(F.sequence(F.lit(least), F.lit(most)), lambda n: (n == least) | (F.length(p) >= n))
        return once(F.concat(F.lit(" "), w, F.lit(" ")), lambda p: F.flatten(F.transform(sizes(p), lambda n: run(p, n))))

    return F.flatten(F.transform(F.filter(F.split(text, " "), lambda w: w != ""), of_word))


def token_span(offsets: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """First and end (exclusive) of the tokens whose offsets (start, end) overlap a span of characters; null if none does."""
    hit = F.filter(F.transform(offsets, lambda o, i: F.when((o["start"] < end) & (o["end"] > start), i)), lambda i: i.isNotNull())
    return F.array_min(hit), F.array_max(hit) + 1


def canonical_digest(*names: str) -> Column:
    """sha256 of the columns as a JSON object with sorted keys, no blanks, and nulls written."""
    return F.sha2(F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"}), 256)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def l1(a: str, b: str) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def l2(a: str, b: str) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def mean_product(a: str, b: str) -> Column:
    """Mean absolute product of components."""
    return total(F.zip_with(a, b, lambda x, y: F.abs(x * y))) / F.size(a)


def interaction(a: str, b: str) -> Column:
    """Both vectors, their absolute differences and their products, one after the other."""
    return F.concat(F.col(a), F.col(b), F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.zip_with(a, b, lambda x, y: x * y))


def tree_digest(leaves: Column) -> Column:
    """sha256 over lines of path, NUL and digest, in order of paths; leaves: an array of struct(path, digest) of bounded size."""
    return F.sha2(F.array_join(F.transform(F.sort_array(leaves), lambda x: F.concat(x["path"], F.lit("\0"), x["digest"])), "\n"), 256)
