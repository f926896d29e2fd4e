"""Main text of web pages, by wrappers inferred from pages of the same host.

A page becomes a tree of containers with the texts of its blocks. A host's wrapper is a union-free regular expression
over such trees, and one page after another is aligned with it, container by container: a container that a page has
not becomes optional, one that it has more than once a repeated group, a text that all pages have at the same path of
containers is the host's template, and other texts are slots. Texts below containers that hold menus, adverts, forms,
notices, comments and the like are boilerplate. Extraction reads every page whole and matches it with its host's wrapper:
what is neither boilerplate nor template, of the article where a page has one. Where a page of the host has no text
besides what all share (as the only page of a host), nothing tells template from content, and nothing is template.

A wrapper is learned from all pages of a host, whole: each slice of pages gives a wrapper of its own, and these are
aligned with each other in SALTS parts, then once more, so no host is too large for a task; pages are never shuffled.
Equal wrappers count once and the alignment is the same in any order. Null and empty html give empty text.
Null urls and urls without a host are one host. Unclosed, stray and mis-nested tags are tolerated. Pages
repeated are extracted each by itself. Empty tables give no rows. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Collection, Iterable
from functools import reduce
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.batches import map_rows, map_slices
from shelfwise.llm.tables import cut_lineage, salted_lookup

#: Parts that the wrappers of a host are first merged in.
SALTS = 64
#: Bytes of all wrappers together that may be broadcast; beyond, pages are joined with them.
BROADCAST_BYTES = 32 << 20

#: Names of elements.
SKIPPED = "script|style|noscript|template|svg|iframe|textarea|select|button|title|canvas|object|math"
CONTAINERS = frozenset("html body main article section div nav header footer aside form ul ol dl table tr td th blockquote figure dialog fieldset details head".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre br hr figcaption thead tbody tfoot caption summary address legend option address center".split())
VOID = frozenset("br hr img input meta link wbr source track area base col embed param".split())
ARTICLES = frozenset(("article", "main"))
#: Elements that hold parts of a content, never all of it.
PARTS = frozenset("ul ol dl table tr td th blockquote figure details fieldset".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form dialog menu head".split())
#: A whole class or id: words that name boilerplate, and words of place or shape beside at least one of them.
BOILERPLATE_NAMES = re.compile(
    r"(?:(?:site|page|top|bottom|left|right|main|primary|secondary|global|mobile)[_-]+)*"
    r"(?:(?:ad|ads|advert|adverts|advertisement|advertising|adsense|banner|sponsor|sponsors|sponsored|promo|promos|promoted|promotions?|nav|navbar|navigation|navi|menu|menus|menubar|breadcrumbs?|sidebar|side|footer|foot|masthead|header|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|share|sharing|social|comments?|replies|respond|disqus|related|recommended|recommendations?|widget|toolbar|pagination|pager|login|search|skip|legal|copyright)"
    r"(?:[_-]+(?:bar|box|wrapper|wrap|container|area|block|slot|unit|link|links|list|buttons|form|inner|[0-9]+))*(?:[_-]+|\Z))+",
    re.I,
)
#: The only names that make an article boilerplate; html, body and main never are by name.
ARTICLE_NAMES = frozenset("comment comments comment-body reply ad ads advert advertisement".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())

TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<({SKIPPED})\b[^>]*?(?:/>|>.*?(?:</\1\s*>|\Z))|<[/!?]?[A-Za-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|<[!?/][^>]*>|[^<]+|<", re.S | re.I)
NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def attributes(tag: str) -> dict[str, str]:
    """Attributes by name, each read whole, so that no value is taken for a name; of equal names the first counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(tag, NAME.match(tag).end()):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def boilerplate(name: str, tag: str) -> bool:
    """Whether a container says of itself that it holds no content."""
    if name in BOILERPLATE_TAGS:
        return True
    a = attributes(tag) if len(tag) > len(name) + 2 else {}
    if name == "header" or name in ("html", "body") or not a:
        return name == "header"
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or a.get("role", "").lower() in BOILERPLATE_ROLES:
        return True
    names = [*a.get("class", "").split(), *a.get("id", "").split()]
    if name in ARTICLES:
        return name == "article" and any(n.lower() in ARTICLE_NAMES for n in names)
    return any(BOILERPLATE_NAMES.fullmatch(n) for n in names)


def label(name: str, tag: str) -> str:
    a = attributes(tag)
    return f"{name}.{' '.join(sorted(a.get('class', '').split()))}" if a.get("class") else name


def read(page: str):
    """Events of a page: ('block',), ('open', name, tag), ('close', name) of containers, and ('text', raw text)."""
    for m in TOKEN.finditer(page):
        token = m[0]
        if token[0] != "<" or token == "<":
            yield ("text", token)
        elif m[1]:
            if m[1].lower() not in ("svg", "math", "button", "canvas", "object"):
                yield ("block",)
        elif token[1] not in "!?":
            n = NAME.match(token)
            if not n:
                continue
            name = n[1].lower()
            if name in CONTAINERS:
                yield ("close", name) if token[1] == "/" else ("open", name, token)
            elif name in BLOCKS:
                yield ("block",)


def digest(*parts: str) -> str:
    return hashlib.blake2b("\0".join(parts).encode("utf-8", "replace"), digest_size=8).hexdigest()


class Place:
    """The open containers while a page is read."""

    def __init__(self) -> None:
        self.own: list[bool] = []  # boilerplate by themselves
        self.names: list[str] = []
        self.labels: list[str] = []
        self.below: list[bool] = []  # below boilerplate, or boilerplate
        self.paths: list[str] = [""]  # digests of the names down to each, classes aside
        self.seen: dict[str, list] = {}  # of each path its parent, name and how often it was opened, in page order

    def open(self, name: str, tag: str) -> None:
        plain = not boilerplate(name, tag)
        if name in ("article", "main") and plain:
            outer = any(b and n in ("aside", "form", "dialog", "footer", "nav") for n, b in zip(self.names, self.own))
            inherited = outer
        else:
            inherited = bool(self.below and self.below[-1])
            if name == "header" and not attributes(tag).get("class") and "article" in self.names:
                plain = True  # an article's own head
        self.own.append(not plain)
        self.names.append(name)
        self.labels.append(label(name, tag))
        self.below.append(inherited or not plain)
        known = name + "!" * self.below[-1]
        self.paths.append(digest(self.paths[-1], known))
        self.seen.setdefault(self.paths[-1], [self.paths[-2], known, 0])[2] += 1

    def close(self, name: str) -> None:
        if name in self.names:
            at = len(self.names) - 1 - self.names[::-1].index(name)
            del self.names[at:], self.labels[at:], self.below[at:], self.own[at:], self.paths[at + 1 :]


def blocks(events: Iterable[tuple], place: Place):
    """The texts of a page's blocks that have any; while one is given, the place is its own."""
    current: list[str] = []
    for event in chain(events, [("block",)]):
        if event[0] == "text":
            current.append(event[1])
            continue
        if current:
            if text := " ".join(html.unescape("".join(current)).split()):
                yield text
            current.clear()
        if event[0] == "open":
            place.open(event[1], event[2])
        elif event[0] == "close":
            place.close(event[1])


def text_key(path: str, text: str, seen: dict[str, int]) -> str:
    """A text at a path, numbered among its equals there."""
    key = digest(path, text)
    seen[key] = n = seen.get(key, 0) + 1
    return key if n == 1 else f"{key}.{n}"


# ---- inference ----

#: tags: of each path [parent, name, least place in a page, least and most often on a page, most texts]; texts: those
#: that every page has, with their paths; least: texts outside boilerplate of the page that has fewest.
Wrapper = dict


def stream(page: str) -> Wrapper:
    """The wrapper of one page: its tags, and all its texts outside boilerplate."""
    place, texts, counts, seen = Place(), {}, {}, {}
    for text in blocks(read(page), place):
        if not (place.below and place.below[-1]):
            path = place.paths[-1]
            counts[path] = counts.get(path, 0) + 1
            texts[text_key(path, text, seen)] = path
    tags = {path: [parent, name, at, n, n, counts.get(path, 0)] for at, (path, (parent, name, n)) in enumerate(place.seen.items())}
    if "" in counts:
        tags[""] = [None, "", -1, 1, 1, counts[""]]
    return {"tags": tags, "texts": texts, "least": len(texts)}


def align(a: Wrapper, b: Wrapper) -> Wrapper:
    """The wrapper that reads what either reads. Equal texts at equal paths stay, others become slots; a container that
    one has not is optional, one that it has more than once is repeated. Order, grouping and repeats don't matter."""
    tags = {}
    for path in {**a["tags"], **b["tags"]}:
        x, y = a["tags"].get(path), b["tags"].get(path)
        if x and y:
            tags[path] = [*x[:2], min(x[2], y[2]), min(x[3], y[3]), max(x[4], y[4]), max(x[5], y[5])]
        else:
            z = x or y
            tags[path] = [*z[:3], 0, *z[4:]]
    return {"tags": tags, "texts": {k: p for k, p in a["texts"].items() if k in b["texts"]}, "least": min(a["least"], b["least"])}


def infer(pages: list[Wrapper]) -> Wrapper:
    """One wrapper of many; pages without text outside boilerplate say nothing."""
    told = [p for p in pages if p["least"]]
    return reduce(align, told) if told else stream("")


def template(wrapper: Wrapper) -> list[str]:
    """Texts of the host and not of its pages. None where a page has no other text: nothing tells the two apart there."""
    return sorted(wrapper["texts"]) if wrapper["least"] > len(wrapper["texts"]) else []


def slots(wrapper: Wrapper) -> list[str]:
    """Paths with texts that aren't the template's."""
    fixed = Counter(wrapper["texts"][k] for k in template(wrapper))
    return [path for path, tag in wrapper["tags"].items() if tag[5] > fixed[path]]


def ordered(tags: dict[str, list]) -> list[str]:
    return sorted(tags, key=lambda p: (tags[p][2], p))


def expression(wrapper: Wrapper) -> str:
    """The wrapper as a regular expression over tokens: template texts are '=', slots are '#'."""
    tags, free, fixed = wrapper["tags"], set(slots(wrapper)), Counter(wrapper["texts"][k] for k in template(wrapper))
    below: dict[str, list[str]] = {}
    for path in ordered(tags):
        if path:
            below.setdefault(tags[path][0], []).append(path)
    out: list[str] = []
    todo: list = [("", True)]
    while todo:
        path, entering = todo.pop()
        _, name, _, least, most, _ = tags.get(path, [None, "", -1, 1, 1, 0])
        mark = ("+" if least else "*") if most > 1 else "" if least else "?"
        if entering:
            if path:
                out.append("(" * bool(mark) + "<" + name)
            out += ["="] * fixed[path] + ["#"] * (path in free)
            todo += [(path, False), *((p, True) for p in reversed(below.get(path, [])))]
        elif path:
            out.append("/" + name.rstrip("!") + (")" + mark if mark else ""))
    return " ".join(out)


def main_container(wrapper: Wrapper) -> str:
    """The name of the container whose content is the main text; empty: the page itself. The article that the wrapper
    holds, else the lowest container above all slots that is no list, table or quote."""
    tags = wrapper["tags"]
    for path in ordered(tags):
        if tags[path][1] in ("article", "main"):
            return tags[path][1]
    common: list[str] | None = None
    for path in slots(wrapper):
        if tags[path][5]:
            above = [path]
            while above[-1]:
                above.append(tags[above[-1]][0])
            above.reverse()
            common = above if common is None else [a for a, b in zip(common, above) if a == b]
    while common and common[-1] and tags[common[-1]][1] in PARTS:
        common.pop()
    return tags[common[-1]][1] if common and common[-1] else ""

# ---- extraction ----


def extract(page: str | None, main: str | None = None, fixed: Collection[str] = ()) -> str:
    """Main text: blocks in page order, joined by one space. main: the wrapper's main container; fixed: its template's texts."""
    if not page:
        return ""
    place, fixed, seen, every, marked = Place(), set(fixed), {}, [], []
    for text in blocks(read(page), place):
        if place.below and place.below[-1] or fixed and text_key(place.paths[-1], text, seen) in fixed:
            continue
        every.append(text)
        if any(n in ARTICLES and not own for n, own in zip(place.names, place.own)):
            marked.append(text)
    # A main container that is no article holds all slots of the host: what is left of its pages is content.
    return " ".join(marked if marked and (main is None or main in ARTICLES) else every)


def host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def packed(wrapper: Wrapper) -> str:
    return json.dumps(wrapper, sort_keys=True)


def learn(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, wrapper, main and fixed, the template's texts: one row for each host that has text."""

    def make():
        def rows_of(hosts, htmls):
            found: dict[str, Wrapper] = {}
            for h, page in zip(hosts, htmls):
                w = stream(page or "")
                if w["least"]:
                    found[h] = align(found[h], w) if h in found else w
            return [(h, packed(w)) for h, w in found.items()]

        return rows_of

    def make_merged():
        return lambda h, found: (h, packed(infer([json.loads(w) for w in found])))

    def make_wrapper():
        def row(h, found):
            w = infer([json.loads(x) for x in found])
            return h, expression(w), main_container(w), template(w)

        return row

    some = pages.select(host(F.col(url_col)).alias("host"), F.col(html_col).alias("page"))
    parts = map_slices(some, "host string, wrapper string", make).withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    merged = map_rows(parts.groupBy("host", "part").agg(F.collect_set("wrapper").alias("found")).drop("part"), "host string, wrapper string", make_merged)
    chosen = merged.groupBy("host").agg(F.collect_set("wrapper").alias("found"))
    return map_rows(chosen, "host string, wrapper string, main string, fixed array<string>", make_wrapper)


def texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Id, url, text and n_chars of every page."""
    wrappers = cut_lineage(learn(pages, url_col, html_col))
    small = (wrappers.agg(F.sum(F.length("host") + F.length("main") + 32 + 24 * F.size("fixed"))).first()[0] or 0) <= BROADCAST_BYTES
    table = wrappers.select(F.col("host").alias("host_"), "main", "fixed")
    some = pages.select(F.col(id_col), F.col(url_col), host(F.col(url_col)).alias("host_"), F.col(html_col).alias("page_"))
    if small:
        joined = some.join(F.broadcast(table), "host_", "left")
    else:
        joined = salted_lookup(some, table, "host_", F.col("page_"))

    def make():
        def row(key, url, page, main, fixed):
            text = extract(page, main, fixed or ())
            return key, url, text, len(text)

        return row

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", text string, n_chars bigint"
    return map_rows(joined.select(id_col, url_col, "page_", "main", "fixed"), schema, make)
