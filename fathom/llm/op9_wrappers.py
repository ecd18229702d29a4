"""Main text of web pages by union-free regular-expression wrappers.

A page becomes a stream of text slots; a slot's token is the path of block
elements around it, with their classes and ids. Runs and tandem groups of tokens
fold into repeated groups. Streams of one host are aligned one after another:
equal tokens merge (a text that differs turns a constant into a text slot), and a
mismatch becomes an optional group on its side. The wrapper is the regular
expression that results: constants, text slots, ``?`` and ``+``, no unions. Each of
its items also knows how many pages have it, how much text, and how much within links.

Alignment takes equal ends, then tokens that either side has once, as far as their order agrees. A gap
between those of at most GAP tokens a side is compared token with token, a larger one in order, each
token with the next equal one within GAP; that bounds the time, not what is read.

Every page of a host takes part. Streams of equal tokens are summed first, within a
task and then per host; what is summed doesn't depend on the order. Different streams
are then aligned in the order of their tokens, in two steps of fixed groups, so that
the wrapper is the same for any partitioning of the pages.

A page's text is read through its alignment with the wrapper, slot by slot:

1. The region is the article or main element in which, by the wrapper's measure, most
   of the page's varying text is; without one that has a quarter of it, the page.
2. A slot in the region is the article, unless
   - the wrapper has it as a constant of several differing pages, and it's no heading;
   - its item is mostly links over the host's pages, and so is the slot;
   - an element around it is a menu, header (its headings stay), footer, sidebar, form
     or the like, or is named so. In the region, names count as classes and roles
     of containers, as whole names or compounds of such words ("share-price" is none);
     those of adverts and notices on any element.

Buttons and inputs stand within a line and don't end it; their text isn't read. Drawings and
formulas may close themselves and nest, and end where a block begins.

Defined cases: null or empty html, and pages without an article, give the empty
text; urls that are null or have no host are one host; a page alone on its host is
its own wrapper; broken markup is read as far as it goes, in time that grows with its
length (a tag that never ends closes the page; elements nested more than MAX_DEPTH deep
are read as siblings, and keep their text); very long pages are one row of a batch;
repeated rows get a row each; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.common import cut, map_arrow, table

#: Wrappers are broadcast up to this size, and joined by host beyond it.
BROADCAST_BYTES = 16 << 20
SALTS = 64
MIN_PAGES = 3
MAX_DEPTH = 512
#: The part of a page's varying text that an article or main element has at least, and the one within it that is entered.
REGION, INNER = 0.25, 0.5

RAW = "script|style|title|textarea|noscript|template|iframe|object|select|canvas|audio|video"
#: Drawings and formulas nest and may close themselves; a start tag of these ends them, as in browsers.
FOREIGN = frozenset(("svg", "math"))
BREAKOUT = frozenset("article aside blockquote body br center code dd div dl dt em figure footer form h1 h2 h3 h4 h5 h6 header hr img li main nav ol p pre section span strong table ul".split())
#: What a tag has up to its end; a quoted value counts only after an equals sign. Possessive, so nothing is read twice.
INSIDE = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+"""
TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b{INSIDE}>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<attrs>{INSIDE})>|<[!?/][^>]*(?:>|\Z)|(?P<text>[^<]+|<)""", re.S | re.I)
#: After the last > of a page, a tag that has no end.
OPEN_END = re.compile(r"<[a-zA-Z/!?]")
ATTR = re.compile(r"""([a-zA-Z_:][\w:.-]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture source track label output meter progress button input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: An element that ends what CLOSES would look for further out.
SCOPES = frozenset("ul ol dl table tbody thead tfoot body article main section div".split())
OUT = frozenset("nav footer aside form dialog menu fieldset head".split())
#: Words that name what isn't the article. Within the region only containers go by their names, any element by those of adverts and notices.
ADVERTS = frozenset("ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored cookie cookies gdpr newsletter paywall".split())
STRONG = frozenset("ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored cookie cookies consent gdpr sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments reply replies respond disqus related recommended recommendations newsletter subscribe subscription pagination pager teaser teasers topbar topnav subnav sidenav submenu paywall contentinfo".split())
WEAK = frozenset("promo promotion banner notice notices alert header masthead share sharing social popup modal overlay widget toolbar login signup signin search skip copyright disclaimer complementary discussion responses toc crumbs rail announcement".split())
#: Words with these beginnings count as well (commentlist, advertblock).
STEMS = ("comment", "advert", "cookie", "sponsor", "newsletter", "subscri", "sidebar", "breadcrumb")
#: What a compound may have beside such words (ad-box, share-buttons, cookie-bar).
NEUTRAL = frozenset("a area bar block body bottom box button buttons col column container content core entry feed form frame global group head holder icon icons inner item items layer left line link links list main mobile outer page panel placement post posts reader region right row section site slot strip text thread title top unit user view wrap wrapper zone".split())
CONTAINERS = frozenset("div section ul ol dl table tbody thead tfoot tr td article main aside center figure details body html".split())
MAIN = frozenset(("article", "main"))
HEADING = re.compile(r"h[1-6](?:[.#].*)?\Z")


def parse(page: str) -> list[tuple[str, str, int]]:
    """The slots in page order: path, text, characters within links."""
    slots: list[tuple[str, str, int]] = []
    paths: list[str] = []
    names: list[str] = []
    open_: dict[str, int] = {}
    held: list[str] = []
    links = linked = foreign = 0
    hidden: list | None = None  # a hidden inline element: its name, the same names open within, the depth it is at

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                slots.append((paths[-1] if paths else "", text, min(linked, len(text))))
            held.clear()
        linked = 0

    def shut(at: int) -> None:
        for name in names[at:]:
            open_[name] -= 1
        del names[at:], paths[at:]

    end = page.rfind(">") + 1
    tail = OPEN_END.search(page, end)
    for m in (*TOKEN.finditer(page, 0, end), None):
        text = page[end : tail.start() if tail else len(page)] if m is None else m["text"]
        if text is not None:
            if hidden is None and not foreign:
                held.append(text)
                if links:
                    linked += len(text)
            continue
        if m["tag"] is None:
            continue
        tag, attrs = m["tag"].lower(), m["attrs"]
        if tag in FOREIGN:
            foreign = max(foreign - 1, 0) if m["end"] else foreign + (not attrs.rstrip().endswith("/"))
            continue
        if foreign:
            if m["end"] or tag not in BREAKOUT:
                continue
            foreign = 0
        if tag == "a":
            links = 0 if m["end"] or "href" not in attrs.lower() else 1
        if tag in INLINE:
            if hidden and hidden[0] == tag:
                if not m["end"]:
                    hidden[1] += 1
                elif hidden[1]:
                    hidden[1] -= 1
                else:
                    hidden = None
            elif not hidden and not m["end"] and tag not in VOID and not attrs.rstrip().endswith("/") and (tag == "button" or _hides(attrs)):
                hidden = [tag, 0, len(names)]
            continue
        flush()
        if m["end"]:
            if open_.get(tag):
                at = len(names) - 1
                while names[at] != tag:
                    at -= 1
                shut(at)
                if hidden and len(names) < hidden[2]:
                    hidden = None
            continue
        if tag in VOID:
            continue
        if names and names[-1] == "p":
            shut(len(names) - 1)
            hidden = None
        if tag in CLOSES:
            at = len(names) - 1
            while at >= 0 and names[at] not in SCOPES and names[at] not in CLOSES[tag]:
                at -= 1
            while at >= 0 and names[at] in CLOSES[tag]:
                shut(at)
                at -= 1
        if len(names) < MAX_DEPTH:
            sign = _signature(tag, attrs)
            paths.append(f"{paths[-1]}>{sign}" if paths else sign)
            names.append(tag)
            open_[tag] = open_.get(tag, 0) + 1
    flush()
    return slots


def _hides(attrs: str) -> bool:
    return bool(attrs) and ("hidden" in attrs or "display:" in attrs) and any(_hidden(k.lower(), v) for k, v in ATTR.findall(attrs))


def _hidden(name: str, value: str) -> bool:
    value = value.strip("\"'").replace(" ", "").lower()
    return name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value)


def _signature(tag: str, attrs: str) -> str:
    if not attrs.strip():
        return tag
    sign = tag
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), entities.unescape(value.strip("\"'"))
        if name in ("class", "role", "itemprop"):
            sign += "".join(f".{w}" for w in sorted(value.lower().split()) if not any(c.isdigit() for c in w))
        elif name == "id" and not any(c.isdigit() for c in value):
            sign += f"#{value.lower()}"
        elif _hidden(name, value):
            sign += ".(hidden)"
    return sign.replace(">", "")


# ---- wrappers ----
# An item: [key, constant or None, repeated, optional, differing pages, pages, characters, linked characters]
# Differing pages are told by a hash of their slots, so copies count once; the MIN_PAGES least are kept, as more make no difference.
KEY, CONST, REP, OPT, PAGES, COUNT, CHARS, LINKED = range(8)


def fold(slots: list[tuple[str, str, int]]) -> tuple[list[list], list[int]]:
    """A page's slots as items, with runs and tandem groups folded; and each slot's item."""
    items: list[list] = []
    of: list[int] = []
    page = [xxhash.xxh64_intdigest("\0".join(x for slot in slots for x in slot[:2]).encode("utf-8", "surrogatepass"))]
    for path, text, linked in slots:
        if items and items[-1][KEY] == path:
            last = items[-1]
            last[CONST], last[REP] = None, True
            last[CHARS] += len(text)
            last[LINKED] += linked
        else:
            items.append([path, text, False, False, page, 1, len(text), linked])
        of.append(len(items) - 1)
    for width in (2, 3, 4):
        items, moved = _tandem(items, width)
        of = [moved[i] for i in of]
    return items, of


def _tandem(items: list[list], width: int) -> tuple[list[list], list[int]]:
    out: list[list] = []
    moved: list[int] = []
    i, n = 0, len(items)
    keys = [x[KEY] for x in items]
    while i < n:
        group = keys[i : i + width]
        j = i + width
        while j + width <= n and keys[j : j + width] == group:
            j += width
        if j > i + width and len(group) == width:
            base = len(out)
            for k in range(width):
                members = items[i + k : j : width]
                one = [group[k], None, True, False, members[0][PAGES], 1, sum(x[CHARS] for x in members), sum(x[LINKED] for x in members)]
                out.append(one)
            moved += [base + k % width for k in range(j - i)]
            i = j
        else:
            out.append(items[i])
            moved.append(len(out) - 1)
            i += 1
    return out, moved


#: Items of a gap that are compared each with each; larger gaps are matched in order.
GAP = 64


def align(a: list[list], b: list[list]) -> list[tuple[int | None, int | None]]:
    """Pairs of equal items in order; an item of one side alone is paired with None.

    Equal ends match; between them, tokens that either side has once are matched as far as their
    order agrees, and the gaps are aligned in turn.
    """
    ka, kb = [x[KEY] for x in a], [x[KEY] for x in b]
    pairs: list[tuple[int | None, int | None]] = []
    at = bt = 0
    for i, j in sorted(_matches(ka, kb)):
        pairs += [(x, None) for x in range(at, i)] + [(None, y) for y in range(bt, j)]
        pairs.append((i, j))
        at, bt = i + 1, j + 1
    return pairs + [(x, None) for x in range(at, len(ka))] + [(None, y) for y in range(bt, len(kb))]


def _matches(ka: list[str], kb: list[str]) -> list[tuple[int, int]]:
    found: list[tuple[int, int]] = []
    todo = [(0, len(ka), 0, len(kb))]
    while todo:
        i, i2, j, j2 = todo.pop()
        while i < i2 and j < j2 and ka[i] == kb[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < i2 and j < j2 and ka[i2 - 1] == kb[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
            found.append((i2, j2))
        if i == i2 or j == j2:
            continue
        once = _once(ka, i, i2)
        also = _once(kb, j, j2)
        chain = _increasing([(x, also[k]) for k, x in once.items() if k in also])
        if chain:
            ends = [(i - 1, j - 1), *chain, (i2, j2)]
            found += chain
            todo += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(ends, ends[1:])]
        elif i2 - i <= GAP and j2 - j <= GAP:
            for block in SequenceMatcher(None, ka[i:i2], kb[j:j2], autojunk=False).get_matching_blocks():
                found += [(i + block.a + k, j + block.b + k) for k in range(block.size)]
        else:
            places: dict[str, list[int]] = {}
            for y in range(j, j2):
                places.setdefault(kb[y], []).append(y)
            last = j - 1
            for x in range(i, i2):
                own = places.get(ka[x], ())
                k = bisect_right(own, last)
                if k < len(own) and own[k] - last <= GAP:
                    last = own[k]
                    found.append((x, last))
    return found


def _once(keys: list[str], i: int, i2: int) -> dict[str, int]:
    found: dict[str, int] = {}
    for x in range(i, i2):
        found[keys[x]] = -1 if keys[x] in found else x
    return {k: x for k, x in found.items() if x >= 0}


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest chain of pairs, given in the order of their first part, with rising second parts."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for n, (_, y) in enumerate(pairs):
        k = bisect_left(tops, y)
        if k == len(tops):
            tops.append(y), at.append(n)
        else:
            tops[k], at[k] = y, n
        before[n] = at[k - 1] if k else -1
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def merge(a: list[list], b: list[list]) -> list[list]:
    out = []
    for i, j in align(a, b):
        if i is None or j is None:
            one = list(a[i] if j is None else b[j])
            one[OPT] = True
        else:
            one = _both(a[i], b[j])
        out.append(one)
    return out


def _both(x: list, y: list) -> list:
    pages = x[PAGES] if x[PAGES] == y[PAGES] else sorted({*x[PAGES], *y[PAGES]})[:MIN_PAGES]
    return [x[KEY], x[CONST] if x[CONST] == y[CONST] else None, x[REP] or y[REP], x[OPT] or y[OPT], pages, *(x[k] + y[k] for k in (COUNT, CHARS, LINKED))]


def regex(wrapper: list[list]) -> str:
    """The wrapper as a readable union-free expression."""
    return " ".join(f"({x[KEY].rpartition('>')[2] or '-'}:{'#text' if x[CONST] is None else repr(x[CONST][:20])}){'+' if x[REP] else ''}{'?' if x[OPT] else ''}" for x in wrapper)


def _named(name: str, words: frozenset) -> bool:
    """Whether a class or id is one of the words, or a compound of such words and neutral ones."""
    pieces = [w for w in re.split(r"[^a-z()]+", name) if w]
    hit = [w in words or (words is STRONG and w.startswith(STEMS) and w != "commentary") for w in pieces]
    return any(hit) and all(h or w in NEUTRAL or w in STRONG or w in WEAK for h, w in zip(hit, pieces))


@lru_cache(1 << 14)
def _part(part: str) -> tuple[str, bool, bool, bool, bool, bool, bool]:
    """Of an element's signature: its tag; hidden; whether classes and roles name it strongly, or weakly; whether the id does; whether it is a main element; whether it's named an advert or notice."""
    tag = re.split(r"[.#]", part)[0]
    classes = [c for c in re.findall(r"\.([^.#]*)", part)]
    ids = re.findall(r"#([^#.]*)", part)
    if "-" in tag:
        classes.append(tag)  # a custom element
    strong, weak = any(_named(c, STRONG) for c in classes), any(_named(c, WEAK) for c in classes)
    main = tag in MAIN or any(c in ("main", "articlebody") for c in (*classes, *ids))
    return tag, "(hidden)" in classes or "hidden" in classes and tag not in MAIN, strong, weak, any(_named(c, STRONG) or _named(c, WEAK) for c in ids), main and tag not in ("html", "body"), any(_named(c, ADVERTS) for c in classes)


@lru_cache(1 << 14)
def regions(path: str) -> tuple[str, ...]:
    """The paths of the article and main elements that a slot is in, from the outermost; one that is named as something else is none."""
    parts = path.split(">")
    return tuple(">".join(parts[: i + 1]) for i, part in enumerate(parts) if (p := _part(part))[5] and not p[2])


@lru_cache(1 << 14)
def boilerplate(path: str, region: str) -> bool:
    """Whether an element around the slot is none of the article's, by itself or its names; the region and what is around it aren't asked for theirs, nor are ids within."""
    parts = path.split(">")
    inner = len(region.split(">")) if region else 0
    heading = bool(HEADING.match(parts[-1]))
    for i, part in enumerate(parts):
        tag, hidden, strong, weak, by_id, main, advert = _part(part)
        if hidden or tag in OUT:
            return True
        if i < inner or tag in ("html", "body"):
            continue
        if HEADING.match(part):
            if strong:
                return True
            continue
        if (tag == "header" or weak and _named_header(part)) and heading and (inner or main):
            continue
        if advert or tag == "header" or ((strong or weak) and (tag in CONTAINERS or "-" in tag or not inner)) or strong and tag in CLOSES or (by_id and not inner):
            return True
    return False


def _named_header(part: str) -> bool:
    return any("header" in re.split(r"[^a-z]+", c) for c in re.findall(r"[.]([^.#]*)", part))


def region_of(items: list[list]) -> str:
    """The path of the article or main element with most of the varying text, as the wrapper measures it; empty if none has a good part."""
    mass: dict[str, float] = {}
    total = 0.0
    for x in items:
        within = regions(x[KEY])
        if boilerplate(x[KEY], within[-1] if within else "") or template(x):
            continue
        m = (x[CHARS] - x[LINKED]) / x[COUNT]
        total += m
        for r in within:
            mass[r] = mass.get(r, 0.0) + m
    region, least = "", REGION * total
    while True:
        inner = [(m, r) for r, m in mass.items() if m > 0 and m >= least and r != region and (not region or r.startswith(region + ">"))]
        if not inner:
            return region
        m, region = max(inner, key=lambda t: (t[0], -len(t[1]), t[1]))
        least = INNER * m


def template(x: list) -> bool:
    """A constant of several differing pages."""
    return x[CONST] is not None and len(x[PAGES]) >= MIN_PAGES


def verdicts(items: list[list]) -> list[tuple[bool, bool]]:
    """Per item of a page, as the wrapper has it: whether it is the article's, and whether its slots are so only if they aren't mostly links."""
    region = region_of(items)
    varies = any(not template(x) for x in items)
    out = []
    for x in items:
        inside = not region or x[KEY].startswith(region + ">") or x[KEY] == region
        constant = varies and template(x) and not (region and HEADING.match(x[KEY].rpartition(">")[2]))
        out.append((inside and not constant and not boilerplate(x[KEY], region), 2 * x[LINKED] > x[CHARS]))
    return out


def host(url: str = "url") -> Column:
    """The host of a url, in lower case; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


PART = "host string, tokens string, wrapper string"


def infer(pages: DataFrame) -> DataFrame:
    """host and the wrapper of all its pages, as JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, list] = {}

        def out():
            rows = [(at, tokens, json.dumps(w)) for (at, tokens), w in seen.items()]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["host", "tokens", "wrapper"])

        size = 0
        for batch in batches:
            for at, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                items, _ = fold(parse(page or ""))
                key = (at, tokens_of(items))
                if key in seen:
                    seen[key] = [_both(x, y) for x, y in zip(seen[key], items)]
                else:
                    seen[key] = items
                    size += 1 + len(items)
                if size > 100_000:
                    yield out()
                    size = 0
        if seen:
            yield out()

    def same(group: pd.DataFrame) -> pd.DataFrame:
        whole: list[list] | None = None
        for w in group["wrapper"]:
            whole = json.loads(w) if whole is None else [_both(x, y) for x, y in zip(whole, json.loads(w))]
        return pd.DataFrame({"host": [group["host"].iloc[0]], "tokens": [group["tokens"].iloc[0]], "wrapper": [json.dumps(whole)]})

    def together(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("tokens")
        whole: list[list] | None = None
        for w in group["wrapper"]:
            whole = json.loads(w) if whole is None else merge(whole, json.loads(w))
        return pd.DataFrame({"host": [group["host"].iloc[0]], "tokens": [group["tokens"].iloc[0]], "wrapper": [json.dumps(whole)]})

    parts = map_arrow(pages.select(host().alias("host"), "html"), run, PART)
    summed = parts.groupBy("host", "tokens").applyInPandas(lambda g: same(g), PART)
    some = summed.withColumn("salt", F.pmod(F.xxhash64("tokens"), F.lit(SALTS))).groupBy("host", "salt").applyInPandas(lambda g: together(g), PART)
    return some.groupBy("host").applyInPandas(lambda g: together(g), PART).select("host", "wrapper")


def tokens_of(items: list[list]) -> str:
    """What tells streams apart: a hash of the tokens, with their number in front."""
    return f"{len(items):06d} " + xxhash.xxh3_128_hexdigest("\0".join(f"{x[KEY]}{'+' if x[REP] else ''}" for x in items).encode("utf-8", "surrogatepass"))


class Reader:
    """Reads pages of one host through its wrapper."""

    def __init__(self, wrapper: list[list]):
        self.wrapper, self.known = wrapper, {}

    def __call__(self, page: str | None) -> str:
        slots = parse(page or "")
        items, of = fold(slots)
        key = tuple(x[KEY] for x in items)
        if key not in self.known:
            if len(self.known) > 200:
                self.known.clear()
            at = {j: i for i, j in align(self.wrapper, items) if i is not None and j is not None}
            self.known[key] = [at.get(j) for j in range(len(items))]
        seen = [items[j] if i is None else self.wrapper[i] for j, i in enumerate(self.known[key])]
        judged = verdicts(seen)
        return "\n".join(text for (_, text, linked), item in zip(slots, of) if judged[item][0] and not (judged[item][1] and 2 * linked > len(text)))


def extract(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """page_id, url and the main text."""
    rows = pages.select("page_id", "url", "html", host().alias("_at"))
    size = wrappers.agg(F.sum(F.length("wrapper"))).first()[0] or 0
    if size <= BROADCAST_BYTES:  # of a checked size, and once per worker
        held = pages.sparkSession.sparkContext.broadcast({r["host"]: r["wrapper"] for r in wrappers.collect()})
        rows = rows.withColumn("wrapper", F.lit(None).cast("string"))
    else:
        held = None
        rows = rows.join(wrappers.withColumnRenamed("host", "_host"), F.col("_at") == F.col("_host"), "left").drop("_host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers: dict[str, Reader] = {}
        for batch in batches:
            texts = []
            for at, page, w in zip(*(batch.column(c).to_pylist() for c in ("_at", "html", "wrapper"))):
                if at not in readers:
                    if len(readers) > 200:
                        readers.clear()
                    readers[at] = Reader(json.loads((w if held is None else held.value.get(at)) or "[]"))
                texts.append(readers[at](page))
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_arrow(rows, run, "page_id long, url string, text string, n_chars long")


def op9_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, cut(infer(pages)))


ORACLE_SQL = None
