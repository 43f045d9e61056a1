"""Main text of web pages by wrappers that are inferred for each host.

A page becomes a tree of block elements with text slots (inline markup is taken off, open elements are closed as browsers do). The wrapper of a
host is a union-free regular expression over such trees: the streams of children of two elements are aligned; what both have is matched
and merged, what one lacks becomes an optional group, neighbours of one kind a repeated group, and a text that differs
becomes a slot. Aligning page after page changes the wrapper only at mismatches. Wrappers merge like pages. The different pages of a host are dealt into as many parts as
their number asks for, by a hash of the page, and merged in the order of that hash, part after part, so the wrapper depends on the set of pages alone,
and no task gets all pages of a large host.

The article is the page's article or main element. Menus, sidebars, footers, forms, scripts, notices, adverts and reader comments in it go, known by the element
or by a name that says just that, and so do short texts of boxes with a class that the wrapper finds to be the same in nearly all articles of the host while the articles differ. In pages without an article slots that hold the same text on nearly all
different pages of a host are its template and go, and so do slots that are mostly links; elements with a telling name go too. What is left are the blocks.

Defined results: null, empty or markup-only html gives an empty text; a page cut off in the middle gives what is there; pages without a host in their
url share the wrapper of the empty host;
repeated pages and null ids are pages like others, but copies of a page count once for its host's wrapper; pages of any length and depth are read whole (elements below the ``DEEPEST``-th level are never
template); columns other than the three named are not read, so their names don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volumetra.llm.common import lean, table

#: Names of HTML elements and words in class names.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg object xmp".split())
DROP = set("script style head title meta link noscript template iframe svg object nav header footer aside form button select textarea input dialog menu".split())
#: An article's own header holds its title.
DROP_INSIDE = DROP - {"header"}
ARTICLE = ("article", "main")
WORDS = set("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption caption".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_NAMED = r"(?:^|[\s_-])(?:%s)(?:$|[\s_-])"
_COMMENTS = "comments?|commentlist|respond|disqus|replies"
_STRICT = f"ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo|banner|sidebar|menu|nav(?:bar|igation)?|breadcrumbs?|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|{_COMMENTS}"
#: Names of elements that go outside articles, inside them, and of articles and text elements (there the name must say it alone).
SKIPPED = re.compile(_NAMED % f"{_STRICT}|side|header|footer|masthead|alert|overlay|discussion|share|sharing|social|related|recommended|signup|login|search|pagination|pager|widget|toolbar|skip|hidden", re.I)
#: Inside articles a name must consist of such words and words for a place or a box: ``banner-history`` and ``cookie-recipe`` are content.
_BOX = "box|container|content|wrap|wrapper|section|area|slot|block|list|unit|bar|inner|outer|top|bottom|left|right|inline|form|signup|text|message|overlay|link|main|site|page|reader|user"
SKIPPED_INSIDE = re.compile(rf"(?:^|\s)(?:(?:{_BOX})[_-])*(?:{_STRICT})(?:[_-](?:{_STRICT}|{_BOX}))*(?=$|\s)", re.I)
SKIPPED_ALONE = re.compile(rf"\s*(?:ads?|adverts?|advertisement|sponsored|cookies?|{_COMMENTS})\s*", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*)(>|\Z)", re.S)
_NAMES = re.compile(r"\b(class|id|role|style|hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
#: Characters of a text within articles that may be template.
SHORT = 200
#: Levels of elements that take part in wrappers.
DEEPEST = 200
#: Different pages that are merged in one row after another.
PER_PART = 2000


class Node:
    """An element of a page: ``items`` are nodes and texts (text, characters inside links)."""

    __slots__ = ("name", "label", "skip", "items")

    def __init__(self, name: str, label: str, skip: bool):
        self.name, self.label, self.skip, self.items = name, label, skip, []


def _label(name: str, attributes: str, inside: bool) -> tuple[str, bool]:
    """Label of an element, and whether it goes. ``inside``: within an article."""
    if "=" not in attributes and "hidden" not in attributes.lower():
        return name, name in (DROP_INSIDE if inside else DROP)
    found = {k.lower(): (v or "").strip("\"'") for k, v in _NAMES.findall(attributes)}
    names = [x for x in (found.get("class", ""), found.get("id", ""), found.get("role", "")) if x]
    skip = "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower()
    if name in ("html", "body", "main"):
        pass
    elif name == "article" or inside and name in WORDS:
        skip = skip or any(SKIPPED_ALONE.fullmatch(x) for x in names)
    else:
        skip = skip or name in (DROP_INSIDE if inside else DROP) or any((SKIPPED_INSIDE if inside else SKIPPED).search(x) for x in names)
    return name + "".join("." + re.sub(r"\d+", "", x) for x in found.get("class", "").split()[:3]), skip


def parse(source: str | None) -> Node:
    """The tree of block elements. Unknown or stray end tags are passed over; a tag cut off at the end of the page is dropped."""
    root = Node("", "", False)
    stack, at, links, inside = [root], 0, 0, 0
    count: dict[str, int] = defaultdict(int)  # open elements by name
    source = source or ""

    def text(s: str) -> None:
        if s:
            items = stack[-1].items
            s = entities.unescape(s)
            n = len(s.strip()) if links else 0
            if items and type(items[-1]) is list:
                items[-1][0].append(s)
                items[-1][1] += n
            else:
                items.append([[s], n])

    def close() -> str:
        nonlocal inside
        name = stack.pop().name
        count[name] -= 1
        inside -= name in ARTICLE
        return name

    for m in _TOKEN.finditer(source):
        if m.start() < at:
            continue
        text(source[at : m.start()])
        at = m.end()
        if m[2] is None or m[4] != ">":
            continue
        name, end = m[2].lower(), bool(m[1])
        if name in INLINE:
            if name == "a":
                links = max(0, links + (-1 if end else 1))
            elif name == "br":
                text(" ")
            continue
        links = 0
        if end:
            if count[name]:
                while close() != name:
                    pass
            continue
        if name in CLOSES:
            while stack[-1].name in CLOSES[name]:
                close()
        if stack[-1].name == "p":
            close()
        label, skip = _label(name, m[3], inside > 0)
        node = Node(name, label, skip)
        stack[-1].items.append(node)
        if name in RAW:
            closing = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
            at = closing.end() if closing else len(source)
        elif name not in VOID and not m[3].endswith("/"):
            stack.append(node)
            count[name] += 1
            inside += name in ARTICLE
    rest = source[at:]
    cut = re.search(r"<[a-zA-Z/!][^<>]*\Z", rest)
    text(rest[: cut.start()] if cut else rest)
    return root


# A wrapper is [label, many, optional, pages, items]; an item is a wrapper or a slot [None, same text or None, characters, link characters, pages].


def _same(text: str) -> str:
    """What stands for a slot's text: itself, or for a longer one a 128-bit hash (behind a line break, which no slot's text has)."""
    return text if len(text) <= 32 else "\n" + hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()


def as_wrapper(node: Node, depth: int = 0) -> list:
    items: list = []
    for x in node.items:
        if type(x) is list:
            s = " ".join("".join(x[0]).split())
            if s:
                items.append([None, _same(s), len(s), x[1], 1])
        elif depth < DEEPEST:
            items.append(as_wrapper(x, depth + 1) if not x.skip else [x.label, 0, 0, 1, []])
    return [node.label, 0, 0, 1, _folded(items)]


def _folded(items: list) -> list:
    """Neighbours of one kind become one repeated group."""
    out: list = []
    for x in items:
        if out and out[-1][0] == x[0]:
            out[-1] = merged(out[-1], x, fold=True)
        else:
            out.append(x)
    return out


def merged(a: list, b: list, fold: bool = False) -> list:
    """Align two wrappers of one label. ``fold``: they are neighbours on one page, not the same place on two."""
    if a[0] is None:
        return [None, a[1] if a[1] == b[1] else None, a[2] + b[2], a[3] + b[3], a[4] if fold else a[4] + b[4]]
    x, y = a[4], b[4]
    kinds_a, kinds_b = [i[0] for i in x], [i[0] for i in y]
    items: list = []
    if kinds_a == kinds_b:
        items = [merged(p, q, fold) for p, q in zip(x, y)]
    else:
        for op, i, j, k, m in SequenceMatcher(None, kinds_a, kinds_b, autojunk=False).get_opcodes():
            if op == "equal":
                items += [merged(p, q, fold) for p, q in zip(x[i:j], y[k:m])]
            else:
                items += [_optional(p) for p in x[i:j] + y[k:m]]
        items = _folded(items)
    return [a[0], int(fold or a[1] or b[1]), int(a[2] or b[2]), a[3] if fold else a[3] + b[3], items]


def _optional(item: list) -> list:
    return item if item[0] is None else [item[0], item[1], 1, item[3], item[4]]


def expression(w: list) -> str:
    """The wrapper as a regular expression."""
    if w[0] is None:
        return json.dumps(w[1], ensure_ascii=False) if w[1] is not None else "#text"
    body = f"<{w[0] or 'page'}>" + " ".join(expression(x) for x in w[4]) + ("</>" if w[4] else "")
    return f"({body}){'*' if w[1] and w[2] else '+' if w[1] else '?'}" if w[1] or w[2] else body


def _varied(w: list) -> int:
    """Characters of the slots whose text differs from page to page."""
    return sum(_varied(x) if x[0] is not None else x[2] if x[1] is None else 0 for x in w[4])


def fixed_slots(w: list, path: str = "", least: int = 3, pages: int | None = None, inside: bool = False) -> list[str]:
    """Paths of the slots that aren't content: one text on nine in ten of the wrapper's pages and ``least`` at least; outside articles also mostly links.

    Within articles only short texts of boxes with a class go that way, never headings, paragraphs or items, and only where most of the host's articles is not the same.
    """
    out = []
    here = f"{path}/{w[0]}"
    pages = w[3] if pages is None else pages
    if not inside and w[0].split(".")[0] in ARTICLE:
        inside = True
        if w[3] < least or 10 * w[3] < 9 * pages or _varied(w) < SHORT * w[3]:
            return []
    for x in w[4]:
        if x[0] is not None:
            out += fixed_slots(x, here, least, pages, inside)
        elif x[1] is not None and x[4] >= least and 10 * x[4] >= 9 * pages and (not inside or x[2] <= SHORT * x[4] and "." in w[0] and w[0].split(".")[0] not in WORDS | set(ARTICLE)):
            out.append(here)
        elif not inside and 2 * x[3] > x[2]:
            out.append(here)
    slots: dict[str, bool] = {}
    for x in w[4]:
        if x[0] is None:
            slots[here] = slots.get(here, True) and here in out
    return [p for p in dict.fromkeys(out) if slots.get(p, True)]


def main_text(source: str | None, fixed: set = frozenset()) -> str:
    """The blocks of a page's outermost articles, or of the whole page where it has none, but for the slots at the ``fixed`` paths."""
    articles: list[str] = []
    others: list[str] = []
    root = parse(source)
    # (items, path down to DEEPEST levels, whether inside an article)
    stack, any_article = [(iter(root.items), f"/{root.label}", False)], False
    while stack:
        items, path, inside = stack[-1]
        x = next(items, None)
        if x is None:
            stack.pop()
        elif type(x) is list:
            s = " ".join("".join(x[0]).split())
            if s and inside and path not in fixed:
                articles.append(s)
            elif s and path not in fixed:
                others.append(s)
        elif not x.skip:
            article = x.name in ARTICLE
            any_article = any_article or article
            stack.append((iter(x.items), f"{path}/{x.label}" if path is not None and len(stack) <= DEEPEST else None, inside or article))
    return "\n\n".join(articles if any_article else others)


def _host(url: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def _merged_in_order(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(host, part, at, wrapper) -> one wrapper for each host and part, merged in the order of ``at``; of equal ``at`` only the first counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, last, w = None, None, None
        for p in batches:
            done = []
            for host, part, at, x in zip(p["host"], p["part"], p["at"], p["wrapper"]):
                if (host, part) != group:
                    if w is not None:
                        done.append((*group, json.dumps(w)))
                    group, last, w = (host, part), None, None
                if at != last:
                    w = json.loads(x) if w is None else merged(w, json.loads(x))
                    last = at
            if done:
                yield pd.DataFrame(done, columns=["host", "part", "wrapper"])
        if w is not None:
            yield pd.DataFrame([(*group, json.dumps(w))], columns=["host", "part", "wrapper"])

    dealt = rows.repartition(*keys).sortWithinPartitions("host", "part", "at")
    return dealt.select("host", "part", "at", "wrapper").mapInPandas(lean(run), "host string, part long, wrapper string")


def wrappers(pages: DataFrame, url_col="url", html_col="html", per_part: int = PER_PART) -> DataFrame:
    """(host, wrapper as json, fixed slots). Equal pages of a host are taken once; about ``per_part`` different pages of all hosts make a part."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            p = p.drop_duplicates(["host", "at"])
            yield pd.DataFrame({"host": p["host"], "at": p["at"], "wrapper": [json.dumps(as_wrapper(parse(x))) for x in p["html"]]})

    def fixed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame({"host": p["host"], "wrapper": p["wrapper"], "fixed": [fixed_slots(json.loads(x)) for x in p["wrapper"]]})

    slim = pages.select(_host(url_col).alias("host"), F.xxhash64(html_col).alias("at"), F.col(html_col).alias("html"))
    bits = max(0, math.ceil(math.log2(max(1, slim.count()) / per_part)))
    rows = slim.mapInPandas(lean(each), "host string, at long, wrapper string")
    rows = rows.withColumn("part", F.shiftrightunsigned("at", 64 - bits) if bits else F.lit(0).cast("long"))
    merged_ = _merged_in_order(rows, ["host", "part"])
    while bits:  # 256 parts to one
        bits = max(0, bits - 8)
        rows = merged_.withColumnRenamed("part", "at").withColumn("part", F.shiftrightunsigned("at", 8) if bits else F.lit(0).cast("long"))
        merged_ = _merged_in_order(rows, ["host", "part"])
    return merged_.select("host", "wrapper").mapInPandas(lean(fixed), "host string, wrapper string, fixed array<string>")


def extract(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    known = table(wrappers(pages, url_col, html_col), "wrappers").select("host", "fixed")
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), _host(url_col).alias("host"))
    joined = slim.join(known, "host", "left").select("page_id", "url", "html", "fixed")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            text = [main_text(h, set(f) if f is not None else set()) for h, f in zip(p["html"], p["fixed"])]
            yield pd.DataFrame({"page_id": p["page_id"], "url": p["url"], "text": text})

    kinds = {f.name: f.dataType.simpleString() for f in slim.schema}
    out = joined.mapInPandas(lean(run), f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
