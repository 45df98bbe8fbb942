"""Main text of web pages by equivalence-class template deduction.

1. Every page is read into tokens: elements, told by the chain of names, classes, ids and roles that leads to
   them, and runs of text under their element. A token's occurrence vector says how often each page of the host has it.
2. Tokens of a host with equal vectors form an equivalence class. Vectors are compared by their support, their
   sum and two mixes of hashed (page, count) pairs, so that classes come from plain aggregates, summed before
   any shuffle, and no host's pages are ever gathered.
3. A class is valid if SUPPORT of the host's pages hold it. Valid classes nest by their elements: a class whose
   tokens come once a page is frame, a class that repeats stands inside a frame element's slot, and texts that FIXED of
   the pages share are strings of the template.
4. What the template doesn't hold is data and lies in the slots of frame elements. From the root the way goes to the
   frame element that holds HOLDS of the host's varying text outside links, as deep as there is one, and then
   back up over parents that add nothing but headings: that is the content. Only names break ties: an article or main element
   around that slot, or beside its rivals, is taken instead.
5. Inside the content two kinds of template go: frame elements whose text never varies (share lines,
   labels), and lists of records, classes of three elements or more that repeat together, behind the
   main slot (readers' comments, related stories). All other slots' text is the result. Elements that
   HTML itself or their names mark as menus, footers, forms, adverts and the like never count and never come out.

A page that doesn't hold its host's content element, or whose host has fewer than MIN_PAGES pages, is judged by
its own elements' names alone. The table of templates is broadcast only if it is small; else it is
joined by host with Spark's handling of skewed keys.

Defined cases: null and empty html give empty text and 0 characters; a null url is a host of its own; repeated rows
are extracted row by row, and a host of nothing but copies keeps all its content; of elements with equal shares the one that comes
first is taken; very long and very deep pages are read whole, in time linear in their length; an empty table gives an empty
result; extra columns, also such as are named host, token or text, are ignored.
"""

from __future__ import annotations

import html as _html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import broadcast_if_small, materialize

#: Share of a host's pages that must hold a valid class, and pages below which a host has no template.
SUPPORT = 0.5
MIN_PAGES = 3
#: Share of a host's varying text that its content element must hold.
HOLDS = 0.6
#: Share of a host's pages that must have a text in one place for it to be the template's.
FIXED = 0.8

# HTML elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
DROPPED = frozenset(
    "nav footer aside form script style textarea title noscript iframe template noembed noframes head button input svg menu dialog".split()
)
MAIN = frozenset(("article", "main"))
# Words of class, id and role attributes.
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe "
    "subscription signup sidebar widget related recommended recommendations share sharing social breadcrumb breadcrumbs menu nav navbar navigation footer masthead topbar comment comments "
    "commentlist disqus reply replies respond pagination pager toolbar login search form skip toc contentinfo complementary dialog".split()
)
HEADER_WORDS = frozenset("header banner masthead".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header".split())
#: Elements that group others, apart from the text's own blocks.
GROUPS = frozenset("center details div header ol section small span ul".split())
#: A content element is at least this deep: not the document, its root or its body.
OUTER = frozenset(("#", "html", "body"))
#: A start tag closes open elements of these names, up to the nearest container.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"), "body": ("head",),
}
CONTAINERS = frozenset("html body article main section div nav aside header footer form table ul ol dl td th figure blockquote details fieldset".split())
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "title", "legend"}

_TAG = re.compile(
    r"""<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*'|["'])*+)>|<[A-Za-z/!?][^>]*\Z""", re.S
)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Element:
    """key: name, id, class and role, digits as 0. token: a hash of the keys from the root to here."""

    __slots__ = ("name", "key", "token", "up", "drop", "main", "inside")

    def __init__(self, name: str, attrs: str, up: Element | None):
        self.name, self.up = name, up
        mark, words, hidden = "", set(), False
        if attrs and "=" in attrs or "hidden" in attrs:
            got = {k.lower(): (v or "").strip("\"'") for k, v in _ATTR.findall(attrs)}
            for a in ("id", "class", "role"):
                if got.get(a):
                    words.update(w.lower() for w in _NAMES.findall(got[a]))
                    mark += "." + re.sub(r"\d+", "0", got[a])
            hidden = "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in got.get("style", "").replace(" ", "")
        self.key = name + mark
        self.token = _hash(f"{up.token if up else 0}>{self.key}")
        inside = up.inside if up else False
        self.main = name in MAIN or "main" in words or "article" in words
        self.inside = inside or self.main
        worded = words & DROPPED_WORDS and not (name in MAIN and not words & {"comment", "comments", "reply", "related", "sponsored", "ad"}) and name not in ("html", "body")
        self.drop = (up.drop if up else False) or hidden or name in DROPPED or bool(worded) or (name == "header" or bool(words & HEADER_WORDS) and name not in ("html", "body")) and not inside


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def events(page: str) -> Iterator[tuple[str, Element, str]]:
    """("open" | "close" | "text" | "break", the element that it concerns or stands in, raw text)."""
    root = Element("#", "", None)
    stack = [root]
    at = 0

    def close_to(n: int) -> Iterator[tuple[str, Element, str]]:
        while len(stack) > n:
            yield "close", stack.pop(), ""

    while True:
        m = _TAG.search(page, at)
        if m is None:
            if at < len(page):
                yield "text", stack[-1], page[at:]
            break
        if m.start() > at:
            yield "text", stack[-1], page[at : m.start()]
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    yield from close_to(i)
                    break
            continue
        if name == "br":
            yield "break", stack[-1], ""
            continue
        shut = CLOSES.get(name, ()) + (("p",) if name in CLOSES_P else ())
        if shut:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in shut:
                    yield from close_to(i)
                    break
                if stack[i].name in CONTAINERS and stack[i].name not in shut:
                    break
        attrs = m[3]
        element = Element(name, attrs, stack[-1])
        yield "open", element, ""
        if name in VOID or attrs.endswith("/"):
            yield "close", element, ""
        elif name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            yield "close", element, ""
        else:
            stack.append(element)
    yield from close_to(1)


def _decoded(raw: str) -> str:
    """A run of text; references are decoded inside the run, never across tags."""
    return _html.unescape(raw) if "&" in raw else raw


def _squeeze(text: str) -> str:
    return " ".join(text.split())


def tokens(page: str) -> dict[int, list]:
    """token -> [how often, the element's token around it, key or None of a text, main, first position, text length inside, of it in links].

    Lengths are sums over all the page's elements of the token and leave out what is never content. A text's lengths are its own.
    """
    root: list = [1, 0, "#", False, 0, 0, 0]
    found: dict[int, list] = {_ROOT: root}
    held: list[list] = [[0, 0, root]]  # of each open element: text length, of it in links, its token's entry
    links = 0
    for n, (kind, el, raw) in enumerate(events(page)):
        if kind == "open":
            t = found.setdefault(el.token, [0, el.up.token, el.key, el.main, n, 0, 0])
            t[0] += 1
            held.append([0, 0, t])
            links += el.name == "a"
        elif kind == "close":
            # What an element held goes to its token and to the element around it.
            text_, linked, t = held.pop()
            for of, i in ((t, 5), (held[-1], 0)):
                of[i] += text_
                of[i + 1] += linked
            links -= el.name == "a"
        elif kind == "text" and (text := _squeeze(_decoded(raw))):
            t = found.setdefault(_hash(f"{el.token}={text}"), [0, el.token, None, False, n, 0, 0])
            t[0] += 1
            if not el.drop:
                for of, i in ((t, 5), (held[-1], 0)):
                    of[i] += len(text)
                    of[i + 1] += len(text) * (links > 0)
    root[5:7] = held[0][:2]
    return found


def host_of(url):
    """Column: the host of a url, lower-cased; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def deduce(found: list[dict], pages: int) -> dict:
    """The template from a host's supported tokens, each with its class.

    frame: tokens of the once-a-page elements, nested by parent; repeated: the other valid classes' elements by the
    frame element in whose slot they stand; fixed: texts that are the template's; content: the content slot's elements;
    out: template elements inside it whose text is none.
    """
    tags = {t["token"]: t for t in found if t["key"] is not None}
    name = {k: t["key"].partition(".")[0] for k, t in tags.items()}
    # An ancestor of a valid element is on the same pages, hence valid.
    kids: dict[int, list[int]] = {}
    for k, t in tags.items():
        if t["up"] in tags:
            kids.setdefault(t["up"], []).append(k)
    fixed = [t for t in found if t["key"] is None and t["support"] >= FIXED * pages]
    plain = {k: t["text"] - t["links"] for k, t in tags.items()}
    vary, text = dict(plain), {k: t["text"] for k, t in tags.items()}
    changing = dict(text)
    for f in fixed:
        at = f["up"]
        while at in tags:
            vary[at] -= f["text"] - f["links"]
            changing[at] -= f["text"]
            at = tags[at]["up"]
    once = {k for k, t in tags.items() if t["total"] == t["support"]}
    named = {k for k, t in tags.items() if t["main"] and plain[k] > 0}
    repeated: dict[int, list[int]] = {}
    for k, t in tags.items():
        if k not in once:
            at = t["up"]
            while at in tags and at not in once:
                at = tags[at]["up"]
            repeated.setdefault(at, []).append(k)

    root = next((k for k, t in tags.items() if t["up"] not in tags), None)
    weight = vary if root is not None and vary[root] > 0 else plain
    content: list[int] = []
    slot = root
    if root is not None and weight[root] > 0:
        first = lambda k: (weight[k], -tags[k]["first"], -k)
        while steps := [k for k in kids.get(slot, []) if (k in once or k in named) and weight[k] >= HOLDS * weight[root]]:
            slot = max(steps, key=first)
        way = []
        at = slot
        while at in tags:
            way.append(at)
            at = tags[at]["up"]
        around = [k for k in reversed(way) if k in named]
        around = [k for k in around if name[k] == "article"][:1] or around[:1]
        if around:
            content = around
        else:
            beside, todo = [], list(kids.get(slot, []))
            while todo:
                k = todo.pop()
                beside += [k] if k in named else []
                todo += [] if k in named else kids.get(k, [])
            if beside and name[slot] in OUTER:
                content = sorted(beside)
            else:
                for up in way[1:]:
                    others = [k for k in kids.get(up, []) if k not in way and weight[k] > 0]
                    if name[up] in OUTER or not all(name[k] in HEADINGS for k in others):
                        break
                    slot = up
                content = [slot]
    out: list[int] = []
    todo = [k for c in content for k in kids.get(c, [])]
    # Where most of the content never changes, the pages are copies; then nothing of it is the template's.
    of_copies = sum(changing[c] for c in content) < 0.5 * sum(text[c] for c in content)
    last = max((tags[k]["first"] for c in content for k in kids.get(c, []) if name[k] not in GROUPS), default=0)
    members: dict[int, int] = {}
    for t in tags.values():
        members[t["class"]] = members.get(t["class"], 0) + 1
    while todo:
        k = todo.pop()
        if k in content:
            continue
        still = k in once and name[k] in GROUPS and text[k] > 0 and changing[k] <= 0
        # A list of records: its text stands in repeated elements alone, three of one class at least that lie in one another.
        records = [r for r in kids.get(k, []) if r not in once and members[tags[r]["class"]] >= 3 and any(tags[i]["class"] == tags[r]["class"] for i in kids.get(r, []))]
        listed = k in once and name[k] in GROUPS and text[k] > 0 and tags[k]["first"] > last and sum(text[r] for r in records) >= 0.9 * text[k] and weight[k] < HOLDS * weight[root]
        if not of_copies and (still or listed):
            out.append(k)
        else:
            todo += kids.get(k, [])
    return {"frame": sorted(once), "repeated": repeated, "fixed": [f["token"] for f in fixed], "content": content, "out": out}


def extract(page: str | None, template: dict | None) -> str:
    """The text of the page's content slots, blocks in page order, joined by newlines. template: content and out."""
    if not page:
        return ""
    every = list(events(page))
    opened = {el.token for kind, el, _ in every if kind == "open"}
    content = set(template["content"]) & (opened | {_ROOT}) if template else set()
    out = set(template["out"]) if content else set()
    if not content:  # by the page's own elements
        content = {el.token for kind, el, _ in every if kind == "open" and el.main and not el.drop} or {_ROOT}
    found: list[str] = []
    parts: list[str] = []
    depth, shut = int(_ROOT in content), 0

    def flush() -> None:
        if parts:
            text = _squeeze("".join(parts))
            parts.clear()
            if text:
                found.append(text)

    for kind, el, raw in every:
        if kind in ("open", "close"):
            if el.name in BLOCK or el.drop or el.token in out:
                flush()
            step = 1 if kind == "open" else -1
            depth += step * (el.token in content)
            shut += step * (el.token in out)
        elif depth > 0 and not shut and not el.drop:
            parts.append(" " if kind == "break" else _decoded(raw))
    flush()
    return "\n".join(found)


_ROOT = Element("#", "", None).token


def templates(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, template as JSON) of every host with MIN_PAGES pages and a valid class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            at, token, rest = [], [], []
            for i, cell in enumerate(batch.column(2)):
                got = tokens(cell.as_py() or "")
                at += [i] * len(got)
                token += got.keys()
                rest += got.values()
            where = pa.array(at, pa.int64())
            cols = zip(*rest) if rest else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(where), batch.column(1).take(where), pa.array(token, pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types))],
                names=["host", "page", "token", "n", "up", "key", "main", "first", "text", "links"],
            )

    read = pages.select(host_of(F.col(url_col)).alias("host"), F.xxhash64(id_col, url_col).alias("page"), F.col(html_col).cast("string").alias("html"))
    rows = read.mapInArrow(run, "host string, page bigint, token bigint, n bigint, up bigint, key string, main boolean, first bigint, text bigint, links bigint")
    mixed = F.xxhash64("page", "n")
    vectors = rows.groupBy("host", "token").agg(
        F.count("*").alias("support"),
        F.sum("n").alias("total"),
        F.bit_xor(mixed).alias("mix"),
        F.sum(F.shiftrightunsigned(mixed, 32)).alias("mix_sum"),
        F.max("up").alias("up"),
        F.max("key").alias("key"),
        F.max("main").alias("main"),
        F.avg("first").alias("first"),
        F.sum("text").alias("text"),
        F.sum("links").alias("links"),
    )
    sizes = read.groupBy("host").agg(F.count("*").alias("pages")).filter(F.col("pages") >= MIN_PAGES)
    valid = vectors.filter(F.col("support") >= 2).join(sizes, "host").filter(F.col("support") >= SUPPORT * F.col("pages"))
    # A class: tokens of one host with one vector. At most 2 / SUPPORT tokens for each that a page has on average.
    members = F.collect_list(F.struct("token", "up", "key", "main", "first", "text", "links"))
    classes = valid.groupBy("host", "pages", "support", "total", "mix", "mix_sum").agg(members.alias("tokens"))
    hosts = classes.groupBy("host", "pages").agg(F.collect_list(F.struct("support", "total", "tokens")).alias("classes"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                found = [t | {"support": c["support"], "total": c["total"], "class": i} for i, c in enumerate(row["classes"]) for t in c["tokens"]]
                found.sort(key=lambda t: (-t["support"], t["first"], t["token"]))
                made.append(json.dumps(deduce(found, row["pages"])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["host", "template"])

    return hosts.select("host", "pages", "classes").mapInArrow(build, "host string, template string")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    # Pages need their host's content and what goes from it; frame and fixed texts have done their part.
    template = F.to_json(F.from_json("template", "content array<bigint>, out array<bigint>"))
    known = materialize(templates(own).select("host", template.alias("template")), "templates")
    widest = known.agg(F.max(F.octet_length("template") + F.octet_length("host"))).first()[0] or 0
    joined = own.withColumn("host", host_of(F.col("url"))).join(broadcast_if_small(known, widest + 64), "host", "left").select("page_id", "url", "html", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str | None, dict | None] = {None: None}
        for batch in batches:
            texts = []
            for page, t in zip(batch.column(2), batch.column(3)):
                t = t.as_py()
                if t not in parsed:
                    if len(parsed) > 500:
                        parsed = {None: None}
                    parsed[t] = json.loads(t)
                texts.append(extract(page.as_py(), parsed[t]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    id_type = own.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars bigint")
