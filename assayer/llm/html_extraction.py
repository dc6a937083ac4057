"""The main text of web pages, by equivalence classes of tokens.

Pages of one host come from one template.  A token is a tag or a run of text at its
place in the tree; tokens that occur equally often on the same pages of a host share
their occurrence vector and form a class.  Classes found on enough different pages, whose tokens
keep their order and that nest, make up the host's template; what lies between their
tokens are slots.  Text of the template is left out, and so are slots in menus, adverts and the
like; the article's slots, or else all that remain, are the main text.

Occurrence vectors never leave their tasks: a vector is known by an order-free
fingerprint that is combined before the shuffle.  Pages are known by the hash of their content, so
copies of a page count once.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import stored
from .url_filter import url_host

# A class must be on so many different pages of its host, and on this share of them.
MIN_PAGES = 3
MIN_SHARE = 0.9
# Within an article, where passages of its own may recur, on so many.
MIN_ARTICLE_PAGES = 8

# Quotes count behind an equals sign only; nothing is tried twice, so long broken pages take linear time.
TAG = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+"[^"]*+(?:"|\Z)|=\s*+'[^']*+(?:'|\Z)|[^>])*+)(?:>|\Z)""",
    re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"?|'[^']*+'?|[^\s"'>]++))?""")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_a-zA-Z]+")
SPACE = re.compile(r"\s+")

# Elements and names of HTML pages.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li",
    "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead",
    "tr", "ul", "caption", "legend", "option",
}
OUTSIDE = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "svg", "dialog", "menu", "search", "object",
           "canvas", "audio", "video"}
MAIN = {"article", "main"}
BOILERPLATE = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo",
    "promotion", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "banner", "footer",
    "contentinfo", "copyright", "sidebar", "aside", "complementary", "related", "recommended", "notice", "notices", "cookie",
    "cookies", "consent", "gdpr", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login",
    "form", "search", "share", "sharing", "social", "comment", "comments", "disqus", "respond", "reply", "replies", "widget",
    "pagination", "pager", "toolbar", "skip", "alert",
}
# Words that say where or in what form a named part stands, not what it holds.
HELPERS = {
    "area", "bar", "block", "bottom", "box", "btn", "button", "buttons", "center", "container", "desktop", "fixed", "float", "global",
    "group", "icon", "icons", "inline", "inner", "item", "items", "js", "label", "large", "left", "link", "links", "list", "main",
    "mobile", "outer", "page", "panel", "posts", "primary", "right", "secondary", "section", "site", "slot", "small", "sticky",
    "stories", "top", "unit", "wrap", "wrapper", "zone",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# ``<p>`` and list items end where the next begins.
SELF_ENDING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
               "option": {"option"}}


def _attributes(raw: str) -> dict[str, str]:
    """The first value of each attribute; names in lower case."""
    found: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), value.strip(value[0]) if value[:1] in ("'", '"') else value)
    return found


def boilerplate_names(element: str, attributes: dict[str, str]) -> set[str]:
    """What the class names, the role and the id of an element say it is, other than the text.

    A name counts as a whole: ``share-buttons`` and ``adSlot2`` do, as their other words only tell
    the form; ``related-work`` does not.  An id names the place of a heading, not its kind.
    """
    names = f"{attributes.get('class', '')} {attributes.get('role', '')}".split()
    if element not in HEADINGS:
        names += attributes.get("id", "").split()
    said: set[str] = set()
    for name in names:
        parts = {part.lower() for part in PART.findall(name)}
        if parts <= BOILERPLATE | HELPERS:
            said |= parts & BOILERPLATE
    return said


def page_tokens(page: str) -> Iterator[tuple[str, str, int, bool, bool]]:
    """(kind, text, place, outside, main) of every tag (``<``), end of a block (``|``) and run of text (``t``) of a page.

    ``place`` is a hash of the open elements and their names; ``outside`` says that one of them is
    not part of the main text, ``main`` that an article is open.  Time and memory are linear in the page,
    however deep it nests.
    """
    # Name, place, outside, main, and whether an article that opens here is one of comments or asides.
    stack: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]
    opened: Counter[str] = Counter()
    at, end = 0, len(page)
    while at < end:
        found = TAG.search(page, at)
        until = found.start() if found else end
        if until > at:
            yield "t", page[at:until], *stack[-1][1:4]
        if not found:
            return
        at = found.end()
        name = (found.group(2) or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            yield "|", "", 0, False, False
        if found.group(1):
            if opened[name]:
                while True:
                    last = stack.pop()[0]
                    opened[last] -= 1
                    if last == name:
                        break
            continue
        raw = found.group(3)
        if name == "br":
            yield "t", " ", *stack[-1][1:4]
        if name in VOID:
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if raw.rstrip().endswith("/") and name not in BLOCKS:
            continue
        if name in SELF_ENDING and stack[-1][0] in SELF_ENDING[name]:
            opened[stack.pop()[0]] -= 1
        _, place, outside, main, barred = stack[-1]
        attributes = _attributes(raw) if raw else {}
        names = " ".join(attributes[a] for a in ("class", "id", "role", "aria-label") if a in attributes)
        place = xxhash.xxh64_intdigest(f"{name}.{names}", place)
        said = boilerplate_names(name, attributes) if names and name not in ("html", "body") else set()
        if name in MAIN and not main and not barred:
            outside, main = False, True  # whatever was left open before it
        # A header within the article is its own headline.
        elif name in OUTSIDE and not (main and name == "header"):
            outside = True
        if said - {"header"} or said and not main:
            outside = True
        barred = barred or name in ("aside", "footer", "nav") or not said.isdisjoint(("comment", "comments"))
        yield "<", name, place, outside, main
        stack.append((name, place, outside, main, barred))
        opened[name] += 1


def _token(kind: str, text: str, place: int) -> int:
    value = xxhash.xxh64_intdigest(f"{kind}{place}\0{text.strip() if kind == 't' else ''}")
    return value - (1 << 64) if value >> 63 else value


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page and different token: host, token, a hash of (content of the page, count), and where it first stands.

    Token 0 stands for the page itself.  Copies of a page give the same rows.
    """
    for batch in batches:
        rows = []
        for host, value in zip(batch.column(0), batch.column(1)):
            page = value.as_py() or ""
            page_hash = xxhash.xxh64_intdigest(page)
            seen: dict[int, list[int]] = {0: [1, 0]}
            for order, (kind, text, place, _, _) in enumerate(page_tokens(page)):
                if kind != "|" and (kind == "<" or text.strip()):
                    seen.setdefault(_token(kind, text, place), [0, order])[0] += 1
            host = host.as_py()
            for token, (count, order) in seen.items():
                vector = xxhash.xxh64_intdigest(b"%d %d" % (page_hash, count)) >> 1
                rows.append((host, token, vector, order))
        columns = list(zip(*rows)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["host", "token", "vector", "first"])


def host_templates(pages: DataFrame) -> DataFrame:
    """(host, template): the tokens of the valid classes of each host in page order, with their class and support."""
    found = pages.select(F.xxhash64(url_host(F.col("url"))).alias("host"), "html").mapInArrow(
        _occurrences, "host long, token long, vector long, first long")
    different = found.groupBy("host", "token", "vector").agg(F.min("first").alias("first"))
    tokens = different.groupBy("host", "token").agg(
        F.bit_xor("vector").alias("class"), F.count(F.lit(1)).alias("support"), F.avg("first").alias("position"))
    pages_of = F.max(F.when(F.col("token") == 0, F.col("support")))
    frequent = stored(tokens.where(F.col("support") >= MIN_PAGES))
    hosts = frequent.groupBy("host").agg(pages_of.alias("n_pages"))
    valid = frequent.where("token <> 0").join(hosts, "host").where(F.col("support") >= MIN_SHARE * F.col("n_pages"))
    return stored(valid.groupBy("host").agg(F.sort_array(F.collect_list(
        F.struct("position", "token", "class", "support"))).alias("template")))


def nested_tokens(template: list[dict] | None) -> dict[int, int]:
    """Tokens of the classes that nest, with their support: a class that cuts across a larger one is left out."""
    spans: dict[int, list[int]] = {}
    for order, entry in enumerate(template or []):
        spans.setdefault(entry["class"], [order, order])[1] = order
    kept: list[tuple[int, int]] = []
    classes = set()
    for name, (low, high) in sorted(spans.items(), key=lambda item: (item[1][0] - item[1][1], item[1])):
        if all(high < a or low > b or a <= low and high <= b for a, b in kept):
            kept.append((low, high))
            classes.add(name)
    return {entry["token"]: entry["support"] for entry in template or [] if entry["class"] in classes}


def main_text(page: str, template: list[dict] | None = None) -> str:
    """The blocks of the main text, one per line.

    They are the article's slots, or else all slots.  A page whose slots are empty holds nothing but
    what every page of its host holds, and keeps that.
    """
    known = nested_tokens(template)
    # By (in the article, in a slot): texts of the open block, and whole blocks.
    parts: dict[tuple[bool, bool], list[str]] = {(main, slots): [] for main in (True, False) for slots in (True, False)}
    blocks: dict[tuple[bool, bool], list[str]] = {key: [] for key in parts}

    def end_block() -> None:
        for key, texts in parts.items():
            if block := SPACE.sub(" ", "".join(texts)).strip():
                blocks[key].append(block)
            texts.clear()

    for kind, text, place, outside, main in page_tokens(page):
        if kind == "|":
            end_block()
        elif kind == "t" and not outside:
            support = known.get(_token(kind, text, place), 0) if known and text.strip() else 0
            decoded = html.unescape(text)
            parts[main, False].append(decoded)
            if not support or main and support < MIN_ARTICLE_PAGES:
                parts[main, True].append(decoded)
    end_block()
    return "\n".join(blocks[True, True] or blocks[True, False] or blocks[False, True] or blocks[False, False])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page.as_py() or "", template.as_py()) for page, template in zip(batch.column(2), batch.column(3))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            names=["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    NULL and empty pages have an empty text.  Character references are decoded; white space within a
    block is one space; blocks are joined by a line feed.  Pages without a host share
    one template; hosts of fewer than ``MIN_PAGES`` different pages have none.  Repeated rows each have a row
    and count once for the template; pages of any length and depth are read whole; other columns are ignored.
    """
    templates = host_templates(pages).withColumnRenamed("host", "__host")
    keyed = pages.select("page_id", "url", "html", F.xxhash64(url_host(F.col("url"))).alias("host"))
    joined = keyed.join(templates, keyed["host"] == templates["__host"], "left")
    return joined.select("page_id", "url", "html", "template").mapInArrow(
        _extract, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")
