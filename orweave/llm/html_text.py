"""Main text of web pages: a suffix array over all pages of a host, guarded by page structure.

Blocks. A page is cut into blocks of text, with what its structure says of each: inside menus, headers,
footers, sidebars, notices, adverts, forms or reader comments (by tag, role, or a word of their class or
id), inside a marked article (``<article>``, else ``<main>``, else a container named as content), or nothing.

Suffix array. The blocks of all pages of a host, dropped ones too, are its token streams. A suffix starts at
every block; its key is the shortest sequence of whole blocks from there that holds ``run`` words, which is
all that finding repeats of that length needs. Suffixes are put in order by host and a 64-bit hash of the
key, and equal neighbours are counted: a key that stands on at least half of a host's pages, and on
``least`` of unlike content (by a sketch of 64 bits, which never counts too many), covers its blocks. The
order is made by aggregation, so a host with a third of all pages is no single task, and a host has at most
twice as many such keys as a page has blocks.

Text. Covered blocks go, and so do those that structure drops; what stands in a marked ``<article>`` or
``<main>`` is guarded from the array, since articles may share passages. Of a page that marks an article only
that is taken. Unique runs of blocks stay, and so does a passage that a few pages share.

Defined cases: a null or empty page has an empty text; unclosed elements end with their parent,
unclosed scripts and comments with the page; very long pages are read whole; repeated rows count towards
half of the host but not as unlike content, and each returns its text; null urls share one host; an empty
table gives no rows; the input's columns travel in one struct, so names never clash.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orweave.llm import common

RAW = "script|style|noscript|template|textarea|title|svg|math|iframe|object|select|button|canvas|audio|video|datalist"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*?(?:/>|>.*?(?:</\1\s*>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?][^>]*>|<(?![a-zA-Z/!?])|</(?![a-zA-Z])[^>]*>", re.S | re.I)
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden|itemprop)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROP_TAGS = frozenset("nav footer aside form menu dialog head".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: Words of a class or id, cut at anything but letters, that name what isn't article.
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial adsense banner breadcrumb breadcrumbs captcha comment comments commentlist consent cookie cookies copyright dialog discussion disqus feedback footer footnav form gdpr hidden login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion recommended related replies reply respond responses search share sharing sidebar sidenav signup social sponsor sponsored subscribe subscription survey teaser toolbar topbar widget widgets".split()
)
#: On <article> itself only these speak against it.
DROP_ARTICLE = frozenset("ad ads advert advertisement comment comments promo related reply respond sponsored teaser".split())
SOFT_WORDS = frozenset("header side top bottom".split())
CONTENT_WORDS = frozenset("article content post entry story main body text".split())
#: Names that speak of something else on the page: has-sidebar, no-ads, ad-free.
ABOUT = re.compile(r"\b(?:has|with|without|no|non|hide|show)[-_][a-z]+|\b[a-z]+[-_]free\b")
ARTICLE, MAIN, CONTENT, OPEN = 3, 2, 1, 0


def _judge(tag: str, attributes: str, inside: int) -> tuple[bool, int]:
    """(is it dropped, what it is: ARTICLE, MAIN, CONTENT or OPEN)."""
    drop, level, words = tag in DROP_TAGS or tag == "header" and not inside, OPEN, set()
    if attributes and not attributes.isspace():
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id"):
                words.update(re.findall("[a-z]+", ABOUT.sub(" ", value)))
            elif name == "role":
                drop |= value in DROP_ROLES
                level = MAIN if value == "main" else ARTICLE if value == "article" else level
            elif name == "itemprop":
                level = ARTICLE if value == "articlebody" else level
            else:
                drop |= name == "hidden" and value != "until-found" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value) is not None
    if tag == "article":
        return drop or bool(words & DROP_ARTICLE), ARTICLE
    if tag == "main":
        return drop, MAIN
    if tag in ("html", "body"):
        return False, level
    named = words & CONTENT_WORDS
    drop |= bool(words & DROP_WORDS) or bool(words & SOFT_WORDS) and not named and not inside
    if level == OPEN and named and not drop and tag in ("div", "section", "td"):
        level = CONTENT
    return drop, level


def parse(page: str) -> tuple[int, list[tuple[str, bool, frozenset]]]:
    """(what the text is taken from, the blocks: text, dropped, marks it stands in). OPEN: the page marks no article."""
    blocks: list[tuple[str, bool, frozenset]] = []
    stack: list[tuple[str, bool, int]] = []  # tag, dropped with all it holds, level
    dropped, level, parts, at = False, OPEN, [], 0

    def flush():
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                blocks.append((text, dropped, frozenset(x[2] for x in stack) if not dropped else frozenset()))

    for m in TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[0] == "<":
                parts.append("<")
            elif m[1] and m[1].lower() in ("textarea", "select", "button"):
                parts.append(" ")
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
            continue
        if tag in VOID and tag != "hr":
            continue
        block = tag in BLOCK
        if m[2]:
            if any(s[0] == tag for s in stack):
                flush()
                while stack.pop()[0] != tag:
                    pass
                dropped, level = (stack[-1][1], max(s[2] for s in stack)) if stack else (False, OPEN)
            elif block:
                flush()
            continue
        if block:
            flush()
            if stack and (stack[-1][0] == "p" or tag in ("li", "dt", "dd", "tr", "td", "th") and stack[-1][0] == tag):
                stack.pop()
                dropped, level = (stack[-1][1], max(s[2] for s in stack)) if stack else (False, OPEN)
        attributes = m[4]
        if tag == "hr" or attributes.endswith("/") or not block and "=" not in attributes:
            continue
        out, what = _judge(tag, attributes, level)
        if not block:
            if not out:
                continue
            flush()
        if tag == "p" and not out:
            continue
        stack.append((tag, dropped or out, OPEN if dropped or out else what))
        dropped, level = dropped or out, max(level, stack[-1][2])
    if at < len(page):
        parts.append(page[at:])
    flush()
    seen = frozenset().union(*(marks for _, _, marks in blocks))
    return next((x for x in (ARTICLE, MAIN, CONTENT) if x in seen), OPEN), blocks


def keys(blocks: list[str], run: int) -> list[tuple[int, int]]:
    """(64-bit hash of the key, first block behind it) of every suffix, by its first block; keys shorter than ``run`` words hash to 0."""
    sizes = [b.count(" ") + 1 for b in blocks]
    out, to, size = [], 0, 0
    for at in range(len(blocks)):
        while size < run and to < len(blocks):
            size += sizes[to]
            to += 1
        out.append((xxhash.xxh3_64_intdigest("\n".join(blocks[at:to])) - (1 << 63) if size >= run else 0, to))
        size -= sizes[at]
    return out


def text_of(page: str, covering: set[int], run: int) -> str:
    """The text of a page of a host where these keys cover their blocks."""
    best, blocks = parse(page)
    gone = [dropped or best not in marks and best != OPEN for _, dropped, marks in blocks]
    if covering and best in (CONTENT, OPEN):
        for at, (key, to) in enumerate(keys([b for b, _, _ in blocks], run)):
            if key in covering:
                gone[at:to] = [True] * (to - at)
    return "\n\n".join(b for (b, _, _), out in zip(blocks, gone, strict=True) if not out)


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))


def repeats(pages: DataFrame, run: int = 8, least: int = 5, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """host, covering: the keys that cover blocks of a host, as its suffix array tells."""
    common.ship(pages.sparkSession)

    def suffixes(batches):
        for batch in batches:
            for some in common.slices(batch, 1):
                hosts, found, bits = [], [], []
                for host, page in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    blocks = [b for b, _, _ in parse((page or b"").decode("utf-8", "replace"))[1]]
                    mine = {k for k, _ in keys(blocks, run)} - {0} | {0}  # 0 counts the page
                    hosts += [host] * len(mine)
                    found += mine
                    bits += [1 << xxhash.xxh3_64_intdigest("\n".join(blocks)) % 64] * len(mine)
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.int64()), pa.array(found, pa.int64()), pa.array(np.array(bits, np.uint64).view(np.int64))], names=["host", "key", "bits"])

    rows = pages.select(F.xxhash64(host_of(F.col(url_col))).alias("host"), F.col(html_col).cast("binary").alias("html"))
    array = rows.mapInArrow(suffixes, "host long, key long, bits long").groupBy("host", "key").agg(F.count("*").alias("n"), F.bit_or("bits").alias("bits"))
    array = common.table(array.where((F.bit_count("bits") >= least) | (F.col("key") == 0)), "suffixes", few=1)
    whole = array.where("key = 0").select("host", F.col("n").alias("all"))
    return array.where("key != 0").join(whole, "host").where("2 * n >= all").groupBy("host").agg(F.collect_list("key").alias("covering"))


def extract(pages: DataFrame, run: int = 8, least: int = 5, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """doc (struct of the input's columns but the html), text."""
    covering = common.table(repeats(pages, run, least, html_col, url_col), "covering", few=1)
    rest = F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != html_col])
    rows = pages.select(rest.alias("doc"), F.col(html_col).cast("binary").alias("html"), F.xxhash64(host_of(F.col(f"`{url_col}`"))).alias("host"))
    met = rows.join(covering, "host", "left").select("doc", "html", "covering")

    def cut(batches):
        for batch in batches:
            for some in common.slices(batch, 1):
                texts = [text_of((x or b"").decode("utf-8", "replace"), set(c or ()), run) for x, c in zip(some.column(1).to_pylist(), some.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(texts, pa.string())], names=["doc", "text"])

    return met.mapInArrow(cut, met.select("doc", F.lit("").alias("text")).schema)
