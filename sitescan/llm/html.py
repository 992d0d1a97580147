"""Main text of web pages by removal of site templates.

A page is read into its element tree. Every element that is no inline markup is a subtree with a hash over its tag, texts and the hashes of
its children. Menus, adverts, headers and footers keep their build while their entries change from page to page; elements that are
mostly links and lie outside the article, or whose tag, role or class says that they are no article, have a second hash over tags and class names
only, a run of equal children counted as one. Spark counts, per host, on how many different pages each hash occurs
(copies of one page count once), and subtrees that recur on many of a host's pages are its template and are deleted. What a host
with few pages cannot show by recurrence is deleted by its tag, role or class alone, and where a page marks its article, only that
is read. As authors do repeat themselves, a paragraph or heading inside a marked article is template only if it is on at least half
of a host's pages and on `_LEAF_PAGES` of them.

Any other subtree needs `least_pages` pages and either a share `least_share` of the host's pages (`_BUILD_SHARE` for a build) or ten times the
square root of their number, whichever is less, so that the menu of a section counts on a large host too (20% of 2,500 pages, 1% of a
million). On a host of 3 or 4 pages it must be on all of them; hosts of 1 or 2 pages have no template. The templates of a host grow at
most with that square root. Up to `most_shipped` hashes of all hosts go to the tasks as they are, and pages are not shuffled; more are
joined to the pages, the pages of large hosts dealt over many tasks.

Null and empty pages have an empty text. A null url belongs to the host ''. A tag, comment or script that the end of the page cuts
off is dropped with what it would hold. Repeated rows are answered row by row; other columns are ignored; no rows give none. The work on a
page grows with its length, however deep it is nested.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, written

_TOKEN = re.compile(r"""<!--[\s\S]*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z!?][^>]*\Z""")
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: HTML's own element classes, and class names by which pages mark what is no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object canvas xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
DROPPED = frozenset("nav footer aside form button select dialog menu head figure-ad".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th tr caption figcaption address".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
NOT_ARTICLE = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promotion sidebar menu nav navbar navigation navigations "
    "breadcrumb breadcrumbs header masthead footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "share sharing social related recommended comment comments replies reply respond disqus login signup register search pagination pager widget widgets hidden".split()
)


#: Words that may stand beside those in the name of a class, as in 'main-nav' or 'ad-container'.
NEUTRAL = frozenset("site main primary secondary global left right top bottom list container wrapper wrap box area section block bar links buttons button form inner outer slot unit item items".split())

#: Pages of a host that must have a paragraph of their articles before it is taken for a notice.
_LEAF_PAGES = 20
#: Share of a host's pages that a build of menus and the like needs.
_BUILD_SHARE = 0.05
#: Parts over which the pages of one large host are dealt, where pages are shuffled.
_SALT = 256
_BOXES = frozenset("div section article main table ul ol dl td th body header blockquote aside nav footer form".split())
_LISTS = ("ul", "ol", "dl", "table", "div")
_DIGITS = re.compile(r"[0-9]+")
#: Kinds of hashes, in their last two bits: a subtree, a leaf of an article, a build.
_SUBTREE, _LEAF, _BUILD = 0, 1, 2


def _no_article(name: str) -> bool:
    """Whether the whole name of a class or id says so: all its words do, or are neutral beside one that does."""
    words = [w for w in re.split(r"[_\-]+", name) if w]
    return any(w in NOT_ARTICLE for w in words) and all(w in NOT_ARTICLE or w in NEUTRAL or w.isdigit() for w in words)


def _marked(attributes: str) -> tuple[bool, bool, bool]:
    """Whether attributes mark an element as no article, do so by class or id, and mark it as the article."""
    out = named = article = False
    for name, value in _ATTR.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            out = True
        elif name == "role":
            out |= value in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu")
            article |= value in ("main", "article")
        elif name in ("class", "id"):
            named |= any(map(_no_article, value.split()))
    return out, named, article


def _hash(parts: list[str], kind: int) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(parts)) >> 3 << 2 | kind


class _Element:
    """An open element: what is dropped and what is article, and where it began."""

    __slots__ = ("tag", "dropped", "article", "marked", "block", "parts", "build", "box", "named", "chars", "linked", "cores", "removed")


def walk(html: str | None, template: frozenset[int] | set[int] = frozenset(), spared: frozenset[int] = frozenset()) -> tuple[list[tuple[str, bool]], set[int], int]:
    """Blocks in page order as (text, stands in the article), the hashes of the page's subtrees, and how many (outermost) were template.

    Class rules pass over html, body, main, the article and whatever holds one of them: elements that turn out to do so are `spared`,
    by number, when the page is read once more. Articles inside a marked element count only if there is none outside."""
    blocks: list[tuple[str, bool]] = []
    hashes: set[int] = set()
    if not html:
        return blocks, hashes, 0
    pieces: list[str] = []
    top = _Element()
    top.tag, top.dropped, top.article, top.marked, top.block, top.parts, top.build, top.box, top.named, top.chars, top.linked, top.cores, top.removed = "", False, False, False, 0, [""], [""], 0, None, 0, 0, 0, 0
    stack = [top]
    #: by tag, the places on the stack of its open elements
    where: dict[str, list[int]] = {}
    #: numbers of elements dropped by class that hold a body or main, and an article
    holds: set[int] = set()
    holds_article: set[int] = set()
    number, free = 0, False
    #: characters read so far, those inside links, and articles and the like; subtrees removed
    chars = linked = cores = removed = 0

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                blocks.append((text, stack[-1].article))
            pieces.clear()

    def close(depth: int) -> None:
        nonlocal removed
        while len(stack) > depth:
            e = stack[-1]
            tag = e.tag
            if tag not in INLINE:
                flush()
                under = stack[-2]
                if len(e.parts) > 1:
                    found = [_hash(e.parts, _LEAF if tag in LEAVES and e.article else _SUBTREE)]
                    build = _hash(e.build, _BUILD)
                    held = chars - e.chars
                    if cores == e.cores and (e.marked or (held and not e.article and tag not in LEAVES and 5 * (linked - e.linked) >= 4 * held)):
                        found.append(build)
                    if not template.isdisjoint(found):
                        del blocks[e.block :]
                        removed = e.removed + 1
                    hashes.update(found)
                    under.parts.append(f"\1{found[0]:x}")
                    if under.build[-1] != (name := f"\1{build:x}"):
                        under.build.append(name)
                else:
                    under.parts.append(e.parts[0])
            stack.pop()
            where[tag].pop()

    def last(tags: tuple[str, ...], stop: int) -> int:
        """The place of the innermost open element of these tags, 0 if it lies outside the element at `stop`."""
        i = max((where[t][-1] for t in tags if where.get(t)), default=0)
        return i if i >= stop else 0

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        stop = m.start() if m else n
        if stop > at:
            text = unescape(html[at:stop])
            if not stack[-1].dropped:
                pieces.append(text)
            if not text.isspace():
                stack[-1].parts.append(text)
                chars += stop - at
                if where.get("a"):
                    linked += stop - at
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag in INLINE and not stack[-1].tag:
                continue
            i = last((tag,), stack[-1].box if tag in INLINE else 0)
            if i:
                close(i)
            elif tag not in INLINE:
                flush()
            continue
        attributes = m[3] or m[6] or ""
        if tag in RAW and not attributes.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if tag in VOID:
            if tag in ("br", "hr") and not stack[-1].dropped:
                pieces.append(" ")
                if tag == "hr":
                    flush()
            continue
        if tag in CLOSES_P:
            i = last(("p",), stack[-1].box)
            if i:
                close(i)
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            same = ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)
            i = last(same, last(_LISTS, 0))
            if i:
                close(i)
        if tag not in INLINE:
            flush()
        number += 1
        out, named, article = _marked(attributes) if attributes else (False, False, False)
        under, e = stack[-1], _Element()
        core = article or tag in ("article", "main", "body", "html")
        if core:
            cores += 1
            reached = holds if (article and tag != "article") or tag in ("main", "body", "html") else holds_article
            around = under.named
            free |= reached is holds_article and around is None
            while around is not None and around[0] not in reached:
                reached.add(around[0])
                around = around[1]
        named = named and not core and number not in spared
        e.tag, e.named, e.article = tag, (number, under.named) if named else under.named, under.article or article or tag in ("article", "main")
        e.marked = out or named or tag in DROPPED or (tag == "header" and not under.article)
        e.dropped, e.block, e.chars, e.linked, e.cores, e.removed = under.dropped or e.marked, len(blocks), chars, linked, cores, removed
        if tag in INLINE:
            e.parts, e.build = under.parts, under.build
        else:
            e.parts, e.build = ["<" + tag], [f"<{tag} {_DIGITS.sub('', ' '.join(sorted(v for k, v in _ATTR.findall(attributes) if k.lower() in ('class', 'id', 'role'))))}" if attributes else "<" + tag]
        e.box = len(stack) if tag in _BOXES else under.box
        where.setdefault(tag, []).append(len(stack))
        stack.append(e)
    flush()
    close(1)
    again = holds if free or holds else holds_article
    if again and not spared:
        return walk(html, template, frozenset(again))
    return blocks, hashes, removed


def read_page(html: str | None, template: frozenset[int] | set[int] = frozenset()) -> tuple[str, int]:
    """Blocks of the article, or of the whole page where no article is marked, joined by two line feeds; number of subtrees removed."""
    blocks, _, removed = walk(html, template)
    inside = [t for t, article in blocks if article]
    return "\n\n".join(inside or [t for t, _ in blocks]), removed


def main_text(html: str | None, template: frozenset[int] | set[int] = frozenset()) -> str:
    return read_page(html, template)[0]


def _host() -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def counts(pages: DataFrame, least: int = 3) -> DataFrame:
    """host, hash, n (different pages of the host that have it) and pages (its different pages), for hashes on `least` pages and more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            html = batch.column(1).to_pylist()
            # 0 stands for the page itself
            found = [[0, *walk(h)[1]] for h in html]
            whole = [xxhash.xxh3_64_intdigest(h or "") >> 1 for h in html]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(whole, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["host", "page", "hashes"])

    small_batches(pages.sparkSession)
    rows = pages.select(_host().alias("host"), F.col("html").cast("string").alias("html"))
    rows = rows.mapInArrow(run, "host string, page long, hashes array<long>").dropDuplicates(["host", "page"])
    found = rows.select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("n"))
    found = written(found.filter((F.col("n") >= least) | (F.col("hash") == 0)), "subtrees")
    return found.filter("hash <> 0").join(found.filter("hash = 0").select("host", F.col("n").alias("pages")), "host")


def templates(pages: DataFrame, least_pages: int = 5, least_share: float = 0.3) -> DataFrame:
    """host, hash: the subtrees that recur on many different pages of the host, a row each."""
    n, pages_of, kind = F.col("n"), F.col("pages"), F.col("hash").bitwiseAND(F.lit(3))
    share = F.when(kind == _BUILD, min(_BUILD_SHARE, least_share)).otherwise(least_share)
    usual = (n >= least_pages) & (n >= F.least(share * pages_of, 10 * F.sqrt(pages_of)))
    leaf = (n >= _LEAF_PAGES) & (2 * n >= pages_of)
    often = F.when(kind == _LEAF, leaf).when(pages_of < least_pages, n == pages_of).otherwise(usual)
    return counts(pages, min(3, least_pages)).filter(often).select("host", "hash")


def extracted(pages: DataFrame, least_pages: int = 5, least_share: float = 0.3, most_shipped: int = 500_000) -> DataFrame:
    """page_id, url, text, n_chars and n_removed (subtrees deleted as template) of every row."""
    found = written(templates(pages, least_pages, least_share), "templates")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), _host().alias("host"))
    shipped: dict[str, frozenset[int]] = {}
    if found.count() <= most_shipped:
        for host, hashes in found.groupBy("host").agg(F.collect_list("hash")).collect():
            shipped[host] = frozenset(hashes)
    else:
        # the pages of large hosts are dealt over several tasks, each of which gets the host's short array
        size = rows.groupBy("host").agg(F.count("*").alias("n"))
        large = [r.host for r in size.filter(F.col("n") > rows.count() / _SALT).collect()]  # less than _SALT hosts
        is_large = F.col("host").isin(large) if large else F.lit(False)
        found = found.groupBy("host").agg(F.collect_list("hash").alias("template"))
        found = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(is_large, _SALT - 1).otherwise(0))))
        rows = rows.withColumn("salt", F.when(is_large, F.pmod(F.xxhash64("page_id", "url"), F.lit(_SALT))).otherwise(0).cast("int"))
        rows = rows.join(found, ["host", "salt"], "left").select("page_id", "url", "html", "host", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none: frozenset[int] = frozenset()
        for batch in slices(batches, 2):
            joined = batch.column(4).to_pylist() if len(batch.columns) > 4 else None
            out = [read_page(h, shipped.get(host, none) if joined is None else frozenset(joined[i] or ())) for i, (h, host) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))]
            text = [t for t, _ in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64()), pa.array([r for _, r in out], pa.int64())], ["page_id", "url", "text", "n_chars", "n_removed"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_removed long")
