"""Main text of web pages: a suffix array per host finds what its pages repeat, markup checks the rest.

All blocks of all pages enter the array but the plain ones of articles: paragraphs, headings, lists, quotes and tables inside
an article (or main) element, which stay whatever repeats. So do the texts that markup sets aside: menus, headers, footers,
sidebars, notices, adverts, forms, comments, and what stands beside an article (scripts and styles are no text). Open are the
other blocks of an article, its paragraphs that only a name marks, and all blocks of a page that marks no article. The token
streams of a host's pages are concatenated and their suffixes sorted by prefix doubling; neighbours that share ``WINDOW`` tokens
or more hold a substring that repeats. Every repeat of ``WINDOW`` or more tokens is covered by the windows in it, each on as
many pages at least, so the counts of windows find the same stretches as those of all maximal repeats.

A stretch is boilerplate if at least ``LEAST_PAGES`` different pages and ``LEAST_SHARE`` of the host's different pages hold it,
open or set aside, and at least ``LEAST_OPEN`` of them in open blocks (a headline or lead that lists of other pages quote is
open on its own page alone); or if as many pages and as great a share of those with open blocks hold it in these. It goes from
the open blocks, and the runs between are kept; then what markup sets aside goes as well.

Hosts with many pages or much text are cut into shards. Each shard sorts its own suffixes and reports how many of its pages
hold each window; the counts are summed over the host's shards, so the result does not depend on the cut.

Defined results: a null or empty html gives an empty text. Pages of a host with the same blocks of main text, or without any and
with the same blocks set aside, count as one, which holds what any of them sets aside, and get the same text, so copies do not
make each other boilerplate. A null url belongs to the host "". An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, saved

WINDOW = 8
LEAST_PAGES = 3
LEAST_SHARE = 0.3
LEAST_OPEN = 2
SHARD_PAGES = 1000
SHARD_CHARS = 8 << 20

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z",
    re.S,
)
NAMED = re.compile(r"""(?:^|\s)(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements whose content is not text of the page.
RAW = frozenset("script style noscript template svg math iframe object canvas audio video head title textarea".split())
#: Elements that hold no main text.
ASIDE = frozenset("nav header footer aside form button select option menu dialog label fieldset".split())
#: Words in a class, id or role that mark such an element.
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs header footer sidebar aside widget cookie cookies consent gdpr notice notification alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended comment comments respond disqus reply "
    "replies complementary contentinfo search pagination pager toolbar copyright disclaimer".split()
)
#: Words that stand beside them in names of such elements: "site-nav", "comment-list". "no-sidebar" or "social-impact" hold others.
NEUTRAL_WORDS = frozenset(
    "site page post entry article main top bottom left right primary secondary global mobile desktop list box container wrapper wrap "
    "section area block bar form link links button buttons posts articles items slot unit inner outer".split()
)
#: Of elements of these words, articles are teasers or comments, unless the page has no other.
TEASER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored promo promotion sidebar aside widget related "
    "recommended comment comments respond disqus reply replies complementary newsletter popup modal".split()
)
#: How an element is set aside: not, with all it holds, or unless it holds an article or main element.
KEPT, GONE, LOOSE = 0, 1, 2
LOOSE_TAGS = frozenset(("form", "fieldset"))
TITLED = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that are text of an article wherever they stand in it.
FIXED = TITLED | frozenset("p li blockquote pre td th dd dt figcaption caption".split())
#: Elements that end one of their kind.
CELLS = frozenset("li td th dd dt".split())
#: Elements inside a line; all others end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q ruby rt rp s samp small span strike strong sub sup "
    "time tt u var wbr".split()
)
HOLDS = re.compile(r"<(?:article|main)\b", re.I)
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def aside_words(tag: str, attributes: str) -> set[str]:
    """The words that mark an element as holding no main text: whole names, or names of such and neutral words only."""
    found: set[str] = set()
    for m in NAMED.finditer(attributes):
        kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if kind == "id" and tag in TITLED:  # a slug of the heading
            continue
        for name in [value] if kind == "aria-label" else value.split():
            words = {w for w in re.split(r"[^a-z]+", name) if len(w) > 1}
            if kind == "aria-label" and len(name.split()) > 1:  # free text
                continue
            if words <= ASIDE_WORDS | NEUTRAL_WORDS:
                found |= words & ASIDE_WORDS
    return found


def sidelong(tag: str, attributes: str, inside: bool) -> int:
    """How the element is set aside. An article's own header holds its headline."""
    if tag in ASIDE:
        return KEPT if inside and tag == "header" else LOOSE if tag in LOOSE_TAGS else GONE
    if not attributes:
        return KEPT
    words = aside_words(tag, attributes)
    if tag in ("html", "body", "article", "main"):
        return GONE if words & {"comment", "comments"} and tag == "article" else KEPT
    if inside:
        words.discard("header")
    if words:
        return GONE if words & TEASER_WORDS else LOOSE
    return GONE if "hidden" in attributes.lower().split() else KEPT


def blocks_of(page: str, loose: bool = False) -> list[tuple[int, str]]:
    """(place, text) of every block: place -1 set aside, 0 outside articles, 1 open and 2 fixed inside a main
    element, 3 open and 4 fixed inside an article element. Elements that are set aside by their names are not if a main
    element stands in them, nor if an article does, unless its like are teasers; with ``loose``, no element is."""
    found: list[tuple[int, str]] = []
    held: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # open elements, how each is set aside, and whether its name leaves it in doubt
    names: Counter[str] = Counter()  # of open elements
    hows: Counter[int] = Counter()  # how they are set aside
    aside = article = whole = fixed = doubt = 0
    at = 0

    def close() -> None:
        if held:
            text = "".join(held)
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                found.append((-1 if aside else 0 if not article + whole else (3 if article else 1) + (fixed > 0 and not doubt), text))
            held.clear()

    while True:
        m = TAG.search(page, at)
        held.append(page[at : m.start() if m else len(page)])
        if m is None:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = (m[1], m[3]) if m[2] else (m[4], m[6])
        if tag in INLINE:
            continue
        if tag == "br":
            held.append(" ")
            continue
        close()
        if closing:
            if names[tag]:
                while True:
                    name, side, unsure = stack.pop()
                    names[name] -= 1
                    hows[side] -= 1
                    aside -= side > 0
                    doubt -= unsure
                    article -= name == "article"
                    whole -= name == "main"
                    fixed -= name in FIXED
                    if name == tag:
                        break
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in EMPTY or attributes.endswith("/") and tag not in FIXED:
            continue
        if tag in FIXED:  # these end an open one of their kind
            last = stack[-1][0] if stack else ""
            if last == "p" and (tag == "p" or tag in TITLED) or tag in CELLS and (last in CELLS or last == "p"):
                _, side, unsure = stack.pop()
                names[last] -= 1
                hows[side] -= 1
                aside -= side > 0
                doubt -= unsure
                fixed -= 1
        inside = article + whole > 0
        side = sidelong(tag, attributes, inside)
        unsure = side > 0 and inside and tag in FIXED  # a paragraph by its name only: open
        if unsure:
            side = KEPT
        if tag in ("article", "main") and not side and aside and not inside:
            freed = [LOOSE, GONE] if loose or tag == "main" and not any(names[x] for x in ASIDE if x not in LOOSE_TAGS) else [LOOSE]
            if any(hows[x] for x in freed):  # those are kept from here on, so all such passes together are linear
                stack = [(t, KEPT if how in freed else how, d) for t, how, d in stack]
                hows = Counter(how for _, how, _ in stack)
                aside = hows[LOOSE] + hows[GONE]
        stack.append((tag, side, unsure))
        names[tag] += 1
        hows[side] += 1
        aside += side > 0
        doubt += unsure
        article += tag == "article"
        whole += tag == "main"
        fixed += tag in FIXED
    close()
    return found


def parted(page: str) -> tuple[list[tuple[bool, str]], list[str]]:
    """(open, text) of the blocks that are or may be main text, those of the articles, else of the main element, else all that
    are not set aside; and the different texts of the other blocks."""
    found = blocks_of(page)
    if not any(place > 0 for place, _ in found) and HOLDS.search(page):
        found = blocks_of(page, loose=True)
    least = next((x for x in (3, 1) if any(place >= x for place, _ in found)), 0)
    chosen = [(place in (0, 1, 3), text) for place, text in found if place >= least]
    return chosen, list(dict.fromkeys(text for place, text in found if place < least))


def settled(page: str) -> list[tuple[bool, str]]:
    """(open, text) of the blocks that are or may be main text."""
    return parted(page)[0]


def host(url: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def _doubled(rank: np.ndarray, step: int) -> np.ndarray:
    """Ranks by twice as many tokens, or by ``step`` more."""
    n = len(rank)
    later = np.concatenate([rank[step:], np.full(min(step, n), -1)])[:n]
    return np.unique(rank.astype(np.int64) * (n + 1) + later + 1, return_inverse=True)[1].astype(np.int64).ravel()


def suffix_ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Rank of the first ``depth`` tokens from each place, by prefix doubling; equal ranks are equal substrings."""
    rank, known = np.unique(tokens, return_inverse=True)[1].ravel(), 1
    while known < depth:
        step = min(known, depth - known)
        rank = _doubled(rank, step)
        known += step
    return rank


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all suffixes in their order, by prefix doubling, and how many tokens each shares with the one before."""
    n = len(tokens)
    levels = [np.unique(tokens, return_inverse=True)[1].ravel().astype(np.int32)]  # ranks by the first 1, 2, 4, ... tokens
    while n and int(levels[-1].max()) + 1 < n:
        levels.append(_doubled(levels[-1], 1 << len(levels) - 1).astype(np.int32))
    order = np.argsort(levels[-1], kind="stable")
    shared = np.zeros(n, np.int64)
    before, after = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        at = np.flatnonzero((before < n) & (after < n))
        at = at[levels[k][before[at]] == levels[k][after[at]]]
        for x in (before, after):
            x[at] += 1 << k
        shared[at + 1] += 1 << k
    return order, shared


def windows_of(streams: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window in the concatenated streams: its stream, its first token there, and a hash of its text.

    A stream shorter than a window is one window by itself.
    """
    words: dict[str, int] = {}
    ids: list[int] = []
    for i, stream in enumerate(streams):
        ids += [words.setdefault(w, len(words)) for w in stream] + [-2 - i]  # an end that equals no other
    flat, size = np.array(ids, np.int64), np.array([len(s) for s in streams], np.int64)
    own = np.repeat(np.arange(len(streams)), size + 1)
    where = np.arange(len(flat)) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
    order, shared = suffix_array(flat)
    # neighbours that share a window or more stand for one repeated substring, and all its places are neighbours
    repeat = np.cumsum(shared < WINDOW)
    whole = (where + WINDOW <= size[own]) | ((where == 0) & (size[own] < WINDOW) & (size[own] > 0))
    chosen = whole[order]
    order, repeat = order[chosen], repeat[chosen]
    own, where = own[order], where[order]
    first = np.flatnonzero(np.diff(repeat, prepend=-1))
    values = [
        xxhash.xxh64_intdigest(" ".join(streams[i][at : at + WINDOW])) - (1 << 63) for i, at in zip(own[first].tolist(), where[first].tolist(), strict=True)
    ]
    return own, where, np.repeat(np.array(values, np.int64), np.diff(first, append=len(repeat)))


COUNTED = pa.schema(
    [("host", pa.string()), ("shard", pa.int32()), ("hash", pa.int64()), ("content", pa.int64()), ("held", pa.int64()), ("held_open", pa.int64())]
)


def _count(table: pa.Table, least_pages: int) -> pa.Table:
    """Per window of a shard, how many of its pages hold it, and how many in open blocks.

    Rows of pages that stand in several shards come by page, under its content. A shard that is the whole host leaves
    out the windows on fewer than ``least_pages``.
    """
    number: dict[int, int] = {}
    blocks: dict[tuple[int, bool, str], None] = {}
    split: set[int] = set()
    for r in table.select(["content", "spread", "open", "rest"]).to_pylist():
        i = number.setdefault(r["content"], len(number))
        if r["spread"]:
            split.add(i)
        blocks.update(((i, is_open, text), None) for is_open in (True, False) for text in r["open" if is_open else "rest"])
    own, _, hashes = windows_of([text.split() for _, _, text in blocks])
    page, is_open = np.array([i for i, _, _ in blocks], np.int64)[own], np.array([o for _, o, _ in blocks], bool)[own]
    value, which = np.unique(hashes, return_inverse=True)
    pairs, pair = np.unique(which * len(number) + page, return_inverse=True)
    which, page = pairs // len(number), pairs % len(number)
    opened = np.zeros(len(pairs), np.int64)
    opened[pair[is_open]] = 1
    apart = np.isin(page, np.array(list(split), np.int64))
    held = np.bincount(which[~apart], minlength=len(value))
    held_open = np.bincount(which[~apart], opened[~apart], len(value)).astype(np.int64)
    told = np.flatnonzero(held >= (least_pages if table.column("shards")[0].as_py() == 1 else 1))
    contents = np.array(list(number), np.int64)

    def rows(at: np.ndarray, content: pa.Array, n: np.ndarray, n_open: np.ndarray) -> pa.Table:
        here = [pa.array([table.column(c)[0].as_py()] * len(at), COUNTED.field(c).type) for c in ("host", "shard")]
        return pa.table([*here, value[at], content, n, n_open], schema=COUNTED)

    return pa.concat_tables(
        [
            rows(told, pa.nulls(len(told), pa.int64()), held[told], held_open[told]),
            rows(which[apart], pa.array(contents[page[apart]]), np.ones(apart.sum(), np.int64), opened[apart]),
        ]
    )


def _strip(pages: pa.Table, shared: pa.Table) -> pa.Table:
    """The text of each page of a shard without the stretches of its open blocks that are shared."""
    known = np.sort(shared.column("hash").to_numpy()) if shared.num_rows else np.empty(0, np.int64)
    rows = pages.to_pylist()
    streams = [text.split() for r in rows for text in r["open"]]
    own, where, hashes = windows_of(streams) if streams else (np.empty(0, np.int64),) * 3
    hit = np.isin(hashes, known)
    covered = [np.zeros(len(s), bool) for s in streams]
    for i, at in zip(own[hit].tolist(), where[hit].tolist(), strict=True):
        covered[i][at : at + WINDOW] = True
    kept = iter([" ".join(w for w, c in zip(s, gone, strict=True) if not c) for s, gone in zip(streams, covered, strict=True)])
    out = []
    for r in rows:
        out.append(" ".join(t for is_open, fixed in zip(r["is_open"], r["blocks"], strict=True) if (t := next(kept) if is_open else fixed)))
    return pa.table({"host": pages.column("host"), "content": pages.column("content"), "text": pa.array(out, pa.string())})


def main_texts(
    pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, shard_pages: int = SHARD_PAGES, shard_chars: int = SHARD_CHARS
) -> DataFrame:
    """(page_id, url, text) of every page."""
    chosen = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), pages["html"].alias("html"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, "html"):
                found = [parted(h) if h else ([], []) for h in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("page_id"),
                        batch.column("url"),
                        pa.array([[t for _, t in x] for x, _ in found], pa.list_(pa.string())),
                        pa.array([[o for o, _ in x] for x, _ in found], pa.list_(pa.bool_())),
                        pa.array([x for _, x in found], pa.list_(pa.string())),
                    ],
                    names=["page_id", "url", "blocks", "is_open", "rest"],
                )

    parsed = chosen.mapInArrow(parse, "page_id long, url string, blocks array<string>, is_open array<boolean>, rest array<string>")
    content = F.when(F.size("blocks") > 0, F.xxhash64("blocks", "is_open")).otherwise(F.xxhash64("rest"))
    parsed = saved(parsed.withColumn("host", host("url")).withColumn("content", content), "parsed-pages")
    streams = parsed.where((F.size("blocks") > 0) | (F.size("rest") > 0)).select(
        "host", "content", F.xxhash64("rest").alias("copy"), F.filter("blocks", lambda x, i: F.col("is_open")[i]).alias("open"), "rest"
    )
    streams = saved(streams.groupBy("host", "content", "copy").agg(F.any_value("open").alias("open"), F.any_value("rest").alias("rest")), "streams")
    chars = F.length(F.array_join("open", " ")) + F.length(F.array_join("rest", " "))
    different = streams.groupBy("host", "content").agg(
        F.count("*").alias("copies"), F.sum(chars).alias("chars"), F.max((F.size("open") > 0).cast("int")).alias("has_open")
    )
    different = saved(different, "different-pages")
    sizes = different.groupBy("host").agg(
        F.count("*").alias("pages"), F.sum("has_open").alias("open_pages"), F.sum("copies").alias("copies"), F.sum("chars").alias("chars")
    )
    # hosts of more than one shard: at most a thousandth part of the pages, and so are the pages whose copies fill one
    shards = F.greatest(F.ceil(F.col("copies") / shard_pages), F.ceil(F.col("chars") / shard_chars))
    large = sizes.select("host", shards.alias("shards")).where(F.col("shards") > 1)
    full = different.where((F.col("copies") > shard_pages) | (F.col("copies") > 1) & (F.col("chars") > shard_chars))
    spread = full.select("host", "content", F.lit(True).alias("spread"))

    def dealt(rows: DataFrame, key: Column) -> DataFrame:
        sharded = rows.join(large, "host", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
        return sharded.withColumn("shard", F.pmod(key, F.col("shards")).cast("int"))

    marked = streams.join(spread, ["host", "content"], "left").withColumn("spread", F.col("spread").isNotNull())
    cut = dealt(marked, F.when(F.col("spread"), F.col("copy")).otherwise(F.col("content"))).repartition("host", "shard")
    counted = cut.groupBy("host", "shard").applyInArrow(
        lambda t: _count(t, least_pages), "host string, shard int, hash long, content long, held long, held_open long"
    )
    counted = saved(counted, "windows")
    apart = counted.where("content is not null").groupBy("host", "hash", "content").agg(F.max("held").alias("held"), F.max("held_open").alias("held_open"))
    summed = counted.where("content is null").unionByName(apart, allowMissingColumns=True)
    held, held_open = F.col("held"), F.col("held_open")
    often = summed.groupBy("host", "hash").agg(F.sum("held").alias("held"), F.sum("held_open").alias("held_open"))
    often = often.where((held >= least_pages) & (held_open > 0)).join(sizes, "host")
    everywhere = (held_open >= min(LEAST_OPEN, least_pages)) & (held >= least_share * F.col("pages"))
    in_open = (held_open >= least_pages) & (held_open >= least_share * F.col("open_pages"))
    common = often.where(everywhere | in_open).select("host", "hash")
    # a host's common windows are few, about its tokens of a page by the least share: all its shards get them
    shared = common.join(large, "host", "left").select(
        "host", F.explode(F.sequence(F.lit(0), (F.coalesce("shards", F.lit(1)) - 1).cast("int"))).alias("shard"), "hash"
    )
    any_open = F.array_contains("is_open", True)
    plain = parsed.where(~any_open).select("page_id", "url", F.array_join("blocks", " ").alias("text"))
    disputed = parsed.where(any_open)
    once = disputed.groupBy("host", "content").agg(F.any_value("blocks").alias("blocks"), F.any_value("is_open").alias("is_open"))
    once = dealt(once, F.col("content")).withColumn("open", F.filter("blocks", lambda x, i: F.col("is_open")[i])).repartition("host", "shard")
    stripped = once.groupBy("host", "shard").cogroup(shared.groupBy("host", "shard")).applyInArrow(_strip, "host string, content long, text string")
    return plain.unionAll(disputed.select("page_id", "url", "host", "content").join(stripped, ["host", "content"]).select("page_id", "url", "text"))
