"""Main text of web pages: marked-up articles as they stand, other pages without what their host repeats.

A page is read into blocks of text, each in the zone of its innermost telling element:
removed (menus, footers, forms, scripts and the like, by element or by words of class, id and role), article,
main (the element, or a container named content, post and the like), or open (nothing says). The blocks of the best zone are held
against the host's other pages, as a suffix array would show them: the pages' streams of tokens (all words, those of articles too, and a mark before
each block) are one text a host, whose suffixes are ranked by their first LONG tokens, by doubling;
Spark brings equal suffixes of a host together, after ranks of half the length have told which may have equals. Of a run of LONG tokens or more that
pages with different markup share, every token is covered; a block more than half of whose words are covered is boilerplate, unless
it is an article's, for which markup vouches. A host is never a group: its suffixes are dealt out by rank.

Suffixes are compared by 64-bit fingerprints that hold the host. Pages alike as a whole don't count as
repeating each other, and a page that would be left with less than a tenth of its words, a near copy of another, keeps its blocks.
What repeats inside articles stays: pages of a host copy articles and share passages, which are main text.

Text: character references decoded, white space inside a block one space, ends trimmed, blocks
joined by a newline; inline elements and line breaks don't end a block.

Defined cases: a null or empty html gives an empty text; a page without a host, or alone on its host, keeps
all open blocks; unclosed elements end with their container, an unclosed comment or script with the page; rows that
share a page_id are pages of their own, and rows alike in all are judged alike; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.blocks import mix, signed, words
from pagemill.llm.bloom import Bloom, Test
from pagemill.llm.repeats import HELD, repeated, twice_at_most
from pagemill.llm.work import NO_ID, bounded_batches, freed, removed, written

LONG = 8  # tokens; a power of two
GROUP = 1 << 19  # bytes of markup that are read together
COPY = 10  # a page that would be left with less than a tenth of its words is a near copy of another
USUAL = 200  # characters of attributes that are remembered
GONE, OPEN, MAIN, ARTICLE = range(4)

_MARKUP = re.compile(
    r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|/(?=[^a-zA-Z])[^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z))""", re.S
)
_ATTRIBUTE = re.compile(r"""(?:^|[\s/"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in "script style textarea title xmp iframe noembed noframes".split()}
HEAD = set("title meta link script style base noscript template".split())
REMOVED = set("head title script style noscript template iframe noembed noframes object canvas audio video svg map nav menu aside footer form fieldset button select textarea dialog datalist".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr picture q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()) | set(
    "script style noscript template iframe object canvas audio video svg map button select textarea input link meta datalist math".split()
)
AFTER_P = set("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
# what a start tag ends, up to which element: list items, definitions, cells and rows
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), **dict.fromkeys(("dd", "dt"), ({"dd", "dt"}, {"dl"})), **dict.fromkeys(("td", "th"), ({"td", "th"}, {"tr", "table"})), "tr": ({"tr"}, {"table"})}
# words in class, id and role of menus, footers, sidebars, notices, adverts, forms and comments; of headers, outside articles
WORDS = set(
    "menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer copyright colophon contentinfo sidebar aside complementary widget notice notices notification cookie cookies consent gdpr alert "
    "alertdialog popup modal overlay newsletter subscribe signup ad ads advert adverts advertisement advertising sponsor sponsored promo promotion form search login comment comments disqus respond replies share sharing social related recommended".split()
)
HEADERS = set("header masthead banner topbar".split())
UNLESS = set("with without no not has free and".split())  # content-with-sidebar is no sidebar
CONTENT = set("article articlebody content entry main maincontent post story".split())  # of a container that stands for main where there is no such element


class Block(NamedTuple):
    zone: int
    text: str


def _zone(zone: int, name: str, attributes: str) -> int:
    """The zone inside an element that stands in ``zone``."""
    return (_usual_zone if len(attributes) < USUAL else _zone_of)(zone, name, attributes)


def _zone_of(zone: int, name: str, attributes: str) -> int:
    if zone == GONE or name in REMOVED or (name == "header" and zone != ARTICLE):
        return GONE
    given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if "=" in attributes else {}
    if name not in ("html", "body"):
        marks = [[w.lower() for w in _NAME_WORDS.findall(x)] for v in given.values() for x in v.split()]
        if name in ("article", "main"):
            marks = [m for m in marks if m in (["comment"], ["reply"])]
            if marks:
                return GONE
        elif any((WORDS & set(m) or (zone != ARTICLE and HEADERS & set(m))) and not UNLESS & set(m) for m in marks):
            return GONE
        elif name in ("div", "section", "td") and any(CONTENT & set(m) and not UNLESS & set(m) for m in marks):
            zone = max(zone, MAIN)
    role = given.get("role", "").lower()
    return max(zone, ARTICLE if "article" in (name, role) else MAIN if name == "main" or role == "main" else OPEN)


_usual_zone = lru_cache(1 << 14)(_zone_of)  # start tags of a site are mostly alike


def read_blocks(markup: str) -> list[Block]:
    """All blocks of a page that hold text, in order."""
    out: list[Block] = []
    parts: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []  # open elements, and the zone around each
    zone = OPEN

    def end_block():
        if len(parts) == 1:
            z, text = parts.pop()
            text = " ".join(text.split())
            if text:
                out.append(Block(z, text))
            return
        for z in sorted({z for z, _ in parts}):
            text = " ".join("".join(t for y, t in parts if y == z).split())
            if text:
                out.append(Block(z, text))
        parts.clear()

    def pop_to(i):
        nonlocal zone
        zone = stack[i][1]
        del stack[i:]

    def above(names, stop=frozenset(), through=None):
        """The index of the innermost open element among ``names`` that no element of ``stop``, nor one outside ``through``, hides."""
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                return i
            if stack[i][0] in stop or (through is not None and stack[i][0] not in through):
                return None
        return None

    at = 0
    while at < len(markup):
        m = _MARKUP.search(markup, at)
        start, end = m.span() if m else (len(markup), len(markup))
        if start > at:
            text = markup[at:start]
            parts.append((zone, unescape(text) if "&" in text else text))
        if m is None:
            break
        at = end
        closing, name, attributes = m.groups()
        if not name:
            continue
        name = name.lower()
        if name == "br":
            parts.append((zone, " "))
            continue
        inline = name in INLINE
        if parts and not inline:
            end_block()
        if closing:
            if stack and stack[-1][0] == name:
                zone = stack.pop()[1]
            elif (i := above({name}, through=INLINE) if inline else above({name})) is not None:
                pop_to(i)
            continue
        if stack and stack[-1][0] == "head" and name not in HEAD:
            pop_to(len(stack) - 1)
        if stack and name in AFTER_P and ((top := stack[-1][0]) == "p" or top in INLINE) and (i := above({"p"}, through=INLINE)) is not None:
            pop_to(i)
        if name in ENDS and (i := above(ENDS[name][0], ENDS[name][1])) is not None:
            pop_to(i)
        if name in RAW:
            end = RAW[name].search(markup, at)
            at = end.start() if end else len(markup)
        if name in VOID or attributes.endswith("/") and name in ("svg", "path", "math"):
            continue
        inner = _zone(zone, name, attributes)
        if not inline or inner != zone:
            stack.append((name, zone))
            zone = inner
    end_block()
    return out


def level(blocks: list[Block]) -> int:
    """The best zone that has text."""
    return max((b.zone for b in blocks), default=GONE)


@lru_cache(1 << 16)
def _token(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


MARK = _token("\n")


class Streams(NamedTuple):
    """Tokens of all that pages say, articles and removed elements included: a mark and the words of each block, page after page."""

    tokens: np.ndarray
    of: np.ndarray  # the block of each token, numbered through all pages
    first: np.ndarray  # page i is tokens[first[i]:first[i + 1]]


def streams(pages: list[list[Block]]) -> Streams:
    texts = [b.text.encode("utf-8", "surrogatepass") for page in pages for b in page]
    found = words(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), lower=False)
    size = np.diff(found.first) + 1
    mark = np.cumsum(size) - size
    tokens = np.full(size.sum(), MARK, np.uint64)
    tokens[np.delete(np.arange(len(tokens)), mark)] = found.hash
    return Streams(tokens, np.repeat(np.arange(len(texts)), size), np.append(mark, len(tokens))[np.cumsum([0, *map(len, pages)])])


def stream(blocks: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """A page's tokens, and the block of each."""
    return streams([blocks])[:2]


def ranks(tokens: list[int] | np.ndarray, long: int = LONG) -> np.ndarray:
    """Fingerprints of the first ``long`` tokens of every suffix that has as many, by doubling."""
    h, n = np.array(tokens, np.uint64), 1
    while n < long and len(h) > n:
        with np.errstate(over="ignore"):
            h = mix(h[:-n] * np.uint64(0x9E3779B97F4A7C15) + (h[n:] ^ np.uint64(n)))
        n *= 2
    return h if n == long else h[:0]


def anchors(s: Streams, hosts: list[str], long: int = LONG) -> tuple[np.ndarray, np.ndarray]:
    """Of every suffix of ``long`` tokens or more its place and the smallest fingerprint of half as many tokens inside the first ``long``: runs of a host that are equal have equal ones, and neighbours mostly share theirs."""
    half = long // 2
    own = np.repeat(np.array([_token(x) for x in hosts], np.uint64), np.diff(s.first))
    ends = np.repeat(s.first[1:], np.diff(s.first))
    place = np.flatnonzero(np.arange(len(ends)) + long <= ends)
    h = ranks(s.tokens, half)
    h = mix(h ^ own[: len(h)])
    low = h[: max(len(h) - half, 0)].copy()
    for i in range(1, half + 1):
        np.minimum(low, h[i : i + len(low)], out=low)
    return place, low[place]


def _leads(anchor: np.ndarray) -> np.ndarray:
    """Where neighbours don't share an anchor."""
    out = np.ones(len(anchor), bool)
    out[1:] = anchor[1:] != anchor[:-1]
    return out


def _parsed(batches, columns: int):
    """Pages of some GROUP characters at a time: the values of the first columns as lists, the blocks, and the batch with the place of the first in it."""
    for b in batches:
        given = [b.column(i).to_pylist() for i in range(columns)]
        markup, i = b.column(b.num_columns - 1), 0
        ends = np.cumsum(pc.fill_null(pc.binary_length(markup), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        while i < len(ends):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + GROUP, "right")))
            yield [x[i:j] for x in given], [read_blocks(x) for x in markup.slice(i, j - i).to_pylist()], b, i
            i = j


def _anchors(long: int, buckets: int):
    """Anchors by bucket, each once a page; of those that are frequent in a task two go on."""

    def run(batches):
        def of_pages():
            seen = set()  # latest pages: a copy adds nothing
            for (hosts, contents), found, _, _ in _parsed(batches, 2):
                fresh = [i for i, x in enumerate(zip(hosts, contents)) if not (x in seen or seen.add(x))]
                if len(seen) > HELD:
                    seen.clear()
                s = streams([found[i] for i in fresh])
                place, anchor = anchors(s, [hosts[i] for i in fresh], long)
                cut = np.searchsorted(place, s.first)
                for i, j in zip(cut[:-1], cut[1:]):
                    one = anchor[i:j]
                    yield np.unique(one[_leads(one)])

        yield from twice_at_most(of_pages(), buckets)

    return run


def _suffixes(long: int, shared: Test):
    """Suffixes whose anchors pass; what passes wrongly is dropped when equal ones are brought together."""

    def run(batches):
        for (hosts, contents), found, b, first in _parsed(batches, 2):
            s = streams(found)
            place, anchor = anchors(s, hosts, long)
            lead = _leads(anchor)
            place = place[shared(anchor[lead].view(np.int64))[np.cumsum(lead) - 1]] if len(place) else place
            page = np.searchsorted(s.first, place, "right") - 1
            host = np.array([_token(x) for x in hosts], np.uint64)
            rank = mix(ranks(s.tokens, long)[place] ^ host[page])
            best = [level(x) for x in found]
            own = np.array([x.zone == z and z != GONE for x_, z in zip(found, best) for x in x_], bool)[s.of]
            before = np.concatenate([[0], np.cumsum(own)])
            asked = before[place + long] > before[place]  # some token of the run is of a block that the host decides on
            key = b.column(2).take(pa.array(first + page, mask=~asked))
            yield pa.RecordBatch.from_arrays([signed(rank), pa.array(np.array(contents, np.int64)[page]), key, pa.array(place - s.first[page], pa.int32())], ["rank", "content", "key", "place"])

    return run


def main_blocks(blocks: list[Block], own: int, places: list[int] | None, long: int = LONG) -> tuple[list[str], int]:
    """Texts of the blocks that stay, and how many went because the host repeats them at ``places`` of the stream; ``own``, the page's fingerprint, decides nothing.

    Of blocks that are repeated those of an article are held against the markup, which vouches for them.
    """
    best = level(blocks)
    if best == GONE:
        return [], 0
    kept = [i for i, b in enumerate(blocks) if b.zone == best]
    if places:
        size = np.array([b.text.count(" ") + 1 for b in blocks])
        block = np.repeat(np.arange(len(blocks)), size + 1)
        covered = np.zeros(len(block) + 1, np.int64)
        np.add.at(covered, places, 1)
        np.add.at(covered, np.asarray(places) + long, -1)
        first = np.concatenate([[True], block[1:] != block[:-1]])  # the mark
        hit = np.bincount(block[~first & (np.cumsum(covered)[:-1] > 0)], minlength=len(blocks))
        unique = [i for i in kept if 2 * hit[i] <= size[i] or blocks[i].zone == ARTICLE]
        if COPY * sum(size[i] for i in unique) >= sum(size[i] for i in kept):
            return [blocks[i].text for i in unique], len(kept) - len(unique)
    return [blocks[i].text for i in kept], 0


TEXTS = "page_id long, url string, text string, n_chars long, n_blocks int, n_repeated int"


def _texts(long: int):
    def run(batches):
        for b in batches:
            rows = [main_blocks(read_blocks(markup), content & 0xFFFFFFFFFFFFFFFF, places, long) for markup, content, places in zip(*(c.to_pylist() for c in b.columns[2:]))]
            text = ["\n".join(blocks) for blocks, _ in rows]
            numbers = [pa.array([len(t) for t in text], pa.int64()), pa.array([len(blocks) for blocks, _ in rows], pa.int32()), pa.array([n for _, n in rows], pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), *numbers], [f.split()[0] for f in TEXTS.split(", ")])

    return run


def _repeated_places(hosted: DataFrame, long: int) -> DataFrame:
    """key and places: where the runs of a page begin that its host repeats."""
    buckets = 4 * max(8, hosted.rdd.getNumPartitions())
    twice = written(hosted.select("host", "content", "html").mapInArrow(_anchors(long, buckets), "bucket int, ranks binary").groupBy("bucket").applyInArrow(repeated, "rank long"), "host-anchors")
    shared = Bloom(twice).test()
    removed(twice)
    freed(hosted.sparkSession)
    suffixes = hosted.select("host", "content", "key", "html").mapInArrow(_suffixes(long, shared), "rank long, content long, key struct<page: long, row: long>, place int")
    suffixes = written(suffixes, "host-suffixes")  # read twice, so that pages aren't
    again = suffixes.groupBy("rank").agg(F.min("content").alias("a"), F.max("content").alias("b"), F.count("key").alias("asked")).filter("a <> b and asked > 0").select("rank")
    again = written(again, "host-again")
    freed(hosted.sparkSession)
    covered = suffixes.filter("key is not null").join(again, "rank", "left_semi").groupBy("key").agg(F.array_sort(F.collect_set("place")).alias("places"))
    places = written(covered, "host-repeats")
    removed(suffixes)
    removed(again)
    return places


def extracted(pages: DataFrame, long: int = LONG) -> DataFrame:
    """page_id, url, text, n_chars (code points), n_blocks kept and n_repeated, those that the host's other pages repeat, of every page."""
    bounded_batches(pages.sparkSession)
    markup = F.coalesce(F.col("html"), F.lit(""))
    host = F.lower(F.regexp_extract("url", r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\s]+)", 1))
    key = F.struct(F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID).cast("long")).alias("page"), F.xxhash64("url", markup).alias("row"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", markup.alias("html"), F.xxhash64(markup).alias("content"), host.alias("host"), key.alias("key"))
    found = _repeated_places(rows.filter("host <> ''"), long)  # Spark broadcasts it if it is small, else deals out both sides
    freed(pages.sparkSession)
    return rows.join(found, "key", "left").select("page_id", "url", "html", "content", "places").mapInArrow(_texts(long), TEXTS)
