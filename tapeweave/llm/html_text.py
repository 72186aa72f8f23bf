"""Main text of web pages: boilerplate by a sparse suffix array of each host, checked against the markup.

A page is a stream of tokens, the words of its text blocks in page order. Where the markup marks no article, two kinds of
suffixes are ranked within their host: those that start at content-chosen anchors (the least hash of every run of
GAP positions, so equal passages choose equal anchors), by a fingerprint of their first DEPTH tokens,
and those that start at a block of DEPTH or more tokens, by a fingerprint of the whole block. Suffixes
of one host and rank that lie on two or more different pages are a substring repeated across distinct
pages. Any repeat of at least DEPTH + GAP - 1 = 15 tokens has an anchor, neighbouring anchors of a repeat are at most
GAP apart, so what they cover has no holes and is repeated in truth; a block that is repeated whole is found at any length
from DEPTH on. Blocks covered by half go, the unique runs stay. A page without a marked article that is nearly all
repeats is the copy of another one and stays whole.

What a page marks as its article is not taken for boilerplate because another page has it too: two addresses may carry one
article, and two articles one sentence. So the suffixes at blocks of DEPTH or more tokens are also counted, exactly and over
distinct pages, marked or not: a block that MANY pages and half of the host's pages have is a notice and goes, unless the article quotes it
(blockquote) or consists of such blocks by half, for then the article itself is syndicated.

The markup is the check of the rest: a block inside a menu, header, footer, sidebar, notice, advert, form or comment
list goes, and so do two or more short blocks in a row that are links throughout.

A task tells repeats among its own pages first and hands on one suffix of each, so a rank that a third
of all pages have is one row a task.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeweave.llm.common import saved, small_batches, text_of
from tapeweave.llm.words import U, mix, power, signed, slices, split

DEPTH, GAP, COVERED = 8, 8, 0.5
NEAR = 0.8  # a page without a marked article that repeats cover so far is a copy
MANY = 10  # distinct pages, half of the host's at least, that make a block of a marked article a notice
LINK = 12  # words of a menu entry at most
PAGE, WHOLE = -1, -2  # sizes that stand for a page of a host and for a block to be counted
CHUNK = 1 << 19  # suffixes that a task compares at a time

# Fixed values of HTML: void elements, elements whose content is raw text, and elements that break a line.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe object svg math xmp noembed noframes select".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CHROME = set("nav header footer aside form menu dialog button fieldset".split())
ARTICLE = set("article main".split())
HEADINGS = "h1 h2 h3 h4 h5 h6".split()
# Elements that the start of another one closes, and where the search for them stops.
CLOSES_P = BLOCK - set("body html head caption dd dt legend li optgroup option summary tbody td tfoot th thead tr".split()) | {"dl", "ol", "ul"}
SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
FENCE = set("article aside body div footer form header main nav section table td th".split())
# Class, id and role words that mark a part of a page as no article, or as one.
OUTSIDE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|side|aside|widget|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|signup|login|search|share|sharing|social|related|recommended|comments?|respond|replies|disqus|pagination|pager|toolbar|skip|hidden|complementary|contentinfo|alert|dialog)(?=$|[\s_-])", re.I)
INSIDE = re.compile(r"(?:^|[\s_-])(?:article|articlebody|post-?content|entry-?content|main|main-?content|story|content)(?=$|[\s_-])", re.I)
TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)>?", re.S)
MARKS = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPACES = re.compile(r"\s+")
OPEN, IN, OUT, QUOTED = 0, 1, 2, 3  # what the markup says: nothing, article, no article, quotation in an article


def _mark(name: str, attributes: str) -> int:
    if name in ARTICLE:
        kind = IN
    elif name in CHROME:
        kind = OUT
    else:
        kind = OPEN
    if attributes and kind != OUT and name not in ("html", "body"):
        for key, a, b, c in MARKS.findall(attributes):
            key, value = key.lower(), a or b or c
            if key in ("class", "id", "role"):
                if OUTSIDE.search(value):
                    return OUT
                if kind == OPEN and INSIDE.search(value):
                    kind = IN
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
                return OUT
    return kind


def _inside(before: int, kind: int, name: str) -> int:
    """What an element is that is marked as kind and stands in one that is before."""
    if before == OUT or kind == OUT and not (name == "header" and before in (IN, QUOTED)):
        return OUT
    if before == IN and name == "blockquote":
        return QUOTED
    return max(before, kind)


def blocks(page: str) -> list[tuple[str, int]]:
    """The text blocks of a page in order, each with OPEN, IN, OUT or QUOTED. Any input is accepted, broken markup too."""
    out: list[tuple[str, int]] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()  # names on the stack, so that a tag that matches none costs nothing
    linked: list[bool] = []  # of each block: a short one, and a link throughout
    plain = False  # whether the block has text outside of links
    state, at, n = OPEN, 0, len(page)

    def add(part: str) -> None:
        nonlocal plain
        text.append(part)
        plain = plain or not opened["a"] and not part.isspace()

    def close() -> None:
        nonlocal plain
        if text:
            line = SPACES.sub(" ", html.unescape("".join(text))).strip()
            text.clear()
            if line:
                out.append((line, state))
                linked.append(state == OPEN and not plain and line.count(" ") < LINK and not any(opened[h] for h in HEADINGS))
            plain = False

    while at < n:
        m = TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        ended, name = (m[1] or "").lower(), (m[2] or "").lower()
        if name:
            if name == "br":
                text.append(" ")
                continue
            if name in RAW and not m[0].endswith("/>"):
                if name not in ("svg", "math", "select"):
                    end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
                else:
                    end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = end.end() if end else n
                if name != "title":
                    text.append(" ")
                continue
            if name in BLOCK:
                close()
                if name in CLOSES_P:
                    _pop(stack, opened, {"p"}, FENCE | {"button"})
                if name in SAME:
                    _pop(stack, opened, *SAME[name])
                elif name == "p":
                    _pop(stack, opened, {"p"}, FENCE)
            if name not in VOID and not m[0].endswith("/>"):
                kind = _mark(name, m[3] or "")
                before = stack[-1][1] if stack else OPEN
                stack.append((name, _inside(before, kind, name)))
                opened[name] += 1
            state = stack[-1][1] if stack else OPEN
        elif ended:
            if ended in BLOCK:
                close()
            if ended == "br":
                text.append(" ")
            elif opened[ended]:
                closed = ""
                while closed != ended:
                    closed = stack.pop()[0]
                    opened[closed] -= 1
            state = stack[-1][1] if stack else OPEN
    close()
    menu = [x and (i > 0 and linked[i - 1] or linked[i + 1 : i + 2] == [True]) for i, x in enumerate(linked)]
    if all(x or kind == OUT for x, (_, kind) in zip(menu, out, strict=True)):
        return out  # nothing but links is all that the page says
    return [(line, OUT if x else kind) for x, (line, kind) in zip(menu, out, strict=True)]


def _pop(stack: list[tuple[str, int]], opened: Counter[str], names: set[str], fence: set[str]) -> None:
    """Close the innermost open element of names, and what it holds, unless one of fence comes first."""
    if not any(opened[x] for x in names):
        return
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] in names:
            opened.subtract(x for x, _ in stack[i:])
            del stack[i:]
            return
        if stack[i][0] in fence:
            return


def main_blocks(found: list[tuple[str, int]], covered: list[float], often: set[int] = frozenset()) -> list[str]:
    """What the article consists of, by the share of each block that repeats cover and the numbers of the blocks that many pages have."""
    sizes = [text.count(" ") + 1 for text, _ in found]
    article = sum(n for n, (_, kind) in zip(sizes, found, strict=True) if kind == IN)
    syndicated = sum(sizes[i] for i in often if found[i][1] == IN) >= COVERED * article
    unmarked = [(n, share) for n, (_, kind), share in zip(sizes, found, covered, strict=True) if kind == OPEN]
    copy = not article and sum(n * share for n, share in unmarked) >= NEAR * sum(n for n, _ in unmarked)
    stays = {
        OPEN: lambda i: copy or covered[i] < COVERED and i not in often,
        IN: lambda i: syndicated or i not in often,
        QUOTED: lambda i: True,
        OUT: lambda i: False,
    }
    out = [text for i, (text, kind) in enumerate(found) if stays[kind](i)]
    return out or [text for text, kind in found if kind == OPEN]


def anchors(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(page, position in the page, fingerprint) of the chosen suffixes of pages' token hashes; first[i]:first[i+1] are page i's."""
    sizes = np.diff(first)
    page = np.repeat(np.arange(len(sizes)), sizes)
    pad = DEPTH + GAP
    at = np.arange(len(words)) + page * pad  # pages apart, so that no window holds two
    spread = np.zeros(len(words) + (len(sizes) + 1) * pad, U)
    spread[at] = words
    code = np.zeros(len(spread) - DEPTH + 1, U)
    for t in range(DEPTH):
        code = code * U(0xD6E8FEB86659FD93) + spread[t : t + len(code)]
    whole = np.zeros(len(code), bool)
    inside = np.arange(len(words)) - first[page]
    fits = inside <= sizes[page] - DEPTH
    whole[at[fits]] = True
    code = np.where(whole, mix(code) >> U(1), U(1) << U(63))
    window = np.lib.stride_tricks.sliding_window_view(code, GAP)
    chosen = np.unique(window.argmin(1) + np.arange(len(window)))
    chosen = chosen[whole[chosen]]
    back = np.zeros(len(spread), np.int64)
    back[at] = np.arange(len(words))
    word = back[chosen]
    return page[word], inside[word], code[chosen]


def whole_blocks(words: np.ndarray, page: np.ndarray, inside: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(page, position in the page, fingerprint, size) of blocks of at least DEPTH tokens; words are the blocks' token hashes, one block after another."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    base, inverse = power(len(words))
    prefix = np.concatenate([np.zeros(1, U), np.cumsum(words * base[: len(words)])])
    long = np.flatnonzero(sizes >= DEPTH)
    code = mix((prefix[ends[long + 1]] - prefix[ends[long]]) * inverse[ends[long]] + sizes[long].astype(U))
    return page[long], inside[long], code, sizes[long]


def coverage(sizes: list[int], spots: list[tuple[int, int]]) -> list[float]:
    """Share of each block's tokens that repeated suffixes, (place, size or 0 for an anchor), cover."""
    ends = np.cumsum([0, *sizes])
    mask = np.zeros(ends[-1], bool)
    for at, size in spots:
        mask[at : at + (size or DEPTH)] = True
    return [float(mask[a:b].mean()) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def decided(found: list[tuple[str, int]], spots: list[dict]) -> list[str]:
    """The article of a page whose suffixes at spots (at, size, pages) are repeated."""
    outer = [i for i, (_, kind) in enumerate(found) if kind in (OPEN, OUT)]
    covered = [0.0] * len(found)
    for i, share in zip(outer, coverage([found[i][0].count(" ") + 1 for i in outer], [(x["at"], x["size"]) for x in spots if x["size"] >= 0]), strict=True):
        covered[i] = share
    host = max((x["pages"] for x in spots if x["size"] == PAGE), default=0)
    return main_blocks(found, covered, {x["at"] for x in spots if x["size"] == WHOLE and x["pages"] >= max(MANY, COVERED * host)})


def _packed(found: list[tuple[str, int]]) -> bytes:
    return zlib.compress("\n".join(f"{kind}{text}" for text, kind in found).encode(), 1)


def _unpacked(data: bytes) -> list[tuple[str, int]]:
    whole = zlib.decompress(data).decode()
    return [(line[1:], int(line[0])) for line in whole.split("\n")] if whole else []


def compared(rank: np.ndarray, row: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """A chunk's suffixes: p, row, at, size, known. A rank that two pages of the chunk have is known as a repeat, and only its first suffix goes by rank."""
    order = np.lexsort((at, row, rank, size < 0))
    rank, row, at, size = rank[order], row[order], at[order], size[order]
    fresh = np.concatenate([[True], (rank[1:] != rank[:-1]) | ((size[1:] < 0) & (size[:-1] >= 0))])
    starts, group = np.flatnonzero(fresh), np.cumsum(fresh) - 1
    known = (np.minimum.reduceat(row, starts) != np.maximum.reduceat(row, starts))[group]
    known &= size >= 0
    p = np.where(known & ~fresh, signed(mix(rank.view(U) ^ mix(row.view(U) + at.astype(U)))), rank)
    back = np.lexsort((at, row))  # suffixes of one page together, which compresses better
    return pa.record_batch([pa.array(x[back]) for x in (p, row, at.astype(np.int32), size.astype(np.int32), known)], ["p", "row", "at", "size", "known"])


def suffixes(pages: DataFrame) -> DataFrame:
    """p (fingerprint of host and of the suffix's tokens, or of row and place where known), row, at, size, known.

    size is the tokens of a whole block, or 0 for an anchor, both of the text outside of marked articles, at being their
    place in it; WHOLE for any block to be counted, at being its number in the page; PAGE for the page itself, by its host.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            for start, n, data, offsets in slices(batch["html"]):
                raw = data.tobytes()
                found = [blocks(raw[a:b].decode()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                row, host = (batch[c].slice(start, n).to_numpy() for c in ("row", "host"))
                host = host.view(U)
                every = np.arange(n)
                parts = [(mix(host ^ U(0x9E37)), row, every * 0, every * 0 + PAGE)]
                for kinds in ((OPEN, OUT), (OPEN, OUT, IN, QUOTED)):
                    texts = [[(i, t) for i, (t, kind) in enumerate(page) if kind in kinds] for page in found]
                    joined = [" ".join(t for _, t in page).encode() for page in texts]
                    w = split(np.frombuffer(b"".join(joined), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in joined])]).astype(np.int64))
                    sizes = np.array([t.count(" ") + 1 for page in texts for _, t in page], np.int64)
                    owner = np.repeat(every, [len(t) for t in texts])
                    if IN in kinds:
                        page, at, code, size = whole_blocks(w.hash, owner, np.array([i for page in texts for i, _ in page], np.int64), sizes)
                        parts.append((mix(code ^ mix(host[page] ^ U(0x51ED))), row[page], at, size * 0 + WHOLE))
                    else:
                        page, at, code, size = whole_blocks(w.hash, owner, np.cumsum(sizes) - sizes - w.first[owner], sizes)
                        parts.append((mix(code ^ host[page]), row[page], at, size))
                        page, at, code = anchors(w.hash, w.first)
                        parts.append((mix(code ^ host[page]), row[page], at, at * 0))
                p, *rest = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield signed(p), *rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for part in made(batches):
            held.append(part)
            if sum(len(x[0]) for x in held) >= CHUNK:
                yield compared(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
        if sum(len(x[0]) for x in held):
            yield compared(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return pages.select("row", "host", "html").mapInArrow(run, "p long, row long, at int, size int, known boolean")


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text (blocks joined by one newline; empty if none), n_chars.

    Null html is empty; a null or odd url is a host of its own kind. Rows of one host that agree in
    html are one page to the search for repeats, so copies take no text from each other, and come
    back as often as they went in. Pages of any length and depth are read whole; other columns are
    ignored; empty input gives no rows.
    """
    small_batches(pages.sparkSession)
    host = F.xxhash64(F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit("")))
    rows = pages.select("page_id", "url", text_of("html").alias("html"))
    rows = rows.withColumn("host", host).withColumn("row", F.xxhash64("host", "html"))
    w = Window.partitionBy("p")
    found = saved(suffixes(rows))
    outer = found.where("size >= 0").withColumns({"known": F.max("known").over(w), "low": F.min("row").over(w), "high": F.max("row").over(w)}).where("known or low <> high")
    counted = found.where("size < 0").select("p", "row", "at", "size")
    pages_with = counted.groupBy("p", "size").agg(F.countDistinct("row").alias("pages")).where(F.col("pages") >= MANY)
    repeats = outer.select("row", "at", "size", F.lit(2).cast("long").alias("pages")).unionByName(counted.join(pages_with, ["p", "size"]).drop("p"))
    spots = repeats.groupBy("row").agg(F.collect_set(F.struct("at", "size", "pages")).alias("spots"))

    kind = pages.schema["page_id"].dataType.simpleString()
    names = ["page_id", "url", "row", "parts"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_packed(blocks(page.as_py())) for page in batch["html"]]
            yield pa.record_batch([*(batch[c] for c in names[:3]), pa.array(parts, pa.binary())], names)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for parts, at in zip(batch["parts"], batch["spots"].to_pylist(), strict=True):
                texts.append("\n".join(decided(_unpacked(parts.as_py()), at or [])))
            yield pa.record_batch([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    parsed = rows.select("page_id", "url", "row", "html").mapInArrow(parse, f"page_id {kind}, url string, row long, parts binary")
    return parsed.join(spots, "row", "left").select("page_id", "url", "parts", "spots").mapInArrow(choose, f"page_id {kind}, url string, text string, n_chars long")
