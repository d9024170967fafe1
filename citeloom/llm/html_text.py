"""Main text of web pages: marked regions, and repeats across the pages of a host.

A page is read into blocks (runs of text between block-level tags). Elements that mark menus, headers, footers,
sidebars, notices, adverts, forms and comments take their blocks with them. Attributes are read one by one and count by
their whole names. The blocks of a page are a token stream; every run of ``LONG`` tokens that a different page of the
host holds too covers its tokens.

Where half of the tokens of a page or more stand in ``main`` or in an ``article``, the text is sought there: passages that repeat
inside articles are content, while repeats around them, and all repeats on other pages, are boilerplate. Blocks that are
mostly covered go, and the unique runs are the text.

Repeats are found over the whole host, among pages of which no two are equal. The anchors of a page (the least of the short grams
in each run) travel as sorted codes of 44 bits, four bytes each, and those that stand on two pages become a bitmap. Runs whose anchor
it holds are then hashed whole and compared; a code or bit that is set by chance costs such a comparison and changes nothing.
So neither batches nor table sizes change a text, and a hot host is dealt out by its runs. Runs count as equal if 96 bits of two independent
hashes of their tokens and host are, pages if 128 bits of theirs. ``covered_tokens`` is the same for
streams in memory, by suffixes sorted with prefix doubling.

Edge cases: null or empty html gives an empty text. Null URLs share one host. Unclosed tags end with their
parents; unclosed comments and scripts run to the end; a tag that never ends is text. Reading a page takes time in
proportion to its length, also for very long ones, deep nesting and unclosed markup. Repeated rows are pages of their own, except that equal pages
do not count as distinct when repeats are sought. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.common import small_batches
from citeloom.llm.url_filter import host_and_path
from citeloom.session import materialize

LONG, GRAM = 8, 4
BROADCAST_ROWS = 2_000_000
VERDICT_BYTES = 64 * 1024 * 1024
CODE_BITS, VALUE_BITS = 44, 32  # of an anchor, and of these within its bucket
HELD_CODES, HELD_RUNS = 2_000_000, 500_000  # anchors and runs that a task sorts at once
BITS_PER_ANCHOR, MOST_WIDTH = 64, 30  # of the bitmap; its largest form has 2**30 bits, 128 MB
ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

# Element names and class words of the HTML vocabulary.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot"
    " th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "select", "iframe", "object", "svg", "canvas", "xmp", "title")
DROPPED = frozenset("nav aside footer form dialog menu head button".split())
CLOSES_P = BLOCKS - {"body", "html", "head", "title", "caption", "legend", "li", "td", "th", "tr", "tbody", "thead", "tfoot"}
DROPPED_WORDS = frozenset(
    "ad ads adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie"
    " cookies copyright disqus gdpr menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted"
    " related respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
COMPOUNDS = frozenset(
    "ad-banner ad-container ad-slot ad-unit ad-wrapper comment-list comments-area cookie-banner cookie-consent cookie-notice cookie-bar nav-bar"
    " nav-menu main-menu main-nav main-navigation site-nav page-nav post-nav post-navigation side-bar site-footer site-header page-footer"
    " page-header related-articles related-links related-posts share-buttons share-links social-links social-share skip-link"
    " newsletter-signup sponsored-content user-comments".split()
)
PAGE_WORDS = frozenset(("header", "footer", "masthead"))  # only outside of the article
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[>\"']")
LONGEST_TAG = 65_536  # characters that are searched for the end of a tag with attention to quotes
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
RAW_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}


def _attributes(text: str) -> list[tuple[str, str]]:
    """Names and values in lower case. Every match takes a whole value, so no name is sought inside of one."""
    return [(key.lower(), "".join(values).lower()) for key, *values in ATTRIBUTE.findall(text)] if text else []


def _is_dropped(name: str, attributes: list[tuple[str, str]], in_article: bool) -> bool:
    if name in DROPPED or name == "header" and not in_article:
        return True
    for key, value in attributes:
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in DROPPED_ROLES:
            return True
        if key in ("class", "id"):
            words = set(value.split())
            if words & DROPPED_WORDS or not in_article and words & PAGE_WORDS or not words.isdisjoint(COMPOUNDS):
                return True
    return False


class Tags:
    """The tags of a page one after the other. What does not lie ahead any more is remembered, so unclosed markup is not searched twice."""

    def __init__(self, page: str):
        self.page = page
        self.last = {mark: page.rfind(mark) for mark in ('>', '"', "'", "-->")}
        self.careless = 0

    def _end(self, at: int) -> int:
        """The place of the > that ends a tag whose attributes begin at ``at``; -1 if there is none."""
        if at > self.last[">"]:
            return -1
        place = at
        while self.careless < 16 and place - at < LONGEST_TAG:
            stop = STOP.search(self.page, place)
            if stop is None:
                break
            if stop[0] == ">":
                return stop.start()
            if stop.start() >= self.last[stop[0]]:
                break  # a quotation mark without a second one
            place = self.page.find(stop[0], stop.end()) + 1
        self.careless += 1
        return self.page.find(">", at)

    def next(self, at: int) -> tuple[int, int, str, str, bool] | None:
        """(start, end, name, attributes, closes) of the next tag from ``at`` on. Comments and declarations have no name."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            at = start + 1
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4) if start + 4 <= self.last["-->"] else -1
                return start, end + 3 if end >= 0 else len(page), "", "", False
            if page[at : at + 1] in ("!", "?"):
                end = page.find(">", at) if at <= self.last[">"] else -1
                return start, end + 1 if end >= 0 else len(page), "", "", False
            closes = page[at : at + 1] == "/"
            name = NAME.match(page, at + closes)
            if name is None:
                continue
            end = self._end(name.end())
            if end >= 0:
                return start, end + 1, name[0].lower(), page[name.end() : end], closes
            return None  # no tag ends any more
        return None


class Open:
    """The open elements, with the places of each name and of the blocks among them."""

    def __init__(self):
        self.stack: list[tuple[str, bool, int]] = []  # name, dropped, region
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, name: str, dropped: bool, region: int) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        if name in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append((name, dropped, region))

    def cut(self, depth: int) -> None:
        while len(self.stack) > depth:
            name = self.stack.pop()[0]
            self.places[name].pop()
            if name in BLOCKS:
                self.blocks.pop()

    def place(self, name: str) -> int | None:
        found = self.places.get(name)
        return found[-1] if found else None

    def open_p(self) -> int | None:
        """A paragraph in which no other block is open."""
        return self.blocks[-1] if self.blocks and self.stack[self.blocks[-1]][0] == "p" else None

    def state(self) -> tuple[bool, int]:
        return self.stack[-1][1:] if self.stack else (False, 0)


def blocks(page: str | None) -> list[tuple[str, int]]:
    """(text, region) of every block that no marked element drops. Region: 2 in an article, 1 in main, 0 elsewhere."""
    page = page or ""
    found: list[tuple[str, int]] = []
    tags, opened = Tags(page), Open()
    run: list[str] = []
    dropped, region, at = False, 0, 0

    def close() -> None:
        text = " ".join("".join(run).split())
        if text and not dropped:
            found.append((text, region))
        run.clear()

    while at < len(page):
        tag = tags.next(at)
        if tag is None:
            run.append(html.unescape(page[at:]))
            break
        start, end, name, inside, closes = tag
        if start > at:
            run.append(html.unescape(page[at:start]))
        at = end
        if not name:
            continue
        if closes:
            depth = opened.place(name)
            if name in BLOCKS or depth is not None and opened.stack[depth][1]:
                close()
            if depth is not None:
                opened.cut(depth)
                dropped, region = opened.state()
            continue
        if name in RAW:
            ended = RAW_END[name].search(page, at)
            at = ended.end() if ended else len(page)
            continue
        if name == "br":
            run.append(" ")
        if name in BLOCKS or name == "button":
            close()
            if name in CLOSES_P and (depth := opened.open_p()) is not None:
                opened.cut(depth)
            if name in ("li", "dt", "dd", "tr", "td", "th") and opened.stack and opened.stack[-1][0] == name:
                opened.cut(len(opened.stack) - 1)
            dropped, region = opened.state()
        if name in VOID or inside.endswith("/"):
            continue
        attributes = _attributes(inside)
        drops = dropped or _is_dropped(name, attributes, region > 0)
        if drops and not dropped:
            close()
        dropped = drops
        region = 2 if name == "article" else max(region, 1) if name == "main" or ("role", "main") in attributes else region
        opened.push(name, dropped, region)
    close()
    return found


def covered_tokens(streams: list[list[str]], long: int = LONG) -> list[np.ndarray]:
    """For each token of each stream: whether it lies in a run of ``long`` tokens that another stream holds too."""
    numbers: dict[str, int] = {}
    flat = [numbers.setdefault(token, len(numbers)) for stream in streams for token in [*stream, "\0end"]]
    sizes = np.array([len(s) + 1 for s in streams])
    ends = np.cumsum(sizes) - 1
    rank = np.array(flat, np.int64)
    owner = np.repeat(np.arange(len(streams)), sizes)
    rank[ends] = len(numbers) + np.arange(len(streams))  # every separator is unlike all others
    covered, length, n = np.zeros(len(rank), bool), 1, len(rank)
    while length < long:  # rank orders the suffixes by their first ``length`` tokens
        step = min(length, long - length)
        after = np.concatenate((rank[step:], np.full(min(step, n), -1)))[:n]
        rank = np.unique(rank * (n + len(numbers) + len(streams) + 1) + after + 1, return_inverse=True)[1]
        length += step
    order = np.argsort(rank, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], np.diff(rank[order]) != 0)))
    least, most = np.minimum.reduceat(owner[order], starts), np.maximum.reduceat(owner[order], starts)
    groups = np.repeat(least != most, np.diff(np.append(starts, n)))
    hits = order[groups]
    depth = np.zeros(n + long + 1, np.int64)
    np.add.at(depth, hits, 1)
    np.add.at(depth, hits + long, -1)
    covered = np.cumsum(depth)[:n] > 0
    return [covered[end - size + 1 : end] for end, size in zip(ends, sizes, strict=True)]


def kept_blocks(sizes: list[int], regions: list[int], flags: np.ndarray) -> list[bool]:
    """Which blocks are text: those of ``main``, else of the articles, if half of the tokens or more stand there; what a repeat
    covers goes, unless it stands in an article, or in a ``main`` without one. Without such a region, the blocks that are not
    mostly covered."""
    marked = 2 * sum(n for n, region in zip(sizes, regions, strict=True) if region) >= sum(sizes) > 0
    content = max(regions, default=0)  # where repeats are content
    kept, at = [], 0
    for n, region in zip(sizes, regions, strict=True):
        share, at = flags[at : at + n].mean(), at + n
        kept.append(bool(marked and region and region == content or (region or not marked) and share < 0.5))
    return kept


def kept_text(found: list[tuple[str, int]], flags: np.ndarray) -> str:
    kept = kept_blocks([text.count(" ") + 1 for text, _ in found], [region for _, region in found], flags)
    return "\n".join(text for (text, _), keep in zip(found, kept, strict=True) if keep)


def main_texts(pages: list[str | None], context: int = 0) -> list[tuple[str, int, int]]:
    """(text, tokens, covered tokens) of each page after the first ``context`` ones, for the pages of one host in memory."""
    parsed = [blocks(page) for page in pages]
    first: dict[str, int] = {}
    for at, page in enumerate(pages):
        first.setdefault(page or "", at)
    alone = sorted(first.values())  # equal pages are one page
    streams = [[token for text, _ in parsed[at] for token in text.split(" ")] for at in alone]
    covered = dict(zip(alone, covered_tokens(streams), strict=True)) if alone else {}
    out = []
    for page, found in list(zip(pages, parsed, strict=True))[context:]:
        flags = covered[first[page or ""]]
        out.append((kept_text(found, flags), len(flags), int(flags.sum())))
    return out


def _mixed(parts: list[np.ndarray], odd: int) -> np.ndarray:
    out = np.zeros(len(parts[0]), np.uint64)
    for part in parts:
        out = (out ^ part) * np.uint64(odd)
        out ^= out >> np.uint64(31)
    return out


class _Tokens:
    """The tokens of a batch of pages in one array, and what runs over them hash to, always with the host.

    The anchor of a run of ``long`` tokens is the ``gram`` tokens inside it with the least hash, so equal runs have equal
    anchors, and neighbouring runs mostly share one.
    """

    def __init__(self, frame: pd.DataFrame, long: int, gram: int):
        streams = [text.replace("\n", " ").split(" ") if text else [] for text in frame["texts"]]
        sizes = np.array([len(s) for s in streams], np.int64)
        self.codes, self.names = pd.factorize(np.array([token for stream in streams for token in stream], object))
        self.owner = np.repeat(np.arange(len(streams)), sizes)
        self.at = np.arange(len(self.codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.starts = np.flatnonzero(self.at + long <= sizes[self.owner])
        self.hosts, self.rows, self.long = frame["host"].to_numpy(object), frame["row"].to_numpy(np.int64), long
        self.hashed: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        whole = np.arange(max(0, len(self.codes) - gram + 1))
        grams = self._hash(whole, gram, "repeats of a pag", ODD[0])
        least = grams[self.starts] if len(self.starts) else np.zeros(0, np.uint64)
        for i in range(1, long - gram + 1):
            least = np.minimum(least, grams[self.starts + i])
        self.anchors = (least & np.uint64(2**CODE_BITS - 1)).view(np.int64)  # the low bits of a least hash are spread evenly

    def _hash(self, starts: np.ndarray, width: int, key: str, odd: int) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.uint64)
        if key not in self.hashed:
            names = pd.util.hash_array(np.asarray(self.names, object), hash_key=key, categorize=False)
            self.hashed[key] = names[self.codes], pd.util.hash_array(self.hosts, hash_key=key)[self.owner]
        tokens, host = self.hashed[key]
        return _mixed([host[starts], *(tokens[starts + i] for i in range(width))], odd)

    def page_anchors(self) -> np.ndarray:
        """The distinct anchors of each page, one page after the other."""
        owner = self.owner[self.starts]
        new = np.ones(len(owner), bool)
        new[1:] = (self.anchors[1:] != self.anchors[:-1]) | (owner[1:] != owner[:-1])
        owner, anchors = owner[new], self.anchors[new]
        order = np.lexsort((anchors, owner))
        owner, anchors = owner[order], anchors[order]
        new = np.ones(len(owner), bool)
        new[1:] = (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])
        return anchors[new]

    def runs(self, wanted: np.ndarray) -> pd.DataFrame:
        """(h, g, row, at) of the runs that are wanted."""
        starts = self.starts[wanted]
        h = self._hash(starts, self.long, "repeats of a pag", ODD[0]).view(np.int64)
        g = self._hash(starts, self.long, "e across a host.", ODD[1]).astype(np.uint32).view(np.int32)
        return pd.DataFrame({"h": h, "g": g, "row": self.rows[self.owner[starts]], "at": self.at[starts].astype(np.int32)})


def _packed(pages: list[np.ndarray]) -> pd.DataFrame:
    """(bucket, codes): anchors of many pages by their high bits, sorted; one that stands on several pages comes twice."""
    anchors = np.sort(np.concatenate(pages))
    kept = np.ones(len(anchors), bool)
    kept[2:] = anchors[2:] != anchors[:-2]
    anchors = anchors[kept]
    bucket = anchors >> VALUE_BITS
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    codes = (anchors & (2**VALUE_BITS - 1)).astype(np.uint32).view(np.int32)
    return pd.DataFrame({"bucket": bucket[np.concatenate(([0], cuts))].astype(np.int32), "codes": np.split(codes, cuts)})


def _met(found: list[pd.DataFrame]) -> pd.DataFrame:
    """(h, g, row, at, sure) of the runs of many pages. Those that stand on several of these are sure: one place keeps the hashes, for pages
    elsewhere, the others take keys of their own, so that no place of a hot run but one per batch meets the others."""
    runs = pd.concat(found, ignore_index=True)
    order = np.argsort(runs["h"].to_numpy(), kind="stable")
    h, g, row = (runs[name].to_numpy()[order] for name in ("h", "g", "row"))
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    starts = np.flatnonzero(first)
    on_two = np.minimum.reduceat(row, starts) != np.maximum.reduceat(row, starts)
    sure = np.repeat(on_two, np.diff(np.append(starts, len(h))))
    free = np.zeros(len(h), bool)
    free[order] = sure & ~first
    runs["sure"] = False
    runs.loc[order[sure], "sure"] = True
    runs["h"] = runs["h"].mask(free, runs["row"])
    runs["g"] = runs["g"].mask(free, runs["at"])
    return runs


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast only what was counted; a larger side is shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _bitmap(anchors: DataFrame, most_width: int) -> np.ndarray:
    """Bits at the two places of every anchor. Its size follows their number up to 2**most_width bits; a fuller one holds more by chance."""
    width = min(most_width, max(15, (BITS_PER_ANCHOR * anchors.count()).bit_length()))
    places = F.array(F.col("anchor").bitwiseAND(F.lit(2**width - 1)), F.shiftright("anchor", CODE_BITS - width))
    placed = anchors.select(F.explode(places).alias("place")).select(F.shiftright("place", 15).alias("part"), F.col("place").bitwiseAND(F.lit(2**15 - 1)).alias("bit"))
    parts = placed.repartition("part").groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).toArrow()
    bitmap = np.zeros((2**width >> 15, 4096), np.uint8)
    for part, bits in zip(parts.column("part").to_pylist(), parts.column("bits"), strict=True):
        bitmap[part] = np.frombuffer(bits.as_buffer(), np.uint8)
    return bitmap.reshape(-1)


def _held(bitmap: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Whether both places of each anchor are set."""
    width = (8 * len(bitmap)).bit_length() - 1
    is_set = lambda at: (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return is_set(anchors & (2**width - 1)) & is_set(anchors >> (CODE_BITS - width))


def covered_starts(pages: DataFrame, long: int = LONG, gram: int = GRAM, most_width: int = MOST_WIDTH) -> DataFrame:
    """(row, starts): where runs of ``long`` tokens start that another one of the pages (row, host, texts) of the host holds too.

    First only anchors move, one per page and anchor, about four for ten tokens. Runs whose anchor stands on one page have no equal
    on another one; the rest are compared by both hashes.
    """
    spark = pages.sparkSession

    def anchors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for frame in frames:
            held.append(_Tokens(frame, long, gram).page_anchors())
            size += len(held[-1])
            if size >= HELD_CODES:
                yield _packed(held)
                held, size = [], 0
        if size:
            yield _packed(held)

    def runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for frame in frames:
            tokens = _Tokens(frame, long, gram)
            held.append(tokens.runs(_held(shared.value, tokens.anchors)))
            size += len(held[-1])
            if size >= HELD_RUNS:
                yield _met(held)
                held, size = [], 0
        if size:
            yield _met(held)

    # Codes of a bucket meet in one task, so they are counted there without a further exchange.
    codes = pages.mapInPandas(anchors, "bucket int, codes array<int>").repartition("bucket").select("bucket", F.explode("codes").alias("code"))
    anchor = F.shiftleft(F.col("bucket").cast("long"), VALUE_BITS) + F.col("code").cast("long").bitwiseAND(F.lit(2**VALUE_BITS - 1))
    repeated = codes.groupBy("bucket", "code").count().where("count > 1").select(anchor.alias("anchor"))
    shared = spark.sparkContext.broadcast(_bitmap(materialize(repeated, "html-anchors"), most_width))
    candidates = pages.mapInPandas(runs, "h long, g int, row long, at int, sure boolean")
    equal = Window.partitionBy("h", "g")
    on_two = F.max("sure").over(equal) | (F.min("row").over(equal) != F.max("row").over(equal))
    found = candidates.select("row", "at", on_two.alias("two")).where("two")
    return found.groupBy("row").agg(F.collect_list("at").alias("starts"))


def _copies(parsed: DataFrame, broadcast_rows: int) -> DataFrame:
    """(row, first) of the pages that equal an earlier one of their host."""
    keys = parsed.select("row", "d", "e")
    twins = materialize(keys.groupBy("d", "e").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "html-twins")
    return materialize(keys.join(_bounded(twins, broadcast_rows), ["d", "e"]).where("row != first").select("row", "first"), "html-copies")


def extract(
    pages: DataFrame, id_col: str = "page_id", url: str = "url", page: str = "html", broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """(id, url, text, n_chars, n_tokens, n_covered) of every page."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [blocks(text) for text in frame.pop("html")]
            # Blocks hold no line breaks.
            frame["texts"] = ["\n".join(text for text, _ in b) for b in found]
            frame["sizes"] = [[text.count(" ") + 1 for text, _ in b] for b in found]
            frame["regions"] = ["".join(str(region) for _, region in b) for b in found]
            yield frame

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row, sizes, regions, starts in frame.itertuples(index=False, name=None):
                depth = np.zeros(int(sum(sizes)) + 1, np.int64)
                starts = np.asarray(starts, np.int64)
                np.add.at(depth, starts, 1)
                np.add.at(depth, starts + LONG, -1)
                flags = np.cumsum(depth)[:-1] > 0
                kept = kept_blocks([int(n) for n in sizes], [int(r) for r in regions], flags)
                rows.append((row, int(flags.sum()), "".join("01"[k] for k in kept)))
            yield pd.DataFrame(rows, columns=["row", "n_covered", "kept"])

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, link, texts, regions, n_covered, kept in frame.itertuples(index=False, name=None):
                parts = texts.split("\n") if texts else []
                sizes = [text.count(" ") + 1 for text in parts]
                if kept is None:  # nothing is covered
                    keep = kept_blocks(sizes, [int(r) for r in regions], np.zeros(sum(sizes), bool))
                else:
                    keep = [k == "1" for k in kept]
                text = "\n".join(t for t, k in zip(parts, keep, strict=True) if k)
                rows.append((i, link, text, len(text), sum(sizes), 0 if kept is None else int(n_covered)))
            yield pd.DataFrame(rows, columns=["id", "url", "text", "n_chars", "n_tokens", "n_covered"])

    small_batches(pages.sparkSession)
    host, _ = host_and_path(F.col(url))
    whole = F.coalesce(page, F.lit(""))
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(url).alias("url"), host.alias("host"),
        F.xxhash64(host, whole).alias("d"), F.xxhash64(whole, host).alias("e"), F.col(page).alias("html"),
    )
    schema = f"row long, id {kind}, url string, host string, d long, e long, texts string, sizes array<int>, regions string"
    parsed = materialize(rows.mapInPandas(parse, schema), "html-blocks")
    copies = _copies(parsed, broadcast_rows)
    alone = parsed.select("row", "host", "texts").join(_bounded(copies.select("row"), broadcast_rows), "row", "left_anti")
    # Verdicts need sizes and regions of blocks, not their texts; they are one short row per page with a repeat.
    light = parsed.select("row", "sizes", "regions").join(covered_starts(alone), "row")
    judged = materialize(light.select("row", "sizes", "regions", "starts").mapInPandas(judge, "row long, n_covered long, kept string"), "html-verdicts")
    same = copies.join(judged.withColumnRenamed("row", "first"), "first").select("row", "n_covered", "kept")
    verdicts = judged.unionByName(same)
    small = (verdicts.agg(F.sum(F.length("kept") + 32)).first()[0] or 0) <= VERDICT_BYTES and broadcast_rows > 0
    placed = parsed.join(F.broadcast(verdicts) if small else verdicts, "row", "left")
    schema = f"id {kind}, url string, text string, n_chars long, n_tokens long, n_covered long"
    out = placed.select("id", "url", "texts", "regions", "n_covered", "kept").mapInPandas(finish, schema)
    return out.withColumnsRenamed({"id": id_col})
