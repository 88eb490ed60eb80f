"""Main text of web pages, with a suffix array over the pages of a host.

Each page is cut into blocks of text. Where markup itself says what a block is
(navigation, page headers and footers, asides, forms, adverts, notices, comments,
scripts, styles), the block goes. Blocks inside an article or main element are the
main text. All that is left is open.

The token streams of a host's pages are concatenated and a suffix array (prefix
doubling up to ``MIN_REPEAT`` tokens, which is as deep as the question goes) finds
the runs of that length that stand on distinct pages; copies of a page, alike in all
tokens, are one page. In open blocks such runs are boilerplate and go; unique runs
stay. Inside an article a repeat alone says little, since two pages may well quote the
same text. There a block goes if runs cover all of it that stand on nine in ten of the
host's distinct pages with articles, of which there are ``MIN_ARTICLES`` or more: a
notice that markup does not name. An article that would lose half of its tokens or more
is a near copy of the others and stays whole.

A page with an article consists of what is left of its article blocks. A page without
one consists of the unique runs of its open blocks; ``repeated_tokens`` tells how many
went.

A host may have any number of pages, so its streams are dealt into arrays of about
``CHUNK_TOKENS`` tokens. Each array reduces its part to one row per distinct run (128
bits of it, and the least and greatest page), the rows of all arrays are grouped, and
runs on distinct pages are joined back to the pages that have them. For articles, a run
on nine in ten of a host's pages is on as many of the pages of one of its arrays at
least, so an array reports only those, with a bound for the ones that it does not; the
few that may reach nine in ten of all pages are counted page by page. How a host is
dealt thus changes no text. Hosts take part that have a page without an article or
``MIN_ARTICLES`` with one: in others the array has nothing to decide. Bitmaps spare
these the shuffle, the joins by run are exact. Common runs are one row on the one side of
that join; the other side is split by the adaptive skew join. A worker holds one array
and one page beyond it.

Results for odd input: null or empty html gives the empty text; a null url is a
host of its own; markup that is cut off ends at the end of the page; repeated rows
stay and are copies; a near copy of a page, neither with an article, loses what both
share; an empty table gives an empty table; other columns do not matter.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.llm.common import column, durable, in_bitmap, map_arrow, membership_bitmap, slices, table

#: Tokens of a run that counts as repeated.
MIN_REPEAT = 16
#: Distinct pages with articles from which on a host shows what stands in nine in ten of them.
MIN_ARTICLES = 10
#: Tokens of a suffix array, unless one page has more.
CHUNK_TOKENS = 1 << 18

# Element and attribute names.
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "template", "xmp", "noembed", "noframes", "svg", "math", "canvas", "object", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "label", "ruby", "rt", "rp", "rb"}
DROPPED = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "fieldset", "datalist"}
MAIN = {"article", "main"}
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "adbox", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup",
    "sidebar", "widget", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar", "footer", "header", "masthead", "copyright", "share", "sharing", "social", "related", "recommended", "comment", "comments", "disqus", "replies", "respond", "reviews", "login", "search",
}
#: Names of what may hold articles of its own that are none of the page.
READERS = {"comment", "comments", "disqus", "replies", "respond", "reviews"}
OTHERS = READERS | {"related", "recommended", "sidebar", "widget"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "form"}

_TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|([^<]+|<)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+")


def _says_boilerplate(tag: str, rest: str, in_main: bool) -> bool:
    if tag in DROPPED:
        return True
    if tag == "header" and not in_main:
        return True
    if not rest or rest == "/":
        return False
    for m in _ATTRIBUTE.finditer(rest):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            # camelCase and dashes part words; a word of the list counts as the whole of a name or at its either end
            for one in re.sub(r"([a-z])([A-Z])", r"\1-\2", m[2] or m[3] or m[4] or "").lower().split():
                words = _WORD.findall(one)
                if not words or tag in ("body", "html"):
                    continue
                if tag in MAIN:  # an article about such a thing is one, a reader's comment is none
                    if len(words) == 1 and words[0] in NAMES or words[0] in READERS:
                        return True
                elif words[0] in NAMES or words[-1] in NAMES and not (in_main and words[-1] == "header"):
                    return True
        elif name == "role" and value in ROLES:
            return True
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True
    return False


def blocks(page: str) -> list[tuple[bool, str]]:
    """(inside an article?, text) of each block that markup does not rule out."""
    found: list[tuple[bool, str]] = []
    text: list[str] = []
    others = False  # may what is skipped hold articles that are none of the page?
    skipped, depth, main = "", 0, 0  # the element that is being skipped, and how often it is nested

    def flush(inside: bool) -> None:
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            if joined:
                found.append((inside, joined))
            text.clear()

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        if m is None:
            at += 1
            continue
        at = m.end()
        if m[7] is not None:
            if not depth:
                text.append(m[7])
            continue
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, rest = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in RAW and not closing:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            if not rest.endswith("/"):
                at = end.end() if end else n
            continue
        if depth:
            if tag == "body" or (tag in MAIN and not closing and not others and not _says_boilerplate(tag, rest, False)):
                depth = 0  # an element that was never closed, or that only sounds like boilerplate
            elif tag == skipped:
                depth += -1 if closing else (not rest.endswith("/"))
                continue
            else:
                continue
        if tag in INLINE:
            continue
        if tag == "br":
            text.append(" ")
            continue
        flush(main > 0)
        if closing:
            if tag in MAIN:
                main = max(0, main - 1)
        elif tag not in VOID:
            if _says_boilerplate(tag, rest, main > 0):
                if not rest.endswith("/"):
                    skipped, depth, others = tag, 1, tag in MAIN or tag in DROPPED or not OTHERS.isdisjoint(_WORD.findall(rest.lower()))
            elif tag in MAIN or re.search(r"""role\s*=\s*["']?main\b|itemprop\s*=\s*["']?articleBody\b""", rest):
                main += 1
    flush(main > 0)
    return found


def sorted_runs(streams: list[np.ndarray], least: int = MIN_REPEAT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array over streams of token numbers, of the suffixes with ``least`` tokens or more: their places in the concatenation, their streams, and where in it each distinct run begins.

    It is sorted to a depth of ``least`` by prefix doubling: suffixes of equal rank
    agree on that many tokens, and a run is whatever its neighbours in the array share.
    """
    lengths = np.array([len(s) for s in streams], dtype=np.int64)
    total = int(lengths.sum())
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(total)  # tokens from here to the end of the page
    whole = np.flatnonzero(left >= least)
    if not len(whole):
        return whole, whole, whole
    _, rank = np.unique(np.concatenate(streams), return_inverse=True)
    rank = rank.astype(np.int64)
    depth = 1
    while depth < least:
        step = min(depth, least - depth)
        after = np.full(total, -1, dtype=np.int64)
        after[: total - step] = rank[step:]
        _, rank = np.unique(rank * (total + 2) + after + 1, return_inverse=True)
        rank = rank.astype(np.int64)
        depth += step
    order = whole[np.argsort(rank[whole], kind="stable")]  # suffixes of equal rank stand by place, so by stream
    ranks = rank[order]
    return order, np.repeat(np.arange(len(streams)), lengths)[order], np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]]))


def _spread(order: np.ndarray, of: np.ndarray, starts: np.ndarray, digests: np.ndarray, is_open: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    if not len(order):
        return order, digests[:0], digests[:0], is_open[:0]
    return order[starts], np.minimum.reduceat(digests[of], starts), np.maximum.reduceat(digests[of], starts), np.logical_or.reduceat(is_open[of], starts)


def repeated_runs(streams: list[np.ndarray], digests: np.ndarray, is_open: np.ndarray, least: int = MIN_REPEAT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct runs of ``least`` tokens in streams of token numbers: a place of each in the concatenation, the least and greatest digest of its pages, and whether one of them is open.

    Pages with one digest are copies, so a run stands on distinct pages where the two
    digests differ.
    """
    return _spread(*sorted_runs(streams, least), digests, is_open)


def streams_of_runs(of: np.ndarray, starts: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """On how many of the ``counted`` streams each distinct run of ``sorted_runs`` stands."""
    if not len(of):
        return of
    first = np.concatenate([[True], of[1:] != of[:-1]])
    first[starts] = True
    return np.add.reduceat((first & counted[of]).astype(np.int64), starts)


def run_keys(host: int, tokens: np.ndarray, at: np.ndarray, least: int) -> list[np.ndarray]:
    """128 bits (two int64 arrays) for the runs of ``least`` tokens at the places ``at``; ``tokens`` has a row of two hashes per token."""
    out = []
    for half in range(2):
        state = np.full(len(at), host & (1 << 64) - 1, dtype=np.uint64)
        for k in range(least):
            state = (state ^ tokens[at + k, half]) * np.uint64(0x9E3779B97F4A7C15)
            state ^= state >> np.uint64(32)
            state *= np.uint64(0xD6E8FEB86659FD93)
            state ^= state >> np.uint64(29)
        out.append(state.view(np.int64))
    return out


def _hashes(words: Iterable[str]) -> np.ndarray:
    found = [xxhash.xxh3_128_intdigest(w.encode("utf-8", "surrogatepass")) for w in words]
    return np.array([(h >> 64, h & (1 << 64) - 1) for h in found], dtype=np.uint64).reshape(-1, 2)


def _packed(found: list[tuple[bool, str]]) -> bytes:
    """Blocks as compressed bytes. They have no line feeds, since white space in them is blanks."""
    return zstandard.ZstdCompressor(level=3).compress("\n".join(("+" if inside else "-") + text for inside, text in found).encode("utf-8", "surrogatepass"))


def _unpacked(packed: bytes) -> list[tuple[bool, str]]:
    text = zstandard.ZstdDecompressor().decompress(packed).decode("utf-8", "surrogatepass")
    return [(line[0] == "+", line[1:]) for line in text.split("\n")] if text else []


def _words(packed: bytes) -> list[str]:
    return [w for _, text in _unpacked(packed) for w in text.split(" ")]


def _texts(batch: pa.RecordBatch, texts: list[str], removed: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [column(batch, "page_id"), column(batch, "url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64())], ["page_id", "url", "text", "n_chars", "repeated_tokens"]
    )


TEXTS = "page_id long, url string, text string, n_chars long, repeated_tokens long"


def extract(pages: DataFrame, least: int = MIN_REPEAT, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """page_id, url, text, n_chars and repeated_tokens for rows with page_id, url and html."""
    host = F.coalesce(F.lower(F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), F.xxhash64(host).alias("host"))

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            found = [blocks(p) for p in column(batch, "html").to_pylist()]
            joined = [" ".join(t for _, t in f) for f in found]
            digests = np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in joined], dtype=np.uint64).view(np.int64)
            article = [any(inside for inside, _ in f) for f in found]
            is_open = [not a and t.count(" ") + 1 >= least for a, t in zip(article, joined)]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "page_id"), column(batch, "url"), column(batch, "host"), pa.array(digests), pa.array(is_open, pa.bool_()), pa.array(article, pa.bool_()), pa.array(list(map(_packed, found)), pa.binary())],
                ["page_id", "url", "host", "digest", "open", "article", "blocks"],
            )

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(map(_unpacked, column(batch, "blocks").to_pylist()))
            some = [any(inside for inside, _ in f) for f in found]
            yield _texts(batch, [" ".join(t for inside, t in f if inside or not article) for f, article in zip(found, some)], [0] * batch.num_rows)

    def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, size = None, [], 0

        def done() -> pa.RecordBatch:
            numbers: dict[str, int] = {}
            streams = [np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64) for words, *_ in held]
            digests, is_open, article = np.array([h[1] for h in held], dtype=np.int64), np.array([h[2] for h in held], dtype=bool), np.array([h[3] for h in held], dtype=bool)
            order, pages, starts = sorted_runs(streams, least)
            at, low, high, some_open = _spread(order, pages, starts, digests, is_open)
            n = int(article.sum())
            missed = max(0, (9 * n - 1) // 10)  # the most pages of a run that is not on nine in ten of these
            on = streams_of_runs(pages, starts, article)
            common = 10 * on >= 9 * n if n else np.zeros(len(at), dtype=bool)
            told = np.ones(len(at), dtype=bool) if in_bitmap(asking_hosts.value, np.array([of]))[0] else common
            at, low, high, some_open, on, common = (x[told] for x in (at, low, high, some_open, on, common))
            tokens = _hashes(numbers)[np.concatenate(streams)] if len(at) else np.zeros((0, 2), dtype=np.uint64)
            # the last row is the array's own: what runs that it does not report as common may have in it
            more = [pa.array([None], pa.int64())]
            return pa.RecordBatch.from_arrays(
                [
                    *(pa.concat_arrays([pa.array(k, pa.int64()), *more]) for k in (*run_keys(of, tokens, at, least), low, high)),
                    pa.array([*some_open.tolist(), None], pa.bool_()), pa.array([of] * (len(at) + 1), pa.int64()), pa.concat_arrays([pa.array(on - missed, pa.int64(), mask=~common), pa.array([missed], pa.int64())]),
                ],
                ["hi", "lo", "low", "high", "open", "host", "gain"],
            )

        for batch in batches:
            for host_, digest, is_open, article, packed in zip(*(column(batch, c).to_pylist() for c in ("host", "digest", "open", "article", "blocks"))):
                if held and host_ == of and held[-1][1] == digest:  # a copy
                    held[-1][2] |= is_open
                    held[-1][3] |= article
                    continue
                if held and (host_ != of or size >= chunk_tokens):
                    yield done()
                    held, size = [], 0
                of, words = host_, _words(packed)
                held.append([words, digest, is_open, article])
                size += len(words)
        if held:
            yield done()

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host_, digest, packed in zip(*(column(batch, c).to_pylist() for c in ("host", "digest", "blocks"))):
                tokens = _hashes(_words(packed))
                at = np.arange(len(tokens) - least + 1)
                keys = run_keys(host_, tokens, at, least)
                yield pa.RecordBatch.from_arrays([*map(pa.array, keys), pa.array([host_] * len(at), pa.int64()), pa.array([digest] * len(at), pa.int64()), pa.array(at, pa.int32())], ["hi", "lo", "host", "digest", "at"])

    def cover(at: list[int] | None, n: int) -> np.ndarray:
        """Which of ``n`` tokens the runs at these (distinct) places cover."""
        covered = np.zeros(n + 1, dtype=np.int64)
        covered[at or []] += 1
        covered[np.array(at or [], dtype=np.int64) + least] -= 1
        return np.cumsum(covered[:-1]) > 0

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for packed, at in zip(column(batch, "blocks").to_pylist(), column(batch, "at").to_pylist()):
                words = _words(packed)
                covered = cover(at, len(words))
                texts.append(" ".join(w for w, hit in zip(words, covered) if not hit))
                removed.append(int(covered.sum()))
            yield _texts(batch, texts, removed)

    def cut_articles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for packed, at in zip(column(batch, "blocks").to_pylist(), column(batch, "at").to_pylist()):
                found = _unpacked(packed)
                article, lost, tokens, begin = [], 0, 0, 0
                covered = cover(at, sum(text.count(" ") + 1 for _, text in found))
                for inside, text in found:
                    n = text.count(" ") + 1
                    if inside:
                        gone = bool(covered[begin : begin + n].all())
                        article.append((gone, text))
                        tokens, lost = tokens + n, lost + n * gone
                    begin += n
                if 2 * lost >= tokens:
                    article, lost = [(False, text) for _, text in article], 0
                texts.append(" ".join(text for gone, text in article if not gone))
                removed.append(lost)
            yield _texts(batch, texts, removed)

    def of_hosts(*bitmaps):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hosts = column(batch, "host").to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(np.logical_or.reduce([in_bitmap(b.value, hosts) for b in bitmaps])))

        return run

    def hosts_of(df: DataFrame):
        return pages.sparkSession.sparkContext.broadcast(membership_bitmap(df.select("host").distinct(), "host"))

    parsed = durable(map_arrow(rows, parse, "page_id long, url string, host long, digest long, open boolean, article boolean, blocks binary"), "blocks")
    asking, articles, plain = parsed.where("open"), parsed.where("article"), parsed.where("not open and not article")
    many = durable(articles.groupBy("host").agg(F.countDistinct("digest").alias("n")).where(F.col("n") >= MIN_ARTICLES), "hosts")
    asking_hosts, many_hosts = hosts_of(asking), hosts_of(many)

    # ranges of (host, digest): copies stand side by side, and a large host lies in many partitions
    near = map_arrow(parsed.select("host", "digest", "open", "article", "blocks"), of_hosts(asking_hosts, many_hosts), "host long, digest long, open boolean, article boolean, blocks binary")
    near = near.repartitionByRange("host", "digest").sortWithinPartitions("host", "digest")
    found = map_arrow(near, runs, "hi long, lo long, low long, high long, open boolean, host long, gain long").groupBy("host", "hi", "lo").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("open").alias("open"), F.sum("gain").alias("gain"))
    found = durable(found.where(((F.col("low") != F.col("high")) & F.col("open")) | F.col("gain").isNotNull()), "repeated")

    def places(of: DataFrame, runs_: DataFrame) -> DataFrame:
        once = of.groupBy("host", "digest").agg(F.first("blocks").alias("blocks"))
        return map_arrow(once, ask, "hi long, lo long, host long, digest long, at int").join(runs_, ["hi", "lo"], "left_semi")

    def cleaned(of: DataFrame, found_at: DataFrame, cut_: Callable) -> DataFrame:
        covers = found_at.groupBy("host", "digest").agg(F.collect_list("at").alias("at"))  # places of one page
        return map_arrow(of.join(covers, ["host", "digest"], "left").select("page_id", "url", "blocks", "at"), cut_, TEXTS)

    out = map_arrow(plain, whole, TEXTS)
    if not asking.isEmpty():
        repeated = found.where((F.col("low") != F.col("high")) & F.col("open")).select("hi", "lo")
        out = out.unionByName(cleaned(asking, places(asking, repeated), cut))

    # runs that may be on nine in ten of a host's articles: what arrays report, and the most that the others may have
    most = found.where("hi is null").select("host", F.col("gain").alias("missed"))
    may = found.where("hi is not null and gain is not null").select("host", "hi", "lo", "gain").join(most, "host").join(many, "host")
    may = durable(may.where(10 * (F.col("gain") + F.col("missed")) >= 9 * F.col("n")).select("host", "hi", "lo", "n"), "common")
    if may.isEmpty():
        return out.unionByName(map_arrow(articles, whole, TEXTS))
    may_hosts = hosts_of(may)

    def elsewhere(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from whole([batch.filter(pa.array(~in_bitmap(may_hosts.value, column(batch, "host").to_numpy(zero_copy_only=False))))])

    there = map_arrow(articles.drop("open", "article"), of_hosts(may_hosts), "page_id long, url string, host long, digest long, blocks binary")
    found_at = durable(places(there, may), "places")
    counted = found_at.groupBy("host", "hi", "lo").agg(F.countDistinct("digest").alias("pages")).join(may, ["host", "hi", "lo"]).where(10 * F.col("pages") >= 9 * F.col("n")).select("hi", "lo")
    return out.unionByName(map_arrow(articles, elsewhere, TEXTS)).unionByName(cleaned(there, found_at.join(counted, ["hi", "lo"], "left_semi"), cut_articles))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op2_html": op2_html}
ORACLES: dict[str, str] = {}
