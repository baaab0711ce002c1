"""Main text of web pages: page structure, and runs of words that pages of a host repeat."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialnum.llm.shared import join_by_key, materialize

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+|[^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
MAIN = {"article", "main"}
CHROME = set("head nav header footer aside form noscript template iframe object svg canvas audio video button select dialog menu".split())
MARKS = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header "
    "masthead cookie cookies consent gdpr notice notices newsletter subscribe popup modal overlay share sharing social related recommended comment comments "
    "disqus replies respond login signup search pagination pager toolbar".split()
)
COMMENTS = {"comment", "comments", "disqus", "replies", "respond"}
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())


def chrome_of(tag: str, attributes: str) -> str:
    """Whether an element is no part of the main text: "chrome" by its name, role or visibility, "comments", "marked" by class or id, or ""."""
    if tag in CHROME:
        return "chrome"
    if not attributes or tag in ("html", "body"):
        return ""
    a = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(attributes)}
    marks = set(f"{a.get('class', '')} {a.get('id', '')}".split())
    if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", ""):
        return "chrome"
    if a.get("role") in ROLES and tag not in MAIN:
        return "chrome"
    return "comments" if marks & COMMENTS else "marked" if marks & MARKS and tag not in MAIN else ""


def blocks(page: str | None) -> list[tuple[str, list[str]]]:
    """Text blocks of a page in order: (region, words). Regions are main (in an article), open and chrome.

    An article in an element that only its class or id marks is main text, unless it lies among comments.
    """
    page = page or ""
    out: list[tuple[str, list[str]]] = []
    stack: list[tuple[str, str]] = []  # (tag, region before it)
    text: list[str] = []
    region, at, skip = "open", 0, 0

    def flush() -> None:
        if text and (words := html.unescape("".join(text)).split()):
            out.append((region if region in ("main", "open") else "chrome", words))
        text.clear()

    while m := TAG.search(page, at):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        closing, tag = bool(m[1]), m[2].lower()
        if tag not in INLINE:
            flush()
            while stack and stack[-1][0] == "p" and tag not in VOID and not (closing and tag == "p"):
                region = stack.pop()[1]
        elif tag == "br":
            text.append(" ")
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    flush()
                    region = stack[k][1]
                    del stack[k:]
                    break
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}[^a-z0-9]", re.I).search(page, at)
            skip = page.find(">", end.start()) + 1 if end else 0
            at = skip or len(page)
            continue
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "path"):
            continue
        own = region
        if region not in ("chrome", "comments"):
            kind = chrome_of(tag, m[3])
            if region != "main" and tag in MAIN and not kind:
                own = "main"
            elif kind and not region == kind == "marked":
                own = kind
        if own != region or region not in ("main", "open") or tag not in INLINE:
            if own != region:
                flush()
            stack.append((tag, region))
            region = own
    text.append(page[at:])
    flush()
    return out


def run_keys(host: str, stream: list[str], least: int) -> list[bytes]:
    """128-bit keys of the first `least` words of each suffix of a stream, within its host."""
    head = host.encode("utf-8", "replace") + b"\0"
    words = [w.encode("utf-8", "replace") for w in stream]
    return [xxhash.xxh3_128_digest(head + b" ".join(words[i : i + least])) for i in range(len(words) - least + 1)]


def article_key(parts: list[list[str]]) -> bytes | None:
    """128-bit key of an article's blocks; None of a page without any."""
    return xxhash.xxh3_128_digest("\0".join(map(" ".join, parts)).encode("utf-8", "replace")) if parts else None


def block_runs(host: str, parts: list[list[str]], least: int) -> list[tuple[int, int, bytes]]:
    """(first, end, key) of the shortest run of whole blocks from each block on that has `least` words, within its host."""
    out, end, size = [], 0, 0
    head = host.encode("utf-8", "replace") + b"\0"
    made = [" ".join(p).encode("utf-8", "replace") for p in parts]
    for first in range(len(parts)):
        while end < len(parts) and size < least:
            size += len(parts[end])
            end += 1
        if size < least:
            break
        out.append((first, end, xxhash.xxh3_128_digest(head + b"\0".join(made[first:end]))))
        size -= len(parts[first])
    return out


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def repeated_runs(streams: DataFrame, least: int, pages: int) -> DataFrame:
    """(row, start): words of a stream from which on `least` words in a row are on `pages` distinct pages of the host.

    `streams` has (row, host, page, words). This is the host's suffix array to the depth that matters: suffixes
    with equal first `least` words are neighbours in it with that common prefix, and longer
    repeats are the union of such windows. So suffixes are grouped by that prefix rather than put into one task
    per host: pages of a prefix are made distinct and counted with partial sums, and prefixes that
    a large part of all suffixes share are joined back by broadcast.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, host, page, words = (c.to_pylist() for c in batch.columns)
            out = [(r, p, i, k) for r, h, p, w in zip(row, host, page, words, strict=True) for i, k in enumerate(run_keys(h, w, least))]
            columns = zip(*out, strict=True) if out else [[]] * 4
            types = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["row", "page", "start", "key"])

    suffixes = materialize(streams.select("row", "host", "page", "words").mapInArrow(keys, "row long, page long, start int, key binary"))
    of_page = suffixes.groupBy("key", "page").agg(F.count(F.lit(1)).alias("n"))
    repeated = of_page.groupBy("key").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("n")).where(F.col("pages") >= pages)
    return join_by_key(suffixes.select("row", "start", "key"), materialize(repeated.select("key", "n")), "key", "n", suffixes.count()).select("row", "start")


def repeated_blocks(streams: DataFrame, pages: int) -> DataFrame:
    """(host, article, gone): places of an article's blocks that its host repeats in most of its articles.

    `streams` has (host, article, page, runs, sizes, frame): the runs of whole blocks of the article, the words of its blocks and the
    runs outside of it. This is the host's suffix array at the starts of blocks. A run goes that `pages` pages and half of the
    host's articles have, equal articles being one: few pages of a small host may well share a line. An article of which more than half would go is a copy, and stays.
    """
    articles = materialize(streams.where(F.col("article").isNotNull()).groupBy("host", "article").agg(F.first("runs").alias("runs"), F.first("sizes").alias("sizes")))
    inside = articles.select("host", "article", F.explode("runs").alias("r")).select("host", "article", "r.*")
    page = F.coalesce("article", F.encode(F.col("page").cast("string"), "utf-8"))
    seen = inside.select("key", F.col("article").alias("page")).unionByName(streams.select(F.explode("frame").alias("key"), page.alias("page")))
    of_page = seen.groupBy("key", "page").agg(F.count(F.lit(1)).alias("n"))
    repeated = of_page.groupBy("key").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("n")).where(F.col("pages") >= pages)
    hits = materialize(join_by_key(inside, materialize(repeated), "key", "n", seen.count()).select("host", "article", "at", "end", "pages"))
    hosts = materialize(articles.groupBy("host").agg(F.count(F.lit(1)).alias("articles")))
    hits = join_by_key(hits, hosts, "host", "articles", articles.count()).where(F.col("pages") * 2 >= F.col("articles"))
    places = hits.select("host", "article", F.explode(F.sequence("at", F.col("end") - 1)).alias("place"))
    gone = places.groupBy("host", "article").agg(F.array_sort(F.collect_set("place")).alias("gone")).join(articles.select("host", "article", "sizes"), ["host", "article"])
    words = lambda sizes: F.aggregate(sizes, F.lit(0), lambda a, b: a + b)
    return gone.where(words(F.transform("gone", lambda i: F.get("sizes", i))) * 2 <= words(F.col("sizes"))).select("host", "article", "gone")


def main_texts(pages: DataFrame, least: int = 8, pages_of_run: int = 3, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", pages_of_block: int = 10) -> DataFrame:
    """Main text of every page: (id, url, text, n_chars).

    What a page has in an article (or main) element is its main text, less the blocks that the host repeats in half of its articles, on `pages_of_block` pages
    at least (`repeated_blocks`): copies and quotations stay, as do repeated words within a block. Outside of it, elements that name themselves menus, headers, adverts, forms,
    comments and the like are dropped. The text of a page without an article is what is left, less every run of `least` words or more
    that `pages_of_run` distinct pages of its host share. Runs are looked for in all text outside of articles, menus and
    footers included, since these are what other pages repeat without saying so.

    Null html is an empty page; a null or unreadable url is the host "". Equal html counts as one page. Repeated rows give
    repeated rows; an empty table gives none; other columns are ignored.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, kinds, articles, runs, sizes, frames = [], [], [], [], [], []
            for page, host in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                w, k, main, frame = [], [], [], []
                for region, block in blocks(page):
                    if region == "main":
                        main.append(block)
                        continue
                    frame.append(block)
                    w += block
                    k += [region == "open"] * len(block)
                words.append(w)
                kinds.append(k)
                articles.append(article_key(main))
                runs.append([{"at": a, "end": e, "key": key} for a, e, key in block_runs(host, main, least)])
                sizes.append([len(b) for b in main])
                frames.append([key for _, _, key in block_runs(host, frame, least)])
            run = pa.struct([("at", pa.int32()), ("end", pa.int32()), ("key", pa.binary())])
            columns = [*batch.columns[1:], pa.array(articles, pa.binary()), pa.array(words, pa.list_(pa.string())), pa.array(kinds, pa.list_(pa.bool_()))]
            columns += [pa.array(runs, pa.list_(run)), pa.array(sizes, pa.list_(pa.int32())), pa.array(frames, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "url", "host", "page", "article", "words", "open", "runs", "sizes", "frame"])

    def article(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[w for region, w in blocks(page) if region == "main"] for page in batch.column(0).to_pylist()]
            keys = pa.array([article_key(f) for f in found], pa.binary())
            parts = pa.array([[" ".join(w) for w in f] for f in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], keys, parts], names=["id", "url", "host", "article", "parts"])

    def unique_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, url, words, kinds, starts = batch.column(0), batch.column(1), *(c.to_pylist() for c in batch.columns[2:])
            texts = []
            for w, k, s in zip(words, kinds, starts, strict=True):
                covered = np.zeros(len(w) + 1, np.int64)
                for i in s or []:
                    covered[i] += 1
                    covered[i + least] -= 1
                gone = np.cumsum(covered)[:-1] > 0
                texts.append(" ".join(x for x, is_open, g in zip(w, k, gone, strict=True) if is_open and not g))
            yield pa.RecordBatch.from_arrays([ids, url, pa.array(texts, pa.string())], names=["id", "url", "text"])

    source = pages.select(
        F.col(html_col).alias("html"), F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.xxhash64(html_col).alias("page")
    )
    streams = "id long, url string, host string, page long, article binary, words array<string>, open array<boolean>"
    streams += ", runs array<struct<at: int, end: int, key: binary>>, sizes array<int>, frame array<binary>"
    streams = materialize(source.mapInArrow(split, streams).withColumn("row", F.monotonically_increasing_id()))
    starts = repeated_runs(streams, least, pages_of_run)
    bare = streams.where(F.col("article").isNull()).select("row", "id", "url", "words", "open")
    starts = starts.join(bare.select("row"), "row", "left_semi").groupBy("row").agg(F.collect_list("start").alias("starts"))
    rest = bare.join(starts, "row", "left").select("id", "url", "words", "open", "starts").mapInArrow(unique_runs, "id long, url string, text string")
    whole = source.select("html", "id", "url", "host").mapInArrow(article, "id long, url string, host string, article binary, parts array<string>").where(F.col("article").isNotNull())
    gone = materialize(repeated_blocks(streams, pages_of_block))
    kept = F.filter("parts", lambda _, i: ~F.coalesce(F.array_contains("gone", i), F.lit(False)))
    whole = whole.join(gone, ["host", "article"], "left").select("id", "url", F.array_join(kept, " ").alias("text"))
    return whole.unionByName(rest).withColumn("n_chars", F.char_length("text").cast("long"))
