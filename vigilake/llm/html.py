"""Main text of web pages.

A page's tokens are read once: tags move a stack of open elements, and text gathers into blocks. Blocks inside menus,
headers, footers, sidebars, notices, adverts, forms, comments and the like never count. Then the suffixes of the token
streams of a host's pages, ranked by their first RUN_TOKENS tokens, form a suffix array that is dealt over the cluster by
rank; suffixes of equal rank that belong to distinct pages are repeats. What a repeat says depends on the page:

Where a page marks its article (<article>, <main> or role=main; `read_blocks`), the blocks inside it are the text, repeated
passages too, as articles quote and copy one another. But what most articles of a host repeat (SITE_SHARE), and is a small
part of each (SITE_PART), is the site's notice. All suffixes of these pages are ranked and counted, first where the pages
are: what half of a host's pages repeat, half of its pages in some task repeat, so only such ranks are counted over the host.

Where a page doesn't, the text is what the pages of its host don't share: blocks that repeats cover go.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm.storage import written
from vigilake.llm.urlfilter import host_and_path

#: Tokens in a run that distinct pages of a host must repeat, and the share of a block's tokens covered by such runs
#: from which the block is boilerplate.
RUN_TOKENS, COVERED = 8, 0.8
#: A run is the site's and not the articles' if at least this share of the host's different pages that mark their article
#: hold it inside, of no fewer than so many pages; an article that is covered by such runs for more than SITE_PART of its
#: tokens is one of many copies, and stays whole.
SITE_SHARE, SITE_PAGES, SITE_PART = 0.5, 20, 0.25
#: Ranks at most that a task counts at once (8 bytes each), and pages of a host from which they are counted there.
PART_RUNS, FEW_PAGES = 4_000_000, 8

# Elements by what they do to text.
_RAW = frozenset("script style noscript template svg iframe object textarea title canvas audio video".split())
_DROP = frozenset("head nav header footer aside form button select option dialog menu fieldset".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
# Words of class, id and role that mark an element as no part of the text: what surrounds an article, and
# what readers wrote or where else to read.
_AROUND = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar sidenav aside footer masthead topbar toolbar "
    "cookie cookies consent gdpr notice alert newsletter subscribe subscription signup login share sharing social "
    "popup modal overlay widget widgets pagination pager search complementary contentinfo dialog".split()
)
_OTHERS = frozenset(
    "related recommended recommendations teaser teasers comment comments commentlist commentform disqus reply replies respond".split()
)
#: These are the readers' only as a class: a section of an article may have one as its id.
_READERS = frozenset("discussion discussions responses feedback".split())
# Words that beside a hint in one name of a class only say what kind of element it is.
_NEUTRAL = frozenset(
    "area bar block body bottom box button buttons col column container content form global group header heading holder inner "
    "item items left link links list main module outer page panel post posts primary right row secondary section site "
    "stories story the thread title top wrap wrapper".split()
)
# Names of a page's header that isn't a <header>.
_PAGE_HEADER = frozenset("header site-header siteheader global-header top-header page-top".split())
# Elements that hold a phrase or a paragraph. Their classes often describe what they say, so they go only
# if every word of the class or id is a hint. A container goes if one name of its class or id is a hint, or hints with
# neutral words: `comment-list` and `site footer` are, `with-sidebar` and `social-history` aren't.
_PHRASE = frozenset(
    "a abbr b bdi bdo blockquote cite code dd del dfn dt em figcaption figure h1 h2 h3 h4 h5 h6 i ins kbd label li mark p pre q s "
    "samp small span strong sub sup td th time tr u var".split()
)

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S
)
_MAIN = re.compile(r"""\brole\s*=\s*["']?main\b""", re.I)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_UNSEEN = re.compile(r"(display\s*:\s*none|visibility\s*:\s*hidden)", re.I)

#: What an element's tag and attributes say of what it holds: text, no text unless it holds the page's article, no text.
TEXT, AROUND, NONE = 0, 1, 2


def _hint(words: list[str]) -> int:
    """What words say that are all hints."""
    return NONE if any(w in _OTHERS for w in words) else AROUND


def what_it_holds(name: str, attributes: str, inside: bool) -> int:
    """TEXT, AROUND or NONE for an element; an article's own header holds its title."""
    if name in _DROP and not (name == "header" and inside):
        return NONE
    if not attributes:
        return TEXT
    found = TEXT
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and _UNSEEN.search(value)):
            return NONE
        if key in ("style", "aria-hidden") or name in ("html", "body", "main"):
            continue
        names = [[w for w in re.split(r"[^a-z]+", n) if w] for n in value.split()]
        if name in _PHRASE:
            every = [w for words in names for w in words]
            if every and all(w in _AROUND or w in _OTHERS for w in every):
                found = max(found, _hint(every))
            continue
        for words in names:
            hints = [w for w in words if w in _AROUND or w in _OTHERS]
            if hints and all(w in _NEUTRAL for w in words if w not in hints):
                found = max(found, _hint(hints))
            elif key == "class" and len(words) == 1 and words[0] in _READERS:
                found = NONE
            elif not inside and name != "article" and "-".join(words) in _PAGE_HEADER:
                found = max(found, AROUND)
    return found


def read_blocks(page: str | None) -> tuple[list[str], list[str]]:
    """The page's text blocks in order: those inside its marked article, and the others that may be text. Marks in
    comments and scripts don't count.

    An article is marked by <main>, role=main, or an <article> that no hint is against. Where hints stand on what is
    around it alone (a layout's class that names its sidebar, say), it still is the page's article if there is no other.
    """
    page = page or ""
    inside: list[str] = []
    rescued: list[str] = []
    outside: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # name, what it holds, is the article
    text: list[str] = []
    none = around = marked = 0
    base = 0  # how many open elements around the article there were as it began

    def flush() -> None:
        block = " ".join("".join(text).split())
        text.clear()
        if block:
            (outside if not marked else rescued if base else inside).append(block)

    def pop() -> None:
        nonlocal none, around, marked, base
        _, holds, marks = stack.pop()
        none -= holds == NONE
        around -= holds == AROUND
        marked -= marks
        if not marked:
            base = 0

    at = 0
    while True:
        m = _TAG.search(page, at)
        upto = m.start() if m else len(page)
        if upto > at and not none and around == base:
            text.append(html.unescape(page[at:upto]))
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in _BLOCK:
            flush()
        elif name == "br":
            text.append(" ")
        if m[1]:
            if any(name == x[0] for x in stack):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in _VOID:
            continue
        if name in _BLOCK and stack and stack[-1][0] == "p":
            pop()  # a block ends an open paragraph
        is_main = name == "main" or bool(_MAIN.search(m[3]))
        holds = what_it_holds("main" if is_main else name, m[3], marked > 0)
        marks = holds == TEXT and not none and (name == "article" or is_main)
        if marks and not marked:
            if is_main:  # there is one, whatever it is in
                stack = [(n, TEXT if h == AROUND else h, k) for n, h, k in stack]
                around = 0
            base = around
        stack.append((name, holds, marks))
        none += holds == NONE
        around += holds == AROUND
        marked += marks
    flush()
    return inside or rescued, outside


def run_hashes(blocks: list[str], run: int = RUN_TOKENS) -> np.ndarray:
    """The rank key of each suffix of the page's tokens: a hash of its first `run` tokens; the last run - 1 have none."""
    token = [xxhash.xxh64_intdigest(t, 7) for block in blocks for t in block.split()]
    h = np.array(token, np.uint64)
    n = len(h) - run + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(run if n > 0 else 0):  # wraps around like any hash
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def covered_tokens(n: int, starts, run: int = RUN_TOKENS) -> np.ndarray:
    """Which of a page's n tokens lie in the runs that begin at `starts`."""
    covered = np.zeros(n, bool)
    for s in starts:
        covered[s : s + run] = True
    return covered


def unique_blocks(blocks: list[str], starts: list[int], run: int = RUN_TOKENS, share: float = COVERED) -> list[str]:
    """The blocks of a page that the runs repeated on other pages, by their first tokens' numbers, don't cover."""
    lengths = [len(b.split()) for b in blocks]
    covered = covered_tokens(sum(lengths), starts, run)
    at, kept = 0, []
    for block, n in zip(blocks, lengths, strict=True):
        if covered[at : at + n].sum() < share * n:
            kept.append(block)
        at += n
    return kept


def _counted(held: dict, share: float) -> np.ndarray:
    """The ranks on at least `share` of the rows of pages of different text, by content their rows and distinct ranks."""
    ranks, counts = np.unique(np.concatenate([r for _, r in held.values()]), return_counts=True)
    return ranks[counts >= share * sum(n for n, _ in held.values()) - 1e-9]


_RANKS = {"host": pa.string(), "content": pa.int64(), "n": pa.int64(), "share": pa.float64(), "ranks": pa.list_(pa.int64())}


def _ranks(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in _RANKS]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, _RANKS.values(), strict=True)], names=list(_RANKS))


def _counted_in_place(run: int):
    """Of each host of a part of a task's pages the ranks on `share` of them; of hosts with few there each page's ranks."""

    def told(hosts: dict) -> Iterator[pa.RecordBatch]:
        for host, (share, held) in hosts.items():
            if sum(n for n, _ in held.values()) >= FEW_PAGES:
                yield _ranks([(host, None, 0, share, _counted(held, share))])
            else:
                yield _ranks([(host, content, n, share, ranks) for content, (n, ranks) in held.items()])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts, size = {}, 0
        for batch in batches:
            for host, content, share, text in zip(*[batch.column(c).to_pylist() for c in ("host", "content", "share", "text")], strict=True):
                held = hosts.setdefault(host, (share, {}))[1]
                if content in held:
                    held[content] = (held[content][0] + 1, held[content][1])
                    continue
                held[content] = (1, np.unique(run_hashes(text.split("\n\n"), run).view("int64")))
                size += len(held[content][1])
                if size >= PART_RUNS:
                    yield from told(hosts)
                    hosts, size = {}, 0
        yield from told(hosts)

    return count


def _counted_by_host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same of pages' ranks that come by host."""
    now, share, held = None, 0.0, {}
    for batch in batches:
        ranks = batch.column("ranks")
        for k, (host, content, n, part) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("host", "content", "n", "share")], strict=True)):
            if held and host != now:
                yield _ranks([(now, None, 0, share, _counted(held, share))])
                held = {}
            now, share = host, part
            before = held.get(content, (0, None))[0]
            held[content] = (before + n, ranks[k].values.to_numpy(zero_copy_only=False))
    if held:
        yield _ranks([(now, None, 0, share, _counted(held, share))])


def likely_runs(marked: DataFrame, pages: DataFrame, run: int = RUN_TOKENS) -> DataFrame:
    """By host ranks (`likely`), among them all that stand on at least SITE_SHARE of its pages of different text. `marked`
    has host, content and text, `pages` each host's numbers of pages of different text and of all.

    The parts of a host's pages in tasks make up all of them, so such a rank stands on that share of some part: of its
    pages of different text, by the share that those are of all of the host's. Pages of parts too small to tell are brought
    together by host."""
    share = (F.lit(SITE_SHARE) * F.col("pages") / F.col("all")).alias("share")
    held = marked.join(pages, "host").select("host", "content", share, "text")
    kinds = "host string, content long, n long, share double, ranks array<long>"
    counted = written(held.mapInArrow(_counted_in_place(run), kinds), "runs")
    few = counted.where("content IS NOT NULL").repartition("host").sortWithinPartitions("host").mapInArrow(_counted_by_host, kinds)
    ranks = counted.where("content IS NULL").unionByName(few).select("host", F.explode("ranks").alias("rank")).distinct()
    return written(ranks.groupBy("host").agg(F.collect_list("rank").alias("likely")), "likely")


def article_blocks(blocks: list[str], site: np.ndarray, run: int = RUN_TOKENS, part: float = SITE_PART) -> list[str]:
    """The blocks of a marked article that runs of `site` don't cover; all of them if those cover more than `part`."""
    starts = np.flatnonzero(np.isin(run_hashes(blocks, run).view("int64"), site))
    n = sum(len(b.split()) for b in blocks)
    return blocks if covered_tokens(n, starts, run).sum() > part * n else unique_blocks(blocks, starts.tolist(), run)


def site_runs(found: DataFrame, pages: DataFrame) -> DataFrame:
    """By host the ranks (`site`) that stand on at least SITE_SHARE of its pages; `found` has host, content and rank, `pages`
    each host's number of pages of different text. A host has no more of them than 1 / SITE_SHARE of its pages' mean."""
    counts = found.groupBy("host", "rank").agg(F.count_distinct("content").alias("n")).where(F.col("n") >= SITE_SHARE * SITE_PAGES)
    most = counts.join(pages, "host").where(F.col("n") >= SITE_SHARE * F.col("pages"))
    return written(most.groupBy("host").agg(F.collect_list("rank").alias("site")), "site")


def extract_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", run: int = RUN_TOKENS) -> DataFrame:
    """`pages` without the html column, with text and n_chars (code points); input columns of these names give way.

    Null and empty html give an empty text. Pages meet by host, whatever its size: a run of `run` tokens that two pages of
    different text share is a repeat. Of pages without a marked article, blocks that repeats cover by at least COVERED go; of
    marked articles, those that repeats of most of the host's articles cover so. Repeated rows are one page for this, so
    they keep their text and get equal results. An empty table stays empty; very long pages are read whole.
    """
    page = F.col(f"`{html_col}`").cast("string")

    @F.pandas_udf("struct<marked: boolean, text: string, blocks: array<string>>")
    def read(column: pd.Series) -> pd.DataFrame:
        out = []
        for p in column:
            inside, outside = read_blocks(p)
            out.append((bool(inside), "\n\n".join(inside), [] if inside else outside))
        return pd.DataFrame(out, columns=["marked", "text", "blocks"])

    @F.pandas_udf("array<long>")
    def runs(column: pd.Series) -> pd.Series:
        return pd.Series([run_hashes(list(b), run).view("int64") for b in column], dtype=object)

    @F.pandas_udf("array<long>")
    def runs_among(text: pd.Series, likely: pd.Series) -> pd.Series:
        found = (np.intersect1d(run_hashes(t.split("\n\n"), run).view("int64"), r) for t, r in zip(text, likely, strict=True))
        return pd.Series(list(found), dtype=object)

    @F.pandas_udf("string")
    def article(text: pd.Series, site: pd.Series) -> pd.Series:
        found = (t if s is None else "\n\n".join(article_blocks(t.split("\n\n"), s, run)) for t, s in zip(text, site, strict=True))
        return pd.Series(list(found), dtype=object)

    @F.pandas_udf("string")
    def unique(blocks: pd.Series, starts: pd.Series) -> pd.Series:
        found = (unique_blocks(list(b), [] if s is None else list(s), run) for b, s in zip(blocks, starts, strict=True))
        return pd.Series(["\n\n".join(b) for b in found], dtype=object)

    names = [c for c in pages.columns if c != html_col and c.lower() not in ("text", "n_chars")]
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in names]).alias("row")
    host = host_and_path(F.col(f"`{url_col}`").cast("string"))[0].alias("host")
    # read once: both what is done and what meets by host comes from this table
    held = written(pages.select(row, host, read.asNondeterministic()(page).alias("r")).select("row", "host", "r.*"), "pages")
    done = held.where("NOT marked AND size(blocks) = 0").select("row", "text")

    marked = held.where("marked").select("row", "host", "text", F.xxhash64("text").alias("content"))
    sizes = marked.groupBy("host").agg(F.count_distinct("content").alias("pages"), F.count("*").alias("all"))
    sizes = written(sizes.where(F.col("pages") >= SITE_PAGES), "sizes")
    likely = marked.join(likely_runs(marked, sizes, run), "host")
    inside = likely.select("host", "content", F.explode(runs_among("text", "likely")).alias("rank"))
    # read from files, so few hosts with such runs are broadcast and the texts needn't move
    told = marked.join(site_runs(inside, sizes), "host", "left").select("row", article("text", "site").alias("text"))

    rest = held.where("NOT marked AND size(blocks) > 0").select("row", "host", "blocks", F.xxhash64("blocks").alias("content"))
    distinct = rest.select("host", "content", "blocks").dropDuplicates(["host", "content"])
    suffixes = distinct.select("host", "content", F.posexplode(runs("blocks")).alias("start", "rank"))
    # which pages share a rank is an aggregate that combines before its shuffle, so a large host is no large task
    shared = suffixes.groupBy("host", "rank").agg(F.min("content").alias("lo"), F.max("content").alias("hi"))
    shared = shared.where("lo <> hi").select("host", "rank")
    starts = suffixes.join(shared, ["host", "rank"], "left_semi").groupBy("host", "content").agg(F.collect_list("start").alias("starts"))
    cut = rest.join(starts, ["host", "content"], "left").select("row", unique("blocks", "starts").alias("text"))
    columns = [F.col("row").getField(c).alias(c) for c in names]
    return done.unionByName(told).unionByName(cut).select(*columns, "text").withColumn("n_chars", F.length("text").cast("long"))
