"""SimHash near-duplicates: fingerprints of word shingles, linked within a Hamming radius by a binary-trie self-join.

Fingerprints are cut into radius + 1 blocks; two within the radius agree in a whole block, so each block's value deals
the distinct fingerprints out. Inside, the fingerprints rotated to start after that block form a trie; node pairs go
down together, add up the bits in which they differ, and end once these exceed the radius. A task returns the spanning
links of what it found, not the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.llm.graph import connected_components
from vigilake.llm.storage import written

BITS = 64
#: Fingerprints at most in one dealt group. Larger groups are cut in parts, and each pair of parts becomes a group.
GROUP_ROWS = 16_384
#: What deals the fingerprints out: a block and its value, and the pair of parts.
GROUP_KEY = ["block", "value", "part_a", "part_b"]
#: Rows that a task gathers before it joins the groups that are complete, and node pairs that it expands at once.
BUFFER_ROWS, STEP_PAIRS = 60_000, 1_000_000
#: Shingles whose bits are counted at once.
COUNT_ROWS = 65_536


def shingle_hashes(text: str | None, size: int = 4, seed: int = 42) -> np.ndarray:
    """The XXH64 of all `size`-word shingles of the text with A-Z lower-cased, in order.

    Words are runs of anything but ASCII white space. A text of fewer words is one shingle; one without words has none.
    """
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return np.zeros(0, "<u8")
    joined, digest = b" ".join(ws), xxhash.xxh64_intdigest
    if len(ws) <= size:
        return np.array([digest(joined, seed)], "<u8")
    lengths = np.fromiter(map(len, ws), np.int64, len(ws))
    ends = np.cumsum(lengths) + np.arange(len(ws))
    starts = (ends - lengths)[: len(ws) - size + 1].tolist()
    ends = ends[size - 1 :].tolist()
    return np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts, ends, strict=True)), "<u8", len(starts))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(h), COUNT_ROWS):
        part = h[at : at + COUNT_ROWS].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(h), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, size: int = 4, seed: int = 42) -> int:
    """The majority bits over the hashes of all shingles of the text; 0 for a text without words."""
    return majority(shingle_hashes(text, size, seed))


def fingerprint_column(text: Column, size: int = 4) -> Column:
    """`fingerprint` of a text column, as a signed long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, size) for t in texts], dtype="uint64").astype("int64")

    return of(text)


def hex_form(fp: Column) -> Column:
    """Sixteen lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _find(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    root = parent[at]
    while True:
        up = parent[root]
        if np.array_equal(up, root):
            return root
        root = up


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[k] and b[k]; a set's root is its lowest row."""
    while len(a):
        ra, rb = _find(parent, a), _find(parent, b)
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))


def trie_links(group: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (as row numbers) between rows of one group whose fingerprints differ in at most `radius` bits.

    `group` is sorted, and `fp` (uint64) within each group. A node of the trie is a run of rows with one prefix; level
    by level (four bits a level) pairs of nodes are replaced by the pairs of their children that stay in the budget.
    Pairs of single rows are compared at once. Work goes depth first in bounded steps.
    """
    n = len(fp)
    parent = np.arange(n)
    row = np.arange(n)
    levels = []  # of each level: first rows of nodes, with n at the end; node of each row; key of each node
    for shift in (BITS, *range(BITS - 4, -1, -4)):
        key = np.zeros(n, np.uint64) if shift == BITS else fp >> np.uint64(shift)
        new = np.ones(n, bool)
        new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        first = np.flatnonzero(new)
        levels.append((np.append(first, n), np.cumsum(new) - 1, key[first]))
    roots = np.arange(len(levels[0][0]) - 1)
    todo = [(0, roots, roots, np.zeros(len(roots), np.int64))]
    while todo:
        level, a, b, err = todo.pop()
        first, _, _ = levels[level]
        size_a, size_b = first[a + 1] - first[a], first[b + 1] - first[b]
        single = (size_a == 1) & (size_b == 1)
        if single.any():
            ra, rb = first[a[single]], first[b[single]]
            near = (ra != rb) & (np.bitwise_count(fp[ra] ^ fp[rb]) <= radius)
            _unite(parent, ra[near], rb[near])
            a, b, err = a[~single], b[~single], err[~single]
        if level + 1 == len(levels) or not len(a):
            continue
        _, node, key = levels[level + 1]
        a0, b0 = node[first[a]], node[first[b]]
        many_a, many_b = node[first[a + 1] - 1] - a0 + 1, node[first[b + 1] - 1] - b0 + 1
        made = np.cumsum(many_a * many_b)
        if made[-1] > STEP_PAIRS and len(a) > 1:
            cut = max(1, int(np.searchsorted(made, STEP_PAIRS)))
            todo += [(level, a[cut:], b[cut:], err[cut:]), (level, a[:cut], b[:cut], err[:cut])]
            continue
        of = np.repeat(np.arange(len(a)), many_a * many_b)
        k = np.arange(made[-1]) - (made - many_a * many_b)[of]
        ca, cb = a0[of] + k // many_b[of], b0[of] + k % many_b[of]
        err = err[of] + np.bitwise_count((key[ca] ^ key[cb]) & np.uint64(15))
        stays = (err <= radius) & ((a[of] != b[of]) | (ca <= cb))
        todo.append((level + 1, ca[stays], cb[stays], err[stays]))
    root = _find(parent, row)
    child = np.flatnonzero(root != row)
    return child, root[child]


def _block_spans(radius: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of radius + 1 blocks that cover all bits."""
    edges = [round(k * BITS / (radius + 1)) for k in range(radius + 2)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:], strict=False)]


def _links_of_partition(radius: int):
    spans = _block_spans(radius)

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        fp = rows["fp"].to_numpy().astype("int64").view("uint64")
        block = rows["block"].to_numpy()
        up = np.array([BITS - lo - width for lo, width in spans], np.uint64)[block]  # the block becomes the top bits
        turned = np.where(up == 0, fp, (fp << up) | (fp >> ((np.uint64(BITS) - up) % np.uint64(BITS))))
        group = rows.groupby(GROUP_KEY, sort=False).ngroup().to_numpy()
        order = np.lexsort((turned, group))
        child, root = trie_links(group[order], turned[order], radius)
        signed = rows["fp"].to_numpy()[order]
        return pd.DataFrame({"child": signed[child], "root": signed[root]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for rows in batches:
            held.append(rows)
            n += len(rows)
            if n < BUFFER_ROWS:
                continue
            rows = pd.concat(held, ignore_index=True)
            earlier = (rows[GROUP_KEY] != rows[GROUP_KEY].iloc[-1]).any(axis=1).to_numpy().nonzero()[0]
            cut = int(earlier[-1]) + 1 if len(earlier) else 0  # the last group may go on in the next batch
            if cut:
                yield joined(rows.iloc[:cut])
            held, n = [rows.iloc[cut:]], len(rows) - cut
        if n:
            yield joined(pd.concat(held, ignore_index=True))

    return run


def hamming_links(fps: DataFrame, radius: int = 4, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links (child, root) that span all pairs of the distinct longs in `fps.fp` within `radius` bits; none is lost."""
    blocks = [
        F.struct(
            F.lit(k).alias("block"),
            F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << width) - 1).cast("long")).alias("value"),
        )
        for k, (lo, width) in enumerate(_block_spans(radius))
    ]
    dealt = fps.select("fp", F.inline(F.array(*blocks)))
    large = dealt.groupBy("block", "value").count().where(F.col("count") > group_rows)
    large = large.select("block", "value", F.ceil(F.col("count") / F.lit(group_rows)).cast("int").alias("parts"))
    dealt = dealt.join(large, ["block", "value"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = dealt.withColumn("own", part).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    )
    dealt = dealt.select(
        "block", "value", F.least("own", "other").alias("part_a"), F.greatest("own", "other").alias("part_b"), "fp"
    )
    dealt = dealt.repartition(*GROUP_KEY).sortWithinPartitions(*GROUP_KEY)
    return dealt.mapInPandas(_links_of_partition(radius), "child long, root long").distinct()


def near_duplicates(
    docs: DataFrame, size: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: its id, `fingerprint` (a long) and `component_id`, the lowest id that links reach.

    Null and empty texts have fingerprint 0 and link like any others. A null id is never a component's id unless all
    ids of the component are null. Repeated rows give a row each; an empty table gives none; other columns aren't
    returned. A very long text is hashed whole, its bits counted in parts of COUNT_ROWS shingles. Texts are read once
    and never shuffled; exact copies meet as one fingerprint.

    A block value of more than GROUP_ROWS fingerprints, v of them, copies its rows v / GROUP_ROWS times, so that all
    pairs of parts meet: none is lost, and the work on that value grows with the square of v.
    """
    prints = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        fingerprint_column(F.col(f"`{text_col}`").cast("string"), size).alias("fp"),
    )
    prints = written(prints, "fingerprints")
    firsts = prints.groupBy("fp").agg(F.min("id").alias("first"))
    roots = connected_components(hamming_links(firsts.select("fp"), radius))
    placed = firsts.join(roots, firsts["fp"] == roots["node"], "left")
    placed = placed.select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("first").alias("component"))
    member = placed.join(lowest, "root").select("fp", "component")
    return prints.join(member, "fp").select(
        F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), F.col("component").alias("component_id")
    )


def keep_one(
    docs: DataFrame, size: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """`docs` with one document of each group of near-duplicates, that of the lowest id; columns stay as they are.

    Rows with one id are one document; of those that repeat its text one row stays. Null ids stay only in groups
    that have no other id.
    """
    found = near_duplicates(docs, size, radius, id_col, text_col)
    heads = found.where(F.col(f"`{id_col}`").eqNullSafe(F.col("component_id"))).select(F.col(f"`{id_col}`").alias("head"))
    return keep_rows(docs, heads.distinct(), id_col, text_col)


def keep_rows(docs: DataFrame, heads: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the rows whose id is one of `heads.head` (distinct); of rows of one id and text, one.

    Rows that nothing repeats, nearly all, aren't sorted: only hashes are counted to find the others.
    """
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    held = docs.select(F.struct("*").alias("row"), ident.alias("id"), F.xxhash64(text).alias("h"))
    counts = docs.select(ident.alias("of_id"), F.xxhash64(text).alias("of_h")).groupBy("of_id", "of_h")
    twice = counts.agg(F.count("*").alias("n")).where("n > 1").drop("n")
    kept = held.join(heads, F.col("id").eqNullSafe(F.col("head")), "left_semi")
    same = F.col("id").eqNullSafe(F.col("of_id")) & F.col("h").eqNullSafe(F.col("of_h"))
    nth = F.row_number().over(Window.partitionBy("id", "h").orderBy(F.xxhash64("row")))
    first = kept.join(twice, same, "left_semi").withColumn("nth", nth).where("nth = 1").drop("nth")
    return kept.join(twice, same, "left_anti").unionByName(first).select("row.*")
