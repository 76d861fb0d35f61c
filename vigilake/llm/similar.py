"""Near-duplicates at an exact Jaccard similarity of word shingles, beside the fingerprints' links.

Documents meet first as equal shingle sets, then by SimHash's trie. What these leave apart is found by a prefix filter:
with all shingles in one order, two sets of at least the wanted similarity share a shingle among the first
n - ceil(threshold * n) + 1 of each. Any order loses none; rare shingles come first, by counts over a sample. Sets that
share one are compared with one set there, which joins large groups at a pair for each member; that is done again with
other sets, and then all pairs that are still in different components are compared.

Before sets are compared, a pair must pass a bound that loses none: each set's shingles are counted by their hashes' low
bits, and no two sets share more than the lesser counts add up to. That is a byte for every two shingles or fewer, so
whole sets travel only for pairs that are nearly sure to be similar.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.llm import simhash
from vigilake.llm.graph import connected_components
from vigilake.llm.storage import discard, written

#: Documents (about) whose shingles are counted for the order, and shingles that are known as common at most.
SAMPLE_DOCS, COMMON = 5_000, 100_000
#: How often the sets that share a shingle are compared with one of them before all pairs still apart are.
LEADS = 2
EPSILON = 1e-9


def shingle_set(text: str | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a text's shingles in order, and the sorted distinct ones."""
    h = simhash.shingle_hashes(text, size)
    return h, np.unique(h)


def set_key(distinct: np.ndarray) -> int:
    """One number for a shingle set, as a signed long."""
    return int(np.array([xxhash.xxh64_intdigest(distinct.tobytes(), 43)], "<u8").view("<i8")[0])


def low_bit_counts(distinct: np.ndarray) -> bytes:
    """How many hashes have each value of their low bits, a byte each, over as many values as there are two hashes or
    fewer; empty, which bounds nothing, if a count doesn't fit."""
    width = 1 << max(0, len(distinct) // 2 - 1).bit_length()
    counts = np.bincount((distinct & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b""


def most_shared(a: bytes, b: bytes) -> float:
    """No two sets with these counts share more hashes than this."""
    if not a or not b:
        return math.inf
    x, y = (np.frombuffer(c, np.uint8).astype(np.int64) for c in (a, b))
    width = min(len(x), len(y))
    return int(np.minimum(x.reshape(-1, width).sum(axis=0), y.reshape(-1, width).sum(axis=0)).sum())


def prefix(distinct: np.ndarray, common: np.ndarray, weight: np.ndarray, threshold: float) -> np.ndarray:
    """The first hashes of a set in the order of (commonness, hash), as many as a similar set can't all miss."""
    n = len(distinct)
    if not n:
        return distinct
    many = n - math.ceil(threshold * n - EPSILON) + 1
    if not len(common):
        return distinct[:many]
    at = np.minimum(np.searchsorted(common, distinct), len(common) - 1)
    rank = np.where(common[at] == distinct, weight[at], 0)
    return distinct[np.argsort(rank, kind="stable")[:many]]


def _common(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted common shingles and their counts in a sample of documents. They decide an order alone, never a result."""
    n = texts.count()
    every = max(1, n // SAMPLE_DOCS)

    @F.pandas_udf("array<long>")
    def distinct(column: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, size)[1].view("<i8") for t in column], dtype=object)

    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select(F.explode(distinct("text")).alias("h"))
    top = sample.groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(COMMON).toArrow()
    hashes = top["h"].to_numpy().view("uint64")
    order = np.argsort(hashes)
    return hashes[order], top["count"].to_numpy()[order]


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows sorted by h, those whose h another row has, with the first row of that h as its lead."""
    held, lead = None, None  # a row that may be alone, and the first row of the h that goes on
    for rows in batches:
        if not len(rows):
            continue
        if held is not None:
            rows = pd.concat([held, rows], ignore_index=True)
        h = rows["h"].to_numpy()
        new = np.r_[True, h[1:] != h[:-1]]
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        out = rows.assign(**{f"lead_{c}": rows[c].to_numpy()[first] for c in ("key", "n", "pos")})
        shared = ~(new & np.r_[new[1:], True])
        if lead is not None and lead["h"].iloc[0] == h[0]:
            run = first == 0
            for c in ("key", "n", "pos"):
                out.loc[run, f"lead_{c}"] = lead[c].iloc[0]
            shared |= run
        else:
            lead = None
        tail = rows.iloc[[-1]]  # the last row is decided with the next batch
        lead_row = rows.iloc[[first[-1]]]
        yield out.iloc[:-1][shared[:-1]]
        if not (lead is not None and first[-1] == 0):
            lead = lead_row if first[-1] < len(rows) - 1 else None
        held = tail
    if held is not None and lead is not None:
        yield held.assign(**{f"lead_{c}": lead[c].iloc[0] for c in ("key", "n", "pos")})


def _could_be(na: Column, i: Column, nb: Column, j: Column, threshold: float) -> Column:
    """Whether sets of these sizes, whose first common shingle is at these places, can be similar enough."""
    lengths = F.least(na, nb) >= threshold * F.greatest(na, nb) - EPSILON
    return lengths & (F.least(na - i, nb - j) >= threshold / (1 + threshold) * (na + nb) - EPSILON)


def _possible(pairs: DataFrame, counts: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (a, b) of set keys, those that the bound of `counts` (key, n, counts) leaves."""

    @F.pandas_udf("int")
    def most(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([min(most_shared(x, y), 2**31 - 1) for x, y in zip(a, b, strict=True)], dtype="int32")

    both = pairs.join(counts.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("counts").alias("ca")), "a")
    both = both.join(counts.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("counts").alias("cb")), "b")
    need = threshold / (1 + threshold) * (F.col("na") + F.col("nb")) - EPSILON
    return both.where(most("ca", "cb") >= need).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, prints: DataFrame, bases: DataFrame, size: int, threshold: float) -> DataFrame:
    """Of pairs (a, b) of set keys with different roots, those whose sets have the similarity, as a written table."""
    for end in ("a", "b"):
        pairs = pairs.join(bases.select(F.col("key").alias(end), F.col("root").alias(f"root_{end}")), end)
    pairs = pairs.where("root_a <> root_b").select("a", "b")
    counts = prints.groupBy("key").agg(F.first("n").alias("n"), F.first("counts").alias("counts"))
    pairs = written(_possible(pairs, counts, threshold), "pairs")
    if pairs.isEmpty():
        return pairs
    needed = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    ids = prints.join(needed, "key", "left_semi").groupBy("key").agg(F.min("id").alias("of")).select("of").distinct()
    ids = written(ids, "ids")  # its size is known, so that few ids are broadcast and the texts stay where they are
    held = texts.join(ids, F.col("id").eqNullSafe(F.col("of")), "left_semi")

    @F.pandas_udf("key long, hs array<long>")
    def sets(column: pd.Series) -> pd.DataFrame:
        made = [shingle_set(t, size)[1] for t in column]
        return pd.DataFrame({"key": [set_key(s) for s in made], "hs": [s.view("<i8") for s in made]})

    # a filter on the key would otherwise be moved below the join with the ids, and all texts be hashed for it
    sets = sets.asNondeterministic()
    held = held.select(sets("text").alias("s")).select("s.key", "s.hs").join(needed, "key", "left_semi")
    held = written(held.dropDuplicates(["key"]), "sets")
    both = pairs.join(held.select(F.col("key").alias("a"), F.col("hs").alias("x")), "a")
    both = both.join(held.select(F.col("key").alias("b"), F.col("hs").alias("y")), "b")
    both = both.select("a", "b", F.size("x").alias("na"), F.size("y").alias("nb"), F.size(F.array_intersect("x", "y")).alias("both"))
    both = both.where(F.col("both") >= threshold * (F.col("na") + F.col("nb") - F.col("both")) - EPSILON)
    links = written(both.select("a", "b"), "links")
    for done in (pairs, ids, held):
        discard(done)
    return links


def _components(bases: DataFrame, links: DataFrame) -> DataFrame:
    """(key, root) of `bases`, a written table, once the links (a, b) between keys have joined their roots, as another."""
    if links.isEmpty():
        return bases
    ends = links.join(bases.select(F.col("key").alias("a"), F.col("root").alias("ra")), "a")
    ends = ends.join(bases.select(F.col("key").alias("b"), F.col("root").alias("rb")), "b").select("ra", "rb")
    joined = connected_components(ends).withColumnRenamed("root", "now")
    after = bases.join(joined, bases["root"] == joined["node"], "left").select("key", F.coalesce("now", "root").alias("root"))
    return written(after, "bases")


def similar_components(texts: DataFrame, prints: DataFrame, bases: DataFrame, size: int, threshold: float) -> DataFrame:
    """(key, root) of the distinct sets' keys, joined beyond their roots in `bases` wherever two sets have at least the
    similarity; no such pair stays apart.

    `texts` has id and text; `prints` one row for each of its rows, with id, key, n and the set's prefix and counts.
    """
    firsts = prints.where("n > 0").groupBy("key").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    rows = firsts.select("key", "n", F.posexplode("prefix").alias("pos", "h"))
    # keys are hashes: the set of the lowest key is any of those that share a shingle, and the same one for many shingles
    rows = rows.repartition("h").sortWithinPartitions("h", "key")
    schema = "key long, n int, pos int, h long, lead_key long, lead_n int, lead_pos int"
    met = written(rows.mapInPandas(_meet, schema), "met")
    pair = (F.least("lead_key", "key").alias("a"), F.greatest("lead_key", "key").alias("b"))

    for turn in range(LEADS):
        if turn:
            placed = _apart(met, bases)
            # another set of each shingle leads now
            order = F.xxhash64("key", F.lit(turn))
            leads = placed.groupBy("h").agg(F.min_by(F.struct("key", "n", "pos", "root"), order).alias("lead"))
            led = placed.join(leads.select("h", *[F.col(f"lead.{c}").alias(f"lead_{c}") for c in ("key", "n", "pos", "root")]), "h")
            led = led.where("root <> lead_root")
        else:
            led = met.where("key <> lead_key")
        could = _could_be(F.col("lead_n"), F.col("lead_pos"), F.col("n"), F.col("pos"), threshold)
        links = _verified(led.where(could).select(*pair).distinct(), texts, prints, bases, size, threshold)
        bases = _components(bases, links)

    placed = _apart(met, bases)
    x, y = placed.alias("x"), placed.alias("y")
    could = _could_be(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), threshold)
    others = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.key") < F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & could)
    others = others.select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()
    bases = _components(bases, _verified(others, texts, prints, bases, size, threshold))
    discard(met)
    return bases


def _apart(met: DataFrame, bases: DataFrame) -> DataFrame:
    """(h, key, n, pos, root) of the shingles that sets of different roots share."""
    placed = met.select("h", "key", "n", "pos").join(bases, "key")
    apart = placed.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h")
    return placed.join(apart, "h", "left_semi")


def keep_one(
    docs: DataFrame, size: int = 5, threshold: float = 0.8, radius: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """`docs` with one document of each group that links reach, that of the lowest id; columns stay as they are.

    Two documents link where their fingerprints differ in at most `radius` bits or their sets of `size`-word shingles
    (words as in `simhash.fingerprint`) have a Jaccard similarity of at least `threshold`. Ids as in `simhash.keep_one`.
    Null and empty texts have an empty set and meet by their fingerprint; an empty table stays empty; a very long text
    takes part whole, its set travelling only where the bound on shared shingles asks for it.
    """
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    common, weight = _common(texts, size)

    @F.pandas_udf("fp long, key long, n int, prefix array<long>, counts binary")
    def described(column: pd.Series) -> pd.DataFrame:
        out = []
        for text in column:
            h, distinct = shingle_set(text, size)
            fp = np.array([simhash.majority(h)], "uint64").view("int64")[0]
            first = prefix(distinct, common, weight, threshold).view("<i8")
            out.append((fp, set_key(distinct), len(distinct), first, low_bit_counts(distinct)))
        return pd.DataFrame(out, columns=["fp", "key", "n", "prefix", "counts"])

    prints = written(texts.select("id", described("text").alias("d")).select("id", "d.*"), "prints")
    # one graph of set keys: a set's other fingerprints lead to it, and fingerprints' links to the lowest set of each
    pairs = written(prints.select("fp", "key").distinct(), "placed")
    of_fp = pairs.groupBy("fp").agg(F.min("key").alias("low"))
    tries = simhash.hamming_links(of_fp.select("fp"), radius)
    tries = tries.join(of_fp.select(F.col("fp").alias("child"), F.col("low").alias("a")), "child")
    tries = tries.join(of_fp.select(F.col("fp").alias("root"), F.col("low").alias("b")), "root").select("a", "b")
    several = pairs.join(of_fp, "fp").where("key <> low").select("key", "low")
    merged = connected_components(tries.union(several))
    keys = pairs.select("key").distinct()
    bases = keys.join(merged, keys["key"] == merged["node"], "left").select("key", F.coalesce("root", "key").alias("root"))
    ends = similar_components(texts, prints, written(bases, "bases"), size, threshold)
    ends = prints.select("id", "key").join(ends, "key").select("id", F.col("root").alias("end"))
    lowest = ends.groupBy("end").agg(F.min("id").alias("head")).select("head").distinct()
    return simhash.keep_rows(docs, lowest, id_col, text_col)
