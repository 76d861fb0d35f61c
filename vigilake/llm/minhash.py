"""MinHash near-duplicates with min-max hashing: each permutation gives the least and the greatest value of a set.

Half as many permutations as values are evaluated. The values are banded: GROUPS groups of ROWS permutations make a band
of their minima and one of their maxima, so two sets of Jaccard similarity s meet in no band with a probability of about
(1 - s^ROWS)^(2 GROUPS), which is 1.3e-7 at 0.8. Links are confirmed on the full sets of shingles.

Equal sets are one set throughout. Sets that share bands are first compared with one other each, the most alike of the
bands' leads; what that joins needs no more pairs. In the bands that still hold sets of different components, blocks of
sets are compared inside tasks, and only links that join two components leave them, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.llm import simhash
from vigilake.llm.graph import connected_components
from vigilake.llm.storage import discard, written

#: Permutations of a band, and groups of permutations; each group makes two bands.
ROWS, GROUPS = 5, 20
PERMUTATIONS, BANDS, VALUES = ROWS * GROUPS, 2 * GROUPS, 2 * ROWS * GROUPS
#: Sets with the similarity agree in fewer values than this many standard deviations below the mean about once in 1e7.
DEVIATIONS = 5.2
#: Hashes that are permuted at once, and sets of a band that are compared with as many others at once.
STEP_HASHES, GROUP_SETS = 2_048, 2_048
#: Texts whose rows are broadcast to find them again; of more, the texts are shuffled to a join.
BROADCAST_ROWS = 1_000_000

_random = np.random.Generator(np.random.PCG64(12))
XORS = _random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
FACTORS = _random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def min_max(distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest value of a non-empty set of hashes under each permutation."""
    least, greatest = np.full(PERMUTATIONS, ~np.uint64(0)), np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(distinct), STEP_HASHES):
        turned = (distinct[at : at + STEP_HASHES, None] ^ XORS) * FACTORS
        np.minimum(least, turned.min(axis=0), out=least)
        np.maximum(greatest, turned.max(axis=0), out=greatest)
    return least, greatest


def banded(least: np.ndarray, greatest: np.ndarray) -> list[int]:
    """One signed long for each band."""
    out = []
    for g in range(GROUPS):
        part = slice(g * ROWS, (g + 1) * ROWS)
        out += [xxhash.xxh64_intdigest(x[part].tobytes(), 2 * g + k) for k, x in enumerate((least, greatest))]
    return np.array(out, np.uint64).view(np.int64).tolist()


def short_values(least: np.ndarray, greatest: np.ndarray) -> bytes:
    """Sixteen bits of each value, by which similarity is estimated."""
    return (np.concatenate([least, greatest]) >> np.uint64(24)).astype("<u2").tobytes()


def least_agreeing(threshold: float) -> int:
    """Values in which sets of this similarity agree, but for about one pair in 1e7."""
    return int(VALUES * threshold - DEVIATIONS * (VALUES * threshold * (1 - threshold)) ** 0.5)


def _described(size: int):
    def of(text: str | None) -> tuple:
        distinct = np.unique(simhash.shingle_hashes(text, size))
        if not len(distinct):
            return b"", 0, None, None
        both = min_max(distinct)
        return xxhash.xxh128_digest(distinct.tobytes(), 7), len(distinct), banded(*both), short_values(*both)

    @F.pandas_udf("key binary, n int, bands array<long>, short binary")
    def described(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([of(t) for t in texts], columns=["key", "n", "bands", "short"])

    return described


def _long_enough(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _agreement(x: Column, y: Column) -> Column:
    """In how many values two sets agree."""

    @F.pandas_udf("int")
    def agreeing(a: pd.Series, b: pd.Series) -> pd.Series:
        values = [np.frombuffer(b"".join(s), "<u2").reshape(-1, VALUES) for s in (a, b)]
        return pd.Series((values[0] == values[1]).sum(axis=1, dtype=np.int32))

    return agreeing(x, y)


def _estimated(pairs: DataFrame, sets: DataFrame, threshold: float, percent: int) -> DataFrame:
    """Of pairs (a, b), those that may have the similarity, with the values in which they agree."""
    for end in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("sid").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("n", "short")]), end)
    pairs = pairs.where(_long_enough(F.col("n_a"), F.col("n_b"), percent))
    pairs = pairs.select("a", "b", _agreement(F.col("short_a"), F.col("short_b")).alias("agree"))
    return pairs.where(F.col("agree") >= least_agreeing(threshold))


def _texts_of(sids: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """(sid, text) of the sets' first documents."""
    needed = sids.join(sets.select("sid", "id", "th"), "sid").select("sid", F.col("id").alias("of"), F.col("th").alias("of_th"))
    needed = written(needed, "needed")
    rows = F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed
    found = texts.join(rows, (F.col("th") == F.col("of_th")) & F.col("id").eqNullSafe(F.col("of")))
    return found.select("sid", "text").dropDuplicates(["sid"])


def _confirmed(pairs: DataFrame, sets: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets have the similarity, as a written table."""
    sids = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    held = written(_texts_of(sids, sets, texts), "held")
    both = pairs.join(held.select(F.col("sid").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(held.select(F.col("sid").alias("b"), F.col("text").alias("text_b")), "b")

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last = [], {}  # the join leaves rows with one set next to each other
            for k in range(batch.num_rows):
                now = {batch.column(end)[k].as_py(): end for end in (0, 1)}
                last = {
                    sid: last[sid] if sid in last else np.unique(simhash.shingle_hashes(batch.column(end + 2)[k].as_py(), size))
                    for sid, end in now.items()
                }
                x, y = last.values()
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    links = written(both.select("a", "b", "text_a", "text_b").mapInArrow(similar, "a long, b long"), "links")
    discard(held)
    return links


def _joined(bases: DataFrame, links: DataFrame) -> DataFrame:
    """(sid, root) of `bases` once the links (a, b) between sets have joined their roots, written; the old table goes."""
    ends = links.join(bases.select(F.col("sid").alias("a"), F.col("root").alias("ra")), "a")
    ends = ends.join(bases.select(F.col("sid").alias("b"), F.col("root").alias("rb")), "b").select("ra", "rb")
    merged = connected_components(ends).withColumnRenamed("root", "now")
    after = bases.join(merged, bases["root"] == merged["node"], "left").select("sid", F.coalesce("now", "root").alias("root"))
    after = written(after, "bases")
    discard(bases)
    discard(links)
    return after


def _best(pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b, agree), for each set the one that agrees most: no more pairs than sets."""
    ends = pairs.select("a", "b", "agree").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "agree"))
    best = ends.groupBy("a").agg(F.max_by("b", F.struct("agree", "b")).alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


GROUP_KEY = ["band", "part_a", "part_b"]


def joining_links(rows: pd.DataFrame, percent: int, least: int) -> list[tuple[int, int]]:
    """Links (a, b) between sets of one group, of two parts or one, that join its roots as far as the similarity does.

    Pairs are of fitting sizes, share no earlier band and agree in `least` values or more; their intersection is counted
    on the hashes' lower halves.
    """
    sid, root, n, own = (rows[c].to_numpy() for c in ("sid", "root", "n", "own"))
    part_a, part_b, place = (int(rows[c].iloc[0]) for c in ("part_a", "part_b", "place"))
    short = np.frombuffer(b"".join(rows["short"]), "<u2").reshape(-1, VALUES)
    bands = np.frombuffer(b"".join(rows["bands"]), "<u4").reshape(-1, BANDS)[:, :place]
    ids = np.unique(np.frombuffer(b"".join(rows["halves"]), "<u4"), return_inverse=True)[1]
    ends = np.concatenate([[0], np.cumsum([len(h) // 4 for h in rows["halves"]])])
    marked = np.zeros(int(ids.max(initial=-1)) + 1, bool)
    parent = np.unique(root, return_inverse=True)[1]  # of each row, the set that its root is in so far
    in_a, in_b = np.flatnonzero(own == part_a), np.flatnonzero(own == part_b)
    links = []
    for x in in_a:
        y = in_b[in_b > x] if part_a == part_b else in_b
        y = y[(parent[y] != parent[x]) & (100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x]))]
        if len(y):
            y = y[~(bands[y] == bands[x]).any(axis=1)]
        if len(y):
            y = y[(short[y] == short[x]).sum(axis=1) >= least]
        if not len(y):
            continue
        mine = ids[ends[x] : ends[x + 1]]
        marked[mine] = True
        both = np.array([np.count_nonzero(marked[ids[ends[k] : ends[k + 1]]]) for k in y])
        marked[mine] = False
        for k in y[100 * both >= percent * (n[x] + n[y] - both)]:
            if parent[k] != parent[x]:
                parent[parent == parent[k]] = parent[x]
                links.append((int(min(sid[x], sid[k])), int(max(sid[x], sid[k]))))
    return links


def _joining(percent: int, least: int):
    """`joining_links` of the groups in rows sorted by GROUP_KEY."""

    def of_group(held: list[pd.DataFrame]) -> pd.DataFrame:
        links = joining_links(pd.concat(held, ignore_index=True), percent, least)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for rows in batches:
            if not len(rows):
                continue
            keys = rows[GROUP_KEY].to_numpy()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(rows)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if held and (held[-1][GROUP_KEY].iloc[-1] != rows[GROUP_KEY].iloc[lo]).any():
                    yield of_group(held)
                    held = []
                held.append(rows.iloc[lo:hi])
        if held:
            yield of_group(held)

    return run


def _remaining(met: DataFrame, bases: DataFrame, sets: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) that join what is still apart, of sets that share a band, as a written table."""
    placed = met.select("band", "place", "sid").join(bases, "sid")
    of_band = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("many"))
    parts = F.ceil(F.col("many") / F.lit(GROUP_SETS)).cast("int")
    of_band = of_band.where("lo <> hi").select("band", parts.alias("parts"))
    mixed = written(placed.join(of_band, "band"), "mixed")

    @F.pandas_udf("binary")
    def halves(column: pd.Series) -> pd.Series:
        return pd.Series([np.unique(simhash.shingle_hashes(t, size)).astype("<u4").tobytes() for t in column], dtype=object)

    @F.pandas_udf("binary")
    def narrow(bands: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(b, np.int64).astype("<u4").tobytes() for b in bands], dtype=object)

    held = _texts_of(mixed.select("sid").distinct(), sets, texts)
    held = held.select("sid", halves("text").alias("halves")).join(sets.select("sid", "n", "short", narrow("bands").alias("bands")), "sid")
    held = written(held, "halves")
    dealt = mixed.withColumn("own", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumn("part_a", F.least("own", "other")).withColumn("part_b", F.greatest("own", "other"))
    dealt = dealt.join(held, "sid").select(*GROUP_KEY, "place", "own", "sid", "root", "n", "bands", "short", "halves")
    dealt = dealt.repartition(*GROUP_KEY).sortWithinPartitions(*GROUP_KEY)
    found = written(dealt.mapInPandas(_joining(percent, least_agreeing(percent / 100)), "a long, b long").distinct(), "joining")
    discard(mixed)
    discard(held)
    return found


def near_duplicates(
    docs: DataFrame, size: int = 2, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: its id, `n_shingles`, `component_id` (the lowest id that links reach) and `kept`, whether
    that is its own id.

    A document's set are its distinct `size`-word shingles, A-Z lower-cased, words as in `simhash.shingle_hashes`; fewer
    words are one shingle. Two sets link if 100 times what they share is at least `percent` times their union. Documents
    without words or text have an empty set and link with nothing, not even one another: their own id is the component's.

    A null id is a component's only where all its ids are null. Repeated rows give a row each, all kept if one is; an
    empty table gives none; other columns aren't read. A very long text takes part whole: its hashes are permuted in
    steps, and the text itself travels only for pairs that its values leave.
    """
    threshold = percent / 100
    text = F.col(f"`{text_col}`").cast("string")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("th"))
    prints = written(texts.select("id", "th", _described(size)("text").alias("d")).select("id", "th", "d.*"), "prints")
    sets = prints.where("n > 0").groupBy("key").agg(
        F.min("id").alias("lowest"), F.min(F.struct("id", "th")).alias("one"), F.first("n").alias("n"),
        F.first("bands").alias("bands"), F.first("short").alias("short"),
    )
    sets = sets.select(F.monotonically_increasing_id().alias("sid"), "key", "lowest", "one.id", "one.th", "n", "bands", "short")
    sets = written(sets, "sets")

    rows = sets.select("sid", F.posexplode("bands").alias("place", "band"))
    leads = rows.groupBy("band").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo <> hi")
    met = written(rows.join(leads, "band"), "met")
    led = met.select("sid", F.explode(F.array("lo", "hi")).alias("lead")).where("lead <> sid")
    led = led.select(F.least("sid", "lead").alias("a"), F.greatest("sid", "lead").alias("b")).distinct()
    led = written(_estimated(led, sets, threshold, percent), "led")

    bases = written(sets.select("sid", F.col("sid").alias("root")), "bases")
    first = written(_best(led), "first")
    bases = _joined(bases, _confirmed(first, sets, texts, size, percent))
    others = _remaining(met, bases, sets, texts, size, percent)
    bases = _joined(bases, _confirmed(others, sets, texts, size, percent))

    member = sets.select("key", "sid", "lowest").join(bases, "sid")
    lowest = member.groupBy("root").agg(F.min("lowest").alias("component"))
    member = written(member.join(lowest, "root").select("key", "component"), "member")
    for done in (met, led, first, others, bases, sets):
        discard(done)
    ident, component = F.col("id"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component"))
    found = prints.select("id", "n", "key").join(member, "key", "left")
    return found.select(
        ident.alias(id_col), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"),
        ident.eqNullSafe(component).alias("kept"),
    )
