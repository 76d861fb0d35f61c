"""Phrase collocations: frequent words become numbers, phrases of two or three of them fixed-width keys, and the keys are
dealt out by ranges, radix-sorted and counted by run lengths.

Texts stay in blocks of about BLOCK_WORDS words in the order they are read. A block's own words are counted in the task
that reads it; their sums over the corpus make the dictionary of frequent words, and each block gets the part of the
dictionary that it needs, ahead of its texts. So no task holds more than one block's words, and nothing is broadcast.
Words that aren't frequent break pieces, as no frequent phrase holds one.

A key is multiplied by an odd number modulo its range, which only permutes the keys: equal ranges of them are then
equally full, without a sample, however often a phrase occurs. What a task has counted of a range travels as one row,
the sorted keys as byte planes of their differences, a third of what a row for each key would take.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.llm.storage import discard, written

#: Words of a block (about), and bytes after which a text is cut at its next break between pieces.
BLOCK_WORDS, CHUNK_BYTES = 1_000_000, 1 << 20
#: Words whose phrases are sorted and counted at once in a task, before they are shuffled.
STEP_WORDS = 1_000_000
#: Keys (about, and at most) that meet in a range, and ranges at least.
RANGE_KEYS, RANGES = 2_000_000, 64
#: Texts that are Python values at once.
STEP_TEXTS = 256
#: Odd, so that multiplying by it permutes the keys.
MIX = 0x9E3779B97F4A7C15
#: Breaks between pieces become full stops, tabs blanks, and A-Z lower case.
FOLD = bytes.maketrans(
    b".,;:!?\x0a\x0b\x0c\x0d\x09ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"." * 10 + b" abcdefghijklmnopqrstuvwxyz"
)
BREAK = b"."
LONG_BITS, WIDE_BITS = 63, 31


def words_and_breaks(folded: bytes) -> list[bytes]:
    """The words of a folded text in order, with BREAK, which no word is, between pieces."""
    return folded.replace(BREAK, b" . ").split()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, STEP_TEXTS):
            yield batch.slice(at, STEP_TEXTS)


def chunks(folded: bytes) -> Iterator[bytes]:
    """A folded text, cut between pieces where it is long; no phrase crosses a cut."""
    at = 0
    while len(folded) - at > CHUNK_BYTES:
        cut = folded.find(BREAK, at + CHUNK_BYTES)
        if cut < 0:
            break
        yield folded[at:cut]
        at = cut + 1
    yield folded[at:]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, lang, word, n, text): a block's texts, folded, and how often it has each word of a language."""
    import pyspark

    block = pyspark.TaskContext.get().partitionId() << 32
    counts: dict[str, Counter] = defaultdict(Counter)
    held = 0

    def counted() -> Iterator[pa.RecordBatch]:
        for lang, words in counts.items():
            words.pop(BREAK, None)
            n = len(words)
            yield _rows([block] * n, [lang] * n, list(words), list(words.values()), [None] * n)
        counts.clear()

    for batch in _slices(batches):
        blocks, langs, texts = [], [], []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for part in chunks(text.translate(FOLD)):
                if held >= BLOCK_WORDS:
                    yield from counted()
                    block, held = block + 1, 0
                ws = words_and_breaks(part)
                counts[lang].update(ws)
                held += len(ws)
                blocks.append(block)
                langs.append(lang)
                texts.append(part)
        yield _rows(blocks, langs, [None] * len(blocks), [None] * len(blocks), texts)
    yield from counted()


def _rows(blocks: list, langs: list, words: list, n: list, texts: list) -> pa.RecordBatch:
    columns = [(blocks, pa.int64()), (langs, pa.string()), (words, pa.binary()), (n, pa.int64()), (texts, pa.binary())]
    return pa.RecordBatch.from_arrays(
        [pa.array(values, kind) for values, kind in columns], names=["block", "lang", "word", "n", "text"]
    )


def pack(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys (key, rest) and their counts of the phrases of two and three words in `ids`, where 0 breaks.

    With ids of `bits` bits that fit a long three times, `key` is the whole phrase (a third id of 0 for two words) and
    `rest` is 0; else `key` has the first two ids of WIDE_BITS bits and `rest` the third.
    """
    if len(ids) < 2:
        return (np.zeros(0, np.int64),) * 3
    two = (ids[:-1] > 0) & (ids[1:] > 0)
    three = two[:-1] & two[1:]
    if 3 * bits <= LONG_BITS:
        first = (ids[:-1] << (2 * bits)) | (ids[1:] << bits)
        key, n = np.unique(np.concatenate([first[two], first[:-1][three] | ids[2:][three]]), return_counts=True)
        return key, np.zeros(len(key), np.int64), n
    pair, number, n = np.unique((ids[:-1] << WIDE_BITS) | ids[1:], return_inverse=True, return_counts=True)
    whole = np.unique(number[two])
    triple, m = np.unique((number[:-1][three] << WIDE_BITS) | ids[2:][three], return_counts=True)
    key = np.concatenate([pair[whole], pair[triple >> WIDE_BITS]])
    rest = np.concatenate([np.zeros(len(whole), np.int64), triple & ((1 << WIDE_BITS) - 1)])
    return key, rest, np.concatenate([n[whole], m])


def mixed(key: np.ndarray, width: int, back: bool = False) -> np.ndarray:
    """The key's place among all of `width` bits, by a fixed permutation; or back to the key."""
    factor = pow(MIX, -1, 1 << width) if back else MIX % (1 << width)
    return (key.astype(np.uint64) * np.uint64(factor) & np.uint64((1 << width) - 1)).astype(np.int64)


def radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """The order that sorts by the non-negative longs `keys`, the last of them first: stable sorts by digits of 16 bits."""
    order = np.arange(len(keys[0]))
    for values in keys:
        for shift in range(0, int(values.max(initial=0)).bit_length(), 16):
            digit = (values >> shift).astype(np.uint16)
            order = order[np.argsort(digit[order], kind="stable")]
    return order


def planes(values: np.ndarray) -> bytes:
    """Non-negative longs as byte planes, the lowest first; the planes above the greatest value's are left out."""
    many = (int(values.max(initial=0)).bit_length() + 7) // 8
    return values.astype("<i8").view(np.uint8).reshape(-1, 8).T[:many].tobytes()


def of_planes(raw: bytes, n: int) -> np.ndarray:
    whole = np.zeros((8, n), np.uint8)
    flat = np.frombuffer(raw, np.uint8)
    if n:
        whole[: len(flat) // n] = flat.reshape(-1, n)
    return np.ascontiguousarray(whole.T).view("<i8").ravel().astype(np.int64)


def _key_width(bits: int) -> int:
    return 3 * bits if 3 * bits <= LONG_BITS else 2 * WIDE_BITS


KEYS = "part long, many int, keys binary, rests binary, counts binary"


def _counted(ids: np.ndarray, bits: int, ranges: int) -> pa.RecordBatch:
    """The phrases in `ids`, counted, as a row for each range of mixed keys that has any."""
    key, rest, n = pack(ids, bits)
    width = _key_width(bits)
    place = mixed(key, width)
    del key
    order = np.lexsort((rest, place)) if 3 * bits > LONG_BITS else np.argsort(place)
    place, rest, n = place[order], rest[order], n[order]
    part = place // (((1 << width) - 1) // ranges + 1)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)] if len(part) else [0]
    rows = [
        (int(part[a]), b - a, planes(np.diff(place[a:b], prepend=0)), planes(rest[a:b]), planes(n[a:b]))
        for a, b in zip(cuts, cuts[1:], strict=False)
    ]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    names = ["part", "many", "keys", "rests", "counts"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _keys(bits: int, ranges: int):
    """From a block's dictionary and its texts, in this order, to counted keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids = None, {}
        gathered, held = [], 0
        for batch in _slices(batches):
            columns = (batch.column(name).to_pylist() for name in ("block", "lang", "word", "id", "text"))
            for block, lang, word, number, text in zip(*columns, strict=True):
                if block != at:
                    at, ids = block, defaultdict(dict)
                if text is None:
                    ids[lang][word] = number
                    continue
                ws = words_and_breaks(text)
                gathered.append(np.fromiter(map(ids[lang].get, ws, repeat(0)), np.int64, len(ws)))
                gathered.append(np.zeros(1, np.int64))
                held += len(ws) + 1
                if held >= STEP_WORDS:
                    yield _counted(np.concatenate(gathered), bits, ranges)
                    gathered, held = [], 0
        if gathered:
            yield _counted(np.concatenate(gathered), bits, ranges)

    return run


def _run_lengths(bits: int, min_count: int):
    """From the rows of a range, next to one another, to one row a key of `min_count` or more."""

    def frequent(rows: list[tuple]) -> pa.RecordBatch:
        place = np.concatenate([np.cumsum(of_planes(keys, many)) for many, keys, _, _ in rows])
        rest, n = (np.concatenate([of_planes(row[k], row[0]) for row in rows]) for k in (2, 3))
        order = radix_order([rest, place])
        place, rest, n = place[order], rest[order], n[order]
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | (rest[1:] != rest[:-1])
        first = np.flatnonzero(new)
        total = np.add.reduceat(n, first)
        first, total = first[total >= min_count], total[total >= min_count]
        columns = [mixed(place[first], _key_width(bits), back=True), rest[first], total]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "rest", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            columns = (batch.column(name).to_pylist() for name in ("part", "many", "keys", "rests", "counts"))
            for part, *row in zip(*columns, strict=True):
                if part != at and held:
                    yield frequent(held)
                    held = []
                at = part
                held.append(tuple(row))
        if held:
            yield frequent(held)

    return run


def _dictionary(requests: DataFrame, min_count: int) -> DataFrame:
    """(lang, word, f, id): the frequent words of each language, numbered from 1 without gaps over all languages."""
    total = requests.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
    # the numbers are taken while the rows are written, so that all who read them see the same
    made = written(total.withColumn("nth", F.monotonically_increasing_id()), "dictionary")
    part = F.shiftright("nth", 33)
    sizes = sorted(made.groupBy(part.alias("part")).count().collect())  # a row for each partition
    starts, before = [], 0
    for row in sizes:
        starts.append((row["part"], before))
        before += row["count"]
    starts = made.sparkSession.createDataFrame(starts, "part long, before long")
    low = F.col("nth").bitwiseAND(F.lit((1 << 33) - 1))
    return made.join(F.broadcast(starts), part == F.col("part")).select(
        "lang", "word", "f", (F.col("before") + low + 1).alias("id")
    )


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)), exact for counts below 1e16."""
    a, left, right = (F.col(c).cast("decimal(19,0)") for c in (a, left, right))
    return F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(7,0)"), left * right)


def _phrases(grams: DataFrame, words: DataFrame, bits: int, inside_percent: int) -> DataFrame:
    """The candidates that stay, as (lang, phrase, a, l, r, score)."""
    if 3 * bits <= LONG_BITS:
        mask = F.lit((1 << bits) - 1)
        ids = [F.shiftright("key", 2 * bits), F.shiftright("key", bits).bitwiseAND(mask), F.col("key").bitwiseAND(mask)]
    else:
        ids = [F.shiftright("key", WIDE_BITS), F.col("key").bitwiseAND(F.lit((1 << WIDE_BITS) - 1)), F.col("rest")]
    grams = grams.select(*[c.alias(f"id{k}") for k, c in enumerate(ids, 1)], "a")
    two = grams.where("id3 = 0").drop("id3")

    def named(k: int) -> DataFrame:
        return words.select(F.col("id").alias(f"id{k}"), F.col("word").alias(f"w{k}"), F.col("f").alias(f"f{k}"))

    pair = lambda x, y: two.select(F.col("id1").alias(f"id{x}"), F.col("id2").alias(f"id{y}"), F.col("a").alias(f"f{x}{y}"))
    three = grams.where("id3 > 0").join(pair(1, 2), ["id1", "id2"]).join(pair(2, 3), ["id2", "id3"])
    longer = three.select("id1", "id2", "a").union(three.select("id2", "id3", "a"))
    longer = longer.groupBy("id1", "id2").agg(F.max("a").alias("longest"))
    two = two.join(longer, ["id1", "id2"], "left").where(
        f"longest IS NULL OR 100 * longest < {int(inside_percent)} * a"
    )
    lang = words.select(F.col("id").alias("id1"), "lang")
    two = two.join(named(1), "id1").join(named(2), "id2").join(lang, "id1")
    two = two.select(
        "lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"),
        _score("a", "f1", "f2").alias("score"),
    )
    three = three.join(named(1), "id1").join(named(2), "id2").join(named(3), "id3").join(lang, "id1")
    three = three.withColumn("s1", _score("a", "f1", "f23")).withColumn("s2", _score("a", "f12", "f3"))
    later = F.col("s2") < F.col("s1")
    three = three.select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a",
        F.when(later, F.col("f12")).otherwise(F.col("f1")).alias("l"),
        F.when(later, F.col("f3")).otherwise(F.col("f23")).alias("r"), F.least("s1", "s2").alias("score"),
    )
    return two.unionByName(three)


def _ranked(found: DataFrame, top: int) -> DataFrame:
    """The first `top` rows of each language with their rank, and the table under it. Rows are sorted over ranges, so a
    language of any size is spread over tasks; a row's rank is its place in its range after the ranges before."""
    order = [F.col("lang"), F.desc("score"), F.desc("a"), F.col("phrase")]
    sorted_rows = found.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(sorted_rows.withColumn("nth", F.monotonically_increasing_id()), "ranked")
    placed_part = placed.withColumn("part", F.shiftright("nth", 33))
    spans = placed_part.groupBy("lang", "part").agg(F.count("*").alias("many"), F.min("nth").alias("first"))
    earlier = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("before", F.coalesce(F.sum("many").over(earlier), F.lit(0))).where(F.col("before") < top)
    rank = F.col("before") + F.col("nth") - F.col("first") + 1
    return placed_part.join(spans, ["lang", "part"]).withColumn("rank", rank).where(F.col("rank") <= top)


def collocations(
    docs: DataFrame, min_count: int = 10, inside_percent: int = 50, top: int = 2000,
    text_col: str = "text", lang_col: str = "lang", bits: int | None = None,
) -> DataFrame:
    """The best phrases of two and three words of each language: lang, rank, phrase, a, l, r, n, score.

    Texts have A-Z lower-cased, split into pieces at `[.,;:!?\\x0A-\\x0D]` and pieces into words `[^\\x20\\x09]+`. Phrases
    of `min_count` occurrences or more are candidates; a is a phrase's count, l and r those of its two parts at the cut of
    the lowest score (the earlier one at ties), the score floor(1000000 a a / (l r)), n the language's words. A candidate
    inside a longer one with `inside_percent` of its count or more goes. Ranks follow score and count, falling, then the
    phrase's bytes.

    A null text is empty, a null language `und`, one with that name. Languages without a phrase and an empty table give
    no rows; repeated rows count each time; other columns, whatever their names, aren't read; a very long text is cut
    between pieces into parts, which no phrase crosses. `bits` may ask for wider ids than the dictionary needs.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), text.alias("text"))
    blocks = written(texts.mapInArrow(_blocks, "block long, lang string, word binary, n long, text binary"), "blocks")
    requests = blocks.where("word IS NOT NULL").select("block", "lang", "word", "n")
    words = written(_dictionary(requests, min_count), "words")
    bits = max(bits or 1, words.count().bit_length())
    if bits > WIDE_BITS:
        raise ValueError(f"a dictionary of over 2^{WIDE_BITS} frequent words has no ids")

    totals = written(requests.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    ranges = max(RANGES, -(-2 * (totals.agg(F.sum("n")).first()[0] or 0) // RANGE_KEYS))  # two phrases begin at a word

    known = requests.join(words, ["lang", "word"]).select("block", "lang", "word", "id", F.lit(None).cast("binary").alias("text"))
    dealt = known.unionByName(
        blocks.where("text IS NOT NULL").select("block", "lang", "text"), allowMissingColumns=True
    )
    dealt = dealt.withColumn("later", F.col("text").isNotNull()).repartition("block").sortWithinPartitions("block", "later")
    keys = dealt.mapInArrow(_keys(bits, ranges), KEYS).repartition("part").sortWithinPartitions("part")
    grams = written(keys.mapInArrow(_run_lengths(bits, min_count), "key long, rest long, a long"), "grams")

    spelled = words.withColumn("word", F.col("word").cast("string"))
    found = written(_phrases(grams, spelled, bits, inside_percent), "phrases")
    rows = _ranked(found, top)
    for done in (found, grams, words, blocks):
        discard(done)
    return rows.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
