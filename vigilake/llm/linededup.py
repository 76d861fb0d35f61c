"""Line dedup by a deletion-neighbourhood join.

A line goes if an earlier line of the corpus has the same words, or differs from it by one word put in, left out or
replaced and is similar enough by that: the edit is at most 1 - SIMILARITY of the longer line's words. Earlier is by
(document id, the row's own hashes, line number).

Only hashes travel: equal lines meet by the hash of their words, and the first occurrence stays. Of the distinct lines,
one edit leaves the first or the last few words as they were, so lines that share neither with another line have no
near line and drop out here. The others emit their deletion variants as hashed keys; lines that share a variant are
joined, their edit distance is verified on the words, and the earliest stays.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.llm.storage import written
from vigilake.llm.text import BLANKS, SPACE_RUN, filled, let, lines, prefix_length, reversed_prefix_length, words

#: The least similarity of near lines: one less the edit's share of the longer line's words.
SIMILARITY = 0.8
#: Lengths of the compared ends; a line takes the longest that fits its half.
ENDS = (1, 2, 4, 8, 16)


def _split(line: Column) -> Column:
    """The words of a trimmed line. Most lines have single spaces alone, and a split at these needs no pattern."""
    runs = [line.contains(x) for x in ("  ", *BLANKS.replace(" ", ""))]
    return F.when(reduce(or_, runs), F.split(line, SPACE_RUN)).otherwise(F.split(line, " "))


def _ends(ws: Column) -> Column:
    """Keys of both ends. Of two lines one edit apart, the shorter has twice the length that its own tier compares, so
    the edit leaves one of the two ends alone; a line whose tier is above that of a line one word shorter emits both."""
    n = F.size(ws)
    tier = F.lit(ENDS[0])
    for length in ENDS[1:]:
        tier = F.when(n >= 2 * length, length).otherwise(tier)

    def keys(length: Column) -> list[Column]:
        parts = (("head", F.slice(ws, F.lit(1), length)), ("tail", F.slice(ws, n - length + 1, length)))
        return [F.xxhash64(F.lit(side), length, part) for side, part in parts]

    # the tiers double, so the one below is half
    both = F.array(*keys(tier), *keys((tier / 2).cast("int")))
    return F.when(n.isin([2 * length for length in ENDS[1:]]), both).when(n >= 2 * ENDS[0], F.array(*keys(tier)))


def _turned(h: Column, by: Column) -> Column:
    """The 64 bits of h rotated to the left."""
    r = F.pmod(by, F.lit(64)).cast("int")
    left, right = F.call_function("shiftleft", h, r), F.call_function("shiftrightunsigned", h, F.pmod(64 - r, F.lit(64)))
    return left.bitwiseOR(right)


def _running_xor(values: Column, span: int = 32) -> Column:
    """The xor of all values up to each; in parts of `span`, so that a long line takes linear time."""
    none = F.array().cast("array<bigint>")
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit(0).cast("long"))
    within = lambda a: F.aggregate(a, none, lambda acc, x: F.concat(acc, F.array(last(acc).bitwiseXOR(x))))
    starts = F.sequence(F.lit(1), F.size(values), F.lit(span))
    parts = F.transform(starts, lambda s: within(F.slice(values, s, span)))

    def joined(parts: Column, ends: Column) -> Column:
        before = lambda k: F.coalesce(F.get(ends, k - 1), F.lit(0).cast("long"))
        return F.flatten(F.transform(parts, lambda part, k: F.transform(part, lambda x: x.bitwiseXOR(before(k)))))

    return let(parts, lambda p: let(within(F.transform(p, lambda part: last(part))), lambda ends: joined(p, ends)))


def _hashes(ws: Column) -> Column:
    """Of a line with words: `whole`, its words' hashes, each turned by its place, in one xor; and `rests`, the same
    for the line without each of its words. The words after a lacking one move up a place, so that a rest comes from
    two parts of the whole."""

    def of(upto: Column) -> Column:
        whole = F.element_at(upto, -1)
        before = lambda i: F.coalesce(F.get(upto, i - 1), F.lit(0).cast("long"))
        rests = F.transform(upto, lambda u, i: before(i).bitwiseXOR(_turned(whole.bitwiseXOR(u), F.lit(63))))
        return F.struct(whole.alias("whole"), rests.alias("rests"))

    turned = F.transform(ws, lambda w, i: _turned(F.xxhash64(w), i))
    return let(turned, lambda t: let(_running_xor(t), of))


def _variants(lined: DataFrame) -> DataFrame:
    """Keys with roles of each line (h1, h2, n, whole, rests): 0 the whole line, 1 the line without one word (meets
    role 0 of a shorter line), 2 the same with the word's place (meets the same of a line of equal length)."""
    rest = lined.select("h1", "h2", "n", F.posexplode("rests").alias("pos", "rest"))
    keys = F.array(
        F.struct(F.xxhash64("rest", F.col("n") - 1).alias("key"), F.lit(1).alias("role")),
        F.struct(F.xxhash64("rest", "n", "pos").alias("key"), F.lit(2).alias("role")),
    )
    whole = lined.select("h1", "h2", F.xxhash64("whole", "n").alias("key"), F.lit(0).alias("role"))
    return rest.select("h1", "h2", F.inline(keys)).union(whole)


def _one_edit_apart(a: Column, b: Column) -> Column:
    """Whether two word sequences differ by at most one word put in, left out or replaced."""
    longer, shorter = F.greatest(F.size(a), F.size(b)), F.least(F.size(a), F.size(b))
    same = prefix_length(a, b) + reversed_prefix_length(a, b)
    return (longer - shorter <= 1) & (same >= longer - 1)


def _shared(keyed: DataFrame) -> DataFrame:
    """The rows whose key another line has too."""
    keys = keyed.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a != b").select("key")
    return keyed.join(keys, "key", "left_semi")


def _near_lines(firsts: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(k1, k2, line_no) of distinct lines that repeat an earlier line by one edit."""
    ends = _shared(firsts.select("h1", "h2", "n", F.explode("ends").alias("key")))
    # one edit changes the length by one at most: every length meets itself and the next
    sized = F.explode(F.array(F.xxhash64("key", "n"), F.xxhash64("key", F.col("n") + 1)))
    maybe = _shared(ends.select("h1", "h2", sized.alias("key"))).select("h1", "h2").distinct()
    # the lines' words: each document is asked for those of its own first occurrences
    wanted = maybe.join(firsts, ["h1", "h2"]).select("first", "h1", "h2")
    asked = wanted.groupBy("first.k1", "first.k2").agg(F.collect_list(F.struct("first", "h1", "h2")).alias("asked"))
    found = lambda ls: F.transform(
        "asked", lambda x: F.struct(x["first"].alias("first"), x["h1"].alias("h1"), x["h2"].alias("h2"), words(F.get(ls, x["first"]["line_no"])).alias("ws"))
    )
    told = texts.join(asked, ["k1", "k2"]).select(F.inline(let(lines(F.col("text")), found)))
    told = told.dropDuplicates(["h1", "h2"]).withColumn("made", _hashes(F.col("ws")))
    lined = written(told.select("first", "h1", "h2", "ws", F.size("ws").alias("n"), "made.*"), "lines")

    keyed = _variants(lined)
    keyed = written(_shared(keyed).join(lined.select("h1", "h2", "first"), ["h1", "h2"]), "variants")
    low = lambda role: F.min(F.when(F.col("role") == role, F.struct("first", "h1", "h2")))
    lows = keyed.groupBy("key").agg(low(0).alias("low0"), low(1).alias("low1"), low(2).alias("low2"))
    met = keyed.join(lows, "key")
    other = F.when(F.col("role") == 0, F.col("low1")).when(F.col("role") == 1, F.col("low0")).otherwise(F.col("low2"))
    pairs = met.withColumn("other", other).where(F.col("other.first") < F.col("first"))
    pairs = pairs.select("h1", "h2", F.col("other.h1").alias("o1"), F.col("other.h2").alias("o2")).distinct()
    here = lined.select("h1", "h2", "first", F.col("ws"))
    there = lined.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("ws").alias("other_ws"))
    verified = pairs.join(here, ["h1", "h2"]).join(there, ["o1", "o2"])
    verified = verified.where(_one_edit_apart(F.col("ws"), F.col("other_ws")) & _similar("ws", "other_ws", similarity))
    return verified.select("first.k1", "first.k2", "first.line_no").distinct()


def _similar(a: str, b: str, similarity: float) -> Column:
    """Whether one edit leaves lines of these lengths similar enough."""
    return 1.0 / F.greatest(F.size(a), F.size(b)) <= 1 - similarity + 1e-9


def dedup_lines(
    docs: DataFrame, edits: int = 1, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """`docs` with the lines that repeat an earlier line taken out of the text, and n_lines, n_dropped (of the text's
    newline-separated lines) added; input columns of these names give way.

    Near lines are at most `edits` (0 or 1) words apart and at least `similarity` alike by 1 - edits / words of the longer one:
    at 0.8, one word in five or more; at 0, any two lines of one word would be near.

    Lines without words stay. Null texts stay null with no lines; an empty text has one line. Rows with equal id and
    text count as one document and get equal results; rows with one id and different texts are different documents;
    null ids come first. A table without rows gives none. Very long texts and lines are treated whole, in time that
    grows with their length.
    """
    if edits not in (0, 1):
        raise ValueError("edits must be 0 or 1")
    text, ident = F.col(f"`{text_col}`").cast("string"), F.col(f"`{id_col}`")
    texts = docs.select(
        F.struct("*").alias("row"),
        text.alias("text"),
        F.xxhash64(text, ident).alias("k1"),
        F.xxhash64(ident, F.lit("row"), text).alias("k2"),
    )
    occurrences = texts.select(
        F.struct(F.col("row").getField(id_col).alias("id"), "k1", "k2").alias("d"), F.posexplode(lines(F.col("text")))
    ).select("d", F.col("pos").alias("line_no"), F.trim("col", F.lit(BLANKS)).alias("line"))
    # split once: a filter on the words would split again
    occurrences = occurrences.where("line != ''").withColumn("ws", _split(F.col("line"))).select(
        F.xxhash64(F.col("ws")).alias("h1"),
        F.xxhash64(F.lit("line"), F.col("ws")).alias("h2"),
        F.struct("d.id", "d.k1", "d.k2", "line_no").alias("first"),
        F.size("ws").alias("n"),
        # a line one word short of the least length can still be near a longer one
        F.when((F.size("ws") + 1) * (1 - similarity) >= 1 - 1e-9, _ends(F.col("ws"))).alias("ends"),
    )
    firsts = occurrences.groupBy("h1", "h2").agg(
        F.min("first").alias("first"), F.first("n").alias("n"), F.first("ends").alias("ends")
    )
    firsts = written(firsts, "firsts")
    kept = firsts.select("first.k1", "first.k2", "first.line_no")
    if edits:
        kept = kept.join(_near_lines(firsts, texts, similarity), ["k1", "k2", "line_no"], "left_anti")
    kept = kept.groupBy("k1", "k2").agg(F.collect_set("line_no").alias("kept"))
    # the row holds the text, so it travels once
    held = texts.drop("text").join(kept, ["k1", "k2"], "left")
    held = held.withColumn("text", F.col("row").getField(text_col).cast("string"))
    numbers = F.coalesce("kept", F.array().cast("array<int>"))

    def left(ls: Column) -> Column:
        blank = F.array_compact(F.transform(ls, lambda x, i: F.when(~filled(x), i)))
        at = F.array_sort(F.concat(numbers, blank))
        return F.struct(F.size(ls).alias("n"), F.transform(at, lambda i: F.get(ls, i)).alias("stays"))

    held = held.select("row", F.col("text"), let(lines(F.col("text")), left).alias("x")).select("row", "text", "x.*")
    known = F.col("text").isNotNull()
    held = held.select(
        "row",
        F.when(known, F.array_join("stays", "\n")).alias("_text"),
        F.when(known, F.col("n")).otherwise(0).cast("long").alias("_n"),
        F.when(known, F.col("n") - F.size("stays")).otherwise(0).cast("long").alias("_dropped"),
    )
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    columns = [F.col("_text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in names]
    return held.select(*columns, F.col("_n").alias("n_lines"), F.col("_dropped").alias("n_dropped"))
