"""Rules as passages in a stored inverted index, found for many questions at once by weighted terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilake.functions.text import rule_explanation
from vigilake.sources.snapshots import Merge, Snapshots

KEYS = {"chunks": ["chunk_id"], "postings": ["chunk_id", "term"]}
#: How fast a repeated term's weight levels off, and how much a passage's length counts.
SATURATION, LENGTH = 1.2, 0.75


def open_rules(spark: SparkSession, root: str, buckets: int = 16) -> Snapshots:
    return Snapshots(spark, root, KEYS, buckets)


def terms(text: Column) -> Column:
    """The lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def chunks_of(rules: DataFrame, words: int = 120) -> DataFrame:
    """(chunk_id, rule_id, title, text) from rules (rule_id, title, text): passages of up to `words` words, split at white
    space; a rule without words has one empty passage."""
    split = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    held = rules.select("rule_id", "title", split.alias("ws"))
    held = held.select("rule_id", "title", "ws", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("ws") - 1) / words)).cast("int"))).alias("n"))
    passage = F.array_join(F.slice("ws", F.col("n") * words + 1, F.lit(words)), " ")
    return held.select(F.concat_ws("#", F.col("rule_id").cast("string"), F.col("n").cast("string")).alias("chunk_id"), F.col("rule_id").cast("string").alias("rule_id"), "title", passage.alias("text"))


def ingest(store: Snapshots, chunks: DataFrame) -> int:
    """Add passages, or put them in place of those with their ids, in one version of passages and postings. A term that a
    passage has no longer stays as a posting of 0."""

    def step(table) -> dict[str, Merge]:
        counted = chunks.select("chunk_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("n"))
        old = table("postings")
        if old is not None:
            gone = old.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", "term", F.lit(0).cast("long").alias("n"))
            counted = counted.unionByName(gone).groupBy("chunk_id", "term").agg(F.max("n").alias("n"))
        sized = chunks.withColumn("length", F.size(terms(F.col("text"))).cast("long"))
        return {"chunks": Merge(sized, "replace"), "postings": Merge(counted, "replace")}

    return store.transact(step)


def retrieve(store: Snapshots, questions: DataFrame, top_k: int = 5) -> DataFrame:
    """(question_id, chunk_id, title, text, score, rank): for each of `questions` (question_id, question) the `top_k`
    passages of the greatest score, to six decimals, ties to the lower chunk_id. A question that shares no term with any
    passage has no row.

    Only the postings of the questions' terms are read beyond the index's counts; a passage's score is a sum that combines
    before its shuffle.
    """
    chunks, postings = store.table("chunks"), store.table("postings").where("n > 0")
    totals = chunks.agg(F.count("*").alias("_many"), F.avg("length").alias("_average"))
    asked = questions.select("question_id", F.explode(F.array_distinct(terms(F.col("question")))).alias("term"))
    known = postings.groupBy("term").agg(F.count("*").alias("_df"))
    weight = F.log(1 + (F.col("_many") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    known = known.crossJoin(F.broadcast(totals)).select("term", weight.alias("_idf"), "_average")  # one row of totals
    asked = asked.join(known, "term")
    hits = asked.join(postings, "term").join(chunks.select("chunk_id", "length"), "chunk_id")
    level = SATURATION * (1 - LENGTH + LENGTH * F.col("length") / F.col("_average"))
    score = F.col("_idf") * F.col("n") * (SATURATION + 1) / (F.col("n") + level)
    scored = hits.groupBy("question_id", "chunk_id").agg(F.round(F.sum(score), 6).alias("score"))
    best = Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id")
    top = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)
    return top.join(chunks.select("chunk_id", "title", "text"), "chunk_id").select("question_id", "chunk_id", "title", "text", "score", "rank")


def explain(found: DataFrame) -> DataFrame:
    """(question_id, said): one sentence for each question on the passages that were found for it, best first."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"])
    return found.groupBy("question_id").agg(ordered.alias("titles")).select("question_id", rule_explanation(F.col("question_id").cast("string"), F.col("titles")).alias("said"))
