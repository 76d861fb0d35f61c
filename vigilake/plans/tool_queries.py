"""The query tools: an event as its reader sees it, its review, its evidence, rules for questions, written artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.functions import results, text
from vigilake.functions.registry import EmbeddingIdentity, embedder
from vigilake.operators import cases, detect, reviews, rules, vectors
from vigilake.plans import tables as t
from vigilake.plans.registry import register
from vigilake.session import shared_folder
from vigilake.sources.artifacts import write_artifacts


def _viewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = (t.cases_events(spark, sf_dir), t.cases_detections(spark, sf_dir), t.cases_evidence(spark, sf_dir).withColumn("path", F.lit("/host/x")), t.reviews(spark, sf_dir))
    return reviews.event_view(cases.event_cases(*sides))


@register(
    "j4_get_event",
    f"""WITH {t.CASES_EVENTS}, {t.DETECTIONS},
d AS (SELECT event_id, string_agg(class_name || '/' || track_id, ',' ORDER BY position, class_name, track_id) AS objects FROM det GROUP BY 1),
e AS (SELECT l_orderkey AS event_id, string_agg(DISTINCT 'ev-' || l_suppkey, ',' ORDER BY 'ev-' || l_suppkey) AS evidence_ids, CAST(count_if(l_linestatus = 'O') AS BIGINT) AS n_available FROM lineitem GROUP BY 1)
SELECT event_id, ev.source, timestamp_ms, event_type, status, coalesce(objects, '') AS objects, coalesce(evidence_ids, '') AS evidence_ids, coalesce(n_available, 0) AS n_available, false AS shows_paths
FROM ev LEFT JOIN d USING (event_id) LEFT JOIN e USING (event_id)""",
)
def get_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's view; no host path is in it."""
    view = _viewed(spark, sf_dir)
    shows = "path" in view.schema["evidence"].dataType.elementType.names
    objects = F.transform(F.array_sort(F.transform("detections", lambda d: F.struct(d["position"], d["class_name"], d["track_id"]))), lambda d: F.concat_ws("/", d["class_name"], d["track_id"].cast("string")))
    named = F.array_sort(F.array_distinct(F.transform("evidence", lambda e: e["evidence_id"])))
    return view.select(
        "event_id", "source", "timestamp_ms", "event_type", "status", F.coalesce(F.array_join(objects, ","), F.lit("")).alias("objects"),
        F.coalesce(F.array_join(named, ","), F.lit("")).alias("evidence_ids"),
        F.coalesce(F.size(F.filter("evidence", lambda e: e["available"])), F.lit(0)).cast("long").alias("n_available"), F.lit(shows).alias("shows_paths"),
    )


@register(
    "j4_review_results",
    "SELECT doc_id AS event_id, CASE WHEN toxic IS NOT NULL THEN true ELSE false END AS found, CASE WHEN toxic = 1 THEN 'violation' WHEN toxic = 0 THEN 'compliant' END AS verdict FROM documents LEFT JOIN labels USING (doc_id)",
)
def review_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest review of each document as an event, and whether there is one."""
    asked = t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"))
    return reviews.reviews_of(t.reviews(spark, sf_dir), asked).select("event_id", "found", "verdict")


@register(
    "j4_readable_evidence",
    "SELECT l_orderkey AS event_id, 'ev-' || l_suppkey AS evidence_id, CAST(l_linenumber AS BIGINT) AS position FROM lineitem WHERE l_linestatus = 'O'",
)
def readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of all events' evidence may be read."""
    asked = t.cases_events(spark, sf_dir).select("event_id")
    found = reviews.readable_evidence_of(t.cases_evidence(spark, sf_dir), asked)
    return found.select("event_id", "evidence_id", F.col("position").cast("long").alias("position"))


WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


@register(
    "j3_rule_retrieval",
    f"""WITH c AS (SELECT item_id || '#0' AS chunk_id, 'rule ' || item_id AS title, {WORDS.format("text")} AS ws FROM benchmark),
p AS (SELECT chunk_id, term, count(*) AS n FROM (SELECT chunk_id, unnest(ws) AS term FROM c) GROUP BY ALL),
k AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
a AS (SELECT count(*) AS many, avg(len(ws)) AS average FROM c),
q AS (SELECT DISTINCT conv_id * 100 + turn AS question_id, unnest({WORDS.format("text")}) AS term FROM conversations),
s AS (
  SELECT question_id, p.chunk_id, round(sum(ln(1 + (many - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(c.ws) / average))), 6) AS score
  FROM q JOIN k USING (term) JOIN p USING (term) JOIN c ON c.chunk_id = p.chunk_id, a GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM s)
SELECT question_id, chunk_id, c.title, score, CAST(rank AS INTEGER) AS rank FROM r JOIN c USING (chunk_id) WHERE rank <= 3""",
)
def rule_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as rules, all turns of all conversations as questions."""
    store = rules.open_rules(spark, shared_folder(spark, "rules"), 8)
    items = t.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("rule_id"), F.concat(F.lit("rule "), F.col("item_id").cast("string")).alias("title"), "text")
    rules.ingest(store, rules.chunks_of(items, 100_000))
    asked = t.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("question_id"), F.col("text").alias("question"))
    found = rules.retrieve(store, asked, 3)
    return found.select("question_id", "chunk_id", "title", "score", "rank")


@register(
    "a17_written_artifacts",
    "SELECT page_id, sha256(html) || '.html' AS name, CAST(octet_length(encode(html)) AS BIGINT) AS size, true AS available FROM pages",
)
def written_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as files by their content, and found again by a listing."""
    root = shared_folder(spark, "artifacts").removeprefix("file://")
    pages = t.table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("content"))
    held = write_artifacts(pages, root, ".html").withColumns({"available": F.lit(False), "mtime": F.lit(0.0)})
    kept = f"{root}-rows"
    held.write.parquet(kept)  # the files are there once this is
    held = spark.read.parquet(kept)
    found = reviews.refresh_evidence(held, reviews.list_files(spark, root))
    return found.select("page_id", F.substring_index("path", "/", -1).alias("name"), "size", "available")


@register(
    "i5_index_text",
    f"""WITH {t.CASES_EVENTS}, {t.DETECTIONS},
d AS (SELECT event_id, string_agg(class_name || ':' || n, ',' ORDER BY class_name) AS objects FROM (SELECT event_id, class_name, count(*) AS n FROM det GROUP BY ALL) GROUP BY 1),
e AS (SELECT l_orderkey AS event_id, count_if(l_linestatus = 'O') AS n FROM lineitem GROUP BY 1)
SELECT event_id, 'event_id=' || event_id || ' source=' || ev.source || ' timestamp_ms=' || timestamp_ms || ' event_type=' || event_type || ' rule_id= rule_version= severity= objects=' || coalesce(objects, 'none')
  || ' rule_facts={{}} available_evidence=' || coalesce(n, 0) || ' evidence_status= verdict=' || coalesce(CASE toxic WHEN 1 THEN 'violation' WHEN 0 THEN 'compliant' END, verdict, '')
  || ' confidence=' || CAST(CASE WHEN quality = 1 THEN 0.9 ELSE confidence END AS VARCHAR) AS text
FROM ev LEFT JOIN d USING (event_id) LEFT JOIN e USING (event_id) LEFT JOIN labels AS l ON l.doc_id = event_id""",
)
def index_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All thirteen fields of every event's index text."""
    made = cases.event_cases(t.cases_events(spark, sf_dir), t.cases_detections(spark, sf_dir), t.cases_evidence(spark, sf_dir), t.reviews(spark, sf_dir))
    case = {c: F.col(c) for c in ("event_id", "source", "timestamp_ms", "event_type", "detections", "evidence", "verdict", "confidence")}
    case |= {"review_verdict": F.col("review.verdict"), "review_confidence": F.col("review.confidence")}
    return made.select("event_id", text.index_text(case).alias("text"))


@register(
    "b10_target_class",
    f"WITH {t.BOXES} SELECT frame_id, CAST(count_if(class_id = 1) AS INTEGER) AS vans, CAST(count(*) AS INTEGER) AS n FROM box GROUP BY 1",
)
def target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of one class by its label, and of all where no label is asked for."""
    labels = ["person", "van"]
    held = t.boxed(spark, sf_dir)
    counts = {}
    for name, asked in (("vans", "van"), ("n", "")):
        wanted = detect.target_class(labels, asked)
        counts[name] = F.size(F.filter("boxes", (lambda w: lambda b: F.lit(w is None) | (b["class_id"] == F.lit(-1 if w is None else w)))(wanted)))
    return held.select("frame_id", *[v.alias(k) for k, v in counts.items()])


@register(
    "i18_prompts",
    f"""WITH {t.CASES_EVENTS}, e AS (SELECT l_orderkey AS event_id, string_agg(DISTINCT 'ev-' || l_suppkey, ', ' ORDER BY 'ev-' || l_suppkey) AS ids FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
SELECT event_id, 'Review event ' || event_id || ' of type ' || event_type || ' from source ' || source || ' under rule none. Objects: none. Evidence: ' || coalesce(ids, 'none')
  || '. Answer with one JSON object: verdict (compliant, violation or uncertain), confidence (0 to 1), evidence_status (available or missing), evidence_ids, claims, explanation.' AS prompt
FROM ev LEFT JOIN e USING (event_id)""",
)
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reviewer is asked about every event, with the evidence that may be named."""
    there = t.cases_evidence(spark, sf_dir).where("available").groupBy("event_id").agg(F.array_sort(F.collect_set("evidence_id")).alias("there"))
    rows = t.cases_events(spark, sf_dir).join(there, "event_id", "left")
    named = F.coalesce("there", F.array().cast("array<string>"))
    asked = results.review_prompt(F.col("event_id").cast("string"), F.col("event_type"), F.col("source"), F.lit(None).cast("string"), F.lit("none"), named)
    return rows.select("event_id", asked.alias("prompt"))


@register("d3_semantic_candidates")
def semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions as text, embedded by the registry's backend, against the embedded texts of all benchmark items. Equal
    texts have equal vectors, so each item finds itself."""
    embed = embedder(EmbeddingIdentity())
    items = t.table(spark, sf_dir, "benchmark").where("text IS NOT NULL")
    points = items.select(F.col("item_id").alias("event_id"), embed(F.col("text")).alias("vector"))
    asked = items.select(F.col("item_id").alias("query_id"), embed(F.col("text")).alias("query"))
    return vectors.block_top_k(points, asked, 5).withColumn("score", F.round("score", 6))
