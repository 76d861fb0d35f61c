"""Review results as text: JSON objects, or the older `key: value` form, to one checked row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.functions.text import key_values
from vigilake.operators.cases import broken_contract

RESULT = (
    "verdict string, confidence double, evidence_status string, evidence_ids array<string>, "
    "claims array<struct<text:string,evidence_ids:array<string>>>, explanation string, policy_id string, model_id string"
)
# The names of the older form's fields, and the full-width comma that may part its ids.
FIELDS = {"verdict": "结论", "confidence": "置信度", "evidence_status": "证据状态", "explanation": "依据", "evidence_ids": "证据ID"}
WIDE_COMMA = "，"


def json_value(text: Column, schema: str, fallback: Column) -> Column:
    """A JSON text's value, or the fallback for null, empty and malformed texts."""
    return F.when(F.try_parse_json(text).isNotNull(), F.coalesce(F.from_json(text, schema), fallback)).otherwise(fallback)


def candidate(text: Column) -> Column:
    """The text, without a code fence's first line and last marks."""
    plain = F.trim(text, F.lit(" \t\r\n"))
    fenced = plain.startswith("```") & plain.endswith("```")
    inner = F.trim(F.regexp_replace(F.substring(plain, F.instr(plain, "\n") + 1, F.length(plain)), r"(?s)\A(.*)```.*\z", "$1"), F.lit(" \t\r\n"))
    return F.when(fenced, F.when(F.instr(plain, "\n") > 0, inner).otherwise("")).otherwise(plain)


def parse_results(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """`rows` with a review's columns and `problem`: null, `no_object` for JSON that is no object, or the first rule of
    the contract that the result breaks. A text that isn't JSON is read as the older form, whose explanation can't be
    blank. Null texts break the first rule."""
    text = F.col(f"`{text_col}`")
    held = rows.withColumn("_json", candidate(text)).withColumn("_variant", F.try_parse_json("_json"))
    held = held.withColumn("_object", F.json_object_keys("_json").isNotNull())
    old = key_values(text)
    field = lambda name: F.try_element_at(old, F.lit(FIELDS[name]))
    ids = F.split(F.replace(F.coalesce(field("evidence_ids"), F.lit("")), F.lit(WIDE_COMMA), F.lit(",")), ",")
    ids = F.filter(F.transform(ids, lambda x: F.trim(x)), lambda x: x != "")
    none = F.lit(None).cast("string")
    older = F.struct(
        field("verdict").alias("verdict"),
        field("confidence").try_cast("double").alias("confidence"),
        field("evidence_status").alias("evidence_status"),
        ids.alias("evidence_ids"),
        F.array().cast("array<struct<text:string,evidence_ids:array<string>>>").alias("claims"),
        F.when(F.trim(F.coalesce(field("explanation"), F.lit(""))) != "", field("explanation")).alias("explanation"),
        none.alias("policy_id"),
        none.alias("model_id"),
    )
    # an absent list is empty
    newer = F.from_json("_json", RESULT)
    newer = newer.withField("evidence_ids", F.coalesce(newer["evidence_ids"], F.array().cast("array<string>")))
    newer = newer.withField("claims", F.coalesce(newer["claims"], F.array().cast("array<struct<text:string,evidence_ids:array<string>>>")))
    held = held.withColumn("_made", F.when(F.col("_object"), newer).when(F.col("_variant").isNull(), older))
    held = held.select(*[F.col(f"`{c}`") for c in rows.columns], "_object", "_variant", "_made.*")
    problem = F.when(~F.col("_object") & F.col("_variant").isNotNull(), "no_object").otherwise(broken_contract())
    return held.withColumn("problem", problem).drop("_object", "_variant")


def review_prompt(event_id: Column, event_type: Column, source: Column, rule_id: Column, objects: Column, evidence_ids: Column) -> Column:
    """What a reviewer is asked about an event: its facts, the evidence that may be named, and the form of the answer."""
    known = F.when(F.size(evidence_ids) > 0, F.array_join(evidence_ids, ", ")).otherwise("none")
    return F.format_string(
        "Review event %s of type %s from source %s under rule %s. Objects: %s. Evidence: %s. Answer with one JSON object: "
        "verdict (compliant, violation or uncertain), confidence (0 to 1), evidence_status (available or missing), evidence_ids, claims, explanation.",
        event_id, F.coalesce(event_type, F.lit("unknown")), source, F.coalesce(rule_id, F.lit("none")), objects, known,
    )
