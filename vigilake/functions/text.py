"""Text forms: index text, log values, safe names, review results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def object_summary(class_names: Column) -> Column:
    """`name:count,...` in name order, or `none`."""
    filled = F.transform(F.coalesce(class_names, F.array().cast("array<string>")), lambda c: F.coalesce(c, F.lit("unknown")))
    counted = F.transform(
        F.array_sort(F.array_distinct(filled)),
        lambda c: F.concat(c, F.lit(":"), F.size(F.filter(filled, lambda x: x == c)).cast("string")),
    )
    return F.when(F.size(filled) == 0, F.lit("none")).otherwise(F.array_join(counted, ","))


def event_text(fields: dict[str, Column]) -> Column:
    """`key=value` pairs in the given order; null values are empty."""
    return F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), blank(v)) for k, v in fields.items()])


def python_float(value: Column) -> Column:
    """A finite double as Python writes it, which is as Java does but for exponents: 1e-05 and 1e+16. (Java before 19
    gives some numbers above 1e16 a digit too many.)"""
    text = value.cast("double").cast("string")
    size = F.abs(value.cast("double"))
    plain = (size == 0) | ((size >= 1e-4) & (size < 1e16))
    # Java begins exponents at 1e-3 and 1e7; between, the digits are written out
    digits = F.regexp_replace(F.regexp_replace(F.abs(value.cast("double")).cast("string"), r"E.*$", ""), r"\.", "")
    digits = F.regexp_replace(digits, r"0+$", "")
    power = F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int")
    sign = F.when(text.startswith("-"), "-").otherwise("")
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    whole = F.concat(sign, F.rpad(F.substring(digits, F.lit(1), power + 1), power + 1, "0"), F.lit("."), F.substring(F.concat(F.substring(digits, power + 2, F.length(digits)), F.lit("")), 1, 400))
    whole = F.when(whole.endswith("."), F.concat(whole, F.lit("0"))).otherwise(whole)
    mantissa = F.regexp_replace(F.regexp_extract(text, r"^(.*)E", 1), r"\.0$", "")
    exponent = F.concat(mantissa, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    return F.when(power.isNull(), text).when(~plain, exponent).when(power < 0, small).otherwise(whole)


#: The fields of an event's index text, in their order.
EVENT_TEXT = (
    "event_id", "source", "timestamp_ms", "event_type", "rule_id", "rule_version", "severity", "objects", "rule_facts",
    "available_evidence", "evidence_status", "verdict", "confidence",
)


def index_text(case: dict[str, Column]) -> Column:
    """An event's index text from a case's columns: EVENT_TEXT's fields. `detections` (with class_name) make the objects,
    `evidence` (with available) the count; rule_facts is canonical JSON text, {} where null; a review's verdict, confidence
    and evidence_status go before the event's own."""
    made = {
        **case,
        "objects": object_summary(F.transform(case["detections"], lambda d: d["class_name"])),
        "rule_facts": F.coalesce(case.get("rule_facts", F.lit(None).cast("string")), F.lit("{}")),
        "available_evidence": F.coalesce(F.size(F.filter(case["evidence"], lambda e: F.coalesce(e["available"], F.lit(False)))), F.lit(0)),
        "verdict": F.coalesce(F.nullif(case.get("review_verdict", F.lit(None).cast("string")), F.lit("")), case["verdict"]),
        "confidence": python_float(F.coalesce(case.get("review_confidence", F.lit(None).cast("double")), case["confidence"])),
    }
    return event_text({k: made.get(k, F.lit(None).cast("string")) for k in EVENT_TEXT})


def log_value(value: Column) -> Column:
    """A log field's value: plain if it is made of letters, digits and _-./: alone, else quoted and escaped."""
    text = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(shown))
    for code in (*range(0x20), 0x7F):
        if chr(code) not in "\n\r\t":
            text = F.replace(text, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    quoted = F.concat(F.lit('"'), text, F.lit('"'))
    return F.when(value.rlike(r"^[A-Za-z0-9_\-./:]+\z"), value).otherwise(quoted)


def safe_directory(event_id: Column) -> Column:
    """The id itself where it is a harmless file name, else `event-` with its digest."""
    harmless = event_id.rlike(r"^[A-Za-z0-9._-]{1,128}\z") & ~event_id.isin(".", "..")
    return F.when(harmless, event_id).otherwise(F.concat(F.lit("event-"), F.sha2(event_id, 256)))


def artifact_name(content: Column) -> Column:
    """A file name that its content decides."""
    return F.concat(F.lit("result-"), F.sha2(content, 256), F.lit(".json"))


def without_fence(text: Column) -> Column:
    """What stands inside a Markdown code fence around the whole text."""
    return F.regexp_replace(F.trim(text), r"(?s)\A```[A-Za-z]*\n(.*?)\n?```\z", "$1")


def key_values(text: Column) -> Column:
    """Map of the `key: value` lines of a text, trimmed; the last of equal keys holds."""
    lines = F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(
        lines,
        lambda x: F.struct(
            F.trim(F.substring_index(x, ":", 1)).alias("k"),
            F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("v"),
        ),
    )
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def mime_type(path: Column) -> Column:
    """By file extension."""
    known = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "mp4": "video/mp4", "json": "application/json"}
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)\z", 1)))


def milliseconds(us: Column) -> Column:
    """Microseconds as milliseconds with three decimals."""
    return F.format_string("%.3f", us.cast("double") / 1000)


def rule_explanation(rule_id: Column, titles: Column) -> Column:
    """One sentence on a rule and the passages that it was found in."""
    return F.concat_ws(" ", F.concat(F.lit("rule "), rule_id, F.lit(":")), F.array_join(titles, "; "))
