"""Hash-based identifiers as column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


# Fixed value: the namespace of the vector index's point ids.
POINTS = uuid.UUID("9b1deb4d-3b7d-4bad-9bdd-2b0d7b3dcb6d")


def _joined(*parts: Column) -> Column:
    """The parts' text with a NUL between them; null parts count as empty."""
    out = F.coalesce(parts[0].cast("string"), F.lit(""))
    for part in parts[1:]:
        out = F.concat(out, F.lit("\0"), F.coalesce(part.cast("string"), F.lit("")))
    return out


def evidence_id(event_id: Column, kind: Column, path: Column) -> Column:
    return F.sha2(_joined(event_id, kind, path), 256)


def track_key(source: Column, track_id: Column) -> Column:
    """The cooldown's key for one track of one source."""
    return F.substring(F.sha2(_joined(source, track_id), 256), 1, 32)


def event_token(event_id: Column, ingress_id: Column) -> Column:
    """What tells a redelivery from another event of the same track."""
    return F.sha2(_joined(event_id, ingress_id), 256)


def name_uuid(name: Column, namespace: uuid.UUID = POINTS) -> Column:
    """The version-5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(F.lower(F.hex(variant)), F.substring(h, 19, 2)),
        F.substring(h, 21, 12),
    )


def hash_embedding(text: Column, dims: int = 64) -> Column:
    """A unit vector drawn from a chain of SHA-256 digests: equal texts, equal vectors."""
    link = F.sha2(text, 256)
    digests = []
    for _ in range(-(-dims // 32)):
        link = F.sha2(F.unhex(link), 256)
        digests.append(link)
    chain = F.concat(*digests)
    raw = F.transform(
        F.sequence(F.lit(0), F.lit(dims - 1)),
        lambda i: F.conv(F.substring(chain, 2 * i + 1, F.lit(2)), 16, 10).cast("double") / 255.0 * 2 - 1,
    )
    bound = F.transform(F.array(raw), lambda v: F.struct(v.alias("v"), norm(v).alias("n")))
    return F.get(F.transform(bound, lambda x: F.transform(x["v"], lambda e: e / F.when(x["n"] == 0, 1.0).otherwise(x["n"]))), F.lit(0))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, e: acc + e.cast("double") * e.cast("double")))


def canonical_json(fields: dict[str, Column]) -> Column:
    """A JSON object with its keys in order, no white space, nulls written out and ASCII alone."""

    def value(c: Column) -> Column:
        text = F.substring(F.to_json(F.struct(c.alias("x"))), 6, 1 << 30)  # what stands after {"x":
        text = F.substring(text, 1, F.length(text) - 1)
        return F.when(c.isNull(), "null").otherwise(text)

    pairs = [F.concat(F.lit(f'"{k}":'), value(fields[k])) for k in sorted(fields)]
    units = F.transform(
        F.split(F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}")), ""),
        lambda c: F.when(F.ascii(c) < 128, c).otherwise(F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")),
    )
    return F.array_join(units, "")


def collection_name(base: str, identity: dict[str, Column]) -> Column:
    """`base` with a digest of the embedding's identity, so that vectors of two models never meet in one table."""
    return F.concat(F.lit(f"{base}__embedding_"), F.substring(F.sha2(canonical_json(identity), 256), 1, 16))
