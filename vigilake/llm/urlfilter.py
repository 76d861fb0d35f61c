"""URL allow and block lists in a broadcast trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules at most that are broadcast as a trie; longer lists are joined, to the same verdicts.
MAX_RULES = 1_000_000

#: The columns that the filter adds.
TAKEN = ("host", "path", "rule", "verdict")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """Fits `host` and all its subdomains where the url's path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path: then up to `?`, `#` or the
    end. Both are empty for null and for a url without `://`."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(u, parts, 1), _UPPER, _LOWER), F.regexp_extract(u, parts, 2)


def build_trie(rules: Iterable[Rule]) -> dict:
    """Nested dicts: host labels from the right, then whole path segments (keys that start with `/`); a node's rules
    lie under "" with what their path still asks of the segment that follows, the longest first."""
    root: dict = {}
    for rule in rules:
        node = root
        for label in reversed(rule.host.translate(str.maketrans(_UPPER, _LOWER)).split(".")):
            node = node.setdefault(label, {})
        *whole, rest = rule.path.split("/")
        for segment in whole:
            node = node.setdefault(f"/{segment}", {})
        node.setdefault("", []).append((rest, rule))
    return root


def best_rule(trie: dict, host: str, path: str) -> Rule | None:
    """The longest rule (host and path together) that fits; at equal length the longer host, then a block."""
    best, rank = None, (-1, -1, False)
    node, segments = trie, path.split("/")
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        below = node
        for segment in segments:
            for rest, rule in below.get("", ()):
                now = (len(rule.name), len(rule.host), rule.verdict == "block")
                if now > rank and segment.startswith(rest):
                    best, rank = rule, now
            below = below.get(f"/{segment}")
            if below is None:
                break
    return best


def _by_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of the distinct hosts and paths in `urls` that a rule (verdict, host, path) fits, as
    `best_rule` has them: the trie's edges become join keys, host labels from the right with whole path segments."""
    labels, segments = F.split("host", r"\."), F.split("path", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    heads = F.transform(
        F.sequence(F.lit(1), F.size(segments)),
        lambda k: F.struct(F.array_join(F.slice(segments, 1, k - 1), "/").alias("whole"), k.alias("depth"), F.get(segments, k - 1).alias("next")),
    )
    asked = urls.select("host", "path").distinct().withColumn("tail", F.explode(tails)).withColumn("at", F.explode(heads))
    asked = asked.select("host", "path", "tail", "at.*")
    host = F.translate("host", _UPPER, _LOWER)
    parts = F.split("path", "/")
    known = rules.select(
        host.alias("tail"),
        F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("whole"),
        F.size(parts).alias("depth"),
        F.element_at(parts, -1).alias("rest"),
        F.struct(
            (F.length("host") + F.length("path")).alias("length"),
            F.length("host").alias("host_length"),
            (F.col("verdict") == "block").alias("block"),
            F.concat("host", "path").alias("rule"),
            "verdict",
        ).alias("rank"),
    )
    met = asked.join(known, ["tail", "whole", "depth"]).where(F.expr("startswith(next, rest)"))
    best = met.groupBy("host", "path").agg(F.max("rank").alias("best"))
    return best.select("host", "path", "best.rule", "best.verdict")


def filter_urls(
    pages: DataFrame,
    rules: Sequence[Rule] | DataFrame,
    url_col: str = "url",
    default: str = "allow",
    max_rules: int = MAX_RULES,
) -> DataFrame:
    """`pages` with host, path, rule and verdict; input columns of these names give way.

    `rules` is a list, or a table (verdict, host, path). Up to `max_rules` are broadcast as a trie; more are joined by
    host labels and path segments, to the same verdicts. Every row gets a verdict: that of the longest rule that fits,
    else `default`. Null and malformed urls have an empty host and path, which no rule with a host fits. Repeated rows
    are judged alike; an empty table stays empty; very long urls are judged whole.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(f"`{url_col}`").cast("string"))
    names = [c for c in pages.columns if c.lower() not in TAKEN]
    kept = [F.col(f"`{c}`") for c in names]
    held = pages.select(F.struct(F.lit(0).alias("_"), *kept).alias("row"), host.alias("host"), path.alias("path"))
    columns = [F.col("row").getField(c).alias(c) for c in names]

    listed = not isinstance(rules, DataFrame)
    if listed and len(rules) <= max_rules:
        few = list(rules)
    elif not listed and rules.limit(max_rules + 1).count() <= max_rules:
        few = [Rule(*r) for r in rules.select("verdict", "host", "path").collect()]
    else:
        table = spark.createDataFrame(rules, "verdict string, host string, path string") if listed else rules
        found = _by_join(held, table).withColumnsRenamed({"host": "of_host", "path": "of_path"})
        joined = held.join(found, (F.col("host") == F.col("of_host")) & (F.col("path") == F.col("of_path")), "left")
        return joined.select(*columns, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))

    trie = spark.sparkContext.broadcast(build_trie(few))

    @F.pandas_udf("struct<rule: string, verdict: string>")
    def judged(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        found = [best_rule(trie.value, h, p) for h, p in zip(host, path, strict=True)]
        return pd.DataFrame(
            {
                "rule": pd.Series([r.name if r else None for r in found], dtype=object),
                "verdict": pd.Series([r.verdict if r else default for r in found], dtype=object),
            }
        )

    held = held.withColumn("found", judged("host", "path"))
    return held.select(*columns, "host", "path", "found.rule", "found.verdict")
