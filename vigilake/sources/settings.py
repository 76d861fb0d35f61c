"""Settings from YAML-like files with overrides, and a sink that publishes messages."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import fields, replace
from pathlib import Path
from typing import TypeVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

T = TypeVar("T")


def _plain(text: str) -> dict[str, str]:
    """`name: value` lines of one level; comments and blank lines are left out."""
    found = {}
    for number, line in enumerate(text.splitlines(), 1):
        line = line.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        name, colon, value = line.partition(":")
        if not colon or line[0].isspace():
            raise ValueError(f"line {number}: one `name: value` of one level is expected")
        found[name.strip()] = value.strip().strip("\"'")
    return found


def read_settings(defaults: T, paths: list[str], prefix: str, environment: Mapping[str, str] = os.environ) -> T:
    """`defaults` (a dataclass) with the values of the first of `paths` that exists, and then those of variables
    PREFIX_NAME. Unknown names, and values that don't have the default's type, are errors."""
    known = {f.name: type(getattr(defaults, f.name)) for f in fields(defaults)}
    first = next((p for p in paths if Path(p).is_file()), None)
    given = _plain(Path(first).read_text()) if first else {}
    if unknown := sorted(set(given) - set(known)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    given |= {n: environment[f"{prefix}_{n.upper()}"] for n in known if f"{prefix}_{n.upper()}" in environment}
    truth = {"true": True, "false": False}
    made = {n: truth[v.lower()] if known[n] is bool else known[n](v) for n, v in given.items()}
    return replace(defaults, **made)


def publish(frames: DataFrame, path: str, checkpoint: str):
    """Start a stream that appends messages (event) as JSON lines to `path`, each once; its checkpoint resumes it."""
    rows = frames.select(F.col("event").alias("value"))
    return rows.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
