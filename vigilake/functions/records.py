"""Log records that must fit a number of bytes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fields that are shortened first, in this order, and fields that never are.
FIRST = ("debug", "reason", "error", "message")
KEPT = ("event", "run_attempt_id", "exit_code", "code", "source_severity")
#: What a quoted value can be cut between: an escape, or a character.
_UNIT = re.compile(rb"\\u[0-9a-fA-F]{4}|\\.|[\xc0-\xff][\x80-\xbf]*|.", re.S)


def shortened(value: bytes, target: int) -> bytes:
    """A written value in about `target` bytes: a plain one keeps a byte, a quoted one its quotes and whole units."""
    if len(value) <= target:
        return value
    if not (value.startswith(b'"') and value.endswith(b'"')):
        return value[: max(1, target)]
    out, room = [], target - 2
    for unit in _UNIT.findall(value[1:-1]):
        room -= len(unit)
        if room < 0:
            break
        out.append(unit)
    return b'"' + b"".join(out) + b'"'


def fit_record(names: list[str], values: list[str], most: int) -> str:
    """`name=value` pairs and a line end, in at most `most` bytes of UTF-8. What doesn't fit is cut from the fields that
    explain most last: debug, reason, error, message, then the others from the end; the cut is told at the end."""
    data = [v.encode() for v in values]
    head = [n.encode() + b"=" for n in names]

    def line() -> bytes:
        return b" ".join(h + v for h, v in zip(head, data, strict=True))

    whole = len(line()) + 1
    if whole <= most:
        return line().decode() + "\n"
    last = {n: k for k, n in enumerate(names)}
    order = [last[n] for n in FIRST if n in last]
    order += [k for k in reversed(range(len(names))) if names[k] not in KEPT and k not in order]
    while True:
        told = line() + b" record_truncated=true omitted_bytes=%d\n" % (whole - len(line()) - 1)
        excess = len(told) - most
        if excess <= 0:
            return told.decode()
        for k in order:
            cut = shortened(data[k], max(0, len(data[k]) - excess))
            if len(cut) < len(data[k]):
                data[k] = cut
                break
        else:
            raise ValueError("field names exceed the record's limit")


def record(fields: dict[str, Column], most: int = 16_384) -> Column:
    """One log record of fields that are written already (`log_value`); null ones are left out."""
    names = list(fields)

    @F.pandas_udf("string")
    def fitted(*columns: pd.Series) -> pd.Series:
        out = []
        for row in zip(*columns, strict=True):
            kept = [(n, v) for n, v in zip(names, row, strict=True) if v is not None]
            out.append(fit_record([n for n, _ in kept], [v for _, v in kept], most))
        return pd.Series(out, dtype=object)

    return fitted(*fields.values())
