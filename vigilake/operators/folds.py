"""State carried along an order: folds over sorted rows, and prefixes handed from time slice to time slice."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vigilake.session import shared_folder


def folded(rows: DataFrame, keys: list[str], order: list[str], start: Callable, advance: Callable, schema: StructType | str) -> DataFrame:
    """`advance(state, part)` over each key's rows in order, `state` being `start()` at the key's first row.

    A key's rows come in parts of an Arrow batch, so only the state is held, however many rows a key has. They run in one
    task, as each state follows from the one before; keys that can be split further should be.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            if not len(batch):
                continue
            names = list(zip(*[[None if pd.isna(x) else x for x in batch[k]] for k in keys], strict=True))
            cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if names[a] != now:
                    now, state = names[a], start()
                yield advance(state, batch.iloc[a:b])

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def folded_arrow(rows: DataFrame, keys: list[str], order: list[str], start: Callable, advance: Callable, schema: StructType | str) -> DataFrame:
    """`folded`, with a part of a key's rows as an Arrow batch to `advance` and from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            names = list(zip(*[batch.column(k).to_pylist() for k in keys], strict=True))
            cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if names[a] != now:
                    now, state = names[a], start()
                yield advance(state, batch.slice(a, b - a))

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def sliced(rows: DataFrame, at: str, width: int) -> DataFrame:
    """Rows with `_slice`, the number of the slice of `width` that `at` lies in."""
    return rows.withColumn("_slice", F.floor(F.col(at) / F.lit(width)).cast("long"))


def within(keys: list[str], at: str) -> Window:
    return Window.partitionBy(*keys, "_slice").orderBy(at)


def carried(rows: DataFrame, keys: list[str], made: dict[str, Column], carry: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """`rows` (with `_slice`) with columns `made` taken over each slice and then, by `carry`, over all slices before it.

    Only one row a key and slice meets in the second step, so a busy key is many tasks and not one.
    """
    slices = rows.groupBy(*keys, "_slice").agg(*[v.alias(k) for k, v in made.items()])
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    names = [*keys, "_slice"]
    slices = slices.select(*[F.col(n).alias(f"_of_{n}") for n in names], *[carry[k](F.col(k)).over(before).alias(k) for k in made])
    same = reduce(and_, [F.col(n).eqNullSafe(F.col(f"_of_{n}")) for n in names])
    return rows.join(slices, same, "left").drop(*[f"_of_{n}" for n in names])


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows with their number in `order`, from 1, as `name`. They are dealt by ranges of the order and numbered within
    each; only the ranges' counts meet. Rows alike in `order` are numbered in any order."""
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession, "ranked")
    dealt = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt.write.parquet(folder)
    dealt = spark.read.schema(dealt.schema).parquet(folder)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    counts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    held = dealt.join(F.broadcast(counts), "_range")
    number = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")
    return held.withColumn(name, number).select(*rows.columns, name)


def last_known(column: Column) -> Column:
    return F.last(column, ignorenulls=True)


def row_numbers(rows: DataFrame, keys: list[str], at: str, width: int, name: str) -> DataFrame:
    """Rows with their number within their keys, in order of `at` (no ties), from 1."""
    held = carried(sliced(rows, at, width), keys, {"_n": F.count("*")}, {"_n": F.sum})
    number = F.row_number().over(within(keys, at)) + F.coalesce("_n", F.lit(0))
    return held.withColumn(name, number.cast("long")).drop("_slice", "_n")


def float32(values) -> np.ndarray:
    return np.asarray(values, np.float32)
