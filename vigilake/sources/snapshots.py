"""Several Parquet tables that change together: a version is one manifest, readers see whole versions alone.

A table's rows lie in buckets by the hash of their key. A transaction writes new files for the buckets that its rows
touch, and then one manifest that names all tables' files; until that is there nobody sees any of it. Manifests are
numbered and never replaced, so of two writers on one version the second starts again from the first one's. A reader needs
no shuffle: a bucket's files hold one row a key. A bucket is written in parts by its rows' keys, whose number follows the
table's rows, so no task holds a whole bucket.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Merge:
    """Rows for a table. Of a key that the table holds already, `keep` leaves the old row, `replace` takes the new one,
    and a column's name takes the row with the greater value there, the old one at ties. Of several new rows of one key
    the greatest counts by that column, and otherwise the least of all. With `drop` the rows' keys go; rows need no
    other columns then."""

    rows: DataFrame
    mode: str = "keep"


#: Rows of a bucket that meet in one task as the bucket is written again; rows of a staged file, and bytes of files that a
#: task reads to deal them out: a task's shuffle holds what it has read.
PART_ROWS, STAGED_ROWS, READ_BYTES = 100_000, 500_000, 8 << 20


@contextmanager
def small_reads(spark: SparkSession) -> Iterator[None]:
    """Let tasks of the session read READ_BYTES of files at most, so that more rows are more tasks."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(READ_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Conflict(Exception):
    """Another writer was first, too often."""


class Snapshots:
    """The tables under `root`; `keys` names each table's key columns."""

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, list[str]], buckets: int = 64):
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), keys, buckets

    # ------------------------------------------------------------ files

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, *parts: str) -> list[str]:
        files, path = self._files(), self._path(*parts)
        return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []

    def _put(self, version: int, manifest: dict) -> bool:
        """Write a manifest whole under its number, unless there is one."""
        jvm, files = self.spark._jvm, self._files()
        files.mkdirs(self._path("log"))
        draft, final = self._path("log", f".{uuid.uuid4().hex}"), self._path("log", f"{version:012}.json")
        stream = files.create(draft, False)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE  # fails if the number is taken
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, options)
        except Exception as problem:
            files.delete(draft, False)
            if "FileAlreadyExistsException" in str(problem):
                return False
            raise
        return True

    # ------------------------------------------------------------ reading

    def version(self) -> int:
        """The latest version; 0 if nothing was ever committed."""
        return max((int(n.split(".")[0]) for n in self._listed("log") if n.endswith(".json") and n[0] != "."), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "tables": {}, "applied": {}}
        lines = self.spark.read.text(f"{self.root}/log/{version:012}.json", wholetext=True)
        return json.loads(lines.first()[0])

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version, the latest by default. Files from before a column was added get its fill."""
        return self._rows(self.manifest(version)["tables"].get(name), None)

    def _rows(self, entry: dict | None, buckets: set[int] | None) -> DataFrame | None:
        if entry is None:
            return None
        kept = [f for f in entry["files"] if buckets is None or f["bucket"] in buckets]
        now = StructType.fromJson(entry["schemas"][-1]["schema"])
        parts = []
        for k in sorted({f["schema"] for f in kept}):
            paths = [f"{self.root}/{f['path']}" for f in kept if f["schema"] == k]
            rows = self.spark.read.schema(StructType.fromJson(entry["schemas"][k]["schema"])).parquet(*paths)
            for step in entry["schemas"][k + 1 :]:
                rows = rows.withColumn(step["added"], F.expr(step["fill"]).cast(now[step["added"]].dataType))
            parts.append(rows.select(now.names))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], now)

    # ------------------------------------------------------------ writing

    def transact(
        self, step: Callable[[Callable[[str], DataFrame | None]], dict[str, Merge]], writer: str | None = None, batch: int | None = None, tries: int = 8
    ) -> int:
        """Commit what `step` makes of a version, as the next version, and return its number.

        `step` gets a function from a table's name to its rows in the version at hand (None before its first commit), and
        is called again if another writer was first. With `writer` and a growing `batch`, a batch that was committed
        before is left out, so that a replay changes nothing.
        """
        for _ in range(tries):
            base = self.manifest()
            if writer is not None and base["applied"].get(writer, -1) >= batch:
                return base["version"]
            changes = step(lambda name, base=base: self._rows(base["tables"].get(name), None))
            tables = dict(base["tables"])
            with small_reads(self.spark):
                for name, change in changes.items():
                    tables[name] = self._merged(name, tables.get(name), change)
            applied = base["applied"] | ({} if writer is None else {writer: batch})
            after = {"version": base["version"] + 1, "tables": tables, "applied": applied}
            if self._put(after["version"], after):
                return after["version"]
        raise Conflict(f"{tries} times another writer was first")

    def bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(*self.keys[name]), F.lit(self.buckets)).cast("int")

    def _merged(self, name: str, entry: dict | None, change: Merge) -> dict:
        """The table's entry after the rows have been written into new files for the buckets that they touch."""
        if entry is None:
            entry = {"schemas": [{"schema": change.rows.schema.jsonValue()}], "files": []}
        now = StructType.fromJson(entry["schemas"][-1]["schema"])
        given = self.keys[name] if change.mode == "drop" else now.names
        new = change.rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in now if f.name in given])
        staged = f"{self.root}/staged/{uuid.uuid4().hex}"
        new.withColumn("_bucket", self.bucket(name)).write.option("maxRecordsPerFile", STAGED_ROWS).parquet(staged)
        new = self.spark.read.parquet(staged)
        touched = {r[0] for r in new.select("_bucket").distinct().collect()}  # no more than there are buckets
        if touched:
            old = self._rows(entry, touched).withColumn("_bucket", self.bucket(name))
            both = old.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)), allowMissingColumns=True)
            others = [c for c in now.names if c not in self.keys[name]]
            row = F.struct(F.lit(1).alias("_one"), *others)
            # the first of a key by this order counts; a struct of all columns settles ties
            if change.mode == "keep":
                order, choose = F.struct("_new", row), F.min_by
            elif change.mode in ("replace", "drop"):
                order, choose = F.struct(~F.col("_new"), row), F.min_by
            else:
                order, choose = F.struct(change.mode, ~F.col("_new"), row), F.max_by
            # as many parts as the rows need: both counts are read from the files' footers
            parts = max(1, -(-(old.count() + new.count()) // (PART_ROWS * len(touched))))
            part = F.pmod(F.xxhash64(F.lit(1), *self.keys[name]), F.lit(parts)).cast("int")
            number = F.array_position(F.array(*map(F.lit, sorted(touched))), F.col("_bucket")).cast("int") - 1
            # each part is a task of its own: dealt by hashes, several would meet in one
            both = both.withColumn("_part", number * parts + part).repartitionById(parts * len(touched), F.col("_part"))
            kept = both.groupBy("_part", "_bucket", *self.keys[name]).agg(choose(row, order).alias("_r"), F.bool_or("_new").alias("_new"))
            if change.mode == "drop":
                kept = kept.where("NOT _new")
            folder = f"data/{name}/{uuid.uuid4().hex}"
            rows = kept.select("_bucket", *[F.col(c) if c in self.keys[name] else F.col(f"_r.{c}") for c in now.names])
            rows.write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
            filled = {int(n.split("=")[1]) for n in self._listed(folder) if n.startswith("_bucket=")}  # of a bucket all rows may go
            files = [{"bucket": b, "path": f"{folder}/_bucket={b}", "schema": len(entry["schemas"]) - 1} for b in sorted(filled)]
            entry = entry | {"files": [f for f in entry["files"] if f["bucket"] not in touched] + files}
        self.discard(staged)
        return entry

    def discard(self, staged: str) -> None:
        """Delete a staged table."""
        self._files().delete(self.spark._jvm.org.apache.hadoop.fs.Path(staged), True)

    def migrate(self, name: str, column: str, kind: str, fill: str) -> int:
        """Add a column; `fill`, an SQL expression over a row's other columns, is its value in rows from before. No file
        is rewritten. A column that is there already stays as it is."""
        for _ in range(8):
            base = self.manifest()
            entry = base["tables"][name]
            now = StructType.fromJson(entry["schemas"][-1]["schema"])
            if column in now.names:
                return base["version"]
            schema = StructType.fromJson(now.jsonValue()).add(column, StructType.fromDDL(f"c {kind}")["c"].dataType)
            self.spark.createDataFrame([], now).select(F.expr(fill).cast(kind))  # an error before anything is written
            entry = entry | {"schemas": [*entry["schemas"], {"schema": schema.jsonValue(), "added": column, "fill": fill}]}
            after = base | {"version": base["version"] + 1, "tables": base["tables"] | {name: entry}}
            if self._put(after["version"], after):
                return after["version"]
        raise Conflict("another writer was first each time")

    def expire(self, keep: int = 10, older_than_ms: int = 86_400_000) -> int:
        """Delete all manifests but the last `keep`, and the files that none of those names and that are older than
        `older_than_ms`, as a writer may be at work on younger ones; how many folders went."""
        files, last = self._files(), self.version()
        named = {f["path"].rsplit("/", 1)[0] for v in range(max(1, last - keep + 1), last + 1) for t in self.manifest(v)["tables"].values() for f in t["files"]}
        gone, limit = 0, self.spark._jvm.System.currentTimeMillis() - older_than_ms
        for v in range(1, last - keep + 1):
            files.delete(self._path("log", f"{v:012}.json"), False)
        folders = [("data", t, f) for t in self._listed("data") for f in self._listed("data", t)] + [("staged", f) for f in self._listed("staged")]
        for parts in folders:
            path = self._path(*parts)
            if "/".join(parts) not in named and files.getFileStatus(path).getModificationTime() <= limit:
                gone += bool(files.delete(path, True))
        return gone
