"""Files that tasks write, named by their content."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_artifacts(rows: DataFrame, root: str, suffix: str = ".json", column: str = "content") -> DataFrame:
    """`rows` without the content (text or binary), with `path`, `size` and `sha256` of the file under `root` that has it;
    a null content has neither.

    A task writes a file beside its place and renames it, and leaves one alone that is there with its size. So a task that
    is run again, or equal contents in many rows, give one file, and no reader sees part of one. The frame is lazy: files
    are written as it is read.
    """
    kept = [c for c in rows.columns if c != column]
    held = rows.select(F.col(f"`{column}`").cast("binary").alias("_content"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in kept]).alias("_row"))

    def put(files: fs.FileSystem, base: str, content: bytes) -> tuple[str, int, str]:
        digest = hashlib.sha256(content).hexdigest()
        folder = f"{base}/{digest[:2]}"
        path = f"{folder}/{digest}{suffix}"
        there = files.get_file_info(path)
        if there.type != fs.FileType.File or there.size != len(content):
            files.create_dir(folder)
            draft = f"{folder}/.{digest}.{uuid.uuid4().hex}"
            with files.open_output_stream(draft) as stream:
                stream.write(content)
            files.move(draft, path)
        return path, len(content), digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        base = base.rstrip("/")
        for batch in batches:
            made = [(None, None, None) if c.as_py() is None else put(files, base, c.as_py()) for c in batch.column(0)]
            columns = list(zip(*made, strict=True)) or [[], [], []]
            kinds = (pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["_row", "path", "size", "sha256"]
            )

    row = held.schema["_row"].dataType.simpleString()
    made = held.mapInArrow(run, f"_row {row}, path string, size bigint, sha256 string")
    return made.select(*[F.col("_row").getField(c).alias(c) for c in kept], "path", "size", "sha256")
