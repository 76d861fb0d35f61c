"""A log of messages as a Spark data source: numbered segments that a sink commits and a stream reads by offset.

    spark.dataSource.register(MessageLog)
    frame.writeStream.format("message_log").option("path", root).option("checkpointLocation", ...).start()
    spark.readStream.format("message_log").option("path", root).option("consumer", name).load()

Tasks write staged files; the commit of a micro-batch first notes which of them become which segments, under the batch's
number, and then renames them. A batch that is replayed finds its note: its new staged files go, and renames that a crash
left undone are made. A reader's offset is the number of the next segment, kept in the query's checkpoint; what it has
committed is also noted under its name, so that segments all consumers are past can be trimmed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

#: Rows of a segment at most.
SEGMENT_ROWS = 100_000


class Log:
    """The files under `root`, a path or a URI: segments, staged, notes and consumers."""

    def __init__(self, root: str):
        self.files, self.root = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        self.root = self.root.rstrip("/")

    def names(self, folder: str) -> list[str]:
        found = self.files.get_file_info(fs.FileSelector(f"{self.root}/{folder}", allow_not_found=True))
        return sorted(i.base_name for i in found if i.type == fs.FileType.File and not i.base_name.startswith("."))

    def read(self, name: str) -> bytes:
        with self.files.open_input_stream(f"{self.root}/{name}") as stream:
            return stream.read()

    def write(self, name: str, data: bytes) -> None:
        """Whole or not at all: written beside and renamed."""
        folder, base = f"{self.root}/{name}".rsplit("/", 1)
        self.files.create_dir(folder)
        draft = f"{folder}/.{base}.{uuid.uuid4().hex}"
        with self.files.open_output_stream(draft) as stream:
            stream.write(data)
        self.files.move(draft, f"{folder}/{base}")

    def exists(self, name: str) -> bool:
        return self.files.get_file_info(f"{self.root}/{name}").type == fs.FileType.File

    def delete(self, name: str) -> None:
        if self.exists(name):
            self.files.delete_file(f"{self.root}/{name}")

    def end(self) -> int:
        """The number of the next segment, after all noted renames are made."""
        for note in self.names("notes")[-1:]:  # a note is made when those before it are done
            self._rename(json.loads(self.read(f"notes/{note}")))
        return max((int(n.split(".")[0]) + 1 for n in self.names("segments")), default=self.start())

    def start(self) -> int:
        """The first segment that hasn't been trimmed."""
        return json.loads(self.read("trimmed.json"))["next"] if self.exists("trimmed.json") else 0

    def _rename(self, note: dict) -> None:
        self.files.create_dir(f"{self.root}/segments")
        for staged, number in note["segments"]:
            if self.exists(f"staged/{staged}"):
                self.files.move(f"{self.root}/staged/{staged}", f"{self.root}/segments/{number:012}.jsonl")

    def commit(self, batch: str, staged: list[str]) -> None:
        """Make the staged files the next segments, once for a batch."""
        begun = self.end()
        if self.exists(f"notes/{batch}.json"):
            for name in staged:
                self.delete(f"staged/{name}")
            return
        note = {"segments": [[name, begun + k] for k, name in enumerate(staged)]}
        self.write(f"notes/{batch}.json", json.dumps(note).encode())
        self._rename(note)

    def trim(self) -> int:
        """Delete the segments that all known consumers have committed; how many went. Without consumers none go."""
        past = [json.loads(self.read(f"consumers/{n}"))["next"] for n in self.names("consumers")]
        first, upto = self.start(), min(past, default=0)
        if upto <= first:
            return 0
        self.write("trimmed.json", json.dumps({"next": upto}).encode())
        gone = [n for n in self.names("segments") if int(n.split(".")[0]) < upto]
        for name in gone:
            self.delete(f"segments/{name}")
        return len(gone)


@dataclass
class Segment(InputPartition):
    number: int


def _messages(root: str, partition: Segment) -> Iterator[tuple]:
    lines = Log(root).read(f"segments/{partition.number:012}.jsonl").split(b"\n")
    for k, line in enumerate(x for x in lines if x):
        row = json.loads(line)
        yield row.get("ingress_id") or f"{partition.number}-{k}", row["event"]


class _Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self):
        log = Log(self.root)
        return [Segment(n) for n in range(log.start(), log.end())]

    def read(self, partition):
        return _messages(self.root, partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, root: str, consumer: str | None):
        self.root, self.consumer = root, consumer

    def initialOffset(self) -> dict:
        return {"next": Log(self.root).start()}

    def latestOffset(self) -> dict:
        return {"next": Log(self.root).end()}

    def partitions(self, start: dict, end: dict):
        return [Segment(n) for n in range(start["next"], end["next"])]

    def read(self, partition):
        return _messages(self.root, partition)

    def commit(self, end: dict) -> None:
        if self.consumer:
            Log(self.root).write(f"consumers/{self.consumer}.json", json.dumps(end).encode())


@dataclass
class Staged(WriterCommitMessage):
    names: list[str]


def _stage(root: str, rows) -> Staged:
    log, names, held = Log(root), [], []

    def put() -> None:
        name = f"{uuid.uuid4().hex}.jsonl"
        log.write(f"staged/{name}", b"\n".join(held) + b"\n")
        names.append(name)
        held.clear()

    for row in rows:
        body = row.asDict()
        held.append(json.dumps({"ingress_id": body.get("ingress_id"), "event": body["event"]}).encode())
        if len(held) >= SEGMENT_ROWS:
            put()
    if held:
        put()
    return Staged(names)


def _drop(root: str, messages) -> None:
    for m in messages:
        for name in [] if m is None else m.names:
            Log(root).delete(f"staged/{name}")


class _Writer(DataSourceWriter):
    def __init__(self, root: str):
        self.root, self.run = root, uuid.uuid4().hex

    def write(self, iterator):
        return _stage(self.root, iterator)

    def commit(self, messages) -> None:
        Log(self.root).commit(f"run-{self.run}", [n for m in messages for n in m.names])

    def abort(self, messages) -> None:
        _drop(self.root, messages)


class _StreamWriter(DataSourceStreamWriter):
    def __init__(self, root: str, producer: str):
        self.root, self.producer = root, producer

    def write(self, iterator):
        return _stage(self.root, iterator)

    def commit(self, messages, batchId: int) -> None:
        Log(self.root).commit(f"{self.producer}-{batchId:012}", [n for m in messages if m is not None for n in m.names])

    def abort(self, messages, batchId: int) -> None:
        _drop(self.root, messages)


class MessageLog(DataSource):
    """Options: `path`; `consumer`, under whose name a stream's commits are noted; `producer`, which tells the batches of
    one writing query from another's."""

    @classmethod
    def name(cls) -> str:
        return "message_log"

    def schema(self) -> str:
        return "ingress_id string, event string"

    def reader(self, schema):
        return _Reader(self.options["path"])

    def streamReader(self, schema):
        return _StreamReader(self.options["path"], self.options.get("consumer"))

    def writer(self, schema, overwrite: bool):
        if overwrite:
            raise ValueError("a message log is only ever added to")
        return _Writer(self.options["path"])

    def streamWriter(self, schema, overwrite: bool):
        return _StreamWriter(self.options["path"], self.options.get("producer", "producer"))
