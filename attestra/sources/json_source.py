"""A1-A5 and M6 as data sources: one JSON file per document, planned by size, and an atomic writer of score updates.

    register(spark)
    spark.read.format("attestra").option("kind", "claims").load(folder)
    scores.writeStream.format("attestra_updates").option("path", folder).option("checkpointLocation", c).start()
"""

from __future__ import annotations

import json
import math
import os
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructType

from attestra.sources import readers

#: (schema of a file, its list, its document's id, names that differ in the rows) of each kind.
KINDS = {
    "transcripts": (readers.TRANSCRIPT, None, "videoId", {"videoId": "video_id"}),
    "mentions": (readers.MENTIONS, "mentions", "transcriptId", {"id": "mention_id", "derivedFrom": "derived_from"}),
    "edges": (readers.EDGES, "edges", "transcriptId", {"id": "edge_id", "subjectMentionId": "subject_mention_id", "objectMentionId": "object_mention_id"}),
    "claims": (readers.CLAIMS, "claims", "videoId", {"id": "claim_id", "hostStance": "stance", "directTruth": "truth"}),
}


def row_schema(kind: str) -> str:
    """The columns of a kind's rows: a file's own, or its document's id and the fields of its list."""
    text, inner, _, names = KINDS[kind]
    if inner is not None:
        text = "video_id string, " + text.split("array<struct<", 1)[1].removesuffix(">>").replace(":", " ")
    for old, new in names.items():
        text = re.sub(rf"\b{old}(?=[: ])", new, text, count=1)
    return text


def store_of(path: str):
    """(file system, path in it) of a local path or a URI that Arrow or Hadoop knows."""
    from pyarrow import fs

    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), os.path.abspath(unquote(parts.path) if parts.scheme else path)
    return fs.FileSystem.from_uri(path)


def fitted(value, kind: DataType):
    """A JSON value as kind asks; what does not fit is null, as in the JSON reader of Spark. Raises nothing."""
    if value is None:
        return None
    if isinstance(kind, StructType):
        return tuple(fitted(value.get(f.name), f.dataType) for f in kind.fields) if isinstance(value, dict) else None
    if isinstance(kind, ArrayType):
        return [fitted(v, kind.elementType) for v in value] if isinstance(value, list) else None
    if isinstance(kind, StringType):
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    if isinstance(kind, BooleanType):
        return value if isinstance(value, bool) else None
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    if isinstance(kind, DoubleType):
        return float(value)
    bits = 31 if isinstance(kind, IntegerType) else 63
    return value if isinstance(kind, (IntegerType, LongType)) and isinstance(value, int) and -(1 << bits) <= value < 1 << bits else None


@dataclass
class Files(InputPartition):
    """The files of a task."""

    paths: tuple[str, ...]


def packed(sizes: list[tuple[str, int]], target: int, open_cost: int) -> list[Files]:
    """Files in parts of about target bytes, each file counting open_cost on top of its size; a larger file is a part of its own."""
    parts, held, weight = [], [], 0
    for path, size in sorted(sizes, key=lambda f: (-f[1], f[0])):
        if held and weight + size + open_cost > target:
            parts.append(Files(tuple(held)))
            held, weight = [], 0
        held.append(path)
        weight += size + open_cost
    return [*parts, Files(tuple(held))] if held else parts


class DocumentReader(DataSourceReader):
    """Reads files of documents; a file that cannot be read is skipped, or fails the job where mode is failfast."""

    def __init__(self, options: dict, schema: StructType):
        self.kind, self.path = options.get("kind", "transcripts"), options["path"]
        self.target, self.open_cost = int(options.get("partitionbytes", 128 << 20)), int(options.get("opencost", 4 << 20))
        self.failfast = options.get("mode", "").lower() == "failfast"
        _, self.inner, self.key, names = KINDS[self.kind]
        old = {new: name for name, new in names.items()}
        self.fields = [(old.get(f.name, f.name), f.dataType) for f in schema.fields]

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, root = store_of(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True)) if store.get_file_info(root).type == fs.FileType.Directory else [store.get_file_info(root)]
        files = [(f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name.endswith(".json") and not f.base_name.startswith(("_", "."))]
        if self.kind == "claims":
            files = [f for f in files if f[0].rsplit("/", 1)[-1] not in readers.REPORTS]
        return packed(files, self.target, self.open_cost) or [Files(())]

    def read(self, part: Files) -> Iterator[tuple]:
        store, _ = store_of(self.path)
        for path in part.paths:
            with store.open_input_stream(path) as f:
                raw = f.read()
            try:
                doc = json.loads(raw)
            except (ValueError, RecursionError):
                doc = None
            if isinstance(doc, dict):
                yield from self.rows(doc)
            elif self.failfast:
                raise ValueError(f"{path} holds no JSON object")

    def rows(self, doc: dict) -> Iterator[tuple]:
        """A document's rows: one without an id gives none, but for mentions and edges, as in the readers."""
        key = fitted(doc.get(self.key), StringType())
        if key is None and self.kind in ("transcripts", "claims"):
            return
        if self.inner is None:
            yield tuple(fitted(doc.get(name), kind) for name, kind in self.fields)
            return
        items = doc.get(self.inner)
        for item in items if isinstance(items, list) else []:
            item = item if isinstance(item, dict) else {}
            yield tuple(key if name == "video_id" else fitted(item.get(name), kind) for name, kind in self.fields)


class DocumentSource(DataSource):
    """Format attestra. Options: kind (transcripts, mentions, edges or claims), partitionBytes, openCost, mode (permissive or failfast).

    The rows are those of the readers of the same kinds: names, order and types of columns included; a schema of one's own may leave columns out. An empty folder gives no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "attestra"

    def schema(self) -> str:
        kind = self.options.get("kind", "transcripts")
        if kind not in KINDS:
            raise ValueError(f"kind must be one of {', '.join(KINDS)}")
        return row_schema(kind)

    def reader(self, schema: StructType) -> DocumentReader:
        return DocumentReader({k.lower(): v for k, v in self.options.items()}, schema)


@dataclass
class Written(WriterCommitMessage):
    """A task's file, not yet in place."""

    name: str | None
    rows: int


class UpdateWriter(DataSourceStreamWriter, DataSourceWriter):
    """Tasks write to a staging folder under names of their own; commit moves the winners' files into the batch's folder, abort removes them.

    A batch that runs again replaces its folder. Files of lost attempts stay in staging, which commit removes; readers
    never look there, as its name begins with an underscore.
    """

    def __init__(self, options: dict, schema: StructType, staging: str):
        self.path, self.names, self.staging = options["path"], schema.fieldNames(), staging

    def write(self, rows: Iterator) -> Written:
        store, root = store_of(self.path)
        staged, n, out = f"{root}/{self.staging}", 0, None
        name = f"{uuid.uuid4().hex}.json"
        try:
            for row in rows:
                if out is None:
                    store.create_dir(staged, recursive=True)
                    out = store.open_output_stream(f"{staged}/{name}")
                values = {k: (None if isinstance(v, float) and not math.isfinite(v) else v) for k, v in zip(self.names, row, strict=True)}
                out.write(json.dumps(values, ensure_ascii=False, default=str).encode() + b"\n")
                n += 1
        except BaseException:
            if out is not None:
                out.close()
                store.delete_file(f"{staged}/{name}")
            raise
        if out is not None:
            out.close()
        return Written(name if n else None, n)

    def _place(self, messages: list, folder: str) -> None:
        from pyarrow import fs

        store, root = store_of(self.path)
        target, staged = f"{root}/{folder}", f"{root}/{self.staging}"
        if store.get_file_info(target).type == fs.FileType.Directory:
            store.delete_dir(target)
        store.create_dir(target, recursive=True)
        for m in messages:
            if m is not None and m.name:
                store.move(f"{staged}/{m.name}", f"{target}/{m.name}")
        self._clear(store, staged)

    def _clear(self, store, staged: str) -> None:
        from pyarrow import fs

        for again in (True, True, True, True, False):
            if store.get_file_info(staged).type != fs.FileType.Directory:
                return
            try:
                store.delete_dir(staged)
            except OSError:  # a task that is being killed still writes there
                if not again:
                    raise
            time.sleep(0.2)

    def commit(self, messages: list, batchId: int | None = None) -> None:
        self._place(messages, "rows" if batchId is None else f"batch={batchId}")

    def abort(self, messages: list, batchId: int | None = None) -> None:
        store, root = store_of(self.path)
        self._clear(store, f"{root}/{self.staging}")


class UpdateSink(DataSource):
    """Format attestra_updates: JSON lines, a folder batch=<number> per micro-batch (rows for a batch job), whole or not there. One stream writes to a path."""

    @classmethod
    def name(cls) -> str:
        return "attestra_updates"

    def writer(self, schema: StructType, overwrite: bool) -> UpdateWriter:
        return UpdateWriter(self.options, schema, f"_staging-{uuid.uuid4().hex}")

    def streamWriter(self, schema: StructType, overwrite: bool) -> UpdateWriter:
        return UpdateWriter(self.options, schema, "_staging-stream")  # tasks and the commit make a writer each


def register(spark: SparkSession) -> None:
    """Make both formats known to the session."""
    spark.dataSource.register(DocumentSource)
    spark.dataSource.register(UpdateSink)
