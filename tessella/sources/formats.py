"""Formats of spark.read, readStream, write and writeStream: a folder of files as sections, and an append-only sink.

Spark's own formats list files and hand out bytes. `tessella_files` reads a mixed folder as labelled sections, in batch
or as a stream in which each file comes once. `tessella_append` takes rows of any schema; what a write has put down is
seen as a whole or not at all. Both reach folders through pyarrow's file systems, by the path's scheme.
"""

from __future__ import annotations

import io
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain, groupby
from operator import itemgetter

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators import extraction as E
from . import files

SCHEMA = f"path string, sections {files.SECTIONS}, error string"
_ARROW = pa.schema([("path", pa.string()), ("sections", pa.list_(pa.struct([("location", pa.string()), ("text", pa.string())]))), ("error", pa.string())])

#: Bytes of files in one task unless the option splitBytes says otherwise, and what opening a file counts for.
SPLIT_BYTES, OPEN_BYTES = 64 << 20, 1 << 20

#: Tasks of a scan after which opening a file counts for a sixteenth: few files still keep all cores at work, and of many
#: small ones the driver has a task for a thousand, not for each 64.
MANY_TASKS = 256

#: Files in one line of a log entry.
LINE_FILES = 1_000

#: Characters in one batch of rows on its way from a task.
FRAME_CHARS = 8 << 20


def register(spark: SparkSession) -> None:
    """Make the formats known to a session."""
    spark.dataSource.register(Files)
    spark.dataSource.register(Append)


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it; a path without a scheme is a local one."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]:", "s3:", path)))


def _below(path: str) -> list[pafs.FileInfo]:
    fs, at = _open(path)
    found = fs.get_file_info(pafs.FileSelector(at, allow_not_found=True, recursive=True))
    return [f for f in found if f.type == pafs.FileType.File]


def put_file(path: str, data: bytes) -> None:
    """A file under its name only when it is whole."""
    put_lines(path, [data])


def put_lines(path: str, data: Iterable[bytes]) -> None:
    """put_file of parts that needn't be held together."""
    fs, at = _open(path)
    folder, name = at.rsplit("/", 1)
    fs.create_dir(folder, recursive=True)
    draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as out:
        for part in data:
            out.write(part)
    fs.move(draft, at)


def _get(path: str) -> bytes:
    fs, at = _open(path)
    with fs.open_input_stream(at) as file:
        return file.read()


def spoken(raw: bytes) -> list[tuple[str, str]]:
    """What operators.extraction.captions says of a caption file's bytes."""
    said, skip = [], False
    for line in re.split(r"\r\n|[\n\v\f\r\x85  ]", raw.decode("utf-8", "replace")):
        line = line.strip()
        skip = bool(line) and (skip or line.startswith(tuple(E.BLOCK_HEADS)))
        words = re.sub("<[^>]*>", "", line).strip()
        if words and not skip and "-->" not in line and not line.isdecimal() and said[-1:] != [words]:
            said.append(words)
    return [("transcript", "\n".join(said))]


def _sections(path: str, raw: bytes) -> Iterator[tuple[str, str]]:
    kind = "." + path.rsplit(".", 1)[-1].lower()
    if kind == ".pdf":
        yield from files.pdf_paragraphs(raw)
    elif kind in (".srt", ".vtt"):
        yield from spoken(raw)
    elif kind in files.EXTRACTORS:
        yield from files.EXTRACTORS[kind](raw)
    else:
        yield "document", raw.decode("utf-8", "ignore")


def _row(path: str) -> dict:
    """One file's row; what was read before an error stays."""
    found, error = [], ""
    try:
        for location, text in _sections(path, _get(path)):
            if text.strip():
                found.append({"location": location, "text": text.encode("utf-8", "replace").decode()})
    except Exception as e:  # noqa: BLE001 - one bad file must not end the scan
        error = f"{type(e).__name__}: {e}"[:500]
    return {"path": path, "sections": found, "error": error}


def _pack(names: list[str]) -> bytes:
    return zlib.compress(json.dumps(names).encode())


def _unpack(packed: bytes) -> list[str]:
    return json.loads(zlib.decompress(packed))


@dataclass
class Split(InputPartition):
    """The files of one task, packed: the driver holds those of a whole scan."""

    packed: bytes

    @property
    def paths(self) -> list[str]:
        return _unpack(self.packed)


class _Folder:
    """What the batch and the stream reader share: listing, dealing out, reading."""

    def __init__(self, options: dict[str, str]):
        self.path = options.get("path", "").rstrip("/")
        if not self.path:
            raise ValueError("tessella_files needs a path")
        self.limit = int(options.get("splitBytes", SPLIT_BYTES))
        self.suffixes = tuple(s.strip().lower() for s in options.get("suffixes", ",".join(E.SUFFIXES)).split(","))

    def folders(self) -> Iterator[tuple[str, list[tuple[str, int]]]]:
        """Each folder with its wanted files (name, bytes), in the order of their names; a leading . or _ marks drafts.

        No more than one folder's files are held at a time.
        """
        fs, at = _open(self.path)
        waiting = [""]
        while waiting:
            below = waiting.pop()
            found = fs.get_file_info(pafs.FileSelector(at.rstrip("/") + below, allow_not_found=True))
            inside = sorted(((f.base_name, f.type, f.size or 0) for f in found if f.base_name[0] not in "._"), key=itemgetter(0))
            waiting += [f"{below}/{name}" for name, kind, _ in reversed(inside) if kind == pafs.FileType.Directory]
            wanted = [(name, n) for name, kind, n in inside if kind == pafs.FileType.File and name.lower().endswith(self.suffixes)]
            if wanted:
                yield self.path + below, wanted

    def dealt(self, found: Iterable[tuple[str, int]]) -> list[Split]:
        """Files (path, bytes) in tasks of about as many bytes; a larger file has a task of its own."""
        splits, paths, size = [], [], 0
        for path, n in found:
            if paths and size + n > self.limit:
                splits.append(Split(_pack(paths)))
                paths, size = [], 0
            paths.append(path)
            size += n + (OPEN_BYTES if len(splits) < MANY_TASKS else OPEN_BYTES // 16)
        return [*splits, Split(_pack(paths))] if paths else splits

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for path in partition.paths:
            rows.append(_row(path))
            size += sum(len(s["text"]) for s in rows[-1]["sections"])
            if size > FRAME_CHARS or len(rows) == 500:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


class FolderReader(_Folder, DataSourceReader):
    def partitions(self) -> Sequence[InputPartition]:
        return self.dealt((f"{folder}/{name}", n) for folder, files in self.folders() for name, n in files) or [Split(_pack([]))]


class FolderStream(_Folder, DataSourceStreamReader):
    """A stream's offset is the number of its last log entry; an entry lists the files that were new when it was made.

    The log lives in the folder that the option `log` names, one for each stream. An entry is put up before its number
    is told to Spark, so a stream that starts again finds every file in one entry, and none in two. A file is known by
    its path: one that is written anew under its name does not come again. Entries are written and read line by line;
    names of all files seen are kept on the driver, packed by folder, and one folder's at a time are compared with its
    listing. So the driver holds a few bytes a file, and more only of its largest folder.
    """

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.log = options.get("log", "").rstrip("/")
        if not self.log:
            raise ValueError("a stream of tessella_files needs the option log, a folder of its own")
        self.last, self.seen = -1, None

    def _lines(self, number: int) -> Iterator[list[tuple[str, int]]]:
        """The files (path, bytes) of an entry, a line's at a time."""
        fs, at = _open(f"{self.log}/{number:020d}")
        with fs.open_input_stream(at) as file:
            for line in io.BufferedReader(file, 1 << 20):
                yield [tuple(f) for f in json.loads(line)]

    def _look(self) -> None:
        """Take up what the log says."""
        numbers = sorted(int(f.base_name) for f in _below(self.log) if f.base_name.isdigit())
        self.seen = {}
        for line in chain.from_iterable(map(self._lines, numbers)):
            for folder, paths in groupby((path.rsplit("/", 1) for path, _ in line), itemgetter(0)):
                self.seen.setdefault(folder, []).append(_pack([name for _, name in paths]))
        self.last = max(numbers, default=-1)

    def _new(self, seen: dict[str, list[bytes]]) -> Iterator[bytes]:
        """Lines of an entry of the files that no entry has; what is seen then of their folders is put into `seen`."""
        for folder, files in self.folders():
            known = set(chain.from_iterable(map(_unpack, self.seen.get(folder, ()))))
            new = [f for f in files if f[0] not in known]
            for k in range(0, len(new), LINE_FILES):
                yield json.dumps([(f"{folder}/{name}", n) for name, n in new[k : k + LINE_FILES]]).encode() + b"\n"
            if new:
                seen[folder] = [_pack(sorted(known.union(map(itemgetter(0), new))))]

    def initialOffset(self) -> dict:
        return {"entry": -1}

    def latestOffset(self) -> dict:
        if self.seen is None:
            self._look()
        seen: dict[str, list[bytes]] = {}
        lines = self._new(seen)
        first = next(lines, None)
        if first is not None:
            put_lines(f"{self.log}/{self.last + 1:020d}", chain([first], lines))
            self.last += 1
            self.seen.update(seen)
        return {"entry": self.last}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return self.dealt(chain.from_iterable(chain.from_iterable(map(self._lines, range(start["entry"] + 1, end["entry"] + 1)))))


class Files(DataSource):
    """path, sections (location, text) and error of the supported files below a folder, a row a file.

    Options: splitBytes, the bytes of files in one task; suffixes, those to read, by commas; log, for streams. An empty
    or missing folder gives no rows, an empty file a row without sections, a file that can't be read a row with its error.
    """

    @classmethod
    def name(cls) -> str:
        return "tessella_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return FolderReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FolderStream(self.options)


@dataclass
class Written(WriterCommitMessage):
    path: str  #: empty where a task had no rows


class _Sink:
    """Tasks write files into a folder of their write's own; a commit is one small file that names those that count."""

    def __init__(self, options: dict[str, str]):
        self.path = options.get("path", "").rstrip("/")
        if not self.path:
            raise ValueError("tessella_append needs a path")

    def put(self, batches: Iterator[pa.RecordBatch], folder: str) -> Written:
        context = TaskContext.get()
        name = f"{context.partitionId():05d}-{context.taskAttemptId()}-{uuid.uuid4().hex}.parquet"
        fs, at = _open(f"{self.path}/data/{folder}/{name}")
        out = None
        try:
            for batch in batches:
                if out is None:
                    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    out = pq.ParquetWriter(at, batch.schema, filesystem=fs)
                out.write_batch(batch)
        except BaseException:
            if out is not None:
                out.close()
                fs.delete_file(at)
            raise
        if out is None:
            return Written("")
        out.close()
        return Written(f"data/{folder}/{name}")

    def settle(self, folder: str, keep: set[str]) -> None:
        """Take away the files of a write's folder that don't count, those of lost tasks too."""
        at = f"{self.path}/data/{folder}"
        fs = _open(at)[0]
        for file in _below(at):
            if f"data/{folder}/{file.base_name}" not in keep:
                fs.delete_file(file.path)

    def finish(self, folder: str, messages: list[WriterCommitMessage | None]) -> None:
        paths = [m.path for m in messages if m is not None and m.path]
        commit = f"{self.path}/commits/{folder}"
        before = _committed(commit)
        if before is None:
            put_file(commit, json.dumps(paths).encode())
        self.settle(folder, set(paths if before is None else before))

    def undo(self, folder: str) -> None:
        self.settle(folder, set(_committed(f"{self.path}/commits/{folder}") or ()))


def _committed(commit: str) -> list[str] | None:
    try:
        return json.loads(_get(commit))
    except FileNotFoundError:
        return None


class AppendWriter(_Sink, DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.folder = f"write-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.put(iterator, self.folder)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self.finish(self.folder, messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.undo(self.folder)


class AppendStream(_Sink, DataSourceStreamArrowWriter):
    """A batch of a stream has one folder and one commit, by its number; when it is repeated, the first commit counts."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.stream = options.get("stream", "stream")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.put(iterator, f"{self.stream}-{TaskContext.get().getLocalProperty('streaming.sql.batchId')}")

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        self.finish(f"{self.stream}-{batchId}", messages)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        self.undo(f"{self.stream}-{batchId}")


class Append(DataSource):
    """Rows are added to a folder, never replaced. Option stream: a name for each stream that writes to the folder."""

    @classmethod
    def name(cls) -> str:
        return "tessella_append"

    def writer(self, schema: StructType, overwrite: bool) -> AppendWriter:
        if overwrite:
            raise ValueError("tessella_append only appends")
        return AppendWriter(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> AppendStream:
        return AppendStream(self.options)


def appended(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The committed rows of a sink, through Spark's own reader, so that filters and columns reach the files."""
    commits = [f for f in _below(f"{path}/commits") if not f.base_name.startswith(".")]
    named = [p for f in commits for p in json.loads(_get(f"{path}/commits/{f.base_name}"))]
    return spark.read.schema(schema).parquet(*(f"{path}/{p}" for p in named)) if named else spark.createDataFrame([], schema)
