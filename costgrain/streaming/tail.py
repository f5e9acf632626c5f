"""Growing text files followed as a stream, to the byte.

``TailSource`` is a streaming source of whole lines. Its offset tells for each
file how far it was read, a hash of its first bytes, and the version of the parser
that reads it on. A file that got shorter, whose first bytes are others, or that
another parser version has read begins at byte 0 again; else reading goes on
where the last batch ended. A line without its line feed waits for the rest.

What the offset tells of files lies in a manifest, which the offset names: a row a file, in the
order of their paths. The driver lists a folder at a time and merges its files with the
manifest before, so that it holds one folder's entries and some thousand rows
however many files there are; it looks into files that have changed. What tasks
read is a plan beside the manifests, of which each takes a batch of rows; a large file is
read by several. Names and bytes come through Arrow's file systems, so a folder may
be local or in a store.
A file that vanishes is forgotten: if it comes back, it is read anew, which a
ledger takes for a replay. What was rotated away before it was read is lost.
"""

from __future__ import annotations

import fnmatch
import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from costgrain.sources.files import LINE_BYTES

#: Bytes at a file's beginning that tell it from another, a step back in search of the last line feed, and what one task reads.
HEAD, STEP, BLOCK = 4_096, 64 << 10, 64 << 20
#: Bytes that opening a file counts for when files are dealt to tasks.
OPEN = 64 << 10
#: Of a line that is too long so many bytes are kept.
STUB = 1_024
#: Rows of a manifest that are held at once.
ROWS = 4_096
#: Manifests that a stream's own folder keeps: as many as Spark keeps offsets, and no fewer.
KEPT = 100
#: Where manifests and plans lie below the followed folder if no folder is named.
STATE = "_costgrain_tail"
SCHEMA = "source_path string, source_offset long, line string, oversize boolean"
_ARROW = pa.schema([("source_path", pa.string()), ("source_offset", pa.int64()), ("line", pa.string()), ("oversize", pa.bool_())])
#: Of a file without a whole line ``end`` is 0.
_ENTRIES = pa.schema([("path", pa.string()), ("size", pa.int64()), ("mtime", pa.int64()), ("end", pa.int64()), ("head", pa.string())])
_PLAN = pa.schema([("path", pa.string()), ("first", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("head", pa.string()), ("head_bytes", pa.int64())])


@dataclass
class Range:
    """Lines of a file that begin in [start, end) of the range that begins at ``first``."""

    path: str
    first: int
    start: int
    end: int
    head: str
    head_bytes: int


@dataclass
class Ranges(InputPartition):
    """What one task reads: the ranges in a batch of the plan, one of a large file or those of many small ones."""

    plan: str
    nth: int


class TailSource(DataSource):
    """A source for ``spark.dataSource.register``; ``follow`` does that. Options: path, glob (default ``*.jsonl``),
    parserVersion (default 1), lineBytes, blockBytes and state."""

    @classmethod
    def name(cls) -> str:
        return "costgrain_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.glob = options["path"], options.get("glob", "*.jsonl")
        self.parser = options.get("parserversion", options.get("parserVersion", "1"))
        self.most = int(options.get("linebytes", options.get("lineBytes", LINE_BYTES)))
        self.block = int(options.get("blockbytes", options.get("blockBytes", BLOCK)))
        own = options.get("state")
        self.state = (own or f"{self.folder.rstrip('/')}/{STATE}").rstrip("/")
        #: A folder of its own is cleared of what no batch needs; others may read what lies in the common one.
        self.clears = own is not None
        self.latest: str | None = None
        #: Tasks of the batches that are not committed, by (start, end).
        self.plans: dict[tuple[str, str], list[Ranges]] = {}

    def initialOffset(self) -> dict:
        return {"parser": self.parser, "files": {}}

    def latestOffset(self) -> dict:
        """For every file the byte after its last line feed and the hash of what comes first."""
        system, root = fs.FileSystem.from_uri(self.folder)
        before, told, files = _Merge(_batches(self.latest)), hashlib.sha256(), 0
        with _Table(self.state, _ENTRIES) as table:
            for info in _walk(system, root):
                if not fnmatch.fnmatch(info.base_name, self.glob):
                    continue
                path, size, mtime = info.path, info.size, info.mtime_ns
                known = before.at(path)
                # A file of the same size and time as before isn't opened again.
                end, head = known[3:] if known and known[1:3] == (size, mtime) and mtime else _measure(system, path, size)
                table.add((path, size, mtime or 0, end, head))
                if end:
                    files += 1
                    told.update(f"{path}\0{end}\0{head}\n".encode())
            # Named by what it tells, a manifest of the same is the same offset.
            self.latest = table.close(f"{told.hexdigest()[:32]}.manifest")
        return {"parser": self.parser, "files": {"manifest": self.latest, "count": files} if files else {}}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        """Ranges of files dealt to tasks by their bytes: a task a file would be more than the driver can hold."""
        if start == end:
            return []
        key = (json.dumps(start, sort_keys=True), json.dumps(end, sort_keys=True))
        if key in self.plans:
            return self.plans[key]
        system, _ = fs.FileSystem.from_uri(self.folder)
        same, held, tasks = start["parser"] == end["parser"], 0, 0
        before = _Merge(_told(start))
        with _Table(self.state, _PLAN) as table:
            for path, _, _, now, head in _told(end):
                known = before.at(path) if same else None
                if not now or (known and known[3:] == (now, head)):
                    continue
                first = 0
                if known and known[3] and known[3] <= now and _head(system, path, known[3]) == known[4]:
                    first = known[3]
                for a in range(first, now, self.block):
                    b = min(a + self.block, now)
                    held += b - a + OPEN
                    if table.rows and held > self.block:
                        table.flush()
                        held = b - a + OPEN
                    table.add((path, first, a, b, head, now), flush=False)
            if table.rows:
                table.flush()
            tasks = table.batches
            plan = table.close(f"{uuid.uuid4().hex}.plan") if tasks else None
        self.plans[key] = [Ranges(plan, n) for n in range(tasks)]
        return self.plans[key]

    def commit(self, end: dict) -> None:
        """Old manifests go; those of the last batches stay, as Spark's offsets do. What a run that died has left goes too."""
        done = json.dumps(end, sort_keys=True)
        self._drop([k for k in self.plans if k[1] == done])
        if not self.clears:
            return
        system, root = fs.FileSystem.from_uri(self.state)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        kept = sorted((i for i in found if i.base_name.endswith(".manifest")), key=lambda i: i.mtime_ns, reverse=True)[:KEPT]
        needed = {self.latest, end["files"].get("manifest"), *(p.plan for parts in self.plans.values() for p in parts[:1])} | {f"{self.state}/{i.base_name}" for i in kept}
        for info in found:
            if f"{self.state}/{info.base_name}" not in needed and info.base_name.endswith((".manifest", ".plan", ".part")):
                _delete(system, info.path)

    def stop(self) -> None:
        self._drop(list(self.plans))

    def _drop(self, batches: list[tuple[str, str]]) -> None:
        for key in batches:
            for first in self.plans.pop(key)[:1]:
                _delete(*fs.FileSystem.from_uri(first.plan))

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.folder)
        rows, held = [], 0
        for part in _batches(partition.plan, partition.nth):
            for row in self._rows(system, Range(*part)):
                rows.append(row)
                held += len(row[2])
                if len(rows) >= 4_096 or held >= 16 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _rows(self, system: fs.FileSystem, partition: Range) -> Iterator[tuple]:
        # Another file in the place of the one that was planned holds nothing of this range.
        if _head(system, partition.path, partition.head_bytes) != partition.head:
            return
        # As Spark's own readers name files.
        name = f"file:{partition.path}" if isinstance(system, fs.LocalFileSystem) else f"{self.folder.split(':', 1)[0]}://{partition.path}"
        for at, line, oversize in _lines(system, partition, self.most):
            yield name, at, line.decode("utf-8", "replace").rstrip("\r"), oversize


def _batch(rows: list[tuple], schema: pa.Schema = _ARROW) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class _Table:
    """Rows written to a folder batch by batch; ``close`` gives what is whole its name."""

    def __init__(self, folder: str, schema: pa.Schema):
        self.folder, self.schema, self.rows, self.batches = folder, schema, [], 0
        self.system, self.root = fs.FileSystem.from_uri(folder)
        self.part = f"{self.root}/{uuid.uuid4().hex}.part"
        self.out = None

    def __enter__(self) -> _Table:
        self.system.create_dir(self.root, recursive=True)
        self.file = self.system.open_output_stream(self.part)
        self.out = pa.ipc.new_file(self.file, self.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
        return self

    def add(self, row: tuple, flush: bool = True) -> None:
        self.rows.append(row)
        if flush and len(self.rows) >= ROWS:
            self.flush()

    def flush(self) -> None:
        self.out.write_batch(_batch(self.rows, self.schema))
        self.rows, self.batches = [], self.batches + 1

    def close(self, name: str) -> str:
        if self.rows:
            self.flush()
        self.out.close()
        self.file.close()
        self.system.move(self.part, f"{self.root}/{name}")
        self.part = None
        return f"{self.folder}/{name}"

    def __exit__(self, *error) -> None:
        if self.part:
            self.file.close()
            _delete(self.system, self.part)


def _batches(table: str | None, nth: int | None = None) -> Iterator[tuple]:
    """Rows of a table, of its ``nth`` batch alone if that is given."""
    if table is None:
        return
    system, path = fs.FileSystem.from_uri(table)
    with system.open_input_file(path) as f:
        reader = pa.ipc.open_file(f)
        for n in range(reader.num_record_batches) if nth is None else [nth]:
            yield from zip(*(c.to_pylist() for c in reader.get_batch(n).columns), strict=True)


def _told(offset: dict) -> Iterator[tuple]:
    """A row (path, size, time, end, head) for each file of an offset, in order; older offsets hold the files themselves."""
    files = offset["files"]
    if not files or isinstance(files.get("manifest"), str):
        return _batches(files.get("manifest"))
    return ((path, 0, 0, e["end"], e["head"]) for path, e in sorted(files.items(), key=lambda x: x[0].split("/")))


class _Merge:
    """Rows in the order of their paths, looked up by paths that come in that order."""

    def __init__(self, rows: Iterator[tuple]):
        self.rows = rows
        self._next()

    def _next(self) -> None:
        self.row = next(self.rows, None)
        self.key = self.row[0].split("/") if self.row else None

    def at(self, path: str) -> tuple | None:
        key = path.split("/")
        while self.row and self.key < key:
            self._next()
        return self.row if self.row and self.key == key else None


def _walk(system: fs.FileSystem, folder: str) -> Iterator[fs.FileInfo]:
    """Files below a folder, by the names of its parts; entries of a folder are held at once, those of all aren't."""
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    found.sort(key=lambda i: i.base_name)
    for info in found:
        if info.type == fs.FileType.File:
            yield info
        elif info.type == fs.FileType.Directory and info.base_name != STATE:
            yield from _walk(system, info.path)


def _delete(system: fs.FileSystem, path: str) -> None:
    with suppress(FileNotFoundError):
        system.delete_file(path)


def _head(system: fs.FileSystem, path: str, end: int) -> str | None:
    """Hash of a file's first bytes, of at most ``end``; None where it has less or is gone."""
    want = min(HEAD, end)
    try:
        with system.open_input_file(path) as f:
            got = f.read(want)
    except FileNotFoundError:
        return None
    return hashlib.sha256(got).hexdigest() if len(got) == want else None


def _measure(system: fs.FileSystem, path: str, size: int) -> tuple[int, str]:
    """Where a file's last whole line ends, looked for from its end back, and the hash of what comes first; (0, "") if it has none."""
    try:
        with system.open_input_file(path) as f:
            at, step = size, HEAD
            while at > 0:
                low, step = max(0, at - step), STEP
                f.seek(low)
                nth = f.read(at - low).rfind(b"\n")
                if nth >= 0:
                    end = low + nth + 1
                    f.seek(0)
                    return end, hashlib.sha256(f.read(min(HEAD, end))).hexdigest()
                at = low
    except FileNotFoundError:
        pass
    return 0, ""


def _lines(system: fs.FileSystem, part: Range, most: int) -> Iterator[tuple[int, bytes, bool]]:
    """(offset, line, oversize) of the lines that begin in the range; of an oversize one only its beginning."""
    with system.open_input_file(part.path) as raw:
        at = part.start
        raw.seek(max(part.first, at - 1))
        f = io.BufferedReader(raw, 1 << 20)
        if at > part.first and f.read(1) != b"\n":
            at += _skip(f)  # the line goes to the task in whose range it begins
        while at < part.end:
            line = f.readline(most + 1)
            if not line:
                return
            size, oversize = len(line), False
            if not line.endswith(b"\n"):
                oversize = size > most
                size += _skip(f)
                line = line[:STUB] if oversize else line
            yield at, line.removesuffix(b"\n"), oversize
            at += size


def _skip(f: io.BufferedReader) -> int:
    """Bytes up to and with the next line feed, read and dropped."""
    size = 0
    while piece := f.readline(1 << 20):
        size += len(piece)
        if piece.endswith(b"\n"):
            break
    return size


def follow(spark: SparkSession, folder: str, glob: str = "*.jsonl", parser_version: str = "1", state: str | None = None, **options: int) -> DataFrame:
    """Lines (source_path, source_offset, line, oversize) below ``folder`` as a stream; ``options``: lineBytes, blockBytes.

    ``state`` names a folder of this stream's own for what its offsets tell of files, which lasts as its checkpoint
    does and that tasks can read; old manifests are cleared from it. Without it they lie in the followed folder and stay."""
    # A session can't take a name that another one of the application has, nor read by it: each stream has its own.
    own = f"{TailSource.name()}_{uuid.uuid4().hex[:12]}"
    spark.dataSource.register(type("OwnTail", (TailSource,), {"name": classmethod(lambda cls: own)}))
    reader = spark.readStream.format(own).option("path", folder).option("glob", glob).option("parserVersion", parser_version)
    for k, v in (options | ({"state": state} if state else {})).items():
        reader = reader.option(k, v)
    return reader.load()
