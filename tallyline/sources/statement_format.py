"""``spark.read.format("statement")``, ``spark.readStream.format("statement")`` and ``df.write.format("statement")``.

Reading: rows of cells like ``files.read_statements``. Files are dealt to partitions by size; filters on ``file`` decide what
is opened, those on ``sheet`` what is given. Writing (name string, content binary or string): one file a row, under a name
that is its own; all are put in place when the job commits, by a rename each, and none if it aborts. As a stream: files
as they arrive, each once (``Arrivals``); ``persist_stream`` keeps their rows and, apart, the files that gave none.

Paths are those of Arrow's file systems: local ones, or URIs of s3, gs, abfs and hdfs. Where only Spark reaches a store,
``files.read_statements`` reads it.
"""

from __future__ import annotations

import contextlib
import fnmatch
import hashlib
import heapq
import io
import itertools
import json
import os
import pickle
import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from tallyline.sources import files

#: Bytes of a task's files, and what opening one counts for.
MOST_BYTES, OPEN_BYTES = 64 << 20, 256 << 10
#: Tasks from which on they become larger.
MANY = 500
#: Lists of names that a commit reads side by side; files looked up at a time; the most digests that stand in an offset itself, where there is a folder for more.
OPEN_LISTS, AT_A_TIME, INLINE = 200, 100_000, 1000
#: A digest as two numbers, in the order of its bytes.
MARK = np.dtype([("high", ">u8"), ("low", ">u8")])


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"^[A-Za-z][A-Za-z0-9+.\-]+:", path) else (fs.LocalFileSystem(), path)


def kind_of(data: bytes, name: str) -> str | None:
    """``files.sniff`` of bytes at hand."""
    head, more = data[:512].decode("latin-1").lower(), data[:4096]
    ending = (re.search(r"(\.[^./\\]*)$", name) or [""])[0].lower()
    if data[:4] == b"PK\x03\x04":
        return "xlsx"
    if data[:8] == bytes.fromhex("D0CF11E0A1B11AE1"):
        return "xls"
    if re.match(r"\s*(<\?xml|<!doctype|<html|<table)", head) or "<table" in head:
        return "html"
    told = {".csv": "csv", ".tsv": "csv", ".txt": "csv", ".htm": "html", ".html": "html"}.get(ending)
    return told or ("csv" if sum(more.count(x) for x in b";,\t") > 3 else None)


class Group(InputPartition):
    """Files of one task: (name as it is shown, path, bytes). They are held packed, as all groups of a table pass through the driver."""

    def __init__(self, files: Iterable[tuple[str, str, int]]):
        super().__init__(None)
        self.packed = zlib.compress(pickle.dumps(list(files)), 1)

    @property
    def files(self) -> list[tuple[str, str, int]]:
        return pickle.loads(zlib.decompress(self.packed))


def listed(path: str, suffix: str) -> Iterator[tuple[str, str, int, int]]:
    """Files under a path: (name as it is shown, path, bytes, time of the last change in ns), as they are found: a local folder is
    read entry by entry, of another store one folder is held at a time."""
    store, root = opened(path)
    prefix = path[: len(path.rstrip("/")) - len(root.rstrip("/"))] if "://" in path or path.startswith("file:") else ""
    good = lambda name: fnmatch.fnmatch(name, suffix) and not name.startswith((".", "_"))
    info = store.get_file_info(root)
    if info.type == fs.FileType.File:
        yield from [(prefix + info.path, info.path, info.size, info.mtime_ns or 0)] if good(info.base_name) else []
        return
    folders = [root] if info.type == fs.FileType.Directory else []
    while folders:
        folder = folders.pop()
        if isinstance(store, fs.LocalFileSystem):
            with contextlib.suppress(FileNotFoundError), os.scandir(folder) as entries:
                for e in entries:
                    if e.is_dir():
                        folders += [e.path] * (not e.name.startswith("_temporary-"))
                    elif good(e.name) and e.is_file():
                        with contextlib.suppress(FileNotFoundError):  # it may go meanwhile
                            s = e.stat()
                            yield prefix + e.path, e.path, s.st_size, s.st_mtime_ns
            continue
        for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if f.type == fs.FileType.Directory:
                folders += [f.path] * (not f.base_name.startswith("_temporary-"))
            elif f.type == fs.FileType.File and good(f.base_name):
                yield prefix + f.path, f.path, f.size, f.mtime_ns or 0


def dealt(named: Iterable[tuple[str, str, int]], most: int) -> list[InputPartition]:
    """Files dealt to tasks by size, in the order in which they come; tasks become larger once there are MANY of them."""
    groups, held, size = [], [], 0
    for x in named:
        if held and size + x[2] > most * max(1, len(groups) // MANY):
            groups.append(Group(held))
            held, size = [], 0
        held.append(x)
        size += x[2] + OPEN_BYTES
    return [*groups, Group(held)] if held or not groups else groups


def rows_of(path: str, partition: Group) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Batches of rows, each with the file it is of."""
    store, _ = opened(path)
    for name, at, _size in partition.files:
        with store.open_input_stream(at) as f:
            data = f.read()
        one = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary()), pa.array([kind_of(data, name)], pa.string())], names=["file", "content", "kind"])
        for rows in files._rows(iter([one])):
            yield name, rows


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("pathglobfilter", "*")
        self.most = int(options.get("maxpartitionbytes", MOST_BYTES))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]):
        """Equalities and lists on file and sheet are done here; the rest is given back."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("file",), ("sheet",)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[f.attribute[0]] = self.wanted.get(f.attribute[0], values) & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        named = (x[:3] for x in listed(self.path, self.suffix) if "file" not in self.wanted or x[0] in self.wanted["file"])
        return dealt(named, self.most)

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        sheets = self.wanted.get("sheet")
        for _, rows in rows_of(self.path, partition):
            yield rows if sheets is None else rows.filter(pa.compute.is_in(rows["sheet"], pa.array(sorted(x for x in sheets if x is not None), rows["sheet"].type)))


class Arrivals(DataSourceStreamReader):
    """Files as they arrive. A file is its path and the time of its last change: one that is written anew comes again.

    An offset is the newest time seen and the digests of the files not older than ``lag`` seconds before it. So a file that shows
    up late, by at most ``lag`` (default: 600), is not missed, and an offset holds only the files of the last ``lag`` seconds. Both ends of a
    batch are in the stream's log: a batch that is run again has the same files, those deleted in between apart.

    Where there is a ``log`` (a folder that the driver sees in all runs; keep it as long as the checkpoint), more than INLINE digests are a
    file there, named by its content, and the offset has its name: an offset stays small however many files arrive at once.
    """

    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("pathglobfilter", "*")
        self.most = int(options.get("maxpartitionbytes", MOST_BYTES))
        self.lag, self.log = round(float(options.get("lag", 600)) * 1e9), options.get("log")

    @staticmethod
    def mark(x: tuple) -> bytes:
        return hashlib.blake2b(f"{x[3]} {x[1]}".encode(), digest_size=16).digest()

    def initialOffset(self) -> dict:
        return {"newest": 0, "recent": []}

    def latestOffset(self) -> dict:
        times, marks = array("q"), bytearray()
        for x in listed(self.path, self.suffix):
            times.append(x[3])
            marks += self.mark(x)
        at = np.frombuffer(times, "q") if times else np.empty(0, "q")
        newest = int(at.max(initial=0))
        recent = np.frombuffer(marks, MARK)[at >= newest - self.lag]
        recent = recent[np.lexsort((recent["low"], recent["high"]))]
        if self.log and len(recent) > INLINE:
            return {"newest": newest, "recent": [], "listed": self.noted(recent.tobytes())}
        return {"newest": newest, "recent": [x.tobytes().hex() for x in recent]}

    def noted(self, data: bytes) -> str:
        """Digests as a file of the log; it is whole as soon as it has its name."""
        store, folder = opened(self.log)
        name = hashlib.blake2b(data, digest_size=16).hexdigest()
        if store.get_file_info(f"{folder}/{name}").type != fs.FileType.File:
            store.create_dir(folder, recursive=True)
            with store.open_output_stream(own := f"{folder}/.{uuid.uuid4().hex}") as f:
                f.write(data)
            store.move(own, f"{folder}/{name}")
        return name

    def within(self, offset: dict) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """Whether files, by times and digests, are in an offset."""
        if "listed" in offset:
            store, folder = opened(self.log)
            with store.open_input_stream(f"{folder}/{offset['listed']}") as f:
                data = f.read()
        else:
            data = bytes.fromhex("".join(sorted(offset["recent"])))
        recent = np.frombuffer(data, MARK)
        high = recent["high"].astype("u8")

        def held(times: np.ndarray, marks: np.ndarray) -> np.ndarray:
            first, end = (np.searchsorted(high, marks["high"].astype("u8"), side) for side in ("left", "right"))
            out = times < offset["newest"] - self.lag
            for step in range(int((end - first).max(initial=0))):  # 1, but for digests with one first half
                some = first + step < end
                out[some] |= recent["low"][first[some] + step] == marks["low"][some]
            return out

        return held

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, until = self.within(start), self.within(end)

        def new() -> Iterator[tuple[str, str, int]]:
            found = listed(self.path, self.suffix)
            while some := list(itertools.islice(found, AT_A_TIME)):
                of = np.array([x[3] for x in some], "q"), np.frombuffer(b"".join(map(self.mark, some)), MARK)
                yield from (some[i][:3] for i in np.flatnonzero(until(*of) & ~before(*of)))

        return dealt(new(), self.most)

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        """A file that cannot be read, is gone or has no row is one row with its error."""
        for x in partition.files:
            n = 0
            try:
                for _, rows in rows_of(self.path, Group([x])):
                    n += rows.num_rows
                    yield rows
                error = None if n else "ValueError: the file has no rows"
            except FileNotFoundError as e:
                error = f"FileNotFoundError: {e}"
            if error:
                yield files._batch([(x[0], None, 0, None, 0, None, None, error)])


@dataclass
class Written(WriterCommitMessage):
    """A list of names in order, each with its file (below the job's folder)."""

    names: str


class Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.job = f"_temporary-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        """Files of this try of a task, beside the place they go to: another try has names of its own."""
        store, root = opened(self.path)
        job, own = f"{root.rstrip('/')}/{self.job}", uuid.uuid4().hex
        folder = f"{job}/{own}"
        store.create_dir(folder, recursive=True)
        names = []
        for n, row in enumerate(rows):
            if not row.name or row.name in (".", "..") or "/" in row.name or row.name.startswith(("_", ".")):
                raise ValueError(f"no name of a file: {row.name!r}")
            with store.open_output_stream(f"{folder}/{n}") as f:
                f.write(row.content.encode() if isinstance(row.content, str) else bytes(row.content or b""))
            names.append((row.name, f"{own}/{n}"))
        return self.noted(f"{folder}/names", sorted(names))

    def noted(self, at: str, names: Iterable[tuple[str, str]]) -> Written:
        with opened(self.path)[0].open_output_stream(at, buffer_size=1 << 16) as f:
            for x in names:
                f.write(f"{json.dumps(x)}\n".encode())
        return Written(at)

    def written(self, messages: list[Written]) -> Iterator[tuple[str, str]]:
        """(name, file) of lists in the order of names; only a piece of each list is held."""

        def of(at: str) -> Iterator[tuple[str, str]]:
            with opened(self.path)[0].open_input_stream(at, buffer_size=1 << 16) as f:
                yield from (tuple(json.loads(x)) for x in io.TextIOWrapper(f, "utf-8", newline="\n"))

        return heapq.merge(*(of(x.names) for x in messages))

    def commit(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        job, lists = f"{root.rstrip('/')}/{self.job}", [x for x in messages if x]
        while len(lists) > OPEN_LISTS:
            lists = [*lists[OPEN_LISTS:], self.noted(f"{job}/{uuid.uuid4().hex}", self.written(lists[:OPEN_LISTS]))]
        last = None
        for name, _ in self.written(lists):
            if name == last:
                self.abort(messages)
                raise ValueError("two rows have one name")
            last = name
        if self.overwrite and store.get_file_info(root).type == fs.FileType.Directory:
            new = self.written(lists)
            kept = next(new, None)
            for name in sorted(f.base_name for f in store.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File):
                while kept and kept[0] < name:
                    kept = next(new, None)
                if not kept or kept[0] != name:
                    store.delete_file(f"{root.rstrip('/')}/{name}")
        for name, source in self.written(lists):
            store.move(f"{job}/{source}", f"{root.rstrip('/')}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing that this job wrote is left beside the files."""
        store, root = opened(self.path)
        if store.get_file_info(f"{root.rstrip('/')}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root.rstrip('/')}/{self.job}")


class Statement(DataSource):
    """options: path, pathGlobFilter, maxPartitionBytes; of a stream also lag (in seconds) and log (a folder)."""

    @classmethod
    def name(cls) -> str:
        return "statement"

    def schema(self) -> str:
        return files.SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema) -> Arrivals:
        return Arrivals(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        if set(schema.names) != {"name", "content"}:
            raise ValueError("a table of files has the columns name and content")
        return Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session; filters reach it only where the session lets Python sources have them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Statement)


def persist_stream(grid: DataFrame, path: str, checkpoint: str, now: bool = False):
    """Keeps a stream of statement files as a table with ``failed``, a partition: false: rows of cells; true: dead letters, a row a file with its error.

    A batch is parsed and written once, as a folder by its id; a batch that is run again replaces its own folder. now: what is there, then stop.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows.withColumn("failed", F.col("error").isNotNull()).write.mode("overwrite").partitionBy("failed").parquet(f"{path}/batch={batch}")

    w = grid.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (w.trigger(availableNow=True) if now else w).start()


def stored(spark: SparkSession, path: str, failed: bool) -> DataFrame:
    """What ``persist_stream`` keeps: rows, or dead letters; the files of the other are not read."""
    held = spark.read.schema(f"{files.SCHEMA}, batch int, failed boolean").option("basePath", path).parquet(path)
    return held.where(F.col("failed") == failed).drop("failed")
