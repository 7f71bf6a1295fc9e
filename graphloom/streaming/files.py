"""Changes of a tree of files as a stream: a data source whose offsets are listings of the tree. Paths are excluded by their path from the root or their absolute path."""

from __future__ import annotations

import json
import os
import re
import sys
import time
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions import globs
from ..functions.globs import DEFAULT_EXCLUDES, glob_regex

for _m in (sys.modules[__name__], globs):
    cloudpickle.register_pickle_by_value(_m)

#: Files of two listings that one task compares.
PER_TASK = 100_000


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def compiled(patterns) -> list[re.Pattern]:
    return [re.compile(glob_regex(g), re.S) for g in patterns]


def opened(path: str, out: list[re.Pattern]) -> bool:
    """Whether a folder may hold a file that isn't excluded: not if one pattern matches files of any name and depth below it."""
    return not any(p.match(f"{path}/\x00") and p.match(f"{path}/\x00/\x00") for p in out)


def listed(fs: pafs.FileSystem, base: str, folders: list[str], out: list[re.Pattern], most: int | None = None) -> tuple[list[tuple[str, int, int]], list[str]]:
    """((path, time of change in ns, size) of the files below some folders, folders that are left once ``most`` were opened); paths are from the base, excluded folders are not opened. A folder that has gone meanwhile has no files."""
    at, found, n = list(folders), [], 0
    while at and (most is None or n < most):
        folder, n = at.pop(), n + 1
        try:
            rows = fs.get_file_info(pafs.FileSelector(f"{base}/{folder}" if folder else base))
        except FileNotFoundError:
            continue
        for f in rows:
            path = f"{folder}/{f.base_name}" if folder else f.base_name
            if f.type == pafs.FileType.Directory:
                if opened(path, out) and opened(f"{base}/{path}", out):
                    at.append(path)
            elif f.type == pafs.FileType.File and not any(p.match(path) or p.match(f"{base}/{path}") for p in out):
                found.append((path, f.mtime_ns or 0, f.size))
    return found, at


def listing(root: str, patterns=DEFAULT_EXCLUDES) -> dict[str, list[int]]:
    """path from the root -> [time of change in ns, size] of the files below a root."""
    fs, base = located(root)
    return {path: [at, size] for path, at, size in listed(fs, base, [""], compiled(patterns))[0]}


class _Listings:
    """Numbered listings in a folder of their own; number 0 is the empty one."""

    def __init__(self, state: str):
        self.fs, self.at = located(state)

    def read(self, n: int) -> dict[str, list[int]]:
        if not n:
            return {}
        with self.fs.open_input_stream(f"{self.at}/{n}.json", compression=None) as f:
            return json.loads(f.read())["files"]

    def time(self, n: int) -> float:
        with self.fs.open_input_stream(f"{self.at}/{n}.json", compression=None) as f:
            return json.loads(f.read())["time"]

    def numbers(self) -> list[int]:
        rows = self.fs.get_file_info(pafs.FileSelector(self.at, allow_not_found=True))
        return sorted(int(m[1]) for f in rows if (m := re.fullmatch(r"(\d+)\.json", f.base_name)))

    def write(self, n: int, files: dict[str, list[int]]) -> None:
        self.fs.create_dir(self.at, recursive=True)
        with self.fs.open_output_stream(f"{self.at}/{n}.part", compression=None) as f:
            f.write(json.dumps({"time": time.time(), "files": files}).encode())
        self.fs.move(f"{self.at}/{n}.part", f"{self.at}/{n}.json")

    def drop_before(self, n: int) -> None:
        for old in self.numbers():
            if old < n:
                self.fs.delete_file(f"{self.at}/{old}.json")


class _Part(InputPartition):
    def __init__(self, start: int, end: int, part: int, parts: int):
        self.start, self.end, self.part, self.parts = start, end, part, parts


class FileEventReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.repo_id = options["path"], options["repo_id"]
        self.patterns = [g for g in options.get("exclude", ",".join(DEFAULT_EXCLUDES)).split(",") if g]
        self.listings = _Listings(options["state"])
        self.known: tuple[int, dict[str, list[int]]] | None = None

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        """The number of a listing that equals the tree now; a new one is written only where something has changed."""
        if self.known is None:
            n = max(self.listings.numbers(), default=0)
            self.known = (n, self.listings.read(n))
        now = listing(self.root, self.patterns)
        if now != self.known[1]:
            self.known = (self.known[0] + 1, now)
            self.listings.write(*self.known)
        return {"listing": self.known[0]}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        size = max(len(self.listings.read(end["listing"])), len(self.listings.read(start["listing"])))
        parts = 1 + size // PER_TASK
        return [_Part(start["listing"], end["listing"], i, parts) for i in range(parts)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        old, new = self.listings.read(partition.start), self.listings.read(partition.end)
        at = datetime.fromtimestamp(self.listings.time(partition.end), timezone.utc)
        for path in old.keys() | new.keys():
            if zlib.crc32(path.encode("utf-8", "surrogateescape")) % partition.parts == partition.part and old.get(path) != new.get(path):
                yield self.repo_id, path, "DELETED" if path not in new else "MODIFIED" if path in old else "CREATED", at

    def commit(self, end: dict) -> None:
        self.listings.drop_before(end["listing"] - 1)  # the last batch may be asked for again


class FileEvents(DataSource):
    """``spark.readStream.format("file_events")``: changes of the files below ``path``, new folders' and deleted ones' included.

    Options: ``path`` (a folder that the driver sees), ``repo_id``, ``state`` (a folder shared with the executors, of one stream alone, that keeps the listings which offsets name), ``exclude`` (globs with commas between; excluded folders are not opened). The first listing is held against none, so files that are there at the start are CREATED. A stream that starts again from its checkpoint compares with the listing it had got to, so what happened between isn't lost; several changes of a file between two listings are one. A change's time is that of the listing that shows it.
    """

    @classmethod
    def name(cls) -> str:
        return "file_events"

    def schema(self) -> str:
        return "repo_id string, file_path string, change_type string, ts timestamp"

    def streamReader(self, schema) -> FileEventReader:
        missing = [k for k in ("path", "repo_id", "state") if not self.options.get(k)]
        if missing:
            raise ValueError(f"file_events needs the options {', '.join(missing)}")
        return FileEventReader({k: self.options[k] for k in ("path", "repo_id", "state", "exclude") if k in self.options})


def file_events(spark: SparkSession, root: str, repo_id: str, state: str, patterns=DEFAULT_EXCLUDES):
    """A stream of the changes of a tree, as ``change_log`` gives those of a log."""
    spark.dataSource.register(FileEvents)
    return spark.readStream.format("file_events").option("path", root).option("repo_id", repo_id).option("state", state).option("exclude", ",".join(patterns)).load()


def rewrite(spark: SparkSession, folder: str, keep: bool) -> None:
    """Delete the data files of a folder, or add a line to each; through Spark's file systems."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.listStatus(path):
        if not f.getPath().getName().startswith("part-"):
            continue
        if not keep:
            fs.delete(f.getPath(), False)
            continue
        stream = fs.create(f.getPath(), True)
        stream.write(bytearray(b"changed\n" * 5))
        stream.close()
