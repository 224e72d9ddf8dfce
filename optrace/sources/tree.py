"""A directory tree as a Spark data source: spark.read.format("file_tree").option("root", ...).

A partition is a folder with all below it: the folders of the first levels, until there are PARTITIONS
of them or none is left to divide; what lies above them is a partition of single entries. Conditions on
the start of path, and equality with one, reach the source: folders they rule out are not listed."""

from __future__ import annotations

import grp
import os
import pwd
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringStartsWith

from optrace.functions import paths
from optrace.session import ship_package

ROWS = "path string, name string, is_dir boolean, mode int, owner string, `group` string, mtime double, size bigint, content string"
KINDS = [pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.string()]
NAMES = ["path", "name", "is_dir", "mode", "owner", "group", "mtime", "size", "content"]
PARTITIONS, BATCH = 64, 500


class Store:
    """The file system a root names, with paths below that root."""

    def __init__(self, root: str):
        self.files, self.base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        self.base = self.base.rstrip("/")
        self.local = isinstance(self.files, fs.LocalFileSystem)

    def place(self, path: str) -> str:
        return f"{self.base}/{path}" if path else self.base

    def inside(self, folder: str) -> list[tuple[str, fs.FileInfo]]:
        found = self.files.get_file_info(fs.FileSelector(self.place(folder)))
        return sorted(((f"{folder}/{x.base_name}".lstrip("/"), x) for x in found), key=lambda x: x[0])

    def is_folder(self, info: fs.FileInfo) -> bool:
        return info.type == fs.FileType.Directory and not (self.local and os.path.islink(info.path))

    def row(self, path: str, info: fs.FileInfo, limit: int | None) -> tuple:
        """An entry; bytes that are no UTF-8, or more than limit, leave the content NULL."""
        is_dir = self.is_folder(info) or not path
        mode, owner, group, content = (0o755 if is_dir else 0o644), "root", "root", None
        if self.local:
            found = os.lstat(info.path)
            mode, owner, group = found.st_mode & 0o7777, _name(found.st_uid, pwd.getpwuid), _name(found.st_gid, grp.getgrgid)
        if info.type == fs.FileType.File and (limit is None or info.size <= limit):
            with self.files.open_input_stream(info.path) as stream:
                try:
                    content = stream.read().decode("utf-8")
                except UnicodeDecodeError:
                    content = None
        return path, path.rpartition("/")[2] or "/", is_dir, mode, owner, group, (info.mtime_ns or 0) / 1e9, 0 if is_dir else info.size or 0, content


def _name(number: int, table) -> str:
    try:
        return table(number)[0]
    except KeyError:
        return str(number)


class Part(InputPartition):
    """Entries on their own, and folders with all below them."""

    def __init__(self, entries: list[str], folders: list[str]):
        super().__init__(None)
        self.entries, self.folders = entries, folders


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, limit = options["root"], options.get("contentlimit")
        self.limit, self.starts, self.equal = None if limit is None else int(limit), [], None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what narrows the folders to list; Spark checks rows by every condition again."""
        for found in filters:
            if isinstance(found, StringStartsWith) and found.attribute == ("path",):
                self.starts.append(found.value)
            elif isinstance(found, EqualTo) and found.attribute == ("path",):
                self.equal = found.value
            yield found

    def _may_hold(self, folder: str) -> bool:
        """Can anything below the folder (path with / behind it) meet the conditions?"""
        wanted = [*self.starts, *([self.equal] if self.equal is not None else [])]
        within = f"{folder}/" if folder else ""
        return all(x.startswith(within) or (within.startswith(x) and x != self.equal) for x in wanted)

    def partitions(self) -> list[Part]:
        store, alone, level = Store(self.root), [""], [""]
        while level and len(level) < PARTITIONS:
            below = []
            for folder in level:
                for path, info in store.inside(folder) if self._may_hold(folder) else ():
                    below.append(path) if store.is_folder(info) else alone.append(path)
            alone += below
            if not below:
                level = []
                break
            level = below
        return [Part(alone, []), *(Part([], [x]) for x in level if self._may_hold(x))]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        store, rows = Store(self.root), []

        def found() -> Iterator[tuple]:
            for path in partition.entries:
                yield store.row(path, store.files.get_file_info(store.place(path)), self.limit)
            waiting = list(partition.folders)
            while waiting:
                folder = waiting.pop()
                for path, info in store.inside(folder) if self._may_hold(folder) else ():
                    if store.is_folder(info):
                        waiting.append(path)
                    yield store.row(path, info, self.limit)

        for row in found():
            rows.append(row)
            if len(rows) == BATCH:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), KINDS)], NAMES)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def read_tree(spark: SparkSession, root: str, content_limit: int | None = None) -> DataFrame:
    """Entries below root, the root itself among them; all workers must reach it."""
    ship_package(spark)
    spark.dataSource.register(TreeSource)
    if "spark.sql.python.filterPushdown.enabled" not in spark.conf.getAll:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    found = spark.read.format("file_tree").option("root", root)
    return (found if content_limit is None else found.option("contentLimit", str(content_limit))).load()


def _written(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(root)
        for batch in batches:
            for path, is_dir, content in zip(*(batch.column(x).to_pylist() for x in ("path", "is_dir", "content"))):
                place = store.place(path)
                store.files.create_dir(place if is_dir else place.rpartition("/")[0], recursive=True)
                if not is_dir:
                    with store.files.open_output_stream(place) as stream:
                        stream.write((content or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return run


def write_tree(entries: DataFrame, root: str) -> int:
    """Writes entries (path, is_dir, content) as folders and files below root and gives their number. A
    task that runs again writes the same files again."""
    ship_package(entries.sparkSession)
    rows = entries.select(paths.normalize(F.col("path")).alias("path"), "is_dir", "content")
    return rows.mapInArrow(_written(root), "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
