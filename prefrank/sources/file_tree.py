"""Lines of every file of a tree, hidden names too, with exact line numbers from one read.

Spark's file sources pass over names that begin with ``_`` or ``.``. Here tasks list the folders,
cut long files into byte ranges and read them. A range also reports how many lines it has, so that
numbers within a file follow from narrow totals and no file is read twice.
"""

from __future__ import annotations

import os
import re
import stat
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefrank import fixed_values as fixed
from prefrank.session import scratch_path

#: Bytes of a range, bytes read at once, and bytes of lines handed on at once.
RANGE_BYTES = 64 << 20
CHUNK_BYTES = 4 << 20
BATCH_BYTES = 4 << 20
#: Entries that a task lists before it hands the folders left back to the others.
WALK = 10_000

_BREAK = re.compile(rb"\r\n|\r|\n")
LISTED = "path string, size bigint, folder boolean, error string"
LINES = "path string, begin bigint, line bigint, content string, lines bigint, error string"


class _Local:
    """Files of a mounted file system; links to folders are not followed."""

    def listing(self, path: str) -> Iterator[tuple[str, int, bool]]:
        with os.scandir(path) as entries:
            for entry in entries:
                folder = entry.is_dir(follow_symlinks=False)
                if folder or entry.is_file():
                    yield os.path.join(path, entry.name), 0 if folder else entry.stat().st_size, folder

    def kind(self, path: str) -> tuple[int, bool] | None:
        try:
            info = os.stat(path)
        except FileNotFoundError:
            return None
        return info.st_size, stat.S_ISDIR(info.st_mode)

    def open(self, path: str):
        return open(path, "rb")


class _Remote:
    """Files of a store that Arrow can open by its scheme; paths keep it."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.store, path = fs.FileSystem.from_uri(uri)
        self.scheme = uri[:len(uri) - len(path)] if uri.endswith(path) else uri.partition("://")[0] + "://"

    def _bare(self, path: str) -> str:
        return path[len(self.scheme):]

    def listing(self, path: str) -> Iterator[tuple[str, int, bool]]:
        from pyarrow import fs

        for info in self.store.get_file_info(fs.FileSelector(self._bare(path))):
            yield self.scheme + info.path, info.size or 0, info.type == fs.FileType.Directory

    def kind(self, path: str) -> tuple[int, bool] | None:
        from pyarrow import fs

        info = self.store.get_file_info(self._bare(path))
        return None if info.type == fs.FileType.NotFound else (info.size or 0, info.type == fs.FileType.Directory)

    def open(self, path: str):
        return self.store.open_input_file(self._bare(path))


def _local_path(target: str) -> str | None:
    if "://" not in target and not target.startswith("file:"):
        return os.path.abspath(target)
    return "/" + target[len("file:"):].lstrip("/") if target.startswith("file:") else None


def _store(target: str):
    return _Local() if _local_path(target) is not None else _Remote(target)


def readable_in_tasks(target: str) -> bool:
    """Whether tasks can open the target's file system."""
    try:
        _store(target)
        return True
    except (ValueError, OSError, ImportError):
        return False


def _wanted(path: str, extensions) -> bool:
    """As a suffix counts: at least one character stands before the last dot of the name."""
    name = path.rsplit("/", 1)[-1]
    return any(name.endswith(e) and len(name) > len(e) and "." not in e[1:] for e in extensions)


def _walk(extensions):
    schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("folder", pa.bool_()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top in batch.column("path").to_pylist():
                store, pending, rows = _store(top), [top], []
                while pending and len(rows) < WALK:
                    here = pending.pop()
                    try:
                        for path, size, folder in store.listing(here):
                            if folder:
                                pending.append(path)
                            elif _wanted(path, extensions):
                                rows.append((path, size, False, None))
                    except OSError as error:
                        rows.append((here, None, True, f"{type(error).__name__}: {error}"))
                rows += [(path, None, True, None) for path in pending]
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def list_files(spark: SparkSession, targets, extensions=fixed.AUDIT_EXTENSIONS) -> DataFrame:
    """(path, size, folder, error) of all files with a wanted extension below the targets, each once.

    Rows of folders are those that could not be listed, with the error. A missing target is warned about.
    Tasks walk the tree: what a task has not listed after `WALK` entries is dealt out again.
    """
    place = scratch_path(spark, "file-tree")
    files, folders = [], []
    for target in targets:
        path = _local_path(target) or target
        kind = _store(target).kind(path)
        if kind is None:
            warnings.warn(f"target does not exist: {target}", stacklevel=2)
        elif kind[1]:
            folders.append((path.rstrip("/") or "/",))
        elif _wanted(path, extensions):
            files.append((path, kind[0], False, None))
    spark.createDataFrame(files, LISTED).write.parquet(f"{place}/0")
    frontier, turn = spark.createDataFrame(folders, "path string").distinct(), 0
    while not frontier.isEmpty():
        turn += 1
        spread = frontier.repartition(max(2, spark.sparkContext.defaultParallelism))
        spread.mapInArrow(_walk(extensions), LISTED).write.parquet(f"{place}/{turn}")
        frontier = spark.read.schema(LISTED).parquet(f"{place}/{turn}").where("folder and error is null").select("path")
    found = spark.read.schema(LISTED).parquet(*[f"{place}/{k}" for k in range(turn + 1)])
    return found.where("not folder or error is not null").dropDuplicates(["path"])


def lines_between(file, begin: int, end: int) -> Iterator[bytes]:
    """Lines (without their breaks) that start in ``[begin, end)`` of a binary file."""
    at = max(0, begin - 1)
    file.seek(at)
    # From the byte before, the first line is the one that the range before owns, if only by its break.
    foreign, held, scanned = begin > 0, b"", 0
    while True:
        chunk = file.read(CHUNK_BYTES)
        held += chunk
        start = 0
        for found in _BREAK.finditer(held, scanned):
            if chunk and found.end() == len(held) and found.group() == b"\r":
                break  # a line feed may follow
            if at + start >= end:
                return
            if not foreign:
                yield held[start:found.start()]
            foreign, start = False, found.end()
        if not chunk:
            if start < len(held) and at + start < end and not foreign:
                yield held[start:]
            return
        at, held = at + start, held[start:]
        if at >= end:
            return
        scanned = max(0, len(held) - 1)


def _reader(range_bytes: int):
    schema = pa.schema([("path", pa.string()), ("begin", pa.int64()), ("line", pa.int64()), ("content", pa.string()),
                        ("lines", pa.int64()), ("error", pa.string())])

    def batch_of(path: str, begin: int, first: int, lines: list[bytes]) -> pa.RecordBatch:
        n = len(lines)
        return pa.record_batch([
            pa.array([path] * n), pa.array([begin] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()),
            pa.array([line.decode("utf-8", "replace") for line in lines], pa.string()), pa.nulls(n, pa.int64()),
            pa.nulls(n, pa.string())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, begin in zip(batch.column("path").to_pylist(), batch.column("begin").to_pylist()):
                count, size, held, problem = 0, 0, [], None
                try:
                    with _store(path).open(path) as file:
                        for line in lines_between(file, begin, begin + range_bytes):
                            held.append(line)
                            count += 1
                            size += len(line) + 64
                            if size > BATCH_BYTES:
                                yield batch_of(path, begin, count - len(held) + 1, held)
                                held, size = [], 0
                except OSError as error:
                    problem = f"{type(error).__name__}: {error}"
                if held:
                    yield batch_of(path, begin, count - len(held) + 1, held)
                yield pa.record_batch([pa.array([path]), pa.array([begin], pa.int64()), pa.nulls(1, pa.int64()),
                                       pa.nulls(1, pa.string()), pa.array([None if problem else count], pa.int64()),
                                       pa.array([problem], pa.string())], schema=schema)

    return run


def read_lines(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Lines of listed files: (path, begin, line, content, lines, error).

    ``line`` counts from 1 within the range that begins at byte ``begin``. Each range also has one row
    without ``content``: with ``lines``, their number, or with the ``error`` that ended its reading.
    Bytes that are no UTF-8 are replaced; ``\\r\\n``, ``\\r`` and ``\\n`` end lines.
    """
    spark = files.sparkSession
    zero, step = F.lit(0).cast("long"), F.lit(range_bytes).cast("long")
    ranges = files.where("error is null").select(
        "path", F.explode(F.sequence(zero, F.greatest(F.col("size") - 1, zero), step)).alias("begin"))
    return ranges.repartition(max(2, 2 * spark.sparkContext.defaultParallelism), "path", "begin").mapInArrow(
        _reader(range_bytes), LINES)


def number_lines(rows: DataFrame) -> DataFrame:
    """(path, line, content) of chosen stored rows of :func:`read_lines`, the rows without content among them.

    Lines after a range that could not be read have no number.
    """
    totals = rows.where("content is null").groupBy("path", "begin").agg(
        F.max("lines").alias("n"), F.max(F.col("error").isNotNull().cast("int")).alias("broken"))
    earlier = Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("path", "begin", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
                           F.coalesce(F.max("broken").over(earlier), F.lit(0)).alias("lost"))
    return rows.where("content is not null").join(starts, ["path", "begin"]).select(
        "path", F.when(F.col("lost") == 0, F.col("before") + F.col("line")).alias("line"), "content")
