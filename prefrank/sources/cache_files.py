"""Compaction of the append-only cache: its day folders become one row per key.

Nothing is rewritten in place. The newest entry of each key of a day is written aside, a manifest names the
files it replaces and the files that replace them, and these are moved into the day's folder. Readers may see an
entry twice meanwhile, which lookups do not mind. Replaced files are deleted by a later run, when readers that
listed them have had ``grace_seconds`` to finish. Each step can be repeated after a failure: a run first finishes
what the manifests of earlier ones say, and files of a manifest are not compacted again.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from prefrank.schemas import CACHE_ENTRY
from prefrank.sources.reports import load_rules, write_settings

#: Below the cache; Spark's readers pass over names like this.
_ASIDE = "_compaction"


class _Files:
    """Listing, moving and deleting below the cache."""

    def __init__(self, spark: SparkSession, path: str):
        self.path_of = spark._jvm.org.apache.hadoop.fs.Path
        self.top = path.rstrip("/")
        self.store = self.path_of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        place = self.path_of(f"{self.top}/{folder}" if folder else self.top)
        return sorted(s.getPath().getName() for s in self.store.listStatus(place)) if self.store.exists(place) else []

    def exists(self, name: str) -> bool:
        return self.store.exists(self.path_of(f"{self.top}/{name}"))

    def move(self, source: str, target: str) -> None:
        if self.exists(source) and not self.store.rename(self.path_of(f"{self.top}/{source}"), self.path_of(f"{self.top}/{target}")):
            raise OSError(f"cannot move {source}")

    def delete(self, name: str) -> None:
        self.store.delete(self.path_of(f"{self.top}/{name}"), True)


def _data(names: list[str]) -> list[str]:
    return [n for n in names if not n.startswith(("_", "."))]


def count_files(spark: SparkSession, path: str) -> int:
    """Data files that readers of the cache see."""
    files = _Files(spark, path)
    return sum(len(_data(files.names(day))) for day in files.names("") if day.startswith("day="))


def _manifests(spark: SparkSession, files: _Files) -> dict[str, dict]:
    return {run: load_rules(spark, f"{files.top}/{_ASIDE}/{run}/manifest") for run in files.names(_ASIDE)
            if files.exists(f"{_ASIDE}/{run}/manifest/_SUCCESS")}


def _finish(files: _Files, run: str, manifest: dict, grace_seconds: float) -> bool:
    """Move what is still aside; delete what it replaces once its time is over."""
    for day, moves in manifest["moves"].items():
        for name in moves:
            files.move(f"{_ASIDE}/{run}/rows/{day}/{name}", f"{day}/{name}")
    if time.time() - manifest["at"] < grace_seconds:
        return False
    for day, replaced in manifest["replaced"].items():
        for name in replaced:
            files.delete(f"{day}/{name}")
    files.delete(f"{_ASIDE}/{run}")
    return True


def compact(spark: SparkSession, path: str, least_files: int = 2, grace_seconds: float = 3600.0,
            rows_per_file: int = 5_000_000) -> int:
    """Compact the days of a cache that have ``least_files`` or more files; returns how many were.

    One compaction runs at a time; readers and appending writers may go on.
    """
    files = _Files(spark, path)
    pending = {run: m for run, m in _manifests(spark, files).items() if not _finish(files, run, m, grace_seconds)}
    gone = {day: {n for m in pending.values() for n in m["replaced"].get(day, [])} for day in files.names("")}
    open_days = {day: [n for n in _data(files.names(day)) if n not in gone[day]]
                 for day in files.names("") if day.startswith("day=")}
    open_days = {day: names for day, names in open_days.items() if len(names) >= least_files}
    if not open_days:
        return 0
    run = uuid.uuid4().hex
    aside = f"{files.top}/{_ASIDE}/{run}"
    schema = StructType(CACHE_ENTRY.fields)
    rows: DataFrame = spark.read.schema(schema).option("basePath", files.top).parquet(
        *[f"{files.top}/{day}/{name}" for day, names in open_days.items() for name in names])
    newest = rows.groupBy("day", "key").agg(F.max_by("value", "written_at").alias("value"), F.max("written_at").alias("written_at"))
    # Few files for each day, of a bounded number of rows.
    newest.hint("rebalance", "day").write.option("maxRecordsPerFile", rows_per_file).partitionBy("day").parquet(f"{aside}/rows")
    moves = {day: _data(files.names(f"{_ASIDE}/{run}/rows/{day}")) for day in open_days}
    manifest = {"at": time.time(), "replaced": open_days, "moves": moves}
    write_settings(spark, manifest, f"{aside}/manifest")
    _finish(files, run, manifest, float("inf"))
    return len(open_days)
