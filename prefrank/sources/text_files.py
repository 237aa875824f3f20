"""Recursive scan of text files with exact line numbers."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefrank import fixed_values as fixed
from prefrank.sources.tables import path_exists


def existing_targets(spark: SparkSession, targets) -> list[str]:
    """Targets that exist, in order and once each; a missing one is warned about."""
    found = []
    for target in targets:
        if not path_exists(spark, target):
            warnings.warn(f"target does not exist: {target}", stacklevel=2)
        elif target not in found:
            found.append(target)
    return found


def _reader(spark: SparkSession, extensions):
    names = ",".join(e.lstrip(".") for e in extensions)
    return (spark.read.format("text")
            .option("recursiveFileLookup", True)
            # At least one character before the dot: '.log' has no extension.
            .option("pathGlobFilter", "?*.{" + names + "}"))


def hidden_files(spark: SparkSession, targets, extensions=fixed.AUDIT_EXTENSIONS) -> int:
    """Files with a wanted extension that Spark's file sources pass over.

    These sources skip names, and folders, that begin with ``_`` or ``.``. The listing reads
    file names only.
    """
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = set()
    for target in targets:
        top = path_of(target)
        store = top.getFileSystem(conf)
        base = store.makeQualified(top).toString().rstrip("/")
        listing = store.listFiles(top, True)
        while listing.hasNext():
            name = listing.next().getPath().toString()
            below = name[len(base):].strip("/").split("/") if name.startswith(base) else [name.rsplit("/", 1)[-1]]
            parts = below if below != [""] else [name.rsplit("/", 1)[-1]]
            wanted = any(parts[-1].endswith(e) and len(parts[-1]) > len(e) for e in extensions)
            if wanted and any(p.startswith(("_", ".")) for p in parts):
                found.add(name)
    return len(found)


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


class TextScan:
    """Lines of text files, with numbers computed only for the lines asked for.

    Files are split like any other text input. A line's number is the count of lines in
    the earlier splits of its file plus its place in its own split, so numbering needs
    one narrow row per split and no shuffle of the lines.
    """

    def __init__(self, spark: SparkSession, targets, extensions=fixed.AUDIT_EXTENSIONS):
        self.targets = existing_targets(spark, targets)
        self.files = self.skipped = 0
        if not self.targets:
            self._rows = _empty(spark, "path string, block long, row long, content string")
            return
        raw = _reader(spark, extensions).load(self.targets)
        self.skipped = hidden_files(spark, self.targets, extensions)
        # The scan's own file list, each file once and empty ones included; only its length leaves the JVM.
        self.files = len(raw._jdf.inputFiles())
        self._rows = raw.select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
            F.col("value").alias("content"))

    @property
    def lines(self) -> DataFrame:
        """(path, block, row, content); filter this, then call :meth:`number`."""
        return self._rows

    def number(self, chosen: DataFrame) -> DataFrame:
        """Replace (block, row) of the chosen lines by their line number from 1.

        Both reads of the files cut them into the same splits, which is what ties a line's
        place to its split; files must not change in between.
        """
        splits = self._rows.groupBy("path", "block").agg(
            F.min("row").alias("first"), F.count("*").alias("n"))
        earlier = (Window.partitionBy("path").orderBy("block")
                   .rowsBetween(Window.unboundedPreceding, -1))
        starts = splits.select(
            "path", "block", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
        line = F.col("before") + F.col("row") - F.col("first") + 1
        # Spark reports paths percent-encoded; a plus sign stands for itself in them.
        plain = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
        return (chosen.join(starts, ["path", "block"])
                .withColumns({"line": line, "path": plain}).drop("block", "row", "first", "before"))
