"""Personal-data audit of file trees."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefrank import fixed_values as fixed
from prefrank.functions.privacy import has_pii, rstrip
from prefrank.functions.text import cut
from prefrank.operators import audit
from prefrank.session import scratch_path
from prefrank.sources import file_tree
from prefrank.sources.reports import write_json
from prefrank.sources.text_files import TextScan


@dataclass(frozen=True)
class Audit:
    """Number of files, table of findings and what was passed over of one audit.

    ``unreadable`` has (path, error) of files and folders that could not be read.
    """

    files: int
    violations: DataFrame
    skipped: int = 0
    unreadable: DataFrame | None = None

    @property
    def summary(self) -> DataFrame:
        return audit.audit_summary(F.lit(self.files).cast("long"), self.violations, self.skipped)

    @property
    def per_file(self) -> DataFrame:
        return audit.file_totals(self.violations)

    @property
    def passed(self) -> bool:
        return not self.skipped and audit.first_violation(self.violations).isEmpty()

    def write_report(self, path: str) -> None:
        """Summary, findings and unreadable files as JSON, below ``path``."""
        write_json(self.summary, f"{path}/summary")
        write_json(audit.report_rows(self.violations), f"{path}/violations")
        if self.unreadable is not None:
            write_json(self.unreadable, f"{path}/unreadable")


def audit_files(spark: SparkSession, targets, extensions=fixed.AUDIT_EXTENSIONS) -> Audit:
    """Scan files and folders, hidden ones too; overlapping targets count once, missing ones are skipped.

    Files are read once, in tasks; findings and the line totals of byte ranges are stored in the shared folder. A
    file or folder that cannot be read is reported and the audit goes on; it is then INCOMPLETE, never a PASS.
    Stores that tasks cannot open by themselves are read by Spark's text source, which passes over hidden names
    (counted as skipped).
    """
    if not all(map(file_tree.readable_in_tasks, targets)):
        scan = TextScan(spark, targets, extensions)
        found = scan.number(audit.violations(scan.lines)).select("path", "line", "content")
        return Audit(scan.files, found, scan.skipped)
    place = scratch_path(spark, "audit")
    file_tree.list_files(spark, targets, extensions).write.parquet(f"{place}/files")
    files = spark.read.schema(file_tree.LISTED).parquet(f"{place}/files")
    rows = file_tree.read_lines(files)
    kept = rows.where(F.col("content").isNull() | has_pii("content")).withColumn(
        "content", cut(rstrip("content"), fixed.AUDIT_CHARS))
    kept.write.parquet(f"{place}/rows")
    stored = spark.read.schema(file_tree.LINES).parquet(f"{place}/rows")
    errors = files.select("path", "error").union(stored.select("path", "error")).where("error is not null")
    unreadable = errors.groupBy("path").agg(F.min("error").alias("error"))
    return Audit(files.where("not folder").count(), file_tree.number_lines(stored), unreadable.count(), unreadable)


def has_violation(spark: SparkSession, targets, extensions=fixed.AUDIT_EXTENSIONS) -> bool:
    """Strict mode: whether any line has personal data; reading ends soon after the first finding."""
    if not all(map(file_tree.readable_in_tasks, targets)):
        return not audit.first_violation(audit.violations(TextScan(spark, targets, extensions).lines)).isEmpty()
    rows = file_tree.read_lines(file_tree.list_files(spark, targets, extensions))
    return not audit.first_violation(rows.where(has_pii("content"))).isEmpty()
