"""Personal-data audit of text lines: (path, line, content) in, findings out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefrank import fixed_values as fixed
from prefrank.functions.privacy import has_pii, rstrip
from prefrank.functions.text import cut

LINE_BREAK = r"\r\n|\r|\n"


def split_lines(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """Numbered lines of a text column, from 1; the text after a final break is no line."""
    # The final break is cut off before the lines are, so that no line row has to carry the array.
    body = F.regexp_replace(F.col(text), rf"({LINE_BREAK})\z", "")
    lines = df.where(F.col(text) != "").select(
        *keep, F.posexplode(F.split(body, LINE_BREAK, -1)).alias("_at", "content"))
    return lines.select(*keep, (F.col("_at") + 1).alias("line"), "content")


def violations(lines: DataFrame, content: str = "content") -> DataFrame:
    """Lines with personal data, content right-trimmed and cut for the record."""
    return lines.where(has_pii(content)).withColumn(content, cut(rstrip(content), fixed.AUDIT_CHARS))


def first_violation(found: DataFrame) -> DataFrame:
    """Strict mode: any one finding decides."""
    return found.limit(1)


def file_totals(found: DataFrame, path: str = "path") -> DataFrame:
    """Findings per file."""
    return found.groupBy(path).agg(F.count("*").alias("violations"))


def distinct_files(files: DataFrame, path: str = "path") -> Column:
    """Number of different files in a table, as a value for :func:`audit_summary`."""
    return files.select(path).distinct().agg(F.count("*")).scalar()


def audit_summary(scanned: Column, found: DataFrame, skipped: int = 0) -> DataFrame:
    """Files scanned, findings and status: FAIL with findings, INCOMPLETE if files were passed over, else PASS."""
    clean = "INCOMPLETE" if skipped else "PASS"
    return found.agg(F.count("*").alias("total_violations")).select(
        scanned.alias("files_scanned"), F.lit(skipped).cast("long").alias("files_skipped"), "total_violations",
        F.when(F.col("total_violations") > 0, "FAIL").otherwise(clean).alias("status"))


def report_rows(found: DataFrame, path: str = "path", lines_per_row: int = 10_000) -> DataFrame:
    """Findings nested per file for a JSON report.

    A row covers a fixed range of line numbers, so a file full of findings becomes
    many rows and no row outgrows a task.
    """
    page = F.floor((F.col("line") - 1) / lines_per_row).alias("page")
    entry = F.struct("line", "content")
    return found.groupBy(path, page).agg(F.sort_array(F.collect_list(entry)).alias("violations"))
