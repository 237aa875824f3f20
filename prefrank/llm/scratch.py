"""Intermediate tables in the shared folder: they cut lineage and survive lost executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prefrank.session import scratch_path


class Scratch:
    """Tables of one operator run below ``spark.checkpoint.dir``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = scratch_path(spark, name)
        self._paths: list[tuple[DataFrame, str]] = []

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back."""
        path = f"{self.root}/{len(self._paths):03d}-{name}"
        df.write.parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        self._paths.append((saved, path))
        return saved

    def drop(self, df: DataFrame) -> None:
        """Delete a saved table that nothing reads any more."""
        for saved, path in self._paths:
            if saved is df:
                place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what one Arrow batch of whole texts holds in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def tidy(df: DataFrame, *added: str) -> DataFrame:
    """Input without columns that an operator is about to add (names compare as Spark compares them)."""
    taken = {name.lower() for name in added}
    return df.drop(*[c for c in df.columns if c.lower() in taken])
