import numpy as np
import pytest
from pyspark.sql import functions as F

from prefrank.llm.labelled import held_out, sample_limit, training_rows


@pytest.mark.parametrize("rows", [21_000, 10 ** 6, 3 * 10 ** 10, 10 ** 15])
def test_the_share_holds_at_any_size(rows):
    limit = sample_limit(rows, 20_000)
    assert abs((limit + 2 ** 63) / 2 ** 64 * rows - 20_000) < 1 and -2 ** 63 < limit < 2 ** 63
    assert sample_limit(20_000, 20_000) is None and sample_limit(0, 20_000) is None


def test_samples_are_even_and_one_row_an_id(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    docs = docs.union(docs.where("doc_id < 200").select("doc_id", F.concat(F.lit("z"), "doc_id"))).union(
        docs.where("doc_id = 5").select("doc_id", F.explode(F.array_repeat("text", 500))))
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    labels = labels.union(spark.createDataFrame([(4, 1), (6, None), (None, 1)], "doc_id long, toxic int"))
    learned = {r.doc_id for r in labels.where(~held_out()).select("doc_id").collect()}
    everything = training_rows(docs, labels, "toxic", 10_000).collect()
    assert sorted(r.text for r in everything) == sorted(f"t{i}" for i in learned)
    assert all(r.y == (1 if r.text == "t4" else int(r.text[1:]) % 2) for r in everything)
    some = training_rows(docs, labels, "toxic", 300).collect()
    assert 220 < len(some) < 380 and len({r.text for r in some}) == len(some)
    assert 0.35 < np.mean([r.y for r in some]) < 0.65
    tiny = training_rows(docs, labels, "toxic", 3).count()
    assert tiny <= 12


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (None, "b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert training_rows(docs, none, "toxic", 10).count() == 0
