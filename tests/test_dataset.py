import warnings

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from prefrank.operators import contracts, dataset
from prefrank.plans.validation import validation_report
from prefrank.sources import tables

ROWS = [
    ("c1", "p1", "a1", "b1", "model_a", "mei"),
    ("c2", "p2", "a2", "b2", "MODEL_B", None),
    ("c3", None, "a3", "b3", "tie", "CORPORATE"),
    ("c4", "p4", "a4", "b4", "tie (bothbad)", "outro"),
    (None, "p5 a@b.co", "a5", "b5", " tie", "Corporate"),
    ("c6", "p6", "a6", None, None, "MEI"),
]
SCHEMA = ("conversation_id string, prompt string, response_a string, response_b string, winner string, "
          "merchant_segment string")


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_clean(raw):
    rows = dataset.clean_preferences(raw).orderBy("prompt").collect()
    assert [(r.conversation_id, r.segment, r.label) for r in rows] == [
        ("c1", "MEI", 0), ("c2", "VAREJO", 1), ("c4", "VAREJO", 2), (None, "CORPORATE", None)]
    without = dataset.clean_preferences(raw.drop("merchant_segment")).collect()
    assert {r.segment for r in without} == {"VAREJO"}


def test_limit_comes_before_null_removal(raw):
    assert dataset.clean_preferences(raw, max_rows=0).count() == 0
    kept = dataset.clean_preferences(raw.where("conversation_id is not null"), 3, "conversation_id")
    assert [r.conversation_id for r in kept.collect()] == ["c1", "c2"]


def test_missing_columns(raw):
    with pytest.raises(KeyError, match="winner"):
        dataset.clean_preferences(raw.drop("winner"))
    with pytest.raises(KeyError, match="prompt"):
        validation_report(raw.drop("prompt"))


def test_reading_counts_dropped_rows(spark, raw, tmp_path):
    path = str(tmp_path / "table")
    raw.write.parquet(path)
    seen = Observation("load")
    df = tables.read_preferences(spark, path, observation=seen)
    assert df.count() == 4
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        assert tables.warn_if_dropped(seen) == 2
    assert len(caught) == 1
    assert tables.read_for_validation(spark, path, 0).count() == 6
    assert tables.read_for_validation(spark, path, 2).count() == 2
    counts = dataset.row_counts(raw).first()
    assert (counts.rows, counts.dropped, counts.kept) == (6, 2, 4)


@pytest.mark.parametrize("policy,want", [
    ("default", ["MEI", "VAREJO", "VAREJO"]), ("reject", ["MEI", None, "VAREJO"]), ("exact", [None, None, "VAREJO"])])
def test_segment_policies(column, policy, want):
    assert column(dataset.normalize_segment("t", policy), ["mei", "x", None]) == want


def test_label_report(raw):
    rows = {r.winner: r for r in dataset.label_distribution(raw).collect()}
    assert len(rows) == 5 and rows["tie"]["count"] == 1
    assert rows["tie"].pct == pytest.approx(100 / 6)
    wide = raw.limit(1).select("winner").unionByName(
        raw.sparkSession.range(19).select(F.lit("tie").alias("winner")))
    flags = {r.winner: r.underrepresented for r in dataset.label_distribution(wide).collect()}
    assert flags == {"model_a": True, "tie": False}
    assert [r.winner for r in dataset.by_frequency(dataset.label_distribution(wide)).collect()] == ["tie", "model_a"]


def test_validation_report(raw):
    report = {(r.check, r.subject, r.metric): (r.value, r.status) for r in validation_report(raw).collect()}
    assert report["rows", "table", "rows"] == (6.0, "INFO")
    assert report["nulls", "prompt", "nulls"] == (1.0, "WARN")
    assert report["nulls", "response_a", "nulls"] == (0.0, "OK")
    assert report["pii", "table", "with_pii"] == (1.0, "WARN")
    assert report["length", "prompt", "max"] == (9.0, "INFO")
    assert report["length", "prompt", "p95"][0] == pytest.approx(7.6)
    sampled = {(r.check, r.metric): r.value for r in validation_report(raw, pii_sample=3).collect() if r.check == "pii"}
    assert sampled["pii", "checked"] == 3.0


def test_pii_gate(raw):
    with pytest.raises(dataset.PiiFound):
        dataset.pii_gate(raw)
    clean = raw.where("conversation_id is not null")
    assert dataset.pii_gate(clean) is clean


def test_epoch_order_is_repeatable(raw):
    first = [r.prompt for r in dataset.shuffle_rows(raw, "prompt", 1).collect()]
    assert first == [r.prompt for r in dataset.shuffle_rows(raw.repartition(3), "prompt", 1).collect()]
    assert first != [r.prompt for r in dataset.shuffle_rows(raw, "prompt", 2).collect()]


def errors(df):
    return [r.errors for r in df.orderBy("i").collect()]


def test_request_contract(spark):
    ok = ("p", "a", "b", "MEI", "id")
    rows = [ok, ("   ", "a", "b", None, None), ("p" * 4097, "a", "b", "VAREJO", "x" * 129),
            ("p", None, "b", "UNKNOWN", "id"), ("p" * 4096, "a", "", "mei", "id")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "i int, prompt string, response_a string, response_b string, "
                               "merchant_segment string, conversation_id string")
    checked = contracts.check_requests(df)
    assert errors(checked) == [
        [], ["prompt: blank"], ["prompt: too long", "conversation_id: too long"],
        ["response_a: missing", "merchant_segment: unknown"],
        ["response_b: blank", "merchant_segment: unknown"]]
    assert contracts.valid(checked).count() == 1 and contracts.rejected(checked).count() == 4


def test_batch_contract(spark):
    item = ("p", "a", "b", "MEI", "id")
    bad = ("p", " ", "b", "MEI", "id")
    rows = [(0, [item]), (1, []), (2, [item] * 33), (3, [item, bad]), (4, None), (5, [item] * 32)]
    df = spark.createDataFrame(rows, "i int, items array<struct<prompt:string,response_a:string,response_b:string,"
                                     "merchant_segment:string,conversation_id:string>>")
    assert errors(contracts.check_batches(df)) == [
        [], ["items: empty"], ["items: too many"], ["response_a: blank"], ["items: empty"], []]


def test_feedback_contract(spark):
    rows = [("c", "A", 5, "api"), ("", "B", None, None), ("c", "model_a", 0, "fax"), (None, "tie", 6, "mobile")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "i int, conversation_id string, actual_winner string, satisfaction_score int, channel string")
    assert errors(contracts.check_feedback(df)) == [
        [], ["conversation_id: missing"],
        ["actual_winner: unknown", "satisfaction_score: out of range", "channel: unknown"],
        ["conversation_id: missing", "satisfaction_score: out of range"]]
    assert contracts.with_feedback_defaults(df).where("i = 1").first().channel == "api"


def test_result_contract(spark):
    rows = [(0, [.6, .3, .1], "A"), (1, [.6, .5, .4], "A"), (2, [1.2, -.1, -.1], "B"), (3, [.5, .5], "B"),
            (4, None, "tie"), (5, [.6, .3, .10009], "C")]
    df = spark.createDataFrame(rows, "i int, probabilities array<double>, winner string")
    bad = ["probabilities: invalid"]
    assert errors(contracts.check_results(df)) == [[], bad, bad, bad, bad, ["winner: unknown"]]
    scores = contracts.score_range_alerts(df.selectExpr("cast(i as double) / 4 AS s"), "s").first()
    assert (scores.rows, scores.out_of_range) == (6, 1)


def test_feedback_winner(column):
    assert column(dataset.feedback_winner_to_training("t"), ["A", "B", "tie", "x"]) == ["model_a", "model_b", "tie", None]
