import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prefrank.operators import metrics, ordering


def frame(spark, labels, probabilities, **extra):
    rows = [(i, None if y is None else int(y), [float(v) for v in p], *[c[i] for c in extra.values()])
            for i, (y, p) in enumerate(zip(labels, probabilities))]
    names = "".join(f", {n} string" for n in extra)
    return spark.createDataFrame(rows, "id long, label int, probabilities array<double>" + names)


def pairwise_auc(y, s):
    pos, neg = s[y], s[~y]
    if not len(pos) or not len(neg):
        return None
    return float(np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])))


def ece(labels, p, n=10):
    conf, ok = p.max(1), (p.argmax(1) == labels).astype(float)
    edges = np.linspace(0, 1, n + 1)
    total = 0.0
    for lo, hi in zip(edges[:-1], edges[1:]):
        m = (conf >= lo) & (conf < hi)
        if m.any():
            total += m.mean() * abs(ok[m].mean() - conf[m].mean())
    return total


def tie_averaged_dcg(relevance, score, k):
    order = np.argsort(-score, kind="stable")
    discounts = np.where(np.arange(len(score)) < k, 1 / np.log2(np.arange(len(score)) + 2), 0)
    total = 0.0
    for value in np.unique(score):
        places = score[order] == value
        total += relevance[order][places].mean() * discounts[places].sum()
    return total


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(3)
    raw = np.round(rng.dirichlet([1, 1, 1], 400), 2) + 0.01
    # A third of the rows shares one score.
    raw[:133] = [0.5, 0.3, 0.2]
    return rng.integers(0, 3, 400), raw / raw.sum(1, keepdims=True)


@pytest.mark.parametrize("buckets", [2, 7, 256])
def test_auc_equals_pairwise_definition(spark, sample, buckets):
    labels, p = sample
    got = {r["class"]: r for r in metrics.auc_by_class(frame(spark, labels, p), buckets=buckets).collect()}
    for c in range(3):
        assert got[c].auc == pytest.approx(pairwise_auc(labels == c, p[:, c]), abs=1e-12)
        assert got[c].positives == (labels == c).sum()


def test_auc_of_chunks_null_and_nan_scores(monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(["x", None][i % 2], int(rng.integers(0, 3)), [float(v) for v in np.round(rng.random(3), 2)]) for i in range(900)]
    rows[0] = ("x", 0, [None, float("nan"), 0.5])
    rows[1] = (None, 1, None)
    table = pa.table({"g": [r[0] for r in rows], "label": pa.array([r[1] for r in rows], pa.int32()),
                      "probabilities": pa.array([r[2] for r in rows], pa.list_(pa.float64()))})
    monkeypatch.setattr(metrics, "CHUNK_ROWS", 100)
    schema = pa.schema([("g", pa.string()), ("class", pa.int32()), ("bucket", pa.int32()), ("positive", pa.bool_()),
                        ("scores", pa.binary()), ("counts", pa.binary())])
    runs = pa.Table.from_batches(metrics._sorted_scores(["g"], np.array([0.2, 0.5]), schema)(iter(table.to_batches(40))))
    for g in ("x", None):
        for c in range(3):
            pairs = below = positives = 0
            for bucket in range(3):
                part = [i for i, r in enumerate(runs.to_pylist()) if (r["g"], r["class"], r["bucket"]) == (g, c, bucket)]
                found = metrics._bucket_pairs(runs.take(part)).to_pylist()[0]
                pairs += found["pairs"] + found["pos"] * below
                below += found["neg"]
                positives += found["pos"]
            group = [r for r in rows if r[0] == g and r[2] is not None]
            scores = np.array([-1.0 if r[2][c] is None else 2.0 if np.isnan(r[2][c]) else r[2][c] for r in group])
            want = pairwise_auc(np.array([r[1] for r in group]) == c, scores)
            assert pairs / (positives * below) == pytest.approx(want, abs=1e-12)


def test_auc_shuffles_sorted_runs_not_scores(spark, sample):
    labels, p = sample
    plan = metrics.auc_by_class(frame(spark, labels, p))._jdf.queryExecution().executedPlan().toString()
    assert "score" not in " ".join(line for line in plan.split("\n") if "Exchange" in line)
    assert plan.count("rangepartitioning") == 0 and "FlatMapGroupsInArrow" in plan


def test_bundle(spark, sample):
    labels, p = sample
    row = metrics.evaluation_metrics(frame(spark, labels, p)).first()
    assert row.accuracy == pytest.approx((p.argmax(1) == labels).mean())
    assert row.log_loss == pytest.approx(-np.log(p[np.arange(400), labels]).mean())
    assert row.preference_score_mean == pytest.approx(p.max(1).mean())
    assert row.ece == pytest.approx(ece(labels, p))
    assert row.auc == pytest.approx(np.mean([pairwise_auc(labels == c, p[:, c]) for c in range(3)]))


def test_bundle_by_group(spark, sample):
    labels, p = sample
    group = np.where(np.arange(400) % 3 == 0, "x", "y")
    got = {r.g: r for r in metrics.evaluation_metrics(frame(spark, labels, p, g=group.tolist()), ["g"]).collect()}
    for g in "xy":
        m = group == g
        assert got[g].n == m.sum()
        assert got[g].auc == pytest.approx(np.mean([pairwise_auc(labels[m] == c, p[m, c]) for c in range(3)]))
        assert got[g].ece == pytest.approx(ece(labels[m], p[m]))


def test_edge_cases(spark):
    perfect = frame(spark, [0, 1, 2, 0, 1], np.eye(3)[[0, 1, 2, 0, 1]])
    row = metrics.evaluation_metrics(perfect).first()
    assert (row.accuracy, row.auc, row.ece) == (1.0, 1.0, 0.0)
    empty = metrics.evaluation_metrics(perfect.limit(0)).first()
    assert [empty[c] for c in ("accuracy", "auc", "log_loss", "preference_score_mean", "ece")] == [0.0] * 5
    uniform = metrics.evaluation_metrics(frame(spark, [0, 1, 2] * 4, [[1 / 3] * 3] * 12)).first()
    assert uniform.auc == 0.5
    two = metrics.evaluation_metrics(frame(spark, [0, 1, 0], [[.5, .3, .2]] * 3)).first()
    assert two.auc == 0.0
    off = metrics.evaluation_metrics(frame(spark, [0, 1, 2], [[.5, .3, .1]] * 3)).first()
    assert off.auc == 0.0
    wrong = metrics.point_metrics(frame(spark, [1], [[1.0, 0.0, 0.0]])).first()
    assert wrong.log_loss == pytest.approx(-math.log(2.220446049250313e-16), rel=1e-6)
    unlabelled = metrics.point_metrics(frame(spark, [0, None], [[1.0, 0.0, 0.0]] * 2)).first()
    assert unlabelled.n == 1


def test_bin_edges(spark):
    edges = [i * (1.0 / 10) for i in range(4, 10)] + [1.0]
    p = np.array([[e, 0, 0] for e in edges])
    bins = {r.bin: r.n for r in metrics.calibration_bins(frame(spark, [0] * 7, p)).collect()}
    assert bins == {4: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1, None: 1}


def test_ndcg(spark):
    rng = np.random.default_rng(5)
    lists = {q: (rng.integers(0, 4, n).astype(float), np.round(rng.random(n), 1))
             for q, n in ((0, 4), (1, 30), (2, 200), (3, 12))}
    lists[4] = (np.zeros(5), rng.random(5))
    lists[5] = (np.array([3., 2, 1, 0]), np.array([3., 2, 1, 0]))
    rows = [(q, float(r), float(s)) for q, (rel, sc) in lists.items() for r, s in zip(rel, sc)]
    df = spark.createDataFrame(rows, "query_id long, relevance double, score double")
    for k in (1, 4, 10):
        got = {r.query_id: r.ndcg for r in metrics.ndcg(df, k=k).collect()}
        for q, (rel, sc) in lists.items():
            ideal = tie_averaged_dcg(rel, rel, k)
            want = tie_averaged_dcg(rel, sc, k) / ideal if ideal else 0.0
            assert got[q] == pytest.approx(want), (q, k)


def test_ndcg_cuts_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0)], "query_id long, relevance double, score double")
    plan = metrics.ndcg(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_losses(spark):
    rng = np.random.default_rng(7)
    logits, labels = rng.normal(size=(60, 3)) * 3, rng.integers(0, 3, 60)
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    rows = [(i // 30, i // 8, int(y), [float(v) for v in z], [float(v) for v in q])
            for i, (y, z, q) in enumerate(zip(labels, logits, p))]
    df = spark.createDataFrame(rows, "epoch int, batch int, label int, logits array<double>, probabilities array<double>")
    target = np.full((60, 3), 0.1 / 3)
    target[np.arange(60), labels] += 0.9
    cls = -(target * np.log(p)).sum(1)
    sign = np.where(labels == 0, 1, -1)
    rank = np.maximum(0, -sign * (p[:, 0] - p[:, 1]) + 0.1)
    keep = labels != 2
    row = metrics.combined_loss(df).first()
    assert row.cls_loss == pytest.approx(cls.mean())
    assert row.rank_loss == pytest.approx(rank[keep].mean())
    assert row.loss == pytest.approx(0.7 * row.cls_loss + 0.3 * row.rank_loss)
    plain = metrics.combined_loss(df, smoothing=0.0).first()
    assert plain.cls_loss == pytest.approx(-np.log(p[np.arange(60), labels]).mean())
    ties = metrics.combined_loss(df.where("label = 2")).first()
    assert ties.rank_loss == 0.0
    by_epoch = {r.epoch: r for r in metrics.epoch_losses(df).collect()}
    idx = np.arange(60)
    batches = [cls[(idx // 30 == 0) & (idx // 8 == b)].mean() for b in range(4)]
    assert by_epoch[0].cls_loss == pytest.approx(np.mean(batches))


def test_gates(spark):
    df = spark.createDataFrame([(0.72, 0.8, 0.07)], "auc double, accuracy double, ece double")
    assert {r.metric: r.status for r in metrics.acceptance_gate(df).collect()} == {"auc": "ok", "ece": "warn"}
    from prefrank.fixed_values import STRICT_GATE
    assert {r.metric: r.status for r in metrics.acceptance_gate(df, STRICT_GATE).collect()} == {
        "auc": "fail", "accuracy": "ok", "ece": "fail"}


def test_exact_quantiles(spark):
    rng = np.random.default_rng(11)
    values = np.round(rng.normal(size=500) * 10.0 ** rng.integers(-6, 9, 500), 3)
    values[:170] = 0.25
    values[170:180] = [-0.0, 0.0, 1e-300, -1e-300, 1e300, -1e300, 5e-324, -5e-324, 1.0, -1.0]
    group = np.array([None, "a", "b"], object)[np.arange(500) % 3]
    df = spark.createDataFrame([(g, float(x)) for g, x in zip(group, values)] + [("a", None), ("only nulls", None), ("one", 7.0)],
                               "g string, x double")
    shares = [0.0, 0.05, 0.5, 0.95, 0.99, 1.0]
    everything = np.append(values, 7.0)
    got = {r.share: r["quantile"] for r in ordering.exact_quantiles(df, "x", shares).collect()}
    assert got == {s: pytest.approx(np.quantile(everything, s), rel=1e-12) for s in shares}
    rows = ordering.exact_quantiles(df, "x", shares, ["g"]).collect()
    assert len(rows) == 4 * 6
    for r in rows:
        inside = values[[g == r.g for g in group]] if r.g != "one" else np.array([7.0])
        assert r["quantile"] == pytest.approx(np.quantile(inside, r.share), rel=1e-12)
    assert ordering.exact_quantiles(df.limit(0), "x", shares).collect() == []
    whole = df.select(F.rint("x").try_cast("int").alias("n"))
    assert ordering.exact_quantiles(whole.where("abs(n) < 1000"), "n", [0.5]).first()["quantile"] is not None
    odd = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (float("-inf"),)], "x double")
    ends = {r.share: r["quantile"] for r in ordering.exact_quantiles(odd, "x", [0.0, 1.0]).collect()}
    assert ends[0.0] == float("-inf") and np.isnan(ends[1.0])


def test_quantiles_read_the_table_four_times(spark):
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        reads.add(1)
        yield from batches

    df = spark.range(2000, numPartitions=1).selectExpr("cast(id * 37 % 1009 as double) x", "id % 3 g").mapInArrow(counted, "x double, g bigint")
    shares = [i / 20 for i in range(21)]
    got = {r.share: r["quantile"] for r in ordering.exact_quantiles(df, "x", shares).collect()}
    assert reads.value == 4
    values = np.array([i * 37 % 1009 for i in range(2000)], float)
    assert got == {s: pytest.approx(np.quantile(values, s)) for s in shares}
    assert len(ordering.exact_quantiles(df, "x", [0.5], ["g"]).collect()) == 3 and reads.value == 8


@pytest.mark.parametrize("buckets", [3, 64])
def test_positions_and_chunks(spark, buckets):
    ids = np.unique(np.random.default_rng(1).integers(0, 10**15, 333)).tolist()
    df = spark.createDataFrame([(int(i),) for i in ids], "id long").repartition(5)
    got = {r.id: r.position for r in ordering.with_position(df, "id", buckets=buckets).collect()}
    assert got == {i: n for n, i in enumerate(sorted(ids))}
    chunks = {r.id: r.chunk for r in ordering.chunk(df, "id", 16, buckets=buckets).collect()}
    assert chunks == {i: n // 16 for n, i in enumerate(sorted(ids))}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 100, 1000, 1023])
def test_permutations_are_one_to_one(spark, n):
    places = spark.range(n)
    orders = [[r[0] for r in places.select("id", ordering.permuted("id", n, seed).alias("p")).orderBy("id").select("p").collect()]
              for seed in (1, 2)]
    assert all(sorted(o) == list(range(n)) for o in orders)
    if n >= 100:
        assert orders[0] != orders[1]
        moved = sum(abs(p - i) > n // 20 for i, p in enumerate(orders[0]))
        assert moved > 0.7 * n and sum(a + 1 == b for a, b in zip(orders[0], orders[0][1:])) < 0.05 * n


def test_permutation_of_large_positions(spark):
    n = 10 ** 13
    got = [r.p for r in spark.range(n - 500, n).select(ordering.permuted("id", n, 3).alias("p")).collect()]
    assert len(set(got)) == 500 and all(0 <= p < n for p in got) and max(got) - min(got) > n // 2


@pytest.mark.parametrize("partitions", [None, 1, 7])
def test_positions_in_any_order(spark, partitions):
    rows = [(f"k{i * 7919 % 1009:04d}", i % 3) for i in range(1009)]
    placed, total = ordering.with_positions(spark.createDataFrame(rows, "k string, c int"), "k", partitions=partitions)
    got = placed.collect()
    assert total == 1009 and placed.columns == ["k", "c", "position"]
    assert [r.position for r in sorted(got, key=lambda r: r.k)] == list(range(1009))
    same, n = ordering.with_positions(spark.createDataFrame([("x",)] * 50, "k string"), "k", partitions=partitions)
    assert sorted(r.position for r in same.collect()) == list(range(50)) and n == 50
    none, n = ordering.with_positions(spark.createDataFrame([], "k string"), "k", partitions=partitions)
    assert none.collect() == [] and n == 0
