import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from prefrank.operators import metrics, runs
from prefrank.operators.dataset import PiiFound
from prefrank.plans import preference_training as training
from prefrank.plans.preference_training import Objective, Schedule, Shape, TrainingRows, batch_sums, combine


def pairs(spark, n=120, noise=7):
    rows = [(str(i), f"pergunta {i}", "palavra " * (1 + 5 * (i % 3 == 0)), "palavra " * (1 + 5 * (i % 3 == 1)), "MEI",
             (i if i % noise else i + 1) % 3, [float(i % 5), 1.0]) for i in range(n)]
    return spark.createDataFrame(rows, "conversation_id string, prompt string, response_a string, response_b string, "
                                       "segment string, label int, emb array<double>")


def sample(shape, n=40, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, shape.embedding_dim + shape.aux_dim)), rng.integers(0, 3, n), rng.normal(size=shape.size) * 0.7


@pytest.mark.parametrize("weight, l2", [(0.7, 0.0), (0.0, 0.1), (1.0, 0.05)])
@pytest.mark.parametrize("dims", [(3, 4), (0, 2), (4, 0)])
def test_gradient_is_that_of_finite_differences(weight, l2, dims):
    shape, objective = Shape(*dims), Objective(cls_weight=weight, l2=l2)
    x, label, vector = sample(shape)

    def value(at):
        return combine(shape, batch_sums(shape, at, x, label, 0.1, 0.1), at, objective)

    _, gradient = value(vector)
    for k in range(shape.size):
        step = np.zeros(shape.size)
        step[k] = 1e-6
        slope = (value(vector + step)[0]["penalised"] - value(vector - step)[0]["penalised"]) / 2e-6
        assert gradient[k] == pytest.approx(slope, abs=2e-7)


def test_losses_are_those_of_the_columns(spark):
    shape = Shape(0, 3)
    x, label, vector = sample(shape, 50, 1)
    losses, _ = combine(shape, batch_sums(shape, vector, x, label, 0.1, 0.1), vector, Objective())
    _, logits, p = training.forward(shape, vector, x)
    rows = [(int(k), z.tolist(), q.tolist()) for k, z, q in zip(label, logits, p)]
    want = metrics.combined_loss(spark.createDataFrame(rows, "label int, logits array<double>, probabilities array<double>")).first()
    for name in ("loss", "cls_loss", "rank_loss"):
        assert losses[name] == pytest.approx(want[name], abs=1e-12)


def test_ties_alone_have_no_ranking_part():
    shape = Shape(2, 0)
    x, _, vector = sample(shape)
    losses, gradient = combine(shape, batch_sums(shape, vector, x, np.full(len(x), 2), 0.1, 0.1), vector, Objective(cls_weight=0.0))
    assert losses["rank_loss"] == 0.0 and not gradient.any()


def test_sums_of_partitions_and_trees(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(training, "FAN_IN", 3)
    shape = Shape(2, 1)
    x, label, vector = sample(shape, 200, 2)
    table = spark.createDataFrame([(int(k), r.tolist(), i % 2) for i, (k, r) in enumerate(zip(label, x))],
                                  "label int, x array<double>, step int")
    table.repartition(25).write.partitionBy("step").parquet(str(tmp_path / "rows"))
    rows = TrainingRows(spark, str(tmp_path / "rows"), shape)
    assert rows.rows().rdd.getNumPartitions() > 3
    mean, deviation = rows.moments()
    assert mean == pytest.approx(x.mean(0)) and deviation == pytest.approx(x.std(0))
    for step in (None, 0, 1):
        chosen = slice(None) if step is None else slice(step, None, 2)
        want = batch_sums(shape, vector, ((x - mean) / deviation)[chosen], label[chosen], 0.1, 0.1)
        assert rows.sums(vector, Objective(), step) == pytest.approx(want)


def test_a_constant_input_and_folded_moments():
    shape = Shape(2, 3)
    x, _, vector = sample(shape, 30, 3)
    x[:, 1] = 5.0
    mean, deviation = x.mean(0), np.where(x.std(0) > 1e-12, x.std(0), 1.0)
    head = shape.head(vector, mean, deviation)
    raw = training.forward(shape, shape.vector(head), x)[2]
    assert raw == pytest.approx(training.forward(shape, vector, (x - mean) / deviation)[2])


def test_minimum_of_the_classification_loss(spark):
    triples = pairs(spark)
    rows = training.training_rows(triples, hidden=False)
    head, history = training.minimize(rows, Objective(cls_weight=1.0), max_iter=100)
    values = [h["penalised"] for h in history]
    assert all(b <= a for a, b in zip(values, values[1:])) and len(values) > 3
    share = triples.groupBy("label").count().collect()
    means = training.predict(head, triples).agg(*[F.avg(F.col("probabilities")[c]) for c in range(3)]).first()
    for r in share:
        assert means[r.label] == pytest.approx(0.9 * r["count"] / 120 + 0.1 / 3, abs=1e-4)
    assert training.objective_value(rows, head, Objective(cls_weight=1.0))["loss"] == pytest.approx(values[-1], abs=1e-9)
    with_rank, _ = training.minimize(rows, Objective(cls_weight=0.7, l2=1e-3), max_iter=100)
    combined = [training.objective_value(rows, h, Objective(cls_weight=0.7))["loss"] for h in (head, with_rank)]
    assert combined[1] <= combined[0] + 1e-3


def test_predictions_in_columns_and_in_stored_rows(spark):
    triples = pairs(spark, 30)
    for hidden, embedding in ((True, None), (True, "emb"), (False, None), (False, "emb")):
        rows = training.training_rows(triples, embedding=embedding, hidden=hidden)
        assert rows.width == 12 + 2 * bool(embedding)
        head = rows.shape.head(rows.shape.start(5))
        got = [sorted((r.label, *np.round(r.probabilities, 9)) for r in df.collect())
               for df in (training.predict(head, triples, embedding), training.predict_rows(head, rows))]
        assert got[0] == got[1] and len(got[0]) == 30


def test_epochs_history_and_early_stopping(spark, tmp_path):
    triples = pairs(spark)
    rows = training.training_rows(triples.where("conversation_id % 4 <> 0"), steps=3)
    held_out = training.training_rows(triples.where("conversation_id % 4 = 0"))
    schedule = Schedule(epochs=6, steps=3, learning_rate=0.2, patience=1)
    head = training.train(rows, str(tmp_path), "run 1", held_out, schedule=schedule)
    history = training.run_history(spark, str(tmp_path), "run 1").orderBy("epoch").collect()
    assert [r.epoch for r in history] == list(range(len(history))) and all(r.run_id == "run 1" for r in history)
    for r in history:
        assert r.loss == pytest.approx(0.7 * r.cls_loss + 0.3 * r.rank_loss)
    # The run ends where early stopping would cut its history, and gives the best epoch's head.
    best, stalled = 0.0, 0
    for k, r in enumerate(history):
        best, stalled = (r.val_auc, 0) if r.val_auc > best else (best, stalled + 1)
        assert stalled < 1 or k == len(history) - 1
    assert stalled == 1 or len(history) == 6
    auc = metrics.evaluation_metrics(training.predict_rows(head, held_out)).first().auc
    assert auc == pytest.approx(max(r.val_auc for r in history))
    chosen = runs.top_checkpoints(training.run_history(spark, str(tmp_path)), 1).first()
    assert chosen.val_auc == pytest.approx(auc)


def test_a_broken_run_goes_on(spark, tmp_path, monkeypatch):
    triples = pairs(spark, 60)
    rows, held_out = training.training_rows(triples, steps=2), training.training_rows(triples)
    schedule = Schedule(epochs=3, steps=2, learning_rate=0.1, patience=9)
    whole = training.train(rows, str(tmp_path / "a"), "r", held_out, schedule=schedule)
    real, calls = metrics.evaluation_metrics, []

    def breaks(*args, **options):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return real(*args, **options)

    monkeypatch.setattr(training.metrics, "evaluation_metrics", breaks)
    with pytest.raises(RuntimeError, match="lost"):
        training.train(rows, str(tmp_path / "b"), "r", held_out, schedule=schedule)
    assert training.run_history(spark, str(tmp_path / "b")).count() == 1
    resumed = training.train(rows, str(tmp_path / "b"), "r", held_out, schedule=schedule)
    assert rows.shape.vector(resumed) == pytest.approx(rows.shape.vector(whole))
    histories = [sorted(tuple(r) for r in training.run_history(spark, str(tmp_path / p)).collect()) for p in "ab"]
    assert [h[:2] for h in histories[0]] == [h[:2] for h in histories[1]]
    # A finished run is not run again.
    training.train(rows, str(tmp_path / "b"), "r", held_out, schedule=schedule)
    assert training.run_history(spark, str(tmp_path / "b")).count() == 3


def test_without_validation_the_last_epoch_counts(spark, tmp_path):
    rows = training.training_rows(pairs(spark, 30), steps=2)
    head = training.train(rows, str(tmp_path), "r", schedule=Schedule(epochs=2, steps=2))
    history = training.run_history(spark, str(tmp_path)).collect()
    assert len(history) == 2 and all(r.val_auc is None for r in history)
    last = training.Checkpoint.load(spark, str(tmp_path / "r" / "epoch-0001"))
    assert rows.shape.vector(head) == pytest.approx(rows.shape.vector(rows.shape.head(last.vector, *rows.moments())))
    assert last.step == 4 and last.epochs == 2


def test_schedule():
    schedule = Schedule(epochs=2, steps=10, learning_rate=1.0, warmup=0.1)
    rates = [schedule.rate(k) for k in range(21)]
    assert rates[:3] == [0.0, 0.5, 1.0] and rates[11] == pytest.approx(0.5) and rates[20] == pytest.approx(0.0)
    assert rates[5] == pytest.approx(0.5 * (1 + math.cos(math.pi * 3 / 18)))


def test_one_step_of_the_optimiser():
    at = training.Checkpoint(np.array([1.0, -2.0]), np.zeros(2), np.zeros(2), step=1)
    schedule = Schedule(epochs=1, steps=4, learning_rate=0.1, warmup=0.0, weight_decay=0.5, clip=1.0)
    gradient = np.array([3.0, 4.0])
    rate = schedule.rate(1)
    training._step(at, gradient, schedule)
    clipped = gradient * (1 / (5 + 1e-6))
    first, second = 0.1 * clipped / (1 - 0.9 ** 2), 0.001 * clipped ** 2 / (1 - 0.999 ** 2)
    assert at.vector == pytest.approx(np.array([1.0, -2.0]) * (1 - rate * 0.5) - rate * first / (np.sqrt(second) + 1e-8))


def test_tables_that_cannot_be_trained_on(spark, tmp_path):
    triples = pairs(spark, 6)
    nothing = training.training_rows(triples.withColumn("label", F.lit(None).cast("int")))
    with pytest.raises(ValueError, match="no labelled rows"):
        training.train(nothing, str(tmp_path), "r")
    with pytest.raises(ValueError, match="no labelled rows"):
        training.minimize(nothing)
    personal = triples.withColumn("prompt", F.lit("fale com a@b.co"))
    with pytest.raises(PiiFound):
        training.training_rows(personal, check_pii=True)
    assert training.training_rows(personal).rows().count() == 6
    blank = triples.withColumn("response_a", F.when(F.col("conversation_id") == "1", " ").otherwise(F.col("response_a")))
    assert training.training_rows(blank).rows().count() == 5


def test_decisions_follow_a_run(spark, tmp_path):
    from prefrank.streaming import run_watch

    rows, held_out = training.training_rows(pairs(spark, 60), steps=2), training.training_rows(pairs(spark, 60))
    path, place = str(tmp_path / "runs"), str(tmp_path / "watch")

    def seen():
        run_watch.start_watching(spark, f"{path}/history", f"{place}/rows", f"{place}/state", patience=2).awaitTermination()
        return {r.run_id: r for r in run_watch.current_decisions(spark, f"{place}/rows").collect()}

    for epochs, run in ((2, "one"), (5, "two")):
        training.train(rows, path, run, held_out, schedule=Schedule(epochs=epochs, steps=2, learning_rate=0.3))
        got = seen()
        for name, r in got.items():
            history = runs.early_stopping(training.run_history(spark, path, name)).orderBy("epoch").collect()
            assert (r.epochs, r.last_epoch, r.best_epoch, r.stop_epoch) == (
                len(history), history[-1].epoch, history[-1].best_epoch, history[-1].stop_epoch)
            assert r.best_auc == pytest.approx(max(0.0, *[h.val_auc for h in history]))
    assert set(got) == {"one", "two"} and seen() == got
    training.train(rows, path, "three", schedule=Schedule(epochs=4, steps=2))
    third = seen()["three"]
    assert (third.epochs, third.best_epoch, third.stop_epoch) == (4, None, None)


def test_fitted_rows_are_scored_without_reading_texts_again(spark, tmp_path, monkeypatch):
    words = ["a b. c", "d e f", "g. h", "i j k l", "m"]
    docs = [(i, " ".join([words[i % 5]] * (1 + i % 7)), "s") for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, int(i % 9 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    calls = []
    prepare = training.prepare
    monkeypatch.setattr(training, "prepare", lambda *a, **k: calls.append(1) or prepare(*a, **k))
    rows = queries()["train_classifier"](spark, str(tmp_path)).collect()
    assert len(calls) == 1 and {r.fitted for r in rows} == {47} and sum(r.mean_probability for r in rows) == pytest.approx(1, abs=1e-3)
