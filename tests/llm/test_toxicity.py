import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from prefrank.llm.toxicity import _document_counts, fit_noisy_or, score_toxicity, train_toxicity
from samples import prose


def corpus(n):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        sentences = [prose(1000 * i + k, 12) + "." for k in range(rng.randrange(1, 6))]
        toxic = i % 3 == 0
        if toxic:
            sentences.insert(rng.randrange(len(sentences) + 1), prose(i, 4) + f" {rng.choice(['idiot', 'scum', 'lowei' + str(i)])} é.")
        rows.append((i, " ".join(sentences)))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def model(spark):
    rows, labels = corpus(600)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return train_toxicity(docs, spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id bigint, toxic int"))


def test_held_out_documents_are_found(spark, model):
    rows, labels = corpus(600)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.predicted for r in score_toxicity(docs, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 100 and all(got[i] == labels[i][1] for i in held)


def test_offending_sentences_are_located(table, model):
    bad = "You lowei77 x."
    text = f"É {prose(1, 9)}. {bad} {prose(2, 9)}!"
    row = score_toxicity(table([(1, text)], "sentences"), model).first()
    assert [text[s.start:s.end] for s in row.sentences] == [bad[:-1]]
    assert 0.7 <= row.score <= 1 and row.score == pytest.approx(1 - np.prod([1 - s.score for s in row.sentences]), abs=1e-6)


def test_defined_results(table, model):
    got = score_toxicity(table([(1, None), (2, ""), (3, "..!\n"), (None, "idiot"), (4, prose(3, 30000))], "score"), model)
    scores = {r.doc_id: (r.score, r.predicted) for r in got.collect()}
    assert [scores[i] for i in (1, 2, 3, 4)] == [(0.0, 0)] * 4 and scores[None][1] == 1
    assert score_toxicity(table([]), model).count() == 0


def test_without_labels_every_score_is_zero(spark, table):
    docs = table([(1, "you idiot")])
    empty = train_toxicity(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert score_toxicity(docs, empty).first().score == 0.0


def test_the_fit_explains_bags():
    """One of two instances of every positive bag has feature 0; the other features are noise."""
    rng = np.random.default_rng(0)
    y = np.arange(200) % 2
    doc, sentence, feature = [], [], []
    for i in range(200):
        for k in range(2):
            doc.append(i)
            sentence.append(2 * i + k)
            feature.append(0 if y[i] and k == 0 else 1 + rng.integers(5))
    w, b = fit_noisy_or(y, np.array(doc), np.array(sentence), np.array(feature), 6)
    assert w[0] + b > 2 and (w[1:] + b < -2).all()


def test_a_task_sums_its_counts_in_bounded_memory():
    texts = [prose(i % 40, 600) for i in range(1200)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([i % 2 for i in range(1200)], pa.int32())], ["text", "y"])
    few, = _document_counts(iter([batch.slice(0, 40)]))
    tracemalloc.start()
    whole, = _document_counts(iter([batch, batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert batch.nbytes > 4 << 20 and peak < 160 << 20
    for name in ("feature", "toxic", "n"):
        times = 1 if name == "feature" else 60
        assert whole.column(name).to_pylist() == [times * x for x in few.column(name).to_pylist()]
    parts = list(_document_counts(iter([batch, batch]), gathered=1000))
    assert len(parts) > 2
    sums = {}
    for part in parts:
        for feature, toxic, n in zip(*(column.to_pylist() for column in part.columns)):
            a, b = sums.get(feature, (0, 0))
            sums[feature] = a + toxic, b + n
    assert sums == {f: (a, b) for f, a, b in zip(*(column.to_pylist() for column in whole.columns))}
