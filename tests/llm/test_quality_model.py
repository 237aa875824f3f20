import random
import zlib

import numpy as np
import pyarrow as pa

from prefrank.llm.quality_model import STATISTICS, grow, score_quality, statistics, train_quality
from samples import prose


def test_statistics_of_a_text():
    text = "One two, two! TWO x|y.\n\nOne two, two! TWO x|y.\nno end\n"
    row = dict(zip(STATISTICS, statistics(pa.array([text, "é", None]))[0]))
    words = ["one", "two", "two", "two", "x", "y"] * 2 + ["no", "end"]
    assert row["log_words"] == np.log1p(len(words)) and row["log_lines"] == np.log1p(3)
    assert row["same_as_previous"] == 4 / 14 and row["top_word"] == 6 / 14 and row["distinct_words"] == 6 / 14
    assert row["repeated_lines"] == 2 / 3 and row["ended_lines"] == 2 / 3 and row["short_lines"] == 1 / 3
    assert row["upper_words"] == 2 / 14 and row["pipe_share"] == 2 / len(text)


def test_batches_do_not_change_statistics():
    texts = [prose(i, 5 * i) for i in range(20)] + ["", None, "a\nb\nb", "x" * 1000, "é" * 10]
    together = statistics(pa.array(texts))
    assert np.allclose(together, np.concatenate([statistics(pa.array([t], pa.string())) for t in texts]))


def test_flat_trees_walk_like_the_definition():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    trees = grow(x, y, trees=30, depth=3)

    def slow(row):
        total = trees.bias
        for feature, cut, value in zip(trees.feature, trees.cut, trees.value):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-total))

    score = trees.score(x)
    assert np.allclose(score[:100], [slow(r) for r in x[:100]])
    assert ((score > 0.5) == y).mean() > 0.95
    fresh = rng.normal(size=(800, 4))
    assert ((trees.score(fresh) > 0.5) == ((fresh[:, 0] > 0.3) ^ (fresh[:, 2] > 0))).mean() > 0.9


def test_held_out_documents_and_defined_results(spark, table):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(500):
        words = prose(i, rng.randrange(20, 120)).split()
        if i % 4 == 0:
            words = [w + "***" for w in words] if i % 8 else [words[0]] * 60
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 > 0)))
    docs = table(rows)
    model = train_quality(docs, spark.createDataFrame(labels, "doc_id bigint, quality int"))
    got = {r.doc_id: r.predicted for r in score_quality(docs, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i] == labels[i][1] for i in held]) > 0.97
    odd = score_quality(table([(1, None), (2, ""), (None, "x" * 300000), (1, None)], "score"), model).collect()
    assert len(odd) == 4 and all(0 <= r.score <= 1 for r in odd) and odd[0].score == odd[1].score
    assert score_quality(table([]), model).count() == 0
    none = train_quality(docs, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert score_quality(docs, none).first().score == 0.5
