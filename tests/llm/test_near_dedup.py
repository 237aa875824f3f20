import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from prefrank.llm.near_dedup import banding_recall, keep_first, near_duplicates, probminhash
from prefrank.llm.similarity import bags, linked, probability_jaccard, similarity
from prefrank.llm.words import Words
from samples import prose


def shingle_set(text):
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text))
    return Counter(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def brute_similarity(a, b):
    x, y = ({k: 1 + np.log(n) for k, n in shingle_set(t).items()} for t in (a, b))
    if not x or not y:
        return 0.0
    both = x.keys() & y.keys()
    plain = len(both) / len(x.keys() | y.keys())
    weighted = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in both)
    return max(plain, weighted)


def test_shingles_are_those_of_the_words():
    texts = ["a b c d e f", "A,b;C d-e f", "one two", "", None, "é è ü " * 4, "x" * 300]
    got = [len(b[0]) for b in bags(pa.array(texts))]
    assert got == [len(shingle_set(t or "")) for t in texts]
    first, second = bags(pa.array(texts[:2]))
    assert (first[0] == second[0]).all()


def test_similarity_is_the_definition():
    rng = random.Random(4)
    base = prose(1, 40).split()
    texts = []
    for _ in range(8):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"new{rng.random()}"
        texts.append(" ".join(words * rng.choice([1, 1, 2])))
    held = bags(pa.array(texts))
    for i, j in itertools.combinations(range(8), 2):
        assert similarity(held[i], held[j]) == pytest.approx(brute_similarity(texts[i], texts[j]))
    want = [[similarity(a, b) >= 0.8 for b in held[4:]] for a in held[:4]]
    assert linked(held[:4], held[4:], 0.8).tolist() == want


def test_sketches_estimate_the_probability_jaccard():
    rng = np.random.default_rng(3)
    element = rng.integers(1, 2**63, 60).astype(np.uint64)
    a, b = rng.uniform(0.5, 4, 40), rng.uniform(0.5, 4, 40)
    x, y = element[:40], element[20:]
    doc = np.repeat([0, 1], 40)
    sketch = probminhash(doc, np.r_[x, y], np.r_[a, b], 2, 4096)
    order = [np.argsort(x), np.argsort(y)]
    bag = (x[order[0]], a[order[0]]), (y[order[1]], b[order[1]])
    at = np.intersect1d(bag[0][0], bag[1][0], return_indices=True)[1:]
    assert (sketch[0] == sketch[1]).mean() == pytest.approx(probability_jaccard(*bag, *at), abs=0.03)
    assert banding_recall(0.8) > 0.9997


def test_short_texts_fill_all_registers():
    sketch = probminhash(np.array([0]), np.array([7], np.uint64), np.ones(1), 1, 100)
    assert (sketch == 7).all()
    assert len(Words(pa.array(["", None])).hash) == 0


def brute_classes(texts):
    """Smallest index of the class of each text, by comparing all pairs."""
    parent = list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if (texts[i] or "") == (texts[j] or "") or brute_similarity(texts[i] or "", texts[j] or "") >= 0.8:
            parent[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(texts))]


def test_classes_are_those_of_all_pairs(spark, table):
    rng = random.Random(7)
    texts = [prose(i, 60) for i in range(30)]
    for i in range(10):
        for k in range(i % 5):
            words = texts[i].split()
            for _ in range(1 + k):
                words[rng.randrange(60)] = f"edit{rng.random()}"
            texts.append(" ".join(words))
    texts += [texts[0], texts[0], "one two", "One, two!", "", None, "", "!!!"]
    rows = list(enumerate(texts))
    got = near_duplicates(table(rows, "class_id")).toPandas()
    want = dict(enumerate(brute_classes(texts)))
    assert dict(zip(got.doc_id, got.class_id)) == want
    assert dict(zip(got.doc_id, got.class_size)) == {i: list(want.values()).count(w) for i, w in want.items()}
    assert set(got[got.is_first].doc_id) == set(want.values())


def test_one_group_with_many_near_copies(spark, table):
    rng = random.Random(2)
    base, texts = prose(9, 80).split(), []
    for _ in range(90):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(80)] = f"edit{rng.random()}"
        texts.append(" ".join(words))
    texts += [prose(300 + i, 60) for i in range(10)]
    got = near_duplicates(table(list(enumerate(texts)))).toPandas()
    want = brute_classes(texts)
    assert dict(zip(got.doc_id, got.class_id)) == dict(enumerate(want)) and 11 < len(set(want)) < 60


def test_copies_with_a_repeated_line_are_found(spark, table):
    texts = []
    for i in range(24):
        line = prose(2000 + i, 20)
        texts += [prose(1000 + i, 104), f"{prose(1000 + i, 104)} " + f"{line}\n" * (5, 10, 20, 50)[i % 4]]
    want = brute_classes(texts)
    assert want == [i - i % 2 for i in range(48)]
    assert max(probability(texts[i], texts[i + 1]) for i in range(0, 48, 2)) < 0.7
    got = near_duplicates(table(list(enumerate(texts)))).toPandas()
    assert dict(zip(got.doc_id, got.class_id)) == dict(enumerate(want))


def probability(a, b):
    a, b = bags(pa.array([a, b]))
    i, j = np.intersect1d(a[0], b[0], return_indices=True)[1:]
    return probability_jaccard(a, b, i, j)


def test_null_ids_repeated_rows_and_empty_tables(spark, table):
    text = prose(5, 50)
    docs = table([(None, text), (None, text), (3, text), (3, text), (None, prose(6, 50))], "n_chars")
    kept = keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.text == text) for r in kept.collect()) == [(False, True), (True, False)]
    assert near_duplicates(table([])).count() == 0 and keep_first(table([])).count() == 0


def test_one_id_with_different_texts(spark, table):
    texts = [prose(60 + i, 50) for i in range(4)]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[2]), (2, texts[2]), (2, texts[3]), (1, texts[0])]
    kept = keep_first(table(rows, "n_chars"))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted(
        [(1, texts[0]), (1, texts[1]), (1, texts[2]), (2, texts[3])])
    got = near_duplicates(table(rows)).toPandas()
    assert got.groupby("text").class_id.nunique().eq(1).all() and got.class_id.nunique() == 4
    assert {1, 2} <= set(got.class_id)


def test_text_ids(spark):
    texts = [prose(70 + i, 50) for i in range(3)]
    rows = [("doc-c", texts[0]), ("doc-a", texts[0] + " tail"), ("doc-b", texts[1]), ("doc-b", texts[2]), (None, texts[2]), (None, prose(80, 50))]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = near_duplicates(docs).collect()
    names = {r.text: r.class_id for r in got}
    assert names[texts[0]] == names[texts[0] + " tail"] == "doc-a" and len(set(names.values())) == 4
    assert all(isinstance(r.class_id, str) for r in got)
    kept = sorted((r.doc_id or "", r.text) for r in keep_first(docs).collect())
    assert kept == sorted([("doc-a", texts[0] + " tail"), ("doc-b", texts[1]), ("doc-b", texts[2]), ("", rows[5][1])])
