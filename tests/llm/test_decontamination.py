import random

import numpy as np
import pytest

from prefrank.llm.decontamination import Postings, block_max_wand, clean_of_items, find_contamination, question_and_answer
from samples import prose


def test_block_max_wand_finds_what_summing_all_postings_finds():
    rng = np.random.default_rng(2)
    for trial in range(60):
        dense = np.where(rng.random((rng.integers(1, 12), 90)) < rng.uniform(0.05, 0.6), rng.exponential(size=90), 0)
        lists = [Postings(np.flatnonzero(row), row[row > 0]) for row in dense if row.any()]
        total = dense.sum(0)
        least = float(np.quantile(total, rng.uniform(0.3, 1))) or 0.1
        got = dict(block_max_wand(lists, least))
        assert sorted(got) == np.flatnonzero(total >= least - 1e-9).tolist(), trial
        assert all(got[d] == pytest.approx(total[d]) for d in got)
    assert block_max_wand([], 0.5) == []


def test_items_split_into_question_and_answer():
    assert question_and_answer("What is the capital of France? Paris.") == ("What is the capital of France? ", "Paris.")
    assert question_and_answer("Only one sentence") == ("Only one sentence", "")
    assert question_and_answer("Too short. Then the rest of it") == ("Too short. Then the rest of it", "")


@pytest.fixture
def items(spark):
    rows = [(i, f"{prose(50 + i, 12 + 9 * i)}. {prose(90 + i, 7)}.") for i in range(12)]
    return rows, spark.createDataFrame([*rows, (None, "no id"), (77, None), (78, "...")], "item_id bigint, text string")


def test_planted_items_are_found_and_no_others(table, items):
    rows, frame = items
    rng = random.Random(1)
    docs, want = [], {}
    for i in range(40):
        words = prose(5000 + i, rng.randrange(0, 300)).split()
        if i % 2:
            item, text = rows[i % 12]
            at = rng.randrange(len(words) + 1)
            words[at:at] = [text.upper() if i % 3 else text]
            want[i] = [item]
        docs.append((i, "É " + " ".join(words)))
    asked = rows[3][1].split(". ")[0]  # a question without its answer is no leak
    docs += [(100, None), (101, ""), (102, f"{prose(1, 40)} {asked} {prose(2, 40)}"), (103, rows[5][1]), (103, rows[5][1])]
    want[103] = [rows[5][0]]
    found = find_contamination(table(docs, "leaks"), frame).collect()
    assert {r.doc_id: [x.item_id for x in r.leaks] for r in found if r.leaks} == want
    assert len(found) == len(docs)
    text = dict(docs)
    for r in found:
        for x in r.leaks:
            assert x.question_overlap == x.answer_overlap == 1 and 0 <= x.start < x.end <= len(text[r.doc_id])
    kept = clean_of_items(table(docs, "n"), frame)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - want.keys()


def test_long_items_are_found_at_all_offsets(spark, table):
    sizes = [58, 93, 113, 123, 143, 185, 249, 393]
    rows = [(i, f"{prose(800 + i, n)}. {prose(900 + i, 7)}.") for i, n in enumerate(sizes)]
    rows.append((8, f"{prose(808, 150)}. {prose(908, 150)}."))  # the answer is longer than a passage
    docs, want = [], {}
    for offset in range(64):
        for i, text in rows:
            docs.append((len(docs), f"{prose(6000 + offset, 64 + offset)} {text} {prose(7000 + i, 200)}"))
            want[docs[-1][0]] = [i]
    docs.append((len(docs), f"{prose(1, 40)} {rows[5][1].split('. ')[0]} {prose(2, 200)}"))  # no answer
    found = find_contamination(table(docs), spark.createDataFrame(rows, "item_id bigint, text string")).collect()
    assert {r.doc_id: [x.item_id for x in r.leaks] for r in found if r.leaks} == want


def test_repeated_and_missing_ids(spark, table):
    texts = [f"{prose(300 + i, 25)}. {prose(400 + i, 7)}." for i in range(5)]
    rows = [(0, texts[0]), (0, texts[1]), (0, texts[2]), (None, texts[3]), (None, texts[4]), (0, texts[0]), (None, None), (0, "")]
    docs = [(i, f"{prose(i, 30)} {t} {prose(i + 9, 30)}") for i, t in enumerate(texts)] + [(9, f"{texts[0]} {texts[1]} {texts[3]}")]
    want = {0: [0], 1: [0], 2: [0], 3: [None], 4: [None], 9: [0, 0, None]}
    for kind in ("bigint", "string"):
        named = [(i if i is None or kind == "bigint" else f"q{i}", t) for i, t in rows]
        found = find_contamination(table(docs), spark.createDataFrame(named, f"item_id {kind}, text string")).collect()
        plain = {k: [i if i is None or kind == "bigint" else f"q{i}" for i in v] for k, v in want.items()}
        assert {r.doc_id: [x.item_id for x in r.leaks] for r in found} == plain


def test_shards_find_the_same(table, items, monkeypatch):
    rows, frame = items
    docs = [(i, f"{prose(i, 30)} {t} {prose(i + 1, 30)}") for i, t in rows]
    monkeypatch.setattr("prefrank.llm.decontamination.SHARD_CHARS", 500)
    got = {r.doc_id: [x.item_id for x in r.leaks] for r in find_contamination(table(docs), frame).collect()}
    assert got == {i: [i] for i, _ in rows}


def test_empty_tables(spark, table, items):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert find_contamination(table([(1, "a")]), none).first().leaks == []
    assert find_contamination(table([]), items[1]).count() == 0
