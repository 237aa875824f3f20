import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from prefrank.llm.near_dedup import near_duplicates
from prefrank.llm.queries import ORACLES, QUERIES
from prefrank.llm.toxicity import score_toxicity, train_toxicity
from samples import prose

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    folder, docs, held = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        held.append(docs)
    return held


def test_stages_do_what_their_operators_decide(spark, results):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    clean, single, safe, redacted, packed = results
    assert all(r.columns == docs.columns for r in results[:-1])
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    model = train_toxicity(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    assert ids(clean) == ids(score_toxicity(docs, model).where("predicted = 0"))
    assert ids(single) == ids(near_duplicates(clean).where("is_first"))
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert ids(safe) == sorted(r.doc_id for r in single.collect() if not any(i in r.text for i in items))
    assert ids(redacted) == ids(safe) and all(len(r.text) == r.n_chars for r in redacted.collect())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in redacted.collect()}
    rows = packed.toPandas()
    assert rows.groupby("doc_id").length.sum().to_dict() == want
    ends = rows.groupby("sequence_id").apply(lambda g: (g.length.sum(), g.offset.max() < 4096), include_groups=False)
    assert all(n <= 4096 and good for n, good in ends) and rows.sequence_id.nunique() <= np.ceil(sum(want.values()) / 4096 * 1.02)


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert ORACLES.keys() <= QUERIES.keys() and corpus_pipeline.ORACLE_SQL is None


def stored(spark, folder, rows, kind="bigint", extra="leaks"):
    """Tables of a small corpus; documents have a column named like one that an operator adds."""
    spark.createDataFrame([(*r, "old") for r in rows], f"doc_id {kind}, text string, lang string, source string, n_chars bigint, {extra} string"
                          ).write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], 1, 0) for r in rows if r[0] is not None] + [(None, 0, 1)]
    spark.createDataFrame(labels, f"doc_id {kind}, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(0, f"{prose(300, 25)}. {prose(400, 7)}."), (0, f"{prose(301, 25)}. {prose(401, 7)}."), (None, None)]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), items


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_nulls_repeats_long_texts_and_names(spark, tmp_path, kind):
    name = (lambda i: i) if kind == "bigint" else "doc-{}".format
    texts = {i: prose(i, 60) for i in range(1, 9)}
    rows = [(name(i), t, "en", None, len(t)) for i, t in texts.items()]
    rows += [(name(1), texts[1], "en", "again", 5), (name(20), texts[2] + " tail", None, "x", None), (None, texts[3], "en", "x", 1),
             (name(21), None, None, None, None), (name(22), "", "en", "x", 0), (None, None, None, None, None),
             (name(23), prose(50, 40_000), "en", "x", 1), (name(24), "password = hunter2hunter2 " + prose(51, 40), "en", "x", 1)]
    folder, items = stored(spark, tmp_path, rows, kind)
    rows = [(name(30 + k), f"{prose(60 + k, 30)} {t} {prose(70 + k, 30)}", "en", "x", 1) for k, (_, t) in enumerate(items[:2])]
    spark.createDataFrame([(*r, "old") for r in rows], spark.read.parquet(f"{folder}/documents.parquet").schema).write.mode(
        "append").parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for stage, function in corpus_pipeline.STAGES:
        docs = function(spark, docs, folder)
        docs.write.parquet(f"{folder}/{stage}")
        docs = spark.read.parquet(f"{folder}/{stage}")
        kept.append(docs)
    assert all(k.columns == ["doc_id", "text", "lang", "source", "n_chars", "leaks"] for k in kept[:-1])
    # Labels without a toxic text teach nothing: all stay. Copies and empty texts have one row each.
    found = {r.doc_id for r in kept[1].collect()}
    assert {name(i) for i in (1, 2, 3, 4, 5, 6, 7, 8, 23, 24, 30, 31)} <= found and name(20) not in found
    assert sum(not r.text for r in kept[1].collect()) == 1 and kept[1].count() == 13
    assert found - {r.doc_id for r in kept[2].collect()} == {name(30), name(31)}
    texts = {r.doc_id: r.text for r in kept[3].collect()}
    assert "hunter2" not in texts[name(24)] and texts[name(5)] == prose(5, 60) and len(texts) == 11
    assert set(kept[4].columns) >= {"doc_id", "piece", "sequence_id", "offset"}
    assert {r.doc_id for r in kept[4].collect()} == texts.keys()


def test_empty_tables(spark, tmp_path):
    folder, _ = stored(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, folder).count() == 0
