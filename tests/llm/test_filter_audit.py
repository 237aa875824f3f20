import random
from collections import Counter
from itertools import permutations

import pytest
from samples import prose

from prefrank.llm import filter_audit
from prefrank.llm.filter_audit import audit_filters, judge_document, label_flags, order_report, read_counters, start_audit

KIND = "doc_id bigint, text string, lang string, n string"


def mask_of(text):
    words = [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in text).split(" ") if w]
    return ((len(words) < 200) + 2 * (100 * len(set(words)) < 50 * len(words))
            + 4 * (100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text)) + 8 * any(c in "#$%&*|" for c in text))


def expected(rows, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    docs = []
    for i, text, lang in rows:
        copy = i is not None and i > least[text or ""]
        docs.append((i, lang or "", mask_of(text or "") + 16 * copy))
    out, shapley = [], Counter()
    for part in {d[1] for d in docs}:
        for order in permutations("ABCDE"):
            rest = [d for d in docs if d[1] == part]
            gone = []
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                redundant = sum(d[2] & bit > 0 for d in gone)
                removed = [d for d in rest if d[2] & bit]
                rest = [d for d in rest if not d[2] & bit]
                gone += removed
                shapley[part, letter] += len(removed)
                unique = sum(d[2] == bit for d in docs if d[1] == part)
                out.append((part, "".join(order), step, len(rest), len(removed), redundant, unique,
                            sum(d[0] in good for d in removed), sum(d[0] in toxic for d in removed)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


COLUMNS = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def collected(report):
    return sorted(tuple(r) for r in report.select(*COLUMNS).collect())


def texts(seed, n):
    rng = random.Random(seed)
    base = [prose(s, rng.choice([20, 199, 200, 260])) for s in range(12)]
    base += ["a b " * 150, "LOUD " * 50 + base[0], base[3] + " 5 % #", "", None, "é" * 300 + " X" * 10, "x\x0bx\x1cy\x85z " * 120]
    return [(rng.choice([*range(n), None]), rng.choice(base), rng.choice(["en", "fr", None, ""])) for _ in range(n)]


def written(spark, folder, rows, files, kind=KIND):
    for k in range(files):
        part = [(*r, "clash") for r in rows[k::files]]
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(folder))


def label_table(spark, rows, kind="doc_id bigint, quality int, toxic int"):
    return spark.createDataFrame(rows, kind)


LABELS = [(i, i % 2, i % 3 == 0 or None) for i in range(0, 200, 3)] + [(3, 0, 1), (None, 1, 1), (6, None, None)]
LABELS = [(i, q, t if t is None else int(t)) for i, q, t in LABELS]


@pytest.mark.parametrize("files, keys", [(1, 4096), (3, 2), (9, 64)])
def test_any_cut_into_micro_batches(spark, tmp_path, files, keys):
    rows = texts(5, 160)
    docs = written(spark, tmp_path / "docs", rows, files)
    assert collected(audit_filters(docs, label_table(spark, LABELS), keys=keys)) == expected(rows, LABELS)


def test_smaller_ids_that_come_later_retract(spark, tmp_path):
    same = prose(1, 300)
    rows = [(i, same, lang) for i, lang in [(9, "en"), (7, "fr"), (7, "en"), (8, "fr"), (2, "en"), (2, "fr"), (2, "en"), (5, "en")]]
    labels = [(9, 1, 0), (2, 1, 1), (7, 0, 1)]
    docs = written(spark, tmp_path / "docs", rows, 8)
    place = str(tmp_path / "audit")
    flags = label_flags(label_table(spark, labels))
    start_audit(docs, flags, place, f"{place}/state").awaitTermination()
    assert collected(order_report(read_counters(spark, place))) == expected(rows, labels)
    changes = spark.read.parquet(f"{place}/changes/batch=*")
    assert changes.where("n < 0").count() >= 3
    # Started again, it goes on with new files: a still smaller id takes back what was counted.
    later = [(1, same, "de"), (4, same, "de")]
    docs = written(spark, tmp_path / "docs", later, 1)
    start_audit(docs, flags, place, f"{place}/state").awaitTermination()
    assert collected(order_report(read_counters(spark, place))) == expected(rows + later, labels)


def test_text_ids(spark, tmp_path):
    rows = [(f"doc-{i}", t, lang) for i, t, lang in texts(6, 60) if i is not None] + [(None, "x", "en"), (None, "x", "en")]
    labels = [(f"doc-{i}", 1, i % 2) for i in range(0, 60, 2)]
    docs = written(spark, tmp_path / "docs", rows, 4, KIND.replace("bigint", "string"))
    got = audit_filters(docs, label_table(spark, labels, "doc_id string, quality int, toxic int"))
    assert collected(got) == expected(rows, labels)


def test_many_copies_do_not_meet(spark, tmp_path):
    rows = [(i, "one text", "en") for i in range(3000)] + [(i, f"text {i}", "en") for i in range(40)]
    docs = written(spark, tmp_path / "docs", rows, 2)
    got = collected(audit_filters(docs, label_table(spark, LABELS)))
    assert got == expected(rows, LABELS)
    run = filter_audit._collapse(judge_document, 16, True, 1 << 20)
    import pyarrow as pa
    batch = pa.record_batch([pa.array(range(3000)), pa.array(["en"] * 3000), pa.array(["one text"] * 3000)], names=["id", "part", "text"])
    out = [r for b in run(iter([batch])) for r in b.to_pylist()]
    assert max(Counter(r["key"] for r in out).values()) < 20 and sum(r["digest"] is not None for r in out) == 1


def test_nothing(spark, tmp_path):
    docs = written(spark, tmp_path / "docs", [], 1)
    assert collected(audit_filters(docs, label_table(spark, []))) == []


def test_long_texts(spark, tmp_path):
    long = prose(2, 400_000)
    rows = [(2, long, "en"), (1, long, "en"), (3, "A" * 5_000_000, "en")]
    assert collected(audit_filters(written(spark, tmp_path / "docs", rows, 2), label_table(spark, LABELS))) == expected(rows, LABELS)


@pytest.mark.parametrize("text", ["", "a", "A" * 3 + "b" * 97, "A" * 3 + "b" * 98, "A" + "é" * 33, "a b c d\x1ce\x85f", "x " * 199, "x y " * 100,
                                  " ".join(str(i) for i in range(200)) + " 0" * 201, "|"])
def test_masks(text):
    assert judge_document(text.encode()) == mask_of(text)
