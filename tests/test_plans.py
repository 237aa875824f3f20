import csv
import glob
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefrank.catalog.views import example_head
from prefrank.functions import scoring
from prefrank.operators import audit
from prefrank.plans import auditing, evaluation, interactions, training
from prefrank.plans import scoring as plan
from prefrank.sources import reports, tables

REQUESTS = ("conversation_id string, prompt string, response_a string, response_b string, merchant_segment string")


def softmax(x):
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def test_scoring_functions(column):
    logits = [[1.0, 2.0, 3.0], [1000.0, 0.0, -1000.0], [0.0, 0.0, 0.0]]
    got = column(scoring.softmax("t"), logits, "array<double>")
    assert np.allclose(got, softmax(np.array(logits)))
    assert column(scoring.argmax("t"), [[.4, .4, .2], [.1, .2, .7], [.2, .4, .4]], "array<double>") == [0, 2, 1]
    assert column(scoring.winner("t"), [[.4, .4, .2], [.1, .2, .7], [.2, .4, .4]], "array<double>") == ["A", "tie", "B"]


@pytest.mark.parametrize("dim", [0, 5])
def test_fusion_head(spark, dim):
    rng = np.random.default_rng(dim)
    w1, b1, w2, b2 = rng.normal(size=(12, 12)), rng.normal(size=12), rng.normal(size=(3, dim + 12)), rng.normal(size=3)
    head = scoring.FusionHead(w1.tolist(), b1.tolist(), w2.tolist(), b2.tolist())
    e, x = rng.normal(size=(20, dim)), rng.normal(size=(20, 12))
    df = spark.createDataFrame([(i, e[i].tolist(), x[i].tolist()) for i in range(20)],
                               "i int, e array<double>, x array<double>")
    got = df.select("i", scoring.fusion_logits(head, "e", "x").alias("l"),
                    scoring.fusion_logits(head, "e", None).alias("z")).orderBy("i").collect()
    hidden = np.maximum(x @ w1.T + b1, 0)
    assert np.allclose([r.l for r in got], np.hstack([e, hidden]) @ w2.T + b2)
    assert np.allclose([r.z for r in got], e @ w2[:, :dim].T + b2)


@pytest.fixture(scope="module")
def requests(spark):
    rows = [("r0", "quanto custa?", "caro demais.", "barato.", "mei"),
            ("r1", "meu cpf 123.456.789-09", "ok a@b.co", "não", "CORPORATE"),
            ("r2", "   ", "a", "b", None),
            ("r3", "p", "a", "b", "outro"),
            ("r4", "p", None, "b", "MEI"),
            ("r5", "x", "y z.", "w", None)]
    return spark.createDataFrame(rows, REQUESTS)


def test_request_scoring(spark, requests):
    now = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    def scorer(texts, aux):
        assert all("123.456" not in t and "@" not in t for t in texts)
        assert aux.shape == (len(texts), 12)
        return np.tile([0.6, 0.3, 0.1], (len(texts), 1))

    outcome = plan.score_requests(requests, plan.batch_scorer(scorer, batch_rows=1), now).collect()
    by_id = {r.conversation_id: r for r in outcome}
    assert len(outcome) == 6
    assert {k: r.reason for k, r in by_id.items() if r.reason} == {
        "r2": "empty input after redaction", "r3": "unknown segment", "r4": "missing text"}
    assert by_id["r0"].winner == "A" and by_id["r0"].segment == "MEI" and not by_id["r0"].from_cache
    assert by_id["r5"].segment == "VAREJO" and by_id["r3"].winner is None


def test_cache_round_trip(spark, requests, tmp_path):
    path = str(tmp_path / "cache")
    scorer = plan.fusion_scorer(example_head())
    now = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    first = plan.score_requests(requests, scorer, now)
    tables.append_cache(plan.new_entries(first, now), path)
    fresh = {r.conversation_id: r for r in plan.results(first).collect()}
    soon = F.to_timestamp(F.lit("2024-01-01 00:59:59"))
    late = F.to_timestamp(F.lit("2024-01-01 01:00:00"))
    cached = {r.conversation_id: r for r in plan.results(
        plan.score_requests(requests, scorer, soon, tables.read_cache(spark, path))).collect()}
    assert set(cached) == set(fresh) == {"r0", "r1", "r5"}
    assert all(r.from_cache for r in cached.values())
    assert all(cached[k].prob_a_wins == fresh[k].prob_a_wins for k in fresh)
    again = plan.score_requests(requests, scorer, late, tables.read_cache(spark, path))
    assert not any(r.from_cache for r in plan.results(again).collect())
    assert plan.refused(again).count() == 3


def test_equal_requests_are_scored_once(spark, requests, tmp_path):
    log = str(tmp_path / "calls")

    def scorer(texts, aux):
        with open(log, "a") as f:
            f.writelines("x" for _ in texts)
        return np.tile([0.2, 0.7, 0.1], (len(texts), 1))

    many = requests.where("conversation_id = 'r0'").crossJoin(spark.range(40)).drop("id")
    table = many.unionByName(requests)
    where = [str(tmp_path / n) for n in ("out", "cache")]
    stored = plan.score_and_store(table, plan.batch_scorer(scorer), F.current_timestamp(), *where)
    assert stored.count() == 46 and plan.results(stored).count() == 43
    assert len(open(log).read()) == 3
    assert tables.read_cache(spark, where[1]).count() == 3
    assert plan.refused(stored).count() == 3


def test_score_and_store(spark, requests, tmp_path):
    scorer, where = plan.fusion_scorer(example_head()), [str(tmp_path / n) for n in ("out", "cache")]
    now = F.to_timestamp(F.lit("2024-01-01 23:59:00"))
    first = plan.score_and_store(requests, scorer, now, *where)
    assert plan.results(first).where("from_cache").count() == 0
    # A new day: the entries live in yesterday's partition.
    later = F.to_timestamp(F.lit("2024-01-02 00:10:00"))
    second = plan.score_and_store(requests, scorer, later, *where)
    assert plan.results(second).where("from_cache").count() == 3
    cache = tables.read_cache(spark, where[1])
    assert cache.count() == 3
    scan = plan.cache_ops.live_entries(cache, later)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in scan


def test_invalid_scores_are_refused(requests):
    now = F.current_timestamp()
    outcome = plan.score_requests(requests, plan.batch_scorer(lambda t, a: np.tile([.6, .5, .4], (len(t), 1))), now)
    assert plan.results(outcome).count() == 0
    with pytest.raises(Exception, match="shape"):
        plan.score_requests(requests, plan.batch_scorer(lambda t, a: np.ones((1, 2))), now).collect()


def test_batches_equal_single_scores(spark, requests):
    good = requests.where("conversation_id in ('r0', 'r1', 'r5')")
    good = good.withColumn("merchant_segment", F.upper("merchant_segment"))
    now = F.current_timestamp()
    single = {r.conversation_id: r for r in plan.results(
        plan.score_requests(good, plan.fusion_scorer(example_head()), now)).collect()}
    items = F.array_sort(F.collect_list(F.struct("conversation_id", "prompt", "response_a", "response_b",
                                                 "merchant_segment", F.lit(1.5).alias("latency_ms"))))
    batch = good.agg(F.lit("b").alias("batch_id"), items.alias("items"))
    scored = plan.score_batches(batch, example_head())
    assert "Exchange" not in scored.select("results")._jdf.queryExecution().optimizedPlan().toString()
    row = scored.first()
    assert [r.conversation_id for r in row.results] == ["r0", "r1", "r5"]
    assert row.total_latency_ms == 4.5
    for r in row.results:
        assert r.prob_a_wins == pytest.approx(single[r.conversation_id].prob_a_wins)
        assert r.winner == single[r.conversation_id].winner


def clean_rows(spark, n=60):
    rows = [(str(i), "p", "palavra " * (1 + 5 * (i % 3 == 0)), "palavra " * (1 + 5 * (i % 3 == 1)), "MEI", i % 3)
            for i in range(n)]
    return spark.createDataFrame(rows, "conversation_id string, prompt string, response_a string, "
                                       "response_b string, segment string, label int")


def test_training_learns_and_persists(spark, tmp_path):
    triples = clean_rows(spark)
    model = training.fit(triples, max_iter=20, reg_param=0.001)
    result = evaluation.metrics.evaluation_metrics(training.predict(model, triples)).first()
    assert result.accuracy == 1.0 and result.auc == 1.0
    history = [r.loss for r in training.loss_history(model, "r").orderBy("epoch").collect()]
    assert history[-1] < history[0]
    path = str(tmp_path / "model")
    model.write().overwrite().save(path)
    from pyspark.ml import PipelineModel
    again = training.predict(PipelineModel.load(path), triples)
    assert evaluation.metrics.evaluation_metrics(again).first().accuracy == 1.0
    weights = [r.weight for r in training.smoothed_rows(triples.limit(1)).collect()]
    assert sum(weights) == pytest.approx(1.0) and max(weights) == pytest.approx(0.9 + 0.1 / 3)


def test_evaluation_and_gate(spark, tmp_path):
    triples = clean_rows(spark, 30).unionByName(clean_rows(spark, 3).withColumn("label", F.lit(None).cast("int")))
    perfect = plan.batch_scorer(lambda t, a: np.eye(3)[np.where(a[:, 0] > a[:, 3], 0, np.where(a[:, 3] > a[:, 0], 1, 2))])
    result = evaluation.evaluate(triples, perfect, materialize=True)
    row = result.first()
    assert (row.n, row.accuracy, row.auc, row.ece) == (30, 1.0, 1.0, 0.0)
    path = str(tmp_path / "report")
    assert {r.status for r in evaluation.gate_and_report(result, path).collect()} == {"ok"}
    assert json.loads(open(glob.glob(f"{path}/*.json")[0]).read())["accuracy"] == 1.0
    flat = evaluation.evaluate(triples, plan.batch_scorer(lambda t, a: np.full((len(t), 3), 1 / 3)))
    with pytest.raises(evaluation.GateFailed):
        evaluation.gate_and_report(flat, str(tmp_path / "none"))
    assert not glob.glob(str(tmp_path / "none*"))


def test_audit_of_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.log").write_bytes(b"ok\nmail a@b.co  \r\nfine\rcpf 123.456.789-09")
    (tmp_path / "sub" / "b.txt").write_bytes(b"\xff broken bytes\n\n11222333000144\n")
    (tmp_path / "c.md").write_text("a@b.co")
    (tmp_path / ".log").write_text("a@b.co")
    (tmp_path / "empty.csv").write_text("")
    with pytest.warns(UserWarning, match="does not exist"):
        result = auditing.audit_files(spark, [str(tmp_path), str(tmp_path / "sub"), str(tmp_path / "missing")])
    found = {(r.path.rsplit("/", 1)[1], r.line): r.content for r in result.violations.collect()}
    assert found == {("a.log", 2): "mail a@b.co", ("a.log", 4): "cpf 123.456.789-09", ("b.txt", 3): "11222333000144"}
    summary = result.summary.first()
    assert (summary.files_scanned, summary.total_violations, summary.status) == (3, 3, "FAIL")
    assert not result.passed and result.per_file.count() == 2
    result.write_report(str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "violations")).count() == 2
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "a+b c%.log").write_text("x@y.co")
    odd = auditing.audit_files(spark, [str(tmp_path / "odd")])
    assert [r.path.rsplit("/", 1)[1] for r in odd.violations.collect()] == ["a+b c%.log"]
    clean = auditing.audit_files(spark, [str(tmp_path / "sub")], (".csv",))
    assert clean.passed and clean.summary.first().status == "PASS"


def test_audit_reads_hidden_names_and_says_what_it_could_not_read(spark, tmp_path, monkeypatch):
    for name in (".secret.log", "_part.txt", ".git/x.csv", "a/_b/.c/deep.json", "plain.log", "gone.log"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("one\nmail a@b.co\n")
    (tmp_path / "link").symlink_to(tmp_path / "a")
    (tmp_path / "dangling.log").symlink_to(tmp_path / "nowhere")
    list_files = auditing.file_tree.list_files

    def and_lose_one(*args):
        files = list_files(*args)
        assert files.count() == 6
        (tmp_path / "gone.log").unlink()
        return files

    monkeypatch.setattr(auditing.file_tree, "list_files", and_lose_one)
    result = auditing.audit_files(spark, [str(tmp_path), f"file:{tmp_path}/a", str(tmp_path / "plain.log")])
    found = sorted((r.path[len(str(tmp_path)) + 1:], r.line) for r in result.violations.collect())
    assert found == [(n, 2) for n in (".git/x.csv", ".secret.log", "_part.txt", "a/_b/.c/deep.json", "plain.log")]
    assert [(r.path, r.error.split(":")[0]) for r in result.unreadable.collect()] == [(f"{tmp_path}/gone.log", "FileNotFoundError")]
    summary = result.summary.first()
    assert (summary.files_scanned, summary.files_skipped, summary.total_violations, summary.status) == (6, 1, 5, "FAIL")
    result.write_report(str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "unreadable")).count() == 1
    monkeypatch.setattr(auditing.file_tree, "list_files", list_files)
    assert auditing.has_violation(spark, [str(tmp_path / ".git")])
    assert not auditing.has_violation(spark, [str(tmp_path / ".git")], (".log",))


def test_an_audit_that_could_not_read_a_file_is_incomplete(spark, tmp_path, monkeypatch):
    (tmp_path / "a.log").write_text("fine")
    (tmp_path / "b.log").write_text("fine")
    list_files = auditing.file_tree.list_files

    def and_lose_one(*args):
        files = list_files(*args)
        files.count()
        (tmp_path / "b.log").unlink()
        return files

    monkeypatch.setattr(auditing.file_tree, "list_files", and_lose_one)
    result = auditing.audit_files(spark, [str(tmp_path)])
    assert result.summary.first().status == "INCOMPLETE" and not result.passed


def test_wide_trees_are_dealt_out_again(spark, tmp_path, monkeypatch):
    for i in range(40):
        (tmp_path / f"d{i % 7}" / f"e{i}").mkdir(parents=True)
        (tmp_path / f"d{i % 7}" / f"e{i}" / "f.txt").write_text("x")
    monkeypatch.setattr(auditing.file_tree, "WALK", 3)
    files = auditing.file_tree.list_files(spark, [str(tmp_path)])
    assert files.count() == 40


@pytest.mark.parametrize("chunk, span", [(1, 3), (2, 5), (7, 4), (100, 10), (5, 1), (64, 1000)])
def test_lines_of_ranges(monkeypatch, chunk, span):
    import io
    import random
    from prefrank.sources import file_tree
    monkeypatch.setattr(file_tree, "CHUNK_BYTES", chunk)
    rng = random.Random(chunk * 1000 + span)
    for _ in range(300):
        data = "".join(rng.choice(["a", "bc", "\n", "\r", "\r\n", ""]) for _ in range(rng.randrange(20))).encode()
        got = [line for begin in range(0, max(len(data), 1), span)
               for line in file_tree.lines_between(io.BytesIO(data), begin, begin + span)]
        want = data.decode().replace("\r\n", "\n").replace("\r", "\n").split("\n")
        assert [x.decode() for x in got] == (want[:-1] if want[-1] == "" else want), data


def test_line_numbers_over_many_ranges(spark, tmp_path, monkeypatch):
    lines = [f"linha {i} " + ("a@b.co" if i % 997 == 0 else "x" * (i % 50)) for i in range(20000)]
    (tmp_path / "big.log").write_text("\n".join(lines))
    read = auditing.file_tree.read_lines
    monkeypatch.setattr(auditing.file_tree, "read_lines", lambda files: read(files, 65536))
    result = auditing.audit_files(spark, [str(tmp_path)])
    assert sorted(r.line for r in result.violations.collect()) == [i + 1 for i in range(0, 20000, 997)]


def test_spark_reads_what_tasks_cannot_open(spark, tmp_path, monkeypatch):
    lines = [f"linha {i} " + ("a@b.co" if i % 997 == 0 else "x" * (i % 50)) for i in range(20000)]
    (tmp_path / "big.log").write_text("\n".join(lines))
    (tmp_path / ".hidden.log").write_text("a@b.co")
    monkeypatch.setattr(auditing.file_tree, "readable_in_tasks", lambda target: False)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        result = auditing.audit_files(spark, [str(tmp_path)])
        assert sorted(r.line for r in result.violations.collect()) == [i + 1 for i in range(0, 20000, 997)]
        assert result.skipped == 1 and auditing.has_violation(spark, [str(tmp_path)])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_split_lines(spark):
    df = spark.createDataFrame([(1, "a\r\nb\rc\n"), (2, ""), (3, "x\n\ny")], "d int, t string")
    got = [(r.d, r.line, r.content) for r in audit.split_lines(df, "t", "d").orderBy("d", "line").collect()]
    assert got == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (3, 1, "x"), (3, 2, ""), (3, 3, "y")]


def test_report_rows_are_bounded(spark):
    df = spark.range(1, 251).selectExpr("'f' AS path", "cast(id as int) AS line", "'x' AS content")
    sizes = sorted(len(r.violations) for r in audit.report_rows(df, lines_per_row=100).collect())
    assert sizes == [50, 100, 100]


def test_interactions_and_submission(spark, tmp_path):
    rows = [("i1", "MEI", "minha taxa subiu, cpf 111.222.333-44", "reclamacao_taxa"),
            ("i2", "VAREJO", "quero cancelar por causa da taxa", "cancelamento")]
    df = spark.createDataFrame(rows, "id string, segment string, message string, expected_intent string")
    answered = interactions.answer_interactions(
        df, lambda prompts: [f"<think>pensa</think>{'CPF' in p} \"a, b\"\n" + "x" * 600 for p in prompts], "Loja")
    got = {r.id: r for r in answered.collect()}
    assert got["i1"].intent == got["i2"].intent == "reclamacao_taxa"
    assert "[CPF_REMOVIDO]" in got["i1"].prompt and got["i1"].thinking == "pensa"
    assert len(got["i1"].response_display) == 403 and not got["i1"].over_limit
    path = str(tmp_path / "out" / "submission")
    reports.write_submission(answered, path)
    lines = [r for f in glob.glob(f"{path}/*.csv") for r in csv.DictReader(open(f, newline=""))]
    assert sorted(r["id"] for r in lines) == ["i1", "i2"]
    assert all(len(r["prediction"]) == 500 and '"a, b"' in r["prediction"] for r in lines)
    with pytest.raises(TypeError):
        interactions.prepare_interactions(df.withColumn("message", F.lit(1)), "Loja")
    empty = str(tmp_path / "empty")
    reports.write_submission(answered.limit(0), empty)
    assert open(glob.glob(f"{empty}/*.csv")[0]).read().strip() == "id,prediction"


def test_rules_file(spark, tmp_path):
    (tmp_path / "r.yaml").write_text("rules:\n  - {intent: a, action: b}\n")
    (tmp_path / "r.json").write_text('{"rules": []}')
    assert reports.load_rules(spark, str(tmp_path / "r.yaml"))["rules"][0]["intent"] == "a"
    assert reports.load_rules(spark, str(tmp_path / "r.json")) == {"rules": []}


def test_history_table(spark, tmp_path):
    rows = spark.createDataFrame([("r", 0, 0.7, 0.6, 0.9)], tables.RUN_HISTORY)
    for _ in range(2):
        tables.append_history(rows, str(tmp_path / "h"))
    assert tables.read_history(spark, str(tmp_path / "h")).count() == 2
