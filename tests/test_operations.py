import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from prefrank import fixed_values as fixed
from prefrank.operators import cache, feedback, monitoring, routing, runs
from prefrank.sources.reports import rule_table

MESSAGES = {
    "Minha taxa está muito alta": "reclamacao_taxa",
    "O MDR que aparece no extrato é diferente": "duvida_taxa_mdr",
    "Como funciona o parcelamento?": "duvida_parcelamento",
    "A maquininha está com problema": "problema_terminal",
    "Quero cancelar o contrato": "cancelamento",
    "MUITO CARO": "reclamacao_taxa",
    "Quero cancelar, a taxa subiu": "reclamacao_taxa",
    "Não sei o que aconteceu": "outros",
    "": "outros",
}


def test_intents(spark, column):
    assert column(routing.detect_intent("t"), list(MESSAGES)) == list(MESSAGES.values())
    df = spark.createDataFrame([(m,) for m in MESSAGES], "message string")
    shuffled = rule_table(spark, fixed.INTENT_RULES).orderBy(F.desc("ord"))
    got = {r.message: r.intent for r in routing.match_rule_table(df, shuffled).collect()}
    assert got == MESSAGES


def test_rule_tables_of_any_size(spark):
    rules = spark.range(20_000).selectExpr("cast(id as int) ord", "concat('k', id, '.') keyword", "concat('i', id) intent")
    short = spark.createDataFrame([(50_000, "ü", "one"), (60_000, "ab", "two"), (70_000, None, "none")], "ord int, keyword string, intent string")
    df = spark.createDataFrame([("x K19999. k7. y",), ("nothing",), (None,), ("Über",), ("ab",), ("ab",)], "message string")
    got = sorted((r.message or "", r.intent) for r in routing.match_rule_table(df, rules.union(short)).collect())
    assert got == sorted([("x K19999. k7. y", "i7"), ("nothing", "outros"), ("", "outros"), ("Über", "one"), ("ab", "two"), ("ab", "two")])


@pytest.mark.parametrize("shard", [routing.SHARD_CHARS, 40_000])
def test_rules_that_share_their_first_letters(spark, monkeypatch, shard):
    monkeypatch.setattr(routing, "SHARD_CHARS", shard)
    rng = random.Random(8)
    keywords = ["abc" + "".join(rng.choices("abcé日", k=rng.randrange(3, 7))) for _ in range(20_000)]
    order = list(range(20_000))
    rng.shuffle(order)
    rules = [(None if i == 7 else o, k, f"i{i % 50}") for i, (o, k) in enumerate(zip(order, keywords))]
    rules += [(o, k, "same keyword") for o, k, _ in rules[:100]] + [(5, None, "none")]
    texts = [" ".join(rng.choices([*keywords, "x", "Z"], k=rng.randrange(0, 4))) for _ in range(60)] + ["", None, "ABCÉ", "abc" * 40, "xabcx"]
    first = {}
    for o, k, intent in sorted([r for r in rules if r[1]], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        first.setdefault(k, (len(first), intent))
    want = []
    for text in texts:
        hits = [first[k] for k in first if text is not None and k in text.lower()]
        want.append((text or "", min(hits)[1] if hits else "outros"))
    df = spark.createDataFrame([(t,) for t in texts + texts[:5]], "message string")
    table = spark.createDataFrame(rules, "ord int, keyword string, intent string")
    got = [(r.message or "", r.intent) for r in routing.match_rule_table(df, table).collect()]
    assert sorted(got) == sorted(want + want[:5]) and len({i for _, i in got}) > 5
    always = routing.match_rule_table(df, table.union(spark.createDataFrame([(-1, "", "always")], table.schema)))
    assert {r.intent for r in always.where("message is not null").collect()} <= {"always", "i7"}
    assert {r.intent for r in routing.match_rule_table(df, table.limit(0)).collect()} == {"outros"}


def test_routing_and_prompt(spark):
    df = spark.createDataFrame([("cancelamento", "MEI", "oi"), ("desconhecido", "XX", "tchau")],
                               "intent string, segment string, message string")
    rows = {r.intent: r for r in routing.route(df).collect()}
    assert (rows["cancelamento"].action, rows["cancelamento"].priority) == ("retencao_avancada", 0)
    assert (rows["desconhecido"].action, rows["desconhecido"].priority) == ("atendimento_geral", 3)
    prompts = {r.intent: r.p for r in df.select("intent", routing.reasoning_prompt(
        "message", "segment", "intent", "Loja").alias("p")).collect()}
    assert prompts["cancelamento"] == (
        "<|system|>\nVocê é o assistente de suporte da Loja. Responda em português, com tom simples, direto e "
        "acolhedor. Segmento do lojista: MEI.\n<|user|>\noi\n<|assistant|>\n<think>\n"
        "Vou analisar a mensagem do lojista passo a passo:\n1. Intent detectado: cancelamento\n"
        "2. Segmento: MEI — tom adequado: simples, direto e acolhedor\n"
        "3. Ação recomendada pelo roteador: ative o script de retenção, destaque benefícios exclusivos\n"
        "4. Devo ser empático, resolver o problema e ative o script de retenção, destaque benefícios exclusivos.\n"
        "</think>\n")
    assert "com tom profissional" in prompts["desconhecido"] and "responda com empatia" in prompts["desconhecido"]


def test_confidence_gate(spark):
    rows = [("MEI", 0.7), ("MEI", 0.69), ("CORPORATE", 0.99), ("XX", 0.99)]
    got = routing.confidence_gate(spark.createDataFrame(rows, "segment string, confidence double")).collect()
    assert [r.needs_review for r in got] == [False, True, True, True]
    assert {r.segment for r in routing.segment_policy(spark).collect()} == set(fixed.SEGMENTS)


def test_histogram_and_percentiles(spark):
    values = [0.05, 0.06, 0.3, 0.31, 9.0, None]
    df = spark.createDataFrame([("e", v) for v in values], "endpoint string, s double")
    rows = {r.le: r for r in monitoring.latency_histogram(df, "s", by=["endpoint"]).collect()}
    assert [rows[k].bucket_count for k in ("0.05", "0.1", "0.2", "0.3", "0.5", "1.0", "2.0", "+Inf")] == [
        1, 2, 2, 3, 4, 4, 4, 5]
    assert rows["+Inf"].latency_count == 5 and rows["+Inf"].latency_sum == pytest.approx(9.72)
    ms = spark.range(1, 401).selectExpr("cast(id as double) ms")
    exact = {r.share: r for r in monitoring.latency_percentiles(ms, "ms").collect()}
    assert exact[0.5].latency_ms == 200.5 and exact[0.5].breached
    assert exact[0.99].latency_ms == pytest.approx(396.01) and exact[0.99].target_ms == 300.0
    sketch = {r.share: r.latency_ms for r in monitoring.latency_percentiles(ms, "ms", exact=False).collect()}
    assert sketch[0.95] == pytest.approx(380, abs=1)
    breaches = monitoring.limit_breaches(ms, "ms").first()
    assert (breaches.requests, breaches.breaches) == (400, 100)


def test_pii_counter_counts_messages(spark):
    df = spark.createDataFrame([("a@b.co c@d.co",), ("11987654321 e a@b.co",), ("nada",)], "t string")
    assert {r.pii_type: r.n for r in monitoring.pii_event_counts(df, "t").collect()} == {"email": 2, "cpf": 1}
    leaks = monitoring.pii_leaks(df, "t").first()
    assert (leaks.outputs, leaks.leaks) == (3, 2)


def test_drift(spark):
    base = spark.range(1000).selectExpr("cast(id as double) v")
    same = monitoring.population_stability(base, base, "v").first()
    assert same.psi == pytest.approx(0.0, abs=1e-12) and not same.drifted
    moved = monitoring.population_stability(base, base.selectExpr("v + 2000 AS v"), "v").first()
    p = [100.0] * 10
    q = [0.0] * 9 + [1000.0]
    import math
    want = sum((max(b / 1000, 1e-6) - max(a / 1000, 1e-6)) * math.log(max(b / 1000, 1e-6) / max(a / 1000, 1e-6))
               for a, b in zip(p, q))
    assert moved.psi == pytest.approx(want, rel=0.01) and moved.drifted


def test_alerts_and_filters(spark):
    metrics = spark.createDataFrame([("psi", 0.21), ("latency_p99_ms", 300.0), ("pii_scrubbed_cpf", 1.0)],
                                    "metric string, value double")
    assert {r.alert for r in monitoring.alerts(metrics).collect()} == {"psi_drift", "pii_leak"}
    now = dt.datetime(2024, 6, 1)
    events = spark.createDataFrame([("u1", now - dt.timedelta(days=90)), ("u2", now - dt.timedelta(days=91))],
                                   "u string, ts timestamp")
    kept = monitoring.within_retention(events, "ts", F.to_timestamp(F.lit("2024-06-01 00:00:00")))
    assert [r.u for r in kept.collect()] == ["u1"]
    consent = spark.createDataFrame([("u2",), ("u2",)], "u string")
    assert [r.u for r in monitoring.with_consent(events, consent, "u").collect()] == ["u2"]
    assert [r.u for r in monitoring.without_consent(events, consent, "u").collect()] == ["u1"]
    flags = spark.createDataFrame([(True,), (False,), (False,)], "from_cache boolean")
    assert tuple(monitoring.cache_stats(flags).first()) == (1, 2)


def test_traffic_split(spark):
    arms = spark.range(20000).select(monitoring.traffic_split(F.col("id") % 5000, 0.3).alias("a"), (F.col("id") % 5000).alias("k"))
    assert arms.groupBy("k").agg(F.countDistinct("a").alias("n")).where("n > 1").count() == 0
    share = arms.where("a = 'challenger'").count() / 20000
    assert share == pytest.approx(0.3, abs=0.03)
    assert spark.range(50).where(monitoring.traffic_split("id", 0.0) != "champion").count() == 0
    with pytest.raises(ValueError):
        monitoring.traffic_split("id", 0.6)


def loop(aucs, patience):
    """The stopping rule as a plain loop."""
    best, streak, best_epoch = 0.0, 0, None
    for epoch, auc in enumerate(aucs):
        if auc > best:
            best, streak, best_epoch = auc, 0, epoch
        else:
            streak += 1
            if streak >= patience:
                return epoch, best_epoch, epoch + 1
    return None, best_epoch, len(aucs)


@pytest.mark.parametrize("patience", [1, 2, 3])
def test_early_stopping_equals_loop(spark, patience):
    rng = random.Random(patience)
    histories = {f"r{i}": [round(rng.random(), 1) for _ in range(rng.randint(1, 9))] for i in range(30)}
    histories["zero"] = [0.0] * 5
    rows = [(r, e, a) for r, aucs in histories.items() for e, a in enumerate(aucs)]
    df = spark.createDataFrame(rows, "run_id string, epoch int, val_auc double")
    got = {}
    for r in runs.early_stopping(df, patience).collect():
        got.setdefault(r.run_id, []).append(r)
    for run, aucs in histories.items():
        stop, best, ran = loop(aucs, patience)
        assert (got[run][0].stop_epoch, got[run][0].best_epoch, len(got[run])) == (stop, best, ran), run
    top = runs.top_checkpoints(df).where("run_id = 'zero'").orderBy("place").collect()
    assert [r.epoch for r in top] == [0, 1]


def test_run_without_validation_never_stops(spark):
    df = spark.createDataFrame([("r", e, None) for e in range(5)], "run_id string, epoch int, val_auc double")
    assert runs.early_stopping(df, 1).count() == 5


def test_cache(spark):
    now = F.to_timestamp(F.lit("2024-01-01 12:00:00"))
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    good = '{"prob_a_wins":0.6,"prob_b_wins":0.3,"prob_tie":0.1,"winner":"A","latency_ms":7.0}'
    newer = good.replace("7.0", "9.0")
    rows = [("k1", good, at(11, 30)), ("k1", newer, at(11, 40)), ("k2", good, at(11, 0)), ("k3", "{broken", at(11, 59)),
            ("k4", good, at(12, 30))]
    table = spark.createDataFrame(rows, "key string, value string, written_at timestamp")
    requests = spark.createDataFrame([("k1",), ("k1",), ("k2",), ("k3",), ("k4",), (None,)], "key string")
    found = cache.with_cached(requests, table, now).collect()
    assert sorted((r.key or "", r.from_cache) for r in found) == [
        ("", False), ("k1", True), ("k1", True), ("k2", False), ("k3", False), ("k4", False)]
    assert {r.cached.latency_ms for r in found if r.from_cache} == {9.0}
    assert cache.misses(requests, table, now).count() == 4


@pytest.mark.parametrize("partitions", [1, 3, 40])
@pytest.mark.parametrize("span", [400, 3])
def test_latest_before_equals_scan(spark, partitions, span):
    rng = random.Random(partitions + span)
    begin = dt.datetime(2024, 1, 1)
    # User 0 holds most rows; times collide on purpose, at the smaller span almost always.
    key = lambda: rng.choice([0, 0, 0, rng.randint(1, 5), None])
    time = lambda: rng.choice([None] + [begin + dt.timedelta(seconds=rng.randint(0, span))] * 20)
    made = [(key(), time(), i // 2, rng.choice([f"p{i}", None])) for i in range(120)]
    given = [(key(), time(), i, "old") for i in range(250)]
    p = spark.createDataFrame(made, "k int, ts timestamp, pid int, predicted string")
    f = spark.createDataFrame(given, "k int, ts timestamp, fid int, predicted string")
    matched = feedback.latest_before(p, f, "k", "ts", "predicted", "pid", partitions)
    assert matched.columns == ["k", "ts", "fid", "predicted", "predicted_at"]
    got = {r.fid: (r.predicted, r.predicted_at, r.k, r.ts) for r in matched.collect()}
    assert len(got) == 250
    for k, ts, fid, _ in given:
        before = [m for m in made if None not in (k, ts, m[1]) and m[0] == k and m[1] <= ts]
        want = max(before, key=lambda m: (m[1], m[2], m[3] is not None, m[3] or "")) if before else None
        assert got[fid] == ((want[3], want[1]) if want else (None, None)) + (k, ts)


def test_latest_before_with_text_keys_and_nothing(spark):
    p = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), 1, 0.5)], "k string, ts timestamp, pid int, score double")
    f = spark.createDataFrame([("a", dt.datetime(2024, 1, 2)), ("b", dt.datetime(2024, 1, 2))], "k string, ts timestamp")
    got = {r.k: r.score for r in feedback.latest_before(p, f, "k", "ts", "score", "pid").collect()}
    assert got == {"a": 0.5, "b": None}
    assert feedback.latest_before(p, f.limit(0), "k", "ts", "score", "pid").count() == 0
    assert [r.score for r in feedback.latest_before(p.limit(0), f, "k", "ts", "score", "pid").collect()] == [None, None]


def test_realised_accuracy(spark):
    df = spark.createDataFrame([("A", "A"), ("B", "A"), (None, "A")], "predicted string, actual string")
    row = feedback.realised_accuracy(df, "predicted", "actual").first()
    assert (row.feedback, row.matched, row.accuracy) == (3, 2, 0.5)
