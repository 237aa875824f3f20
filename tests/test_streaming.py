import datetime as dt
import json

import pytest

from prefrank.streaming import feeds

BEGIN = dt.datetime(2024, 1, 1)


def write(spark, rows, schema, path, mode="append"):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode(mode).parquet(path)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "k string, ts timestamp"
    write(spark, [("a", BEGIN), ("a", BEGIN + dt.timedelta(hours=5))], schema, source)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    stream = feeds.tumbling_counts(feeds.read_table(spark, source, schema), "ts", "k")
    feeds.start(stream, out, state).awaitTermination()
    write(spark, [("a", BEGIN + dt.timedelta(minutes=1)), ("a", BEGIN + dt.timedelta(hours=9))], schema, source)
    query = feeds.start(stream, out, state)
    query.awaitTermination()
    assert feeds.rows_dropped_late(query) == 1
    got = {r.window_start: r.n for r in spark.read.parquet(out).collect()}
    assert got == {BEGIN: 1, BEGIN + dt.timedelta(hours=5): 1}


def test_restart_continues_from_the_checkpoint(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "k string, ts timestamp"
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for day in range(2):
        write(spark, [("a", BEGIN + dt.timedelta(days=day)), ("b", BEGIN)], schema, source)
        stream = feeds.tumbling_counts(feeds.read_table(spark, source, schema), "ts", "k", lateness="9 days")
        feeds.start_replacing(stream, out, state).awaitTermination()
    got = {(r.window_start, r.k): r.n for r in feeds.latest_batch(spark, out).collect()}
    assert got == {(BEGIN, "a"): 1, (BEGIN, "b"): 2, (BEGIN + dt.timedelta(days=1), "a"): 1}


def test_feedback_ingest(spark, tmp_path):
    good = {"conversation_id": "c1", "actual_winner": "A", "satisfaction_score": 5, "channel": "api",
            "timestamp": "2024-01-01T10:00:00+00:00"}
    events = [good, {**good, "actual_winner": "model_a"}, {**good, "channel": None, "satisfaction_score": None}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "e.json").write_text("\n".join(map(json.dumps, events)) + "\nnot json\n")
    raw = feeds.read_json_lines(spark, str(tmp_path / "in"))
    feeds.ingest_feedback(raw, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    stored = feeds.read_feedback(spark, str(tmp_path / "out"))
    accepted = stored.where("accepted").collect()
    assert len(accepted) == 2 and {r.channel for r in accepted} == {"api"}
    assert accepted[0].timestamp == dt.datetime(2024, 1, 1, 10)
    assert stored.where("not accepted").count() == 2


def test_repeats_within_time_to_live(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "key string, ts timestamp"
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    # The key again after 10 minutes (dropped) and, once other traffic has moved the
    # watermark past its expiry, after three hours (a new request).
    for key, minutes in (("k", 0), ("k", 10), ("other", 150), ("k", 180), ("k", 200)):
        write(spark, [(key, BEGIN + dt.timedelta(minutes=minutes))], schema, source)
        stream = feeds.suppress_repeats(feeds.read_table(spark, source, schema), "key", "ts")
        feeds.start(stream, out, state).awaitTermination()
    assert sorted(r.ts for r in spark.read.parquet(out).where("key = 'k'").collect()) == [BEGIN, BEGIN + dt.timedelta(minutes=180)]


@pytest.mark.parametrize("files", [1, 5, 40])
def test_repeats_do_not_depend_on_micro_batches(spark, tmp_path, files):
    rows = [(f"u{i * 7 % 5}", BEGIN + dt.timedelta(minutes=(i * 11) // 3)) for i in range(400)]
    want, last = [], {}
    for key, ts in rows:
        if key not in last or ts >= last[key] + dt.timedelta(hours=1):
            want.append((key, ts))
            last[key] = ts
    schema, source, out = "key string, ts timestamp", str(tmp_path / "in"), str(tmp_path / "out")
    size = len(rows) // files
    for i in range(files):
        write(spark, rows[i * size:(i + 1) * size], schema, f"{source}/{i:03d}")
    stream = feeds.suppress_repeats(feeds.read_table(spark, f"{source}/*", schema, max_files=10), "key", "ts")
    feeds.start(stream, out, str(tmp_path / "state")).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == sorted(want)


def test_streams_equal_batch(spark, tmp_path):
    rows = [(f"u{i % 7}", BEGIN + dt.timedelta(minutes=13 * i), float(i % 50)) for i in range(200)]
    schema, source = "k string, ts timestamp, v double", str(tmp_path / "in")
    write(spark, rows, schema, source)
    batch = spark.createDataFrame(rows, schema)
    forms = {
        "count": lambda d: feeds.tumbling_counts(d, "ts", "k"),
        "latency": lambda d: feeds.sliding_latency(d, "ts", "v"),
        "bins": lambda d: feeds.binned_counts(d, "ts", "v", [10, 20, 30]),
    }
    for name, form in forms.items():
        out = str(tmp_path / name)
        stream = form(feeds.read_table(spark, source, schema))
        feeds.start_replacing(stream, out, str(tmp_path / f"{name}-state")).awaitTermination()
        got = sorted(map(tuple, feeds.latest_batch(spark, out).collect()))
        assert got == sorted(map(tuple, form(batch).collect())), name


def test_feedback_join_is_time_bounded(spark, tmp_path):
    made = [("c1", BEGIN), ("c2", BEGIN), ("c3", BEGIN)]
    given = [("c1", BEGIN + dt.timedelta(hours=1)), ("c2", BEGIN + dt.timedelta(hours=30)),
             ("c3", BEGIN - dt.timedelta(minutes=1))]
    write(spark, made, "c string, made_at timestamp", str(tmp_path / "p"))
    write(spark, given, "c string, given_at timestamp", str(tmp_path / "f"))
    p = feeds.read_table(spark, str(tmp_path / "p"), "c string, made_at timestamp")
    f = feeds.read_table(spark, str(tmp_path / "f"), "c string, given_at timestamp")
    out = str(tmp_path / "out")
    feeds.start(feeds.match_feedback(p, f, "c", "made_at", "given_at"), out, str(tmp_path / "s")).awaitTermination()
    assert [r.c for r in spark.read.parquet(out).collect()] == ["c1"]


def test_redaction_before_storage(spark, tmp_path):
    write(spark, [("a@b.co 11987654321",), ("nada",)], "t string", str(tmp_path / "in"))
    stream = feeds.redact_messages(feeds.read_table(spark, str(tmp_path / "in"), "t string"), "t")
    feeds.start(stream, str(tmp_path / "out"), str(tmp_path / "s")).awaitTermination()
    rows = {r.t: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows["[EMAIL_REDACTED] [CPF_REDACTED]"].pii_types == ["cpf", "email"]
    assert not any(r.leak for r in rows.values())


def test_windowed_stability(spark):
    rows = [(BEGIN, b, 100) for b in range(4)] + [(BEGIN + dt.timedelta(days=1), 3, 400)]
    counts = spark.createDataFrame(rows, "window_start timestamp, bin int, n long")
    got = {r.window_start: r for r in feeds.windowed_stability(counts, [0.25] * 4).collect()}
    assert abs(got[BEGIN].psi) < 1e-12 and not got[BEGIN].drifted
    assert got[BEGIN + dt.timedelta(days=1)].drifted


def test_sessions(spark):
    minutes = [0, 10, 39, 80, 85]
    df = spark.createDataFrame([("c", BEGIN + dt.timedelta(minutes=m)) for m in minutes], "c string, ts timestamp")
    got = sorted((r.session_start, r.turns) for r in feeds.sessions(df, "c", "ts").collect())
    assert got == [(BEGIN, 3), (BEGIN + dt.timedelta(minutes=80), 2)]
