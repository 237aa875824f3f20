import datetime as dt
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from prefrank.streaming import feeds, lateness, panes, repeats, versions

BEGIN = dt.datetime(2024, 1, 1)


def minutes(n):
    return BEGIN + dt.timedelta(minutes=n)


def write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


COUNTS = "window_start timestamp, k string, n bigint"


def test_changed_windows_only_and_falling_state(spark, tmp_path):
    source, out, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    rows, written, states = [], [], []
    for day in range(4):
        # Ten hours of traffic a day; the watermark then lets go of the windows of the day before.
        part = [(f"k{h % 2}", minutes(1440 * day + 60 * h)) for h in range(10)]
        rows += part
        write(spark, part, "k string, ts timestamp", source)
        stream = feeds.tumbling_counts(feeds.read_table(spark, source, "k string, ts timestamp"), "ts", "k")
        query = versions.start_updating(stream, out, state)
        query.awaitTermination()
        states.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        got = {(r.window_start, r.k): r.n for r in versions.latest_rows(spark, out, COUNTS, "window_start", "k").collect()}
        assert got == {(ts, k): 1 for k, ts in rows}
        written.append(spark.read.schema(COUNTS).parquet(out).count())
    assert written == [10, 20, 30, 40]  # nothing is written twice
    assert max(states) <= 12


def test_newest_version_wins_before_and_after_folds(spark, tmp_path):
    source, out, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    assert versions.latest_rows(spark, out, COUNTS, "window_start", "k").count() == 0
    assert versions.fold_versions(spark, out, COUNTS, "window_start", "k") == -1
    want = {}
    for turn in range(5):
        part = [("a", minutes(0)), ("b", minutes(60 * turn))]
        for k, ts in part:
            want[ts, k] = want.get((ts, k), 0) + 1
        write(spark, part, "k string, ts timestamp", source)
        table = feeds.read_table(spark, source, "k string, ts timestamp")
        versions.start_updating(feeds.tumbling_counts(table, "ts", "k", lateness="9 days"), out, state).awaitTermination()
        if turn in (1, 2, 3):
            folded = versions.fold_versions(spark, out, COUNTS, "window_start", "k")
            assert versions.fold_versions(spark, out, COUNTS, "window_start", "k") == folded
        got = {(r.window_start, r.k): r.n for r in versions.latest_rows(spark, out, COUNTS, "window_start", "k").collect()}
        assert got == want
    # What lies below the fold before the last is gone, so are all but two folds.
    left = [int(p.name[9:]) for p in (tmp_path / "out").iterdir()]
    folds = sorted(int(p.name[9:]) for p in (tmp_path / "out-folded").iterdir())
    assert len(folds) == 2 and folds[-1] == folded and min(left) > folds[0]


def exact(values, share):
    ordered = np.sort(values)
    return ordered[max(0, int(np.ceil(share * len(ordered))) - 1)]


def test_windows_merge_their_panes(spark, tmp_path):
    rng = np.random.default_rng(4)
    schema = "ts timestamp, v double"
    rows = [(BEGIN + dt.timedelta(seconds=float(s)), float(x)) for s, x in zip(rng.uniform(0, 4 * 3600, 30_000), rng.lognormal(4, 1, 30_000))]
    rows += [(BEGIN, None)]
    for k in range(3):
        write(spark, rows[k::3], schema, str(tmp_path / "in"))
    stream = panes.latency_panes(feeds.read_table(spark, str(tmp_path / "in"), schema, max_files=1), "ts", "v", lateness="1 day")
    versions.start_updating(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    stored = versions.latest_rows(spark, str(tmp_path / "out"), panes.PANE_SCHEMA, "pane_start")
    assert stored.count() == 16 and stored.agg(F.sum("n")).first()[0] == 30_000
    assert max(len(r.sketch) for r in stored.collect()) < 20_000
    got = panes.sliding_percentiles(stored).collect()
    assert len(got) == 19
    for r in got:
        inside = np.array([x for ts, x in rows if x is not None and r.window_start <= ts < r.window_start + dt.timedelta(hours=1)])
        assert r.n == len(inside)
        for share, value in ((0.5, r.p50_ms), (0.95, r.p95_ms), (0.99, r.p99_ms)):
            below, upto = (inside < value).mean(), (inside <= value).mean()
            assert below - 2 * panes.RANK_ERROR <= share <= upto + 2 * panes.RANK_ERROR
        assert r.over_limit == (r.p99_ms > 300)


def test_few_rows_are_exact(spark):
    rows = [(minutes(4 * i), float(i * 37 % 101)) for i in range(60)]
    batch = spark.createDataFrame(rows, "ts timestamp, v double")
    got = {r.window_start: r for r in panes.sliding_percentiles(panes.latency_panes(batch, "ts", "v")).collect()}
    plain = {r.window_start: r for r in feeds.sliding_latency(batch, "ts", "v").collect()}
    assert got.keys() == plain.keys()
    for start, r in got.items():
        inside = [x for ts, x in rows if start <= ts < start + dt.timedelta(hours=1)]
        assert (r.n, r.p50_ms, r.p95_ms) == (len(inside), exact(inside, 0.5), exact(inside, 0.95))
        assert (r.n, r.over_limit) == (plain[start].n, plain[start].over_limit)


def test_sliding_latency_is_exact_with_many_equal_values(spark, tmp_path):
    values = [(i, float(v), minutes(i % 15)) for i, v in enumerate(list(range(1, 100)) * 60)]
    write(spark, values, "event_id long, value double, ts timestamp", str(tmp_path / "events.parquet"))
    rows = queries()["stream_sliding_latency"](spark, str(tmp_path)).collect()
    assert len(rows) == 4 and {(r.n, r.p50_ms, r.p95_ms, r.p99_ms, r.over_limit) for r in rows} == {(5940, 50.0, 95.0, 99.0, False)}


def test_sketch_check_joins_stored_percentiles(spark, tmp_path):
    rows = [(i, float(i * 37 % 101), minutes(i)) for i in range(200)]
    write(spark, rows, "event_id long, value double, ts timestamp", str(tmp_path / "events.parquet"))
    found = queries()["stream_sliding_sketch"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    # Windows are joined by their stored size: the rows of the table are neither shuffled for it nor sorted.
    assert "kll_" not in plan and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert all(r.p50_near and r.p95_near and r.p99_near for r in found.collect())


@pytest.mark.parametrize("buckets", [None, 3])
def test_exact_percentiles_add_up_over_micro_batches(spark, tmp_path, buckets):
    rng, rows = random.Random(7), []
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(3):
        # Later parts reach back behind the watermark of a stateful stream; some rows have no value.
        new = [(minutes(rng.randrange(600)), None if rng.random() < 0.1 else round(rng.lognormvariate(4, 1), 1)) for _ in range(400)]
        new += [(minutes(-300), None)]
        rows += new
        write(spark, new, "ts timestamp, v double", source)
        panes.start_counting(feeds.read_table(spark, source, "ts timestamp, v double"), "ts", "v", out, str(tmp_path / "s")).awaitTermination()
    got = panes.exact_percentiles(panes.read_counts(spark, out), buckets=buckets).collect()
    assert {r.window_start for r in got} == {ts - dt.timedelta(minutes=ts.minute % 15 + 15 * i) for ts, _ in rows for i in range(4)}
    for r in got:
        all_ = [x for ts, x in rows if r.window_start <= ts < r.window_start + dt.timedelta(hours=1)]
        inside = [x for x in all_ if x is not None]
        want = [exact(inside, s) if inside else None for s in (0.5, 0.95, 0.99)]
        assert (r.n, [r.p50_ms, r.p95_ms, r.p99_ms]) == (len(all_), want)
        assert r.over_limit == (None if not inside else want[2] > 300)


@pytest.mark.parametrize("files", [1, 5])
def test_kept_and_late_rows_are_all_rows(spark, tmp_path, files):
    rng = random.Random(files)
    rows = [(i, minutes(10 * i - rng.choice([0, 0, 0, 40, 300])) if i % 17 else None, {"m": i}) for i in range(200)]
    schema = "id int, ts timestamp, extra map<string,int>"
    size = len(rows) // files
    for k in range(files):
        write(spark, rows[k * size:(k + 1) * size], schema, str(tmp_path / "in"))
    stream = feeds.read_table(spark, str(tmp_path / "in"), schema, max_files=1)
    lateness.start_split(stream, "ts", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r.id: r for r in lateness.read_split(spark, str(tmp_path / "out"), stream.schema).collect()}
    assert len(got) == len(rows)
    newest = None
    for k in range(files):
        mark = newest and newest - dt.timedelta(hours=1)
        part = rows[k * size:(k + 1) * size]
        for i, ts, extra in part:
            want = "undated" if ts is None else "late" if mark and ts < mark else "kept"
            assert (got[i].arrival, got[i].extra, got[i].ts) == (want, extra, ts)
            assert got[i].delay_seconds == ((mark - ts).total_seconds() if want == "late" else None)
        newest = max([ts for _, ts, _ in part if ts] + ([newest] if newest else []))
    assert any(r.arrival == "late" for r in got.values()) == (files > 1)


def test_times_of_another_zone(spark, tmp_path):
    write(spark, [(1, minutes(0)), (2, minutes(600))], "id int, ts timestamp", str(tmp_path / "in"))
    write(spark, [(3, minutes(530)), (4, minutes(550))], "id int, ts timestamp", str(tmp_path / "in"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        stream = feeds.read_table(spark, str(tmp_path / "in"), "id int, ts timestamp", max_files=1)
        lateness.start_split(stream, "ts", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        got = {r.id: (r.arrival, r.delay_seconds) for r in lateness.read_split(spark, str(tmp_path / "out"), stream.schema).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == {1: ("kept", None), 2: ("kept", None), 3: ("late", 600.0), 4: ("kept", None)}


def kept_of(rows, ttl):
    last, want = {}, []
    for key, ts in sorted({r for r in rows if None not in r}):
        if key not in last or ts >= last[key] + ttl:
            want.append((key, ts))
            last[key] = ts
    return want


@pytest.mark.parametrize("files", [1, 4, 25])
def test_repeats_whatever_the_micro_batches(spark, tmp_path, files):
    rng = random.Random(9)
    rows = [(rng.choice(["hot", "hot", "a", "b", "c"]), minutes(i // 2)) for i in range(600)]
    schema, out = "k string, ts timestamp", str(tmp_path / "out")
    size = len(rows) // files
    for i in range(files):
        write(spark, rows[i * size:(i + 1) * size], schema, str(tmp_path / "in"))
    stream = feeds.read_table(spark, str(tmp_path / "in"), schema, max_files=1)
    repeats.start_suppressing(stream, "k", "ts", out, str(tmp_path / "state"), ttl=1800).awaitTermination()
    got = sorted(tuple(r) for r in repeats.read_kept(spark, out, stream.schema).collect())
    assert got == kept_of(rows, dt.timedelta(seconds=1800))
    assert len(list((tmp_path / "out" / "last").iterdir())) <= 2


def test_repeats_after_a_restart_and_forgotten_keys(spark, tmp_path):
    schema, out = "k string, ts timestamp", str(tmp_path / "out")
    for key, at in (("k", 0), ("k", 10), ("other", 150), ("k", 180), ("k", 200), ("other", 205)):
        write(spark, [(key, minutes(at))], schema, str(tmp_path / "in"))
        stream = feeds.read_table(spark, str(tmp_path / "in"), schema)
        repeats.start_suppressing(stream, "k", "ts", out, str(tmp_path / "state")).awaitTermination()
    got = sorted(tuple(r) for r in repeats.read_kept(spark, out, stream.schema).collect())
    assert got == [("k", minutes(0)), ("k", minutes(180)), ("other", minutes(150))]


def test_rows_without_key_or_time_are_kept(spark):
    rows = [(None, minutes(0), 1), (None, minutes(0), 2), ("a", None, 3), ("a", None, 4), ("a", minutes(0), 5), ("a", minutes(0), 5)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, n int")
    got = repeats.choose(df, spark.createDataFrame([], "_key string, _last_micros bigint"), "k", "ts").collect()
    assert sorted(r.n for r in got) == [1, 2, 3, 4, 5]
    assert repeats.choose(df.limit(0), spark.createDataFrame([("a", 0)], "_key string, _last_micros bigint"), "k", "ts").count() == 0


def test_one_key_with_all_rows_takes_constant_memory():
    schema = pa.schema([("_key", pa.string()), ("_micros", pa.int64()), ("_last_micros", pa.int64())])

    def batches(n):
        for b in range(n):
            times = np.arange(10_000, dtype=np.int64) * 1_000 + b * 10_000_000
            yield pa.record_batch([pa.array(["hot"] * 10_000), pa.array(times), pa.nulls(10_000, pa.int64())], schema=schema)

    def peak(n):
        tracemalloc.start()
        kept = sum(b.num_rows for b in repeats._fold(7_000_000)(batches(n)))
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return kept, top

    (few, small), (many, large) = peak(5), peak(200)
    assert large < 1.5 * small and (few, many) == (8, 286)
