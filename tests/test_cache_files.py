import datetime as dt

import pytest
from pyspark.sql import functions as F

from prefrank.operators import cache
from prefrank.sources import cache_files, tables

NOW = dt.datetime(2024, 1, 3)


def append(spark, path, rows):
    table = spark.createDataFrame([(k, f'{{"winner": "A", "latency_ms": {v}}}', t) for k, v, t in rows],
                                  "key string, value string, written_at timestamp")
    tables.append_cache(table, path)


def live(spark, path):
    found = cache.live_entries(tables.read_cache(spark, path), F.lit(NOW), ttl=7 * 86400)
    return {r.key: r.cached.latency_ms for r in found.collect()}


def at(day, hour):
    return dt.datetime(2024, 1, day, hour)


@pytest.fixture
def path(spark, tmp_path):
    place = str(tmp_path / "cache")
    for turn in range(4):
        append(spark, place, [("a", float(turn), at(1, turn)), (f"k{turn}", 1.0, at(1, 5)), ("a", 9.0 - turn, at(2, turn))])
    return place


WANT = {"a": 6.0, "k0": 1.0, "k1": 1.0, "k2": 1.0, "k3": 1.0}


def test_compaction_keeps_the_entries(spark, path):
    before = cache_files.count_files(spark, path)
    assert live(spark, path) == WANT and before >= 8
    assert cache_files.compact(spark, path) == 2
    # Replaced files stay for readers that know them; entries may stand twice.
    assert cache_files.count_files(spark, path) > before and live(spark, path) == WANT
    assert cache_files.compact(spark, path) == 0
    append(spark, path, [("new", 5.0, at(2, 9))])
    assert cache_files.compact(spark, path, grace_seconds=0) == 1  # the day with the new file
    assert cache_files.compact(spark, path, grace_seconds=0) == 0
    assert live(spark, path) == WANT | {"new": 5.0}
    assert cache_files.count_files(spark, path) == 2 and tables.read_cache(spark, path).count() == 5 + 2
    assert not any(p.name.startswith("_") and list(p.iterdir()) for p in __import__("pathlib").Path(path).iterdir() if p.is_dir())


@pytest.mark.parametrize("step", ["write_settings", "_finish"])
def test_a_broken_compaction_loses_nothing(spark, path, monkeypatch, step):
    def breaks(*args, **options):
        raise RuntimeError("lost")

    real = getattr(cache_files, step)
    monkeypatch.setattr(cache_files, step, breaks)
    with pytest.raises(RuntimeError, match="lost"):
        cache_files.compact(spark, path)
    assert live(spark, path) == WANT
    monkeypatch.setattr(cache_files, step, real)
    cache_files.compact(spark, path)
    cache_files.compact(spark, path, grace_seconds=0)
    assert live(spark, path) == WANT
    assert cache_files.count_files(spark, path) == 2


def test_a_move_that_stopped_half_way_is_finished(spark, path, monkeypatch):
    moved = []
    real = cache_files._Files.move

    def once(self, source, target):
        if moved:
            raise OSError("lost")
        moved.append(target)
        real(self, source, target)

    monkeypatch.setattr(cache_files._Files, "move", once)
    with pytest.raises(OSError):
        cache_files.compact(spark, path)
    assert live(spark, path) == WANT
    monkeypatch.setattr(cache_files._Files, "move", real)
    cache_files.compact(spark, path, grace_seconds=0)
    assert live(spark, path) == WANT and cache_files.count_files(spark, path) == 2


def test_nothing_to_compact(spark, tmp_path):
    assert cache_files.compact(spark, str(tmp_path / "none")) == 0 and cache_files.count_files(spark, str(tmp_path / "none")) == 0
    append(spark, str(tmp_path / "one"), [("a", 1.0, at(1, 0))])
    assert cache_files.compact(spark, str(tmp_path / "one")) == 0
