"""Streams with timers: state goes, also between two runs of one checkpoint, and batches change nothing."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lineweave.streaming import timers as T

DAY = T.DAY
SCHEMA = "user_id long, event_id long, event_type string, value double, at timestamp"


def at(days):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(days=days)


def run(spark, folder, make, batches):
    """Rows after all batches, each its own run of one checkpoint, and the rows of state after each."""
    held = []
    for k, rows in enumerate(batches):
        spark.createDataFrame([(u, e, kind, v, at(t)) for u, e, kind, v, t in rows], SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{k}")
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{folder}/in").withWatermark("at", "1 day")
        q = make(stream).writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).format("parquet").option("path", f"{folder}/out").start()
        q.awaitTermination()
        held.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    return sorted(map(tuple, spark.read.parquet(f"{folder}/out").collect()), key=repr), held


def micros(days):
    return int(at(days).timestamp() * 1_000_000)


def test_jobs_are_reaped_and_leave(spark, tmp_path):
    first = [(1, 10, "signup", 0.0, 0), (1, 11, "view", 0.0, 1), (2, 20, "signup", 0.0, 0), (2, 21, "purchase", 0.0, 0.5), (3, 30, "signup", 0.0, 0.2), (None, 40, "signup", 0.0, 0), (4, 50, "view", None, 0)]
    later = [(9, 90, "signup", 0.0, 10), (3, 31, "view", 0.0, 9.5)]
    rows, held = run(spark, tmp_path, T.reaper_stream, [first, later])
    assert rows == [(1, 10, micros(1), micros(3)), (3, 30, micros(0.2), micros(0.2) + T.SILENT)]
    assert held == [2, 1]  # of the first run 1 and 3, after the second only 9
    whole, _ = run(spark, tmp_path / "one", T.reaper_stream, [first + later])
    assert whole == rows


def test_what_was_told_is_forgotten(spark, tmp_path):
    first = [(1, 1, "click", 0.0, 0), (1, 2, "view", 0.0, 1), (2, 3, "click", 0.0, 0.4), (3, 4, "view", 0.0, 0)]
    later = [(1, 5, "view", 0.0, 5), (2, 6, "click", 0.0, 5), (2, 7, "view", 0.0, 5), (2, 8, "view", 0.0, 6.5)]
    rows, held = run(spark, tmp_path, T.memory_stream, [first, later])
    assert rows == sorted([(1, 2, 1), (3, 4, None), (1, 5, None), (2, 7, 6), (2, 8, None)], key=repr)
    assert held == [2, 0] or held == [2, 1]  # 2's memory ends inside the second batch, where a row comes after it


@pytest.mark.parametrize("make", [T.estimate_stream, T.heartbeat_stream, T.late_data_stream])
def test_batches_change_nothing(spark, tmp_path, make):
    kinds = ["signup", "view", "purchase", "view", "error", "view", "click"]
    rows = [(k % 3, k, kinds[(k * 5 + k // 3) % 7], float(k), k / 9) for k in range(120)]
    whole, _ = run(spark, tmp_path / "one", make, [rows])
    cut, held = run(spark, tmp_path / "two", make, [rows[:50], rows[50:80], rows[80:], [(7, 999, "click", 0.0, 40)]])
    if make is T.late_data_stream:  # who still waits at the end of the one run is through after the other
        assert set(whole) <= set(cut) and len(cut) - len(whole) <= 3
    else:
        assert [r for r in cut if r[0] != 7] == whole
    if make is T.heartbeat_stream:
        assert held[-1] == 1  # all but the last user are out of date


def test_late_data(spark, tmp_path):
    h = 1 / 24
    first = [(1, 1, "signup", 0.0, 0), (1, 2, "purchase", 0.0, 7 * h), (2, 3, "signup", 0.0, 0), (2, 4, "error", 0.0, h), (3, 5, "signup", 0.0, 0), (4, 6, "signup", 0.0, 0), (4, 7, "signup", 0.0, h), (4, 8, "purchase", 0.0, 10 * h)]
    rows, held = run(spark, tmp_path, T.late_data_stream, [first, [(9, 9, "view", 0.0, 3)]])
    assert rows == sorted([(1, 1, 2, "met"), (2, 3, None, "cancelled"), (3, 5, None, "without"), (4, 6, None, "without"), (4, 7, None, "without")], key=repr)
    assert held == [1, 0]


def test_empty_stream(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")).withWatermark("at", "1 day")
    assert T.available(T.reaper_stream(stream)).where(F.lit(True)).collect() == []
