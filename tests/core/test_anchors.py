"""Anchors and word times on small rows: order, repeats, nulls, empty tables."""

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lineweave.operators import anchors as A
from lineweave.operators import words as W

S = 1_000_000


def plain_forward(keys, captions, n, share):
    """The rule read off: the pointer stays on the last caption taken."""
    at, found = 0, []
    for i, a in enumerate(keys):
        if a is None or len(a) < n:
            continue
        for j in range(at, len(captions)):
            b = captions[j]
            if b and len(b) >= n and (a in b or b in a and len(b) >= share * len(a)):
                found.append((i + 1, j + 1))
                at = j
                break
    return found


def rows_of(spark, keys, captions):
    lines = spark.createDataFrame([(1, i + 1, k) for i, k in enumerate(keys)], "song long, i long, key string")
    caps = spark.createDataFrame([(1, 7, j + 1, k, 20 * j * S, (20 * j + 2) * S) for j, k in enumerate(captions)], "song long, track long, j long, key string, s long, e long")
    return lines, caps


def test_forward_only(spark):
    keys = ["chorus", "verse one", None, "chorus", "ve", "", "late", "chorus", "two lines", "in a caption", "abcd", "a line much longer than what is shown of it"]
    captions = ["credits", "chorus", "verse one la", None, "chorus", "credits", "two lines in a caption", "late", "a caption that holds abcd and much more", "shown"]
    lines, caps = rows_of(spark, keys, captions)
    pairs = A.key_pairs(lines, caps, 4, 0.3).distinct()
    got = sorted((r.i, r.j) for r in A.forward(pairs, 0).collect())
    assert got == plain_forward(keys, captions, 4, 0.3)
    assert (1, 2) in got and (4, 5) in got and (11, 9) in got and all(i != 12 for i, _ in got)


def test_forbidden_spans_and_plan(spark):
    keys = ["first line", "second line", "third line", "fourth line"]
    captions = ["first line", "credit", "second line", "fourth line", "third line", "other", "fourth line"]
    lines, caps = rows_of(spark, keys, captions)
    pairs = A.key_pairs(lines, caps, 4, 0.3).distinct()
    found = A.anchors(lines, caps, pairs, S // 2)
    spans = A.forbidden_spans(found, 8 * S, S, S // 2, S // 4)
    got = {r.i: (r.s, r.e, r.between, r.likes, r.accepted) for r in spans.collect()}
    # ten letters last 2.5 s, longer than the caption's 2; a caption like a line forbids the second span
    assert got[1] == (3_500_000, 39 * S, 1, 0, True)
    assert got[2][2:] == (1, 1, False)
    assert got[3][2:] == (1, 0, True)
    timed = lines.withColumns({"s": F.lit(0), "e": F.lit(1000 * S)})
    plan = A.anchor_plan(timed, caps, found, spans, 4, 50, 35).collect()[0]
    assert (plan.track, plan.matched, plan.spans, plan.skipped) == (7, 4, 2, None)
    tight = A.anchor_plan(timed.withColumn("e", F.lit(150 * S)), caps, found, spans, 4, 50, 35).collect()[0]
    assert (tight.spans, tight.skipped) == (0, "too_much_forbidden")
    short = A.anchor_plan(timed.withColumn("key", F.lit("ab")), caps, found, spans, 4, 50, 35).collect()[0]
    assert short.skipped == "no_matchable_lines"


def test_echoes(spark):
    def run(items, lines):
        i = spark.createDataFrame([(1, k + 1, x) for k, x in enumerate(items)], "song long, i long, key string")
        j = spark.createDataFrame([(1, k + 1, x) for k, x in enumerate(lines)], "song long, j long, key string")
        return sorted((r.line, r.item) for r in A.echoes(i, j).collect())

    assert run(["a", "c", None, "a"], ["a", "b", "c", "a"]) == [(1, 1), (3, 2), (4, 4)]
    assert run([None, "", None], ["a", "b"]) == [(1, 1), (2, 2)]
    assert run(["x", "y"], ["a", "b"]) == [(1, 1), (2, 2)]
    assert run(["x"], ["a", "b"]) == []
    assert run(["a", "a"], ["a"]) == [(1, 1)]


def test_echoes_of_every_error(spark, tmp_path):
    """Errors are taken whatever their number; the query and its SQL say the same."""
    rows = [(1, 1, "error", 10.1), (2, 1, "error", 20.2), (3, 1, "error", 30.3), (4, 1, "click", 10.4), (5, 1, "click", 20.5), (6, 1, "click", 30.6)]
    rows += [(11, 2, "error", 40.1), (12, 2, "error", 50.2), (13, 2, "click", 60.3), (14, 2, "click", 70.4)]  # as many as clicks: by number
    rows += [(21, 3, "error", 1.0), (23, 3, "error", 2.0), (25, 3, "error", 3.0), (26, 3, "click", 80.0), (28, 3, "click", 90.0)]  # without keys
    rows += [(31, 4, "error", 10.0), (32, 4, "error", 4.9), (33, 4, "click", 20.0)]  # one key is told, but meets nothing
    start, names = datetime.datetime(2024, 1, 1), ["event_id", "user_id", "event_type", "value"]
    table = pa.table([*map(list, zip(*rows)), [start + datetime.timedelta(hours=r[0]) for r in rows]], [*names, "ts"])
    pq.write_table(table, tmp_path / "events.parquet")
    query, sql = A.QUERIES["echo_alignment"]
    want = [(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 1, 1), (2, 2, 2), (3, 1, 1), (3, 2, 2)]
    assert sorted((r.song, r.line, r.item) for r in query(spark, str(tmp_path)).collect()) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    assert sorted(con.execute(f"SELECT song, line, item FROM ({sql})").fetchall()) == want


def test_letter_times(spark):
    def run(text, spans):
        d = spark.createDataFrame([(text, spans)], "text string, spans array<struct<letter: string, s: bigint, e: bigint>>").withColumn("hits", W.letters_found("text", "spans"))
        r = d.select(W.letter_times(F.col("text"), F.col("hits")).alias("t")).collect()[0].t
        return r and [(x.s, x.e) for x in r]

    assert run("abcd", [("a", 0, 10), ("d", 40, 50)]) == [(0, 10), (10, 20), (20, 30), (40, 50)]
    assert run("xaby", [("a", 5, 6), ("z", 7, 8), ("b", 9, 10)]) == [(5, 6), (5, 6), (9, 10), (9, 10)]
    assert run("abc", []) is None and run(None, [("a", 1, 2)]) is None and run("", [("a", 1, 2)]) is None and run("abc", None) is None


def test_syllable_times(spark):
    d = spark.sql("SELECT array(named_struct('s', 0L, 'e', 6L), named_struct('s', 6L, 'e', 9L)) AS t, array(named_struct('a', 1, 'b', 2), named_struct('a', 1, 'b', 2), named_struct('a', 2, 'b', 3), named_struct('a', 5, 'b', 6)) AS m")
    got = d.select(W.syllable_times(F.col("m"), F.col("t")).alias("x")).collect()[0].x
    assert [(x.s, x.e) for x in got] == [(0, 3), (3, 6), (6, 9), (None, None)]


WORDS = "song long, line long, k long, s long, e long"


def test_pulled_tails(spark):
    far = [(1, 1, 1, 0, 1 * S), (1, 1, 2, 1 * S, 2 * S), (1, 1, 3, 6 * S, 7 * S)]
    verse = [(2, 1, 1, 0, S), (2, 1, 2, 9 * S, 10 * S), (2, 1, 3, 10 * S, 11 * S), (2, 1, 4, 11 * S, 12 * S)]
    sung = [(3, 1, 1, 0, S), (3, 1, 2, 4 * S, 5 * S), (3, 1, 3, None, None)]
    voice = spark.createDataFrame([(3, 1, 0, 5 * S)], "song long, line long, s long, e long")
    got = {(r.song, r.k): (r.s, r.e) for r in W.pull_tails(spark.createDataFrame(far + verse + sung, WORDS), voice, 2 * S, S, 300_000).collect()}
    assert got[1, 3] == (2_300_000, 2_300_000) and got[1, 2] == (S, 2 * S)
    assert got[2, 2] == (9 * S, 10 * S), "half a verse after a rest isn't a tail"
    assert got[3, 2] == (4 * S, 5 * S), "a gap with voice in it stays"
    assert W.pull_tails(spark.createDataFrame([], WORDS), voice, 2 * S, S, 300_000).count() == 0


def test_held_tails(spark):
    lines = spark.createDataFrame([(1, 1, 0, S), (1, 2, 5 * S, 6 * S), (1, 3, 7 * S, None)], "song long, line long, s long, e long")
    voice = spark.createDataFrame([(1, 1, 0, 3 * S)], "song long, line long, s long, e long")
    assert {r.line: r.new_e for r in W.hold_tails(lines, voice, 10 * S, 50_000).collect()} == {1: 3 * S, 2: 6 * S, 3: None}


def test_forward_streams_songs_over_all_tasks(spark):
    rows = [(song, track, i, j) for song in range(40) for track in (1, 2) for i in (1, 2, 3) for j in (3, 2, 1) if (i, j) != (1, 1)]
    pairs = spark.createDataFrame(rows, "song long, track long, i long, j long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        found = A.forward(pairs, 0)
        assert found.rdd.getNumPartitions() == 4, "small groups aren't put into one task"
        assert sorted(map(tuple, found.collect())) == [(s, t, i, j) for s in range(40) for t in (1, 2) for i, j in ((1, 2), (2, 2), (3, 2))]
        assert sorted(map(tuple, A.forward(pairs.where("song = 1"), 1).collect())) == [(1, t, i, j) for t in (1, 2) for i, j in ((1, 2), (2, 3))]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
