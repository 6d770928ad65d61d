"""Operators on curves and lines, called on small tables of one's own."""

from pyspark.sql import functions as F

from lineweave.operators import arrays as A
from lineweave.operators import fixes as X


def test_curves(spark):
    df = spark.createDataFrame([(1, [3, -1, 4, 1, -5, 9, 2]), (2, [5]), (3, []), (4, None), (5, [2, 2, 2])], "k int, x array<long>")
    x = F.col("x")
    got = {r.k: r for r in df.select("k", A.frame_energy(x, 3).alias("e"), X.peaks(x, 3).alias("p"), A.loud_runs(x, 0.4, 2).alias("l"), X.longest_run(F.transform(x, lambda v: v > 0)).alias("r"), X.every_nth(x, 3).alias("n"), X.rises(x).alias("u"), X.unit_curve(x).alias("c"), X.on_grid(x, 0.5, F.lit(5)).alias("g")).collect()}
    assert got[1].e == [26, 107, 4] and got[1].p == [4, 9, 2] and [tuple(z) for z in got[1].l] == [(5, 6)]
    assert tuple(got[1].r) == (2, 2) and got[1].n == [3, 1, 2] and got[1].u == [0, 5, 0, 0, 14, 0]
    assert abs(sum(got[1].c)) < 1e-9 and abs(sum(v * v for v in got[1].c) - 1) < 1e-9
    assert got[1].g == [3.0, 1.0, -1.0, 1.5, 4.0] and got[2].g == [5.0, 0.0, 0.0, 0.0, 0.0]
    assert got[3].e is None and got[3].p is None and got[3].r is None and got[3].n == [] == got[3].u
    assert all(getattr(got[4], c) is None for c in "eplrnuc") and got[5].c is None


def test_chunks_and_stitching(spark):
    df = spark.range(0, 60).select(F.col("id").alias("k"), F.when(F.col("id") > 0, F.sequence(F.lit(1), F.col("id"))).alias("x"))
    parts = df.select("k", "x", F.explode(A.chunks(F.size("x"), 10, 6)).alias("c")).select("k", "x", "c.*")
    parts = parts.withColumn("x", F.slice("x", (F.col("a") + 1).cast("int"), (F.col("b") - F.col("a")).cast("int")))
    got = {r.k: r.x for r in X.stitch(parts, "k").collect()}
    assert got == {k: list(range(1, k + 1)) for k in range(1, 60)}
    first = spark.range(1).select(A.chunks(F.lit(16), 10, 6).alias("c")).first().c
    assert [tuple(c) for c in first] == [(0, 10, 0, 8), (6, 16, 8, 16)]


def test_small_functions(spark):
    df = spark.createDataFrame([(880.0, "aab"), (0.0, ""), (None, None), (1760.0, "x")], "hz double, t string")
    got = df.select(A.midi_of(F.col("hz")).alias("m"), A.midi_of(F.col("hz"), 85).alias("h"), A.frames_needed(F.col("t")).alias("f")).collect()
    assert [tuple(r) for r in got] == [(81.0, 81.0, 4), (None, None, 0), (None, None, None), (93.0, 81.0, 1)]
    sym = spark.createDataFrame([(1, k, c) for k, c in enumerate("aab--b-cc")] + [(2, 0, "-")], "k int, n int, c string")
    assert {r.k: r.symbols for r in A.collapsed(sym, "k", ["n"], "c", "-").collect()} == {1: ["a", "b", "b", "c"]}
    hist = spark.createDataFrame([(1, (p + 7) % 12, int(100 * w)) for p, w in enumerate(A.MINOR)] + [(2, p, 3) for p in range(12)], "song long, pitch_class long, n long")
    assert [(r.song, r.key, r.r) for r in A.keys_of(hist).collect()] == [(1, 19, 1.0)]


def test_lines(spark):
    t = "song long, line long, text string, s long, e long, value double"
    lines = spark.createDataFrame([(1, 1, "a", 0, 10, 1.0), (1, 2, "a", 10, 12, 9.0), (1, 3, "b", 50, 60, 2.0), (1, 4, "b", 50, 55, None)], t)
    other = spark.createDataFrame([(1, 3, 77), (1, 1, 5)], "song long, line long, at long")
    assert {r.line: r["at"] for r in X.spliced(lines, other).collect()} == {1: 0, 2: 10, 3: 77, 4: None}
    assert sorted((r.s, r.e, r.n) for r in X.runs_of_pitch(lines.withColumn("pitch", F.col("text")), 5).collect()) == [(0, 12, 2), (50, 60, 2)]
    assert {r.line: r.off for r in X.off_median(lines, "value", 1).collect()} == {1: -4.0, 2: 7.0, 3: -3.5, 4: None}
    assert [(r.song, r.most) for r in X.most_covered(lines.where("line = 1"), lines.where("line <> 1").withColumn("s", F.lit(4).cast("long"))).collect()] == [(1, 18)]
    assert sorted(r.frame for r in X.whole_frames(lines, 5).collect()) == [0, 1, 10, 11]
    after = spark.createDataFrame([(1, 1, 3, 10), (1, 2, 10, 12), (1, 3, 40, 66)], "song long, line long, new_s long, new_e long")
    assert {r.line: r.moved for r in X.moved_ends(lines, after, 2).collect()} == {1: "start", 3: "both"}
    assert {r.line: r.new_at for r in X.share_moment(lines, ["song"], "s", "line", 10).collect()} == {3: 50, 4: 55}
    words = spark.createDataFrame([(1, 0, "abc"), (1, 1, "d"), (2, 0, "")], "song long, k long, word string")
    assert {(r.song, r.k): r["at"] for r in X.starts_by_length(words.where("word <> ''"), ["song"], "k", "word", 100).collect()} == {(1, 0): 0, (1, 1): 75}
