from pyspark.sql import functions as F

from lineweave.functions import text as X
from lineweave.operators import layers as L
from lineweave.operators import repairs as R
from lineweave.operators import sequential as S
from lineweave.sources.tables import table

LINES = "song long, line long, text string"


def test_keys_of_lines(spark):
    rows = [(1, 1, "Are you ready ?"), (1, 2, "Ａｒｅ　ｙｏｕ ready？"), (1, 3, "a\u200bb\ufeff c"), (1, 4, "行く。"), (1, 5, "行く？"), (1, 6, "!"), (1, 7, None), (1, 8, "a!")]
    got = {r.line: (r.strict, r.loose) for r in L.line_keys(spark.createDataFrame(rows, LINES)).collect()}
    assert got[1] == ("Areyouready?", "Areyouready") == got[2] and got[3] == ("abc", "abc")
    assert got[4] == ("行く。", "行く") and got[5] == ("行く?", "行く")
    assert got[6] == ("!", None) and got[7] == ("", None) and got[8] == ("a!", None)
    assert L.line_keys(spark.createDataFrame([], LINES)).collect() == []


def test_lyric_norm(spark):
    rows = spark.createDataFrame([("Cafe\u0301,  NOIR!",), (None,)], "t string").select(L.lyric_norm(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == ["café noir", ""]


def keyed(*lines):
    return [(t.replace(" ", ""), t.replace(" ", "").strip(".!?") if len(t.strip(".!? ")) > 1 else None) for t in lines]


def test_walk_over_split_lines():
    assert S.walk(keyed("one two", "three"), keyed("one two", "three")) == [(0, 1, 0, 1), (1, 1, 1, 1)]
    # one line of the other list says several of ours, and the other way round
    assert S.walk(keyed("one", "two", "three", "four"), keyed("one two three", "four")) == [(0, 3, 0, 1), (3, 1, 1, 1)]
    assert S.walk(keyed("one two three", "four"), keyed("one", "two", "three", "four")) == [(0, 1, 0, 3), (1, 1, 3, 1)]
    # punctuation that only one has, also inside a join
    assert S.walk(keyed("I love you.", "and more"), keyed("I love you", "and more!")) == [(0, 1, 0, 1), (1, 1, 1, 1)]
    # lines that only one list has are skipped, to the nearest equal pair
    assert S.walk(keyed("aa", "x1", "x2", "bb", "cc"), keyed("title", "aa", "bb", "y1", "cc")) == [(0, 1, 1, 1), (3, 1, 2, 1), (4, 1, 4, 1)]
    far = [f"n{i}" for i in range(12)]
    assert S.walk(keyed("aa", *far[:11], "zz"), keyed("aa", "zz")) == [(0, 1, 0, 1), (12, 1, 1, 1)]
    assert S.walk(keyed("aa", *far, "zz"), keyed("aa", "zz")) == [(0, 1, 0, 1)]
    # more than six parts aren't one line
    assert S.walk(keyed(*"abcdefg"), keyed("a b c d e f g")) == []
    assert S.walk([], keyed("a")) == S.walk(keyed("a"), []) == []


def test_layers_are_carried_over(spark):
    ours = spark.createDataFrame([(1, 1, "one two"), (1, 2, "three"), (1, 3, "four"), (2, 1, "aa"), (2, 2, "bb"), (2, 3, "cc"), (3, 1, None)], LINES)
    layer = spark.createDataFrame([(1, 1, "one", "eins "), (1, 2, "two", "zwei"), (1, 3, "three four", "drei vier"), (2, 1, "aa", "AA"), (2, 2, "zz", "ZZ")], LINES + ", translation string")
    got = sorted(tuple(r) for r in S.carry_layer(ours, layer).collect())
    assert got == [(1, 1, "eins zwei"), (1, 2, "drei vier")]  # song 2 gets a third of its lines only
    assert sorted(tuple(r) for r in S.carry_layer(ours, layer, 0.3).where("song = 2").collect()) == [(2, 1, "AA")]


def test_most_lines_of_resplit_documents_align(spark):
    d = "/root/testdata/sf0.001"
    a, b = S.resplit(spark, d)
    found = S.align_resplit(a, b).agg(F.sum("lines"), F.sum("others")).first()
    assert found[0] > 0.95 * a.count() and found[1] > 0.95 * b.count()


def test_shown_layers(spark):
    rows = [(1, 1, "a", "b", "c"), (1, 2, "a", None, "c"), (1, 3, "a", "", None), (2, 1, "x", None, None), (3, 1, "x", "y", None)]
    df = spark.createDataFrame(rows, LINES + ", pronunciation string, translation string")
    assert [r.s for r in df.orderBy("song", "line").select(L.display_text(F.col("text"), F.col("pronunciation"), F.col("translation")).alias("s")).collect()] == ["a\n(b)\nc", "a\nc", "a", "x", "x\n(y)"]
    got = {(r.song, r.variant): r.text for r in L.variants(df).collect()}
    assert set(got) == {(1, "original"), (1, "translated"), (1, "pronunciation"), (1, "full"), (2, "original"), (3, "original"), (3, "pronunciation"), (3, "full")}
    assert got[1, "translated"] == "c\nc\na" and got[3, "full"] == "x\n(y)"


def test_names_and_origins(spark):
    df = spark.createDataFrame([("wiki1", None, None), (None, "My Captions", "u"), (None, "x", "http://a"), (None, None, None), (" ", "", "")], "a string, b string, c string")
    assert [r.o for r in df.select(L.origin(F.col("a"), F.col("b"), F.col("c"), ("wiki1",)).alias("o")).collect()] == ["wiki", "caption", "wiki", "manual", "manual"]
    df = spark.createDataFrame([(None, " new "), ("", "n" * 300), ("old", "new"), (None, " "), (None, None)], "a string, b string")
    assert [r.o for r in df.select(L.backfilled(F.col("a"), F.col("b")).alias("o")).collect()] == ["new", "n" * 256, "old", None, None]


def test_matches_inside_words_and_long_runs(spark, tmp_path):
    docs = [(1, "prefixunbreakable moonlight"), (2, "unbreakable, moonlight!"), (3, "moonlight"), (4, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "Unbreakable Moonlight\nsecond"), (8, "short"), (9, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {(1, 1, 7, 1), (2, 1, 7, 1)} <= {tuple(r) for r in X.q_containment_lines(spark, str(tmp_path)).select("song", "line", "item_id", "item_line").collect()}
    from lineweave.operators.arrays import adjacent_equals

    spark.createDataFrame([(1, "a" * 300), (2, "ab"), (3, "a"), (4, None)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    assert {r.p_partkey: r.frames for r in adjacent_equals(spark, str(tmp_path)).collect()} == {1: 599, 2: 2, 3: 1, 4: None}


def test_nulls_and_empty_tables(spark):
    lines = spark.createDataFrame([(1, 1, None), (1, 2, "a b"), (1, 3, "a b")], LINES)
    assert [tuple(r) for r in S.split_long_lines(lines, 2).orderBy("line", "piece").collect()] == [(1, 2, 0, "a"), (1, 2, 1, "b"), (1, 3, 0, "a"), (1, 3, 1, "b")]
    assert S.align_lines(lines.where("line = 1"), lines.where("line = 1")).collect() == []
    timed = "song long, line long, text string, s long, e long, value double"
    some = spark.createDataFrame([(1, 1, "x", None, None, None), (1, 2, "x", 0, 10, 1.0), (1, 3, "x", 5, None, 1.0), (1, 3, "x", 40 * R.HOUR, 41 * R.HOUR, 1.0)], timed)
    voice = spark.createDataFrame([(1, 1, 2, 4), (2, 1, None, None)], "song long, line long, s long, e long")
    for run in (lambda a, v: R.fill_voiced_gaps(a, v, 1, 100), lambda a, v: R.shrink_silent(a, v, 5, 1), lambda a, v: R.on_onset(a, v, 3), lambda a, v: R.pull_to_block(a, v, 5, 5), lambda a, v: R.stranded(a, v, 5, 1), R.body_region, lambda a, v: R.problem_gaps(a, "value > 0", 5), lambda a, v: R.match_stats(a, "value > 0"), lambda a, v: R.gated_match(a, v, 1, 0.1), lambda a, v: R.reaped(a, v, 5), lambda a, v: R.remembered(a, v, 5)):
        run(some, voice).collect()
        assert run(some.limit(0), voice).collect() == [] == run(some.limit(0), voice.limit(0)).collect()
    assert {(r.line, r.new_s, r.new_e) for r in R.shrink_silent(some, voice, 5, 1).collect()} >= {(1, None, None), (2, 1, 5)}


def test_same_lines_stream_songs_over_all_tasks(spark):
    a = spark.createDataFrame([(s, k, t) for s in range(20) for k, t in ((1, "one"), (2, "two!"), (3, "three"), (4, "ｏｎｅ​"))] + [(None, 1, "one")], "song long, line long, text string")
    b = spark.createDataFrame([(s, k, t) for s in range(20) for k, t in ((5, "two"), (6, "one"), (7, "one"), (8, ""))] + [(None, 1, "one")], "song long, line long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        found = L.same_lines(a, b)
        assert found.rdd.getNumPartitions() == 4
        assert sorted(map(tuple, found.collect())) == [(s, k, o, x) for s in range(20) for k, o, x in ((1, 6, True), (2, 5, False), (4, 6, True))]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
