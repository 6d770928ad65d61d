from lineweave.operators import fixes


def test_scaffold(spark):
    lines = spark.createDataFrame([(1, i, 100 * i) for i in range(6)], "song long, line long, s long")
    anchors = spark.createDataFrame([(1, 1, 105), (1, 4, 700)], "song long, line long, anchor long")
    got = {r.line: r.new_s for r in fixes.scaffold(lines, anchors, 10).collect()}
    # 1 keeps its start, 4 takes the anchor, 2 and 3 lie between, 5 can't come before 4
    assert got == {0: 0, 1: 100, 2: 300, 3: 500, 4: 700, 5: 700}
    assert fixes.scaffold(lines.limit(0), anchors.limit(0), 10).collect() == []


def test_respacing_and_rolling_captions(spark):
    lines = spark.createDataFrame([(1, i, s, t) for i, (s, t) in enumerate([(0, "a"), (10, "la"), (20, "la"), (30, "la"), (90, "la"), (95, "b")])], "song long, line long, s long, text string").withColumn("e", fixes.F.col("s") + 1)
    assert {r.line: r.new_s for r in fixes.respace_repeats(lines).collect()} == {1: 10, 2: 36, 3: 63, 4: 90}
    c = spark.createDataFrame([(1, 0, "a"), (1, 1, "a b"), (1, 2, "c"), (1, 3, None), (1, 4, "c d")], "song long, k long, text string")
    assert [r.text for r in fixes.merge_rolling(c).orderBy("run").collect()] == ["a b", "c", None, "c d"]


def test_rolling_captions_take_all_words_of_all_turns(spark, tmp_path):
    long = " ".join(f"w{i % 5}" for i in range(1003))
    turns = [(1, 0, "a b c d e f g h i"), (1, 1, "a b c d e f g h i"), (1, 2, "  "), (1, 3, None), (2, 0, "la " * 17), (2, 4, long)]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = fixes.rolling_captions_all(spark, str(tmp_path)).orderBy("conv_id", "turn", "run").collect()
    assert [(r.conv_id, r.turn, r.run, r.text) for r in got][:4] == [(1, 0, 1, "a b c d e f g h"), (1, 0, 2, "i"), (1, 1, 1, "a b c d e f g h"), (1, 1, 2, "i")]
    assert [r.text for r in got if (r.conv_id, r.turn) == (2, 0)] == [" ".join(["la"] * 8)] * 2 + ["la"]
    assert " ".join(r.text for r in got if r.turn == 4) == long
    captions = fixes.grown_captions(spark.read.parquet(str(tmp_path / "conversations.parquet")))
    assert captions.count() == 9 + 9 + 17 + 1003 and captions.selectExpr("max(size(split(text, ' ')))").first()[0] == 8
