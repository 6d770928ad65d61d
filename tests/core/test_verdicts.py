from pyspark.sql import functions as F

from lineweave.operators import verdicts as V


def test_notes_in_key(spark):
    rows = [(61, 60.45), (61, 61.0), (61, 61.55), (61, None), (60, 60.4), (66, 66.5), (None, 60.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, midi long, center double")
    got = df.select("i", V.snapped_to_key(F.col("midi"), F.col("center"), F.lit(0), F.lit(False)).alias("m")).orderBy("i").collect()
    assert [r.m for r in got] == [60, 61, 62, 61, 60, 67, None]


def test_titles_and_links(spark):
    df = spark.createDataFrame([(0, " Song【MV】 / Artist "), (1, "名曲feat.X"), (2, "plain"), (3, ""), (4, None), (5, "/ a / b"), (6, "a FT.b"), (7, "Loft")], "i int, t string")
    got = [r.x for r in df.select("i", V.search_titles(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == [["Song【MV】", "Song / Artist", "Song【MV】 / Artist"], ["名曲", "名曲feat.X"], ["plain"], [], None, ["/ a / b"], ["a", "a FT.b"], ["Loft"]]
    pairs = spark.createDataFrame([(0, 0.5, 0.1), (1, 0.6, 0.55), (2, 0.6, None), (3, None, None)], "i int, a double, b double")
    assert [r.v for r in pairs.select("i", V.link_verdict(F.col("a"), F.col("b")).alias("v")).orderBy("i").collect()] == ["low", "unclear", "linked", None]


def test_runs_of_broken_files(spark):
    rows = [("/x/a__b/1.json", '{"mae": 0.5}'), ("/x/a__b/2.json", "{"), ("/x/other/3.json", '{"mae": 1}'), (None, None)]
    got = V.runs_by_combo(spark.createDataFrame(rows, "path string, file string")).collect()
    assert [tuple(r) for r in got] == [("a", "b", 1, 1, 0.5)]
    lines = spark.createDataFrame([("/x/a__b/1.json", '{\n  "mae": 2.5,\n  "songs": [\n    1\n  ]\n}\n')], "path string, file string")
    assert [tuple(r) for r in V.runs_by_combo(lines).collect()] == [("a", "b", 1, 0, 2.5)]
