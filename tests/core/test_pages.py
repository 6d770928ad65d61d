from pyspark.sql import functions as F

from lineweave.operators import queues as Q
from lineweave.sources import pages as P


def test_hinted_table(spark):
    t = lambda h, x: (f"<h3 a='b'><b>{h}</b></h3>" if h else "") + f"<TABLE id=1>{x}</TABLE>"
    pages = [
        (t("Original", "one") + t("Winter Night Edit", "two"), "Song / winter night EDIT feat. x", "two"),
        (t("긴 버전", "one") + t("짧은 버전", "two"), "song (short ver)", "two"),
        (t("A", "one") + t("반주", "two"), "the minstrel", "one"),
        (t("A", "one") + t("2", "two"), "2", "one"),
        (t("Remix", "one") + t("", "two"), "Remix", "one"),
        (t("x1", "one") + t("Remix", "two") + t("Remix B", "three"), "remix b", "three"),
        (t("x1", "one"), None, "one"),
        ("<p>none</p>", "a", None),
        (None, "a", None),
    ]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "i int, page string, hint string, want string")
    for r in df.select("i", "want", P.hinted_table(F.col("page"), F.col("hint")).alias("got")).collect():
        assert r.got == r.want, r


def test_headed_lines(spark):
    page = '<table class="lyrics-table"><tr class="lyrics-table-header"><th class="lyrics-jp">a</th>{}</tr><tr><td>x &amp; y</td><td></td><td>z</td></tr><tr><td><br /></td></tr><tr><td colspan="3" class="merged">solo</td></tr></table>'
    df = spark.createDataFrame([(0, page.format("<th>b</th><th>c</th>")), (1, page.format("")), (2, None), (3, "no")], "i int, page string")
    got = {r.i: r.x for r in df.select("i", P.headed_lines(F.col("page")).alias("x")).collect()}
    assert [tuple(x) for x in got[0].lines] == [("x & y", None, "z"), ("solo", None, None)] and got[0].translated
    assert got[1] is got[2] is got[3] is None


def test_claims_take_jobs_in_order(spark):
    kinds = "ask sync sync link ask ask ask ask sync link ask".split()
    df = spark.createDataFrame([(1, i, i, k) for i, k in enumerate(kinds)] + [(2, 0, 0, "ask")], "song long, line long, s long, kind string")
    got = Q.claims(df, ("sync", "link"), "ask").orderBy("song", "ask").collect()
    assert [(r.song, r.ask, r.job) for r in got] == [(1, 0, None), (1, 4, 1), (1, 5, 2), (1, 6, 3), (1, 7, None), (1, 10, 8), (2, 0, None)]
