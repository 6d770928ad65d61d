"""Moras, and syllables aligned to them, against every way and by hand."""

from functools import lru_cache

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lineweave.functions import moras as M

TOKENS = "n int, tokens array<struct<surface: string, reading: string>>"


def found(spark, *lines):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], TOKENS)
    rows = df.select("n", M.text_moras(F.col("tokens")).alias("m")).orderBy("n").collect()
    return [None if r.m is None else [(x.kana, x.a, x.b) for x in r.m] for r in rows]


def test_moras_of_tokens(spark):
    got = found(
        spark,
        [("走っ", "はしっ"), ("て", "て")],
        [("今日", "きょう"), ("は", "は")],
        [("チョコ", "ちょこ")],
        [("お茶ー", "おちゃー"), (" ", ""), ("Rock'n-Roll", ""), (" & ", ""), ("3", "")],
        [("行き先", "ゆくえ")],  # surface and reading don't fit
        [("Tシャツ", "てぃーしゃつ"), ("abc", None), (None, "x")],
        [],
        None,
    )
    assert got[0] == [("は", 1, 2), ("し", 1, 2), ("っ", 2, 3), ("て", 3, 4)]
    assert got[1] == [("きょ", 1, 3), ("う", 1, 3), ("は", 3, 4)]
    assert got[2] == [("ちょ", 1, 3), ("こ", 3, 4)]
    assert got[3] == [("お", 1, 2), ("ちゃ", 2, 3), ("ー", 3, 4), ("Rock'n-Roll", 5, 16), ("&", 17, 18), ("3", 19, 20)]
    assert got[4] == [("ゆ", 1, 4), ("く", 1, 4), ("え", 1, 4)]
    assert got[5] == [("てぃ", 1, 2), ("ー", 1, 2), ("しゃ", 2, 4), ("つ", 4, 5), ("abc", 5, 8)]
    assert got[6:] == [[], None]


def cost_of(moras, prons):
    """Least cost over all ways, cell by cell."""
    rows, vowels = zip(*map(M.mora_class, moras))
    ini = [(ord(c) - M.FIRST) // 588 if M.FIRST <= ord(c) <= M.FIRST + 11171 else -1 for c in prons]
    snd = [M.SOUNDS[(ord(c) - M.FIRST) % 588 // 28] if i >= 0 else 5 for c, i in zip(prons, ini)]
    pair = M.pair_costs(np.array([rows]), np.array([vowels]), np.array([ini]), np.array([snd]))[0]

    @lru_cache(None)
    def least(i, j):
        if i == len(moras) and j == len(prons):
            return 0
        ways = []
        if i < len(moras) and j < len(prons):
            ways.append(least(i + 1, j + 1) + int(pair[i, j]))
        if i < len(moras):
            ways.append(least(i + 1, j) + (M.LOW if rows[i] in (M.STOP, M.NASAL) else M.SKIP))
        if j < len(prons):
            ways.append(least(i, j + 1) + (M.ASCII if i < len(moras) and rows[i] == M.ASCII_WORD else M.EXTRA))
        return min(ways)

    return least(0, 0), pair


MORA = st.sampled_from(["あ", "か", "きょ", "っ", "ん", "ー", "ぷ", "を", "love", "漢", "てぃ"])
SYLLABLE = st.sampled_from("아카쿄콧은오푸러브x티")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(MORA, min_size=1, max_size=5), st.lists(SYLLABLE, min_size=1, max_size=5)), min_size=1, max_size=4))
def test_least_cost_of_every_line_of_a_batch(lines):
    got = M.aligned_batch([m for m, _ in lines], [p for _, p in lines])
    for (moras, prons), (syllables, quality) in zip(lines, got):
        least, pair = cost_of(tuple(moras), tuple(prons))
        rows, vowels = zip(*map(M.mora_class, moras))
        _, last = M.edit_table(np.array([rows]), np.array([len(moras)]), pair[None])
        cost, _ = M.edit_table(np.array([rows]), np.array([len(moras)]), pair[None])
        assert cost[0, -1, -1] == least
        assert [x["text"] for x in syllables] == prons and 0 <= quality <= 1
        assert (syllables, quality) == M.read_back(moras, prons, pair, last[0])  # padding of a batch changes nothing
        at = 0
        for x in syllables:
            if x["first"] >= 0:
                assert at <= x["first"] < x["until"] <= len(moras)
                at = x["first"]


def test_by_hand():
    line = lambda moras, pron: M.aligned_batch([moras], [list(pron)])[0]
    spans = lambda x: [(s["text"], s["first"], s["until"]) for s in x[0]]
    assert spans(line(["に", "っ", "ぽ", "ん"], "닛폰")) == [("닛", 0, 2), ("폰", 2, 4)]
    assert spans(line(["day", "よ"], "데이요")) == [("데", 0, 1), ("이", 0, 1), ("요", 1, 2)]
    assert line(["さ", "く", "ら"], "사쿠라") == ([{"text": t, "first": k, "until": k + 1} for k, t in enumerate("사쿠라")], 1.0)
    assert line(["さ"], "사하")[0][1] == {"text": "하", "first": -1, "until": -1}


def test_rows_and_segments(spark):
    m = "array<struct<kana: string, a: int, b: int>>"
    rows = [(1, [("か", 1, 2), ("っ", 2, 3), ("love", 3, 7)], "캇 러브"), (2, None, "가"), (3, [("か", 1, 2)], None), (4, [], "가"), (5, [("か", 1, 2)], " "), (6, [("か", 1, 2), ("き", 2, 3)], "므므")]
    df = M.align_syllables(spark.createDataFrame(rows, f"quality_of long, moras {m}, pron string"))
    got = {r.quality_of: r for r in df.collect()}
    assert [(x.text, x.first, x.until) for x in got[1].syllables] == [("캇", 0, 2), ("러", 2, 3), ("브", 2, 3)]
    assert got[2].syllables is None and got[3].quality is None and got[4].syllables == [] == got[5].syllables
    times = F.expr("array(struct(0L AS s, 10L AS e), struct(10L AS s, 30L AS e), struct(20L AS s, 60L AS e))")
    seg = df.select("quality_of", M.syllable_segments(F.col("syllables"), F.col("quality"), times).alias("x")).collect()
    seg = {r.quality_of: r.x for r in seg}
    assert [(x.text, x.s, x.e) for x in seg[1]] == [("캇", 0, 30), ("러", 30, 40), ("브", 40, 60)]
    assert all(seg[k] is None for k in (2, 3, 4, 5, 6))
    assert M.align_syllables(df.limit(0).drop("syllables", "quality")).collect() == []
