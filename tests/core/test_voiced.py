"""Voiced time on small rows: the inverse by definition, leaked lines and piled words."""

import random

from pyspark.sql import functions as F

from lineweave.operators import voiced as V

LINES = "song long, line long, text string, s long, e long"


def moment(regions, amount):
    """Walk along the regions."""
    for s, e in regions:
        if amount <= e - s:
            return s + amount
        amount -= e - s
    return regions[-1][1]


def test_inverse_by_walking(spark):
    rng = random.Random(3)
    voice, wanted, want = [], [], []
    for song in range(6):
        t, regions = 0, []
        for k in range(rng.randint(1, 5)):
            s = t + rng.randint(1, 9)
            t = s + rng.randint(1, 9)
            regions.append((s, t))
            voice.append((song, k, "", s, t))
        for n, amount in enumerate([0, *(rng.randint(0, 50) for _ in range(12))]):
            wanted.append((song, amount, n))
            want.append((song, n, moment(regions, amount)))
    voice += [(9, 0, "", 5, 5), (9, 1, "", None, None)]
    wanted.append((9, 3, 0))
    got = V.voiced_moments(spark.createDataFrame(voice, LINES), spark.createDataFrame(wanted, "song long, amount long, n long"), ["song"])
    assert sorted((r.song, r.n, r["at"]) for r in got.collect()) == [*sorted(want), (9, 0, None)]


def leaks(spark, lines, voice):
    got = V.spread_leaks(spark.createDataFrame(lines, LINES), spark.createDataFrame(voice, LINES), 100, 1.0, 10, 25, 1)
    return {r.line: (r.new_s, r.new_e) for r in got.collect()}


def test_leaked_lines_go_behind_the_silence(spark):
    voice = [(1, 0, "", 0, 100), (1, 1, "", 300, 340), (1, 2, "", 360, 420), (1, 3, "", 700, 800)]
    lines = [(1, 0, "first", 0, 50), (1, 1, "sung", 50, 100), (1, 2, "a" * 9, 150, 151), (1, 3, "b" * 9, 160, 161), (1, 4, "reached", 295, 310), (1, 5, "later", 365, 375), (1, 6, "after the next", 705, 750)]
    got = leaks(spark, lines, voice)
    # lines 2 to 5 share 100 of voice: 300-340 and 360-420, a quarter each
    assert got == {2: (300, 325), 3: (325, 370), 4: (370, 395), 5: (395, 420)}
    near = [x if x[1] != 3 else (1, 3, "b" * 9, 40, 41) for x in lines]
    assert 3 not in leaks(spark, near, voice)  # sorted first, on voice
    capped = [x if x[1] != 2 else (1, 2, "a" * 9, 101, 102) for x in lines]
    assert leaks(spark, capped, voice)[2] == (300, 325) and leaks(spark, [x if x[1] != 4 else (1, 4, "reached", 291, 292) for x in lines], voice)[5] == (395, 420)


def test_lines_on_voice_or_slow_stay(spark):
    voice = [(1, 0, "", 0, 100), (1, 1, "", 300, 400)]
    slow = [(1, 0, "x", 0, 9), (1, 1, "", 150, 160), (1, 2, "y", 300, 310)]
    assert leaks(spark, slow, voice) == {}  # nothing is too fast
    assert leaks(spark, [(1, 0, "x", 0, 9), (1, 1, "aaaa", 60, 61), (1, 2, "y", 300, 310)], voice) == {}  # on voice
    late = [(1, 0, "x", 0, 9), (1, 1, "a" * 99, 240, 241), (1, 2, "y", 300, 310)]
    assert leaks(spark, late, voice) == {}  # not far before the end
    assert leaks(spark, [(1, 0, None, None, None), (1, 1, None, 150, 151)], voice) == {} == leaks(spark, [], [])
    alone = [(1, 0, "x", 0, 9), (1, 1, "a" * 99, 150, 151)]
    assert leaks(spark, alone, voice) == {}  # no line has come to the voice behind


def test_piles_over_voice(spark):
    voice = spark.createDataFrame([(1, 0, "", 10, 20), (1, 1, "", 80, 90)], LINES)
    rows = [(1, 1, 1, 0, 5), (1, 1, 2, 0, 5), (1, 1, 3, 0, 30), (1, 1, 4, 0, 5), (1, 1, 5, 100, 110), (1, 1, 6, 100, 140), (1, 2, 1, 10, 10), (1, 2, 2, 10, 10), (1, 3, 1, None, 4)]
    words = spark.createDataFrame(rows, "song long, line long, k long, s long, e long")
    got = {(r.line, r.k): (r.new_s, r.new_e) for r in V.spread_by_voice(words, voice).collect()}
    assert [got[1, k] for k in range(1, 5)] == [(0, 5), (15, 15), (20, 30), (85, 85)]
    assert got[1, 5] == (100, 110) and got[1, 6] == (120, 140)  # no voice: even steps
    assert got[2, 1] == got[2, 2] == (10, 10) and got[3, 1] == (None, 4)
    assert V.spread_by_voice(words.where(F.lit(False)), voice).collect() == []
