"""Words of lines on small rows, by hand and by the rule read off."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lineweave.operators import line_words as W

S = 1_000_000
WORDS, LINES = "song long, line long, k long, word string, s long, e long", "song long, line long, text string, s long, e long"


def frames(spark, lines, words):
    return spark.createDataFrame(lines, LINES), spark.createDataFrame(words, WORDS)


def plain_cover(text, words, line_s, line_e, most):
    """Letter by letter."""
    out, i, p = [], 0, 0
    while p < len(text):
        word = words[i] if i < len(words) else None
        if word and text.startswith(word[0], p):
            out.append([word[0], word[1], word[2], True])
            p, i = p + len(word[0]), i + 1
        elif word and not 0 <= text.find(word[0], p) - p <= W.REACH:
            i += 1
        else:
            out.append([text[p], None, None, False])
            p += 1
    k = 0
    while k < len(out):
        j = k
        while j < len(out) and not out[j][3]:
            j += 1
        n = j - k
        if n:
            lo = out[k - 1][2] if k else None
            hi = out[j][1] if j < len(out) else None
            if lo is None and hi is None:
                lo, hi = line_s, line_e
            elif lo is None:
                lo = min(max(line_s, hi - most * n), hi)
            elif hi is None:
                hi = min(line_e, lo + most * n)
            hi = max(hi, lo)
            for x in range(n):
                out[k + x][1:3] = lo + (hi - lo) * x // n, lo + (hi - lo) * (x + 1) // n
        k = j + 1
    return [tuple(x) for x in out]


TEXT, WORD = st.text(alphabet="ab c", max_size=12), st.text(alphabet="ab c", min_size=1, max_size=3)


@settings(max_examples=12, deadline=None)
@given(lines=st.lists(st.tuples(TEXT, st.lists(WORD, min_size=1, max_size=6)), min_size=1, max_size=30))
def test_cover_like_letter_by_letter(spark, lines):
    timed = [[(w, (7 * k + 3) * S, (7 * k + 8 - 2 * (k % 3)) * S) for k, w in enumerate(words)] for _, words in lines]
    rows = [(1, i, t, 0, 60 * S) for i, (t, _) in enumerate(lines)]
    words = [(1, i, k, *w) for i, x in enumerate(timed) for k, w in enumerate(x)]
    found = {}
    for r in sorted(W.full_words(*frames(spark, rows, words), 2 * S).collect()):
        found.setdefault(r.line, []).append((r.word, r.s, r.e, r.measured))
    for i, (text, _) in enumerate(lines):
        assert found.get(i, []) == plain_cover(text, timed[i], 0, 60 * S, 2 * S), (text, timed[i])


def test_cover_of_odd_lines(spark):
    lines = [(1, 1, None, 0, S), (1, 2, "ab", None, None), (1, 3, "ab", 0, 4 * S), (1, 4, "", 0, S)]
    words = [(1, 1, 0, "a", 0, S), (1, 2, 0, "b", 2 * S, 3 * S), (1, 2, 1, None, 0, 1), (1, 3, 0, "zz", 0, S), (1, 4, 0, "a", 0, S), (1, 5, 0, "no line", 0, S)]
    got = sorted(map(tuple, W.full_words(*frames(spark, lines, words), S).collect()))
    assert got == [(1, 2, 0, "a", 2 * S, 2 * S, False), (1, 2, 1, "b", 2 * S, 3 * S, True), (1, 3, 0, "a", 0, 2 * S, False), (1, 3, 1, "b", 2 * S, 4 * S, False)]


def test_impossible_lines(spark):
    even = [(k, "ab", k * S, k * S + S) for k in range(5)]
    cases = {
        1: (0, 5, even),  # fine
        2: (0, 5, even[:3]),  # too few to tell
        3: (3, 9, even),  # before the line
        4: (0, 4, [(0, "a", 0, S), *[(k, "b", (2 + k) * S // 2 + S, 4 * S) for k in range(1, 4)]]),  # the first apart
        5: (0, 8, [(0, "abcd", 0, 10_000), (1, " ", 0, S), (2, "ab", 2 * S, 5 * S), (3, "c", 5 * S, 8 * S)]),  # pressed
        6: (0, 60, [(k, "abc", 10 * S + k, 10 * S + k + 1) for k in range(4)]),  # all at once
        7: (0, 60, [(k, "abc", (10 + k) * S, (11 + k) * S) for k in range(4)]),  # short, but slow enough
        8: (5, 5, even),  # no length, and within the slack or not
    }
    lines = [(1, i, "", a * S, b * S) for i, (a, b, _) in cases.items()]
    words = [(1, i, *w) for i, (_, _, ws) in cases.items() for w in ws] + [(1, 1, 9, None, 0, 90 * S), (1, 1, 10, "", 0, 90 * S)]
    got = {r.line for r in W.impossible_lines(*frames(spark, lines, words), 11, S, 45_000).collect()}
    assert got == {3, 4, 5, 6, 8}


def fuse(spark, lines, own, other, other_lines=None, window=(), most=S):
    ls, o = frames(spark, lines, own)
    zl, z = frames(spark, other_lines or lines, other)
    w = spark.createDataFrame(list(window), "song long, line long, s long, e long")
    return sorted(map(tuple, W.fused_words(ls, o, zl, z, w, 11, S, 45_000, most).collect()))


def test_fused_words(spark):
    line = [(1, 1, "one two", 10 * S, 20 * S)]
    own = [(1, 1, 0, "one", 10 * S, 15 * S), (1, 1, 1, "two", 10 * S, 15 * S)]
    other = [(1, 1, 0, "one", 0, S), (1, 1, 1, " ", S, 2 * S), (1, 1, 2, "two", 2 * S, 4 * S)]
    zl = [(1, 1, "one two", 0, 5 * S)]
    starts = lambda rows: [(r[3], r[4] // S, r[5] // S, r[6]) for r in rows]
    wide = fuse(spark, line, own, other, zl, most=9 * S)
    assert [x[3] for x in starts(wide)] == [True] * 3 and (wide[0][4], wide[-1][5]) == (10 * S, 20 * S)
    inside = fuse(spark, line, own, other, zl, [(1, 1, 12 * S, 16 * S)], most=9 * S)
    assert starts(inside) == [("one", 12, 13, True), (" ", 13, 14, True), ("two", 14, 16, True)]
    assert not any(r[6] for r in fuse(spark, line, own, other, zl, most=S))  # apart in the middle
    assert not any(r[6] for r in fuse(spark, line, own, other, [(1, 1, "other", 0, 5 * S)], most=9 * S))
    assert not any(r[6] for r in fuse(spark, [(1, 1, "one two", 5 * S, 5 * S)], own, other, zl, most=9 * S))
    back = [(1, 1, 0, "one", 4 * S, 8 * S), (1, 1, 1, "two", 0, S)]
    assert starts(fuse(spark, line, own, back, zl, [(1, 1, 10 * S, 18 * S)], most=9 * S)) == [("one", 14, 18, True), ("two", 18, 18, True)]
    fewer = [(1, 1, 0, "one", 0, S)]
    two = [(1, 1, 0, "one", 10 * S, 15 * S), (1, 1, 1, "two", 15 * S, 20 * S)]
    assert not any(r[6] for r in fuse(spark, line, two, fewer, zl, most=9 * S))
    assert fuse(spark, line, [], []) == [] and len(fuse(spark, line, own, [])) == 2
    assert [r[6] for r in fuse(spark, line, [(1, 1, 0, None, 0, S)], fewer, zl)] == [True]


def test_resynthesized(spark):
    ls, ws = frames(spark, [(1, 1, "", 0, 10 * S), (1, 2, "", 5 * S, 5 * S)], [(1, 1, 0, "abc", 0, 0), (1, 1, 1, "de", 0, 0), (1, 1, 2, "", 0, 0), (1, 2, 0, "x", S, 2 * S)])
    targets = ls.select("song", "line").unionByName(ls.select("song", "line"))
    assert sorted(map(tuple, W.resynthesized(ls, ws, targets).collect())) == [(1, 1, 0, "abc", 0, 6 * S), (1, 1, 1, "de", 6 * S, 10 * S), (1, 2, 0, "x", S, 2 * S)]
    assert W.resynthesized(ls, ws.limit(0), targets).collect() == []
    assert W.resynthesized(ls, ws, targets.where(F.lit(False))).count() == 3


def test_long_gaps_and_large_steps(spark):
    """Products of letters and microseconds are beyond 32 bits."""
    hour = 3600 * S
    lines, words = frames(spark, [(1, 1, "x" * 50 + "abc" + "y" * 60, 0, 1000 * hour)], [(1, 1, 0, "zz", 0, 1), (1, 1, 1, "xab", 500 * hour, 501 * hour)])
    got = W.full_words(lines, words.withColumn("word", F.when(F.col("k") == 1, "x" * 50).otherwise(F.col("word"))), hour).collect()
    assert len(got) == 64 and max(r.e for r in got) == 501 * hour + 63 * hour
