import difflib
import random

from lineweave.operators import sequential as S
from lineweave.sources import subtitles


def test_greedy_matching(spark):
    a = spark.createDataFrame([(1, 1, 100), (1, 2, 104), (1, 3, 300), (2, 1, 5)], "song long, line long, s long")
    b = spark.createDataFrame([(1, 10, 103), (1, 11, 98), (1, 12, 200), (3, 1, 5)], "song long, line long, s long")
    assert sorted(map(tuple, S.greedy_one_to_one(a, b, 10).collect())) == [(1, 1, 11, -2), (1, 2, 10, -1)]
    assert S.greedy_one_to_one(a.limit(0), b.limit(0), 10).collect() == []


def test_alignment_is_longest(spark):
    rows = {1: ("a b c d e f".split(), "x b d c e f".split()), 2: (list("aab"), list("ba")), 3: (["q"], [])}
    frames = [spark.createDataFrame([(s, i, t) for s, v in rows.items() for i, t in enumerate(v[k])], "song long, line long, text string") for k in (0, 1)]
    got = {}
    for r in S.align_lines(*frames).collect():
        got.setdefault(r.song, []).append((r.a, r.b))
    for s, (x, y) in rows.items():
        pairs = sorted(got.get(s, []))
        assert all(x[i] == y[j] for i, j in pairs) and all(p < q and u < v for (p, u), (q, v) in zip(pairs, pairs[1:]))
        assert len(pairs) >= sum(m.size for m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())


def test_long_lines(spark):
    lines = spark.createDataFrame([(1, 1, "one two three"), (1, 2, "unbreakableword x"), (1, 3, "  ")], "song long, line long, text string")
    got = sorted(map(tuple, S.split_long_lines(lines, 8).collect()))
    assert got == [(1, 1, 0, "one two"), (1, 1, 1, "three"), (1, 2, 0, "unbreakableword"), (1, 2, 1, "x")]


def test_subtitles(spark):
    lines = spark.createDataFrame([(1, 1, 1_234_567, 3_723_004_000, "a\nb"), (1, 2, 59_996_000, 60_000_000, "c")], "song long, line long, s long, e long, text string")
    srt = subtitles.render(lines, "srt")
    assert srt.first().file == "1\n00:00:01,234 --> 01:02:03,004\na\nb\n\n2\n00:00:59,996 --> 00:01:00,000\nc\n"
    assert [tuple(r)[1:] for r in subtitles.parse_srt(srt).orderBy("line").collect()] == [(1, 1_234_000, 3_723_004_000, "a b"), (2, 59_996_000, 60_000_000, "c")]
    lrc = spark.createDataFrame([(1, "[00:10.50][01:00.00]twice\nno stamp\n[00:01.00]once")], "song long, file string")
    assert sorted((r.s, r.text) for r in subtitles.parse_lrc(lrc).collect()) == [(1_000_000, "once"), (10_500_000, "twice"), (60_000_000, "twice")]
    try:
        subtitles.render(lines, "doc")
        raise AssertionError
    except ValueError:
        pass


def test_common_lines_are_those_of_the_whole_table():
    def plain(p, q):
        best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
        for i in range(len(p) - 1, -1, -1):
            for j in range(len(q) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if p[i] == q[j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        out = []
        while i < len(p) and j < len(q):
            if p[i] == q[j]:
                out.append((i, j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
        return out

    r = random.Random(1)
    for _ in range(3000):
        p, q = ([r.choice("abcdefgh"[at:][:k]) for _ in range(r.randrange(9))] for at, k in ((0, 3), (r.randrange(3), 4)))
        assert S.common_lines(p, q) == plain(p, q), (p, q)


def test_alignments_stream_songs_over_all_tasks(spark):
    lines = spark.createDataFrame([(s, k, f"line {k}") for s in range(30) for k in range(1, 5)], "song long, line long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        found = S.align_lines(lines, lines)
        assert found.rdd.getNumPartitions() == S.align_resplit(lines, lines).rdd.getNumPartitions() == 4
        assert sorted(map(tuple, found.collect())) == [(s, k, k) for s in range(30) for k in range(1, 5)]
        assert sorted(map(tuple, S.align_resplit(lines, lines).collect())) == [(s, k, 1, k, 1) for s in range(30) for k in range(1, 5)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
