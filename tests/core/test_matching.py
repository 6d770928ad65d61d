"""Matches of lines to heard words, and repairs, on hand-made rows."""

import random
from collections import Counter

from pyspark.sql import functions as F

from lineweave.operators import matching as M

WORDS = "song long, word long, text string, s long, e long"
LINES = "song long, line long, text string"
TIMED = "song long, line long, text string, s long, e long"


def plain_matches(lines, words):
    """Every range in the search window, by definition."""
    at, out = 0, []
    for i, text in lines:
        n = len((text or "").split())
        a = "".join((text or "").lower().split())
        best = (0.3, None)
        stop = min(len(words), at + 3 * n + 20)
        for first in range(max(0, at - 10), stop):
            for last in range(first, min(stop, first + 2 * n + 4)):
                b = "".join("".join(w or "" for w in words[first : last + 1]).lower().split())
                if a and b:
                    common = sum((Counter(a) & Counter(b)).values())
                    score = 2.0 * common / (len(a) + len(b)) * (min(len(a), len(b)) / max(len(a), len(b))) ** 0.5
                    if score > best[0] + 1e-12:
                        best = (score, (i, first, last))
        if best[1]:
            out.append((*best[1], round(best[0], 9)))
            at = best[1][2] + 1
    return out


def test_match_ranges(spark):
    rng = random.Random(5)
    vocabulary = ["moon", "river", "sing", "a", "light", "nightfall", "oh", "ramen", None]
    lines, words = [], []
    for song in range(4):
        said = [[rng.choice(vocabulary[:-1]) for _ in range(rng.randint(1, 6))] for _ in range(12)]
        lines += [(song, i, " ".join(x)) for i, x in enumerate(said)] + [(song, 90, None), (song, 91, "  "), (song, 92, "oh oh")]
        heard = [w for x in said for w in x if rng.random() < 0.8] + [None]
        words += [(song, k, w, k, k + 1) for k, w in enumerate(heard)]
    lines.append((9, 0, "no words here"))
    lines.append((8, 0, "moonlit"))
    words += [(8, k, "zzz", k, k + 1) for k in range(22)] + [(8, 22, "moon", 22, 23), (8, 23, "lit", 23, 24)]
    got = M.match_ranges(spark.createDataFrame(lines, LINES), spark.createDataFrame(words, WORDS)).collect()
    for song in (0, 1, 2, 3, 8, 9):
        want = plain_matches(sorted((i, t) for s, i, t in lines if s == song), [w for s, _, w, _, _ in words if s == song])
        assert sorted((r.line, r.first, r.last, round(r.score, 9)) for r in got if r.song == song) == want
    assert len(got) > 30 and [(r.first, r.last) for r in got if r.song == 8] == [(21, 22)]
    assert M.match_ranges(spark.createDataFrame([], LINES), spark.createDataFrame([], WORDS)).collect() == []


def test_folded_repeats_follow_each_other(spark):
    rows = [(1, 1, "la la", 0, 10), (1, 2, "la la ", 40, 60), (1, 3, " la la", 70, 90), (1, 4, "end", 100, 101), (1, 5, None, 200, 300), (1, 6, None, 400, 500)]
    voice = spark.createDataFrame([(1, 1, "", 0, 12), (1, 2, "", 100, 101)], TIMED)
    got = M.fold_repeats(spark.createDataFrame(rows, TIMED), voice, 15, 5, 1)
    assert [(r.line, r.new_s, r.new_e) for r in got.orderBy("line").collect()] == [(1, 0, 10), (2, 10, 20), (3, 20, 30), (4, 100, 101), (5, 200, 300), (6, 400, 500)]


def test_stranded_lines_keep_order(spark):
    rows = [(1, 1, "a", 20, 25), (1, 2, "b", 27, 30), (1, 3, "c", 101, 110), (1, 4, "d", 150, 160), (1, 5, "e", None, None)]
    voice = spark.createDataFrame([(1, 1, "", 100, 120)], TIMED)
    got = M.snap_stranded(spark.createDataFrame(rows, TIMED), voice, 15, 3, 1)
    assert [(r.line, r.new_s, r.new_e) for r in got.orderBy("line").collect()] == [(1, 97, 102), (2, 98, 101)]


def test_piles_and_mixed_times(spark):
    rows = [(1, 1, 1, 0, 2), (1, 1, 2, 0, 2), (1, 1, 3, 0, 2), (1, 1, 4, 9, 12), (1, 2, 1, 5, 5), (1, 2, 2, 5, 5)]
    got = M.spread_piled(spark.createDataFrame(rows, "song long, line long, k long, s long, e long")).orderBy("line", "k").collect()
    assert [(r.new_s, r.new_e) for r in got] == [(0, 2), (3, 3), (6, 6), (9, 12), (5, 5), (5, 5)]
    lines = spark.createDataFrame([(1, 1, "a", 10, 20), (1, 2, "b", 0, 0), (1, 3, None, 5, 6), (1, 4, "d", 90, 95)], TIMED)
    got = M.mixed_times(lines, "text <> 'b'", 100).orderBy("line").collect()
    assert [(r.s, r.e) for r in got] == [(10, 20), (25, 50), (50, 75), (90, 95)]


def test_octaves_fold_only_where_both_sides_agree(spark):
    midi = [60, 61, 72, 60, 62, 77, 60, 60]
    df = spark.createDataFrame([(1, i, i, m) for i, m in enumerate(midi)], "song long, line long, s long, midi long")
    got = [r.folded for r in M.fold_octaves(df, 3, 9, 2).orderBy("line").collect()]
    assert got == [60, 61, 60, 60, 62, 77, 60, 60]
    assert M.fold_octaves(df.where(F.lit(False)), 3, 9, 2).collect() == []


def plain_blocks(lines, window, whole):
    """The rule read off: a block begins at each anchor, lines before the first one are a block of their own."""
    out = []
    for song in {x[0] for x in lines}:
        own = sorted(x[1:] for x in lines if x[0] == song)
        if any(ok for _, _, ok in own):
            blocks = []
            for line, s, ok in own:
                if ok or not blocks:
                    blocks.append([line, line, s if ok else None])
                blocks[-1][1] = line
            for (first, last, at), after in zip(blocks, [*blocks[1:], (0, 0, None)]):
                kept = lambda t: max(0, min(whole, t))
                out.append((song, first, last, 0 if at is None else kept(at - window), whole if after[2] is None else kept(after[2] + window)))
    return sorted(out)


def test_anchor_blocks_by_definition(spark):
    rng = random.Random(3)
    lines = [(song, line, None if rng.random() < 0.1 else 10 * line + rng.randrange(30), rng.choice([True, False, False, None])) for song in range(60) for line in sorted(rng.sample(range(40), rng.randrange(1, 9)))]
    df = spark.createDataFrame(lines, "song long, line long, s long, hit boolean")
    want = plain_blocks(lines, 7, 200)
    assert sorted(tuple(r) for r in M.blocks_of_anchors(df, "hit", 7, 200).collect()) == want
    assert len(want) > 60 and len({x[0] for x in want}) < 60
    assert M.blocks_of_anchors(df.limit(0), "hit", 7, 200).collect() == []


def test_anchor_blocks_sort_lines_once(spark, capsys):
    """A task holds one sorted copy of its lines, not one for each step."""
    M.QUERIES["anchor_blocks"][0](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert plan.count("Sort [") == 1 and plan.count("Exchange hashpartitioning") == 1
