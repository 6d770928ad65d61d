"""Operators whose next step depends on the last result: folds, alignments, greedy matching.

Each works on one bounded group at a time (the lines of a song, the turns of a conversation) with a
short loop; grouping and everything around it is Spark's.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineweave.functions.text import match_key
from lineweave.operators.layers import ITEMS, line_keys
from lineweave.sources.tables import TIMED_SQL, by_song, lyric_lines, table, timed_lines


def enforce_monotonic(lines: DataFrame, shortest: int) -> DataFrame:
    """Starts that never come before the line before has lasted ``shortest``: as each step adds that much,
    a running maximum of the starts less as many steps.  A null start takes the earliest allowed."""
    w = Window.partitionBy("song").orderBy("line")
    steps = shortest * F.row_number().over(w).cast("long")
    rows = lines.select("song", "line", "s", steps.alias("steps"))
    return rows.select("song", "line", (F.max(F.col("s") - F.col("steps")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("steps")).alias("new_s"))


def greedy_one_to_one(left: DataFrame, right: DataFrame, tolerance: int) -> DataFrame:
    """In order of the left starts, each takes the nearest right line within tolerance that is still
    free; of equal ones the earlier."""
    both = left.select("song", "line", "s", F.lit(0).alias("side")).unionByName(right.select("song", "line", "s", F.lit(1).alias("side")))

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["s", "line"])
        free = list(pdf[pdf.side == 1][["s", "line"]].itertuples(index=False))
        starts = pd.Series([x.s for x in free], dtype="int64")
        used, out = set(), []
        for x in pdf[pdf.side == 0].itertuples(index=False):
            lo, hi = starts.searchsorted(x.s - tolerance), starts.searchsorted(x.s + tolerance, side="right")
            near = [(abs(free[j].s - x.s), j) for j in range(lo, hi) if j not in used]
            if near:
                _, j = min(near)
                used.add(j)
                out.append((x.song, x.line, free[j].line, free[j].s - x.s))
        return pd.DataFrame(out, columns=["song", "line", "match", "apart"])

    return both.groupBy("song").applyInPandas(match, "song long, line long, match long, apart long")


def common_lines(p: list[str], q: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence; of equal ones the first list goes on first.  Places of the
    first whose key the second doesn't have are passed over before the table is made: they never hold up a way."""
    code = {k: n for n, k in enumerate(dict.fromkeys(q))}
    kept = [i for i, k in enumerate(p) if k in code]
    x, y = [code[p[i]] for i in kept], np.array([code[k] for k in q], np.int32)
    best = np.zeros((len(x) + 1, len(q) + 1), np.int32)
    for i in range(len(x) - 1, -1, -1):
        ways = np.where(y == x[i], best[i + 1, 1:] + 1, best[i + 1, :-1])
        best[i, :-1] = np.maximum.accumulate(ways[::-1])[::-1]
    i = j = 0
    out = []
    while i < len(x) and j < len(q):
        if x[i] == y[j]:
            out.append((kept[i], j))
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def align_lines(a: DataFrame, b: DataFrame) -> DataFrame:
    """Longest common subsequence of two line lists of a key, by line keys: (song, a, b) pairs.  A null
    text equals none."""
    both = a.select("song", "line", match_key(F.col("text")).alias("k"), F.lit(0).alias("side")).unionByName(b.select("song", "line", match_key(F.col("text")).alias("k"), F.lit(1).alias("side")))

    def lcs(rows: list[tuple]) -> list[tuple]:
        x, y = ([r for r in rows if r[3] == side] for side in (0, 1))
        return [(x[i][1], y[j][1]) for i, j in common_lines([r[2] for r in x], [r[2] for r in y])]

    return by_song(both.where("k IS NOT NULL"), ["side", "line"], lcs, pa.schema({"song": pa.int64(), "a": pa.int64(), "b": pa.int64()}))


#: Lines that can stand for one line of the other list, and how far ahead an equal line is looked for.
MERGED, AHEAD = 6, 12


def walk(a: list[tuple], b: list[tuple]) -> list[tuple[int, int, int, int]]:
    """Stretches (i, p, j, q) of two lists of (strict, loose) line keys: p lines of a from i say what q
    lines of b from j do, one of the two being a single line.  Where neither list goes on with an equal
    stretch, both skip to the nearest equal lines; with none near, the rest stays alone."""
    shapes = [(1, 1), *((p, 1) for p in range(2, MERGED + 1)), *((1, q) for q in range(2, MERGED + 1))]

    def same(x: list[tuple], y: list[tuple]) -> bool:
        if "".join([k for k, _ in x]) == "".join([k for k, _ in y]):
            return True
        return all(k is not None for _, k in (*x, *y)) and "".join([k for _, k in x]) == "".join([k for _, k in y])

    # Letters up to each line, so that only stretches as long as each other are put together.
    long = [[[0, *accumulate(len(k[n] or "") for k in keys)] for n in (0, 1)] for keys in (a, b)]
    even = lambda n, p, q: long[0][n][i + p] - long[0][n][i] == long[1][n][j + q] - long[1][n][j]
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        hit = next(((p, q) for p, q in shapes if i + p <= len(a) and j + q <= len(b) and (even(0, p, q) or even(1, p, q)) and same(a[i : i + p], b[j : j + q])), None)
        if hit is None:
            near = [(x + y, x, y) for x, (s, u) in enumerate(a[i : i + AHEAD]) for y, (t, v) in enumerate(b[j : j + AHEAD]) if s == t or u is not None and u == v]
            if not near:
                break
            _, x, y = min(near)
            i, j = i + x, j + y
        else:
            out.append((i, hit[0], j, hit[1]))
            i, j = i + hit[0], j + hit[1]
    return out


def align_resplit(a: DataFrame, b: DataFrame) -> DataFrame:
    """song, line, lines, other, others: stretches of two versions of a song whose lines are split
    differently, as of ``walk``; line and other are their first lines.  Each song is one group."""
    both = line_keys(a).withColumn("side", F.lit(0)).unionByName(line_keys(b).withColumn("side", F.lit(1)))

    def align(rows: list[tuple]) -> list[tuple]:
        x, y = ([r for r in rows if r[4] == side] for side in (0, 1))
        return [(x[i][1], p, y[j][1], q) for i, p, j, q in walk(*([r[2:4] for r in t] for t in (x, y)))]

    out = pa.schema({"song": pa.int64(), "line": pa.int64(), "lines": pa.int32(), "other": pa.int64(), "others": pa.int32()})
    return by_song(both.select("song", "line", "strict", "loose", "side"), ["side", "line"], align, out)


def carry_layer(lines: DataFrame, layer: DataFrame, least: float = 0.5) -> DataFrame:
    """song, line, translation: the layer's translations on lines of another split; of several layer lines
    they are joined, and of several lines the first takes it.  Only for songs where least of the lines
    get one.  layer: song, line, text, translation."""
    found = align_resplit(lines, layer)
    of = layer.select("song", F.col("line").alias("at"), F.coalesce("translation", F.lit("")).alias("translation"))
    each = found.withColumn("at", F.explode(F.sequence(F.col("other"), F.col("other") + F.col("others") - 1))).join(of, ["song", "at"])
    text = each.groupBy("song", "line").agg(F.array_join(F.array_sort(F.collect_list(F.struct("at", "translation")))["translation"], "").alias("translation"))
    size = lines.groupBy("song").agg(F.count(F.lit(1)).alias("n"))
    enough = text.groupBy("song").agg(F.count(F.lit(1)).alias("m")).join(size, "song").where(F.col("m") >= least * F.col("n")).select("song")
    return text.join(enough, "song", "left_semi")


def split_long_lines(lines: DataFrame, budget: int) -> DataFrame:
    """Words of a line dealt greedily to pieces of at most budget characters; a longer word is a piece of
    its own, and a null or blank line has none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for x in pdf.itertuples(index=False):
                piece, n = "", 0
                for w in (x.text or "").split():
                    if piece and len(piece) + 1 + len(w) > budget:
                        out.append((x.song, x.line, n, piece))
                        piece, n = w, n + 1
                    else:
                        piece = f"{piece} {w}" if piece else w
                if piece:
                    out.append((x.song, x.line, n, piece))
            yield pd.DataFrame(out, columns=["song", "line", "piece", "text"])

    return lines.select("song", "line", "text").mapInPandas(run, "song long, line long, piece long, text string")


def monotonic(spark, d):
    return enforce_monotonic(timed_lines(spark, d), 60_000_000)


def greedy_note_score(spark, d):
    t = timed_lines(spark, d)
    return greedy_one_to_one(t.where("text = 'click'"), t.where("text = 'view'"), 3600_000_000)


def dp_align(spark, d):
    """Lines of each document against those of the next one: those that both have, in order."""
    a = lyric_lines(table(spark, d, "documents"))
    b = a.withColumn("song", F.col("song") - 1)
    return align_lines(a, b)


def resplit(spark, d) -> tuple[DataFrame, DataFrame]:
    """The lines of each document, and the same in halves (even documents) or joined by two (odd ones)."""
    lines = lyric_lines(table(spark, d, "documents"))
    words = F.split("text", r"\s+")
    half = F.ceil(F.size(words) / 2).cast("int")
    halves = lines.where("song % 2 = 0").select("song", "line", F.posexplode(F.filter(F.array(F.array_join(F.slice(words, F.lit(1), half), " "), F.array_join(F.slice(words, half + 1, F.size(words)), " ")), lambda t: t != "")).alias("k", "text"))
    pairs = lines.where("song % 2 <> 0").groupBy("song", F.floor((F.col("line") + 1) / 2).alias("line")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("line", "text")))["text"], " ").alias("text"))
    w = Window.partitionBy("song").orderBy("line", "k")
    halves = halves.select("song", F.row_number().over(w).cast("long").alias("line"), "text")
    return lines, halves.unionByName(pairs.select("song", "line", "text"))


def resplit_alignment(spark, d):
    return align_resplit(*resplit(spark, d))


def long_line_split(spark, d):
    return split_long_lines(lyric_lines(table(spark, d, "benchmark"), "item_id"), 40)


T = TIMED_SQL
QUERIES = {
    # the fold s' = max(s, last + d) is max over earlier lines of s + d * (steps since)
    "monotonic": (monotonic, f"SELECT song, line, max(s - 60000000 * i) OVER (PARTITION BY song ORDER BY line ROWS UNBOUNDED PRECEDING) + 60000000 * i AS new_s FROM (SELECT *, row_number() OVER (PARTITION BY song ORDER BY line) AS i FROM {T})"),
    "greedy_note_score": (
        greedy_note_score,
        f"WITH RECURSIVE c AS (SELECT song, line, s, row_number() OVER (PARTITION BY song ORDER BY s, line) AS i FROM {T} WHERE text = 'click'), v AS (SELECT song, list({{'s': s, 'line': line}} ORDER BY s, line) AS v FROM {T} WHERE text = 'view' GROUP BY 1), n AS (SELECT c.*, list_filter(v, lambda x: abs(x.s - c.s) <= 3600000000) AS near FROM c JOIN v ON v.song = c.song), r AS (SELECT DISTINCT song, 0::BIGINT AS i, NULL::BIGINT AS line, NULL::BIGINT AS s, []::BIGINT[] AS used, NULL::STRUCT(d BIGINT, s BIGINT, line BIGINT) AS best FROM n UNION ALL SELECT song, i, line, s, CASE WHEN best.line IS NULL THEN used ELSE list_append(used, best.line) END, best FROM (SELECT n.song, n.i, n.line, n.s, r.used, list_sort(list_transform(list_filter(near, lambda x: NOT list_contains(r.used, x.line)), lambda x: {{'d': abs(x.s - n.s), 's': x.s, 'line': x.line}}))[1] AS best FROM r JOIN n ON n.song = r.song AND n.i = r.i + 1)) SELECT song, line, best.line AS match, best.s - s AS apart FROM r WHERE best.line IS NOT NULL",
    ),
    "dp_align": (dp_align, None),
    "long_line_split": (
        long_line_split,
        f"WITH RECURSIVE l AS (SELECT song, line, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM {ITEMS}), r AS (SELECT song, line, w, 1 AS k, 0::BIGINT AS piece, w[1] AS t FROM l WHERE len(w) > 0 UNION ALL SELECT song, line, w, k + 1, CASE WHEN over THEN piece + 1 ELSE piece END, CASE WHEN over THEN w[k + 1] ELSE t || ' ' || w[k + 1] END FROM (SELECT *, length(t) + 1 + length(w[k + 1]) > 40 AS over FROM r WHERE k < len(w))) SELECT song, line, piece, arg_max(t, k) AS text FROM r GROUP BY 1, 2, 3",
    ),
    "resplit_alignment": (resplit_alignment, None),
}
