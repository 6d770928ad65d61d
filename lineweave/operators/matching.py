"""Lines of a song matched to words that were heard, and times from those matches.

Lines are (song, line, text), words (song, word, text, s, e) numbered from 0 in order.  A song is one
group: where its next line is looked for depends on the last match.  Null and blank texts match nothing;
of equal scores the earliest and then the shortest range wins; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.operators.intervals import HOUR, by_start, overlaps
from lineweave.operators.repairs import L, T, V, W, _cover, covered, sung
from lineweave.operators.words import days
from lineweave.sources.tables import table, timed_lines

#: Words before the last match and beyond a line's own length that are looked at, and the least score.
BACK, BEYOND, LEAST = 10, 20, 0.3
MATCH = "song long, line long, first long, last long, score double"


def letters(texts: list[str | None], alphabet: dict[str, int]) -> np.ndarray:
    """Counts of each letter in each text."""
    counts = np.zeros((len(texts), len(alphabet)), np.int32)
    for i, t in enumerate(texts):
        for c in "".join((t or "").lower().split()):
            counts[i, alphabet[c]] += 1
    return counts


def best_range(line: np.ndarray, sums: np.ndarray, starts: range, longest: int, least: float) -> tuple[int, int, float] | None:
    """First and last word of the range inside starts most like a line: F1 of the letters in common, times the root of
    the ratio of the lengths.  sums are letter counts of all words before each one."""
    first = np.repeat(np.arange(starts.start, starts.stop), longest)
    end = first + np.tile(np.arange(1, longest + 1), len(starts))
    first, end = first[end <= starts.stop], end[end <= starts.stop]
    own, n = sums[end] - sums[first], int(line.sum())
    size, common = own.sum(axis=1), np.minimum(own, line).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(size > 0, 2.0 * common / (n + size) * np.sqrt(np.minimum(n, size) / np.maximum(n, size)), 0.0)
    if not len(score) or score.max() <= least:
        return None
    k = int(score.argmax())
    return int(first[k]), int(end[k]) - 1, float(score[k])


def match_ranges(lines: DataFrame, words: DataFrame, least: float = LEAST) -> DataFrame:
    """song, line, first, last, score: the range of words that each line is, in order.  Each search begins
    some words before where the last match ended."""
    both = lines.select("song", F.col("line").alias("i"), "text", F.lit(0).alias("side")).unionByName(words.select("song", F.col("word").alias("i"), "text", F.lit(1).alias("side")))

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = (pdf[pdf.side == k].sort_values("i") for k in (0, 1))
        x, y = (t.assign(text=[v if isinstance(v, str) else "" for v in t.text]) for t in (x, y))
        alphabet = {c: k for k, c in enumerate(sorted(set("".join("".join([*x.text, *y.text]).lower().split()))))}
        heard = np.concatenate([np.zeros((1, len(alphabet)), np.int32), letters(list(y.text), alphabet).cumsum(axis=0, dtype=np.int32)])
        at, out = 0, []
        for i, text, line in zip(x.i, x.text, letters(list(x.text), alphabet)):
            n = len(text.split())
            if n and line.sum():
                starts = range(max(0, at - BACK), min(len(y), at + 3 * n + BEYOND))
                hit = best_range(line, heard, starts, 2 * n + 4, least)
                if hit:
                    out.append((pdf.song.iloc[0], i, *hit))
                    at = hit[1] + 1
        return pd.DataFrame(out, columns=["song", "line", "first", "last", "score"])

    return both.groupBy("song").applyInPandas(match, MATCH)


def mixed_times(lines: DataFrame, matched: str, whole: int) -> DataFrame:
    """song, line, s, e: matched lines keep their times, others get an even share of the song by their
    place (from 0).  A line that would start before the one before begins at that one's end."""
    w = Window.partitionBy("song").orderBy("line")
    rows = lines.withColumns({"i": F.row_number().over(w) - 1, "step": F.floor(F.lit(whole) / F.count(F.lit(1)).over(Window.partitionBy("song")))})
    ok = F.expr(matched)
    rows = rows.select("song", "step", F.struct("line", F.when(ok, F.col("s")).otherwise(F.col("i") * F.col("step")).alias("s"), F.when(ok, F.col("e")).otherwise((F.col("i") + 1) * F.col("step")).alias("e")).alias("x"))
    songs = rows.groupBy("song", "step").agg(F.array_sort(F.collect_list("x")).alias("x"))
    late = "x.s < element_at(a, -1).s"
    start = f"if({late}, element_at(a, -1).e, x.s)"
    step = f"array_append(a, named_struct('line', x.line, 's', {start}, 'e', if({late} AND x.e <= {start}, {start} + step, x.e)))"
    fold = F.expr(f"aggregate(slice(x, 2, size(x)), slice(x, 1, 1), (a, x) -> {step})")
    return songs.select("song", F.explode(fold).alias("x")).select("song", "x.line", "x.s", "x.e")


def snap_stranded(lines: DataFrame, voice: DataFrame, apart: int, early: int = 0, step: int = 1) -> DataFrame:
    """song, line, new_s, new_e of lines with voice in less than a quarter of them and none near: to just
    before the next region, in order, step apart within a run of such lines, if that is before the next
    line that is sung.  One that ends before the region keeps its length, but not into that line."""
    c = covered(lines, voice)
    rows = lines.join(c, ["song", "line"], "left").withColumn("quiet", 4 * F.coalesce("voiced", F.lit(0)) < F.col("e") - F.col("s"))
    marks = rows.select("song", "line", "s", "e", "quiet", F.lit(0).alias("side")).unionByName(voice.select("song", "line", "s", "e", F.lit(False).alias("quiet"), F.lit(1).alias("side")))
    ahead = Window.partitionBy("song").orderBy("s", "side", "line").rowsBetween(0, Window.unboundedFollowing)
    marks = marks.withColumn("onset", F.first(F.when(F.col("side") == 1, F.col("s")), ignorenulls=True).over(ahead)).where("side = 0")
    w = by_start()
    marks = marks.withColumns({"stop": F.when(~F.lead("quiet").over(w), F.lead("s").over(w)), "base": F.col("onset") - early})
    marks = marks.withColumn("goes", F.col("quiet") & (F.col("onset") - F.col("s") >= apart) & (F.col("stop").isNull() | (F.col("base") < F.col("stop"))))
    marks = marks.withColumn("run", F.sum(F.when(F.coalesce("goes", F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("goes")
    r = by_start("run")
    k = step * F.row_number().over(r).cast("long")
    marks = marks.withColumn("k", k).withColumn("new_s", F.max(F.col("base") - F.col("k")).over(r.rowsBetween(Window.unboundedPreceding, 0)) + F.col("k"))
    whole = F.least(F.col("new_s") + F.col("e") - F.col("s"), "stop")
    return marks.where("stop IS NULL OR new_s < stop").select("song", "line", "new_s", F.when(F.col("e") <= F.col("onset"), whole).otherwise(F.col("e")).alias("new_e"))


def fold_repeats(lines: DataFrame, voice: DataFrame, long: int, room: int, before: int) -> DataFrame:
    """song, line, new_s, new_e: long lines with voice in less than 30 % that say what the line before
    says go right behind it, as long as it is, if there is room before the next line.  Of several in a
    row each follows the last: chains of them are one group."""
    w = by_start()
    rows = lines.join(covered(lines, voice), ["song", "line"], "left")
    rows = rows.withColumns({"p_text": F.lag("text").over(w), "next": F.lead("s").over(w)})
    again = (F.col("e") - F.col("s") >= long) & (F.trim("text") == F.trim("p_text")) & (10 * F.coalesce("voiced", F.lit(0)) < 3 * (F.col("e") - F.col("s")))
    rows = rows.withColumn("again", F.coalesce(again, F.lit(False)))
    rows = rows.withColumn("chain", F.sum(F.when(F.col("again"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    chains = rows.groupBy("song", "chain").agg(F.array_sort(F.collect_list(F.struct("s", "line", "e", "next", "again"))).alias("x"))
    a, end = "element_at(a, -1)", f"coalesce(x.next, {2**62}) - {before} - element_at(a, -1).e"
    go = f"{a}.e < x.s AND {end} >= {room}"
    step = f"array_append(a, if({go}, named_struct('s', {a}.e, 'line', x.line, 'e', {a}.e + least({a}.e - {a}.s, {end}), 'next', x.next, 'again', x.again), x))"
    fold = F.expr(f"aggregate(slice(x, 2, size(x)), slice(x, 1, 1), (a, x) -> {step})")
    return chains.select("song", F.explode(fold).alias("x")).select("song", "x.line", F.col("x.s").alias("new_s"), F.col("x.e").alias("new_e"))


def spread_piled(words: DataFrame) -> DataFrame:
    """song, line, k, new_s, new_e: words of a line with one start are spread in even steps up to the
    next start, or the last word's end; their ends don't come before their starts."""
    pile = Window.partitionBy("song", "line", "s")
    heads = words.groupBy("song", "line", "s").agg(F.count(F.lit(1)).alias("n"), F.max_by("e", "k").alias("last"))
    heads = heads.withColumn("until", F.coalesce(F.lead("s").over(Window.partitionBy("song", "line").orderBy("s")), "last"))
    rows = words.withColumn("i", F.row_number().over(pile.orderBy("k")) - 1).join(heads, ["song", "line", "s"])
    spread = (F.col("n") > 1) & (F.col("until") > F.col("s"))
    s = F.when(spread, F.col("s") + F.floor((F.col("until") - F.col("s")) * F.col("i") / F.col("n"))).otherwise(F.col("s"))
    return rows.select("song", "line", "k", s.alias("new_s"), F.when(spread, F.greatest("e", s)).otherwise(F.col("e")).alias("new_e"))


def hold_words(words: DataFrame, most: int) -> DataFrame:
    """song, line, k, new_e: a word lasts up to the next one's start or the line's end, but no longer than
    most after its own start, and never ends sooner than it did."""
    nxt = F.coalesce(F.lead("s").over(Window.partitionBy("song", "line").orderBy("k")), "line_e")
    return words.select("song", "line", "k", F.greatest("e", F.least(nxt, F.col("s") + most)).alias("new_e"))


def fold_octaves(notes: DataFrame, reach: int, least: int, off: int) -> DataFrame:
    """song, line, midi, folded: notes that are about the same whole octaves away from the medians of the
    notes before and after go back by as many."""
    w = by_start()
    mid = lambda lo, hi: F.expr("percentile(midi, 0.5)").over(w.rowsBetween(lo, hi))
    rows = notes.withColumns({"before": mid(-reach, -1), "after": mid(1, reach)})

    def shift(m: str) -> Column:
        away = F.col("midi") - F.col(m)
        octaves = F.bround(away / 12)
        return F.when((F.abs(away) >= least) & (octaves != 0) & (F.abs(away - 12 * octaves) <= off), -12 * octaves).otherwise(0)

    agreed = F.when(F.col("before").isNotNull() & F.col("after").isNotNull() & (shift("before") == shift("after")), shift("before")).otherwise(0)
    return rows.select("song", "line", "midi", (F.col("midi") + agreed).cast("long").alias("folded"))


def span_pitch(frames: DataFrame, spans: DataFrame, least: int = 3) -> DataFrame:
    """song, line, midi, n, share: the pitch that most voiced frames of a span have, of equal ones the
    lowest, with its count and its share of all the span's frames.  Not with fewer voiced frames."""
    at = frames.select("song", "line", "s", (F.col("s") + 1).alias("e"))
    o = overlaps(spans, at).select("song", F.col("a").alias("line"), F.col("b").alias("frame"))
    o = o.join(frames.select("song", F.col("line").alias("frame"), "midi", "voiced"), ["song", "frame"])
    by = o.groupBy("song", "line", "midi").agg(F.count_if("voiced").alias("n"), F.count(F.lit(1)).alias("frames"))
    g = by.groupBy("song", "line").agg(F.max_by(F.struct("midi", "n"), F.struct("n", -F.col("midi"))).alias("x"), F.sum("n").alias("all"), F.sum("frames").alias("frames"))
    return g.where(F.col("all") >= least).select("song", "line", "x.midi", "x.n", F.round(F.col("x.n") / F.col("frames"), 9).alias("share"))


def blocks_of_anchors(lines: DataFrame, anchored: str, window: int, whole: int, order: tuple[str, ...] = ("line",)) -> DataFrame:
    """song, first, last, lo, hi: an anchored line and those up to the next one, and the time they may
    take: from window before the anchor to window after the next.  Lines before the first start at 0.
    order are the columns that lines were numbered by, if their order is still that of the rows: then they
    aren't sorted once more."""
    w = Window.partitionBy("song").orderBy(*order)
    ok = F.coalesce(F.expr(anchored), F.lit(False))
    rows = lines.withColumns({"ok": ok, "before": F.lag("line").over(w), "end": F.max("line").over(Window.partitionBy("song")), "head": F.row_number().over(w) == 1})
    # a block begins at each anchor, and at the first line
    heads = rows.where("ok OR head").select("song", *dict.fromkeys([*order, "line"]), "before", "end", "ok", F.when(F.col("ok"), F.col("s")).alias("at"))
    heads = heads.withColumns({"more": F.lead("ok").over(w), "last": F.lead("before").over(w), "nxt": F.lead("at").over(w)}).where("ok OR more")
    kept = lambda t: F.greatest(F.lit(0), F.least(F.lit(whole), t))
    lo, hi = F.when(F.col("at").isNull(), 0).otherwise(kept(F.col("at") - window)), F.when(F.col("nxt").isNull(), whole).otherwise(kept(F.col("nxt") + window))
    return heads.select("song", F.col("line").alias("first"), F.coalesce("last", "end").alias("last"), lo.alias("lo"), hi.alias("hi"))


def sung_parts(spark, d) -> tuple[DataFrame, DataFrame]:
    """Names of parts as lines of a song for each size; their words, without every fifth, as heard."""
    p = table(spark, d, "part").select(F.col("p_size").cast("long").alias("song"), F.col("p_partkey").alias("line"), F.col("p_name").alias("text"))
    each = p.select("song", "line", F.posexplode(F.split("text", " ")).alias("k", "text")).where((F.col("line") + F.col("k")) % 5 != 0)
    n = F.row_number().over(Window.partitionBy("song").orderBy("line", "k")).cast("long") - 1
    return p, each.select("song", n.alias("word"), "text", (n * 500_000).alias("s"), (n * 500_000 + 400_000).alias("e"))


def q_match_ranges(spark, d):
    return match_ranges(*sung_parts(spark, d)).withColumn("score", F.round("score", 9))


#: What lines of orders are numbered by.
VERSE_ORDER = ("l_linenumber", "l_shipdate", "l_partkey", "l_quantity")


def verses(spark, d) -> DataFrame:
    """Lines of orders: ship day as start, quantity in hours as length."""
    t = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "song")
    s = F.timestamp_diff("MICROSECOND", F.lit("1990-01-01 00:00:00").cast("timestamp_ntz"), t.l_shipdate)
    line = F.row_number().over(Window.partitionBy("song").orderBy(*VERSE_ORDER))
    return t.select("song", line.cast("long").alias("line"), s.alias("s"), (s + F.col("l_quantity").cast("long") * HOUR).alias("e"), "l_returnflag", *VERSE_ORDER)


YEARS = 10 * 365 * 24 * HOUR


def calls(spark, d) -> tuple[DataFrame, DataFrame]:
    """Clicks and errors as lines, three hours at least, of two texts; views as voice."""
    lines, voice = sung(spark, d)
    return lines.withColumns({"text": F.when(F.col("text") == "error", "b").otherwise("a"), "e": F.greatest("e", F.col("s") + 3 * HOUR)}), voice


def piled(spark, d) -> DataFrame:
    """Words of a user and day, whose starts are the hours they lie in by fours."""
    width = 4 * HOUR
    return days(timed_lines(spark, d)).withColumn("s", F.floor(F.col("s") / width) * width)


def notes(spark, d) -> DataFrame:
    return timed_lines(spark, d).withColumn("midi", (F.floor("value") % 40 + 40).cast("long"))


S_SQL = "(SELECT l_orderkey AS song, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_quantity) AS line, epoch_us(l_shipdate) - epoch_us(TIMESTAMP '1990-01-01') AS s, epoch_us(l_shipdate) - epoch_us(TIMESTAMP '1990-01-01') + l_quantity::BIGINT * 3600000000 AS e, l_returnflag FROM lineitem)"
H = HOUR
C_SQL = f"(SELECT song, line, CASE WHEN text = 'error' THEN 'b' ELSE 'a' END AS text, s, greatest(e, s + {3 * H}) AS e FROM {L})"
DAY = 24 * H
P_SQL = f"(SELECT song, d AS line, row_number() OVER (PARTITION BY song, d ORDER BY s, line) AS k, s // {4 * H} * {4 * H} AS s, e, (d + 1) * {DAY} AS line_e FROM (SELECT *, s // {DAY} AS d FROM {T}))"
QUERIES = {
    "word_range_matches": (q_match_ranges, None),
    "mixed_times": (
        lambda spark, d: mixed_times(verses(spark, d), "l_returnflag <> 'N'", YEARS),
        f"WITH RECURSIVE r AS (SELECT *, row_number() OVER w - 1 AS i, {YEARS} // count(*) OVER (PARTITION BY song) AS step FROM {S_SQL} WINDOW w AS (PARTITION BY song ORDER BY line)), b AS (SELECT song, line, i, step, CASE WHEN l_returnflag <> 'N' THEN s ELSE i * step END AS s, CASE WHEN l_returnflag <> 'N' THEN e ELSE (i + 1) * step END AS e FROM r), f AS (SELECT * FROM b WHERE i = 0 UNION ALL SELECT b.song, b.line, b.i, b.step, CASE WHEN b.s < f.s THEN f.e ELSE b.s END, CASE WHEN b.s < f.s AND b.e <= f.e THEN f.e + b.step ELSE b.e END FROM f JOIN b ON b.song = f.song AND b.i = f.i + 1) SELECT song, line, s, e FROM f",
    ),
    "stranded_to_onset": (
        lambda spark, d: snap_stranded(*sung(spark, d), 3 * HOUR // 2, 3 * HOUR // 20, HOUR // 20),
        f"WITH v AS {V}, l AS {L}, q AS (SELECT l.*, 4 * coalesce(c.voiced, 0) < e - s AS quiet, (SELECT min(v.s) FROM v WHERE v.song = l.song AND v.s >= l.s) AS onset FROM l LEFT JOIN {_cover('l')} c ON c.song = l.song AND c.line = l.line), n AS (SELECT *, CASE WHEN NOT lead(quiet) OVER ({W}) THEN lead(s) OVER ({W}) END AS stop, onset - {3 * H // 20} AS base FROM q), g AS (SELECT *, coalesce(quiet AND onset - s >= {3 * H // 2} AND (stop IS NULL OR base < stop), false) AS goes FROM n), u AS (SELECT *, sum(CASE WHEN goes THEN 0 ELSE 1 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS run FROM g), k AS (SELECT *, {H // 20} * row_number() OVER (PARTITION BY song, run ORDER BY s, line) AS k FROM u WHERE goes), m AS (SELECT *, max(base - k) OVER (PARTITION BY song, run ORDER BY s, line ROWS UNBOUNDED PRECEDING) + k AS new_s FROM k) SELECT song, line, new_s, CASE WHEN e <= onset THEN least(new_s + e - s, stop) ELSE e END AS new_e FROM m WHERE stop IS NULL OR new_s < stop",
    ),
    "folded_repeats": (
        lambda spark, d: fold_repeats(*calls(spark, d), 6 * HOUR, HOUR, HOUR // 20),
        f"WITH RECURSIVE v AS {V}, l AS {C_SQL}, r AS (SELECT l.*, lead(l.s) OVER w AS nxt, row_number() OVER w AS i, coalesce(e - s >= {6 * H} AND text = lag(text) OVER w AND 10 * coalesce(c.voiced, 0) < 3 * (e - s), false) AS again FROM l LEFT JOIN {_cover('l')} c ON c.song = l.song AND c.line = l.line WINDOW w AS (PARTITION BY l.song ORDER BY l.s, l.line)), f AS (SELECT song, line, i, s, e FROM r WHERE NOT again UNION ALL SELECT r.song, r.line, r.i, CASE WHEN f.e < r.s AND coalesce(r.nxt, {2**62}) - {H // 20} - f.e >= {H} THEN f.e ELSE r.s END, CASE WHEN f.e < r.s AND coalesce(r.nxt, {2**62}) - {H // 20} - f.e >= {H} THEN f.e + least(f.e - f.s, coalesce(r.nxt, {2**62}) - {H // 20} - f.e) ELSE r.e END FROM f JOIN r ON r.song = f.song AND r.i = f.i + 1 AND r.again) SELECT song, line, s AS new_s, e AS new_e FROM f",
    ),
    "piled_words": (
        lambda spark, d: spread_piled(piled(spark, d)),
        f"WITH p AS {P_SQL}, h AS (SELECT song, line, s, count(*) AS n, max_by(e, k) AS last FROM p GROUP BY 1, 2, 3), u AS (SELECT *, coalesce(lead(s) OVER (PARTITION BY song, line ORDER BY s), last) AS until FROM h), x AS (SELECT p.*, n, until, row_number() OVER (PARTITION BY p.song, p.line, p.s ORDER BY p.k) - 1 AS i FROM p JOIN u ON u.song = p.song AND u.line = p.line AND u.s = p.s), y AS (SELECT *, CASE WHEN n > 1 AND until > s THEN s + (until - s) * i // n ELSE s END AS new_s FROM x) SELECT song, line, k, new_s, CASE WHEN n > 1 AND until > s THEN greatest(e, new_s) ELSE e END AS new_e FROM y",
    ),
    "held_words": (
        lambda spark, d: hold_words(piled(spark, d), 6 * HOUR),
        f"SELECT song, line, k, greatest(e, least(coalesce(lead(s) OVER (PARTITION BY song, line ORDER BY k), line_e), s + {6 * H})) AS new_e FROM {P_SQL}",
    ),
    "octave_context": (
        lambda spark, d: fold_octaves(notes(spark, d), 3, 9, 2),
        f"WITH n AS (SELECT *, (floor(value) % 40 + 40)::BIGINT AS midi FROM {T}), m AS (SELECT song, line, midi, median(midi) OVER ({W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS a, median(midi) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS b FROM n), o AS (SELECT *, round_even((midi - a) / 12, 0) AS p, round_even((midi - b) / 12, 0) AS q FROM m), z AS (SELECT *, CASE WHEN abs(midi - a) >= 9 AND p <> 0 AND abs(midi - a - 12 * p) <= 2 THEN -12 * p ELSE 0 END AS x, CASE WHEN abs(midi - b) >= 9 AND q <> 0 AND abs(midi - b - 12 * q) <= 2 THEN -12 * q ELSE 0 END AS y FROM o) SELECT song, line, midi, (midi + CASE WHEN a IS NOT NULL AND b IS NOT NULL AND x = y THEN x ELSE 0 END)::BIGINT AS folded FROM z",
    ),
    "span_pitch": (
        lambda spark, d: span_pitch(notes(spark, d).select("song", "line", "s", (F.col("midi") % 7).alias("midi"), (F.col("value") > 10).alias("voiced")), sung(spark, d)[1]),
        f"WITH v AS {V}, f AS (SELECT song, s, (floor(value) % 40 + 40)::BIGINT % 7 AS midi, value > 10 AS voiced FROM {T}), o AS (SELECT v.song, v.line, midi, count(*) FILTER (voiced) AS n, count(*) AS frames FROM v JOIN f ON f.song = v.song AND f.s >= v.s AND f.s < v.e GROUP BY 1, 2, 3), g AS (SELECT *, sum(n) OVER p AS total, sum(frames) OVER p AS size, row_number() OVER (PARTITION BY song, line ORDER BY n DESC, midi) AS k FROM o WINDOW p AS (PARTITION BY song, line)) SELECT song, line, midi, n, round(n / size::DOUBLE, 9) AS share FROM g WHERE k = 1 AND total >= 3",
    ),
    "anchor_blocks": (
        lambda spark, d: blocks_of_anchors(verses(spark, d), "l_returnflag = 'R'", 24 * HOUR, YEARS, VERSE_ORDER),
        f"WITH b AS (SELECT *, count(*) FILTER (l_returnflag = 'R') OVER (PARTITION BY song ORDER BY line ROWS UNBOUNDED PRECEDING) AS block, count(*) FILTER (l_returnflag = 'R') OVER (PARTITION BY song) AS n FROM {S_SQL}), g AS (SELECT song, block, min(line) AS first, max(line) AS last, max(s) FILTER (l_returnflag = 'R') AS anchor FROM b WHERE n > 0 GROUP BY 1, 2), x AS (SELECT *, lead(anchor) OVER (PARTITION BY song ORDER BY block) AS nxt FROM g) SELECT song, first, last, CASE WHEN anchor IS NULL THEN 0 ELSE greatest(0, least({YEARS}, anchor - {DAY})) END AS lo, CASE WHEN nxt IS NULL THEN {YEARS} ELSE greatest(0, least({YEARS}, nxt + {DAY})) END AS hi FROM x",
    ),
}
