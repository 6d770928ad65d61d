"""Timing repairs against voiced regions, and verdicts on how well a song's lines sit on them.

Lines and regions are as in ``intervals``; regions are islands of voiced lines that touch.  All is windows
by song, and joins that meet in time buckets.  Lines with a null start or end overlap nothing and are left
as they are; of lines with equal starts the smaller number is first; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineweave.operators.intervals import HOUR, by_start, overlaps, regions, resolve_overlaps
from lineweave.sources.tables import TIMED_SQL, timed_lines


def sung(spark, d) -> tuple[DataFrame, DataFrame]:
    """The lines to repair, and the voiced regions of each song."""
    t = timed_lines(spark, d)
    voice = regions(t.where("text = 'view'"), 0, 1).select("song", F.col("island").alias("line"), "s", "e")
    return t.where("text <> 'view'"), voice


def covered(spans: DataFrame, voice: DataFrame) -> DataFrame:
    """song, line, voiced: how long regions cover the spans, where they do."""
    return overlaps(spans, voice).groupBy("song", F.col("a").alias("line")).agg(F.sum("overlap").alias("voiced"))


def fill_voiced_gaps(lines: DataFrame, voice: DataFrame, least: int, most: int) -> DataFrame:
    """Neighbours meet at the middle of a gap of over least and under most in which there is voice."""
    w = by_start()
    rows = lines.withColumn("next", F.lead("s").over(w))
    gap = rows.where((F.col("next") - F.col("e") > least) & (F.col("next") - F.col("e") < most)).select("song", "line", F.col("e").alias("s"), F.col("next").alias("e"))
    rows = rows.join(covered(gap, voice), ["song", "line"], "left").withColumn("middle", F.when(F.col("voiced") > 0, F.floor((F.col("e") + F.col("next")) / 2)))
    return rows.select("song", "line", F.coalesce(F.lag("middle").over(w), "s").alias("new_s"), F.coalesce("middle", "e").alias("new_e"))


def shrink_silent(lines: DataFrame, voice: DataFrame, long: int, pad: int) -> DataFrame:
    """A line of over long that is silent for more than half of it shrinks to its last region and pad on
    both sides; if too little is left, to the region and what rings after it."""
    hit = overlaps(lines, voice).groupBy("song", F.col("a").alias("line")).agg(F.sum("overlap").alias("voiced"), F.max(F.struct("b_s", "b_e")).alias("last"))
    rows = lines.join(hit, ["song", "line"], "left")
    s, e = F.greatest(F.col("s"), F.col("last.b_s") - pad), F.least(F.col("e"), F.col("last.b_e") + pad)
    s, e = F.when(e - s < 3 * pad, F.col("last.b_s")).otherwise(s), F.when(e - s < 3 * pad, F.col("last.b_e") + 2 * pad).otherwise(e)
    silent = (F.col("e") - F.col("s") > long) & (2 * F.col("voiced") < F.col("e") - F.col("s"))
    return rows.select("song", "line", F.when(silent, s).otherwise(F.col("s")).alias("new_s"), F.when(silent, e).otherwise(F.col("e")).alias("new_e"))


def on_onset(lines: DataFrame, voice: DataFrame, tolerance: int) -> DataFrame:
    """song, line of the lines that start within tolerance of a region's start."""
    near = lines.select("song", "line", (F.col("s") - tolerance).alias("s"), (F.col("s") + tolerance + 1).alias("e"))
    starts = voice.select("song", "line", "s", (F.col("s") + 1).alias("e"))
    return overlaps(near, starts).select("song", F.col("a").alias("line")).distinct()


def pull_to_block(lines: DataFrame, voice: DataFrame, gap: int, chain: int) -> DataFrame:
    """song, line, new_s of lines after a gap that start late: back to where the regions that lead up to
    the line begin, unless it starts on an onset, hardly moves, or would triple its length."""
    late = lines.withColumn("before", F.lag("e").over(by_start())).where(F.col("s") - F.col("before") >= gap)
    late = late.join(on_onset(late, voice, HOUR // 2), ["song", "line"], "left_anti")
    w = by_start()
    blocks = voice.withColumn("fresh", F.when(F.col("s") - F.lag("e").over(w) <= chain, 0).otherwise(1)).withColumn("block", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = late.select("song", "line", F.col("before").alias("s"), "e")
    near = overlaps(spans, voice).select("song", F.col("a").alias("line"), F.col("b").alias("region"), "b_s", "b_e").join(blocks.select("song", F.col("line").alias("region"), "block"), ["song", "region"])
    near = near.join(late.select("song", "line", "s", "e"), ["song", "line"])
    own = near.where("b_e > s").groupBy("song", "line").agg(F.min_by("block", "b_s").alias("block"))
    found = near.join(own, ["song", "line", "block"]).groupBy("song", "line", "s", "e").agg(F.min("b_s").alias("anchor"))
    found = found.withColumn("new_s", F.col("anchor") - 3 * HOUR // 20)
    return found.where((F.col("anchor") <= F.col("s") - 3 * HOUR // 2) & (F.col("e") - F.col("new_s") <= 3 * (F.col("e") - F.col("s")))).select("song", "line", "new_s")


def stranded(lines: DataFrame, voice: DataFrame, gap: int, unsung: int) -> DataFrame:
    """song, sites: lines after a gap with much voice in it, whose own first hour has next to none."""
    rows = lines.withColumn("before", F.lag("e").over(by_start())).where(F.col("s") - F.col("before") >= gap)
    head = covered(rows.select("song", "line", "s", F.least(F.col("e"), F.col("s") + HOUR).alias("e")), voice).withColumnRenamed("voiced", "head")
    inside = covered(rows.select("song", "line", F.col("before").alias("s"), F.col("s").alias("e")), voice)
    rows = rows.join(inside, ["song", "line"]).join(head, ["song", "line"], "left")
    size = F.least(F.col("e"), F.col("s") + HOUR) - F.col("s")
    return rows.where((F.col("voiced") >= unsung) & (5 * F.coalesce("head", F.lit(0)) < F.greatest(size, F.lit(1)))).groupBy("song").agg(F.count(F.lit(1)).alias("sites"))


def body_region(lines: DataFrame, voice: DataFrame) -> DataFrame:
    """The region that holds the most letters of a line by their middles, of equal ones the earliest;
    where none does, the song's first region."""
    n = F.length("text")
    at = (F.col("s") + F.floor((F.col("e") - F.col("s")) * (2 * F.col("k") + 1) / (2 * n))).cast("long")
    letters = lines.withColumn("k", F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))))).select("song", "line", at.alias("s"), (at + 1).alias("e"))
    mass = overlaps(letters, voice.withColumn("e", F.col("e") + 1)).groupBy("song", F.col("a").alias("line"), "b").agg(F.count(F.lit(1)).alias("mass"))
    best = mass.groupBy("song", "line").agg(F.max_by("b", F.struct("mass", -F.col("b"))).alias("region"))
    first = voice.groupBy("song").agg(F.min("line").alias("first"))
    return lines.join(first, "song").join(best, ["song", "line"], "left").select("song", "line", F.coalesce("region", "first").alias("region"))


def problem_gaps(lines: DataFrame, matched: str, shortest: int, most: int = 3) -> DataFrame:
    """song, problem: whether most or more lines without a match stand at an end of the song, or between
    two matches too near for lines of the shortest duration."""
    w = by_start()
    rows = lines.withColumn("i", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("song")))
    ok = rows.where(matched).withColumns({"missing": F.lead("i").over(w) - F.col("i") - 1, "room": F.lead("s").over(w) - F.col("e")})
    bad = ok.groupBy("song").agg(
        ((F.min("i") > most) | (F.max("n") - F.max("i") >= most) | F.coalesce(F.bool_or((F.col("missing") >= most) & (F.col("room") < shortest * F.col("missing"))), F.lit(False))).alias("bad")
    )
    return lines.select("song").distinct().join(bad, "song", "left").select("song", F.coalesce("bad", F.lit(True)).alias("problem"))


def match_stats(lines: DataFrame, matched: str) -> DataFrame:
    """song, total, matched, rate, confidence (mean value of matched lines), usable (a rate of 0.2)."""
    ok = F.expr(matched)
    g = lines.groupBy("song").agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("matched"), F.coalesce(F.avg(F.when(ok, F.col("value"))), F.lit(0.0)).alias("confidence"))
    return g.select("song", "total", "matched", F.round(F.col("matched") / F.col("total"), 9).alias("rate"), F.round("confidence", 6).alias("confidence"), (5 * F.col("matched") >= F.col("total")).alias("usable"))


def confidence_stats(lines: DataFrame, words: DataFrame) -> DataFrame:
    """song, total, matched (lines with words), rate, confidence of words (song, line, confidence): the mean, and
    the share of words that are sure; of scores that is over 0, of logarithms of probabilities, which have a
    negative mean, over -5.  Words without a confidence count for the line alone."""
    own = words.groupBy("song").agg(F.count_distinct("line").alias("matched"), F.avg("confidence").alias("mean"))
    level = F.when(F.col("mean") < 0, -5.0).otherwise(0.0)
    sure = words.join(own.select("song", "mean"), "song").groupBy("song").agg(F.count_if(F.col("confidence") > level).alias("sure"), F.count("confidence").alias("n"))
    g = lines.groupBy("song").agg(F.count(F.lit(1)).alias("total")).join(own, "song", "left").join(sure, "song", "left")
    some = F.coalesce(F.col("n") > 0, F.lit(False))
    return g.select("song", "total", F.when(some, F.col("matched")).otherwise(0).alias("matched"), F.when(some, F.round(F.col("sure") / F.nullif("n", F.lit(0)), 9)).otherwise(0.0).alias("rate"), F.when(some, F.round("mean", 6)).otherwise(0.0).alias("confidence"))


def drift_gate(lines: DataFrame, anchors: DataFrame, most: int) -> DataFrame:
    """song, drift, off: the upper middle one of the distances from lines to overlapping anchors, and
    whether it is so large that the anchors should take over."""
    d = overlaps(lines, anchors).groupBy("song").agg(F.array_sort(F.collect_list(F.abs(F.col("a_s") - F.col("b_s")))).alias("d"))
    return d.select("song", F.get("d", F.floor(F.size("d") / 2).cast("int")).alias("drift")).withColumn("off", F.col("drift") >= most)


def short_gaps_after_overlaps(lines: DataFrame, short: int) -> DataFrame:
    """Overlaps meet at their middle first; then positive gaps under short do."""
    w = by_start()
    rows = resolve_overlaps(lines).select("song", "line", F.col("new_s").alias("s"), F.col("new_e").alias("e"))
    rows = rows.withColumns({"next": F.lead("s").over(w), "prev": F.lag("e").over(w)})
    after, before = F.col("next") - F.col("e"), F.col("s") - F.col("prev")
    e = F.when((after > 0) & (after < short), F.floor((F.col("e") + F.col("next")) / 2)).otherwise(F.col("e"))
    s = F.when((before > 0) & (before < short), F.floor((F.col("prev") + F.col("s")) / 2)).otherwise(F.col("s"))
    return rows.select("song", "line", s.alias("new_s"), e.alias("new_e"))


def gated_match(lines: DataFrame, anchors: DataFrame, least: int, share: float) -> DataFrame:
    """song, line, match: the anchor that a line overlaps longest, by least and by this share of the shorter
    of the two at least; of equal ones the first."""
    o = overlaps(lines, anchors)
    short = F.least(F.col("a_e") - F.col("a_s"), F.col("b_e") - F.col("b_s"))
    o = o.where((F.col("overlap") >= least) & (F.col("overlap") >= share * short))
    return o.groupBy("song", F.col("a").alias("line")).agg(F.max_by("b", F.struct("overlap", -F.col("b_s"), -F.col("b"))).alias("match"))


def reaped(jobs: DataFrame, signs: DataFrame, ttl: int) -> DataFrame:
    """song, line of jobs without a sign of life within ttl, by the song's last time."""
    both = jobs.select("song", "line", "s", F.lit(0).alias("side")).unionByName(signs.select("song", "line", "s", F.lit(1).alias("side")))
    w = Window.partitionBy("song").orderBy("s", "side", "line")
    sign = F.first(F.when(F.col("side") == 1, F.col("s")), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = both.withColumns({"sign": sign, "now": F.max("s").over(Window.partitionBy("song"))})
    return rows.where((F.col("side") == 0) & (F.col("now") - F.col("s") > ttl) & (F.col("sign").isNull() | (F.col("sign") - F.col("s") > ttl))).select("song", "line")


def remembered(asks: DataFrame, told: DataFrame, ttl: int) -> DataFrame:
    """song, line, known: the last line told before each ask, if that is no longer ago than ttl."""
    both = asks.select("song", "line", "s", F.lit(1).alias("side")).unionByName(told.select("song", "line", "s", F.lit(0).alias("side")))
    w = Window.partitionBy("song").orderBy("s", "side", "line").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("last", F.last(F.when(F.col("side") == 0, F.struct("s", "line")), ignorenulls=True).over(w))
    return rows.where("side = 1").select("song", "line", F.when(F.col("s") - F.col("last.s") <= ttl, F.col("last.line")).alias("known"))


def _of(kind: str):
    return lambda spark, d: timed_lines(spark, d).where(F.col("text") == kind)


T = TIMED_SQL
W = "PARTITION BY song ORDER BY s, line"
L = f"(SELECT * FROM {T} WHERE text <> 'view')"
V = f"(SELECT song, island AS line, min(s) AS s, max(e) AS e FROM (SELECT *, sum(f) OVER ({W} ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN s - max(e) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 0 THEN 0 ELSE 1 END AS f FROM {T} WHERE text = 'view')) GROUP BY 1, 2 HAVING max(e) - min(s) >= 1)"
H = HOUR


def _cover(spans: str) -> str:
    return f"(SELECT x.song, x.line, sum(least(x.e, v.e) - greatest(x.s, v.s)) AS voiced, max_by(v.s, v.s) AS last_s, max_by(v.e, v.s) AS last_e FROM {spans} x JOIN v ON v.song = x.song AND v.s < x.e AND x.s < v.e GROUP BY 1, 2)"


QUERIES = {
    "voiced_gap_fill": (
        lambda spark, d: fill_voiced_gaps(*sung(spark, d), HOUR // 20, 10 * HOUR),
        f"WITH v AS {V}, l AS (SELECT *, lead(s) OVER ({W}) AS n FROM {L}), g AS (SELECT song, line, e AS s, n AS e FROM l WHERE n - e > {H // 20} AND n - e < {10 * H}), m AS (SELECT l.*, CASE WHEN c.voiced > 0 THEN (l.e + l.n) // 2 END AS m FROM l LEFT JOIN {_cover('g')} c ON c.song = l.song AND c.line = l.line) SELECT song, line, coalesce(lag(m) OVER ({W}), s) AS new_s, coalesce(m, e) AS new_e FROM m",
    ),
    "silence_shrink": (
        lambda spark, d: shrink_silent(*sung(spark, d), 2 * HOUR, HOUR // 10),
        f"WITH v AS {V}, l AS {L}, c AS (SELECT l.*, c.voiced, last_s, last_e, greatest(l.s, last_s - {H // 10}) AS a, least(l.e, last_e + {H // 10}) AS b FROM l LEFT JOIN {_cover('l')} c ON c.song = l.song AND c.line = l.line) SELECT song, line, CASE WHEN e - s > {2 * H} AND 2 * voiced < e - s THEN CASE WHEN b - a < {3 * (H // 10)} THEN last_s ELSE a END ELSE s END AS new_s, CASE WHEN e - s > {2 * H} AND 2 * voiced < e - s THEN CASE WHEN b - a < {3 * (H // 10)} THEN last_e + {2 * (H // 10)} ELSE b END ELSE e END AS new_e FROM c",
    ),
    "onset_on_region": (lambda spark, d: on_onset(*sung(spark, d), HOUR // 2), f"WITH v AS {V} SELECT song, line FROM {L} l WHERE EXISTS (SELECT 1 FROM v WHERE v.song = l.song AND abs(v.s - l.s) <= {H // 2})"),
    "pull_to_block": (
        lambda spark, d: pull_to_block(*sung(spark, d), 8 * HOUR, 2 * HOUR),
        f"WITH v0 AS {V}, v AS (SELECT *, sum(f) OVER ({W} ROWS UNBOUNDED PRECEDING) AS block FROM (SELECT *, CASE WHEN s - lag(e) OVER ({W}) <= {2 * H} THEN 0 ELSE 1 END AS f FROM v0)), l AS (SELECT * FROM (SELECT *, lag(e) OVER ({W}) AS p FROM {L}) x WHERE s - p >= {8 * H} AND NOT EXISTS (SELECT 1 FROM v WHERE v.song = x.song AND abs(v.s - x.s) <= {H // 2})), n AS (SELECT l.song, l.line, l.s, l.e, v.s AS b_s, v.e AS b_e, block FROM l JOIN v ON v.song = l.song AND v.e > p AND v.s < l.e AND l.p < l.e), o AS (SELECT song, line, min_by(block, b_s) AS block FROM n WHERE b_e > s GROUP BY 1, 2), f AS (SELECT n.song, n.line, s, e, min(b_s) AS anchor FROM n JOIN o ON o.song = n.song AND o.line = n.line AND o.block = n.block GROUP BY 1, 2, 3, 4) SELECT song, line, anchor - {3 * H // 20} AS new_s FROM f WHERE anchor <= s - {3 * H // 2} AND e - (anchor - {3 * H // 20}) <= 3 * (e - s)",
    ),
    "stranded_sites": (
        lambda spark, d: stranded(*sung(spark, d), 3 * HOUR, 3 * HOUR // 2),
        f"WITH v AS {V}, l AS (SELECT * FROM (SELECT *, lag(e) OVER ({W}) AS p FROM {L}) WHERE s - p >= {3 * H}), h AS (SELECT song, line, s, least(e, s + {H}) AS e FROM l), g AS (SELECT song, line, p AS s, s AS e FROM l) SELECT l.song, count(*) AS sites FROM l JOIN {_cover('g')} i ON i.song = l.song AND i.line = l.line LEFT JOIN {_cover('h')} c ON c.song = l.song AND c.line = l.line WHERE i.voiced >= {3 * H // 2} AND 5 * coalesce(c.voiced, 0) < greatest(least(e, s + {H}) - s, 1) GROUP BY 1",
    ),
    "body_region": (
        lambda spark, d: body_region(*sung(spark, d)),
        f"WITH v AS {V}, l AS {L}, p AS (SELECT song, line, s + floor(((e - s) * (2 * k + 1))::DOUBLE / (2 * length(text)))::BIGINT AS at FROM (SELECT *, unnest(range(length(text))) AS k FROM l)), m AS (SELECT p.song, p.line, v.line AS b, count(*) AS n FROM p JOIN v ON v.song = p.song AND v.s <= p.at AND p.at <= v.e GROUP BY 1, 2, 3), b AS (SELECT song, line, b FROM m QUALIFY row_number() OVER (PARTITION BY song, line ORDER BY n DESC, b) = 1) SELECT l.song, l.line, coalesce(b.b, f.f) AS region FROM l JOIN (SELECT song, min(line) AS f FROM v GROUP BY 1) f ON f.song = l.song LEFT JOIN b ON b.song = l.song AND b.line = l.line",
    ),
    "problem_gaps": (
        lambda spark, d: problem_gaps(timed_lines(spark, d), "text IN ('view', 'purchase')", HOUR),
        f"WITH r AS (SELECT *, row_number() OVER ({W}) AS i, count(*) OVER (PARTITION BY song) AS n FROM {T}), o AS (SELECT *, lead(i) OVER ({W}) - i - 1 AS missing, lead(s) OVER ({W}) - e AS room FROM r WHERE text IN ('view', 'purchase')), b AS (SELECT song, min(i) > 3 OR max(n) - max(i) >= 3 OR coalesce(bool_or(missing >= 3 AND room < {H} * missing), false) AS bad FROM o GROUP BY 1) SELECT t.song, coalesce(bad, true) AS problem FROM (SELECT DISTINCT song FROM {T}) t LEFT JOIN b ON b.song = t.song",
    ),
    "match_stats": (
        lambda spark, d: match_stats(timed_lines(spark, d), "text = 'view'"),
        f"SELECT song, count(*) AS total, count(*) FILTER (text = 'view') AS matched, round(count(*) FILTER (text = 'view') / count(*)::DOUBLE, 9) AS rate, round(coalesce(avg(value) FILTER (text = 'view'), 0), 6) AS confidence, 5 * count(*) FILTER (text = 'view') >= count(*) AS usable FROM {T} GROUP BY 1",
    ),
    "best_overlap_gated": (
        lambda spark, d: gated_match(_of("click")(spark, d), _of("view")(spark, d), HOUR // 2, 0.3),
        f"SELECT c.song, c.line, v.line AS match FROM (SELECT * FROM {T} WHERE text = 'click') c JOIN (SELECT * FROM {T} WHERE text = 'view') v ON v.song = c.song AND v.s < c.e AND c.s < v.e WHERE least(c.e, v.e) - greatest(c.s, v.s) >= greatest({H // 2}, 0.3 * least(c.e - c.s, v.e - v.s)) QUALIFY row_number() OVER (PARTITION BY c.song, c.line ORDER BY least(c.e, v.e) - greatest(c.s, v.s) DESC, v.s, v.line) = 1",
    ),
    "confidence_stats": (
        lambda spark, d: confidence_stats(timed_lines(spark, d), timed_lines(spark, d).where("text <> 'view'").withColumn("confidence", F.when(F.col("line") % 9 > 0, F.when(F.col("song") % 2 == 0, F.floor("value") - 20.0).otherwise(-F.floor("value") / 4)))),
        f"WITH w AS (SELECT *, CASE WHEN line % 9 > 0 THEN CASE WHEN song % 2 = 0 THEN floor(value) - 20 ELSE -floor(value) / 4 END END AS c FROM {T} WHERE text <> 'view'), m AS (SELECT song, count(DISTINCT line) AS matched, avg(c) AS mean, count(c) AS n FROM w GROUP BY 1), s AS (SELECT w.song, count(*) FILTER (c > CASE WHEN mean < 0 THEN -5 ELSE 0 END) AS sure FROM w JOIN m ON m.song = w.song GROUP BY 1) SELECT t.song, count(*) AS total, CASE WHEN any_value(n) > 0 THEN any_value(matched) ELSE 0 END AS matched, CASE WHEN any_value(n) > 0 THEN round(any_value(sure) / any_value(n)::DOUBLE, 9) ELSE 0 END AS rate, CASE WHEN any_value(n) > 0 THEN round(any_value(mean), 6) ELSE 0 END AS confidence FROM {T} t LEFT JOIN m ON m.song = t.song LEFT JOIN s ON s.song = t.song GROUP BY 1",
    ),
    "drift_gate": (
        lambda spark, d: drift_gate(_of("click")(spark, d), _of("view")(spark, d), 3 * HOUR),
        f"SELECT song, d[len(d) // 2 + 1] AS drift, d[len(d) // 2 + 1] >= {3 * H} AS off FROM (SELECT c.song, list_sort(list(abs(c.s - v.s))) AS d FROM (SELECT * FROM {T} WHERE text = 'click') c JOIN (SELECT * FROM {T} WHERE text = 'view') v ON v.song = c.song AND v.s < c.e AND c.s < v.e GROUP BY 1)",
    ),
    "short_gaps_after_overlaps": (
        lambda spark, d: short_gaps_after_overlaps(timed_lines(spark, d), HOUR),
        f"WITH r AS (SELECT song, line, CASE WHEN p > s THEN (p + s) // 2 ELSE s END AS s, CASE WHEN n < e THEN (e + n) // 2 ELSE e END AS e FROM (SELECT *, lead(s) OVER ({W}) AS n, lag(e) OVER ({W}) AS p FROM {T})) SELECT song, line, CASE WHEN s - p > 0 AND s - p < {H} THEN (p + s) // 2 ELSE s END AS new_s, CASE WHEN n - e > 0 AND n - e < {H} THEN (e + n) // 2 ELSE e END AS new_e FROM (SELECT *, lead(s) OVER ({W}) AS n, lag(e) OVER ({W}) AS p FROM r)",
    ),
    "orphans_reaped": (
        lambda spark, d: reaped(_of("click")(spark, d), _of("view")(spark, d), 50 * HOUR),
        f"SELECT song, line FROM (SELECT *, (SELECT max(s) FROM {T} m WHERE m.song = c.song AND m.text IN ('click', 'view')) AS now, (SELECT min(s) FROM {T} v WHERE v.song = c.song AND v.text = 'view' AND v.s >= c.s) AS sign FROM (SELECT * FROM {T} WHERE text = 'click') c) WHERE now - s > {50 * H} AND (sign IS NULL OR sign - s > {50 * H})",
    ),
    "remembered_hash": (
        lambda spark, d: remembered(_of("click")(spark, d), _of("view")(spark, d), 24 * HOUR),
        f"SELECT song, line, CASE WHEN s - last.s <= {24 * H} THEN last.line END AS known FROM (SELECT *, (SELECT max({{'s': v.s, 'line': v.line}}) FROM {T} v WHERE v.song = c.song AND v.text = 'view' AND v.s <= c.s) AS last FROM (SELECT * FROM {T} WHERE text = 'click') c)",
    ),
}
