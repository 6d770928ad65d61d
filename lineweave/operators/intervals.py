"""Ordered intervals per song: gaps, overlaps, islands, matches in time.

Intervals are (song, line, s, e), times in microseconds.  Everything is windows and joins on the
song; interval joins first meet in time buckets, so that a song isn't compared with itself as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.sources.tables import TIMED_SQL, timed_lines

SECOND = 1_000_000
HOUR = 3600 * SECOND
#: Shortest gap that counts as silence, and as an interlude.
SHORT_GAP, INTERLUDE = HOUR, 10 * HOUR


def by_start(*keys: str):
    return Window.partitionBy("song", *keys).orderBy("s", "line")


def gaps(lines: DataFrame, short: int = SHORT_GAP, interlude: int = INTERLUDE) -> DataFrame:
    """After each line, the positive gap up to the next one."""
    after = F.lead("s").over(by_start())
    g = lines.select("song", "line", F.col("e").alias("gap_start"), after.alias("gap_end")).withColumn("gap", F.col("gap_end") - F.col("gap_start"))
    return g.where("gap > 0").withColumns({"is_short": F.col("gap") < short, "is_interlude": F.col("gap") >= interlude})


def merge_short_gaps(lines: DataFrame, how: str, short: int = SHORT_GAP) -> DataFrame:
    """Gaps of 0 up to short close: at their middle, or by lengthening the earlier or the later line."""
    w = by_start()
    rows = lines.withColumns({"_next": F.lead("s").over(w), "_prev": F.lag("e").over(w)})

    def middle(a: str, b: str) -> Column:
        return F.floor((F.col(a) + F.col(b)) / 2)

    after, before = F.col("_next") - F.col("e"), F.col("s") - F.col("_prev")
    ends = {"midpoint": middle("e", "_next"), "prev": F.col("_next"), "next": F.col("e")}[how]
    starts = {"midpoint": middle("_prev", "s"), "prev": F.col("s"), "next": F.col("_prev")}[how]
    e = F.when((after >= 0) & (after < short), ends).otherwise(F.col("e"))
    s = F.when((before >= 0) & (before < short), starts).otherwise(F.col("s"))
    return rows.select("song", "line", s.alias("new_s"), e.alias("new_e"))


def resolve_overlaps(lines: DataFrame) -> DataFrame:
    """Overlapping neighbours meet at the middle of the overlap."""
    w = by_start()
    rows = lines.withColumns({"_next": F.lead("s").over(w), "_prev": F.lag("e").over(w)})
    e = F.when(F.col("_next") < F.col("e"), F.floor((F.col("e") + F.col("_next")) / 2)).otherwise(F.col("e"))
    s = F.when(F.col("_prev") > F.col("s"), F.floor((F.col("_prev") + F.col("s")) / 2)).otherwise(F.col("s"))
    return rows.select("song", "line", s.alias("new_s"), e.alias("new_e"))


def cut_before_next(lines: DataFrame, lead: int = 20_000) -> DataFrame:
    """A line that runs into the next ends shortly before it."""
    after = F.lead("s").over(by_start())
    return lines.select("song", "line", F.when(after < F.col("e"), after - lead).otherwise(F.col("e")).alias("new_e"))


def islands(lines: DataFrame, gap: int, *keys: str) -> DataFrame:
    """Lines that follow each other within gap of all before them are one island, numbered per song."""
    w = by_start(*keys)
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("s") - reach > gap), 1).otherwise(0)
    return lines.withColumn("_fresh", fresh).withColumn("island", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def regions(lines: DataFrame, gap: int, shortest: int) -> DataFrame:
    """Islands as regions; shorter ones are dropped."""
    r = islands(lines, gap).groupBy("song", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count(F.lit(1)).alias("n"))
    return r.where(F.col("e") - F.col("s") >= shortest)


def in_buckets(df: DataFrame, width: int, s: str = "s", e: str = "e") -> DataFrame:
    """A row for each time bucket that an interval touches."""
    return df.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.greatest(s, e) / width))))


def overlaps(left: DataFrame, right: DataFrame, width: int = 24 * HOUR) -> DataFrame:
    """Pairs (song, a, b, overlap) of intervals that share time: each pair once, in the first bucket that
    both touch."""
    x = in_buckets(left.select("song", F.col("line").alias("a"), F.col("s").alias("a_s"), F.col("e").alias("a_e")), width, "a_s", "a_e")
    y = in_buckets(right.select("song", F.col("line").alias("b"), F.col("s").alias("b_s"), F.col("e").alias("b_e")), width, "b_s", "b_e")
    both = x.join(y, ["song", "bucket"]).where((F.col("a_s") < F.col("b_e")) & (F.col("b_s") < F.col("a_e")))
    first = both.where(F.col("bucket") == F.floor(F.greatest("a_s", "b_s") / width))
    return first.withColumn("overlap", F.least("a_e", "b_e") - F.greatest("a_s", "b_s"))


def backward_asof(left: DataFrame, right: DataFrame) -> DataFrame:
    """To each left row, the last right line that starts no later: one union and one running value."""
    both = left.select("song", "line", "s", F.lit(1).alias("_side")).unionByName(right.select("song", "line", "s", F.lit(0).alias("_side")))
    w = Window.partitionBy("song").orderBy("s", "_side", "line").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("asof", F.last(F.when(F.col("_side") == 0, F.col("line")), ignorenulls=True).over(w)).where("_side = 1").drop("_side")


def _kind(spark, d, kind):
    return timed_lines(spark, d).where(F.col("text") == kind)


def gap_table(spark, d):
    return gaps(timed_lines(spark, d)).select("song", "line", "gap", "is_short", "is_interlude")


def interludes(spark, d):
    """Gaps of interlude length in which no view is under way."""
    g = gaps(timed_lines(spark, d).where("text <> 'view'")).where("is_interlude").select("song", "line", F.col("gap_start").alias("s"), F.col("gap_end").alias("e"))
    sung = overlaps(g, _kind(spark, d, "view")).where(F.col("overlap") > SECOND).select("song", F.col("a").alias("line")).distinct()
    return g.join(sung, ["song", "line"], "left_anti").select("song", "line", (F.col("e") - F.col("s")).alias("silence"))


def extend_to_next_start(spark, d):
    w = by_start()
    t = timed_lines(spark, d)
    return t.select("song", "line", F.coalesce(F.lead("s").over(w), F.col("e")).alias("new_e"))


def vad_regions(spark, d):
    return regions(timed_lines(spark, d), HOUR, HOUR // 2).select("song", "s", "e", "n")


def post_gap_windows(spark, d):
    """After each interlude, from the next line until the one before the next interlude."""
    w = by_start()
    t = timed_lines(spark, d).withColumn("fresh", F.when(F.col("s") - F.lag("e").over(w) >= INTERLUDE, 1).otherwise(0))
    block = t.withColumn("block", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("block > 0")
    return block.groupBy("song", "block").agg(F.min("s").alias("opens"), F.max("s").alias("last_start"), F.count(F.lit(1)).alias("lines"))


def largest_gap(spark, d):
    g = gaps(timed_lines(spark, d))
    return g.groupBy("song").agg(F.max_by(F.struct("line", "gap"), F.struct("gap", -F.col("line"))).alias("g")).select("song", "g.line", "g.gap")


def coverage_ratio(spark, d):
    """Share of all click time that views cover, by song."""
    c = _kind(spark, d, "click")
    o = overlaps(c, regions(_kind(spark, d, "view"), 0, 1).withColumnRenamed("island", "line")).groupBy("song").agg(F.sum("overlap").alias("o"))
    total = c.groupBy("song").agg(F.sum(F.col("e") - F.col("s")).alias("t")).where("t > 0")
    return total.join(o, "song", "left").select("song", F.round(F.coalesce("o", F.lit(0)) / F.col("t"), 9).alias("coverage"))


def longest_silence(spark, d):
    w = by_start()
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return timed_lines(spark, d).withColumn("hole", F.col("s") - reach).groupBy("song").agg(F.greatest(F.max("hole"), F.lit(0)).alias("longest"))


def timing_issues(spark, d):
    """Clicks during which nothing else of the song goes on."""
    c, rest = _kind(spark, d, "click"), timed_lines(spark, d).where("text <> 'click'")
    return c.join(overlaps(c, rest).select("song", F.col("a").alias("line")).distinct(), ["song", "line"], "left_anti").select("song", "line")


def sung_lines(spark, d):
    c = _kind(spark, d, "click")
    return c.join(overlaps(c, _kind(spark, d, "view")).select("song", F.col("a").alias("line")).distinct(), ["song", "line"], "left_semi").select("song", "line")


def first_region_lookup(spark, d):
    """The first view region that holds a click's start."""
    c = _kind(spark, d, "click").withColumn("e", F.col("s") + 1)
    r = regions(_kind(spark, d, "view"), HOUR, 0).withColumnRenamed("island", "line")
    return overlaps(c, r).groupBy("song", F.col("a").alias("line")).agg(F.min("b").alias("region"))


def best_overlap_match(spark, d):
    """To each click the view with the longest overlap, of equal ones the first."""
    o = overlaps(_kind(spark, d, "click"), _kind(spark, d, "view"))
    best = F.max_by(F.struct("b", "overlap"), F.struct("overlap", -F.col("b_s"), -F.col("b")))
    return o.groupBy("song", F.col("a").alias("line")).agg(best.alias("m")).select("song", "line", F.col("m.b").alias("match"), "m.overlap")


def asof_line(spark, d):
    return backward_asof(_kind(spark, d, "purchase"), _kind(spark, d, "view")).select("song", "line", "asof")


def nearest_same_text(spark, d):
    """The nearest other line of the song with the same text, of equal ones the earlier."""
    w = by_start("text")
    t = timed_lines(spark, d)
    t = t.withColumns({"p": F.lag("line").over(w), "ps": F.lag("s").over(w), "n": F.lead("line").over(w), "ns": F.lead("s").over(w)})
    near = F.when(F.col("n").isNull() | (F.col("s") - F.col("ps") <= F.col("ns") - F.col("s")), F.col("p")).otherwise(F.col("n"))
    return t.select("song", "line", near.alias("nearest"))


def leak_runs(spark, d):
    """Runs of lines of over 30 units that hold one of over 60."""
    w = by_start()
    t = timed_lines(spark, d).withColumn("long", F.col("value") > 30)
    t = t.withColumn("turn", F.when(F.col("long") & ~F.coalesce(F.lag("long").over(w), F.lit(False)), 1).otherwise(0))
    runs = t.withColumn("run", F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("long")
    return runs.groupBy("song", "run").agg(F.count(F.lit(1)).alias("lines"), F.min("s").alias("s"), F.max("value").alias("top")).where("top > 60").select("song", "run", "lines", "s")


def tail_extension(spark, d):
    """A line's end moves into the gap after it, by two hours at most, one if it's short of a click."""
    after = F.lead("s").over(by_start())
    cap = F.when(F.col("text") == "click", 2 * HOUR).otherwise(HOUR)
    room = F.greatest(F.coalesce(after - F.col("e"), F.lit(0)), F.lit(0))
    return timed_lines(spark, d).select("song", "line", (F.col("e") + F.least(room, cap)).alias("new_e"))


def stretch_clamp(spark, d):
    """Clicks of over eight hours of which views cover less than half end with their last view, or after
    eight hours."""
    c = _kind(spark, d, "click").where(F.col("e") - F.col("s") > 8 * HOUR)
    body = overlaps(c, regions(_kind(spark, d, "view"), 0, 1).withColumnRenamed("island", "line")).groupBy("song", F.col("a").alias("line")).agg(F.sum("overlap").alias("o"), F.max(F.least("a_e", "b_e")).alias("last"))
    j = c.join(body, ["song", "line"], "left")
    low = F.coalesce("o", F.lit(0)) * 2 < F.col("e") - F.col("s")
    return j.select("song", "line", F.when(low, F.coalesce("last", F.col("s") + 8 * HOUR)).otherwise(F.col("e")).alias("new_e"))


def adlib_complement(spark, d):
    """Parts of view regions that no click covers: holes between the merged clicks."""
    v = regions(_kind(spark, d, "view"), 0, 1).select("song", F.col("island").alias("line"), "s", "e")
    c = regions(_kind(spark, d, "click"), 0, 1).select("song", F.col("island").alias("line"), "s", "e")
    cut = overlaps(v, c).select("song", F.col("a").alias("line"), F.greatest("a_s", "b_s").alias("s"), F.least("a_e", "b_e").alias("e"))
    edges = cut.unionByName(v.select("song", "line", F.col("s"), F.col("s").alias("e"))).unionByName(v.select("song", "line", F.col("e").alias("s"), "e"))
    w = Window.partitionBy("song", "line").orderBy("s", "e")
    free = edges.select("song", "line", F.lag("e").over(w).alias("hole_s"), F.col("s").alias("hole_e"))
    return free.where("hole_e > hole_s")


def lru_prune(spark, d):
    """Oldest lines go until the rest of a song have a summed value of 300 at most."""
    w = Window.partitionBy("song").orderBy(F.desc("s"), F.desc("line")).rowsBetween(Window.unboundedPreceding, 0)
    cents = F.round(F.col("value") * 100).cast("long")
    return timed_lines(spark, d).withColumn("kept", F.sum(cents).over(w)).where("kept > 30000").select("song", "line")


def interpolate_unmatched(spark, d):
    """Errors have no time of their own: they are spread evenly between the lines around them."""
    w = by_start()
    t = timed_lines(spark, d).withColumn("known", F.col("text") != "error")
    until, since = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    t = t.withColumns({"p_e": F.last(F.when(F.col("known"), F.col("e")), ignorenulls=True).over(until), "n_s": F.first(F.when(F.col("known"), F.col("s")), ignorenulls=True).over(since), "part": F.sum(F.when(F.col("known"), 1).otherwise(0)).over(until)})
    g = Window.partitionBy("song", "part")
    bad = t.where("NOT known AND p_e IS NOT NULL AND n_s IS NOT NULL")
    bad = bad.withColumns({"i": F.row_number().over(g.orderBy("s", "line")), "n": F.count(F.lit(1)).over(g)})
    return bad.select("song", "line", (F.col("p_e") + F.floor((F.col("n_s") - F.col("p_e")) * (F.col("i") - 1) / F.col("n"))).alias("new_s"), (F.col("p_e") + F.floor((F.col("n_s") - F.col("p_e")) * F.col("i") / F.col("n"))).alias("new_e"))


def uniform_fallback(spark, d):
    """Lines of a song spread evenly from its first start to its last end."""
    w = Window.partitionBy("song")
    t = timed_lines(spark, d).withColumns({"a": F.min("s").over(w), "b": F.max("e").over(w), "n": F.count(F.lit(1)).over(w), "i": F.row_number().over(by_start())})
    return t.select("song", "line", (F.col("a") + F.floor((F.col("b") - F.col("a")) * (F.col("i") - 1) / F.col("n"))).alias("new_s"))


def repeated_rescale(spark, d):
    """Words of a line moved linearly into a span of half its length from its start."""
    t = timed_lines(spark, d).where("e > s")
    words = t.withColumn("k", F.explode(F.sequence(F.lit(0), F.length("text") - 1)))
    return words.select("song", "line", "k", (F.col("s") + F.floor((F.col("e") - F.col("s")) * F.col("k") / (2 * F.length("text")))).alias("at"))


def monotonic_starts(spark, d):
    """Ends that never go back: the largest end so far."""
    w = by_start().rowsBetween(Window.unboundedPreceding, 0)
    return timed_lines(spark, d).select("song", "line", F.max("e").over(w).alias("new_e"))


T = TIMED_SQL
W = "PARTITION BY song ORDER BY s, line"
NEXT = f"lead(s) OVER ({W})"
PREV = f"lag(e) OVER ({W})"


def _of(kind: str) -> str:
    return f"(SELECT * FROM {T} WHERE text = '{kind}')"


def _regions(kind: str | None, gap: int, shortest: int) -> str:
    src = _of(kind) if kind else T
    return f"(SELECT song, island, min(s) AS s, max(e) AS e, count(*) AS n FROM (SELECT *, sum(f) OVER ({W} ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN s - max(e) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {gap} THEN 0 ELSE 1 END AS f FROM {src})) GROUP BY song, island HAVING max(e) - min(s) >= {shortest})"


def _merge(how: str) -> str:
    e = {"midpoint": "(e + n) // 2", "prev": "n", "next": "e"}[how]
    s = {"midpoint": "(p + s) // 2", "prev": "s", "next": "p"}[how]
    return f"SELECT song, line, CASE WHEN s - p >= 0 AND s - p < {SHORT_GAP} THEN {s} ELSE s END AS new_s, CASE WHEN n - e >= 0 AND n - e < {SHORT_GAP} THEN {e} ELSE e END AS new_e FROM (SELECT *, {NEXT} AS n, {PREV} AS p FROM {T})"


QUERIES = {
    "gap_table": (gap_table, f"SELECT song, line, n - e AS gap, n - e < {SHORT_GAP} AS is_short, n - e >= {INTERLUDE} AS is_interlude FROM (SELECT *, {NEXT} AS n FROM {T}) WHERE n > e"),
    "interludes": (interludes, f"WITH g AS (SELECT song, line, e AS a, n AS b FROM (SELECT *, {NEXT} AS n FROM {T} WHERE text <> 'view') WHERE n - e >= {INTERLUDE}) SELECT song, line, b - a AS silence FROM g WHERE NOT EXISTS (SELECT 1 FROM {_of('view')} v WHERE v.song = g.song AND v.s < g.b AND g.a < v.e AND least(v.e, g.b) - greatest(v.s, g.a) > {SECOND})"),
    "merge_short_gaps_midpoint": (lambda spark, d: merge_short_gaps(timed_lines(spark, d), "midpoint"), _merge("midpoint")),
    "merge_short_gaps_prev": (lambda spark, d: merge_short_gaps(timed_lines(spark, d), "prev"), _merge("prev")),
    "merge_short_gaps_next": (lambda spark, d: merge_short_gaps(timed_lines(spark, d), "next"), _merge("next")),
    "resolve_overlaps": (lambda spark, d: resolve_overlaps(timed_lines(spark, d)), f"SELECT song, line, CASE WHEN p > s THEN (p + s) // 2 ELSE s END AS new_s, CASE WHEN n < e THEN (e + n) // 2 ELSE e END AS new_e FROM (SELECT *, {NEXT} AS n, {PREV} AS p FROM {T})"),
    "fix_overlaps_lead": (lambda spark, d: cut_before_next(timed_lines(spark, d)), f"SELECT song, line, CASE WHEN n < e THEN n - 20000 ELSE e END AS new_e FROM (SELECT *, {NEXT} AS n FROM {T})"),
    "extend_to_next_start": (extend_to_next_start, f"SELECT song, line, coalesce({NEXT}, e) AS new_e FROM {T}"),
    "vad_regions": (vad_regions, f"SELECT song, s, e, n FROM {_regions(None, HOUR, HOUR // 2)}"),
    "post_gap_windows": (post_gap_windows, f"SELECT song, block, min(s) AS opens, max(s) AS last_start, count(*) AS lines FROM (SELECT *, sum(f) OVER ({W} ROWS UNBOUNDED PRECEDING) AS block FROM (SELECT *, CASE WHEN s - {PREV} >= {INTERLUDE} THEN 1 ELSE 0 END AS f FROM {T})) WHERE block > 0 GROUP BY 1, 2"),
    "largest_gap": (largest_gap, f"SELECT song, line, n - e AS gap FROM (SELECT *, {NEXT} AS n FROM {T}) WHERE n > e QUALIFY row_number() OVER (PARTITION BY song ORDER BY n - e DESC, line) = 1"),
    "coverage_ratio": (coverage_ratio, f"WITH c AS {_of('click')}, v AS {_regions('view', 0, 1)}, o AS (SELECT c.song, sum(least(c.e, v.e) - greatest(c.s, v.s)) AS o FROM c JOIN v ON c.song = v.song AND c.s < v.e AND v.s < c.e GROUP BY 1) SELECT c.song, round(coalesce(any_value(o.o), 0)::DOUBLE / sum(e - s)::DOUBLE, 9) AS coverage FROM c LEFT JOIN o ON o.song = c.song GROUP BY c.song HAVING sum(e - s) > 0"),
    "longest_silence": (longest_silence, f"SELECT song, greatest(coalesce(max(h), 0), 0) AS longest FROM (SELECT song, s - max(e) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM {T}) GROUP BY 1"),
    "timing_issues": (timing_issues, f"SELECT song, line FROM {_of('click')} c WHERE NOT EXISTS (SELECT 1 FROM {T} o WHERE o.text <> 'click' AND o.song = c.song AND c.s < o.e AND o.s < c.e)"),
    "sung_lines": (sung_lines, f"SELECT song, line FROM {_of('click')} c WHERE EXISTS (SELECT 1 FROM {_of('view')} o WHERE o.song = c.song AND c.s < o.e AND o.s < c.e)"),
    "first_region_lookup": (first_region_lookup, f"SELECT c.song, c.line, min(r.island) AS region FROM {_of('click')} c JOIN {_regions('view', HOUR, 0)} r ON r.song = c.song AND r.s <= c.s AND c.s < r.e GROUP BY 1, 2"),
    "best_overlap_match": (best_overlap_match, f"SELECT c.song, c.line, v.line AS match, least(c.e, v.e) - greatest(c.s, v.s) AS overlap FROM {_of('click')} c JOIN {_of('view')} v ON c.song = v.song AND c.s < v.e AND v.s < c.e QUALIFY row_number() OVER (PARTITION BY c.song, c.line ORDER BY overlap DESC, v.s, v.line) = 1"),
    "asof_line": (asof_line, f"SELECT p.song, p.line, (SELECT arg_max(v.line, (v.s, v.line)) FROM {_of('view')} v WHERE v.song = p.song AND v.s <= p.s) AS asof FROM {_of('purchase')} p"),
    "nearest_same_text": (nearest_same_text, f"SELECT song, line, CASE WHEN n IS NULL OR s - ps <= ns - s THEN p ELSE n END AS nearest FROM (SELECT *, lag(line) OVER w AS p, lag(s) OVER w AS ps, lead(line) OVER w AS n, lead(s) OVER w AS ns FROM {T} WINDOW w AS (PARTITION BY song, text ORDER BY s, line))"),
    "leak_runs": (leak_runs, f"WITH t AS (SELECT *, value > 30 AS long FROM {T}), u AS (SELECT *, CASE WHEN long AND NOT coalesce(lag(long) OVER ({W}), false) THEN 1 ELSE 0 END AS f FROM t), r AS (SELECT *, sum(f) OVER ({W} ROWS UNBOUNDED PRECEDING) AS run FROM u) SELECT song, run, count(*) AS lines, min(s) AS s FROM r WHERE long GROUP BY 1, 2 HAVING max(value) > 60"),
    "tail_extension": (tail_extension, f"SELECT song, line, e + least(greatest(coalesce(n - e, 0), 0), CASE WHEN text = 'click' THEN {2 * HOUR} ELSE {HOUR} END) AS new_e FROM (SELECT *, {NEXT} AS n FROM {T})"),
    "stretch_clamp": (stretch_clamp, f"WITH c AS (SELECT * FROM {_of('click')} WHERE e - s > {8 * HOUR}), o AS (SELECT c.song, c.line, sum(least(c.e, v.e) - greatest(c.s, v.s)) AS o, max(least(c.e, v.e)) AS last FROM c JOIN {_regions('view', 0, 1)} v ON c.song = v.song AND c.s < v.e AND v.s < c.e GROUP BY 1, 2) SELECT c.song, c.line, CASE WHEN coalesce(o, 0) * 2 < e - s THEN coalesce(last, s + {8 * HOUR}) ELSE e END AS new_e FROM c LEFT JOIN o ON o.song = c.song AND o.line = c.line"),
    "adlib_complement": (adlib_complement, f"WITH v AS {_regions('view', 0, 1)}, c AS {_regions('click', 0, 1)}, x AS (SELECT v.song, v.island AS line, greatest(v.s, c.s) AS s, least(v.e, c.e) AS e FROM v JOIN c ON v.song = c.song AND v.s < c.e AND c.s < v.e UNION ALL SELECT song, island, s, s FROM v UNION ALL SELECT song, island, e, e FROM v) SELECT song, line, hole_s, s AS hole_e FROM (SELECT *, lag(e) OVER (PARTITION BY song, line ORDER BY s, e) AS hole_s FROM x) WHERE s > hole_s"),
    "lru_prune": (lru_prune, f"SELECT song, line FROM (SELECT *, sum(round(value * 100)::BIGINT) OVER (PARTITION BY song ORDER BY s DESC, line DESC ROWS UNBOUNDED PRECEDING) AS k FROM {T}) WHERE k > 30000"),
    "interpolate_unmatched": (interpolate_unmatched, f"WITH t AS (SELECT *, last_value(CASE WHEN text <> 'error' THEN e END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS p, first_value(CASE WHEN text <> 'error' THEN s END IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n, sum(CASE WHEN text <> 'error' THEN 1 ELSE 0 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS part FROM {T}), b AS (SELECT *, row_number() OVER (PARTITION BY song, part ORDER BY s, line) AS i, count(*) OVER (PARTITION BY song, part) AS c FROM t WHERE text = 'error' AND p IS NOT NULL AND n IS NOT NULL) SELECT song, line, p + floor(((n - p) * (i - 1))::DOUBLE / c)::BIGINT AS new_s, p + floor(((n - p) * i)::DOUBLE / c)::BIGINT AS new_e FROM b"),
    "uniform_fallback": (uniform_fallback, f"SELECT song, line, a + floor(((b - a) * (i - 1))::DOUBLE / n)::BIGINT AS new_s FROM (SELECT *, min(s) OVER (PARTITION BY song) AS a, max(e) OVER (PARTITION BY song) AS b, count(*) OVER (PARTITION BY song) AS n, row_number() OVER ({W}) AS i FROM {T})"),
    "repeated_rescale": (repeated_rescale, f"SELECT song, line, k, s + floor(((e - s) * k)::DOUBLE / (2 * length(text)))::BIGINT AS at FROM (SELECT *, unnest(range(length(text)))::INT AS k FROM {T} WHERE e > s)"),
    "monotonic_ends": (monotonic_starts, f"SELECT song, line, max(e) OVER ({W} ROWS UNBOUNDED PRECEDING) AS new_e FROM {T}"),
}
