"""Line times as they are shown: with the voice and time to read, and repeats brought back to an even step.

Lines and voice are as in ``repairs``.  A null start or end stays as it is; of lines with equal starts the
smaller number is first, of regions the earlier; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.operators.intervals import HOUR, by_start, regions
from lineweave.operators.matching import piled
from lineweave.operators.repairs import L, V, W, short_gaps_after_overlaps, sung
from lineweave.operators.words import once
from lineweave.sources.tables import TIMED_SQL, timed_lines


def next_region(asks: DataFrame, voice: DataFrame, after: bool = False) -> DataFrame:
    """The asks (song, t, ...) with ``region`` (s, e): the first that ends at t or later, or only later."""
    rest = [c for c in asks.columns if c not in ("song", "t")]
    a = asks.select("song", "t", F.lit(1 if after else 0).alias("side"), F.struct(*rest).alias("row"))
    v = voice.where("e >= s").select("song", F.col("e").alias("t"), F.lit(0 if after else 1).alias("side"), F.struct("s", "e").alias("own"))
    w = Window.partitionBy("song").orderBy("t", "side", F.col("own.s")).rowsBetween(0, Window.unboundedFollowing)
    both = a.unionByName(v, allowMissingColumns=True).withColumn("region", F.first("own", ignorenulls=True).over(w))
    return both.where("row IS NOT NULL").select("song", "t", "row.*", F.when(F.col("t").isNotNull(), F.col("region")).alias("region"))


def readable(lines: DataFrame, voice: DataFrame, most: int, before: int, buffer: int, shortest: int, short: int) -> DataFrame:
    """song, line, new_s, new_e.  A line goes on with the voice that it ends in, by most at most, and starts with
    the first voice in it, if none goes on when it starts and shortest is left; after an end with no voice for
    buffer it stays that long, for reading; both only up to before the next line.  It lasts shortest at least.
    Then overlaps, and gaps under short, meet at their middle."""
    odd = lines.where("s IS NULL OR e IS NULL").select("song", "line", F.col("s").alias("new_s"), F.col("e").alias("new_e"))
    rows = lines.where("s IS NOT NULL AND e IS NOT NULL").select("song", "line", "s", "e", F.lead("s").over(by_start()).alias("next"))
    ends = next_region(rows.withColumn("t", F.col("e")), voice).withColumnRenamed("region", "at_end")
    both = next_region(ends.withColumn("t", F.col("s")), voice).withColumnRenamed("region", "at_start")
    stop = F.col("next") - before
    sung_on = F.when((F.col("at_end.s") <= F.col("e")) & (F.col("at_end.e") > F.col("e")), F.least(F.col("at_end.e"), stop, F.col("e") + most))
    late = F.when((F.col("at_start.s") > F.col("s")) & (F.col("at_start.s") < F.col("e")), F.col("at_start.s"))
    both = both.withColumn("x", F.coalesce(sung_on, "e")).withColumn("a", F.when(late < F.col("x") - shortest, late).otherwise(F.col("s")))
    rest = next_region(both.drop("t").withColumn("t", F.col("x")), voice, True)
    silent = F.coalesce(F.col("region.s") >= F.col("x") + buffer, F.lit(True))
    held = F.when(silent, F.greatest("x", F.least(F.col("x") + buffer, stop))).otherwise(F.col("x"))
    shown = rest.withColumn("z", held).select("song", "line", F.col("a").alias("s"), F.greatest("z", F.col("a") + shortest).alias("e"))
    return short_gaps_after_overlaps(shown, short).unionByName(odd)


def evened(steps: Column, factor: float, least: int, excess: int) -> Column:
    """Steps of which again and again the longest (of equal ones the first) becomes their median, as long as it
    is over factor medians and longer by over excess, and the median over least."""

    def median(x: Column) -> Column:
        n = F.size(x)
        return once(F.array_sort(x), lambda y: (F.get(y, F.floor((n - 1) / 2).cast("int")) + F.get(y, F.floor(n / 2).cast("int"))) / 2)

    def turn(acc: Column) -> Column:
        def go(v: Column) -> Column:
            far = (v.m > least) & (v.worst > factor * v.m) & (v.worst - v.m > excess)
            at = F.array_position(v.x, v.worst)
            return F.when(far, F.transform(v.x, lambda y, i: F.when(i + 1 == at, v.m).otherwise(y))).otherwise(v.x)

        return once(F.struct(acc.alias("x"), median(acc).alias("m"), F.array_max(acc).alias("worst")), go)

    return F.aggregate(F.sequence(F.lit(0), F.size(steps)), steps.cast("array<double>"), lambda acc, _: turn(acc))


def even_repeats(lines: DataFrame, run: int = 3, factor: float = 1.5, least: int = 50_000, excess: int = 100_000) -> DataFrame:
    """song, line, new_s, new_e of lines in runs of at least run lines with one text: where one was passed over,
    those behind are pulled back until the steps between starts are even enough, and keep their length.  A run
    is one row."""
    w = by_start()
    text = F.trim(F.coalesce("text", F.lit("")))
    t = lines.where("s IS NOT NULL").select("song", "line", "s", "e", text.alias("text"))
    t = t.withColumn("turn", F.when((F.col("text") != "") & (F.lag("text").over(w) == F.col("text")), 0).otherwise(1))
    t = t.withColumn("run", F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("step", (F.col("s") - F.lag("s").over(by_start("run"))).cast("double"))
    runs = t.groupBy("song", "run").agg(F.array_sort(F.collect_list(F.struct("s", "line", "e", "step"))).alias("x")).where(F.size("x") >= run)
    runs = runs.withColumn("steps", evened(F.slice(F.col("x.step"), F.lit(2), F.size("x") - 1), factor, least, excess))
    at = lambda x, i: F.struct(x.line.alias("line"), x.s.alias("s"), x.e.alias("e"), F.floor(F.aggregate(F.slice("steps", F.lit(1), i), F.lit(0.0), lambda a, v: a + v)).alias("since"))
    rows = runs.select("song", F.get("x.s", F.lit(0)).alias("first"), F.explode(F.transform("x", at)).alias("y"))
    new = F.col("first") + F.col("y.since")
    return rows.select("song", "y.line", new.alias("new_s"), (F.col("y.e") + new - F.col("y.s")).alias("new_e"))


def hold_sung(words: DataFrame, voice: DataFrame, most: int, most_held: int, quiet: int) -> DataFrame:
    """song, line, k, new_e: a word (s, e; line_e: its line's end) lasts up to the next one or the line's end, but
    not into a silence of quiet or more, and no longer than most after its own start; most_held if there is
    voice in four fifths of what it gains.  It never ends sooner than it did."""
    merged = regions(voice, quiet - 1, 0).select("song", "s", "e")
    nxt = F.coalesce(F.lead("s").over(Window.partitionBy("song", "line").orderBy("k")), "line_e")
    rows = next_region(words.select("song", "line", "k", "s", "e", nxt.alias("until")).withColumn("t", F.col("e")), merged, True)
    near = F.coalesce(F.col("region.s") - F.col("e") < quiet, F.lit(False))
    silent = F.when(near, F.col("region.e")).otherwise(F.col("e"))
    rows = rows.withColumn("stop", F.greatest("e", F.when(F.col("until") - silent >= quiet, silent).otherwise(F.col("until"))))
    sung_part = F.when(near, F.least("stop", "region.e") - F.greatest("e", "region.s")).otherwise(0)
    held = (F.col("stop") > F.col("e")) & (5 * sung_part >= 4 * (F.col("stop") - F.col("e")))
    cap = F.col("s") + F.when(held, most_held).otherwise(most)
    return rows.select("song", "line", "k", F.greatest("e", F.least("until", "stop", cap)).alias("new_e"))


MOST, BEFORE, BUFFER, SHORTEST, SHORT = 3 * HOUR, HOUR // 20, HOUR, HOUR // 2, HOUR // 3


def q_readable(spark, d):
    return readable(*sung(spark, d), MOST, BEFORE, BUFFER, SHORTEST, SHORT)


def _calls(spark, d) -> DataFrame:
    """Events of two texts, so that there are long runs."""
    return timed_lines(spark, d).withColumn("text", F.when(F.col("text") == "error", "b").otherwise("la "))


def q_even(spark, d):
    return even_repeats(_calls(spark, d), 3, 1.5, HOUR, HOUR // 10)


def q_hold(spark, d):
    return hold_sung(piled(spark, d), sung(spark, d)[1], HOUR, 5 * HOUR, 2 * HOUR)


H, DAY = HOUR, 24 * HOUR
HOLD_SQL = f"""v AS {V}, m AS (SELECT song, min(s) AS s, max(e) AS e FROM (SELECT *, sum(f) OVER ({W} ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN s - max(e) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < {2 * H} THEN 0 ELSE 1 END AS f FROM v)) GROUP BY song, g),
w AS (SELECT song, d AS line, row_number() OVER (PARTITION BY song, d ORDER BY s, line) AS k, s // {4 * H} * {4 * H} AS s, e, (d + 1) * {DAY} AS line_e FROM (SELECT *, s // {DAY} AS d FROM {TIMED_SQL})),
n AS (SELECT *, coalesce(lead(s) OVER (PARTITION BY song, line ORDER BY k), line_e) AS until, (SELECT min_by({{'s': m.s, 'e': m.e}}, m.e) FROM m WHERE m.song = w.song AND m.e > w.e) AS r FROM w),
q AS (SELECT *, coalesce(r.s - e < {2 * H}, false) AS near FROM n),
t AS (SELECT *, greatest(e, CASE WHEN until - CASE WHEN near THEN r.e ELSE e END >= {2 * H} THEN CASE WHEN near THEN r.e ELSE e END ELSE until END) AS stop FROM q),
h AS (SELECT *, stop > e AND 5 * CASE WHEN near THEN least(stop, r.e) - greatest(e, r.s) ELSE 0 END >= 4 * (stop - e) AS held FROM t)"""
READABLE_SQL = f"""v AS {V}, l AS (SELECT *, lead(s) OVER ({W}) AS n FROM {L}),
x AS (SELECT *, (SELECT min_by({{'s': v.s, 'e': v.e}}, (v.e, v.s)) FROM v WHERE v.song = l.song AND v.e >= l.e) AS p, (SELECT min_by({{'s': v.s, 'e': v.e}}, (v.e, v.s)) FROM v WHERE v.song = l.song AND v.e >= l.s) AS q FROM l),
y AS (SELECT *, CASE WHEN p.s <= e AND p.e > e THEN least(p.e, coalesce(n - {BEFORE}, p.e), e + {MOST}) ELSE e END AS x FROM x),
z AS (SELECT *, CASE WHEN q.s > s AND q.s < e AND q.s < x - {SHORTEST} THEN q.s ELSE s END AS a, coalesce((SELECT min_by(v.s, (v.e, v.s)) FROM v WHERE v.song = y.song AND v.e > y.x) >= x + {BUFFER}, true) AS silent FROM y),
c AS (SELECT song, line, a AS s, greatest(CASE WHEN silent THEN greatest(x, least(x + {BUFFER}, coalesce(n - {BEFORE}, x + {BUFFER}))) ELSE x END, a + {SHORTEST}) AS e FROM z),
r AS (SELECT song, line, CASE WHEN p > s THEN (p + s) // 2 ELSE s END AS s, CASE WHEN n < e THEN (e + n) // 2 ELSE e END AS e FROM (SELECT *, lead(s) OVER ({W}) AS n, lag(e) OVER ({W}) AS p FROM c))"""
EVEN_SQL = f"""t AS (SELECT song, line, s, e, CASE WHEN text = 'error' THEN 'b' ELSE 'la' END AS text FROM {TIMED_SQL}),
u AS (SELECT *, sum(f) OVER ({W} ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN lag(text) OVER ({W}) = text THEN 0 ELSE 1 END AS f FROM t)),
n AS (SELECT *, s - lag(s) OVER g AS step, row_number() OVER g AS i FROM u WINDOW g AS (PARTITION BY song, run ORDER BY s, line)),
g AS (SELECT song, run, 0 AS k, list(step::DOUBLE ORDER BY i) FILTER (i > 1) AS x, min(s) AS first FROM n GROUP BY 1, 2 HAVING count(*) >= 3),
f AS (SELECT song, run, k, x, first, true AS more FROM g UNION ALL SELECT song, run, k + 1, CASE WHEN far THEN list_transform(x, lambda y, i: CASE WHEN i = list_position(x, worst) THEN m ELSE y END) ELSE x END, first, far FROM (SELECT *, m > {H} AND worst > 1.5::DOUBLE * m AND worst - m > {H // 10} AS far FROM (SELECT *, list_median(x) AS m, list_max(x) AS worst FROM f WHERE more AND k <= len(x)))),
b AS (SELECT song, run, max_by(x, k) AS x, any_value(first) AS first FROM f GROUP BY 1, 2),
e AS (SELECT n.song, n.line, n.s, n.e, b.first + floor(coalesce(list_sum(b.x[1:i - 1]), 0))::BIGINT AS new_s FROM n JOIN b USING (song, run))"""
QUERIES = {
    "readable_times": (q_readable, f"WITH {READABLE_SQL} SELECT song, line, CASE WHEN s - p > 0 AND s - p < {SHORT} THEN (p + s) // 2 ELSE s END AS new_s, CASE WHEN n - e > 0 AND n - e < {SHORT} THEN (e + n) // 2 ELSE e END AS new_e FROM (SELECT *, lead(s) OVER ({W}) AS n, lag(e) OVER ({W}) AS p FROM r)"),
    "held_while_sung": (q_hold, f"WITH {HOLD_SQL} SELECT song, line, k, greatest(e, least(until, stop, s + CASE WHEN held THEN {5 * H} ELSE {H} END)) AS new_e FROM h"),
    "even_repeats": (q_even, f"WITH RECURSIVE {EVEN_SQL} SELECT song, line, new_s, e + new_s - s AS new_e FROM e"),
}
