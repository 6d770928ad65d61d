"""Lines put on a scaffold of captions: near ones stay, far ones move to their caption, the rest goes between.

Lines are (song, line, s, e) in order of line, whatever their times; anchors (song, line, s, e) the captions
that they match; lengths (song, whole) how long a song is.  A null start fits nowhere; a song without an
anchor or a length stays as it is; repeated anchors of a line count once, the earliest; an empty table gives
no rows.  Lines between two anchors are one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineweave.operators.intervals import HOUR, overlaps
from lineweave.sources.tables import TIMED_SQL, timed_lines

#: How far apart lines are kept, and how long a line and a sung line last at least, in microseconds.
GAP, LINE, SUNG = 20_000, 100_000, 500_000


def scaffold_plan(lines: DataFrame, anchors: DataFrame, lengths: DataFrame, tolerance: int, gap: int = GAP, shortest: int = LINE, sung: int = SUNG) -> DataFrame:
    """song, line, new_s, new_e, source.  An anchor that starts after all before it pins its line: within
    tolerance at the line's own start (kept), else at its caption's (caption), but not before the pinned line
    before.  Another line keeps its start if it comes gap after the line before and leaves room for the lines
    up to the next pinned one; else it takes an even share of that room (interp).  Ends come gap before the
    next start: at the line's own end, its caption's, or there."""
    w = Window.partitionBy("song").orderBy("line")
    past, upto, rest = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    one = anchors.where("s IS NOT NULL").groupBy("song", "line").agg(F.min(F.struct("s", "e")).alias("a"))
    t = lines.select("song", "line", "s", "e").join(one, ["song", "line"], "left").join(lengths, "song", "left")
    t = t.withColumn("fresh", F.col("a").isNotNull() & (F.max("a.s").over(past).isNull() | (F.col("a.s") > F.max("a.s").over(past))))
    near = F.coalesce(F.abs(F.col("s") - F.col("a.s")) <= tolerance, F.lit(False))
    t = t.withColumn("pin", F.when(F.col("fresh"), F.when(near, F.col("s")).otherwise(F.col("a.s")))).withColumn("before", F.greatest(F.max("pin").over(past), F.lit(0)))
    t = t.withColumns({"source": F.when(F.col("fresh"), F.when(near & (F.col("pin") >= F.col("before")), "kept").otherwise("caption")), "pin": F.when(F.col("fresh"), F.greatest("pin", "before"))})
    t = t.withColumns({"part": F.count("pin").over(upto), "hi": F.first("pin", ignorenulls=True).over(rest), "pins": F.count("pin").over(Window.partitionBy("song"))})
    good = (F.col("pins") > 0) & F.col("whole").isNotNull()
    free = t.where(good & F.col("pin").isNull()).withColumn("lo", F.col("before"))
    runs = free.groupBy("song", "part", "lo", "hi", "whole").agg(F.array_sort(F.collect_list(F.struct("line", "s"))).alias("x")).withColumn("n", F.size("x").cast("long"))
    runs = runs.withColumn("hi", F.coalesce("hi", F.greatest("whole", F.col("lo") + (F.col("n") + 1) * shortest)))
    out = "array<struct<line: bigint, at: bigint, fits: boolean>>"
    fits = f"coalesce(x.s BETWEEN a.cur + {gap} AND hi - (n - size(a.found)) * {shortest}, false)"
    at = f"if({fits}, x.s, a.cur + CAST(floor((hi - a.cur) / (n - size(a.found) + 1)) AS bigint))"
    put = F.expr(f"aggregate(x, struct(lo AS cur, CAST(array() AS {out}) AS found), (a, x) -> struct({at} AS cur, array_append(a.found, named_struct('line', x.line, 'at', {at}, 'fits', {fits})) AS found), a -> a.found)")
    put = runs.select("song", F.explode(put).alias("y")).select("song", "y.line", F.col("y.at").alias("at"), "y.fits")
    t = t.join(put, ["song", "line"], "left").withColumn("new_s", F.coalesce("pin", "at"))
    source = F.coalesce("source", F.when(F.col("fits"), "kept").otherwise("interp"))
    cap = F.coalesce(F.lead("new_s").over(w), F.greatest("whole", F.col("new_s") + shortest)) - gap
    t = t.withColumns({"source": source, "cap": cap})
    shown = F.least(F.greatest(F.col("a.e"), F.col("new_s") + sung), "cap")
    end = F.when(F.col("source") == "kept", F.least(F.coalesce("e", "cap"), "cap")).when(F.col("source") == "caption", shown).otherwise(F.col("cap"))
    end = F.greatest(end, F.col("new_s") + shortest)
    return t.select("song", "line", F.when(good, F.col("new_s")).otherwise(F.col("s")).alias("new_s"), F.when(good, end).otherwise(F.col("e")).alias("new_e"), F.when(good, F.col("source")).otherwise("kept").alias("source"))


MONTH = 30 * 24 * HOUR


def q_scaffold(spark, d):
    """Clicks in order of their number against the first view that they overlap, from the first of January on."""
    t = timed_lines(spark, d)
    c, v = t.where("text = 'click'"), t.where("text = 'view'")
    first = overlaps(c, v).groupBy("song", F.col("a").alias("line")).agg(F.min(F.struct(F.col("b_s").alias("s"), F.col("b_e").alias("e"))).alias("x")).select("song", "line", "x.s", "x.e")
    zero = 1_704_067_200_000_000
    moved = lambda df: df.select("song", "line", (F.col("s") - zero).alias("s"), (F.col("e") - zero).alias("e"))
    return scaffold_plan(moved(c), moved(first), c.select("song").distinct().withColumn("whole", F.lit(MONTH)), HOUR, HOUR // 20, HOUR // 2, HOUR)


H, ZERO = HOUR, 1_704_067_200_000_000
_PAST = "(PARTITION BY song ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
PLAN_SQL = f"""c AS (SELECT song, line, s - {ZERO} AS s, e - {ZERO} AS e, text FROM {TIMED_SQL}),
l AS (SELECT c.song, c.line, c.s, c.e, min({{'s': v.s, 'e': v.e}}) FILTER (v.s IS NOT NULL) AS a FROM c LEFT JOIN c v ON v.text = 'view' AND v.song = c.song AND c.s < v.e AND v.s < c.e WHERE c.text = 'click' GROUP BY 1, 2, 3, 4),
p AS (SELECT *, a IS NOT NULL AND coalesce(a.s > max(a.s) OVER {_PAST}, true) AS fresh FROM l),
q AS (SELECT *, CASE WHEN fresh THEN CASE WHEN abs(s - a.s) <= {H} THEN s ELSE a.s END END AS pin0 FROM p),
r AS (SELECT *, greatest(coalesce(max(pin0) OVER {_PAST}, 0), 0) AS past FROM q),
u AS (SELECT *, CASE WHEN fresh THEN greatest(pin0, past) END AS pin, CASE WHEN fresh THEN CASE WHEN abs(s - a.s) <= {H} AND pin0 >= past THEN 'kept' ELSE 'caption' END END AS src FROM r),
g AS (SELECT *, count(pin) OVER (PARTITION BY song ORDER BY line ROWS UNBOUNDED PRECEDING) AS part, first_value(pin IGNORE NULLS) OVER (PARTITION BY song ORDER BY line ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt, count(pin) OVER (PARTITION BY song) AS pins, row_number() OVER (PARTITION BY song ORDER BY line) AS i FROM u),
n AS (SELECT *, count(*) FILTER (pin IS NULL) OVER (PARTITION BY song, part) AS n, row_number() OVER (PARTITION BY song, part, pin IS NULL ORDER BY line) - 1 AS k FROM g)"""


def _plan_sql() -> str:
    """The walk along the lines of a song as one recursion."""
    hi = f"coalesce(n.nxt, greatest({MONTH}, n.past + (n.n + 1) * {H // 2}))"
    fits = f"(n.pin IS NULL AND coalesce(n.s BETWEEN w.new_s + {H // 20} AND {hi} - (n.n - n.k) * {H // 2}, false))"
    step = f"CASE WHEN n.pin IS NOT NULL THEN n.pin WHEN {fits} THEN n.s ELSE w.new_s + floor(({hi} - w.new_s)::DOUBLE / (n.n - n.k + 1))::BIGINT END"
    walk = f"w AS (SELECT DISTINCT song, 0::BIGINT AS i, 0::BIGINT AS new_s, false AS fits FROM n WHERE pins > 0 UNION ALL SELECT n.song, n.i, {step}, {fits} FROM w JOIN n ON n.song = w.song AND n.i = w.i + 1)"
    done = f"x AS (SELECT n.song, n.line, n.s, n.e, n.a, n.pins, w.new_s, CASE WHEN n.pins = 0 THEN 'kept' ELSE coalesce(n.src, CASE WHEN w.fits THEN 'kept' ELSE 'interp' END) END AS source, coalesce(lead(w.new_s) OVER (PARTITION BY n.song ORDER BY n.line), greatest({MONTH}, w.new_s + {H // 2})) - {H // 20} AS cap FROM n LEFT JOIN w ON w.song = n.song AND w.i = n.i)"
    end = f"greatest(CASE source WHEN 'kept' THEN least(e, cap) WHEN 'caption' THEN least(greatest(a.e, new_s + {H}), cap) ELSE cap END, new_s + {H // 2})"
    return f"WITH RECURSIVE {PLAN_SQL}, {walk}, {done} SELECT song, line, CASE WHEN pins > 0 THEN new_s ELSE s END AS new_s, CASE WHEN pins > 0 THEN {end} ELSE e END AS new_e, source FROM x"


QUERIES = {"scaffold_plan": (q_scaffold, _plan_sql())}
