"""Times by a share of the voice: where so much of it has been heard, and lines and words put there.

Voice is (song, line, s, e), regions that don't overlap.  The voiced time up to a moment is piecewise linear;
its inverse is an as-of join of wanted amounts with running sums of the regions' lengths.  Everything is a
window by song and part of it.  Rows with a null start or end aren't voice and aren't moved; of lines with
equal starts the smaller number is first; a song without voice stays as it is; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.operators.intervals import HOUR, by_start, overlaps
from lineweave.operators.matching import piled
from lineweave.operators.repairs import L, V, W, _cover, covered, sung
from lineweave.sources.tables import TIMED_SQL


def voiced_moments(voice: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of wanted (keys, amount, ...) with ``at``: the moment when so much of the voice of their keys has
    been heard; the first region's start for 0, and the last one's end beyond all of it."""
    before = Window.partitionBy(*keys).orderBy("s", "line")
    sums = voice.where("e > s").withColumn("upto", F.sum(F.col("e") - F.col("s")).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    regions = sums.select(*keys, (F.col("upto") - F.col("e") + F.col("s")).alias("amount"), F.struct("s", "e", (F.col("upto") - F.col("e") + F.col("s")).alias("from")).alias("region"), F.lit(1).alias("side"))
    rest = [c for c in wanted.columns if c not in (*keys, "amount")]
    asked = wanted.select(*keys, "amount", F.struct(*rest).alias("row"), F.lit(0).alias("side"))
    both = asked.unionByName(regions, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("amount", "side")
    last, first = F.last("region", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("region", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = both.withColumn("in", F.coalesce(last, first)).where("side = 0")
    return rows.select(*keys, "amount", "row.*", F.least(F.col("in.s") + F.greatest(F.col("amount") - F.col("in.from"), F.lit(0)), "in.e").alias("at"))


def leaked_blocks(lines: DataFrame, voice: DataFrame, gap: int, rate: float, near: int) -> tuple[DataFrame, DataFrame]:
    """Blocks (song, part, first, last, from, cap) of lines to be spread anew, numbered by start from 0, and the
    voice with its part, the number of silences of gap before it.  A block belongs to a silence; it begins with
    the lines that stand before its end (but for near) with voice in less than 0.3 of them, and goes on up to
    the next silence.  There is none where these lines don't begin gap before the end, or none of them has
    over rate letters a second, or the block is a single line."""
    w = by_start()
    parts = voice.withColumns({"was": F.lag("e").over(w)}).withColumn("part", F.sum(F.when(F.col("s") - F.col("was") >= gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    opens = parts.where((F.col("part") > 0) & (F.col("s") - F.col("was") >= gap)).select("song", "part", F.col("s").alias("ends"), (F.col("s") - F.col("was")).alias("silence"), F.col("was").alias("begins"))
    opens = opens.withColumn("until", F.lead("begins").over(Window.partitionBy("song").orderBy("part")))
    rows = lines.where("s IS NOT NULL AND e IS NOT NULL").join(covered(lines, voice), ["song", "line"], "left").withColumn("i", F.row_number().over(w) - 1)
    rows = rows.withColumn("quiet", (F.col("i") > 0) & (10 * F.coalesce("voiced", F.lit(0)) < 3 * F.greatest(F.col("e") - F.col("s"), F.lit(1))))
    rows = rows.withColumn("run", F.sum(F.when(F.col("quiet"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    in_run = by_start("run").rowsBetween(Window.unboundedPreceding, 0)
    speed = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", "")) * 1_000_000 / F.greatest(F.col("e") - F.col("s"), F.lit(100_000))
    rows = rows.withColumns({"fast": F.max(F.when(F.col("quiet"), speed)).over(in_run), "head": F.min(F.when(F.col("quiet"), F.struct("i", "s"))).over(in_run)})
    # what stands before a silence's end, and the number of lines before the next one
    marks = opens.select("song", F.col("part").alias("of"), (F.col("ends") - near).alias("t"), F.lit(0).alias("side")).unionByName(opens.where("until IS NOT NULL").select("song", F.col("part").alias("of"), F.col("until").alias("t"), F.lit(1).alias("side")))
    seen = rows.select("song", F.col("s").alias("t"), F.lit(2).alias("side"), "line", F.struct("i", "quiet", "fast", "head").alias("last"))
    seen = marks.unionByName(seen, allowMissingColumns=True).withColumn("last", F.last("last", ignorenulls=True).over(Window.partitionBy("song").orderBy("t", "side", "line").rowsBetween(Window.unboundedPreceding, 0)))
    size = rows.groupBy("song").agg(F.max("i").alias("all"))
    left = seen.where("side = 0").select("song", F.col("of").alias("part"), "last")
    right = seen.where("side = 1").select("song", F.col("of").alias("part"), F.col("last.i").alias("next"))
    b = opens.join(left, ["song", "part"]).join(right, ["song", "part"], "left").join(size, "song")
    b = b.withColumns({"first": F.col("last.head.i"), "to": F.greatest(F.when(F.col("until").isNull(), F.col("all")).otherwise(F.col("next")), F.col("last.i") + 1)})
    good = F.col("last.quiet") & (F.col("last.head.s") <= F.col("ends") - gap) & (F.col("last.fast") >= rate) & (F.col("last.i") < F.col("all"))
    return b.where(good).select("song", "part", F.col("first").cast("long").alias("first"), F.col("to").cast("long").alias("last"), "silence"), parts.select("song", "part", "line", "s", "e")


def spread_leaks(lines: DataFrame, voice: DataFrame, gap: int, rate: float, near: int, slack: int, shortest: int) -> DataFrame:
    """song, line, new_s, new_e of the lines of blocks: each gets an equal share of the voice after the block's
    silence, in order, but starts no later than the silence's length and slack after where it was.  Each silence
    sees the lines as they were; of two blocks with one line the later has it."""
    blocks, parts = leaked_blocks(lines, voice, gap, rate, near)
    total = parts.groupBy("song", "part").agg(F.sum(F.col("e") - F.col("s")).alias("total"))
    n = F.col("last") - F.col("first") + 1
    steps = blocks.join(total, ["song", "part"]).withColumn("n", n).where("total > 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
    steps = steps.select("song", "part", F.floor(F.col("k") * F.col("total") / F.col("n")).alias("amount"), "k", "n", (F.col("first") + F.col("k")).alias("i"), (F.col("silence") + slack).alias("cap"))
    put = voiced_moments(parts, steps, ["song", "part"])
    put = put.withColumn("until", F.lead("at").over(Window.partitionBy("song", "part").orderBy("k"))).where("k < n")
    own = lines.where("s IS NOT NULL AND e IS NOT NULL").select("song", "line", "s", (F.row_number().over(by_start()) - 1).cast("long").alias("i"))
    rows = put.join(own, ["song", "i"])
    so_far = Window.partitionBy("song", "part").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("new_s", F.max(F.least("at", F.col("s") + F.col("cap"))).over(so_far)).withColumn("new_e", F.greatest("until", F.col("new_s") + shortest))
    best = rows.groupBy("song", "line").agg(F.max(F.struct("part", "new_s", "new_e")).alias("x"))
    return best.select("song", "line", "x.new_s", "x.new_e")


def spread_by_voice(words: DataFrame, voice: DataFrame) -> DataFrame:
    """song, line, k, new_s, new_e: words (song, line, k, s, e) of a line with one start are spread over the voice
    up to the next start, or the last word's end, in equal shares of it; without voice there in even steps.  Ends
    don't come before starts."""
    heads = words.groupBy("song", "line", "s").agg(F.count(F.lit(1)).alias("n"), F.max_by("e", "k").alias("end"))
    heads = heads.withColumn("until", F.coalesce(F.lead("s").over(Window.partitionBy("song", "line").orderBy("s")), "end")).where("n > 1 AND until > s")
    span = heads.select("song", F.struct("line", "s").alias("line"), "s", F.col("until").alias("e"))
    inside = overlaps(span, voice).select("song", F.col("a.line").alias("line"), F.col("a.s").alias("pile"), F.col("b").alias("region"), F.greatest("a_s", "b_s").alias("s"), F.least("a_e", "b_e").alias("e"))
    total = inside.groupBy("song", "line", "pile").agg(F.sum(F.col("e") - F.col("s")).alias("total"))
    rows = words.withColumn("i", F.row_number().over(Window.partitionBy("song", "line", "s").orderBy("k")) - 1)
    rows = rows.join(heads.select("song", "line", "s", "n", "until"), ["song", "line", "s"], "left").withColumnRenamed("s", "pile").join(total, ["song", "line", "pile"], "left")
    moves = rows.where("i > 0 AND total > 0").select("song", "line", "pile", F.floor(F.col("i") * F.col("total") / F.col("n")).alias("amount"), "k")
    at = voiced_moments(inside.withColumnRenamed("line", "own").withColumnRenamed("region", "line"), moves.withColumnRenamed("line", "own"), ["song", "own", "pile"])
    rows = rows.join(at.select("song", F.col("own").alias("line"), "k", "at"), ["song", "line", "k"], "left")
    even = F.col("pile") + F.floor((F.col("until") - F.col("pile")) * F.col("i") / F.col("n"))
    s: Column = F.coalesce("at", F.when(F.col("total").isNull(), even), "pile")
    return rows.select("song", "line", "k", s.alias("new_s"), F.when(F.col("n").isNotNull(), F.greatest("e", s)).otherwise(F.col("e")).alias("new_e"))


GAP, RATE, NEAR, SLACK, SHORTEST = 20 * HOUR, 0.0003, 2 * HOUR, 5 * HOUR, HOUR // 10


def q_leaks(spark, d):
    return spread_leaks(*sung(spark, d), GAP, RATE, NEAR, SLACK, SHORTEST)


def q_piled(spark, d):
    return spread_by_voice(piled(spark, d).select("song", "line", "k", "s", "e"), sung(spark, d)[1])


H, DAY = HOUR, 24 * HOUR
#: p: voice with its part; o: silences; l: lines; b: blocks; x: steps.
LEAKS_SQL = f"""v AS {V}, p AS (SELECT song, line, s, e, was, sum(CASE WHEN s - was >= {GAP} THEN 1 ELSE 0 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS part FROM (SELECT *, lag(e) OVER ({W}) AS was FROM v)),
u AS (SELECT *, sum(e - s) OVER (PARTITION BY song, part ORDER BY s, line ROWS UNBOUNDED PRECEDING) AS upto, sum(e - s) OVER (PARTITION BY song, part) AS total FROM p),
o AS (SELECT song, part, s AS ends, s - was AS silence, lead(was) OVER (PARTITION BY song ORDER BY part) AS until FROM p WHERE s - was >= {GAP}),
l AS (SELECT l.*, row_number() OVER (PARTITION BY l.song ORDER BY l.s, l.line) - 1 AS i, 10 * coalesce(c.voiced, 0) < 3 * greatest(l.e - l.s, 1) AS low, length(regexp_replace(coalesce(text, ''), '\\s', '', 'g')) * 1000000.0::DOUBLE / greatest(l.e - l.s, 100000) AS speed FROM {L} l LEFT JOIN {_cover(L)} c ON c.song = l.song AND c.line = l.line),
k AS (SELECT o.*, (SELECT max(i) FROM l WHERE l.song = o.song AND l.s < o.ends - {NEAR}) AS last, (SELECT max(i) FROM l WHERE l.song = o.song) AS high, (SELECT max(i) FROM l WHERE l.song = o.song AND l.s < o.until) AS next FROM o),
f AS (SELECT k.*, (SELECT coalesce(max(i), 0) + 1 FROM l WHERE l.song = k.song AND l.i <= k.last AND (NOT low OR i = 0)) AS first FROM k),
b AS (SELECT *, greatest(CASE WHEN until IS NULL THEN high ELSE next END, last + 1) AS until_i FROM f WHERE first <= last AND last < high AND (SELECT s FROM l WHERE l.song = f.song AND l.i = f.first) <= ends - {GAP} AND (SELECT max(speed) FROM l WHERE l.song = f.song AND l.i BETWEEN f.first AND f.last) >= {RATE}::DOUBLE),
x AS (SELECT song, part, silence, first + k AS i, k, n, floor((k * total)::DOUBLE / n)::BIGINT AS amount FROM (SELECT *, unnest(range(n + 1)) AS k FROM (SELECT b.song, b.part, silence, first, until_i - first + 1 AS n, any_value(total) AS total FROM b JOIN u ON u.song = b.song AND u.part = b.part GROUP BY ALL))),
y AS (SELECT x.*, (SELECT min_by(u.s + greatest(x.amount - (u.upto - u.e + u.s), 0), u.upto) FROM u WHERE u.song = x.song AND u.part = x.part AND u.upto >= x.amount) AS pos FROM x),
z AS (SELECT *, lead(pos) OVER (PARTITION BY song, part ORDER BY k) AS until FROM y),
q AS (SELECT z.song, l.line, part, max(least(pos, l.s + silence + {SLACK})) OVER (PARTITION BY z.song, part ORDER BY k ROWS UNBOUNDED PRECEDING) AS new_s, until FROM z JOIN l ON l.song = z.song AND l.i = z.i WHERE k < n)"""
P_SQL = f"(SELECT song, d AS line, row_number() OVER (PARTITION BY song, d ORDER BY s, line) AS k, s // {4 * H} * {4 * H} AS s, e FROM (SELECT *, s // {DAY} AS d FROM {TIMED_SQL}))"
QUERIES = {
    "spread_leaks": (q_leaks, f"WITH {LEAKS_SQL} SELECT song, line, new_s, greatest(until, new_s + {SHORTEST}) AS new_e FROM q QUALIFY row_number() OVER (PARTITION BY song, line ORDER BY part DESC) = 1"),
    "piled_by_voice": (
        q_piled,
        f"""WITH v AS {V}, p AS {P_SQL}, h AS (SELECT *, coalesce(lead(s) OVER (PARTITION BY song, line ORDER BY s), last) AS until FROM (SELECT song, line, s, count(*) AS n, max_by(e, k) AS last FROM p GROUP BY 1, 2, 3)), g AS (SELECT * FROM h WHERE n > 1 AND until > s),
c AS (SELECT g.song, g.line, g.s AS pile, greatest(g.s, v.s) AS s, least(g.until, v.e) AS e FROM g JOIN v ON v.song = g.song AND v.s < g.until AND g.s < v.e), u AS (SELECT *, sum(e - s) OVER (PARTITION BY song, line, pile ORDER BY s ROWS UNBOUNDED PRECEDING) AS upto, sum(e - s) OVER (PARTITION BY song, line, pile) AS total FROM c),
r AS (SELECT p.*, n, until, row_number() OVER (PARTITION BY p.song, p.line, p.s ORDER BY p.k) - 1 AS i, (SELECT any_value(total) FROM u WHERE u.song = p.song AND u.line = p.line AND u.pile = p.s) AS total FROM p LEFT JOIN g ON g.song = p.song AND g.line = p.line AND g.s = p.s),
a AS (SELECT *, CASE WHEN i > 0 AND total > 0 THEN floor((i * total)::DOUBLE / n)::BIGINT END AS amount FROM r), m AS (SELECT *, (SELECT min_by(u.s + a.amount - (u.upto - u.e + u.s), u.upto) FROM u WHERE u.song = a.song AND u.line = a.line AND u.pile = a.s AND u.upto >= a.amount) AS pos FROM a),
f AS (SELECT *, coalesce(pos, CASE WHEN total IS NULL THEN s + floor(((until - s) * i)::DOUBLE / n)::BIGINT END, s) AS new_s FROM m) SELECT song, line, k, new_s, CASE WHEN n IS NOT NULL THEN greatest(e, new_s) ELSE e END AS new_e FROM f""",
    ),
}
