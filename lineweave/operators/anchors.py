"""Anchors: lines matched in order to the captions of a track, and what follows from them.

Lines are (song, i, key), captions (song, track, j, key, s, e); i and j count from 1 in order of time.
Keys meet by short fragments, so that only lines and captions that share one are compared; the walk in
order goes through the matches of one song and track, its result, in one task.  A null key, or one shorter
than a fragment, matches nothing; rows that are equal in everything are numbered one after the other in
any order; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.operators.intervals import HOUR
from lineweave.sources.tables import TIMED_SQL, dealt, timed_lines

KEY = ["song", "track"]


def numbered(rows: DataFrame, name: str, *keys: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy("s", "line")).cast("long"))


def pieces(key: Column, n: int) -> Column:
    """The distinct fragments of n letters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(key) - n + 1), lambda p: F.substr(key, p, F.lit(n))))


def key_pairs(lines: DataFrame, captions: DataFrame, n: int, share: float) -> DataFrame:
    """song, track, i, j where a caption's key holds the line's, or stands in it with this share of its letters
    at least: the shorter one's first fragment is among those of the longer."""
    a = lines.where(F.length("key") >= n).select("song", "i", F.col("key").alias("a"))
    b = captions.where(F.length("key") >= n).select(*KEY, "j", F.col("key").alias("b"))
    first, every = lambda c: F.substring(c, 1, n), lambda c: F.explode(pieces(F.col(c), n))
    inside = a.withColumn("g", first("a")).join(b.withColumn("g", every("b")), ["song", "g"]).where(F.contains("b", "a"))
    around = a.withColumn("g", every("a")).join(b.withColumn("g", first("b")), ["song", "g"]).where(F.contains("a", "b") & (F.col("a") != F.col("b")) & (F.length("b") >= share * F.length("a")))
    return inside.unionByName(around).select(*KEY, "i", "j")


def forward(pairs: DataFrame, step: int) -> DataFrame:
    """song, track, i, j: each i in order takes its first j that isn't before the last one taken, or
    is step after it.  A task goes through its pairs in order, however many songs they are of."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, last, done = 0, None, None
        for batch in batches:
            taken = []
            for at, (song, track, i, j) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                if (song, track) != last:
                    last, least, done = (song, track), 0, None
                if i != done and j >= least:
                    done, least = i, j + step
                    taken.append(at)
            yield batch.take(pa.array(np.array(taken, np.int64)))

    order = [*KEY, "i", "j"]
    rows = dealt(pairs.select(*(F.col(c).cast("long").alias(c) for c in order)), *KEY).sortWithinPartitions(*order)
    return rows.mapInArrow(walk, "song long, track long, i long, j long")


def anchors(lines: DataFrame, captions: DataFrame, pairs: DataFrame, shortest: int) -> DataFrame:
    """The forward matches with the caption's times, the letters of the line, and how many captions up to
    this one match any line (like: whether this one does)."""
    like = pairs.select(*KEY, "j").distinct().withColumn("like", F.lit(1))
    c = captions.join(like, [*KEY, "j"], "left").select(*KEY, "j", "s", F.greatest("e", F.col("s") + shortest).alias("e"), F.coalesce("like", F.lit(0)).alias("like"))
    c = c.withColumn("likes", F.sum("like").over(Window.partitionBy(*KEY).orderBy("j").rowsBetween(Window.unboundedPreceding, 0)))
    return forward(pairs, 0).join(c, [*KEY, "j"]).join(lines.select("song", "i", F.length("key").alias("letters")), ["song", "i"])


def forbidden_spans(found: DataFrame, gap: int, margin: int, shortest: int, letter: int) -> DataFrame:
    """song, track, i, s, e, between, likes, accepted: where no line can start, as the lines of two
    neighbouring anchors are neighbours too and nothing like a line is shown between them.  What is sung
    first lasts to the end of its caption, or letter by letter, whichever is later."""
    w = Window.partitionBy(*KEY).orderBy("i")
    sung = F.sum("letters").over(Window.partitionBy(*KEY, "j"))
    rows = found.withColumn("until", F.greatest("e", F.col("s") + F.greatest(F.lit(shortest), sung * letter)))
    nxt = {f"n_{c}": F.lead(c).over(w) for c in ("i", "j", "s", "like", "likes")}
    rows = rows.withColumns(nxt).where((F.col("n_i") == F.col("i") + 1) & (F.col("n_s") - F.col("until") >= gap) & (F.col("n_s") - F.col("until") > 2 * margin))
    between = F.greatest(F.col("n_j") - F.col("j") - 1, F.lit(0))
    likes = F.when(F.col("n_j") > F.col("j"), F.col("n_likes") - F.col("n_like") - F.col("likes")).otherwise(0)
    return rows.select(*KEY, "i", (F.col("until") + margin).alias("s"), (F.col("n_s") - margin).alias("e"), between.alias("between"), likes.alias("likes"), (likes == 0).alias("accepted"))


def anchor_plan(lines: DataFrame, tracks: DataFrame, found: DataFrame, spans: DataFrame, n: int, percent: int, most: int) -> DataFrame:
    """For each song the first track that this percentage of the lines with a key match, its anchors, its
    accepted spans and their length; skipped says why there are none.  Spans of more than most percent of
    the song are too many."""
    size = lines.groupBy("song").agg(F.count_if(F.length("key") >= n).alias("lines"), (F.max("e") - F.min("s")).cast("long").alias("long"))
    rate = tracks.select(*KEY).distinct().join(found.groupBy(*KEY).agg(F.count(F.lit(1)).alias("matched")), KEY, "left").join(size.select("song", "lines"), "song")
    chosen = rate.where((F.col("lines") > 0) & (100 * F.coalesce("matched", F.lit(0)) >= percent * F.col("lines"))).groupBy("song").agg(F.min_by("matched", "track").alias("matched"), F.min("track").alias("track"))
    total = spans.where("accepted").groupBy(*KEY).agg(F.count(F.lit(1)).alias("spans"), F.sum(F.col("e") - F.col("s")).cast("long").alias("forbidden"))
    rows = size.join(chosen, "song", "left").join(total, KEY, "left")
    over = 100 * F.col("forbidden") > most * F.col("long")
    skipped = F.when(F.col("lines") == 0, "no_matchable_lines").when(F.col("track").isNull(), "low_match").when(F.col("spans").isNull(), "no_gap").when(over, "too_much_forbidden")
    return rows.select("song", "track", "matched", F.when(over, 0).otherwise(F.coalesce("spans", F.lit(0))).alias("spans"), "forbidden", skipped.alias("skipped"))


def echoes(items: DataFrame, lines: DataFrame) -> DataFrame:
    """song, line, item: items (song, i, key) in order onto the next line (song, j, key) with their key.  If
    none finds one and no item has a key, or there are as many items as lines, they go by their number."""
    pairs = items.where("key <> ''").join(lines.select("song", "j", "key"), ["song", "key"]).select("song", F.lit(0).cast("long").alias("track"), "i", "j")
    met = forward(pairs, 1).select("song", F.col("j").alias("line"), F.col("i").alias("item"))
    size = items.groupBy("song").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("key") != "").alias("keys")).join(lines.groupBy("song").agg(F.count(F.lit(1)).alias("lines")), "song")
    lost = size.join(met.select("song").distinct(), "song", "left_anti").where("keys = 0 OR items = lines")
    placed = items.join(lost, "song").where("i <= lines").select("song", F.col("i").alias("line"), F.col("i").alias("item"))
    return met.unionByName(placed)


def _clicks(spark, d):
    """Clicks of a user as lines, views and purchases as captions of two tracks.  Keys are digits of the value,
    its whole part alone or with its hundredths: by the line's number short, middling or long."""
    whole, rest = F.format_string("%02d", F.floor("value")), F.format_string("%02d", F.floor(F.col("value") * 100) % 100)
    n, line = F.col("line") % 3, F.col("text") == "click"
    middling, long = F.when(line, F.concat(whole, rest)).otherwise(F.concat(rest, whole)), F.when(line, F.concat(whole, rest, whole, rest)).otherwise(F.concat(F.lit("abcdefgh"), whole))
    t = timed_lines(spark, d).withColumn("key", F.when(n == 0, whole).when(n == 1, middling).otherwise(long))
    captions = t.where("text IN ('view', 'purchase')").withColumn("track", F.when(F.col("text") == "view", 1).otherwise(2).cast("long"))
    return numbered(t.where("text = 'click'"), "i", "song"), numbered(captions, "j", *KEY)


def _found(spark, d):
    lines, captions = _clicks(spark, d)
    pairs = key_pairs(lines, captions, 2, 0.3).distinct()
    return lines, captions, anchors(lines, captions, pairs, HOUR // 2)


def _spans(found):
    return forbidden_spans(found, 8 * HOUR, HOUR // 2, HOUR // 2, HOUR // 4)


def q_plan(spark, d):
    lines, captions, found = _found(spark, d)
    return anchor_plan(lines, captions, found, _spans(found), 2, 30, 35)


def q_echoes(spark, d):
    """All errors of a user as echoes of all its clicks; those under 5 have no key."""
    t = timed_lines(spark, d).withColumn("key", F.when(F.col("value") >= 5, F.floor("value").cast("string")))
    return echoes(numbered(t.where("text = 'error'"), "i", "song"), numbered(t.where("text = 'click'"), "j", "song"))


H = HOUR
CLICKS = f"""t0 AS (SELECT *, lpad((floor(value)::BIGINT)::VARCHAR, greatest(2, length((floor(value)::BIGINT)::VARCHAR))::INT, '0') AS w, lpad((floor(value * 100)::BIGINT % 100)::VARCHAR, 2, '0') AS r FROM {TIMED_SQL}),
t AS (SELECT song, line, text, s, e, CASE line % 3 WHEN 0 THEN w WHEN 1 THEN CASE WHEN text = 'click' THEN w || r ELSE r || w END ELSE CASE WHEN text = 'click' THEN w || r || w || r ELSE 'abcdefgh' || w END END AS key FROM t0),
a AS (SELECT song, s, e, key, row_number() OVER (PARTITION BY song ORDER BY s, line) AS i FROM t WHERE text = 'click'),
b0 AS (SELECT song, CASE text WHEN 'view' THEN 1 ELSE 2 END AS track, s, e, line, key FROM t WHERE text IN ('view', 'purchase')),
b AS (SELECT *, row_number() OVER (PARTITION BY song, track ORDER BY s, line) AS j FROM b0),
p AS (SELECT a.song, track, i, list(j) AS js FROM a JOIN b ON a.song = b.song AND (contains(b.key, a.key) OR contains(a.key, b.key) AND length(b.key) >= 0.3::DOUBLE * length(a.key)) GROUP BY 1, 2, 3),
n AS (SELECT a.song, k.track, a.i, coalesce(p.js, []) AS js FROM a JOIN (SELECT DISTINCT song, track FROM b) k ON k.song = a.song LEFT JOIN p ON p.song = a.song AND p.track = k.track AND p.i = a.i),
r AS (SELECT song, track, 0::BIGINT AS i, NULL::BIGINT AS j, 0::BIGINT AS least FROM n GROUP BY 1, 2 UNION ALL SELECT n.song, n.track, n.i, list_min(list_filter(js, lambda x: x >= r.least)), coalesce(list_min(list_filter(js, lambda x: x >= r.least)), r.least) FROM r JOIN n ON n.song = r.song AND n.track = r.track AND n.i = r.i + 1),
f AS (SELECT r.song, r.track, r.i, r.j, b.s, greatest(b.e, b.s + {H // 2}) AS e, length(a.key) AS letters FROM r JOIN b ON b.song = r.song AND b.track = r.track AND b.j = r.j JOIN a ON a.song = r.song AND a.i = r.i),
u AS (SELECT *, greatest(e, s + greatest({H // 2}, {H // 4} * sum(letters) OVER (PARTITION BY song, track, j))) AS until, lead(i) OVER w AS n_i, lead(j) OVER w AS n_j, lead(s) OVER w AS n_s FROM f WINDOW w AS (PARTITION BY song, track ORDER BY i)),
g AS (SELECT song, track, i, (until + {H // 2})::BIGINT AS s, n_s - {H // 2} AS e, greatest(n_j - j - 1, 0) AS between, (SELECT count(*) FROM (SELECT DISTINCT song, track, unnest(js) AS x FROM p) q WHERE q.song = u.song AND q.track = u.track AND x > u.j AND x < u.n_j) AS likes FROM u WHERE n_i = i + 1 AND n_s - until >= {8 * H} AND n_s - until > {2 * (H // 2)})"""

QUERIES = {
    "forward_anchors": (lambda spark, d: _found(spark, d)[2].select(*KEY, "i", "j", "s", "e", "letters"), f"WITH RECURSIVE {CLICKS} SELECT song, track, i, j, s, e, letters FROM f"),
    "forbidden_spans": (lambda spark, d: _spans(_found(spark, d)[2]), f"WITH RECURSIVE {CLICKS} SELECT *, likes = 0 AS accepted FROM g"),
    "anchor_plan": (
        q_plan,
        f"WITH RECURSIVE {CLICKS}, z AS (SELECT song, count(*) AS lines, max(e) - min(s) AS long FROM a GROUP BY 1), c AS (SELECT f.song, track, count(*) AS matched FROM f JOIN z ON z.song = f.song GROUP BY 1, 2, z.lines HAVING 100 * count(*) >= 30 * z.lines QUALIFY row_number() OVER (PARTITION BY f.song ORDER BY track) = 1), x AS (SELECT song, track, count(*) AS spans, sum(e - s)::BIGINT AS forbidden FROM g WHERE likes = 0 GROUP BY 1, 2) SELECT z.song, c.track, c.matched, CASE WHEN 100 * forbidden > 35 * long THEN 0 ELSE coalesce(spans, 0) END AS spans, forbidden, CASE WHEN c.track IS NULL THEN 'low_match' WHEN spans IS NULL THEN 'no_gap' WHEN 100 * forbidden > 35 * long THEN 'too_much_forbidden' END AS skipped FROM z LEFT JOIN c ON c.song = z.song LEFT JOIN x ON x.song = c.song AND x.track = c.track",
    ),
    "echo_alignment": (
        q_echoes,
        f"WITH RECURSIVE t AS (SELECT *, CASE WHEN value >= 5 THEN floor(value)::BIGINT END AS key FROM {TIMED_SQL}), a AS (SELECT song, key, row_number() OVER (PARTITION BY song ORDER BY s, line) AS i FROM t WHERE text = 'error'), b AS (SELECT song, key, row_number() OVER (PARTITION BY song ORDER BY s, line) AS j FROM t WHERE text = 'click'), n AS (SELECT a.song, i, list(j) FILTER (j IS NOT NULL) AS js FROM a LEFT JOIN b ON b.song = a.song AND b.key = a.key GROUP BY 1, 2), r AS (SELECT DISTINCT song, 0::BIGINT AS i, NULL::BIGINT AS j, 0::BIGINT AS past FROM n UNION ALL SELECT n.song, n.i, list_min(list_filter(js, lambda x: x > r.past)), coalesce(list_min(list_filter(js, lambda x: x > r.past)), r.past) FROM r JOIN n ON n.song = r.song AND n.i = r.i + 1), m AS (SELECT song, j AS line, i AS item FROM r WHERE j IS NOT NULL) SELECT * FROM m UNION ALL SELECT a.song, i, i FROM a JOIN (SELECT a.song, count(*) AS items, count(key) AS keys, any_value(n) AS lines FROM a JOIN (SELECT song, count(*) AS n FROM b GROUP BY 1) c ON c.song = a.song GROUP BY 1) z ON z.song = a.song WHERE a.song NOT IN (SELECT song FROM m) AND (keys = 0 OR items = lines) AND i <= lines",
    ),
}
