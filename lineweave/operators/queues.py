"""Claims on queues of jobs.

Rows are (song, line, s, kind): a queue, a number, a time and what happens.  All is windows by queue; rows
with a null time are left out, of equal times the smaller number is first, an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineweave.operators.intervals import by_start
from lineweave.sources.tables import TIMED_SQL, timed_lines


def served(rows: DataFrame, job: str, ask: str) -> DataFrame:
    """ask and n of the rows of kind ask that find a job of this kind waiting: the n-th gets the n-th job.
    What waits is the balance of jobs and asks above its lowest point so far."""
    w = by_start()
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.where(F.col("kind").isin(job, ask))
    rows = rows.withColumn("balance", F.sum(F.when(F.col("kind") == job, 1).otherwise(-1)).over(so_far))
    rows = rows.withColumn("floor", F.least(F.lit(0), F.min("balance").over(so_far)))
    hit = (F.col("kind") == ask) & (F.col("floor") == F.coalesce(F.lag("floor").over(w), F.lit(0)))
    rows = rows.withColumn("hit", hit).where("hit")
    return rows.select("song", F.col("line").alias("ask"), F.row_number().over(w).alias("n"))


def claims(rows: DataFrame, kinds: tuple[str, ...], ask: str) -> DataFrame:
    """song, ask, job: the oldest waiting job that each ask gets, of the first kind that has one; null
    where nothing waits."""
    rows = rows.where("s IS NOT NULL")
    left, found = rows, None
    for kind in kinds:
        jobs = rows.where(F.col("kind") == kind).select("song", F.col("line").alias("job"), F.row_number().over(by_start()).alias("n"))
        got = served(left, kind, ask).join(jobs, ["song", "n"]).select("song", "ask", "job")
        found = got if found is None else found.unionByName(got)
        left = left.join(got.select("song", F.col("ask").alias("line")), ["song", "line"], "left_anti")
    return rows.where(F.col("kind") == ask).select("song", F.col("line").alias("ask")).join(found, ["song", "ask"], "left")


QUERIES = {
    "fifo_claims": (
        lambda spark, d: claims(timed_lines(spark, d).withColumnRenamed("text", "kind"), ("click", "view"), "purchase"),
        f"WITH RECURSIVE r AS (SELECT song, line, text, row_number() OVER (PARTITION BY song ORDER BY s, line) AS i FROM {TIMED_SQL} WHERE text IN ('click', 'view', 'purchase')), f AS (SELECT song, 0::BIGINT AS i, []::BIGINT[] AS a, []::BIGINT[] AS b, NULL::BIGINT AS ask, NULL::BIGINT AS job FROM r WHERE i = 1 UNION ALL SELECT r.song, r.i, CASE WHEN r.text = 'click' THEN list_append(a, r.line) WHEN r.text = 'purchase' THEN a[2:] ELSE a END, CASE WHEN r.text = 'view' THEN list_append(b, r.line) WHEN r.text = 'purchase' AND len(a) = 0 THEN b[2:] ELSE b END, CASE WHEN r.text = 'purchase' THEN r.line END, CASE WHEN r.text = 'purchase' THEN coalesce(a[1], b[1]) END FROM f JOIN r ON r.song = f.song AND r.i = f.i + 1) SELECT song, ask, job FROM f WHERE ask IS NOT NULL",
    ),
}
