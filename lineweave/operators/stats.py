"""Robust statistics over groups: medians, error reports, dispersion, gates, scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.sources.tables import TIMED_SQL, table, timed_lines


def geometric_mean(x: Column) -> Column:
    """Over positive values only."""
    return F.exp(F.avg(F.log(F.when(x > 0, x))))


def error_report(df: DataFrame, error: str, *keys: str) -> DataFrame:
    """Median and mean absolute error, signed median, 95th percentile, largest, and the share within 10."""
    a = F.abs(F.col(error))
    return df.groupBy(*keys).agg(
        F.round(F.percentile(a, 0.5), 6).alias("mae"), F.round(F.avg(a), 6).alias("aae"), F.round(F.percentile(error, 0.5), 6).alias("bias"),
        F.round(F.percentile(a, 0.95), 6).alias("p95"), F.max(a).alias("worst"), F.round(F.count_if(a <= 10) / F.count(F.lit(1)), 9).alias("within"),
    )


def scores(df: DataFrame, predicted: str, true: str, *keys: str) -> DataFrame:
    """Counts that add up over parts, then precision, recall and F1."""
    p, t = F.col(predicted), F.col(true)
    c = df.groupBy(*keys).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"))
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 9)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def clamp_outliers(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Of groups of three and more, values over 2.5 medians (4 at least) come down to the median."""
    m = df.groupBy(*keys).agg(F.percentile(value, 0.5).alias("median"), F.count(F.lit(1)).alias("_n"))
    j = df.join(m, list(keys))
    far = (F.col("_n") >= 3) & (F.col(value) > F.greatest(2.5 * F.col("median"), F.lit(4.0)))
    return j.withColumn("clamped", F.when(far, F.col("median")).otherwise(F.col(value))).drop("_n")


def repeat_outlier_clamp(spark, d):
    t = timed_lines(spark, d).select("song", "line", "text", "value")
    return clamp_outliers(t, "value", "song", "text").select("song", "line", F.round("clamped", 6).alias("clamped"))


def geomean_confidence(spark, d):
    t = table(spark, d, "lineitem")
    return t.groupBy("l_returnflag").agg(F.round(geometric_mean(F.col("l_discount")), 9).alias("discount"), F.round(F.avg(F.coalesce(F.when(F.col("l_tax") > 0.02, F.col("l_tax")), F.col("l_discount"))), 9).alias("mixed"))


def log_conf_route(spark, d):
    """Median of the log of a confidence, with a floor, and the route that it takes."""
    c = F.col("value") / 100
    m = table(spark, d, "events").groupBy("user_id").agg(F.percentile(F.when(c > 0, F.log(F.greatest(c, F.lit(1e-6)))).otherwise(math.log(1e-6)), 0.5).alias("m"))
    return m.select("user_id", F.round("m", 9).alias("m"), F.when(F.col("m") < -1.5, "rescue").otherwise("fast").alias("route"))


def coverage_gate(spark, d):
    """Mean value of a user's purchases, or 0 where they are under a fifth of the events."""
    p = F.col("event_type") == "purchase"
    g = table(spark, d, "events").groupBy("user_id").agg(F.count_if(p).alias("n"), F.count(F.lit(1)).alias("all"), F.avg(F.when(p, F.col("value"))).alias("m"))
    return g.select("user_id", F.round(F.when(F.col("n") * 5 >= F.col("all"), F.col("m")).otherwise(0.0), 6).alias("score"))


def q_error_report(spark, d):
    e = table(spark, d, "events").withColumn("error", F.round(F.col("value") - 25, 2))
    return error_report(e, "error", "event_type")


def dispersion(spark, d):
    """Spread of the values of each user and kind: count, median, quartiles' distance, largest, over 50."""
    s = table(spark, d, "events").groupBy("user_id", "event_type").agg((F.max("value") - F.min("value")).alias("spread"))
    q = lambda p: F.percentile("spread", p)
    return s.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(q(0.5), 6).alias("median"), F.round(q(0.75) - q(0.25), 6).alias("iqr"), F.round(F.max("spread"), 6).alias("most"), F.count_if(F.col("spread") > 50).alias("over"))


def promotion_gate(spark, d):
    """Each priority's order prices against the baseline's: kept if mean and 95th percentile are at most
    2 % higher."""
    o = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.percentile("o_totalprice", 0.5).alias("mae"), F.percentile("o_totalprice", 0.95).alias("p95"))
    base = o.where("o_orderpriority LIKE '1%'").select(F.col("mae").alias("m"), F.col("p95").alias("p"))
    ok = (F.col("mae") <= 1.02 * F.col("m")) & (F.col("p95") <= 1.02 * F.col("p"))
    return o.crossJoin(F.broadcast(base)).select("o_orderpriority", F.round("mae", 4).alias("mae"), F.round("p95", 4).alias("p95"), ok.alias("passes"))  # base is one row


def reason_histogram(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


def prf1(spark, d):
    """A toxic-word list as a predictor of the label, by source."""
    j = table(spark, d, "documents").select("doc_id", "source", "text").join(table(spark, d, "labels"), "doc_id")
    p = F.col("text").rlike(r"(?i)\b(idiot|stupid|moron|loser)\b")
    return scores(j.select("source", p.alias("p"), (F.col("toxic") == 1).alias("t")), "p", "t", "source")


T = TIMED_SQL
QUERIES = {
    "repeat_outlier_clamp": (repeat_outlier_clamp, f"WITH m AS (SELECT song, text, quantile_cont(value, 0.5) AS m, count(*) AS n FROM {T} GROUP BY 1, 2) SELECT t.song, line, round(CASE WHEN n >= 3 AND value > greatest(2.5 * m, 4.0) THEN m ELSE value END, 6) AS clamped FROM {T} t JOIN m ON m.song = t.song AND m.text = t.text"),
    "geomean_confidence": (geomean_confidence, "SELECT l_returnflag, round(exp(avg(CASE WHEN l_discount > 0 THEN ln(l_discount) END)), 9) AS discount, round(avg(CASE WHEN l_tax > 0.02 THEN l_tax ELSE l_discount END), 9) AS mixed FROM lineitem GROUP BY 1"),
    "log_conf_route": (log_conf_route, "SELECT user_id, round(m, 9) AS m, CASE WHEN m < -1.5 THEN 'rescue' ELSE 'fast' END AS route FROM (SELECT user_id, quantile_cont(CASE WHEN value > 0 THEN ln(greatest(value / 100, 1e-6)) ELSE ln(1e-6) END, 0.5) AS m FROM events GROUP BY 1)"),
    "coverage_gate": (coverage_gate, "SELECT user_id, round(CASE WHEN count(*) FILTER (event_type = 'purchase') * 5 >= count(*) THEN avg(value) FILTER (event_type = 'purchase') ELSE 0 END, 6) AS score FROM events GROUP BY 1"),
    "error_report": (q_error_report, "WITH e AS (SELECT event_type, round(value - 25, 2) AS x FROM events) SELECT event_type, round(quantile_cont(abs(x), 0.5), 6) AS mae, round(avg(abs(x)), 6) AS aae, round(quantile_cont(x, 0.5), 6) AS bias, round(quantile_cont(abs(x), 0.95), 6) AS p95, max(abs(x)) AS worst, round(count(*) FILTER (abs(x) <= 10) / count(*)::DOUBLE, 9) AS within FROM e GROUP BY 1"),
    "dispersion": (dispersion, "WITH s AS (SELECT user_id, event_type, max(value) - min(value) AS s FROM events GROUP BY 1, 2) SELECT event_type, count(*) AS n, round(quantile_cont(s, 0.5), 6) AS median, round(quantile_cont(s, 0.75) - quantile_cont(s, 0.25), 6) AS iqr, round(max(s), 6) AS most, count(*) FILTER (s > 50) AS over FROM s GROUP BY 1".replace("AS over", 'AS "over"')),
    "promotion_gate": (promotion_gate, "WITH o AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.5) AS mae, quantile_cont(o_totalprice, 0.95) AS p95 FROM orders GROUP BY 1), b AS (SELECT mae AS m, p95 AS p FROM o WHERE o_orderpriority LIKE '1%') SELECT o_orderpriority, round(mae, 4) AS mae, round(p95, 4) AS p95, mae <= 1.02 * m AND p95 <= 1.02 * p AS passes FROM o, b"),
    "reason_histogram": (reason_histogram, "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity)::BIGINT AS quantity FROM lineitem GROUP BY 1, 2"),
    "prf1": (prf1, r"WITH j AS (SELECT source, regexp_matches(text, '(?i)\b(idiot|stupid|moron|loser)\b') AS p, toxic = 1 AS t FROM documents JOIN labels USING (doc_id)), c AS (SELECT source, count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn FROM j GROUP BY 1) SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 9) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, 9) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END, 9) AS f1 FROM c"),
}
