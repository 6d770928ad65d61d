"""Relational layer: newest rows, existence, queues, quotas, versions, and changes as new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineweave.sources.tables import micros, table

DAY = 86_400_000_000


def newest(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """All rows that have their key's largest value; equal ones stay.  A maximum and a join, so that a
    hot key isn't gathered in one task."""
    top = df.groupBy(*keys).agg(F.max(by).alias("_top"))
    return df.join(top, keys).where(F.col(by) == F.col("_top")).drop("_top")


def newest_one(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first in the given order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def top_per_key(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place", place.cast("long")).where(F.col("place") <= n)


def exists_map(keys: DataFrame, key: str, facts: DataFrame, fact_key: str, name: str) -> DataFrame:
    """Whether each key has a fact, as a boolean."""
    known = facts.select(F.col(fact_key).alias(key)).distinct().withColumn("_known", F.lit(True))
    return keys.join(known, key, "left").withColumn(name, F.coalesce("_known", F.lit(False))).drop("_known")


def count_at_most(df: DataFrame, by: str, name: str, bucket: Column) -> DataFrame:
    """How many rows have at most this row's value.  bucket ascends with it and has a bounded number of
    values (days, say): one window runs over buckets, the other inside each."""
    df = df.withColumn("_b", bucket)
    per = df.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = per.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.count(F.lit(1)).over(Window.partitionBy("_b").orderBy(by))  # equal values are peers
    return df.withColumn("_in", inside).join(F.broadcast(before), "_b").withColumn(name, F.col("_before") + F.col("_in")).drop("_b", "_in", "_before")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of changes, and those of base without one."""
    return base.join(changes, keys, "left_anti").select(*base.columns).unionByName(changes)


def delete_with(df: DataFrame, gone: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows without a partner among those that go; on maps columns of df to columns of gone."""
    keys = gone.select(*(F.col(v).alias(k) for k, v in on.items())).distinct()
    return df.join(keys, list(on), "left_anti")


def orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").withColumn("at", micros("o_orderdate"))


def latest_per_key(spark, d):
    return newest(orders(spark, d), ["o_custkey"], "at").select("o_custkey", "o_orderkey", "at")


def latest_titled_dedup(spark, d):
    rows = orders(spark, d).where("o_orderpriority IS NOT NULL")
    one = newest_one(rows, ["o_custkey"], F.desc("at"), F.desc("o_orderkey"))
    return one.select("o_custkey", "o_orderkey", "at").orderBy(F.desc("at"), "o_custkey").limit(100)


def exists_batch(spark, d):
    return exists_map(table(spark, d, "customer").select("c_custkey"), "c_custkey", table(spark, d, "orders").where("o_orderstatus = 'F'"), "o_custkey", "found")


def newest_with_exclusion(spark, d):
    """For each part, the newest other part of its brand."""
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_partkey"))
    parts = table(spark, d, "part").select("p_partkey", "p_brand")
    two = parts.withColumn("_r", F.row_number().over(w)).where("_r <= 2").groupBy("p_brand").agg(F.max("p_partkey").alias("a"), F.min("p_partkey").alias("b"))
    other = F.when(F.col("p_partkey") != F.col("a"), F.col("a")).when(F.col("a") != F.col("b"), F.col("b"))
    return parts.join(two, "p_brand").select("p_partkey", other.alias("other"))


def queue_position(spark, d):
    """How many queued rows are as old as this one or older, this one included."""
    queued = orders(spark, d).where("o_orderstatus = 'P'").select("o_orderkey", "at")
    return count_at_most(queued, "at", "position", F.floor(F.col("at") / (30 * DAY))).select("o_orderkey", "position")


def oldest_queued(spark, d):
    queued = orders(spark, d).where("o_orderstatus = 'P'")
    return newest_one(queued, ["o_orderpriority"], "at", "o_orderkey").select("o_orderpriority", "o_orderkey")


def stale_processing(spark, d):
    cutoff = F.lit("1997-01-01 00:00:00").cast("timestamp_ntz")
    return table(spark, d, "orders").where((F.col("o_orderstatus") == "P") & (F.col("o_orderdate") < cutoff)).select("o_orderkey", F.lit("failed").alias("status"))


def active_notices(spark, d):
    ends = F.when(F.col("p_size") % 3 == 0, F.lit(None)).otherwise(F.col("p_size"))
    rows = table(spark, d, "part").withColumn("ends", ends)
    return rows.where((F.col("p_size") > 10) & (F.col("ends").isNull() | (F.col("ends") > 25))).select("p_partkey", "ends")


def quota_24h(spark, d):
    """Of each user's day up to its last event: clicks, views, the larger count, and when the quota
    opens again (the oldest event of the larger kind plus a day; of equal ones the later)."""
    e = table(spark, d, "events").select("user_id", "event_type", micros("ts").alias("at"))
    last = e.groupBy("user_id").agg(F.max("at").alias("now"))
    day = e.join(last, "user_id").where(F.col("at") >= F.col("now") - DAY)

    def n(kind: str) -> Column:
        return F.count_if(F.col("event_type") == kind)

    def oldest(kind: str) -> Column:
        return F.min(F.when(F.col("event_type") == kind, F.col("at")))

    c = day.groupBy("user_id").agg(n("click").alias("clicks"), n("view").alias("views"), oldest("click").alias("c"), oldest("view").alias("v"))
    reset = F.when(F.col("clicks") > F.col("views"), F.col("c")).when(F.col("views") > F.col("clicks"), F.col("v")).otherwise(F.greatest("c", "v"))
    return c.select("user_id", "clicks", "views", F.greatest("clicks", "views").alias("used"), (reset + DAY).alias("reset_at"))


def recent_median_eta(spark, d):
    """Median of the last 20 values of each kind and label; of fewer than 5, that of the kind."""
    e = table(spark, d, "events").select("user_id", "event_type", micros("ts").alias("at"), "event_id", "value").withColumn("depth", F.pmod("user_id", F.lit(25)))
    last = top_per_key(e, ["event_type", "depth"], 20, F.desc("at"), F.desc("event_id"))
    own = last.groupBy("event_type", "depth").agg(F.percentile("value", 0.5).alias("m"), F.count(F.lit(1)).alias("n"))
    every = top_per_key(e, ["event_type"], 20, F.desc("at"), F.desc("event_id")).groupBy("event_type").agg(F.percentile("value", 0.5).alias("all_m"))
    return own.join(F.broadcast(every), "event_type").select("event_type", "depth", F.round(F.when(F.col("n") >= 5, F.col("m")).otherwise(F.col("all_m")), 6).alias("eta"))


def views_default_zero(spark, d):
    seen = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "customer").select("c_custkey").join(seen, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("views"))


def versions_top10(spark, d):
    return top_per_key(orders(spark, d), ["o_custkey"], 10, F.desc("at"), F.desc("o_orderkey")).select("o_custkey", "place", "o_orderkey")


def snapshot_changes(spark, d):
    """The version before each change of the payload."""
    w = Window.partitionBy("o_custkey").orderBy("at", "o_orderkey")
    rows = orders(spark, d).select("o_custkey", "o_orderkey", "o_orderpriority", F.lag("o_orderkey").over(w).alias("before"), F.lag("o_orderpriority").over(w).alias("was"))
    return rows.where("was <> o_orderpriority").select("o_custkey", "o_orderkey", "before", "was")


def verified_exists(spark, d):
    rich = table(spark, d, "supplier").where("s_acctbal > 5000")
    return exists_map(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey", rich, "s_nationkey", "verified")


def cascade_delete_anti(spark, d):
    gone = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return delete_with(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), gone, {"l_orderkey": "o_orderkey"})


def delete_either_endpoint(spark, d):
    gone = table(spark, d, "nation").where("n_regionkey = 1").select("n_nationkey")
    links = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("a"), F.pmod(F.col("s_suppkey"), F.lit(25)).cast("int").alias("b"))
    return delete_with(delete_with(links, gone, {"a": "n_nationkey"}), gone, {"b": "n_nationkey"})


def upsert_latest_wins(spark, d):
    base = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    news = table(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderpriority", "o_orderkey").alias("c_mktsegment"))
    return upsert(base, news, ["c_custkey"])


def cooldown_pairs(spark, d):
    """Events that come less than three days after the one of the same user and kind before."""
    w = Window.partitionBy("user_id", "event_type").orderBy("at", "event_id")
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", micros("ts").alias("at"))
    return e.withColumn("since", F.col("at") - F.lag("at").over(w)).where(F.col("since") < 3 * DAY).select("event_id", "since")


def suffix_split(spark, d):
    name = F.col("event_type")
    e = table(spark, d, "events").groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    cut = F.right(name, F.lit(2)) == "ck"
    return e.select(F.when(cut, F.left(name, F.length(name) - 2)).otherwise(name).alias("base"), F.when(cut, F.lit("ck")).alias("variant"), "n")


def two_tier_lookup(spark, d):
    """By customer and priority if there is such an order, else by customer alone; the first by key."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    strict = o.groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("strict"))
    loose = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("loose"))
    c = table(spark, d, "customer").select("c_custkey", F.concat_ws("-", F.pmod("c_custkey", F.lit(5)) + 1, F.element_at(F.array(*map(F.lit, ["URGENT", "HIGH", "MEDIUM", "NOT SPECIFIED", "LOW"])), (F.pmod("c_custkey", F.lit(5)) + 1).cast("int"))).alias("wanted"))
    a = c.join(strict, (c.c_custkey == strict.o_custkey) & (c.wanted == strict.o_orderpriority), "left").drop("o_custkey")
    b = a.join(loose, a.c_custkey == loose.o_custkey, "left")
    return b.select("c_custkey", F.coalesce("strict", "loose").alias("o_orderkey"), F.when(F.col("strict").isNotNull(), "strict").when(F.col("loose").isNotNull(), "loose").alias("tier"))


def restart_recovery(spark, d):
    status = F.col("o_orderstatus")
    now = F.when(status == "P", "failed").when(status == "O", "queued").otherwise(status)
    return table(spark, d, "orders").groupBy(now.alias("status")).agg(F.count(F.lit(1)).alias("n"))


AT = "epoch_us(o_orderdate)"
QUERIES = {
    "latest_per_key": (latest_per_key, f"SELECT o_custkey, o_orderkey, {AT} AS at FROM orders WHERE ({AT}) = (SELECT max(epoch_us(x.o_orderdate)) FROM orders x WHERE x.o_custkey = orders.o_custkey)"),
    "latest_titled_dedup": (latest_titled_dedup, f"SELECT o_custkey, o_orderkey, {AT} AS at FROM orders WHERE o_orderpriority IS NOT NULL QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 ORDER BY 3 DESC, 1 LIMIT 100"),
    "exists_batch": (exists_batch, "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS found FROM customer"),
    "newest_with_exclusion": (newest_with_exclusion, "SELECT p.p_partkey, max(q.p_partkey) AS other FROM part p LEFT JOIN part q ON p.p_brand = q.p_brand AND p.p_partkey <> q.p_partkey GROUP BY p.p_partkey"),
    "queue_position": (queue_position, "WITH q AS (SELECT * FROM orders WHERE o_orderstatus = 'P') SELECT a.o_orderkey, (SELECT count(*) FROM q b WHERE b.o_orderdate <= a.o_orderdate AND b.o_orderkey <> a.o_orderkey) + 1 AS position FROM q a"),
    "oldest_queued": (oldest_queued, "SELECT o_orderpriority, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders WHERE o_orderstatus = 'P' GROUP BY 1"),
    "stale_processing": (stale_processing, "SELECT o_orderkey, 'failed' AS status FROM orders WHERE o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1997-01-01'"),
    "active_notices": (active_notices, "SELECT * FROM (SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_size END AS ends FROM part WHERE p_size > 10) WHERE ends IS NULL OR ends > 25"),
    "quota_24h": (quota_24h, f"WITH e AS (SELECT user_id, event_type, epoch_us(ts) AS t, max(epoch_us(ts)) OVER (PARTITION BY user_id) AS now FROM events), c AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'view') AS views, min(t) FILTER (event_type = 'click') AS c, min(t) FILTER (event_type = 'view') AS v FROM e WHERE t >= now - {DAY} GROUP BY user_id) SELECT user_id, clicks, views, greatest(clicks, views) AS used, CASE WHEN clicks > views THEN c WHEN views > clicks THEN v ELSE greatest(c, v) END + {DAY} AS reset_at FROM c"),
    "recent_median_eta": (recent_median_eta, "WITH e AS (SELECT event_type, user_id % 25 AS depth, value, row_number() OVER (PARTITION BY event_type, user_id % 25 ORDER BY ts DESC, event_id DESC) AS r, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS g FROM events), a AS (SELECT event_type, quantile_cont(value, 0.5) AS m FROM e WHERE g <= 20 GROUP BY 1) SELECT event_type, depth, round(CASE WHEN count(*) >= 5 THEN quantile_cont(value, 0.5) ELSE any_value(a.m) END, 6) AS eta FROM e JOIN a USING (event_type) WHERE r <= 20 GROUP BY 1, 2"),
    "views_default_zero": (views_default_zero, "SELECT c_custkey, count(o_orderkey) AS views FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
    "versions_top10": (versions_top10, "SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place, o_orderkey FROM orders QUALIFY place <= 10"),
    "snapshot_changes": (snapshot_changes, "WITH x AS (SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER w AS before, lag(o_orderpriority) OVER w AS was, o_orderpriority FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) SELECT o_custkey, o_orderkey, before, was FROM x WHERE was <> o_orderpriority"),
    "verified_exists": (verified_exists, "SELECT n_nationkey, n_name, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000) AS verified FROM nation"),
    "cascade_delete_anti": (cascade_delete_anti, "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')"),
    "delete_either_endpoint": (delete_either_endpoint, "WITH l AS (SELECT s_suppkey, s_nationkey AS a, (s_suppkey % 25)::INT AS b FROM supplier), g AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1) SELECT s_suppkey, a, b FROM l WHERE a NOT IN (SELECT k FROM g) AND b NOT IN (SELECT k FROM g)"),
    "upsert_latest_wins": (upsert_latest_wins, "SELECT c_custkey, coalesce((SELECT arg_max(o_orderpriority, o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P'), c_mktsegment) AS c_mktsegment FROM customer UNION SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) FROM orders WHERE o_orderstatus = 'P' AND o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY 1"),
    "cooldown_pairs": (cooldown_pairs, f"SELECT * FROM (SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS since FROM events) WHERE since < 3 * {DAY}"),
    "suffix_split": (suffix_split, "SELECT CASE WHEN right(event_type, 2) = 'ck' THEN left(event_type, length(event_type) - 2) ELSE event_type END AS base, CASE WHEN right(event_type, 2) = 'ck' THEN 'ck' END AS variant, count(*) AS n FROM events GROUP BY event_type"),
    "two_tier_lookup": (two_tier_lookup, "WITH c AS (SELECT c_custkey, (c_custkey % 5 + 1) || '-' || ['URGENT', 'HIGH', 'MEDIUM', 'NOT SPECIFIED', 'LOW'][(c_custkey % 5 + 1)::INT] AS wanted FROM customer), x AS (SELECT c_custkey, min(o_orderkey) FILTER (o_orderpriority = wanted) AS strict, min(o_orderkey) AS loose FROM c LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) SELECT c_custkey, coalesce(strict, loose) AS o_orderkey, CASE WHEN strict IS NOT NULL THEN 'strict' WHEN loose IS NOT NULL THEN 'loose' END AS tier FROM x"),
    "restart_recovery": (restart_recovery, "SELECT CASE o_orderstatus WHEN 'P' THEN 'failed' WHEN 'O' THEN 'queued' ELSE o_orderstatus END AS status, count(*) AS n FROM orders GROUP BY 1"),
}
