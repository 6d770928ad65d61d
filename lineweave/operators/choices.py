"""Rankings, priorities, sets and decisions: which candidate, which layer, which request goes through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.operators.relational import DAY, newest_one, orders, top_per_key
from lineweave.sources.tables import micros, table


def fused(sources: list[DataFrame], key: str, id_: str, cap: int) -> DataFrame:
    """(key, id) rows of several sources, the first named first; each id once, cap of them for each key."""
    both = sources[0].select(key, id_, F.lit(0).alias("source"))
    for i, s in enumerate(sources[1:], 1):
        both = both.unionByName(s.select(key, id_, F.lit(i).alias("source")))
    once = both.groupBy(key, id_).agg(F.min("source").alias("source"))
    return top_per_key(once, [key], cap, F.col("source"), F.col(id_))


def decision(pending: Column, recent: Column, capped: Column) -> Column:
    """The first that holds, else the request is submitted."""
    return F.when(pending, "pending").when(recent, "cooldown").when(capped, "capped").otherwise("submitted")


def signed_ranks(df: DataFrame, difference: str, *keys: str) -> DataFrame:
    """Wilcoxon's sum of ranks of positive differences, doubled so that tied (average) ranks are whole,
    and the number of differences that aren't 0."""
    d = df.where(F.col(difference) != 0).withColumn("_a", F.abs(difference))
    # ranks from counts by distinct size: equal differences are one row before the window
    sizes = d.groupBy(*keys, "_a").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(difference) > 0).alias("_up"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_a").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = sizes.withColumn("_r", 2 * before + F.col("_n") + 1)
    return ranked.groupBy(*keys).agg(F.sum(F.col("_r") * F.col("_up")).alias("w2"), F.sum("_n").alias("n"))


def candidate_score(spark, d):
    """The best part of each brand: a base, and more for a steel kind, a name with two words, and price tiers."""
    p = table(spark, d, "part")
    score = 10 + F.when(F.contains("p_type", F.lit("STEEL")), 15).otherwise(0) + F.when(F.contains("p_name", F.lit(" ")), 20).otherwise(0) + F.when(F.col("p_retailprice") >= 1500, 5).when(F.col("p_retailprice") >= 1200, 2).otherwise(0)
    best = newest_one(p.withColumn("score", score), ["p_brand"], F.desc("score"), F.desc("p_retailprice"), F.col("p_partkey"))
    return best.select("p_brand", "p_partkey", "score")


def track_order(spark, d):
    """Up to three suppliers of a nation: those with a balance first, then by name."""
    s = table(spark, d, "supplier")
    return top_per_key(s, ["s_nationkey"], 3, F.col("s_acctbal") < 0, F.col("s_name")).select("s_nationkey", "place", "s_suppkey")


def candidate_fusion(spark, d):
    """Up to five orders of a customer: the largest, then the newest three, then queued ones."""
    o = orders(spark, d)
    first = newest_one(o, ["o_custkey"], F.desc("o_totalprice"), F.col("o_orderkey"))
    new = top_per_key(o, ["o_custkey"], 3, F.desc("at"), F.desc("o_orderkey"))
    return fused([first, new, o.where("o_orderstatus = 'P'")], "o_custkey", "o_orderkey", 5).select("o_custkey", "place", "o_orderkey", "source")


def layer_resolution(spark, d):
    """For each nation its richest customer of each segment, as one line of text."""
    best = newest_one(table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"], F.desc("c_acctbal"), F.col("c_custkey"))
    by = best.groupBy("c_nationkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("c_mktsegment", "c_custkey")))).alias("m"))
    return by.select("c_nationkey", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";").alias("layers"))


def common_keys(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey")).intersect(table(spark, d, "supplier").select("s_nationkey"))


def missing_keys(spark, d):
    """Customers without a queued order: what a resumed run still has to do."""
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


def ordered_unique(spark, d):
    """Event types of a user in order of their first event."""
    first = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min(F.struct(micros("ts").alias("at"), "event_id")).alias("f"))
    return first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("f", "event_type"))).alias("t")).select("user_id", F.array_join("t.event_type", ",").alias("types"))


def sliding_quota(spark, d):
    """How many actions of its kind a user had in the 24 hours up to each, and whether that is over 3."""
    w = Window.partitionBy("user_id", "event_type").orderBy("at").rangeBetween(-DAY, 0)
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", micros("ts").alias("at"))
    return e.withColumn("used", F.count(F.lit(1)).over(w)).select("event_id", "used", (F.col("used") > 3).alias("refused"))


def dispatch(spark, d):
    """What becomes of each event as a request."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", micros("ts").alias("at"))
    since = F.col("at") - F.lag("at").over(Window.partitionBy("user_id", "event_type").orderBy("at", "event_id"))
    day = F.count(F.lit(1)).over(Window.partitionBy("user_id").orderBy("at").rangeBetween(-DAY, 0))
    e = e.withColumns({"since": since, "day": day})
    return e.select("event_id", decision(F.coalesce(F.col("since") < DAY, F.lit(False)), F.coalesce(F.col("since") < 3 * DAY, F.lit(False)), F.col("day") > 3).alias("decision"))


def wilcoxon(spark, d):
    """Taxes against discounts, line by line, by return flag."""
    t = table(spark, d, "lineitem").select("l_returnflag", F.round((F.col("l_tax") - F.col("l_discount")) * 100).cast("long").alias("diff"))
    return signed_ranks(t, "diff", "l_returnflag")


def conditional_update(spark, d):
    """Only queued rows change; a missing value keeps the old one."""
    o = table(spark, d, "orders")
    queued = F.col("o_orderstatus") == "P"
    new = F.when(queued & (F.col("o_totalprice") > 100_000), "1-URGENT")
    return o.select("o_orderkey", F.when(queued, "R").otherwise(F.col("o_orderstatus")).alias("status"), F.coalesce(new, F.col("o_orderpriority")).alias("priority"))


def pipeline_age(spark, d):
    """Rows by a JSON path: old ones lack it or have less than 50 there."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy(F.when(k.isNull() | (k < 50), "old").otherwise("new").alias("age"), "event_type").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "candidate_score": (candidate_score, "SELECT p_brand, p_partkey, score FROM (SELECT *, 10 + CASE WHEN contains(p_type, 'STEEL') THEN 15 ELSE 0 END + CASE WHEN contains(p_name, ' ') THEN 20 ELSE 0 END + CASE WHEN p_retailprice >= 1500 THEN 5 WHEN p_retailprice >= 1200 THEN 2 ELSE 0 END AS score FROM part) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_retailprice DESC, p_partkey) = 1"),
    "track_order": (track_order, "SELECT s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal < 0, s_name) AS place, s_suppkey FROM supplier QUALIFY place <= 3"),
    "candidate_fusion": (candidate_fusion, "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS big, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS new FROM orders), s AS (SELECT o_custkey, o_orderkey, CASE WHEN big = 1 THEN 0 WHEN new <= 3 THEN 1 WHEN o_orderstatus = 'P' THEN 2 END AS source FROM r) SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY source, o_orderkey) AS place, o_orderkey, source FROM s WHERE source IS NOT NULL QUALIFY place <= 5"),
    "layer_resolution": (layer_resolution, "SELECT c_nationkey, string_agg(c_mktsegment || '=' || c_custkey, ';' ORDER BY c_mktsegment) AS layers FROM (SELECT * FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal DESC, c_custkey) = 1) GROUP BY 1"),
    "common_keys": (common_keys, "SELECT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier"),
    "missing_keys": (missing_keys, "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"),
    "ordered_unique": (ordered_unique, "SELECT user_id, string_agg(event_type, ',' ORDER BY t, i) AS types FROM (SELECT user_id, event_type, min(ts) AS t, arg_min(event_id, (ts, event_id)) AS i FROM events GROUP BY 1, 2) GROUP BY 1"),
    "sliding_quota": (sliding_quota, f"SELECT event_id, used, used > 3 AS refused FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS used FROM events)"),
    "dispatch": (dispatch, f"WITH e AS (SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS since, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS day FROM events) SELECT event_id, CASE WHEN since < {DAY} THEN 'pending' WHEN since < 3 * {DAY} THEN 'cooldown' WHEN day > 3 THEN 'capped' ELSE 'submitted' END AS decision FROM e"),
    "wilcoxon": (wilcoxon, "WITH d AS (SELECT l_returnflag, round((l_tax - l_discount) * 100)::BIGINT AS d FROM lineitem), r AS (SELECT *, 2 * rank() OVER (PARTITION BY l_returnflag ORDER BY abs(d)) + count(*) OVER (PARTITION BY l_returnflag, abs(d)) - 1 AS r2 FROM d WHERE d <> 0) SELECT l_returnflag, sum(CASE WHEN d > 0 THEN r2 ELSE 0 END)::BIGINT AS w2, count(*) AS n FROM r GROUP BY 1"),
    "conditional_update": (conditional_update, "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'R' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'P' AND o_totalprice > 100000 THEN '1-URGENT' ELSE o_orderpriority END AS priority FROM orders"),
    "pipeline_age": (pipeline_age, "SELECT CASE WHEN json_extract(props, '$.k')::BIGINT >= 50 THEN 'new' ELSE 'old' END AS age, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
}
