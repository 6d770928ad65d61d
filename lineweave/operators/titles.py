"""Titles of videos looked up in a list of songs.

Titles and songs are made distinct first, so that repeats are looked up once.  Null titles and those
without a letter find nothing; of equal answers the smallest entry wins; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.functions.text import fragments, match_key, title_candidates
from lineweave.sources.tables import table

#: What stands between a title and names in it.
SEPARATORS = r"\s-\s|/|\|"


def asked(titles: DataFrame) -> DataFrame:
    """title, full, keys, pos, q: the keys of a title's candidates, then of its parts between dashes, strokes
    and bars, of two letters at least."""
    found = F.concat(title_candidates(F.col("title")), F.split("title", SEPARATORS))
    keys = F.filter(F.array_distinct(F.transform(found, match_key)), lambda k: F.length(k) >= 2)
    rows = titles.select("title").where("title IS NOT NULL").distinct().select("title", match_key(F.col("title")).alias("full"), keys.alias("keys"))
    return rows.select("*", F.posexplode("keys").alias("pos", "q"))


def held_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct keys of which one holds the other and has at most twice its length.  The
    one that is held is met at the two letters that the fewest keys of the other side have."""

    def met(short: DataFrame, long: DataFrame, s: str, n: str) -> DataFrame:
        every = fragments(long, n, 2)
        of = fragments(short, s, 2).join(every.groupBy("fragment").agg(F.count(F.lit(1)).alias("df")), "fragment", "left")
        rare = of.groupBy(s).agg(F.min_by("fragment", F.struct(F.coalesce("df", F.lit(0)), "fragment")).alias("fragment"))
        return rare.join(every, "fragment").where(F.contains(n, s) & (2 * F.length(s) >= F.length(n))).select("a", "b")

    return met(a, b, "a", "b").unionByName(met(b, a, "b", "a")).distinct()


def look_up(titles: DataFrame, songs: DataFrame, singers: tuple[str, ...] = ()) -> DataFrame:
    """title, entry, exact: for each title the song (entry, name, alias, slug) one of whose names is its first
    candidate that is one; of several, the one with the most other candidates in its names.  Else the song
    with the longest name that holds a candidate or stands in it, but neither one that covers only half of
    the candidate, nor one for what may be an artist: the rest of a longer name has to be in the title.
    Keys of singers alone count for nothing unless they are the whole title."""
    q = asked(titles).where(~F.col("q").isin(*singers) | (F.col("q") == F.col("full"))) if singers else asked(titles)
    names = songs.select("entry", match_key(F.concat_ws(" ", "name", "alias", "slug")).alias("hay"), *[match_key(F.col(c)).alias(c) for c in ("name", "alias", "slug")])
    every = names.select("entry", "hay", F.explode(F.array_distinct(F.array("name", "alias", "slug"))).alias("q")).where("length(q) >= 2")
    every = every.groupBy("q", "hay").agg(F.min("entry").alias("entry"))
    others = F.size(F.filter("keys", lambda k: (k != F.col("q")) & (F.length(k) >= 3) & F.contains(F.col("hay"), k)))
    exact = q.join(every, "q").groupBy("title").agg(F.min_by("entry", F.struct("pos", -others, "entry")).alias("entry"))

    rest = q.join(exact, "title", "left_anti")
    own = names.select("entry", F.explode(F.array_distinct(F.array("name", "alias"))).alias("b")).where("length(b) >= 2").groupBy("b").agg(F.min("entry").alias("entry"))
    near = rest.join(held_keys(rest.select(F.col("q").alias("a")).distinct(), own.select("b")).withColumnRenamed("a", "q"), "q").join(own, "b")
    if singers:
        near = near.where(~F.col("b").isin(*singers) | (F.col("b") == F.col("full")))
    half = F.contains("q", "b") & (F.col("b") != F.col("q")) & (2 * F.length("b") <= F.length("q"))
    at = F.instr(F.col("b"), F.col("q"))
    left = F.concat(F.substr("b", F.lit(1), at - 1), F.substr("b", at + F.length("q")))
    artist = F.contains("b", "q") & (F.col("b") != F.col("q")) & (F.col("q") != F.col("full")) & (F.length(left) >= 2) & ~F.contains(F.col("full"), left)
    close = near.where(~half & ~artist).groupBy("title").agg(F.min_by("entry", F.struct("pos", -F.length("b"), "entry")).alias("entry"))
    return exact.withColumn("exact", F.lit(True)).unionByName(close.withColumn("exact", F.lit(False)))


def _title() -> Column:
    k = F.col("p_size") % 3
    return F.when(k == 0, F.concat("p_name", F.lit(" - "), "p_brand")).when(k == 1, F.concat("p_name", F.lit("s ("), "p_type", F.lit(")"))).otherwise(F.concat("p_brand", F.lit(" / "), "p_name"))


def q_title_lookup(spark, d):
    """Names of parts with something before or behind them, looked up among all parts."""
    p = table(spark, d, "part")
    songs = p.select(F.col("p_partkey").alias("entry"), F.col("p_name").alias("name"), F.concat("p_type", F.lit(" "), "p_brand").alias("alias"), F.concat("p_brand", F.lit(" "), "p_name").alias("slug"))
    return look_up(p.select(_title().alias("title")), songs)


K = "lower(regexp_replace({}, '[^a-zA-Z0-9]', '', 'g'))".format
QUERIES = {
    "title_lookup": (
        q_title_lookup,
        f"""WITH s AS (SELECT p_partkey AS entry, {K("p_name")} AS name, {K("p_type || p_brand")} AS alias, {K("p_brand || p_name")} AS slug, {K("p_name || p_type || p_brand || p_brand || p_name")} AS hay FROM part),
t AS (SELECT DISTINCT CASE p_size % 3 WHEN 0 THEN p_name || ' - ' || p_brand WHEN 1 THEN p_name || 's (' || p_type || ')' ELSE p_brand || ' / ' || p_name END AS title FROM part),
c AS (SELECT title, {K("title")} AS x, min(pos) AS pos, q FROM (SELECT title, 0 AS pos, {K("title")} AS q FROM t UNION ALL SELECT title, 1, {K("regexp_replace(title, '[(].*[)]', '')")} FROM t UNION ALL SELECT title, 2, {K("string_split(title, ' - ')[1]")} FROM t UNION ALL SELECT title, 3 + i, {K("regexp_split_to_array(title, '[ ]-[ ]|/')[i + 1]")} FROM t, range(2) r(i)) WHERE length(q) >= 2 GROUP BY 1, 2, 4),
n AS (SELECT q, hay, min(entry) AS entry FROM (SELECT entry, hay, unnest([name, alias, slug]) AS q FROM s) GROUP BY 1, 2),
e AS (SELECT c.title, n.entry, c.pos, (SELECT count(*) FROM c o WHERE o.title = c.title AND o.q <> c.q AND length(o.q) >= 3 AND contains(n.hay, o.q)) AS others FROM c JOIN n ON n.q = c.q),
f AS (SELECT title, entry FROM e QUALIFY row_number() OVER (PARTITION BY title ORDER BY pos, others DESC, entry) = 1),
b AS (SELECT b, min(entry) AS entry FROM (SELECT entry, unnest([name, alias]) AS b FROM s) GROUP BY 1),
h AS (SELECT c.title, c.pos, b.b, b.entry FROM c JOIN b ON (contains(b.b, c.q) OR contains(c.q, b.b)) AND 2 * length(b.b) >= length(c.q) AND 2 * length(c.q) >= length(b.b) WHERE c.title NOT IN (SELECT title FROM f) AND NOT (contains(c.q, b.b) AND b.b <> c.q AND 2 * length(b.b) <= length(c.q)) AND NOT (contains(b.b, c.q) AND b.b <> c.q AND c.q <> c.x AND length(b.b) - length(c.q) >= 2 AND NOT contains(c.x, b.b[:strpos(b.b, c.q) - 1] || b.b[strpos(b.b, c.q) + length(c.q):])))
SELECT title, entry, true AS exact FROM f UNION ALL SELECT title, entry, false FROM h QUALIFY row_number() OVER (PARTITION BY title ORDER BY pos, length(b) DESC, entry) = 1""",
    ),
}
