"""Small decisions: notes in key, paired medians, links, spans that are kept, search titles, runs by folder.

Nulls give null, or the value that was there before; of equal choices the first named wins; empty tables
give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.sources.tables import TIMED_SQL, table, timed_lines, work_dir

# Steps of the two scales from their first note.
MAJOR, MINOR = (0, 2, 4, 5, 7, 9, 11), (0, 2, 3, 5, 7, 8, 10)


def in_scale(pitch: Column, tonic: Column, minor: Column) -> Column:
    step = F.pmod(pitch - tonic, F.lit(12))
    return F.when(minor, step.isin(*MINOR)).otherwise(step.isin(*MAJOR))


def snapped_to_key(midi: Column, center: Column, tonic: Column, minor: Column, most: float = 0.6, lead: float = 0.25) -> Column:
    """A note outside its key goes to the neighbour in it that is nearest to where it was sung, if that is
    within most, and not further than the note itself by over lead; of two as near, the lower."""
    sides = F.filter(F.array(midi - 1, midi + 1), lambda m: in_scale(m, tonic, minor) & (F.abs(m - center) <= most))
    best = F.array_min(F.transform(sides, lambda m: F.struct(F.abs(m - center).alias("d"), m.alias("m"))))
    return F.when(~in_scale(midi, tonic, minor) & (best.d <= F.abs(midi - center) + lead), best.m).otherwise(midi)


def paired_median(a: DataFrame, b: DataFrame, key: str, value: str, group: str) -> DataFrame:
    """group, pairs, median of the differences (b less a) of rows with one key."""
    pairs = a.select(group, key, F.col(value).alias("a")).join(b.select(group, key, F.col(value).alias("b")), [group, key])
    return pairs.groupBy(group).agg(F.count(F.lit(1)).alias("pairs"), F.median(F.col("b") - F.col("a")).alias("median"))


def link_verdict(score: Column, second: Column, least: float = 0.55, margin: float = 0.08) -> Column:
    """Whether a cover is linked: its best score is high, and well above the second."""
    return F.when(score < least, "low").when(score - F.coalesce(second, F.lit(0.0)) < margin, "unclear").when(score.isNotNull(), "linked")


def kept_spans(after: DataFrame, before: DataFrame, moved: int) -> DataFrame:
    """song, line, s, e: the earlier span of a line whose start has moved by over moved, else the later."""
    rows = after.join(before.select("song", "line", F.col("s").alias("b_s"), F.col("e").alias("b_e")), ["song", "line"], "left")
    far = F.coalesce(F.abs(F.col("s") - F.col("b_s")) > moved, F.lit(False))
    return rows.select("song", "line", F.when(far, F.col("b_s")).otherwise(F.col("s")).alias("s"), F.when(far, F.col("b_e")).otherwise(F.col("e")).alias("e"))


# Signs that end a title, words that do, and brackets.
SIGNS, GUESTS, OPENING, CLOSING = "/｜|〜", ("feat", "ft"), "【[（(", "】]）)"
_END = rf"[{SIGNS}]|\s-\s|(?<![A-Za-z0-9_])(?:{'|'.join(GUESTS)})"
_ASIDE = "[{0}][^{1}]*[{1}]".format(OPENING.replace("[", "\\["), CLOSING.replace("]", "\\]"))


def search_titles(title: Column) -> Column:
    """What to search for, in order: what stands before the first separator, the title without brackets,
    itself."""
    raw = F.trim(title)
    head = F.regexp_extract(raw, rf"(?i)^(?!{_END})(.+?)(?:{_END})", 1)
    plain = F.regexp_replace(F.regexp_replace(raw, _ASIDE, " "), r"\s+", " ")
    return F.when(title.isNotNull(), F.filter(F.array_distinct(F.array(F.trim(head), F.trim(plain), raw)), lambda x: x != ""))


def runs_by_combo(files: DataFrame) -> DataFrame:
    """first, second, runs, error of run records (path, file: the whole text of a file) in folders named
    first__second; files that aren't JSON with an error are counted apart as broken."""
    combo = F.regexp_extract("path", r"([^/]+)__([^/]+)/[^/]+$", 1), F.regexp_extract("path", r"([^/]+)__([^/]+)/[^/]+$", 2)
    error = F.from_json("file", "mae double")["mae"]
    rows = files.select(combo[0].alias("first"), combo[1].alias("second"), error.alias("mae")).where("first <> ''")
    return rows.groupBy("first", "second").agg(F.count("mae").alias("runs"), F.count_if(F.col("mae").isNull()).alias("broken"), F.round(F.avg("mae"), 6).alias("error"))


def q_snap(spark, d):
    midi = (F.floor("value") % 40 + 40).cast("long")
    center = midi + F.round((F.col("value") - F.floor("value")) * 2 - 1, 3)
    tonic, minor = F.col("song") % 12, F.col("song") % 2 == 1
    t = timed_lines(spark, d).select("song", "line", midi.alias("midi"), center.alias("center"), tonic.alias("tonic"), minor.alias("minor"))
    return t.select("song", "line", "midi", snapped_to_key(F.col("midi"), F.col("center"), F.col("tonic"), F.col("minor")).alias("snapped"))


def q_paired(spark, d):
    t = table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q")).withColumn("key", F.concat_ws("-", "l_orderkey", "l_returnflag"))
    return paired_median(t.where("l_linestatus = 'O'"), t.where("l_linestatus = 'F'"), "key", "q", "l_returnflag")


def q_links(spark, d):
    t = timed_lines(spark, d).groupBy("song").agg(F.array_sort(F.collect_list("value"), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0)).alias("v"))
    return t.select("song", link_verdict(F.get("v", F.lit(0)) / 400, F.get("v", F.lit(1)) / 400).alias("verdict"))


def q_kept(spark, d):
    t = timed_lines(spark, d)
    return kept_spans(t.withColumn("s", F.col("s") + F.floor(F.col("value")).cast("long") * 10_000), t, 200_000)


def q_search_titles(spark, d):
    p = table(spark, d, "part")
    title = F.concat(F.lit(" "), "p_name", F.when(F.col("p_size") % 2 == 0, " feat. ").otherwise(" ["), "p_brand", F.lit("]"))
    return p.select("p_partkey", F.posexplode(search_titles(title)).alias("k", "title"))


def q_runs(spark, d):
    """Orders of twenty groups of customers as run files, of several lines each, in folders by status and
    priority, written as text and read back file by file."""
    o = table(spark, d, "orders")
    path = work_dir(spark)
    folder = F.concat("o_orderstatus", F.lit("__"), F.substring("o_orderpriority", 1, 1))
    each = o.groupBy(folder.alias("folder"), (F.col("o_custkey") % 20).alias("run")).agg(F.max("o_totalprice").alias("mae"), F.count(F.lit(1)).alias("songs"))
    text = F.when(F.col("run") % 7 == 0, F.lit("{\n  broken")).otherwise(F.concat(F.lit('{\n  "songs": '), "songs", F.lit(',\n  "mae": '), F.col("mae").cast("string"), F.lit("\n}")))
    each.select("folder", "run", text.alias("value")).repartition("folder", "run").write.partitionBy("folder", "run").text(path)
    place = F.regexp_replace(F.regexp_replace(F.col("_metadata.file_path"), "folder=", ""), "/run=([^/]*)/[^/]*$", "/$1.json")
    files = spark.read.text(f"{path}/folder=*/run=*", wholetext=True).select(place.alias("path"), F.col("value").alias("file"))
    return runs_by_combo(files)


def q_hashes(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(F.encode("html", "UTF-8")).alias("hash"))


_IN = "list_contains(CASE WHEN minor THEN [0, 2, 3, 5, 7, 8, 10] ELSE [0, 2, 4, 5, 7, 9, 11] END, ({} - tonic + 120) % 12)".format
QUERIES = {
    "snapped_to_key": (
        q_snap,
        f"WITH n AS (SELECT song, line, (floor(value) % 40 + 40)::BIGINT AS midi, (floor(value) % 40 + 40)::BIGINT + round((value - floor(value)) * 2 - 1, 3) AS center, song % 12 AS tonic, song % 2 = 1 AS minor FROM {TIMED_SQL}), c AS (SELECT *, CASE WHEN {_IN('midi - 1')} AND abs(midi - 1 - center) <= 0.6::DOUBLE THEN abs(midi - 1 - center) END AS lo, CASE WHEN {_IN('midi + 1')} AND abs(midi + 1 - center) <= 0.6::DOUBLE THEN abs(midi + 1 - center) END AS hi FROM n) SELECT song, line, midi, CASE WHEN NOT {_IN('midi')} AND least(lo, hi) <= abs(midi - center) + 0.25::DOUBLE THEN CASE WHEN hi IS NULL OR lo <= hi THEN midi - 1 ELSE midi + 1 END ELSE midi END AS snapped FROM c",
    ),
    "paired_median": (
        q_paired,
        "WITH t AS (SELECT l_orderkey, l_returnflag, l_linestatus, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2, 3) SELECT a.l_returnflag, count(*) AS pairs, median(b.q - a.q) AS median FROM t a JOIN t b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = b.l_returnflag AND a.l_linestatus = 'O' AND b.l_linestatus = 'F' GROUP BY 1",
    ),
    "link_verdict": (
        q_links,
        f"WITH v AS (SELECT song, list_reverse_sort(list(value)) AS v FROM {TIMED_SQL} GROUP BY 1) SELECT song, CASE WHEN v[1] / 400 < 0.55::DOUBLE THEN 'low' WHEN v[1] / 400 - coalesce(v[2] / 400, 0) < 0.08::DOUBLE THEN 'unclear' ELSE 'linked' END AS verdict FROM v",
    ),
    "kept_spans": (q_kept, f"SELECT song, line, CASE WHEN floor(value) * 10000 > 200000 THEN s ELSE s + floor(value)::BIGINT * 10000 END AS s, e FROM {TIMED_SQL}"),
    "search_titles": (
        q_search_titles,
        "WITH t AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN [p_name, p_name || ' feat. ' || p_brand || ']'] ELSE [p_name, p_name || ' [' || p_brand || ']'] END AS t FROM part) SELECT p_partkey, unnest([0, 1]) AS k, unnest(t) AS title FROM t",
    ),
    "runs_by_combo": (
        q_runs,
        "SELECT first, second, count(*) FILTER (run % 7 <> 0) AS runs, count(*) FILTER (run % 7 = 0) AS broken, round(avg(mae) FILTER (run % 7 <> 0), 6) AS error FROM (SELECT o_orderstatus AS first, o_orderpriority[1] AS second, o_custkey % 20 AS run, max(o_totalprice) AS mae FROM orders GROUP BY 1, 2, 3) GROUP BY 1, 2",
    ),
    "content_hashes": (q_hashes, "SELECT page_id, md5(html) AS hash FROM pages"),
}
