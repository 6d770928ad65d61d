"""Translations, pronunciations and confidences as layers over lines: keys by which lines are the same,
joins by number, adoption from other versions, what is shown, and scores that compare.

Nulls: a null text has the key of an empty one; a missing translation or pronunciation isn't shown.  Of
rows with equal times the smaller key is first.  An empty table gives no rows.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.sources.tables import LYRICS_SQL, TIMED_SQL, by_song, dealt, lyric_lines, table, timed_lines

#: The punctuation that a loose key doesn't have.
LOOSE_MARKS = ".,!?、。！？…‥・「」『』（）()‘’“”'\""


def compatible(text: pd.Series) -> pd.Series:
    """Compatibility composition (NFKC), without format characters; a batch at a time."""

    class Kept(dict):
        def __missing__(self, c: int) -> int | None:
            self[c] = None if unicodedata.category(chr(c)) == "Cf" else c
            return self[c]

    keep = Kept()

    def plain(t: str) -> str:
        return t if t.isascii() else unicodedata.normalize("NFKC", t).translate(keep)

    return text.fillna("").map(plain)


def composed(text: pd.Series) -> pd.Series:
    """Canonical composition (NFC); a batch at a time."""
    return text.fillna("").map(lambda t: unicodedata.normalize("NFC", t))


def strict_key(text: Column) -> Column:
    """The text in one of its compatible forms, without white space; punctuation counts."""
    return F.regexp_replace(F.pandas_udf(compatible, "string")(text), r"(?U)\s+", "")


def loose_key(text: Column) -> Column:
    """As strict, without punctuation; null if under two characters are left."""
    key = F.translate(strict_key(text), LOOSE_MARKS, "")
    return F.when(F.length(key) >= 2, key)


def lyric_norm(text: Column) -> Column:
    """Composed, lower case, words and single blanks only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.pandas_udf(composed, "string")(text)), r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))


def line_keys(lines: DataFrame) -> DataFrame:
    """song, line, strict and loose of each line."""
    keyed = dealt(lines.select("song", "line", "text"), "song", "line").select("song", "line", strict_key(F.col("text")).alias("strict"))
    loose = F.translate("strict", LOOSE_MARKS, "")
    return keyed.select("song", "line", "strict", F.when(F.length(loose) >= 2, loose).alias("loose"))


def fingerprints(lines: DataFrame) -> DataFrame:
    """song, fingerprint: md5 of the strict keys of its lines, each on its own line."""
    keys = line_keys(lines).groupBy("song").agg(F.array_sort(F.collect_list(F.struct("line", "strict"))).alias("k"))
    return keys.select("song", F.md5(F.array_join("k.strict", "\n").cast("binary")).alias("fingerprint"))


def same_lines(a: DataFrame, b: DataFrame) -> DataFrame:
    """song, line, other, strict: for each line of a song in a, its first equal line in b; by the strict
    key, or where there is none by the loose one."""
    both = line_keys(b).withColumn("side", F.lit(0)).unionByName(line_keys(a).withColumn("side", F.lit(1)))

    def match(rows: list[tuple]) -> list[tuple]:
        strict, loose, out = {}, {}, []
        for _, line, s, k, side in rows:
            if side == 0 and line is not None:
                strict.setdefault(s, line)
                loose.setdefault(k, line)
            elif side == 1 and (s in strict or k is not None and k in loose):
                out.append((line, strict[s] if s in strict else loose[k], s in strict))
        return out

    out = pa.schema({"song": pa.int64(), "line": pa.int64(), "other": pa.int64(), "strict": pa.bool_()})
    return by_song(both.where("song IS NOT NULL").select("song", "line", "strict", "loose", "side"), ["side", "line"], match, out)


def display_text(text: Column, pronunciation: Column, translation: Column) -> Column:
    """Text, (pronunciation), translation, each on its own line, as far as there is one."""
    def some(c: Column) -> Column:
        return F.when(c != "", c)

    return F.concat_ws("\n", text, F.when(some(pronunciation).isNotNull(), F.concat(F.lit("("), pronunciation, F.lit(")"))), some(translation))


def variants(lines: DataFrame) -> DataFrame:
    """song, variant, text: all lines of a song as original, translated, pronunciation and full; all but
    the first only where the song has such a value.  A line without one shows its text."""
    own = F.array_sort(F.collect_list(F.struct("line", "text", "pronunciation", "translation")))
    g = lines.groupBy("song").agg(own.alias("l"), F.bool_or(F.col("translation").isNotNull()).alias("t"), F.bool_or(F.col("pronunciation").isNotNull()).alias("p"))

    def joined(f) -> Column:
        return F.array_join(F.transform("l", f), "\n")

    each = {
        "original": (F.lit(True), joined(lambda x: x["text"])),
        "translated": (F.col("t"), joined(lambda x: F.coalesce(x["translation"], x["text"]))),
        "pronunciation": (F.col("p"), joined(lambda x: F.coalesce(x["pronunciation"], x["text"]))),
        "full": (F.col("t") | F.col("p"), joined(lambda x: display_text(x["text"], x["pronunciation"], x["translation"]))),
    }
    rows = F.array(*(F.when(has, F.struct(F.lit(name).alias("variant"), text.alias("text"))) for name, (has, text) in each.items()))
    return g.select("song", F.explode(F.array_compact(rows)).alias("v")).select("song", "v.variant", "v.text")


def by_number(lines: DataFrame, layer: DataFrame) -> DataFrame:
    """Lines with the layer's translation of the same number, else their own."""
    new = layer.groupBy("song", "line").agg(F.max("translation").alias("new"))
    return lines.join(new, ["song", "line"], "left").withColumn("translation", F.coalesce("new", "translation")).drop("new")


def own_or_linked(own: DataFrame, links: DataFrame) -> DataFrame:
    """Rows of a song; of one that has none, those of the song it is linked to, moved by its offset, and
    divided by its rate.  links: song, source, rate, offset."""
    has = own.select("song").distinct()
    bare = links.join(has, "song", "left_anti")
    moved = bare.join(own.withColumnRenamed("song", "source"), "source").select("song", "line", (F.floor(F.col("s") / F.col("rate")) + F.col("offset")).alias("s"), F.lit(True).alias("linked"))
    return own.select("song", "line", "s", F.lit(False).alias("linked")).unionByName(moved)


def adoptable(versions: DataFrame, current: DataFrame, human: tuple[str, ...]) -> DataFrame:
    """For each key of current (key, fingerprint), the newest version by people with another fingerprint.
    versions: key, version, fingerprint, origin, at."""
    rows = versions.where(F.col("origin").isin(*human)).join(current.withColumnRenamed("fingerprint", "now"), "key").where("fingerprint <> now")
    return rows.groupBy("key").agg(F.max_by("version", F.struct("at", "version")).alias("version"))


def backfilled(old: Column, new: Column, most: int = 256) -> Column:
    """The old value; where it is missing or blank, the new one, trimmed and cut to what the column holds."""
    return F.coalesce(F.when(F.trim(old) != "", old), F.when(F.trim(new) != "", F.substring(F.trim(new), 1, most)))


def origin(source: Column, name: Column, url: Column, wikis: tuple[str, ...]) -> Column:
    """Where a layer comes from: a known source, captions by name, any address, else a person."""
    return (
        F.when(F.coalesce(source, name, url).isNull(), "manual")
        .when(F.trim(source).isin(*wikis), "wiki")
        .when(F.contains(F.lower(F.coalesce(name, F.lit(""))), F.lit("caption")), "caption")
        .when(F.coalesce(url, F.lit("")) != "", "wiki")
        .otherwise("manual")
    )


def sharpness(confidence: Column, vocabulary: Column) -> Column:
    """log to the base of the vocabulary of 1 / confidence: 0 is best, 1 is chance; null without either."""
    return F.when((confidence > 0) & (vocabulary > 1), -F.log(confidence) / F.log(vocabulary))


def percent(x: Column) -> Column:
    return F.round(100 * F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))).cast("long")


def slots(word: Column, shown: Column) -> Column:
    """The letters of shown dealt in order to the letters of word, in proportion: an array by letter."""
    w, n = F.length(word), F.length(shown)
    return F.transform(F.sequence(F.lit(0), F.greatest(w - 1, F.lit(0))), lambda j: F.substr(shown, F.ceil(j * n / w).cast("int") + 1, (F.ceil((j + 1) * n / w) - F.ceil(j * n / w)).cast("int")))


def q_line_keys(spark, d):
    keys = line_keys(lyric_lines(table(spark, d, "documents")))
    return keys.select("song", "line", F.md5(F.col("strict").cast("binary")).alias("strict"), F.md5(F.col("loose").cast("binary")).alias("loose"))


def q_fingerprints(spark, d):
    return fingerprints(lyric_lines(table(spark, d, "documents")))


def q_lyric_norm(spark, d):
    return lyric_lines(table(spark, d, "benchmark"), "item_id").select("song", "line", lyric_norm(F.col("text")).alias("norm"))


def q_same_lines(spark, d):
    """Lines of each document in the next one."""
    lines = lyric_lines(table(spark, d, "documents"))
    return same_lines(lines, lines.withColumn("song", F.col("song") - 1))


def part_lines(spark, d):
    name = F.when(F.col("l_quantity") >= 25, F.concat(F.lit("p"), F.col("l_partkey").cast("string")))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("song"), F.col("l_linenumber").alias("line"), F.concat("l_linestatus", F.col("l_suppkey").cast("string")).alias("text"), name.alias("pronunciation"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("translation"))


def q_by_number(spark, d):
    lines = part_lines(spark, d)
    layer = lines.where("line % 2 = 0").select("song", "line", F.col("pronunciation").alias("translation"))
    return by_number(lines, layer).select("song", "line", "translation")


def q_own_or_linked(spark, d):
    """Purchases of each user, or those of the next user at 1.25 times the rate."""
    t = timed_lines(spark, d)
    links = t.select("song").distinct().select("song", (F.col("song") + 1).alias("source"), F.lit(1.25).alias("rate"), F.lit(500_000).alias("offset"))
    return own_or_linked(t.where("text = 'purchase' AND value > 95").select("song", "line", "s"), links)


def q_adoptable(spark, d):
    """For each customer, the newest finished order of another priority than the last one's."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("version"), F.col("o_orderpriority").alias("fingerprint"), F.col("o_orderstatus").alias("origin"), F.col("o_orderdate").alias("at"))
    last = o.groupBy("key").agg(F.max_by("fingerprint", F.struct("at", "version")).alias("fingerprint"))
    return adoptable(o, last, ("F", "P"))


def q_backfill(spark, d):
    old = F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", backfilled(old, F.concat(F.lit("  "), F.col("c_name"), F.lit(" "))).alias("title"))


def q_origin(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", origin(F.when(F.col("p_size") > 10, F.col("p_brand")), F.when(F.col("p_size") % 3 == 0, F.concat(F.col("p_name"), F.lit(" Caption"))), F.when(F.col("p_size") % 2 == 0, F.col("p_type")), ("Brand#11", "Brand#12")).alias("origin"))


def q_sharpness(spark, d):
    v = F.when(F.col("l_returnflag") == "A", 29).when(F.col("l_returnflag") == "R", 9000)
    alpha = sharpness(F.col("l_discount"), v)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(alpha, 9).alias("alpha"), F.round(F.exp(-alpha), 9).alias("quality"), F.round(F.pow(F.lit(100.0), -alpha), 9).alias("rescaled"))


def q_percent(spark, d):
    return table(spark, d, "events").select("event_id", percent(F.col("value") / 80 - 0.05).alias("percent"))


def q_slots(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(slots(F.col("p_name"), F.col("p_type")), "|").alias("slots"))


def q_better_engine(spark, d):
    """Of two scores of an order the larger; of equal ones the second."""
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.avg("l_discount"), 6).alias("a"), F.round(F.avg("l_tax"), 6).alias("b"))
    return g.select("l_orderkey", F.when(F.col("a") > F.col("b"), "first").otherwise("second").alias("engine"), F.greatest("a", "b").alias("rate"))


def q_cache_stats(spark, d):
    size = F.octet_length(F.coalesce("html", F.lit("")))
    return table(spark, d, "pages").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def q_coverage_choice(spark, d):
    """The event type that most of a user's events have; of equal ones the first by name."""
    g = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type")
    return g.withColumn("place", F.row_number().over(w)).where("place = 1").select("user_id", "event_type", "n")


def q_valid_segments(spark, d):
    """Events with a text and a number in their properties, in order, as one list for each user."""
    k = F.get_json_object("props", "$.k").try_cast("double")
    rows = table(spark, d, "events").select("user_id", "event_id", F.trim("event_type").alias("text"), k.alias("start")).where("start IS NOT NULL AND text <> ''")
    g = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("start", "event_id", "text"))).alias("t"))
    return g.select("user_id", F.md5(F.array_join(F.transform("t", lambda x: F.concat(x["event_id"].cast("string"), F.lit(":"), x["text"])), ",").cast("binary")).alias("segments"))


def q_copied_rows(spark, d):
    """Rows of every seventh user, copied to a new id that says where they come from."""
    t = timed_lines(spark, d).select("song", "line", "s", F.lit(None).cast("long").alias("copied_from"))
    return t.unionByName(t.where("song % 7 = 0").select((F.col("song") + 1_000_000).alias("song"), "line", "s", F.col("song").alias("copied_from")))


S = "regexp_replace(regexp_replace(nfc_normalize(text), '\\p{Cf}', '', 'g'), '\\s+', '', 'g')"
KEYS = f"(SELECT song, line, k AS strict, CASE WHEN length(l) >= 2 THEN l END AS loose FROM (SELECT song, line, k, translate(k, '{LOOSE_MARKS.replace(chr(39), chr(39) * 2)}', '') AS l FROM (SELECT song, line, {S} AS k FROM {LYRICS_SQL})))"
ITEMS = LYRICS_SQL.replace("doc_id", "item_id").replace("documents", "benchmark")
PARTS = "(SELECT l_orderkey AS song, l_linenumber AS line, l_linestatus || l_suppkey AS text, CASE WHEN l_quantity >= 25 THEN 'p' || l_partkey END AS pronunciation, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS translation FROM lineitem)"


def _variant(name: str, value: str, having: str) -> str:
    return f"SELECT song, '{name}' AS variant, string_agg({value}, chr(10) ORDER BY line, text, pronunciation NULLS FIRST, translation NULLS FIRST) AS text FROM {PARTS} GROUP BY 1 HAVING {having}"


FULL = "text || coalesce(chr(10) || '(' || pronunciation || ')', '') || coalesce(chr(10) || translation, '')"
QUERIES = {
    "line_keys": (q_line_keys, f"SELECT song, line, md5(strict) AS strict, md5(loose) AS loose FROM {KEYS}"),
    "strict_fingerprints": (q_fingerprints, f"SELECT song, md5(string_agg(strict, chr(10) ORDER BY line)) AS fingerprint FROM {KEYS} GROUP BY 1"),
    "lyric_norm": (q_lyric_norm, f"SELECT song, line, trim(regexp_replace(regexp_replace(lower(nfc_normalize(text)), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '\\s+', ' ', 'g')) AS norm FROM {ITEMS}"),
    "same_lines": (q_same_lines, f"WITH k AS {KEYS} SELECT a.song, a.line, coalesce(s.m, l.m) AS other, s.m IS NOT NULL AS strict FROM k a LEFT JOIN (SELECT song - 1 AS song, strict, min(line) AS m FROM k GROUP BY 1, 2) s ON s.song = a.song AND s.strict = a.strict LEFT JOIN (SELECT song - 1 AS song, loose, min(line) AS m FROM k WHERE loose IS NOT NULL GROUP BY 1, 2) l ON l.song = a.song AND l.loose = a.loose WHERE coalesce(s.m, l.m) IS NOT NULL"),
    "display_text": (lambda spark, d: part_lines(spark, d).select("song", "line", display_text(F.col("text"), F.col("pronunciation"), F.col("translation")).alias("shown")), f"SELECT song, line, {FULL} AS shown FROM {PARTS}"),
    "output_variants": (lambda spark, d: variants(part_lines(spark, d)), " UNION ALL ".join((_variant("original", "text", "true"), _variant("translated", "coalesce(translation, text)", "count(translation) > 0"), _variant("pronunciation", "coalesce(pronunciation, text)", "count(pronunciation) > 0"), _variant("full", FULL, "count(translation) + count(pronunciation) > 0")))),
    "layer_by_number": (q_by_number, f"SELECT p.song, p.line, coalesce(n.t, p.translation) AS translation FROM {PARTS} p LEFT JOIN (SELECT song, line, max(pronunciation) AS t FROM {PARTS} WHERE line % 2 = 0 GROUP BY 1, 2) n ON n.song = p.song AND n.line = p.line"),
    "own_or_linked": (q_own_or_linked, f"WITH o AS (SELECT song, line, s FROM {TIMED_SQL} WHERE text = 'purchase' AND value > 95), b AS (SELECT DISTINCT song FROM {TIMED_SQL} WHERE song NOT IN (SELECT song FROM o)) SELECT song, line, s, false AS linked FROM o UNION ALL SELECT b.song, o.line, floor(o.s / 1.25::DOUBLE)::BIGINT + 500000, true FROM b JOIN o ON o.song = b.song + 1"),
    "adoptable_versions": (q_adoptable, "WITH l AS (SELECT o_custkey AS key, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS now FROM orders GROUP BY 1) SELECT key, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS version FROM orders JOIN l ON key = o_custkey WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority <> now GROUP BY 1"),
    "title_backfill": (q_backfill, "SELECT c_custkey, CASE WHEN c_acctbal > 0 AND trim(c_mktsegment) <> '' THEN c_mktsegment ELSE left(trim(c_name), 256) END AS title FROM customer"),
    "layer_origin": (q_origin, "SELECT p_partkey, CASE WHEN p_size > 10 AND p_brand IN ('Brand#11', 'Brand#12') THEN 'wiki' WHEN p_size % 3 = 0 THEN 'caption' WHEN p_size % 2 = 0 THEN 'wiki' ELSE 'manual' END AS origin FROM part"),
    "conf_sharpness": (q_sharpness, "SELECT l_orderkey, l_linenumber, round(a, 9) AS alpha, round(exp(-a), 9) AS quality, round(pow(100.0, -a), 9) AS rescaled FROM (SELECT *, CASE WHEN l_discount > 0 AND l_returnflag IN ('A', 'R') THEN -ln(l_discount) / ln(CASE l_returnflag WHEN 'A' THEN 29 ELSE 9000 END) END AS a FROM lineitem)"),
    "stage_percent": (q_percent, "SELECT event_id, round(100 * least(greatest(value / 80 - 0.05::DOUBLE, 0), 1))::BIGINT AS percent FROM events"),
    "letter_slots": (q_slots, "SELECT p_partkey, array_to_string(list_transform(range(length(p_name)), lambda j: array_to_string(list_transform(list_filter(range(length(p_type)), lambda k: k * length(p_name) // length(p_type) = j), lambda k: substr(p_type, k::INT + 1, 1)), '')), '|') AS slots FROM part"),
    "better_engine": (q_better_engine, "SELECT l_orderkey, CASE WHEN a > b THEN 'first' ELSE 'second' END AS engine, greatest(a, b) AS rate FROM (SELECT l_orderkey, round(avg(l_discount), 6) AS a, round(avg(l_tax), 6) AS b FROM lineitem GROUP BY 1)"),
    "cache_stats": (q_cache_stats, "SELECT count(*) AS files, coalesce(sum(strlen(coalesce(html, ''))), 0)::BIGINT AS bytes FROM pages"),
    "coverage_choice": (q_coverage_choice, "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) = 1"),
    "valid_segments": (q_valid_segments, "SELECT user_id, md5(string_agg(event_id || ':' || trim(event_type), ',' ORDER BY k, event_id)) AS segments FROM (SELECT *, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) WHERE k IS NOT NULL AND trim(event_type) <> '' GROUP BY 1"),
    "copied_rows": (q_copied_rows, f"SELECT song, line, s, NULL::BIGINT AS copied_from FROM {TIMED_SQL} UNION ALL SELECT song + 1000000, line, s, song FROM {TIMED_SQL} WHERE song % 7 = 0"),
}
