"""Readers of small documents in a column: caption JSON, project JSON, word stamps, note files, tables in
HTML, answers of models, alignment output and pronunciation lists.  Each explodes a file to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.functions.text import cell_text
from lineweave.operators.words import once
from lineweave.sources.subtitles import lrc_stamp
from lineweave.sources.tables import TIMED_SQL, table, timed_lines

CAPTIONS = "events array<struct<tStartMs: long, dDurationMs: long, segs: array<struct<utf8: string>>>>"
PROJECT = "metadata struct<title: string>, results array<struct<text: string, start_time: long, end_time: long, line_number: long>>"


def parse_captions(files: DataFrame) -> DataFrame:
    """song, k, s, e, text of caption JSON: without blank ones and note signs, and with captions that
    repeat the one before as one."""
    c = files.select("song", F.posexplode(F.from_json("file", CAPTIONS)["events"]).alias("k", "c"))
    text = F.trim(F.regexp_replace(F.array_join(F.transform("c.segs", lambda s: s["utf8"]), ""), r"[\s\x{266A}]+", " "))
    rows = c.select("song", "k", (F.col("c.tStartMs") * 1000).alias("s"), ((F.col("c.tStartMs") + F.col("c.dDurationMs")) * 1000).alias("e"), text.alias("text")).where("text <> ''")
    w = Window.partitionBy("song").orderBy("k")
    rows = rows.withColumn("turn", F.when(F.lag("text").over(w) == F.col("text"), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("song", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.first("text").alias("text"))


def parse_project(files: DataFrame) -> DataFrame:
    p = files.select("song", F.from_json("file", PROJECT).alias("p"))
    return p.select("song", F.col("p.metadata.title").alias("title"), F.explode("p.results").alias("r")).select("song", "title", "r.*")


def parse_word_stamps(files: DataFrame) -> DataFrame:
    """song, k, s, e, word of lines like <00:01.00>one <00:01.50>two: a word ends where the next begins,
    the last after a second."""
    x = F.regexp_extract_all("file", F.lit(r"(<\d+:\d+\.\d+>[^<]*)"), 1)
    rows = files.select("song", F.posexplode(x).alias("k", "x"))
    s = F.regexp_extract("x", r"<(\d+):", 1).cast("long") * 60_000_000 + F.round(F.regexp_extract("x", r":(\d+\.\d+)>", 1).cast("double") * 1_000_000).cast("long")
    rows = rows.select("song", "k", s.alias("s"), F.trim(F.regexp_extract("x", ">(.*)", 1)).alias("word"))
    after = F.lead("s").over(Window.partitionBy("song").orderBy("k"))
    return rows.withColumn("e", F.coalesce(after, F.col("s") + 1_000_000))


def parse_notes(files: DataFrame) -> DataFrame:
    """song, k, s, e, midi of note files: blocks with Length in ticks (480 a beat), NoteNum, Lyric, and a
    Tempo that holds from there on.  Rests (R) take time and are no notes."""
    block = F.filter(F.split("file", r"\n\["), lambda b: b.contains("Length="))
    rows = files.select("song", F.posexplode(block).alias("k", "b"))
    get = lambda name: F.regexp_extract("b", rf"{name}=([^\n]*)", 1)
    w = Window.partitionBy("song").orderBy("k")
    until = w.rowsBetween(Window.unboundedPreceding, 0)
    tempo = F.last(F.when(get("Tempo") != "", get("Tempo").cast("double")), ignorenulls=True).over(until)
    rows = rows.select("song", "k", get("Length").cast("long").alias("ticks"), get("NoteNum").cast("int").alias("midi"), get("Lyric").alias("lyric"), F.coalesce(tempo, F.lit(120.0)).alias("tempo"))
    rows = rows.withColumn("length", F.round(F.col("ticks") * 60_000_000 / (F.col("tempo") * 480)).cast("long")).withColumn("e", F.sum("length").over(until))
    return rows.where("lyric <> 'R'").select("song", "k", (F.col("e") - F.col("length")).alias("s"), "e", "midi")


def table_lines(html: Column) -> Column:
    """Lines of a page whose table has three rows for each (text, pronunciation, translation), or two
    (text, translation), or one: as array of struct(text, pronunciation, translation)."""
    return once(F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), 1), cell_text), _lines_of_cells)


def _lines_of_cells(cells: Column) -> Column:
    n = F.size(cells)
    by = F.when(n % 3 == 0, 3).when(n % 2 == 0, 2).otherwise(1)
    none = F.lit(None).cast("string")
    at = lambda i: F.get(cells, i)
    line = lambda i: F.struct(at(i * by).alias("text"), F.when(by == 3, at(i * by + 1)).otherwise(none).alias("pronunciation"), F.when(by == 3, at(i * by + 2)).when(by == 2, at(i * by + 1)).otherwise(none).alias("translation"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), (n / by).cast("int") - 1), line)).otherwise(F.array().cast("array<struct<text:string,pronunciation:string,translation:string>>"))


def json_objects(answer: Column) -> Column:
    """The whole flat objects in a model's answer, with or without a fence, also if it breaks off."""
    return F.regexp_extract_all(answer, F.lit(r"(\{[^{}]*\})"), 1)


def parse_ctm(lines: DataFrame) -> DataFrame:
    """Alignment output, a line each: file, channel, start, length, token."""
    x = F.split(F.trim("value"), r"\s+")
    return lines.where(F.size(x) >= 5).select(x[0].alias("file"), x[2].cast("double").alias("s"), (x[2].cast("double") + x[3].cast("double")).alias("e"), x[4].alias("token"))


def parse_pronunciations(lines: DataFrame) -> DataFrame:
    """A pronunciation list: ;;; comments, WORD or WORD(2), then phones; all entries of a word together."""
    x = F.split(F.trim("value"), r"\s+", 2)
    word = F.lower(F.regexp_replace(x[0], r"\(\d+\)$", ""))
    rows = lines.where(~F.col("value").startswith(";;;") & (F.size(x) == 2)).select(word.alias("word"), F.regexp_replace(x[1], r"\d", "").alias("phones"))
    return rows.groupBy("word").agg(F.array_sort(F.collect_set("phones")).alias("entries"))


def caption_round_trip(spark, d):
    """Events as caption JSON and back, equal ones merged."""
    one = F.struct("s", "line", F.struct(F.floor(F.col("s") / 1000).alias("tStartMs"), F.floor((F.col("e") - F.col("s")) / 1000).alias("dDurationMs"), F.array(F.struct(F.col("text").alias("utf8"))).alias("segs")).alias("c"))
    files = timed_lines(spark, d).groupBy("song").agg(F.array_sort(F.collect_list(one)).alias("t")).select("song", F.to_json(F.struct(F.col("t.c").alias("events"))).alias("file"))
    return parse_captions(files)


def project_round_trip(spark, d):
    one = F.struct(F.col("text"), F.col("s").alias("start_time"), F.col("e").alias("end_time"), F.col("line").alias("line_number"))
    files = timed_lines(spark, d).groupBy("song").agg(F.collect_list(one).alias("results")).select("song", F.to_json(F.struct(F.struct(F.concat(F.lit("song "), F.col("song").cast("string")).alias("title")).alias("metadata"), "results")).alias("file"))
    return parse_project(files)


def word_stamp_round_trip(spark, d):
    """Lines of an order as words of one second of stamps."""
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("song"), F.struct("l_linenumber", F.concat(F.lit("<"), lrc_stamp(F.col("l_linenumber").cast("long") * 1_500_000), F.lit(">"), "l_returnflag").alias("x")).alias("x"))
    files = t.groupBy("song").agg(F.array_sort(F.collect_list("x")).alias("t")).select("song", F.array_join("t.x", " ").alias("file"))
    return parse_word_stamps(files).select("song", "k", "s", "e", "word")


def note_round_trip(spark, d):
    """Lines of an order as notes: quantities as lengths, returned ones as rests."""
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("song"), F.struct("l_linenumber", F.format_string("[#%04d]\nLength=%d\nLyric=%s\nNoteNum=%d\nTempo=125", "l_linenumber", (F.col("l_quantity") * 10).cast("long"), "l_returnflag", F.col("l_linenumber") + 60).alias("x")).alias("x"))
    files = t.groupBy("song").agg(F.array_sort(F.collect_list("x")).alias("t")).select("song", F.concat(F.lit("[#SETTING]\n"), F.array_join("t.x", "\n")).alias("file"))
    return parse_notes(files)


def broken_answers(spark, d):
    """A user's props as a fenced answer that breaks off: what can be read of it."""
    t = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "props"))).alias("t"))
    answer = F.concat(F.lit("```json\n["), F.array_join("t.props", ", "), F.lit(', {"k": 1'))
    k = F.transform(json_objects(answer), lambda x: F.get_json_object(x, "$.k").cast("long"))
    return t.select("user_id", F.size(k).cast("long").alias("n"), F.aggregate(k, F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


def page_links(spark, d):
    """Targets and titles of a page's links, without those that are empty."""
    a = F.regexp_extract_all("html", F.lit(r'(<a href="[^"]*">[^<]*</a>)'), 1)
    p = table(spark, d, "pages").select("page_id", F.posexplode(a).alias("k", "a"))
    return p.select("page_id", "k", F.regexp_extract("a", 'href="([^"]*)"', 1).alias("target"), F.trim(F.regexp_extract("a", ">([^<]*)<", 1)).alias("title")).where("title <> ''")


def q_table_rows(spark, d):
    """Lines of an order as a page with a table of one column, read by how its rows can be divided."""
    x = F.struct("l_linenumber", F.concat(F.lit("<TR class=r>\n<td>"), "l_returnflag", F.lit("<br/>&amp; <b>"), "l_linenumber", F.lit("</b></td></TR>")).alias("x"))
    pages = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(x)).alias("x")).select("l_orderkey", F.concat(F.lit("<p>no row</p><table>"), F.array_join("x.x", ""), F.lit("</table>")).alias("html"))
    rows = pages.select("l_orderkey", F.posexplode(table_lines(F.col("html"))).alias("k", "l"))
    return rows.select("l_orderkey", "k", "l.text", "l.pronunciation", "l.translation")


def q_ctm(spark, d):
    """Events as lines of alignment output, every seventh cut short."""
    s, n = F.format_string("%d.%02d", F.floor(F.col("event_id") / 100), F.col("event_id") % 100), F.format_string("0.%02d", F.col("user_id") % 100)
    line = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("u"), "user_id", F.lit(" 1 "), s)).otherwise(F.concat(F.lit("u"), "user_id", F.lit(" 1  "), s, F.lit(" "), n, F.lit(" "), "event_type", F.lit(" 0.9 ")))
    return parse_ctm(table(spark, d, "events").select(line.alias("value"))).select("file", F.round("s", 6).alias("s"), F.round("e", 6).alias("e"), "token")


def q_pronunciations(spark, d):
    """Brands as words, letters of types as phones with stresses; sizes number the entries of a word."""
    phones = F.array_join(F.transform(F.filter(F.split(F.substring("p_type", 1, 6), ""), lambda c: c != " "), lambda c, i: F.concat(c, ((i + F.col("p_size")) % 3).cast("string"))), " ")
    word = F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.when(F.col("p_size") % 4 > 0, F.concat(F.lit("("), F.col("p_size") % 4 + 1, F.lit(")"))).otherwise(""))
    line = F.when(F.col("p_partkey") % 9 == 0, F.concat(F.lit(";;; "), "p_name")).otherwise(F.concat(word, F.lit("  "), phones))
    return parse_pronunciations(table(spark, d, "part").select(line.alias("value"))).select("word", F.posexplode("entries").alias("k", "phones"))


T = TIMED_SQL
QUERIES = {
    "table_rows": (
        q_table_rows,
        "WITH c AS (SELECT l_orderkey, l_returnflag || ' & ' || l_linenumber AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem), g AS (SELECT l_orderkey, i // w AS k, w, list(c ORDER BY i) AS c FROM (SELECT *, CASE WHEN n % 3 = 0 THEN 3 WHEN n % 2 = 0 THEN 2 ELSE 1 END AS w FROM c) GROUP BY 1, 2, 3) SELECT l_orderkey, k::INT AS k, c[1] AS text, CASE WHEN w = 3 THEN c[2] END AS pronunciation, CASE w WHEN 3 THEN c[3] WHEN 2 THEN c[2] END AS translation FROM g",
    ),
    "alignment_output": (q_ctm, "SELECT 'u' || user_id AS file, round(event_id / 100.0::DOUBLE, 6) AS s, round(event_id / 100.0::DOUBLE + user_id % 100 / 100.0::DOUBLE, 6) AS e, event_type AS token FROM events WHERE event_id % 7 <> 0"),
    "pronunciation_list": (
        q_pronunciations,
        "WITH p AS (SELECT DISTINCT lower(replace(p_brand, '#', '')) AS word, array_to_string(list_filter(string_split(left(p_type, 6), ''), lambda c: c <> ' '), ' ') AS phones FROM part WHERE p_partkey % 9 <> 0) SELECT word, (row_number() OVER (PARTITION BY word ORDER BY phones) - 1)::INT AS k, phones FROM p",
    ),
    "caption_round_trip": (caption_round_trip, f"WITH t AS (SELECT *, s // 1000 * 1000 AS a, (s // 1000 + (e - s) // 1000) * 1000 AS b, CASE WHEN lag(text) OVER (PARTITION BY song ORDER BY s, line) = text THEN 0 ELSE 1 END AS f FROM {T}), r AS (SELECT *, sum(f) OVER (PARTITION BY song ORDER BY s, line ROWS UNBOUNDED PRECEDING) AS run FROM t) SELECT song, run, min(a) AS s, max(b) AS e, any_value(text) AS text FROM r GROUP BY 1, 2"),
    "project_round_trip": (project_round_trip, f"SELECT song, 'song ' || song AS title, text, s AS start_time, e AS end_time, line AS line_number FROM {T}"),
    "word_stamp_round_trip": (word_stamp_round_trip, "SELECT l_orderkey AS song, (row_number() OVER w - 1)::INT AS k, l_linenumber::BIGINT * 1500000 AS s, coalesce(lead(l_linenumber::BIGINT * 1500000) OVER w, l_linenumber::BIGINT * 1500000 + 1000000) AS e, l_returnflag AS word FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag)"),
    "note_round_trip": (note_round_trip, "WITH n AS (SELECT l_orderkey AS song, l_linenumber, l_returnflag, (l_quantity * 10)::BIGINT || chr(10) || l_returnflag AS x, round((l_quantity * 10)::BIGINT * 60000000 / (125 * 480.0))::BIGINT AS len FROM lineitem), r AS (SELECT *, row_number() OVER w - 1 AS k, sum(len) OVER w AS e FROM n WINDOW w AS (PARTITION BY song ORDER BY l_linenumber, x ROWS UNBOUNDED PRECEDING)) SELECT song, k::INT AS k, e - len AS s, e, l_linenumber + 60 AS midi FROM r WHERE l_returnflag <> 'R'"),
    "broken_answers": (broken_answers, "SELECT user_id, count(*) AS n, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY 1"),
    "page_links": (page_links, r"""WITH p AS (SELECT page_id, regexp_extract_all(html, '(<a href="[^"]*">[^<]*</a>)', 1) AS a FROM pages), u AS (SELECT page_id, unnest(range(len(a)))::INT AS k, unnest(a) AS a FROM p) SELECT * FROM (SELECT page_id, k, regexp_extract(a, 'href="([^"]*)"', 1) AS target, trim(regexp_extract(a, '>([^<]*)<', 1)) AS title FROM u) WHERE title <> ''"""),
}
