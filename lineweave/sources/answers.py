"""What a language model answered: the whole objects of a list that may break off, and timed lines in three
notations.

All is expressions over one answer.  A null or blank answer has no objects and no lines; repeated objects and
lines stay; lines keep their order, so there are no ties; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.operators.words import once
from lineweave.sources.tables import table

#: A string, a bracket, what is between, or the quote of a string that doesn't end.
TOKEN = r'"(?:[^"\\]|\\.)*"|[\[\]{}]|[^"\[\]{}]+|"'
#: What may stand between the items of a list, single values included.
BETWEEN = r"^(?:[\s,]|-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)*$"
FENCED = r"(?s)```(?:json)?\s*(.*?)\s*```"


def body(answer: Column) -> Column:
    """The answer without a thought and without a fence around it."""
    said = F.trim(F.regexp_replace(answer, r"(?s)<think>.*?</think>", ""), F.lit(" \t\r\n"))
    return F.when(said.startswith("```") & said.rlike(FENCED), F.regexp_extract(said, FENCED, 1)).otherwise(said)


def list_objects(text: Column) -> Column:
    """The objects of the first list in a text, whole ones, in order, with all that is nested in them, as
    strings.  Brackets inside strings don't count.  The list is read up to its end, or to the first item
    that is broken; other items (numbers, lists) are passed over."""
    at = F.locate("[", text)
    first = F.struct(F.lit(0).alias("depth"), F.lit("").alias("item"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("found"))

    def step(acc: Column, t: Column) -> Column:
        opens, closes = t.isin("{", "["), t.isin("}", "]")
        depth = acc.depth + F.when(opens, 1).when(closes, -1).otherwise(0)
        item = F.when((acc.depth > 0) | opens, F.concat(acc.item, t)).otherwise("")
        ended = (acc.depth == 1) & closes
        stop = (t == '"') | (acc.depth == 0) & (closes | ~opens & ~t.startswith('"') & ~t.rlike(BETWEEN)) | ended & F.get_json_object(item, "$").isNull()
        found = F.when(~stop & ended & item.startswith("{"), F.array_append(acc.found, item)).otherwise(acc.found)
        moved = F.struct(depth.alias("depth"), F.when(ended, "").otherwise(item).alias("item"), stop.alias("done"), found.alias("found"))
        return F.when(acc.done, acc).otherwise(moved)

    tokens = F.filter(F.regexp_extract_all(F.substr(text, at + 1), F.lit(TOKEN), 0), lambda t: t != "")
    return F.when(at > 0, F.aggregate(tokens, first, step, lambda acc: acc.found)).otherwise(F.array().cast("array<string>"))


def answer_objects(answer: Column) -> Column:
    return F.coalesce(once(body(answer), list_objects), F.array().cast("array<string>"))


def _micros(seconds: Column) -> Column:
    return F.round(seconds.cast("double") * 1_000_000).cast("long")


#: How long a line with only a start lasts, and how long before the next one it ends, in microseconds.
LASTS, BEFORE = 3_000_000, 100_000


def answer_lines(answers: DataFrame) -> DataFrame:
    """song, k, line, text, s, e of answers (song, answer): objects with text, start and end (or start_time and
    end_time) and maybe line, if the text from its first to its last bracket is a list; else lines such as
    [01:02.50] text, or 1.5 - 4: text.  Of the former the end is just before the next line.  Each
    answer is read by itself: k counts its own lines."""
    value = lambda x, *names: F.coalesce(*(F.get_json_object(x, f"$.{n}") for n in names))
    at = lambda x, *names: _micros(F.coalesce(value(x, *names).try_cast("double"), F.lit(0.0)))
    line = lambda number, text, s, e: F.struct(number.alias("line"), text.alias("text"), s.alias("s"), e.alias("e"))

    def item(x: Column) -> Column:
        return line(value(x, "line").try_cast("long"), F.coalesce(value(x, "text"), F.lit("")), at(x, "start", "start_time"), at(x, "end", "end_time"))

    stamp, span = r"^\[(\d+):(\d+\.?\d*)\]\s*(.+)", r"^(\d+\.?\d*)\s*[-–]\s*(\d+\.?\d*)[:\s]+(.+)"

    def row(x: Column) -> Column:
        part = lambda p, i: F.regexp_extract(x, p, i)
        s = lambda: F.when(x.rlike(stamp), part(stamp, 1).try_cast("long") * 60_000_000 + _micros(part(stamp, 2).try_cast("double"))).otherwise(_micros(part(span, 1).try_cast("double")))
        e = F.when(x.rlike(span), _micros(part(span, 2).try_cast("double")))
        text = F.trim(F.when(x.rlike(stamp), part(stamp, 3)).otherwise(part(span, 3)))
        return once(s(), lambda at: line(F.lit(None).cast("long"), text, at, F.when(x.rlike(stamp), at + LASTS).otherwise(e)))

    def rows(body: Column) -> Column:
        lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x, F.lit(" \t\r"))), lambda x: x.rlike(stamp) | x.rlike(span))
        end = lambda x, after: F.when((x.e == x.s + LASTS) & after.isNotNull(), after - BEFORE).otherwise(x.e)
        return once(F.transform(lines, row), lambda found: F.transform(found, lambda x, i: line(x.line, x.text, x.s, end(x, F.get(found, i + 1).s))))

    def lines_of(x: Column) -> Column:
        whole = (x.inner != "") & F.get_json_object(x.inner, "$").isNotNull()
        return F.when(whole, F.transform(list_objects(x.inner), item)).when(~whole, rows(x.body))

    found = once(body(F.col("answer")), lambda b: once(F.struct(b.alias("body"), F.regexp_extract(b, r"(?s)(\[.*\])", 1).alias("inner")), lines_of))
    return answers.select("song", F.posexplode_outer(found).alias("k", "x")).where("k IS NOT NULL").select("song", "k", "x.*")


def numbered_lines(found: DataFrame, lyrics: DataFrame) -> DataFrame:
    """The lines found with the text of the lyric (song, line, text) that they name, and the line (the last) of
    the lyric with their text, in any case, where they name none."""
    named = lyrics.select("song", "line", F.col("text").alias("own"))
    by_text = lyrics.groupBy("song", F.lower("text").alias("low")).agg(F.max("line").alias("at"))
    rows = found.join(named, ["song", "line"], "left").withColumn("low", F.lower("text")).join(by_text, ["song", "low"], "left")
    return rows.select("song", "k", F.coalesce("line", "at").alias("line"), F.coalesce("own", "text").alias("text"), "s", "e")


def _answers(spark, d) -> DataFrame:
    """Events as answers: in a fence, after a thought, cut off, or with words around."""
    whole = F.concat(F.lit('[{"k": '), "event_id", F.lit(', "in": {"t": ["a}\\"]b", {}]}}, '), "props", F.lit(', [1, {"x": 2}], 7.5, {"z": "'), "event_type", F.lit('"}]'))
    n = F.col("event_id") % 4
    answer = F.when(n == 0, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(n == 1, F.concat(F.lit("<think>[{no}</think> "), whole)).when(n == 2, F.left(whole, (F.col("event_id") % 97 + 8).cast("int"))).otherwise(F.concat(F.lit("Here: "), whole, F.lit(" [{}] or so")))
    return table(spark, d, "events").select("event_id", answer.alias("answer"))


def q_objects(spark, d):
    return _answers(spark, d).select("event_id", F.posexplode(answer_objects(F.col("answer"))).alias("k", "object"))


def _songs(spark, d) -> DataFrame:
    """Lines of an order as an answer: objects, stamps or spans, by its number; every fifth list is cut off."""
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("song"), F.col("l_linenumber").cast("long").alias("n"), F.col("l_quantity").cast("long").alias("q"), "l_returnflag")
    form = F.col("song") % 3
    objects = F.concat(F.lit('{"text": "'), "l_returnflag", F.lit(' {0}", "start": '), F.col("n") * 2, F.lit(', "end_time": '), F.col("n") * 2 + 1, F.when(F.col("n") % 2 == 0, F.concat(F.lit(', "line": '), "n")).otherwise(""), F.lit("}"))
    stamps = F.concat(F.lit("["), F.col("n"), F.lit(":"), F.col("q"), F.lit(".25] "), "l_returnflag")
    spans = F.concat(F.col("n"), F.lit(".5 - "), F.col("n") + 1 + F.col("q") % 4, F.lit(": "), "l_returnflag")
    x = F.struct("n", "q", F.when(form == 0, objects).when(form == 1, stamps).otherwise(spans).alias("x"))
    each = t.groupBy("song").agg(F.array_sort(F.collect_list(x)).alias("x"))
    listed = F.concat(F.lit("["), F.array_join("x.x", ", "), F.when(F.col("song") % 5 == 0, "").otherwise("]"))
    return each.select("song", F.when(form == 0, listed).otherwise(F.concat(F.lit("As heard:\n"), F.array_join("x.x", "\n"))).alias("answer"))


def q_lines(spark, d):
    lyrics = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("song"), F.col("l_linenumber").cast("long").alias("line")).agg(F.min("l_returnflag").alias("text"))
    return numbered_lines(answer_lines(_songs(spark, d)), lyrics)


OBJECTS_SQL = """w AS (SELECT event_id, '[{"k": ' || event_id || ', "in": {"t": ["a}\\"]b", {}]}}, ' || props || ', [1, {"x": 2}], 7.5, {"z": "' || event_type || '"}]' AS w FROM events),
a AS (SELECT event_id, CASE event_id % 4 WHEN 2 THEN left(w, (event_id % 97 + 8)::INT) WHEN 3 THEN w || ' [{}] or so' ELSE w END AS t FROM w),
c AS (SELECT event_id, 1 AS i, 0 AS depth, false AS quoted, false AS escaped, 0 AS start, 0 AS stop, false AS done FROM a
UNION ALL SELECT event_id, i + 1, CASE WHEN quoted THEN depth WHEN x IN ('{', '[') THEN depth + 1 WHEN x IN ('}', ']') THEN depth - 1 ELSE depth END, CASE WHEN x = '"' AND NOT escaped THEN NOT quoted ELSE quoted END, quoted AND NOT escaped AND x = '\\', CASE WHEN NOT quoted AND depth = 0 AND x IN ('{', '[') THEN i + 1 ELSE start END, CASE WHEN NOT quoted AND depth = 1 AND x IN ('}', ']') THEN i + 1 ELSE 0 END, NOT quoted AND depth = 0 AND x = ']' FROM (SELECT c.*, t[i + 1] AS x, length(t) AS n FROM c JOIN a USING (event_id)) WHERE i < n AND NOT done)"""
LINES_SQL = """t AS (SELECT l_orderkey AS song, l_linenumber::BIGINT AS n, l_quantity::BIGINT AS q, l_returnflag AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity::BIGINT, l_returnflag) - 1 AS k FROM lineitem),
r AS (SELECT *, CASE song % 3 WHEN 0 THEN n * 2000000 WHEN 1 THEN n * 60000000 + q * 1000000 + 250000 ELSE n * 1000000 + 500000 END AS s, CASE song % 3 WHEN 0 THEN (n * 2 + 1) * 1000000 WHEN 2 THEN (n + 1 + q % 4) * 1000000 END AS e FROM t WHERE song % 3 <> 0 OR song % 5 <> 0),
y AS (SELECT l_orderkey AS song, l_linenumber::BIGINT AS line, min(l_returnflag) AS text FROM lineitem GROUP BY 1, 2),
z AS (SELECT song, text, max(line) AS pos FROM y GROUP BY 1, 2),
u AS (SELECT *, CASE WHEN song % 3 = 0 THEN f || ' {0}' ELSE f END AS text, CASE WHEN song % 3 = 0 AND n % 2 = 0 THEN n END AS line, CASE WHEN song % 3 = 0 THEN e WHEN song % 3 = 1 OR e = s + 3000000 THEN coalesce(lead(s) OVER (PARTITION BY song ORDER BY k) - 100000, s + 3000000) ELSE e END AS until FROM r)"""
QUERIES = {
    "answer_objects": (q_objects, f"WITH RECURSIVE {OBJECTS_SQL} SELECT event_id, (row_number() OVER (PARTITION BY event_id ORDER BY stop) - 1)::INT AS k, object FROM (SELECT event_id, stop, substr(t, start, stop - start + 1) AS object FROM c JOIN a USING (event_id) WHERE stop > 0) WHERE object LIKE '{{%'"),
    "answer_lines": (q_lines, f"WITH {LINES_SQL} SELECT u.song, k::INT AS k, coalesce(u.line, z.pos) AS line, coalesce(y.text, u.text) AS text, s, until AS e FROM u LEFT JOIN y ON y.song = u.song AND y.line = u.line LEFT JOIN z ON z.song = u.song AND z.text = u.text"),
}
