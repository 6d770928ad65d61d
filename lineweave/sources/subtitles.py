"""Timed text files: SRT, LRC, ASS and JSON, read to rows and rendered from rows.

A file is one string.  Times are microseconds.  Rendering gathers the lines of one song, as a file
has to; reading explodes a file to its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.sources.tables import TIMED_SQL, table, timed_lines

ASS_HEAD = "[Script Info]\nScriptType: v4.00+\n\n[Events]\nFormat: Layer, Start, End, Style, Text"


def stamp(t: Column, sep: str, digits: int, hours: int = 2) -> Column:
    """hh:mm:ss and a fraction, cut (not rounded) to digits."""
    unit = 10 ** (6 - digits)
    s = F.floor(t / 1_000_000)
    return F.format_string(f"%0{hours}d:%02d:%02d{sep}%0{digits}d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60, F.floor(t % 1_000_000 / unit))


def lrc_stamp(t: Column) -> Column:
    return F.format_string("%02d:%02d.%02d", F.floor(t / 60_000_000), F.floor(t % 60_000_000 / 1_000_000), F.floor(t % 1_000_000 / 10_000))


def render(lines: DataFrame, how: str) -> DataFrame:
    """song and file: its lines in order of start and number, in one of FORMATS."""
    if how not in FORMATS:
        raise ValueError(f"{how} is none of {', '.join(FORMATS)}")
    t = lines.groupBy("song").agg(F.array_sort(F.collect_list(F.struct("s", "line", "e", "text"))).alias("t"))
    return t.select("song", FORMATS[how](F.col("t")).alias("file"))


def _srt(t: Column) -> Column:
    return F.array_join(F.transform(t, lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), stamp(x["s"], ",", 3), F.lit(" --> "), stamp(x["e"], ",", 3), F.lit("\n"), x["text"], F.lit("\n"))), "\n")


def _lrc(t: Column) -> Column:
    return F.array_join(F.transform(t, lambda x: F.concat(F.lit("["), lrc_stamp(x["s"]), F.lit("]"), x["text"])), "\n")


def _ass(t: Column) -> Column:
    row = lambda x: F.concat(F.lit("Dialogue: 0,"), stamp(x["s"], ".", 2, 1), F.lit(","), stamp(x["e"], ".", 2, 1), F.lit(",Default,"), F.replace(x["text"], F.lit("\n"), F.lit("\\N")))
    return F.array_join(F.concat(F.array(F.lit(ASS_HEAD)), F.transform(t, row)), "\n")


def _json(t: Column) -> Column:
    return F.to_json(F.transform(t, lambda x: F.struct(x["text"].alias("text"), x["s"].alias("start"), x["e"].alias("end"))))


FORMATS = {"srt": _srt, "lrc": _lrc, "ass": _ass, "json": _json}


def _clock(h: Column, m: Column, s: Column, ms: Column) -> Column:
    return ((h.cast("long") * 60 + m.cast("long")) * 60 + s.cast("long")) * 1_000_000 + ms.cast("long") * 1000


def parse_srt(files: DataFrame) -> DataFrame:
    """song, line, s, e, text of SRT files; several text lines are joined by a blank, blocks without a
    time line are dropped."""
    block = F.explode(F.filter(F.split(F.replace("file", F.lit("\r"), F.lit("")), r"\n\s*\n"), lambda b: b.rlike(r"\d+:\d+:\d+[,.]\d+ --> ")))
    b = files.select("song", block.alias("b"))
    when = r"(\d+):(\d+):(\d+)[,.](\d+) --> (\d+):(\d+):(\d+)[,.](\d+)"
    g = lambda k: F.regexp_extract("b", when, k)
    text = F.regexp_replace(F.trim(F.regexp_extract("b", r"-->[^\n]*\n([\s\S]*)", 1), F.lit("\n ")), "\n", " ")
    return b.select("song", F.regexp_extract("b", r"(\d+)\s*\n", 1).cast("long").alias("line"), _clock(g(1), g(2), g(3), g(4)).alias("s"), _clock(g(5), g(6), g(7), g(8)).alias("e"), text.alias("text"))


def parse_lrc(files: DataFrame) -> DataFrame:
    """song, s, text of LRC files; a line with several stamps is several lines."""
    one = files.select("song", F.posexplode(F.split("file", "\n")).alias("k", "l"))
    stamps = F.regexp_extract_all("l", F.lit(r"\[(\d+:\d+\.\d+)\]"), 1)
    return one.select("song", "k", F.explode(stamps).alias("x"), F.regexp_replace("l", r"^(\[\d+:\d+\.\d+\])+", "").alias("text")).select("song", "k", (F.substring_index("x", ":", 1).cast("long") * 60_000_000 + F.round(F.substring_index("x", ":", -1).cast("double") * 1_000_000).cast("long")).alias("s"), "text")


def parse_props(spark, d):
    """The number in an event's JSON, missing or malformed as NULL."""
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


def _lines(spark, d):
    """Lines of the first hours: times since the first event of all."""
    t = timed_lines(spark, d)
    zero = t.agg(F.min("s").alias("zero"))  # one row
    return t.crossJoin(F.broadcast(zero)).withColumns({"s": F.col("s") - F.col("zero"), "e": F.col("e") - F.col("zero")}).drop("zero")


def _rendered(how: str):
    return lambda spark, d: render(_lines(spark, d), how)


def srt_round_trip(spark, d):
    t = _lines(spark, d)
    back = parse_srt(render(t, "srt"))
    return back.groupBy("song").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("e") - F.col("s")).alias("length"), F.max("line").alias("last"))


def lrc_round_trip(spark, d):
    return parse_lrc(render(_lines(spark, d), "lrc")).select("song", "s", "text")


Z = f"(SELECT song, line, text, s - z AS s, e - z AS e FROM {TIMED_SQL}, (SELECT min(epoch_us(ts)) AS z FROM events))"


def _sql_stamp(t: str, sep: str, digits: int, hours: int = 2) -> str:
    unit = 10 ** (6 - digits)
    return f"printf('%0{hours}d:%02d:%02d{sep}%0{digits}d', {t} // 3600000000, {t} // 60000000 % 60, {t} // 1000000 % 60, {t} % 1000000 // {unit})"


LRC_STAMP = "printf('%02d:%02d.%02d', s // 60000000, s % 60000000 // 1000000, s % 1000000 // 10000)"
NL = "chr(10)"
QUERIES = {
    "srt_render": (_rendered("srt"), f"WITH z AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY s, line) AS i FROM {Z}) SELECT song, string_agg(i || {NL} || {_sql_stamp('s', ',', 3)} || ' --> ' || {_sql_stamp('e', ',', 3)} || {NL} || text || {NL}, {NL} ORDER BY i) AS file FROM z GROUP BY 1"),
    "lrc_render": (_rendered("lrc"), f"SELECT song, string_agg('[' || {LRC_STAMP} || ']' || text, {NL} ORDER BY s, line) AS file FROM {Z} GROUP BY 1"),
    "ass_render": (_rendered("ass"), f"SELECT song, '{ASS_HEAD}' || {NL} || string_agg('Dialogue: 0,' || {_sql_stamp('s', '.', 2, 1)} || ',' || {_sql_stamp('e', '.', 2, 1)} || ',Default,' || text, {NL} ORDER BY s, line) AS file FROM {Z} GROUP BY 1"),
    "json_render": (_rendered("json"), f"SELECT song, '[' || string_agg('{{\"text\":\"' || text || '\",\"start\":' || s || ',\"end\":' || e || '}}', ',' ORDER BY s, line) || ']' AS file FROM {Z} GROUP BY 1"),
    "srt_round_trip": (srt_round_trip, f"SELECT song, count(*) AS n, sum(e // 1000 - s // 1000) * 1000 AS length, count(*) AS last FROM {Z} GROUP BY 1"),
    "lrc_round_trip": (lrc_round_trip, f"SELECT song, s // 10000 * 10000 AS s, text FROM {Z}"),
    "json_props": (parse_props, "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events"),
}
