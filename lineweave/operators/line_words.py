"""Words of a line that cover its whole text, lines whose words can't be right, and two sources of word times
in one line.

Words are rows (song, line, k, word, s, e), lines (song, line, text, s, e), times in microseconds.  Words of a
line are windows by song and line, or an array in the line's row.  Null and empty words are none; a line
with a null text or without words has none; a line without words is never wrong; of equal words the
smaller number is first; where both sources are as good the line keeps its own; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.operators.intervals import HOUR
from lineweave.operators.words import days, once, vocal_window
from lineweave.sources.tables import TIMED_SQL, timed_lines

LINE = ["song", "line"]
HIT = "struct<pos: int, size: int, s: bigint, e: bigint>"
PIECE = "array<struct<word: string, s: bigint, e: bigint, measured: boolean>>"
#: Letters that may be passed over to get to the next word.
REACH = 4


def placed(text: str, words: str) -> Column:
    """Hits (pos from 1, size, s, e) of words (word, s, e) in order, each at its next place in the text; one
    that doesn't come within REACH letters is no word of this text and is passed by."""
    at = f"locate(x.word, {text}, a.p)"
    hit = f"named_struct('pos', {at}, 'size', length(x.word), 's', x.s, 'e', x.e)"
    step = f"if(coalesce(x.word <> '' AND {at} BETWEEN a.p AND a.p + {REACH}, false), struct({at} + length(x.word) AS p, array_append(a.hits, {hit}) AS hits), a)"
    return F.expr(f"aggregate({words}, struct(1 AS p, CAST(array() AS array<{HIT}>) AS hits), (a, x) -> {step}, a -> a.hits)")


def covering(text: Column, hits: Column, line_s: Column, line_e: Column, most: int) -> Column:
    """Pieces (word, s, e, measured) that are the text when joined: hits with their times, and the letters
    between them in equal steps from one hit's end to the next one's start.  Before the first and after the
    last, letters take no more than most each of what is left of the line; without any hit, they share it."""

    def letters(a: Column, b: Column, v: Column) -> Column:
        first, until = F.when(a.isNull(), 1).otherwise(a.pos + a.size), F.when(b.isNull(), F.length(v.text) + 1).otherwise(b.pos)
        n = until - first
        inner = F.when(a.isNull() & b.isNull(), F.coalesce(v.s, F.lit(0))).when(a.isNull(), F.least(F.greatest(F.coalesce(v.s, b.s), b.s - most * n.cast("long")), b.s)).otherwise(a.e)
        outer = F.when(a.isNull() & b.isNull(), F.coalesce(v.e, inner)).when(b.isNull(), F.least(F.coalesce(v.e, a.e), a.e + most * n.cast("long"))).otherwise(b.s)
        gap = F.struct(first.alias("first"), n.alias("n"), inner.alias("lo"), (F.greatest(outer, inner) - inner).alias("long"))
        one = lambda g, k: F.struct(F.substr(v.text, g.first + k, F.lit(1)).alias("word"), (g.lo + F.floor(g.long * k / g.n)).alias("s"), (g.lo + F.floor(g.long * (k + 1) / g.n)).alias("e"), F.lit(False).alias("measured"))
        return once(gap, lambda g: F.when(g.n > 0, F.transform(F.sequence(F.lit(0), g.n - 1), lambda k: one(g, k))).otherwise(F.array().cast(PIECE)))

    def part(v: Column, i: Column) -> Column:
        a, b = F.when(i > 0, F.get(v.hits, i - 1)), F.get(v.hits, i)
        own = F.when(b.isNotNull(), F.array(F.struct(F.substr(v.text, b.pos, b.size).alias("word"), b.s.alias("s"), b.e.alias("e"), F.lit(True).alias("measured")))).otherwise(F.array().cast(PIECE))
        return F.concat(once(F.struct(a.alias("a"), b.alias("b")), lambda x: letters(x.a, x.b, v)), own)

    line = F.struct(text.alias("text"), hits.alias("hits"), line_s.alias("s"), line_e.alias("e"))
    return once(line, lambda v: F.when(v.text.isNotNull() & v.hits.isNotNull(), F.flatten(F.transform(F.sequence(F.lit(0), F.size(v.hits)), lambda i: part(v, i)))))


def words_of(words: DataFrame) -> DataFrame:
    """song, line, words: those that aren't empty, in order."""
    one = F.struct("k", "word", "s", "e")
    return words.where("word <> ''").groupBy(*LINE).agg(F.array_sort(F.collect_list(one)).alias("words"))


def hits_of(lines: DataFrame, words: DataFrame) -> DataFrame:
    """The lines that have words, with hits of these in the text."""
    return lines.join(words_of(words), LINE).withColumn("hits", placed("text", "words"))


def full_words(lines: DataFrame, words: DataFrame, most: int) -> DataFrame:
    """song, line, k (from 0), word, s, e, measured: pieces that cover the whole text of the lines with words."""
    rows = hits_of(lines, words).select(*LINE, F.posexplode(covering(F.col("text"), F.col("hits"), F.col("s"), F.col("e"), most)).alias("k", "x"))
    return rows.select(*LINE, "k", "x.word", "x.s", "x.e", "x.measured")


def impossible_lines(lines: DataFrame, words: DataFrame, rate: float, slack: int, pressed: int) -> DataFrame:
    """song, line of lines (s, e) whose words, four at least, can't be right: they leave the line by over slack;
    the first is apart by over 0.4 of it; a third or more of the letters are in words (between blanks) of two
    letters and more that last no longer than pressed; or all are in less than half of it, at over rate letters
    a second."""
    w = Window.partitionBy(*LINE).orderBy("k")
    blank = F.trim("word") == ""
    rows = words.where("word <> ''").withColumns({"n": F.length("word").cast("long"), "n_s": F.lead("s").over(w), "i": F.row_number().over(w), "part": F.count_if(blank).over(w.rowsBetween(Window.unboundedPreceding, 0)), "blank": blank})
    own = lambda c: F.when(~F.col("blank"), F.col(c))
    parts = rows.groupBy(*LINE, "part").agg(
        F.sum(own("n")).alias("letters"), (F.max(own("e")) - F.min(own("s"))).alias("long"), F.count(F.lit(1)).alias("words"), F.sum("n").alias("n"), F.min("s").alias("lo"), F.max("e").alias("hi"), F.max(F.when(F.col("i") == 1, F.col("n_s") - F.col("s"))).alias("lead")
    )
    thin = F.when((F.col("letters") > 1) & (F.col("long") <= pressed), F.col("letters")).otherwise(0)
    g = parts.groupBy(*LINE).agg(F.sum("letters").alias("letters"), F.sum(thin).alias("thin"), F.sum("words").alias("words"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("lead").alias("lead"))
    g = g.join(lines.select(*LINE, "s", "e"), LINE).withColumns({"long": F.col("e") - F.col("s"), "width": F.col("hi") - F.col("lo")})
    outside = (F.col("lo") < F.col("s") - slack) | (F.col("hi") > F.col("e") + slack)
    tight = (2 * F.col("width") < F.col("long")) & ((F.col("width") <= 0) | (F.col("n") * 1_000_000 > rate * F.col("width")))
    inside = (F.col("long") > 0) & ((10 * F.col("lead") > 4 * F.col("long")) | F.coalesce((F.col("letters") > 0) & (3 * F.col("thin") >= F.col("letters")), F.lit(False)) | tight)
    return g.where((F.col("words") >= 4) & (outside | inside)).select(*LINE)


def fused_words(lines: DataFrame, own: DataFrame, other_lines: DataFrame, other: DataFrame, window: DataFrame, rate: float, slack: int, pressed: int, most: int) -> DataFrame:
    """song, line, k, word, s, e, fused: the words of another source on the lines with the same text, stretched
    from where they are to the line's window (song, line, s, e; else the whole line), in order: no start comes
    before the last end.  A line keeps its own words if the other's can't be right or don't last, give fewer
    different starts, or if their starts are apart from those of its own equal words by over most in the
    (upper) middle."""
    starts = lambda ls, ws: hits_of(ls, ws).select(*LINE, F.size(F.array_distinct(F.transform("hits", lambda h: h.s))).alias("starts"))
    same = lines.select(*LINE, "text", "s", "e").join(other_lines.select(*LINE, F.col("text").alias("o_text")), LINE).where("text = o_text AND e > s")
    fit = same.join(impossible_lines(other_lines, other, rate, slack, pressed), LINE, "left_anti")
    fit = fit.join(starts(other_lines, other).withColumnRenamed("starts", "there"), LINE).join(starts(lines, own).withColumnRenamed("starts", "here"), LINE, "left").where("there >= coalesce(here, 0)")
    fit = fit.join(window.select(*LINE, F.col("s").alias("w_s"), F.col("e").alias("w_e")), LINE, "left")
    fit = fit.select(*LINE, F.coalesce("w_s", "s").alias("t0"), F.coalesce("w_e", "e").alias("t1"))
    all_, w = Window.partitionBy(*LINE), Window.partitionBy(*LINE).orderBy("k")
    new = other.where("word <> ''").select(*LINE, "k", "word", "s", "e").withColumns({"lo": F.min("s").over(all_), "hi": F.max("e").over(all_)}).where("hi > lo").join(fit, LINE)
    onto = lambda c: F.col("t0") + F.floor((F.col(c) - F.col("lo")).cast("double") * (F.col("t1") - F.col("t0")) / (F.col("hi") - F.col("lo")))
    new = new.withColumns({"x": onto("s"), "y": onto("e")})
    before = F.coalesce(F.max(F.greatest("x", "y")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("t0"))
    new = new.withColumn("before", before).select(*LINE, "k", "word", F.greatest("x", "before").alias("s"), F.greatest("y", "x", "before").alias("e"))
    nth = F.row_number().over(Window.partitionBy(*LINE, "word").orderBy("k")).alias("nth")
    mine = own.where("word <> ''").select(*LINE, "k", "word", "s", "e")
    apart = new.select(*LINE, "word", "s", nth).join(mine.select(*LINE, "word", F.col("s").alias("o_s"), nth), [*LINE, "word", "nth"])
    middle = apart.groupBy(*LINE).agg(F.array_sort(F.collect_list(F.abs(F.col("s") - F.col("o_s")))).alias("d"))
    far = middle.where(F.get("d", F.floor(F.size("d") / 2).cast("int")) > most).select(*LINE)
    new = new.join(far, LINE, "left_anti").withColumn("fused", F.lit(True))
    kept = mine.join(new.select(*LINE).distinct(), LINE, "left_anti").withColumn("fused", F.lit(False))
    return new.unionByName(kept)


def resynthesized(lines: DataFrame, words: DataFrame, targets: DataFrame) -> DataFrame:
    """song, line, k, word, s, e: the words of target lines share their line by letters, others stay."""
    w = Window.partitionBy(*LINE)
    rows = words.where("word <> ''").join(targets.select(*LINE).distinct().withColumn("target", F.lit(True)), LINE, "left").join(lines.select(*LINE, F.col("s").alias("l_s"), F.col("e").alias("l_e")), LINE)
    rows = rows.withColumns({"upto": F.sum(F.length("word")).over(w.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum(F.length("word")).over(w)})
    share = lambda c: F.col("l_s") + F.floor((F.col("l_e") - F.col("l_s")) * c / F.col("n"))
    go = F.coalesce(F.col("target") & (F.col("l_e") > F.col("l_s")), F.lit(False))
    return rows.select(*LINE, "k", "word", F.when(go, share(F.col("upto") - F.length("word"))).otherwise(F.col("s")).alias("s"), F.when(go, share(F.col("upto"))).otherwise(F.col("e")).alias("e"))


def _words(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Days of users as lines, from the first event's start on; their events as words, every fifth with a
    blank, every seventh misspelt; and as another source has them, later by their value, without every sixth."""
    t = days(timed_lines(spark, d))
    own = t.select(*LINE, "k", F.when(F.col("k") % 7 == 0, "zoo").when(F.col("k") % 5 == 0, " ").otherwise(F.col("text")).alias("word"), "s", F.least("e", F.col("s") + HOUR // 2).alias("e"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.when(F.col("k") % 5 == 0, " ").otherwise(F.col("text")).alias("text")))), lambda x: x["text"]), "")
    lines = t.groupBy(*LINE).agg(F.concat(F.lit("("), text, F.lit(")!")).alias("text"), F.min("s").alias("s"), F.max("line_e").alias("e"))
    later = (F.pmod(F.col("s"), F.lit(17)) * (HOUR // 40)).cast("long")
    other = own.where("k % 6 <> 0").select(*LINE, "k", "word", (F.col("s") + later).alias("s"), (F.col("e") + later + HOUR // 10).alias("e"))
    return lines, own, other


MOST, RATE, SLACK, PRESSED, APART = HOUR // 20, 0.004, HOUR, HOUR // 4, HOUR // 6


def q_full(spark, d):
    lines, own, _ = _words(spark, d)
    return full_words(lines, own, MOST)


def q_impossible(spark, d):
    lines, own, _ = _words(spark, d)
    return impossible_lines(lines, own, RATE, SLACK, PRESSED)


def _window(lines: DataFrame, words: DataFrame) -> DataFrame:
    rows = words.join(lines.select(*LINE, F.col("s").alias("line_s"), F.col("e").alias("line_e")), LINE)
    return vocal_window(rows.withColumnRenamed("word", "text"), HOUR, 0.002)


def q_fused(spark, d):
    lines, own, other = _words(spark, d)
    return fused_words(lines, own, lines, other, _window(lines, own), RATE, SLACK, PRESSED, APART)


def q_resynthesized(spark, d):
    """Lines whose words can't be right, and those of days that seven divides."""
    lines, own, _ = _words(spark, d)
    return resynthesized(lines, own, impossible_lines(lines, own, RATE, SLACK, PRESSED).unionByName(lines.where("line % 7 = 0").select(*LINE)))


H, DAY = HOUR, 24 * HOUR
#: t: events of a day; o, z: words of the two sources; l: lines; h: hits, a step for each word.
WORDS_SQL = f"""t AS (SELECT song, s // {DAY} AS line, row_number() OVER (PARTITION BY song, s // {DAY} ORDER BY s, line) AS k, text, s, e FROM {TIMED_SQL}),
o AS (SELECT song, line, k, CASE WHEN k % 7 = 0 THEN 'zoo' WHEN k % 5 = 0 THEN ' ' ELSE text END AS word, s, least(e, s + {H // 2}) AS e FROM t),
l AS (SELECT song, line, '(' || string_agg(CASE WHEN k % 5 = 0 THEN ' ' ELSE text END, '' ORDER BY k) || ')!' AS text, min(s) AS s, (line + 1) * {DAY} AS e FROM t GROUP BY song, line),
z AS (SELECT song, line, k, word, s + s % 17 * {H // 40} AS s, e + s % 17 * {H // 40} + {H // 10} AS e FROM o WHERE k % 6 <> 0)"""


def _hits(name: str, words: str) -> str:
    return f"""{name}w AS (SELECT *, row_number() OVER (PARTITION BY song, line ORDER BY k) AS i FROM {words} WHERE word <> ''),
{name} AS (SELECT DISTINCT song, line, 0::BIGINT AS i, 1 AS p, NULL::INT AS pos, NULL::INT AS size, NULL::BIGINT AS s, NULL::BIGINT AS e FROM {name}w
UNION ALL SELECT song, line, i, CASE WHEN ok THEN pos + size ELSE p END, CASE WHEN ok THEN pos END, size, s, e FROM (SELECT w.song, w.line, w.i, p, (p - 1 + strpos(substr(text, p), word))::INT AS pos, length(word)::INT AS size, w.s, w.e, strpos(substr(text, p), word) BETWEEN 1 AND {REACH + 1} AS ok FROM {name} h JOIN {name}w w ON w.song = h.song AND w.line = h.line AND w.i = h.i + 1 JOIN l ON l.song = h.song AND l.line = h.line))"""


def _bad(words: str) -> str:
    return f"""(SELECT song, line FROM (SELECT *, e - s AS long, hi - lo AS width FROM (SELECT song, line, sum(letters) AS letters, sum(CASE WHEN letters > 1 AND part_long <= {PRESSED} THEN letters ELSE 0 END) AS thin, sum(words) AS words, sum(n) AS n, min(lo) AS lo, max(hi) AS hi, max(head) AS head FROM (SELECT song, line, part, sum(length(word)) FILTER (trim(word) <> '') AS letters, max(e) FILTER (trim(word) <> '') - min(s) FILTER (trim(word) <> '') AS part_long, count(*) AS words, sum(length(word)) AS n, min(s) AS lo, max(e) AS hi, max(n_s - s) FILTER (i = 1) AS head FROM (SELECT *, row_number() OVER w AS i, lead(s) OVER w AS n_s, count(*) FILTER (trim(word) = '') OVER (w ROWS UNBOUNDED PRECEDING) AS part FROM {words} WINDOW w AS (PARTITION BY song, line ORDER BY k)) GROUP BY 1, 2, 3) GROUP BY 1, 2) JOIN l USING (song, line)) WHERE words >= 4 AND (lo < s - {SLACK} OR hi > e + {SLACK} OR long > 0 AND (10 * head > 4 * long OR coalesce(letters > 0 AND 3 * thin >= letters, false) OR 2 * width < long AND (width <= 0 OR n * 1000000 > {RATE}::DOUBLE * width))))"""


FULL_SQL = f"""g AS (SELECT *, row_number() OVER (PARTITION BY song, line ORDER BY i) AS r FROM h WHERE pos IS NOT NULL),
ll AS (SELECT * FROM l WHERE EXISTS (SELECT 1 FROM hw WHERE hw.song = l.song AND hw.line = l.line)),
b AS (SELECT ll.song, ll.line, ll.text, ll.s AS l_s, ll.e AS l_e, r, a.pos + a.size AS first, a.e AS a_e, NULL::INT AS until, NULL::BIGINT AS b_s FROM ll JOIN g a USING (song, line)
UNION ALL SELECT song, line, text, s, e, 0, NULL, NULL, NULL, NULL FROM ll),
c AS (SELECT b.* REPLACE (n.pos AS until, n.s AS b_s) FROM b LEFT JOIN g n ON n.song = b.song AND n.line = b.line AND n.r = b.r + 1),
x AS (SELECT *, coalesce(first, 1) AS f, coalesce(until, length(text) + 1) - coalesce(first, 1) AS n FROM c),
y AS (SELECT *, CASE WHEN r = 0 AND until IS NULL THEN l_s WHEN r = 0 THEN least(greatest(l_s, b_s - {MOST} * n), b_s) ELSE a_e END AS lo FROM x),
q AS (SELECT *, greatest(CASE WHEN r = 0 AND until IS NULL THEN l_e WHEN until IS NULL THEN least(l_e, a_e + {MOST} * n) ELSE b_s END, lo) - lo AS long FROM y),
p AS (SELECT song, line, f + j AS pos, substr(text, f + j, 1) AS word, lo + floor((long * j)::DOUBLE / n)::BIGINT AS s, lo + floor((long * (j + 1))::DOUBLE / n)::BIGINT AS e, false AS measured FROM (SELECT *, unnest(range(n)) AS j FROM q)
UNION ALL SELECT song, line, g.pos, substr(ll.text, g.pos, g.size), g.s, g.e, true FROM g JOIN ll USING (song, line))"""
FUSED_SQL = f"""sz AS (SELECT song, line, count(DISTINCT s) FILTER (pos IS NOT NULL) AS n FROM hz GROUP BY 1, 2),
so AS (SELECT song, line, count(DISTINCT s) FILTER (pos IS NOT NULL) AS n FROM ho GROUP BY 1, 2),
v AS (SELECT song, line, greatest(lo, s) AS s, least(hi, e) AS e FROM (SELECT song, line, min(o.s) AS lo, max(o.e) AS hi, sum(length(word)) AS n, l.s, l.e FROM o JOIN l USING (song, line) GROUP BY song, line, l.s, l.e) WHERE lo >= s - {H} AND hi <= e + {H} AND least(hi, e) > greatest(lo, s) AND n * 1000000 <= 0.002::DOUBLE * (least(hi, e) - greatest(lo, s))),
f AS (SELECT l.song, l.line, coalesce(v.s, l.s) AS t0, coalesce(v.e, l.e) AS t1 FROM l JOIN sz USING (song, line) LEFT JOIN so USING (song, line) LEFT JOIN v USING (song, line) WHERE l.e > l.s AND sz.n >= coalesce(so.n, 0) AND (l.song, l.line) NOT IN {_bad("z")}),
n0 AS (SELECT z.*, min(s) OVER w AS lo, max(e) OVER w AS hi FROM z WINDOW w AS (PARTITION BY song, line)),
n1 AS (SELECT song, line, k, word, t0, t0 + floor((s - lo)::DOUBLE * (t1 - t0) / (hi - lo))::BIGINT AS x, t0 + floor((e - lo)::DOUBLE * (t1 - t0) / (hi - lo))::BIGINT AS y FROM n0 JOIN f USING (song, line) WHERE hi > lo),
n2 AS (SELECT *, coalesce(max(greatest(x, y)) OVER (PARTITION BY song, line ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), t0) AS past FROM n1),
n3 AS (SELECT song, line, k, word, greatest(x, past) AS s, greatest(y, x, past) AS e, row_number() OVER (PARTITION BY song, line, word ORDER BY k) AS nth FROM n2),
d AS (SELECT song, line, list_sort(list(abs(n3.s - m.s))) AS d FROM n3 JOIN (SELECT *, row_number() OVER (PARTITION BY song, line, word ORDER BY k) AS nth FROM o) m USING (song, line, word, nth) GROUP BY 1, 2),
far AS (SELECT song, line FROM d WHERE d[len(d) // 2 + 1] > {APART}),
won AS (SELECT * FROM n3 WHERE (song, line) NOT IN (SELECT song, line FROM far))"""
QUERIES = {
    "full_words": (q_full, f"WITH RECURSIVE {WORDS_SQL}, {_hits('h', 'o')}, {FULL_SQL} SELECT song, line, (row_number() OVER (PARTITION BY song, line ORDER BY pos) - 1)::INT AS k, word, s, e, measured FROM p"),
    "impossible_lines": (q_impossible, f"WITH {WORDS_SQL} SELECT * FROM {_bad('o')}"),
    "fused_words": (q_fused, f"WITH RECURSIVE {WORDS_SQL}, {_hits('hz', 'z')}, {_hits('ho', 'o')}, {FUSED_SQL} SELECT song, line, k, word, s, e, true AS fused FROM won UNION ALL SELECT song, line, k, word, s, e, false FROM o WHERE (song, line) NOT IN (SELECT song, line FROM won)"),
    "resynthesized_lines": (
        q_resynthesized,
        f"WITH {WORDS_SQL}, u AS (SELECT o.*, l.s AS l_s, l.e AS l_e, sum(length(word)) OVER (PARTITION BY o.song, o.line ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto, sum(length(word)) OVER (PARTITION BY o.song, o.line) AS n, o.line % 7 = 0 OR (o.song, o.line) IN {_bad('o')} AS target FROM o JOIN l ON l.song = o.song AND l.line = o.line) SELECT song, line, k, word, CASE WHEN target AND l_e > l_s THEN l_s + floor(((l_e - l_s) * (upto - length(word)))::DOUBLE / n)::BIGINT ELSE s END AS s, CASE WHEN target AND l_e > l_s THEN l_s + floor(((l_e - l_s) * upto)::DOUBLE / n)::BIGINT ELSE e END AS e FROM u",
    ),
}
