"""Times of letters, syllables and words inside a line, and of a line's tail.

Letters and syllables of a line are arrays in its row, so that nothing is exchanged for them; words are
rows, and windows by song and line.  Null texts and empty lists give no times; words with a null time are
in no gap; of words with equal starts the smaller number is first; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.operators.intervals import HOUR, by_start, overlaps
from lineweave.operators.repairs import L, V, W, sung
from lineweave.sources.tables import TIMED_SQL, dealt, table, timed_lines

#: A letter that is found, with its place in the text (from 1).
HIT = "struct<pos: int, s: bigint, e: bigint>"


def letters_found(text: str, spans: str) -> Column:
    """Spans (letter, s, e) in order, each at the next place of its letter in the text; a span whose
    letter doesn't come any more is passed by."""
    step = f"(a, x) -> if(locate(x.letter, {text}, a.p + 1) > 0, struct(locate(x.letter, {text}, a.p + 1) AS p, array_append(a.hits, struct(locate(x.letter, {text}, a.p + 1) AS pos, x.s AS s, x.e AS e)) AS hits), a)"
    return F.expr(f"aggregate({spans}, struct(0 AS p, CAST(array() AS array<{HIT}>) AS hits), {step}, a -> a.hits)")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def letter_times(text: Column, hits: Column) -> Column:
    """Array of (s, e) by letter: as found; between two that are, in equal steps; at the ends, as the nearest."""

    def at(known: Column, p: Column) -> Column:
        a, b = F.array_max(F.filter(known, lambda h: h.pos <= p)), F.array_min(F.filter(known, lambda h: h.pos >= p))
        return once(F.struct(a.alias("a"), b.alias("b")), lambda x: place(x.a, x.b, p))

    def place(a: Column, b: Column, p: Column) -> Column:
        step = (b.s - a.e) / (b.pos - a.pos)
        between = lambda k: F.floor(a.e + step * k)
        s = F.when(a.isNull(), b.s).when(b.isNull() | (a.pos == p), a.s).otherwise(between(p - a.pos - 1))
        e = F.when(a.isNull(), b.e).when(b.isNull() | (a.pos == p), a.e).otherwise(between(p - a.pos))
        return F.struct(s.alias("s"), e.alias("e"))

    places = F.sequence(F.lit(1), F.length(text))
    return once(hits, lambda known: F.when((F.size(known) > 0) & (F.length(text) > 0), F.transform(places, lambda p: at(known, p))))


def syllable_times(syllables: Column, times: Column) -> Column:
    """Array of (s, e) by syllable (a, b: first letter from 1, letter after the last), in order of the
    text; those of the same letters share their time in equal parts; one without letters has none."""

    def at(x: Column, i: Column) -> Column:
        first, n = F.array_position(syllables, x), F.size(F.filter(syllables, lambda y: y == x))
        s, e = F.get(times, x.a - 1).s, F.get(times, F.least(x.b - 1, F.size(times)) - 1).e
        long = F.greatest(e - s, F.lit(0))
        k = i + 1 - first
        return F.struct((s + F.floor(long * k / n)).alias("s"), (s + F.floor(long * (k + 1) / n)).alias("e"))

    return F.transform(syllables, at)


def anchor_spans(words: DataFrame, longest: int, shortest: int) -> DataFrame:
    """song, line, k, s, until: a word is sung up to the next one or the end of its line (line_e), but no
    longer than this after its own end."""
    nxt = F.coalesce(F.lead("s").over(Window.partitionBy("song", "line").orderBy("k")), "line_e")
    cap = F.greatest("e", F.col("s") + shortest) + longest
    return words.select("song", "line", "k", "s", F.greatest("s", F.least(nxt, "line_e", cap)).alias("until"))


def vocal_window(words: DataFrame, slack: int, most: float) -> DataFrame:
    """song, line, s, e: where a line's words are, inside the line (line_s, line_e).  Not for lines whose
    words are outside by over slack, or more letters than most for each second."""
    g = words.where("s IS NOT NULL AND e IS NOT NULL").groupBy("song", "line", "line_s", "line_e").agg(F.min("s").alias("lo"), F.max("e").alias("hi"), F.sum(F.length("text")).alias("n"))
    g = g.where((F.col("lo") >= F.col("line_s") - slack) & (F.col("hi") <= F.col("line_e") + slack)).select("song", "line", "n", F.greatest("lo", "line_s").alias("s"), F.least("hi", "line_e").alias("e"))
    return g.where((F.col("e") > F.col("s")) & (F.col("n") * 1_000_000 <= most * (F.col("e") - F.col("s")))).drop("n")


def presence(frames: DataFrame, width: int) -> DataFrame:
    """song, line, presence: share of voiced frames in a window of this many; beyond the ends none is."""
    w = by_start().rowsBetween(-(width // 2), (width - 1) // 2)
    return frames.select("song", "line", (F.sum(F.when(F.col("f0") > 0, 1).otherwise(0)).over(w) / width).alias("presence"))


def padded_matches(words: DataFrame, shortest: int, near: int) -> DataFrame:
    """song, line, s, e: times of a matched line; one that is shorter than shortest lasts that long if the
    next word comes within near."""
    close = F.lead("s").over(by_start()) - F.col("e") < near
    return words.select("song", "line", "s", F.when((F.col("e") - F.col("s") < shortest) & close, F.greatest("e", F.col("s") + shortest)).otherwise(F.col("e")).alias("e"))


def pull_tails(words: DataFrame, voice: DataFrame, gap: int, silence: int, after: int, tail: int = 2) -> DataFrame:
    """song, line, k, s, e: of a line that breaks at a gap with this long a silence in it, the last words,
    if they are no more than tail, go to just after the words before, but not into the next line."""
    w = Window.partitionBy("song", "line").orderBy("k")
    rows = words.withColumns({"until": F.greatest("s", "e"), "n_s": F.lead("s").over(w), "left": F.count(F.lit(1)).over(Window.partitionBy("song", "line")) - F.row_number().over(w)})
    broken = rows.where((F.col("n_s") - F.col("until") >= gap) & F.col("left").between(1, tail)).select("song", "line", "k", "until", "n_s")
    hole = broken.select("song", F.struct("line", "k").alias("line"), F.col("until").alias("s"), F.col("n_s").alias("e"))
    by_hole = Window.partitionBy("song", "a").orderBy("b_s")
    o = overlaps(hole, voice).withColumns({"was": F.coalesce(F.lag("b_e").over(by_hole), "a_s"), "last": F.lead("b_s").over(by_hole).isNull()})
    runs = o.groupBy("song", "a").agg(F.greatest(F.max(F.col("b_s") - F.col("was")), F.max(F.when(F.col("last"), F.col("a_e") - F.col("b_e")))).alias("run"))
    broken = broken.join(runs.select("song", F.col("a.line").alias("line"), F.col("a.k").alias("k"), "run"), ["song", "line", "k"], "left")
    cut = broken.where(F.coalesce("run", F.col("n_s") - F.col("until")) >= silence).groupBy("song", "line").agg(F.min("k").alias("cut"), F.min_by("until", "k").alias("body"))
    starts = words.groupBy("song", "line").agg(F.min("s").alias("first"))
    starts = starts.withColumn("next", F.lead("first").over(Window.partitionBy("song").orderBy("line")))
    rows = words.join(cut, ["song", "line"], "left").join(starts.select("song", "line", "next"), ["song", "line"], "left")
    to = F.greatest(F.least(F.col("body") + after, F.col("next") - 10_000), "body")
    moved = F.col("k") > F.col("cut")
    return rows.select("song", "line", "k", F.when(moved, to).otherwise(F.col("s")).alias("s"), F.when(moved, to).otherwise(F.col("e")).alias("e"))


def hold_tails(lines: DataFrame, voice: DataFrame, most: int, least: int) -> DataFrame:
    """song, line, new_e: a line's end goes on with the voice that it ends in, up to most and to the next
    line; by least or not at all."""
    end = lines.select("song", "line", F.col("e").alias("s"), (F.col("e") + 1).alias("e"))
    on = overlaps(end, voice).groupBy("song", F.col("a").alias("line")).agg(F.max("b_e").alias("voiced"))
    rows = lines.withColumn("next", F.lead("s").over(by_start())).join(on, ["song", "line"], "left")
    stop = F.least(F.coalesce("next", F.col("e") + most), F.col("e") + most, "voiced")
    return rows.select("song", "line", F.when(F.col("voiced").isNotNull() & (stop > F.col("e") + least), stop).otherwise(F.col("e")).alias("new_e"))


def _letters(spark, d):
    """Names of parts as lines, letters of their types as spans, 0.1 s each."""
    spans = F.transform(F.sequence(F.lit(1), F.length("p_type")), lambda k: F.struct(F.lower(F.substr("p_type", k, F.lit(1))).alias("letter"), (k.cast("long") * 100_000).alias("s"), (k.cast("long") * 100_000 + 60_000).alias("e")))
    rows = dealt(table(spark, d, "part"), "p_partkey").select("p_partkey", F.lower("p_name").alias("text"), spans.alias("spans"))
    return rows.withColumn("hits", letters_found("text", "spans"))


def q_letter_times(spark, d):
    t = _letters(spark, d).withColumn("times", letter_times(F.col("text"), F.col("hits")))
    return t.select("p_partkey", F.posexplode_outer("times").alias("k", "t")).where("k IS NOT NULL").select("p_partkey", "k", "t.s", "t.e")


def q_syllable_times(spark, d):
    """Three syllables on each two letters."""
    t = _letters(spark, d).withColumn("times", letter_times(F.col("text"), F.col("hits")))
    m = F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / 2).cast("int") * 3 - 1), lambda i: F.struct((F.floor(i / 3).cast("int") * 2 + 1).alias("a"), (F.floor(i / 3).cast("int") * 2 + 3).alias("b")))
    found = F.when(F.col("times").isNotNull() & (F.length("text") > 1), syllable_times(F.col("m"), F.col("times")))
    return t.withColumn("m", m).select("p_partkey", F.posexplode_outer(found).alias("k", "t")).where("k IS NOT NULL").select("p_partkey", "k", "t.s", "t.e")


def q_measured(spark, d):
    return _letters(spark, d).select("p_partkey", F.size(F.array_distinct(F.transform("hits", lambda h: h.s))).cast("long").alias("starts"))


def days(lines: DataFrame) -> DataFrame:
    """Events as words; a line is a day of a user, its words numbered in order."""
    day = 24 * HOUR
    rows = lines.withColumnRenamed("line", "word").withColumn("line", F.floor(F.col("s") / day).cast("long"))
    k = F.row_number().over(Window.partitionBy("song", "line").orderBy("s", "word")).cast("long")
    return rows.select("song", "line", k.alias("k"), "text", "s", "e", (F.col("line") * day).alias("line_s"), (F.col("line") * day + day).alias("line_e"))


def q_tails(spark, d):
    lines, voice = sung(spark, d)
    return pull_tails(days(lines), voice, 2 * HOUR, HOUR, HOUR // 3)


T, H, DAY = TIMED_SQL, HOUR, 24 * HOUR


def _days(of: str) -> str:
    return f"(SELECT song, d AS line, row_number() OVER (PARTITION BY song, d ORDER BY s, line) AS k, text, s, e, d * {DAY} AS line_s, (d + 1) * {DAY} AS line_e FROM (SELECT *, s // {DAY} AS d FROM {of}))"


LETTERS = """c AS (SELECT p_partkey, lower(p_name) AS text, lower(p_type) AS ty FROM part),
h AS (SELECT p_partkey, 0::BIGINT AS k, 0::BIGINT AS pos, false AS hit FROM c UNION ALL SELECT c.p_partkey, h.k + 1, CASE WHEN strpos(substr(text, h.pos + 1), substr(ty, h.k + 1, 1)) > 0 THEN h.pos + strpos(substr(text, h.pos + 1), substr(ty, h.k + 1, 1)) ELSE h.pos END, strpos(substr(text, h.pos + 1), substr(ty, h.k + 1, 1)) > 0 FROM h JOIN c ON c.p_partkey = h.p_partkey WHERE h.k < length(ty)),
p AS (SELECT p_partkey, unnest(range(1, length(text) + 1)) AS pos FROM c),
q AS (SELECT p.*, k * 100000 AS s, k * 100000 + 60000 AS e FROM p LEFT JOIN h ON h.p_partkey = p.p_partkey AND h.pos = p.pos AND hit),
k AS (SELECT *, CASE WHEN s IS NOT NULL THEN pos END AS known FROM q),
a AS (SELECT *, last_value(known IGNORE NULLS) OVER w AS a_p, last_value(s IGNORE NULLS) OVER w AS a_s, last_value(e IGNORE NULLS) OVER w AS a_e, first_value(known IGNORE NULLS) OVER z AS b_p, first_value(s IGNORE NULLS) OVER z AS b_s, first_value(e IGNORE NULLS) OVER z AS b_e FROM k WINDOW w AS (PARTITION BY p_partkey ORDER BY pos ROWS UNBOUNDED PRECEDING), z AS (PARTITION BY p_partkey ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT p_partkey, pos, CASE WHEN a_p IS NULL THEN b_s WHEN b_p IS NULL OR a_p = pos THEN a_s ELSE floor(a_e + (b_s - a_e)::DOUBLE / (b_p - a_p) * (pos - a_p - 1))::BIGINT END AS s, CASE WHEN a_p IS NULL THEN b_e WHEN b_p IS NULL OR a_p = pos THEN a_e ELSE floor(a_e + (b_s - a_e)::DOUBLE / (b_p - a_p) * (pos - a_p))::BIGINT END AS e FROM a WHERE a_p IS NOT NULL OR b_p IS NOT NULL)"""

QUERIES = {
    "letter_times": (q_letter_times, f"WITH RECURSIVE {LETTERS} SELECT p_partkey, (pos - 1)::INT AS k, s, e FROM l"),
    "syllable_times": (
        q_syllable_times,
        f"WITH RECURSIVE {LETTERS}, x AS (SELECT a.p_partkey, (a.pos - 1) // 2 AS g, a.s, greatest(b.e - a.s, 0) AS long FROM l a JOIN l b ON b.p_partkey = a.p_partkey AND b.pos = a.pos + 1 WHERE a.pos % 2 = 1) SELECT p_partkey, (g * 3 + i)::INT AS k, s + long * i // 3 AS s, s + long * (i + 1) // 3 AS e FROM (SELECT *, unnest([0, 1, 2]) AS i FROM x)",
    ),
    "measured_anchors": (q_measured, f"WITH RECURSIVE {LETTERS} SELECT p_partkey, count(*) FILTER (hit) AS starts FROM h GROUP BY 1"),
    "anchor_spans": (
        lambda spark, d: anchor_spans(days(timed_lines(spark, d)), 3 * HOUR // 2, HOUR // 20),
        f"SELECT song, line, k, s, greatest(s, least(coalesce(lead(s) OVER (PARTITION BY song, line ORDER BY k), line_e), line_e, greatest(e, s + {H // 20}) + {3 * H // 2})) AS until FROM {_days(T)}",
    ),
    "vocal_window": (
        lambda spark, d: vocal_window(days(timed_lines(spark, d)), HOUR, 0.002),
        f"SELECT song, line, greatest(lo, line_s) AS s, least(hi, line_e) AS e FROM (SELECT song, line, line_s, line_e, min(s) AS lo, max(e) AS hi, sum(length(text)) AS n FROM {_days(T)} GROUP BY 1, 2, 3, 4) WHERE lo >= line_s - {H} AND hi <= line_e + {H} AND least(hi, line_e) > greatest(lo, line_s) AND n * 1000000 <= 0.002::DOUBLE * (least(hi, line_e) - greatest(lo, line_s))",
    ),
    "voice_presence": (
        lambda spark, d: presence(timed_lines(spark, d).withColumn("f0", F.greatest(F.col("value") - 30, F.lit(0))), 4),
        f"SELECT song, line, count(*) FILTER (value > 30) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4.0::DOUBLE AS presence FROM {T}",
    ),
    "padded_matches": (
        lambda spark, d: padded_matches(timed_lines(spark, d), 3 * HOUR, 2 * HOUR),
        f"SELECT song, line, s, CASE WHEN e - s < {3 * H} AND lead(s) OVER ({W}) - e < {2 * H} THEN greatest(e, s + {3 * H}) ELSE e END AS e FROM {T}",
    ),
    "pulled_tails": (
        q_tails,
        f"WITH v AS {V}, x AS (SELECT *, greatest(s, e) AS until, lead(s) OVER w AS n_s, count(*) OVER (PARTITION BY song, line) - k AS left_over FROM {_days(L)} WINDOW w AS (PARTITION BY song, line ORDER BY k)), b AS (SELECT * FROM x WHERE n_s - until >= {2 * H} AND left_over BETWEEN 1 AND 2), m AS (SELECT b.song, b.line, b.k, unnest(list_concat([b.until], coalesce(list(v.e ORDER BY v.s) FILTER (v.s IS NOT NULL), []))) AS a, unnest(list_concat(coalesce(list(v.s ORDER BY v.s) FILTER (v.s IS NOT NULL), []), [b.n_s])) AS z FROM b LEFT JOIN v ON v.song = b.song AND v.s < b.n_s AND b.until < v.e GROUP BY b.song, b.line, b.k, b.until, b.n_s), c AS (SELECT song, line, min(k) AS cut FROM (SELECT song, line, k FROM m GROUP BY 1, 2, 3 HAVING max(z - a) >= {H}) GROUP BY 1, 2), n AS (SELECT song, line, lead(min(s)) OVER (PARTITION BY song ORDER BY line) AS nxt FROM x GROUP BY 1, 2), y AS (SELECT x.song, x.line, x.k, x.s, x.e, CASE WHEN x.k > c.cut THEN greatest(least(o.until + {H // 3}, n.nxt - 10000), o.until) END AS t FROM x LEFT JOIN c ON c.song = x.song AND c.line = x.line LEFT JOIN x o ON o.song = c.song AND o.line = c.line AND o.k = c.cut LEFT JOIN n ON n.song = x.song AND n.line = x.line) SELECT song, line, k, coalesce(t, s) AS s, coalesce(t, e) AS e FROM y",
    ),
    "held_tails": (
        lambda spark, d: hold_tails(*sung(spark, d), 3 * HOUR, HOUR // 20),
        f"WITH v AS {V}, x AS (SELECT song, line, s, e, least(coalesce(lead(s) OVER ({W}), e + {3 * H}), e + {3 * H}) AS most FROM {L}), y AS (SELECT *, least(most, (SELECT max(v.e) FROM v WHERE v.song = x.song AND v.s <= x.e AND v.e > x.e)) AS stop, (SELECT max(v.e) FROM v WHERE v.song = x.song AND v.s <= x.e AND v.e > x.e) IS NOT NULL AS voiced FROM x) SELECT song, line, CASE WHEN voiced AND stop > e + {H // 20} THEN stop ELSE e END AS new_e FROM y",
    ),
}
