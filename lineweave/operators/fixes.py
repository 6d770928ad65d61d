"""Repairs of timings and curves: clumps, respacing, runs of notes, octave jumps, grids, stitched chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.operators.arrays import P, X, chunk_windows, frames, runs
from lineweave.operators.intervals import HOUR, by_start, gaps, overlaps, resolve_overlaps
from lineweave.operators.words import once
from lineweave.sources.tables import TIMED_SQL, micros, table, timed_lines

DAY = 24 * HOUR


def snap_octaves(x: Column, jump: int = 40, octave: int = 12) -> Column:
    """An array in which each value that is over jump away from the one before, as corrected, moves by
    whole octaves to the nearest place."""
    none = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<long>").alias("out"))

    def step(acc: Column, v: Column) -> Column:
        by = v - acc["last"]
        new = F.when(F.abs(by) > jump, v - octave * F.round(by / octave).cast("long")).otherwise(v)
        return F.struct(new.alias("last"), F.concat(acc["out"], F.array(new)).alias("out"))

    return F.aggregate(x, none, step)["out"]


def share_moment(rows: DataFrame, keys: list[str], at: str, order: str, long: int) -> DataFrame:
    """Rows of a key with one moment, two at least, at even steps over so long from it on, as new_at."""
    w = Window.partitionBy(*keys, at)
    t = rows.withColumns({"_i": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count(F.lit(1)).over(w)}).where(F.col("_n") > 1)
    return t.withColumn("new_at", F.col(at) + F.floor(F.col("_i") * long / F.col("_n"))).drop("_i", "_n")


def clump_subdivide(spark, d):
    """Lines of an order with one ship date share that day evenly."""
    t = table(spark, d, "lineitem").withColumn("day", micros("l_shipdate"))
    return share_moment(t, ["l_orderkey"], "day", "l_linenumber", DAY).select("l_orderkey", "l_linenumber", F.col("new_at").alias("at"))


def starts_by_length(words: DataFrame, keys: list[str], k: str, word: str, long: int) -> DataFrame:
    """Words with ``at``: where each starts if those of a key share so long by their letters."""
    all_ = Window.partitionBy(*keys)
    n = F.char_length(word).cast("long")
    before = F.coalesce(F.sum(n).over(all_.orderBy(k).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return words.withColumns({"_b": before, "_t": F.sum(n).over(all_)}).withColumn("at", F.floor(F.col("_b") * long / F.col("_t"))).drop("_b", "_t")


def proportional_resynth(spark, d):
    """Words of a turn spread over a second by their lengths."""
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    t = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(w).alias("k", "word"))
    return starts_by_length(t, ["conv_id", "turn"], "k", "word", 1_000_000).select("conv_id", "turn", "k", "at")


def moved_ends(before: DataFrame, after: DataFrame, least: int = 10_000) -> DataFrame:
    """song, line, moved: which ends of a line (s, e) are elsewhere after (new_s, new_e) by over least."""
    j = before.select("song", "line", "s", "e").join(after, ["song", "line"])
    head, tail = F.abs(F.col("new_s") - F.col("s")) > least, F.abs(F.col("new_e") - F.col("e")) > least
    return j.where(head | tail).select("song", "line", F.when(head & tail, "both").when(head, "start").otherwise("end").alias("moved"))


def diff_labels(spark, d):
    """Which ends of a line the repair of overlaps has moved."""
    t = timed_lines(spark, d)
    return moved_ends(t, resolve_overlaps(t))


def straddles(spark, d):
    """Clicks under way before and after a pause between views."""
    c = timed_lines(spark, d).where("text = 'click'")
    g = gaps(timed_lines(spark, d).where("text = 'view'")).select("song", "line", F.col("gap_start").alias("s"), F.col("gap_end").alias("e"))
    return overlaps(c, g).where("a_s < b_s AND a_e > b_e").groupBy("song", F.col("a").alias("line")).agg(F.count(F.lit(1)).alias("pauses"))


def spliced(lines: DataFrame, other: DataFrame) -> DataFrame:
    """song, line, at: starts from the other alignment (song, line, at) from the first line after the song's
    largest gap on.  A song without a gap isn't there; a line that the other lacks has none."""
    cut = gaps(lines).groupBy("song").agg(F.max_by("gap_end", F.struct("gap", -F.col("line"))).alias("cut"))
    both = lines.join(cut, "song").join(other.select("song", "line", F.col("at").alias("o_at")), ["song", "line"], "left")
    return both.select("song", "line", F.when(F.col("s") >= F.col("cut"), F.col("o_at")).otherwise(F.col("s")).alias("at"))


def splice(spark, d):
    """Ends as the other alignment."""
    t = timed_lines(spark, d)
    return spliced(t, t.select("song", "line", F.col("e").alias("at")))


def runs_of_pitch(notes: DataFrame, pause: int) -> DataFrame:
    """song, note, pitch, s, e, n: lines of one pitch with pauses under this between them are one note."""
    w = by_start()
    same = (F.lag("pitch").over(w) == F.col("pitch")) & (F.col("s") - F.lag("e").over(w) < pause)
    t = notes.withColumn("turn", F.when(same, 0).otherwise(1)).withColumn("note", F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return t.groupBy("song", "note", "pitch").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count(F.lit(1)).alias("n"))


def note_runs(spark, d):
    return runs_of_pitch(timed_lines(spark, d).withColumn("pitch", F.floor(F.col("value") / 20)), DAY)


def octave_snap(spark, d):
    """Curves with their jumps of over 0.3 taken out."""
    x = F.transform("x", lambda v: F.round(v / 10_000).cast("long"))
    return frames(spark, d).select("vec_id", F.array_join(snap_octaves(x, 30, 12), ",").alias("curve"))


def off_median(lines: DataFrame, value: str, reach: int) -> DataFrame:
    """song, line, off: how far a value is from the median of up to reach lines on both sides and itself."""
    m = F.expr(f"percentile({value}, 0.5)").over(by_start().rowsBetween(-reach, reach))
    return lines.select("song", "line", (F.col(value) - m).alias("off"))


def median_fold(spark, d):
    return off_median(timed_lines(spark, d), "value", 3).withColumn("off", F.round("off", 6))


def most_covered(spans: DataFrame, voice: DataFrame) -> DataFrame:
    """song, most: the most voice time that one span of a song covers."""
    return overlaps(spans, voice).groupBy("song", "a").agg(F.sum("overlap").alias("o")).groupBy("song").agg(F.max("o").alias("most"))


def swallowed(spark, d):
    t = timed_lines(spark, d)
    return most_covered(t.where("text = 'click'"), t.where("text = 'view'"))


def whole_frames(spans: DataFrame, width: int) -> DataFrame:
    """song, frame: the frames of a song that lie wholly in one of its spans."""
    a, b = F.ceil(F.col("s") / width), F.floor(F.col("e") / width) - 1
    t = spans.select("song", a.alias("a"), b.alias("b")).where("a <= b")
    return t.select("song", F.explode(F.sequence("a", "b")).alias("frame")).distinct()


def forbidden_frames(spark, d):
    """How many six-hour frames of a song lie wholly in a line."""
    return whole_frames(timed_lines(spark, d), 6 * HOUR).groupBy("song").agg(F.count(F.lit(1)).alias("frames"))


def peaks(x: Column, width: int) -> Column:
    """The largest of every width values; the last may be of fewer."""
    return F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), F.size(x) - 1, F.lit(width)), lambda i: F.array_max(F.slice(x, i + 1, F.lit(width)))))


def peak_support(spark, d):
    """The sum of the peaks of every eight values."""
    return frames(spark, d).select("vec_id", F.aggregate(peaks(F.col("x"), 8), F.lit(0).cast("long"), lambda a, v: a + v).alias("support"))


def longest_run(flags: Column) -> Column:
    """The longest run of true, (n, first) with first from 0, of equal ones the first; null for none."""
    best = F.array_max(F.transform(runs(flags), lambda z: F.struct((z["last"] - z["first"] + 1).alias("n"), (-z["first"]).alias("first"))))
    return once(best, lambda b: F.when(b.isNotNull(), F.struct(b["n"].cast("long").alias("n"), (-b["first"]).cast("long").alias("first"))))


def span_bounds(spark, d):
    """The first of the longest runs of positive values."""
    return frames(spark, d).select("vec_id", longest_run(F.transform("x", lambda v: v > 0)).alias("r")).select("vec_id", "r.n", "r.first")


def on_grid(x: Column, step: float, n: Column) -> Column:
    """The curve at n moments that are step of its own steps apart, on straight lines between its values; 0
    beyond its ends."""

    def at(v: Column, j: Column) -> Column:
        t = j * F.lit(float(step))
        lo, hi = F.floor(t).cast("int"), F.ceil(t).cast("int")
        return F.when(hi < F.size(v), F.get(v, lo) + (F.get(v, hi) - F.get(v, lo)) * (t - lo)).otherwise(0.0)

    return once(F.struct(x.cast("array<double>").alias("x"), n.alias("n")), lambda v: F.transform(F.sequence(F.lit(0), v.n - 1), lambda j: at(v.x, j)))


def grid_interpolation(spark, d):
    """Curves on a grid one and a half times as wide, up to one moment past their ends: twice the sum."""
    y = on_grid(F.col("x"), 1.5, F.floor(F.size("x") / 1.5).cast("int") + 2)
    return frames(spark, d).select("vec_id", F.round(2 * F.aggregate(y, F.lit(0.0), lambda a, v: a + v)).cast("long").alias("double_sum"))


def stitch(parts: DataFrame, key: str) -> DataFrame:
    """key, x: the kept parts of chunks (key, a, keep_a, keep_b, x: the chunk's own values) put together."""
    own = F.slice("x", (F.col("keep_a") - F.col("a") + 1).cast("int"), (F.col("keep_b") - F.col("keep_a")).cast("int"))
    return parts.groupBy(key).agg(F.flatten(F.array_sort(F.collect_list(F.struct("a", own.alias("own"))))["own"]).alias("x"))


def stitched(spark, d):
    """Chunks cut and put together again are the whole curve: its sum and length."""
    c = chunk_windows(spark, d).join(frames(spark, d), "vec_id").withColumn("x", F.slice("x", (F.col("a") + 1).cast("int"), (F.col("b") - F.col("a")).cast("int")))
    return stitch(c, "vec_id").select("vec_id", F.size("x").cast("long").alias("n"), F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


def every_nth(x: Column, n: int) -> Column:
    """The first of every n values."""
    return F.filter(x, lambda v, i: i % n == 0)


def downsampled(spark, d):
    return frames(spark, d).select("vec_id", F.posexplode(every_nth(F.col("x"), 4)).alias("i", "v")).select("vec_id", F.col("i").cast("long").alias("i"), "v")


def rises(x: Column) -> Column:
    """How much each value is above the one before, 0 where it isn't."""
    n = F.greatest(F.size(x) - 1, F.lit(0))
    return F.zip_with(F.slice(x, F.lit(2), n), F.slice(x, F.lit(1), n), lambda b, a: F.greatest(b - a, b - b))


def unit_curve(x: Column) -> Column:
    """The curve less its mean, of length one; null if it is flat or empty."""

    def of(v: Column) -> Column:
        y = F.transform(v.x, lambda z: z - v.m)
        return once(F.struct(y.alias("y"), F.sqrt(F.aggregate(y, F.lit(0.0), lambda a, z: a + z * z)).alias("n")), lambda w: F.when(w.n > 1e-9, F.transform(w.y, lambda z: z / w.n)))

    x = x.cast("array<double>")
    return once(F.struct(x.alias("x"), (F.aggregate(x, F.lit(0.0), lambda a, z: a + z) / F.nullif(F.size(x), F.lit(0))).alias("m")), of)


def onset_envelope(spark, d):
    """Rises of a curve, less their mean and of length one."""
    return frames(spark, d).select("vec_id", F.posexplode(unit_curve(rises(F.col("x")))).alias("i", "v")).withColumn("v", F.round("v", 9))


def respace_repeats(lines: DataFrame, least: int = 3, factor: float = 1.5) -> DataFrame:
    """Starts of runs of lines with one text, spread evenly where the widest step is over factor medians."""
    w = by_start()
    t = lines.withColumn("turn", F.when(F.lag("text").over(w) == F.col("text"), 0).otherwise(1))
    t = t.withColumn("run", F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    in_run = Window.partitionBy("song", "run").orderBy("s", "line")
    t = t.withColumns({"i": F.row_number().over(in_run) - 1, "step": F.col("s") - F.lag("s").over(in_run)})
    each = t.groupBy("song", "run").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("a"), F.max("s").alias("b"), F.max("step").alias("most"), F.percentile("step", 0.5).alias("middle")).where((F.col("n") >= least) & (F.col("most") > factor * F.col("middle")))
    return t.join(each, ["song", "run"]).select("song", "line", (F.col("a") + F.floor((F.col("b") - F.col("a")) * F.col("i") / (F.col("n") - 1))).alias("new_s"))


def merge_rolling(captions: DataFrame) -> DataFrame:
    """Captions (song, k, text) of which each goes on where the one before stopped become one, the last."""
    w = Window.partitionBy("song").orderBy("k")
    c = captions.withColumn("turn", F.when(F.startswith("text", F.lag("text").over(w)), 0).otherwise(1))
    c = c.withColumn("run", F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return c.groupBy("song", "run").agg(F.max_by("text", "k").alias("text"))


def scaffold(lines: DataFrame, anchors: DataFrame, tolerance: int) -> DataFrame:
    """Starts held against anchors (song, line, anchor): a line near its anchor keeps its start, one far
    from it takes the anchor, one without is put evenly between the known lines around it (at the edges
    it keeps its start), and no line starts before one before it."""
    w = by_start()
    until, since = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    t = lines.select("song", "line", "s").join(anchors, ["song", "line"], "left").withColumn("i", F.row_number().over(w))
    known = F.when(F.abs(F.col("s") - F.col("anchor")) <= tolerance, F.col("s")).otherwise(F.col("anchor"))
    t = t.withColumn("k", F.when(F.col("anchor").isNotNull(), F.struct(known.alias("at"), "i")))
    t = t.withColumns({"p": F.last("k", ignorenulls=True).over(until), "n": F.first("k", ignorenulls=True).over(since)})
    between = F.col("p.at") + F.floor((F.col("n.at") - F.col("p.at")) * (F.col("i") - F.col("p.i")) / (F.col("n.i") - F.col("p.i")))
    t = t.withColumn("at", F.coalesce("k.at", between, "s"))
    return t.select("song", "line", F.max("at").over(until).alias("new_s"))


def grown_captions(turns: DataFrame, block: int = 8) -> DataFrame:
    """Captions (song: conv_id and turn; k, text) that grow by a word, of all words of all turns.  A
    caption shows the words since the last full block: the text stays linear, and a run breaks there."""
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    t = turns.select(F.struct("conv_id", "turn").alias("song"), w.alias("w")).where("size(w) > 0")
    grown = F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda n: F.array_join(F.slice("w", n - n % block + 1, n % block + 1), " "))
    return t.select("song", F.posexplode(grown).alias("k", "text"))


def rolling_captions_all(spark, d):
    """Every turn as captions that grow by a word, and what is left of them: its blocks of eight words."""
    return merge_rolling(grown_captions(table(spark, d, "conversations"))).select("song.conv_id", "song.turn", "run", "text")


def scaffold_query(spark, d):
    """Clicks against the views that they overlap first."""
    t = timed_lines(spark, d)
    c = t.where("text = 'click'")
    first = overlaps(c, t.where("text = 'view'")).groupBy("song", F.col("a").alias("line")).agg(F.min("b_s").alias("anchor"))
    return scaffold(c, first, 2 * HOUR)


T = TIMED_SQL
W = "PARTITION BY song ORDER BY s, line"
QUERIES = {
    "clump_subdivide": (clump_subdivide, f"SELECT l_orderkey, l_linenumber, epoch_us(l_shipdate) + floor(i * {DAY} / n::DOUBLE)::BIGINT AS at FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_shipdate ORDER BY l_linenumber) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey, l_shipdate) AS n FROM lineitem) WHERE n > 1"),
    "proportional_resynth": (proportional_resynth, r"WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM conversations), u AS (SELECT conv_id, turn, unnest(range(len(w))) AS k, length(unnest(w)) AS n FROM w) SELECT conv_id, turn, k::INT AS k, floor(coalesce(sum(n) OVER (PARTITION BY conv_id, turn ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE * 1000000 / (sum(n) OVER (PARTITION BY conv_id, turn))::DOUBLE)::BIGINT AS at FROM u"),
    "diff_labels": (diff_labels, f"WITH r AS (SELECT song, line, CASE WHEN p > s THEN s - (p + s) // 2 ELSE 0 END AS ds, CASE WHEN n < e THEN e - (e + n) // 2 ELSE 0 END AS de FROM (SELECT *, lead(s) OVER ({W}) AS n, lag(e) OVER ({W}) AS p FROM {T})) SELECT song, line, CASE WHEN abs(ds) > 10000 AND abs(de) > 10000 THEN 'both' WHEN abs(ds) > 10000 THEN 'start' ELSE 'end' END AS moved FROM r WHERE abs(ds) > 10000 OR abs(de) > 10000"),
    "straddles": (straddles, f"WITH g AS (SELECT song, e AS a, n AS b FROM (SELECT *, lead(s) OVER ({W}) AS n FROM {T} WHERE text = 'view') WHERE n > e) SELECT c.song, c.line, count(*) AS pauses FROM {T} c JOIN g ON c.song = g.song AND c.text = 'click' AND c.s < g.a AND c.e > g.b GROUP BY 1, 2"),
    "splice": (splice, f"WITH g AS (SELECT song, arg_max(n, (n - e, -line)) AS cut FROM (SELECT *, lead(s) OVER ({W}) AS n FROM {T}) WHERE n > e GROUP BY 1) SELECT t.song, line, CASE WHEN s >= cut THEN e ELSE s END AS at FROM {T} t JOIN g ON g.song = t.song"),
    "note_runs": (note_runs, f"WITH t AS (SELECT *, floor(value / 20)::BIGINT AS pitch FROM {T}), f AS (SELECT *, CASE WHEN lag(pitch) OVER ({W}) = pitch AND s - lag(e) OVER ({W}) < {DAY} THEN 0 ELSE 1 END AS f FROM t), r AS (SELECT *, sum(f) OVER ({W} ROWS UNBOUNDED PRECEDING) AS note FROM f) SELECT song, note, pitch, min(s) AS s, max(e) AS e, count(*) AS n FROM r GROUP BY 1, 2, 3"),
    "octave_snap": (
        octave_snap,
        f"SELECT vec_id, array_to_string(list_reduce(list_transform(x, lambda v: [round(v / 10000.0)::BIGINT]), lambda a, v: list_append(a, CASE WHEN abs(v[1] - a[-1]) > 30 THEN v[1] - 12 * round((v[1] - a[-1]) / 12.0)::BIGINT ELSE v[1] END)), ',') AS curve FROM {X}",
    ),
    "median_fold": (median_fold, f"SELECT song, line, round(value - quantile_cont(value, 0.5) OVER ({W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS off FROM {T}"),
    "swallowed": (swallowed, f"WITH o AS (SELECT c.song, c.line, sum(least(c.e, v.e) - greatest(c.s, v.s)) AS o FROM {T} c JOIN {T} v ON c.song = v.song AND c.text = 'click' AND v.text = 'view' AND c.s < v.e AND v.s < c.e GROUP BY 1, 2) SELECT song, max(o) AS most FROM o GROUP BY 1"),
    "forbidden_frames": (forbidden_frames, f"SELECT song, count(DISTINCT f) AS frames FROM (SELECT song, unnest(range(ceil(s / {6 * HOUR}.0)::BIGINT, floor(e / {6 * HOUR}.0)::BIGINT)) AS f FROM {T}) GROUP BY 1"),
    "peak_support": (peak_support, f"SELECT vec_id, sum(m)::BIGINT AS support FROM (SELECT vec_id, i // 8 AS f, max(v) AS m FROM {P} GROUP BY 1, 2) GROUP BY 1"),
    "span_bounds": (span_bounds, f"WITH g AS (SELECT *, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS g FROM {P} WHERE v > 0), r AS (SELECT vec_id, count(*) AS n, min(i) AS first FROM g GROUP BY vec_id, g) SELECT vec_id, n, first FROM r QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, first) = 1"),
    "grid_interpolation": (grid_interpolation, f"SELECT vec_id, sum(x[(j * 3 // 2 + 1)::INT] + x[((j * 3 + 1) // 2 + 1)::INT])::BIGINT AS double_sum FROM {X}, range(43) r(j) GROUP BY 1"),
    "stitched": (stitched, f"SELECT vec_id, count(*) AS n, sum(v)::BIGINT AS total FROM {P} GROUP BY 1"),
    "downsampled": (downsampled, f"SELECT vec_id, i // 4 AS i, v FROM {P} WHERE i % 4 = 0"),
    "onset_envelope": (onset_envelope, f"WITH r AS (SELECT a.vec_id, a.i, greatest(b.v - a.v, 0) AS r FROM {P} a JOIN {P} b ON a.vec_id = b.vec_id AND b.i = a.i + 1), m AS (SELECT *, r - avg(r) OVER (PARTITION BY vec_id) AS y FROM r) SELECT vec_id, i::INT AS i, round(y / sqrt(sum(y * y) OVER (PARTITION BY vec_id)), 9) AS v FROM m"),
    "respace_repeats": (lambda spark, d: respace_repeats(timed_lines(spark, d)), f"WITH t AS (SELECT *, CASE WHEN lag(text) OVER ({W}) = text THEN 0 ELSE 1 END AS f FROM {T}), r AS (SELECT *, sum(f) OVER ({W} ROWS UNBOUNDED PRECEDING) AS run FROM t), g AS (SELECT *, row_number() OVER x - 1 AS i, s - lag(s) OVER x AS step FROM r WINDOW x AS (PARTITION BY song, run ORDER BY s, line)), a AS (SELECT song, run, count(*) AS n, min(s) AS a, max(s) AS b FROM g GROUP BY 1, 2 HAVING count(*) >= 3 AND max(step) > 1.5::DOUBLE * quantile_cont(step, 0.5)) SELECT g.song, line, a + floor(((b - a) * i)::DOUBLE / (n - 1))::BIGINT AS new_s FROM g JOIN a ON a.song = g.song AND a.run = g.run"),
    "rolling_captions_all": (rolling_captions_all, r"WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM conversations) SELECT conv_id, turn, b + 1 AS run, array_to_string(w[b * 8 + 1:b * 8 + 8], ' ') AS text FROM (SELECT conv_id, turn, w, unnest(range((len(w) + 7) // 8)) AS b FROM w)"),
    "scaffold": (scaffold_query, f"WITH c AS (SELECT * FROM {T} WHERE text = 'click'), a AS (SELECT c.song, c.line, min(v.s) AS anchor FROM c JOIN {T} v ON v.text = 'view' AND v.song = c.song AND c.s < v.e AND v.s < c.e GROUP BY 1, 2), k AS (SELECT c.song, c.line, c.s, row_number() OVER (PARTITION BY c.song ORDER BY c.s, c.line) AS i, CASE WHEN anchor IS NULL THEN NULL WHEN abs(s - anchor) <= {2 * HOUR} THEN s ELSE anchor END AS tv FROM c LEFT JOIN a ON a.song = c.song AND a.line = c.line), x AS (SELECT *, last_value(tv IGNORE NULLS) OVER u AS pa, last_value(CASE WHEN tv IS NOT NULL THEN i END IGNORE NULLS) OVER u AS pi, first_value(tv IGNORE NULLS) OVER f AS na, first_value(CASE WHEN tv IS NOT NULL THEN i END IGNORE NULLS) OVER f AS ni FROM k WINDOW u AS (PARTITION BY song ORDER BY i ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY song ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT song, line, max(coalesce(tv, pa + floor(((na - pa) * (i - pi))::DOUBLE / (ni - pi))::BIGINT, s)) OVER (PARTITION BY song ORDER BY i ROWS UNBOUNDED PRECEDING) AS new_s FROM x"),
}
