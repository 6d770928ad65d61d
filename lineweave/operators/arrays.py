"""Frame curves as arrays: energy, thresholds, runs, histograms, correlation, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.operators.words import once
from lineweave.sources.tables import TIMED_SQL, table, timed_lines

#: Pitch-class weights of the major profile (fixed values, Krumhansl and Kessler 1982).
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
#: and of the minor profile.
MINOR = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def correlation(x: Column, y: Column, n: int) -> Column:
    """Pearson's of two arrays of n doubles; NULL if one is constant."""

    def of(v: Column) -> Column:
        pairs = F.zip_with(v.x, v.y, lambda a, b: F.struct((a - v.mx).alias("a"), (b - v.my).alias("b")))
        zero = F.struct(*[F.lit(0.0).alias(c) for c in ("ab", "aa", "bb")])
        sums = F.aggregate(pairs, zero, lambda s, p: F.struct((s.ab + p.a * p.b).alias("ab"), (s.aa + p.a * p.a).alias("aa"), (s.bb + p.b * p.b).alias("bb")))
        return once(sums, lambda s: F.when((s.aa > 0) & (s.bb > 0), s.ab / F.sqrt(s.aa * s.bb)))

    return once(F.struct(x.alias("x"), y.alias("y"), (total(x) / n).alias("mx"), (total(y) / n).alias("my")), of)


def moving_average(x: Column, reach: int) -> Column:
    """Mean of each value and up to reach on both sides."""
    def at(i: Column) -> Column:
        part = F.slice(x, F.greatest(i - reach, F.lit(1)), F.least(i + reach, F.size(x)) - F.greatest(i - reach, F.lit(1)) + 1)
        return total(part) / F.size(part)

    return F.transform(F.sequence(F.lit(1), F.size(x)), at)


def runs(flags: Column) -> Column:
    """Runs of true in an array of booleans, as array of struct(first, last), from 0."""
    start = F.filter(F.transform(flags, lambda f, i: F.when(f & ~F.coalesce(F.get(flags, i - 1), F.lit(False)), i)), lambda x: x.isNotNull())
    stop = F.filter(F.transform(flags, lambda f, i: F.when(f & ~F.coalesce(F.get(flags, i + 1), F.lit(False)), i)), lambda x: x.isNotNull())
    return F.zip_with(start, stop, lambda a, b: F.struct(a.alias("first"), b.alias("last")))


def frames(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 1_000_000).cast("long")).alias("x"), "label")


def frame_energy(x: Column, width: int) -> Column:
    """Sums of squares of every width values; the last may have fewer.  Null and empty curves have none."""
    at = F.sequence(F.lit(0), F.size(x) - 1, F.lit(width))
    return F.when(F.size(x) > 0, F.transform(at, lambda i: F.aggregate(F.slice(x, i + 1, F.lit(width)), F.lit(0).cast("long"), lambda a, v: a + v * v)))


def frame_rms(spark, d):
    """Energy of every 16 values, in squared units."""
    return frames(spark, d).select("vec_id", F.posexplode(frame_energy(F.col("x"), 16)).alias("frame", "energy")).withColumn("frame", F.col("frame").cast("long"))


def loud_runs(x: Column, share: float, least: int) -> Column:
    """Runs (first, last) of at least ``least`` values that are over this share of the curve's values."""

    def found(y: Column) -> Column:
        cut = F.get(F.array_sort(y), F.floor(F.size(y) * share).cast("int"))
        return once(F.struct(y.alias("y"), cut.alias("cut")), lambda v: F.filter(runs(F.transform(v.y, lambda z: z > v.cut)), lambda r: r["last"] - r["first"] + 1 >= least))

    return once(x, found)


def percentile_voice(spark, d):
    """Runs of values over the 60th percentile of a curve, of two and more."""
    return frames(spark, d).select("vec_id", F.explode(loud_runs(F.col("x"), 0.6, 2)).alias("r")).select("vec_id", F.col("r.first").cast("long").alias("first"), F.col("r.last").cast("long").alias("last"))


def moving_average_query(spark, d):
    x = F.transform("x", lambda v: v.cast("double"))
    return frames(spark, d).select("vec_id", F.posexplode(moving_average(x, 3)).alias("i", "mean")).withColumn("mean", F.round("mean", 3))


def array_correlation(spark, d):
    """Each curve's correlation with that of the next vector."""
    f = frames(spark, d).select("vec_id", F.transform("x", lambda v: v.cast("double")).alias("x"))
    g = f.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return f.join(g, "vec_id").select("vec_id", F.round(correlation(F.col("x"), F.col("y"), 64), 6).alias("r"))


def pitch_histogram(spark, d):
    t = timed_lines(spark, d)
    return t.groupBy("song", F.pmod(F.round(F.col("value")).cast("long"), F.lit(12)).alias("pitch_class")).agg(F.count(F.lit(1)).alias("n"))


def keys_of(histogram: DataFrame) -> DataFrame:
    """song, key (0 to 11 major, 12 to 23 minor), r: the key whose profile fits a song's counts (song,
    pitch_class, n) best; of equal ones the first.  A song with the same count for each class has none."""
    rows = [(12 * m + k, i, float(w[(i - k) % 12])) for m, w in enumerate((MAJOR, MINOR)) for k in range(12) for i in range(12)]
    profiles = histogram.sparkSession.createDataFrame(rows, "key int, pitch_class long, w double")  # 24 keys of 12 classes
    # a class that a song lacks counts 0 in every sum
    own = histogram.groupBy("song").agg(F.sum("n").cast("double").alias("sx"), F.sum(F.col("n") * F.col("n")).cast("double").alias("sxx"))
    both = histogram.join(F.broadcast(profiles), "pitch_class").groupBy("song", "key").agg(F.sum(F.col("n") * F.col("w")).alias("sxy"))
    sums = profiles.groupBy("key").agg(F.sum("w").alias("sy"), F.sum(F.col("w") * F.col("w")).alias("syy"))
    all_ = both.join(F.broadcast(sums), "key").join(own, "song").where("12 * sxx > sx * sx")
    r = F.round((12 * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt((12 * F.col("sxx") - F.col("sx") * F.col("sx")) * (12 * F.col("syy") - F.col("sy") * F.col("sy"))), 9)
    return all_.groupBy("song").agg(F.max(F.struct(r.alias("r"), (-F.col("key")).alias("k"))).alias("b")).select("song", (-F.col("b.k")).alias("key"), F.col("b.r").alias("r"))


def key_estimate(spark, d):
    return keys_of(pitch_histogram(spark, d))


def collapsed(symbols: DataFrame, key: str, order: list[str], symbol: str, blank: str) -> DataFrame:
    """key, symbols: each key's symbols in order, repeats as one; a blank is none, but parts repeats."""
    w = Window.partitionBy(key).orderBy(*order)
    kept = symbols.withColumn("_p", F.lag(symbol).over(w)).where((F.col("_p").isNull() | (F.col("_p") != F.col(symbol))) & (F.col(symbol) != blank))
    return kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(symbol).alias("_s")))).alias("_x")).select(key, F.col("_x._s").alias("symbols"))


def greedy_collapse(spark, d):
    """Types of a user's events in order, by their first letters; errors are blanks."""
    found = collapsed(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", "error")
    return found.select("user_id", F.array_join(F.transform("symbols", lambda s: F.substring(s, 1, 1)), "").alias("text"))


def affine_time_map(spark, d):
    """Nested times of a song, at 1.25 times the rate and half a second later."""
    t = timed_lines(spark, d).groupBy("song").agg(F.array_sort(F.collect_list(F.struct("s", "e", "line"))).alias("t"))
    moved = F.transform("t", lambda x: x.withField("s", F.floor(x["s"] / 1.25) + 500_000).withField("e", F.floor(x["e"] / 1.25) + 500_000))
    return t.select("song", F.explode(moved).alias("x")).select("song", "x.line", "x.s", "x.e")


def chunks(n: Column, size: int, stride: int) -> Column:
    """Windows (a, b) of size every stride of n values, the last as long as there are values that no window
    before has whole; and of each the part (keep_a, keep_b) that is kept: overlaps meet at their middle."""
    over, half = size - stride, (size - stride) // 2
    starts = F.filter(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0)).cast("long"), F.lit(stride).cast("long")), lambda a: (a == 0) | (a + over < n))

    def one(a: Column) -> Column:
        b = F.least(a + size, n.cast("long"))
        return F.struct(a.alias("a"), b.alias("b"), F.when(a == 0, a).otherwise(a + half).alias("keep_a"), F.when(b == n, b).otherwise(a + size - (over - half)).alias("keep_b"))

    return F.when(n > 0, F.transform(starts, one))


def chunk_windows(spark, d):
    """Windows of 24 values every 20."""
    return frames(spark, d).select("vec_id", F.inline(chunks(F.size("x"), 24, 20)))


def midi_of(hz: Column, highest: int | None = None) -> Column:
    """A frequency in semitones (440 Hz: 69); one over highest goes down an octave.  None for 0 and below."""
    midi = F.when(hz > 0, 69 + 12 * F.log2(hz / 440))
    return midi if highest is None else F.when(midi > highest, midi - 12).otherwise(midi)


def hz_to_midi(spark, d):
    """Retail prices as frequencies, with an octave taken off above 72."""
    return table(spark, d, "part").select("p_partkey", F.round(midi_of(F.col("p_retailprice"), 72), 6).alias("midi"))


def frames_needed(text: Column) -> Column:
    """Frames that a text needs at least: its letters, and one more between equal ones."""
    c = F.split(text, "")
    twins = F.aggregate(F.zip_with(F.slice(c, F.lit(2), F.size(c)), F.slice(c, 1, F.size(c) - 1), lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda a, v: a + v)
    return F.when(F.length(text) == 0, 0).otherwise(F.length(text) + twins).cast("long")


def adjacent_equals(spark, d):
    return table(spark, d, "part").select("p_partkey", frames_needed(F.col("p_name")).alias("frames"))


def best_offset(spark, d):
    """Shift of up to four values at which a curve's first half fits its second best."""
    def score(k: int) -> Column:
        return F.aggregate(F.zip_with(F.slice("x", 1, 28), F.slice("x", 33 + k, 28), lambda a, b: a * b), F.lit(0).cast("long"), lambda a, v: a + v)

    best = F.array_max(F.array(*(F.struct(score(k).alias("v"), F.lit(-k).alias("k")) for k in range(5))))
    return frames(spark, d).select("vec_id", (-best["k"]).alias("shift"), best["v"].alias("score"))


X = "(SELECT vec_id, label, list_transform(embedding, lambda x: round(x::DOUBLE * 1000000)::BIGINT) AS x FROM embeddings)"
P = "(SELECT vec_id, unnest(range(64)) AS i, unnest(x) AS v FROM " + X + ")"
T = TIMED_SQL


def _key_sql() -> str:
    h = f"h AS (SELECT song, ((round(value)::BIGINT % 12) + 12) % 12 AS pc, count(*) AS n FROM {T} GROUP BY 1, 2), f AS (SELECT song, pc, coalesce(n, 0)::DOUBLE AS n FROM (SELECT DISTINCT song FROM h) CROSS JOIN range(12) r(pc) LEFT JOIN h USING (song, pc))"
    rows = ", ".join(f"({12 * m + k}, {i}, {w[(i - k) % 12]}::DOUBLE)" for m, w in enumerate((MAJOR, MINOR)) for k in range(12) for i in range(12))
    return f"WITH {h}, p(key, pc, w) AS (VALUES {rows}) SELECT song, key, round(corr(n, w), 9) AS r FROM f JOIN p USING (pc) GROUP BY song, key HAVING stddev_pop(n) > 0 QUALIFY row_number() OVER (PARTITION BY song ORDER BY round(corr(n, w), 9) DESC, key) = 1"


QUERIES = {
    "frame_rms": (frame_rms, f"SELECT vec_id, i // 16 AS frame, sum(v * v)::BIGINT AS energy FROM {P} GROUP BY 1, 2"),
    "percentile_voice": (percentile_voice, f"WITH f AS (SELECT p.vec_id, i, v > list_sort(x)[39] AS on_ FROM {P} p JOIN {X} x ON x.vec_id = p.vec_id), g AS (SELECT *, i - row_number() OVER (PARTITION BY vec_id, on_ ORDER BY i) AS g FROM f) SELECT vec_id, min(i) AS first, max(i) AS last FROM g WHERE on_ GROUP BY vec_id, g HAVING max(i) > min(i)"),
    "moving_average": (moving_average_query, f"SELECT vec_id, i::INT AS i, round(avg(v) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 3) AS mean FROM {P}"),
    "array_correlation": (array_correlation, f"SELECT a.vec_id, round(corr(a.v, b.v), 6) AS r FROM {P} a JOIN {P} b ON b.vec_id = a.vec_id + 1 AND a.i = b.i GROUP BY 1"),
    "pitch_histogram": (pitch_histogram, f"SELECT song, round(value)::BIGINT % 12 AS pitch_class, count(*) AS n FROM {T} GROUP BY 1, 2"),
    "key_estimate": (key_estimate, _key_sql()),
    "greedy_collapse": (greedy_collapse, "SELECT user_id, string_agg(left(event_type, 1), '' ORDER BY ts, event_id) AS text FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE (p IS NULL OR p <> event_type) AND event_type <> 'error' GROUP BY 1"),
    "affine_time_map": (affine_time_map, f"SELECT song, line, floor(s / 1.25::DOUBLE)::BIGINT + 500000 AS s, floor(e / 1.25::DOUBLE)::BIGINT + 500000 AS e FROM {T}"),
    "chunk_windows": (chunk_windows, "SELECT vec_id, a, least(a + 24, 64) AS b, CASE WHEN a = 0 THEN 0 ELSE a + 2 END AS keep_a, CASE WHEN a + 24 >= 64 THEN 64 ELSE a + 22 END AS keep_b FROM embeddings, range(0, 64, 20) r(a) WHERE a = 0 OR a + 4 < 64"),
    "hz_to_midi": (hz_to_midi, "SELECT p_partkey, CASE WHEN m > 72 THEN m - 12 ELSE m END AS midi FROM (SELECT p_partkey, round(69 + 12 * log2(p_retailprice / 440), 6) AS m FROM part)"),
    "adjacent_equals": (adjacent_equals, "SELECT p_partkey, length(p_name) + len(list_filter(range(1, length(p_name)), lambda i: substr(p_name, i::INT, 1) = substr(p_name, i::INT + 1, 1))) AS frames FROM part"),
    "best_offset": (best_offset, f"WITH s AS (SELECT a.vec_id, k, sum(a.v * b.v)::BIGINT AS score FROM {P} a, range(5) r(k), {P} b WHERE a.vec_id = b.vec_id AND a.i < 28 AND b.i = a.i + 32 + k GROUP BY 1, 2) SELECT vec_id, k::INT AS shift, score FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, k) = 1"),
}
