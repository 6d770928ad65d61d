"""Which caption track of a song holds its lyrics: candidates in order, looked into one after the other, and
the track that translates them.

Tracks are (song, track, manual), track a language code; payloads (song, track, k, text, s, e) are what is
dear to read: rank r is read only for songs that ranks before have not answered.  Hints are (song, hint,
own): the language that the title points to, and that of lyrics which are there already; both may be null
or absent.  Null track codes are no tracks; of equal ranks the smaller code goes first; a null text is an
empty line; repeated tracks count once; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.functions.lyrics import base_language, body_language, clean_caption
from lineweave.functions.readings import LETTERS
from lineweave.operators.intervals import overlaps
from lineweave.sources.tables import table, work_dir

#: Tracks of a song that are looked into, and lines that lyrics have at least.
PROBES, LINES = 4, 3


def ranked_tracks(tracks: DataFrame, hints: DataFrame, most: int = PROBES) -> DataFrame:
    """song, track, rank (from 1) of manual tracks: those in the language of the own lyrics, in that of the
    title, and the others, each by code."""
    t = tracks.where("manual AND track IS NOT NULL").select("song", "track").distinct().join(hints, "song", "left")
    base = base_language(F.col("track"))
    place = F.when(base == base_language(F.col("own")), 0).when(base == base_language(F.col("hint")), 1).otherwise(2)
    w = Window.partitionBy("song").orderBy("place", "track")
    return t.withColumn("place", place).select("song", "track", F.row_number().over(w).alias("rank")).where(F.col("rank") <= most)


def verdict(hint: Column, lang: Column, lines: Column, cjk: Column) -> Column:
    """Why a track isn't taken: no lines, too few, or a body in no or another language than the title's; null if
    it is.  A body in Han characters alone may be Japanese or Chinese, as the title says."""
    wrong = lang.isNull() | hint.isNotNull() & (lang != hint) & ~((lang == "zh") & hint.isin("ja", "zh"))
    return F.when(lines == 0, "empty_caption").when(lines < LINES, "too_short").when(wrong & cjk, "body_mismatch").when(wrong, "non_cjk")


def looked_into(ranked: DataFrame, payloads: DataFrame, hints: DataFrame) -> DataFrame:
    """The tracks with language and code, null for the one that is taken."""
    own = payloads.withColumn("line", clean_caption(F.coalesce("text", F.lit("")))).join(ranked.select("song", "track"), ["song", "track"])
    w = Window.partitionBy("song", "track").orderBy("k")
    own = own.where("line <> ''").withColumn("before", F.lag("line").over(w)).where("before IS NULL OR line <> before")
    text = own.groupBy("song", "track").agg(F.count(F.lit(1)).alias("lines"), F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("body"))
    rows = ranked.join(text, ["song", "track"], "left").join(hints.select("song", "hint"), "song", "left").withColumn("lang", body_language(F.col("body")))
    cjk = F.coalesce(F.col("body").rlike(r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}]"), F.lit(False))
    code = verdict(F.col("hint"), F.col("lang"), F.coalesce("lines", F.lit(0)), cjk)
    said = F.when((F.col("lang") == "zh") & F.col("hint").isNotNull(), F.col("hint")).otherwise(F.col("lang"))
    return rows.select("song", "track", "rank", F.when(code.isNull(), said).alias("language"), code.alias("code"))


def lyric_tracks(tracks: DataFrame, payloads: DataFrame, hints: DataFrame, most: int = PROBES) -> DataFrame:
    """song, track, language, probes, error for each song with tracks: the first track by rank that can be
    taken; or none, and why not.  A song whose title points to a language that none of several tracks is in
    isn't looked into."""
    spark, path = tracks.sparkSession, work_dir(tracks.sparkSession)
    songs = tracks.groupBy("song").agg(F.count_distinct(F.when(F.col("manual"), F.col("track"))).alias("n"), F.collect_set(F.when(F.col("manual"), base_language(F.col("track")))).alias("langs"))
    songs = songs.join(hints.select("song", "hint"), "song", "left")
    hopeless = F.coalesce((F.col("n") >= 2) & ~F.array_contains("langs", F.col("hint")), F.lit(False))
    songs = songs.select("song", "hint", F.when(F.col("n") == 0, "no_manual_captions").when(hopeless, "no_original_track").alias("early"))
    ranked = ranked_tracks(tracks, hints, most).join(songs.where("early IS NULL").select("song"), "song")
    ranked.write.parquet(f"{path}/ranked")
    ranked = spark.read.schema(ranked.schema).parquet(f"{path}/ranked")
    seen = None
    for rank in range(1, most + 1):
        now = ranked.where(F.col("rank") == rank)
        if seen is not None:
            now = now.join(seen.where("code IS NULL").select("song"), "song", "left_anti")
        now = looked_into(now, payloads, hints)
        now.write.parquet(f"{path}/looked/rank={rank}")
        seen = spark.read.schema("song long, track string, language string, code string, rank int").parquet(f"{path}/looked")
    each = seen.groupBy("song").agg(F.count(F.lit(1)).alias("probes"), F.max(F.when(F.col("code").isNull(), F.struct("track", "language"))).alias("x"), F.collect_set("code").alias("codes"))
    rows = songs.join(each, "song", "left")
    one = F.when(F.size("codes") == 1, F.get("codes", F.lit(0)))
    failed = F.when(one.isin("too_short", "empty_caption"), one).when(F.col("hint").isNotNull() & (F.size("codes") > 0) & ~F.coalesce(one == "non_cjk", F.lit(False)), "no_original_track").otherwise("non_cjk_caption")
    error = F.when(F.col("early").isNotNull(), F.col("early")).when(F.col("x").isNull(), failed)
    return rows.select("song", "x.track", "x.language", F.coalesce("probes", F.lit(0)).alias("probes"), error.alias("error"))


def translation_tracks(tracks: DataFrame, taken: DataFrame, language: str = "ko") -> DataFrame:
    """song, track: the first manual track in the language for songs whose lyrics aren't in it."""
    own = taken.where("error IS NULL").where(base_language(F.col("language")) != language).select("song")
    t = tracks.where("manual").where(base_language(F.col("track")) == language).groupBy("song").agg(F.min("track").alias("track"))
    return t.join(own, "song", "left_semi")


def translated_lines(originals: DataFrame, captions: DataFrame, least: int, share: float) -> DataFrame:
    """song, line, translation: the caption (song, line, text, s, e) that a line overlaps longest, by least or by
    this share of the line; of equal ones the first.  One caption may serve several lines."""
    o = overlaps(originals, captions).where((F.col("overlap") >= least) | (F.col("overlap") >= share * (F.col("a_e") - F.col("a_s"))))
    best = o.groupBy("song", F.col("a").alias("line")).agg(F.max_by("b", F.struct("overlap", -F.col("b_s"), -F.col("b"))).alias("b"))
    return best.join(captions.select("song", F.col("line").alias("b"), F.col("text").alias("translation")), ["song", "b"]).select("song", "line", "translation")


_LATIN, _KANA = "abcdefghijklmnopqrstuvwxyz", LETTERS[:26]
CODES = ["ja", "ko-KR", "en", "zh_TW", "ja-JP", "de"]


def _tracks(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Up to five tracks of a part, four in five manual; their lines are its name in kana, Hangul, Han or Latin
    letters, up to eight times, a sound note between; titles of two in three point to a language."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("song"), "p_name", "p_size")
    t = p.withColumn("j", F.explode(F.sequence(F.lit(0), (F.col("song") % 5).cast("int")))).withColumn("track", F.element_at(F.array(*map(F.lit, CODES)), ((F.col("song") * 7 + F.col("j") * F.col("p_size")) % 6 + 1).cast("int")))
    t = t.groupBy("song", "p_name", "track").agg(F.min("j").alias("j")).withColumn("manual", (F.col("song") + F.col("j")) % 5 != 0)
    kana, kind = F.translate("p_name", _LATIN, _KANA), (F.floor(F.col("song") / 3) + F.col("j") * 2) % 4
    text = F.when(kind == 0, kana).when(kind == 1, F.translate("p_name", _LATIN, "가나다라마바사아자차카타파" * 2)).when(kind == 2, F.translate("p_name", _LATIN, "漢" * 26)).otherwise(F.col("p_name"))
    n = ((F.col("song") + F.col("j") * 3) % 9).cast("int")
    lines = t.withColumn("k", F.explode(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))))
    payloads = lines.select("song", "track", "k", F.when(F.col("k") % 4 == 3, "[music]").otherwise(F.concat(text, F.lit(" "), F.col("k"))).alias("text"), (F.col("k") * 10 + F.col("j") * 4).cast("long").alias("s"), (F.col("k") * 10 + 9).cast("long").alias("e"))
    hint = F.element_at(F.array(F.lit("ja"), F.lit("ko"), F.lit(None).cast("string"), F.lit("zh"), F.lit("ja"), F.lit(None).cast("string")), (F.col("song") % 6 + 1).cast("int"))
    return t.select("song", "track", "manual"), payloads, p.select("song", hint.alias("hint"), F.lit(None).cast("string").alias("own"))


def q_tracks(spark, d):
    return lyric_tracks(*_tracks(spark, d))


def q_translated(spark, d):
    tracks, payloads, hints = _tracks(spark, d)
    taken = lyric_tracks(tracks, payloads, hints)
    path = work_dir(spark)
    taken.write.parquet(path)
    taken = spark.read.schema(taken.schema).parquet(path)
    of = lambda chosen: payloads.join(chosen.select("song", "track"), ["song", "track"]).select("song", F.col("k").cast("long").alias("line"), "text", "s", "e")
    return translated_lines(of(taken), of(translation_tracks(tracks, taken)), 8, 0.3)


#: t: tracks; y: their lines; r: ranks; g: what each says; f: the first that is taken, by song.
TRACKS_SQL = f"""t0 AS (SELECT p_partkey AS song, p_name, j, {CODES}[((p_partkey * 7 + j * p_size) % 6 + 1)::INT] AS track FROM (SELECT *, unnest(range(p_partkey % 5 + 1)) AS j FROM part)),
t AS (SELECT song, p_name, track, min(j) AS j, (song + min(j)) % 5 <> 0 AS manual, CASE WHEN song % 6 IN (0, 4) THEN 'ja' WHEN song % 6 = 1 THEN 'ko' WHEN song % 6 = 3 THEN 'zh' END AS hint, lower(regexp_extract(track, '^[a-z]+')) AS base FROM t0 GROUP BY 1, 2, 3),
y AS (SELECT song, track, j, k, CASE (song // 3 + j * 2) % 4 WHEN 0 THEN 'ja' WHEN 1 THEN 'ko' WHEN 2 THEN 'zh' END AS body, k * 10 + j * 4 AS s, k * 10 + 9 AS e, CASE WHEN k % 4 = 3 THEN '[music]' ELSE CASE (song // 3 + j * 2) % 4 WHEN 0 THEN translate(p_name, '{_LATIN}', '{_KANA}') WHEN 1 THEN translate(p_name, '{_LATIN}', '{"가나다라마바사아자차카타파" * 2}') WHEN 2 THEN translate(p_name, '{_LATIN}', '{"漢" * 26}') WHEN 3 THEN p_name END || ' ' || k END AS text FROM (SELECT *, unnest(range(1, (song + j * 3) % 9 + 1)) AS k FROM t)),
n AS (SELECT song, hint, count(*) FILTER (manual) AS n, coalesce(bool_or(base = hint) FILTER (manual), false) AS has FROM t GROUP BY 1, 2),
r AS (SELECT t.*, row_number() OVER (PARTITION BY song ORDER BY CASE WHEN base = hint THEN 1 ELSE 2 END, track) AS rank FROM t WHERE manual QUALIFY rank <= {PROBES}),
c AS (SELECT r.*, lines, CASE WHEN lines > 0 THEN body END AS lang FROM (SELECT r.song, r.track, count(*) FILTER (text IS NULL OR text <> '[music]') AS lines, any_value(body) AS body FROM r LEFT JOIN y ON y.song = r.song AND y.track = r.track AND k % 4 <> 3 GROUP BY 1, 2) JOIN r USING (song, track)),
x AS (SELECT c.* REPLACE (CASE WHEN j IS NULL OR NOT EXISTS (SELECT 1 FROM y WHERE y.song = c.song AND y.track = c.track) THEN 0 ELSE lines END AS lines) FROM c),
g AS (SELECT *, CASE WHEN lines = 0 THEN 'empty_caption' WHEN lines < {LINES} THEN 'too_short' WHEN lang IS NULL THEN 'non_cjk' WHEN hint IS NOT NULL AND lang <> hint AND NOT (lang = 'zh' AND hint IN ('ja', 'zh')) THEN 'body_mismatch' END AS code FROM x JOIN n USING (song, hint) WHERE NOT (n >= 2 AND hint IS NOT NULL AND NOT has) UNION ALL SELECT x.*, n.n, n.has, CASE WHEN lines = 0 THEN 'empty_caption' WHEN lines < {LINES} THEN 'too_short' WHEN lang IS NULL THEN 'non_cjk' END FROM x JOIN n USING (song) WHERE x.hint IS NULL),
f AS (SELECT song, min(rank) AS best FROM g WHERE code IS NULL GROUP BY 1),
e AS (SELECT g.song, count(*) AS probes, max(track) FILTER (code IS NULL) AS track, max(CASE WHEN lang = 'zh' AND hint IS NOT NULL THEN hint ELSE lang END) FILTER (code IS NULL) AS language, list_distinct(list(code) FILTER (code IS NOT NULL)) AS codes FROM g LEFT JOIN f USING (song) WHERE best IS NULL OR rank <= best GROUP BY 1),
l AS (SELECT n.song, e.track, e.language, coalesce(probes, 0) AS probes, CASE WHEN n.n = 0 THEN 'no_manual_captions' WHEN n.n >= 2 AND hint IS NOT NULL AND NOT has THEN 'no_original_track' WHEN e.track IS NOT NULL THEN NULL WHEN len(codes) = 1 AND codes[1] IN ('too_short', 'empty_caption') THEN codes[1] WHEN hint IS NOT NULL AND len(codes) > 0 AND codes <> ['non_cjk'] THEN 'no_original_track' ELSE 'non_cjk_caption' END AS error FROM n LEFT JOIN e USING (song))"""
QUERIES = {
    "lyric_tracks": (q_tracks, f"WITH {TRACKS_SQL} SELECT * FROM l"),
    "translated_captions": (
        q_translated,
        f"WITH {TRACKS_SQL}, kt AS (SELECT t.song, min(t.track) AS track FROM t JOIN l USING (song) WHERE manual AND base = 'ko' AND l.error IS NULL AND l.language <> 'ko' GROUP BY 1), ot AS (SELECT y.* FROM y JOIN l ON l.song = y.song AND l.track = y.track), ct AS (SELECT y.* FROM y JOIN kt ON kt.song = y.song AND kt.track = y.track) SELECT o.song, o.k::BIGINT AS line, c.text AS translation FROM ot o JOIN ct c ON c.song = o.song AND o.s < c.e AND c.s < o.e AND (least(o.e, c.e) - greatest(o.s, c.s) >= 8 OR least(o.e, c.e) - greatest(o.s, c.s) >= 0.3::DOUBLE * (o.e - o.s)) QUALIFY row_number() OVER (PARTITION BY o.song, o.k ORDER BY least(o.e, c.e) - greatest(o.s, c.s) DESC, c.s, c.k) = 1",
    ),
}
