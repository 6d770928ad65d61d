"""Languages by script, tokens, cleaned captions, previews, gates on what a text holds."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from lineweave.functions.text import SCRIPTS, count_script, lyrics_hash, match_key
from lineweave.sources.tables import LYRICS_SQL, lyric_lines, table

#: A token is a run of letters and digits of one script; each Han character is one.
TOKEN = "|".join([f"[{SCRIPTS['latin']}0-9]+", f"[{SCRIPTS['kana']}]+", f"[{SCRIPTS['hangul']}]+", f"[{SCRIPTS['han']}]"])


def body_language(text: Column) -> Column:
    """ja, ko or zh if over a twentieth of the visible characters are theirs, else NULL."""
    kana, hangul, han = (count_script(text, s) for s in ("kana", "hangul", "han"))
    visible = F.length(F.regexp_replace(text, r"\s", ""))
    some = (kana + hangul + han) * 20 > visible
    return F.when(some, F.when((kana > 0) & (kana >= hangul), "ja").when(hangul > 0, "ko").otherwise("zh"))


def script_absent(lang: Column, text: Column) -> Column:
    """Whether a text lacks the script that its language can't do without."""
    need = {"ja": "kana", "ko": "hangul", "zh": "han"}
    out = F.lit(False)
    for code, script in need.items():
        out = out | ((lang == code) & (count_script(text, script) == 0))
    return out


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), 1)


def clean_caption(text: Column) -> Column:
    """Without sound notes in brackets, note signs and double blanks."""
    out = F.regexp_replace(text, r"\[[^\]]*\]|\([^)]*\)|[\x{266A}\x{266B}#*]", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


#: Roles that a credit may name before its colon, and sounds that a line in brackets may be; small letters.
ROLES = "music lyric lyrics words vocal vocals arrangement mix guitar bass drums movie illust".split()
SOUNDS = "music applause laughter cheering silence noise".split()


def one_blank(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def credit_line(text: Column, roles: list[str] = ROLES) -> Column:
    """Whether a line is one to four roles, a colon within 28 letters, and somebody."""
    role = "(?:" + "|".join(roles) + ")"
    named = F.lower(text).rlike(rf"^[\s&/,、・·+＋]*{role}(?:[\s&/,、・·+＋]+{role}){{0,3}}[\s&/,、・·+＋]*[:：].*\S")
    return named & (F.length(F.regexp_extract(text, "^([^:：]*)", 1)) <= 28)


def clean_line(text: Column, roles: list[str] = ROLES, sounds: list[str] = SOUNDS) -> Column:
    """A line of captions as it is sung: without square brackets, a mark or a speaker before it, and notes after
    it; empty if it is a credit, an address or a sound.  A null line is empty."""
    said = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\[［【][^\]］】]*[\]］】]", " "))
    said = one_blank(F.regexp_replace(said, r"^(?:>>+\s*|♪+\s*|-\s+)", ""))
    rest = one_blank(F.regexp_replace(F.regexp_replace(said, r"^[^\s:：]{1,12}[:：]\s+", ""), r"[♪♫♬\s]+$", ""))
    sound = F.lower(rest).rlike(r"^[(（]\s*(?:" + "|".join(sounds) + r")\s*[)）]$")
    return F.when(credit_line(said, roles) | F.lower(said).rlike(r"^(?:https?://|www\.)\S+$") | sound, "").otherwise(rest)


def base_language(code: Column) -> Column:
    return F.lower(F.split(F.replace(code, F.lit("_"), F.lit("-")), "-")[0])


def valid_id(id_: Column) -> Column:
    return id_.rlike(r"^[A-Za-z0-9_-]{11}$")


def ascii_kept(text: Column, share: float = 0.8) -> Column:
    """The text without what isn't ASCII, or NULL if less than share of it is left."""
    kept = F.regexp_replace(text, r"[^\x00-\x7F]", "")
    return F.when(F.length(kept) >= share * F.length(text), kept)


def docs(spark, d):
    return table(spark, d, "documents")


def q_body_language(spark, d):
    return docs(spark, d).groupBy("lang", F.coalesce(body_language(F.col("text")), F.lit("none")).alias("body"), script_absent(F.col("lang"), F.col("text")).alias("absent")).agg(F.count(F.lit(1)).alias("n"))


def q_tokens(spark, d):
    """Tokens of each turn: how many, how many different ones, and the longest's length."""
    t = table(spark, d, "conversations").select("conv_id", "turn", tokens(F.col("text")).alias("t"))
    return t.select("conv_id", "turn", F.size("t").alias("n"), F.size(F.array_distinct("t")).alias("different"), F.coalesce(F.array_max(F.transform("t", F.length)), F.lit(0)).alias("longest"))


def q_caption_clean(spark, d):
    return lyric_lines(docs(spark, d)).select("song", "line", clean_caption(F.col("text")).alias("text")).where("text <> ''")


def q_clean_line(spark, d):
    """Lines of documents with what captions have around them, by their number."""
    n, text = F.col("line") % 7, F.col("text")
    said = (
        F.when(n == 0, F.concat(F.lit(" Music & Vocal : "), text)).when(n == 1, F.concat(F.lit(">> "), text)).when(n == 2, F.concat(F.lit("[note]  - "), text, F.lit(" ♪ ♫"))).when(n == 3, F.concat(F.lit("Bob: "), text))
        .when(n == 4, F.when(F.col("song") % 2 == 0, "( Applause)").otherwise("www.a.b/c")).when(n == 5, F.concat(F.lit("Music and more: "), text)).otherwise(text)
    )
    return lyric_lines(docs(spark, d)).select("song", "line", clean_line(said).alias("sung"))


def q_preview(spark, d):
    """How many lines a document has, its first, and the first three as one line of up to 100 characters."""
    lines = lyric_lines(docs(spark, d))
    some = lines.groupBy("song").agg(F.count(F.lit(1)).alias("n"), F.min_by("text", "line").alias("first_line"))
    top = lines.where("line <= 3").groupBy("song").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("t"))
    return some.join(top, "song").select("song", "n", "first_line", F.substring(F.array_join("t.text", " / "), 1, 100).alias("preview"))


def q_usable_lines(spark, d):
    """Documents with at least two lines of two letters and more."""
    good = lyric_lines(docs(spark, d)).where(F.length(match_key(F.col("text"))) >= 2)
    return good.groupBy("song").agg(F.count(F.lit(1)).alias("lines")).where("lines >= 2")


def q_ascii_kept(spark, d):
    kept = ascii_kept(F.col("text"), 0.98)
    return docs(spark, d).select("doc_id", kept.isNotNull().alias("good"), F.md5(kept).alias("kept_md5"))


def q_same_hash_elsewhere(spark, d):
    """Documents whose lyrics hash another source has too, and the largest such doc_id."""
    h = docs(spark, d).select("doc_id", "source", lyrics_hash(F.col("text")).alias("h")).where("h IS NOT NULL")
    # the two best sources of a hash are enough to answer for any one left out
    best = h.groupBy("h", "source").agg(F.max("doc_id").alias("m"))
    w = Window.partitionBy("h").orderBy(F.desc("m"))
    two = best.withColumn("r", F.row_number().over(w)).where("r <= 2").groupBy("h").agg(F.max_by("source", "m").alias("s1"), F.max("m").alias("m1"), F.when(F.count(F.lit(1)) > 1, F.min("m")).alias("m2"))
    found = h.join(two, "h").select("doc_id", F.when(F.col("source") != F.col("s1"), F.col("m1")).otherwise(F.col("m2")).alias("other"))
    return found.where("other IS NOT NULL")


def q_gloss_reindex(spark, d):
    """Turns without the system's, numbered anew, with the number that each had."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, d, "conversations").where("role <> 'system'")
    return t.select("conv_id", F.col("turn").alias("old"), (F.row_number().over(w) - 1).cast("long").alias("line"))


def q_url_ids(spark, d):
    """The last part of each path cut to 11 characters, if it can be an id, and the url's base language."""
    last = F.substring(F.regexp_replace(F.element_at(F.split(F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1), "/"), -1), r"\.[a-z]+$", ""), 1, 11)
    return table(spark, d, "pages").select("page_id", last.alias("id"), valid_id(last).alias("valid"), base_language(F.regexp_extract("url", r"://[^/]*/([a-z]{2})/", 1)).alias("lang"))


def _n(cls: str) -> str:
    return f"length(regexp_replace(text, '[^{cls}]', '', 'g'))"


L = LYRICS_SQL
KANA, HANGUL, HAN = (_n(SCRIPTS[s]) for s in ("kana", "hangul", "han"))
QUERIES = {
    "body_language": (q_body_language, rf"SELECT lang, CASE WHEN ({KANA} + {HANGUL} + {HAN}) * 20 > length(regexp_replace(text, '\s', '', 'g')) THEN CASE WHEN {KANA} > 0 AND {KANA} >= {HANGUL} THEN 'ja' WHEN {HANGUL} > 0 THEN 'ko' ELSE 'zh' END ELSE 'none' END AS body, coalesce(lang = 'ja' AND {KANA} = 0 OR lang = 'ko' AND {HANGUL} = 0 OR lang = 'zh' AND {HAN} = 0, false) AS absent, count(*) AS n FROM documents GROUP BY 1, 2, 3"),
    "script_tokens": (q_tokens, f"WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '({TOKEN})', 1) AS t FROM conversations) SELECT conv_id, turn, len(t)::INT AS n, len(list_distinct(t))::INT AS different, coalesce(list_max(list_transform(t, lambda x: length(x))), 0)::INT AS longest FROM t"),
    "caption_clean": (q_caption_clean, rf"SELECT * FROM (SELECT song, line, trim(regexp_replace(regexp_replace(text, '\[[^\]]*\]|\([^)]*\)|[\x{{266A}}\x{{266B}}#*]', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM {L}) WHERE text <> ''"),
    "sung_captions": (
        q_clean_line,
        rf"WITH c AS (SELECT song, line, CASE line % 7 WHEN 0 THEN ' Music & Vocal : ' || text WHEN 1 THEN '>> ' || text WHEN 2 THEN '[note]  - ' || text || ' ♪ ♫' WHEN 3 THEN 'Bob: ' || text WHEN 4 THEN CASE WHEN song % 2 = 0 THEN '( Applause)' ELSE 'www.a.b/c' END WHEN 5 THEN 'Music and more: ' || text ELSE text END AS t FROM {L}), a AS (SELECT song, line, trim(regexp_replace(regexp_replace(trim(regexp_replace(t, '[\[［【][^\]］】]*[\]］】]', ' ', 'g')), '^(?:>>+\s*|♪+\s*|-\s+)', ''), '\s+', ' ', 'g')) AS t FROM c), b AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(t, '^[^\s:：]{{1,12}}[:：]\s+', ''), '[♪♫♬\s]+$', ''), '\s+', ' ', 'g')) AS r FROM a) SELECT song, line, CASE WHEN regexp_matches(lower(t), '^[\s&/,、・·+＋]*(?:{'|'.join(ROLES)})(?:[\s&/,、・·+＋]+(?:{'|'.join(ROLES)})){{0,3}}[\s&/,、・·+＋]*[:：].*\S') AND length(regexp_extract(t, '^([^:：]*)', 1)) <= 28 OR regexp_matches(lower(t), '^(?:https?://|www\.)\S+$') OR regexp_matches(lower(r), '^[(（]\s*(?:{'|'.join(SOUNDS)})\s*[)）]$') THEN '' ELSE r END AS sung FROM b",
    ),
    "preview": (q_preview, f"SELECT song, count(*) AS n, arg_min(text, line) AS first_line, left(string_agg(text, ' / ' ORDER BY line) FILTER (line <= 3), 100) AS preview FROM {L} GROUP BY 1"),
    "usable_lines": (q_usable_lines, rf"SELECT song, count(*) AS lines FROM {L} WHERE length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) >= 2 GROUP BY 1 HAVING count(*) >= 2"),
    "ascii_kept": (q_ascii_kept, r"WITH k AS (SELECT doc_id, text, regexp_replace(text, '[^\x00-\x7F]', '', 'g') AS k FROM documents) SELECT doc_id, coalesce(length(k) >= 0.98 * length(text), false) AS good, CASE WHEN length(k) >= 0.98 * length(text) THEN md5(k) END AS kept_md5 FROM k"),
    "same_hash_elsewhere": (q_same_hash_elsewhere, "WITH h AS (SELECT doc_id, source, left(sha256(trim(text, ' ' || chr(9) || chr(13) || chr(10))), 16) AS h FROM documents) SELECT a.doc_id, max(b.doc_id) AS other FROM h a JOIN h b ON a.h = b.h AND a.source <> b.source GROUP BY 1"),
    "gloss_reindex": (q_gloss_reindex, "SELECT conv_id, turn AS old, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS line FROM conversations WHERE role <> 'system'"),
    "url_ids": (q_url_ids, r"WITH u AS (SELECT page_id, url, left(regexp_replace(string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/')[-1], '\.[a-z]+$', ''), 11) AS id FROM pages) SELECT page_id, id, regexp_matches(id, '^[A-Za-z0-9_-]{11}$') AS valid, lower(regexp_extract(url, '://[^/]*/([a-z]{2})/', 1)) AS lang FROM u"),
}
