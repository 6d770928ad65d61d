"""Text keys, scripts, fingerprints and fuzzy matches, by built-in functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.sources.tables import LYRICS_SQL, lyric_lines, table

#: Character classes by script.
SCRIPTS = {"latin": "A-Za-z\\x{00C0}-\\x{024F}", "han": "\\x{4E00}-\\x{9FFF}", "kana": "\\x{3040}-\\x{30FF}", "hangul": "\\x{AC00}-\\x{D7A3}"}
MARKS = r"[^\p{L}\p{N}]"


def lyrics_hash(text: Column) -> Column:
    return F.substring(F.sha2(F.trim(text, F.lit(" \t\r\n")), 256), 1, 16)


def match_key(text: Column) -> Column:
    """Letters and digits in lower case, without what stands between them."""
    return F.lower(F.regexp_replace(text, MARKS, ""))


def anchor_key(text: Column) -> Column:
    return match_key(F.regexp_replace(text, r"\([^)]*\)", ""))


def count_script(text: Column, script: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{SCRIPTS[script]}]", ""))


def script_class(text: Column) -> Column:
    """The script with the most characters, of equal ones the first named; none for none."""
    best = F.lit("none")
    most = F.greatest(*(count_script(text, s) for s in SCRIPTS))
    for s in reversed(SCRIPTS):
        best = F.when((most > 0) & (count_script(text, s) == most), F.lit(s)).otherwise(best)
    return best


def title_candidates(title: Column) -> Column:
    """The title, without brackets, without what follows a dash, and without featured names."""
    plain = F.trim(F.regexp_replace(title, r"[\(\[][^\)\]]*[\)\]]", ""))
    head = F.trim(F.substring_index(title, " - ", 1))
    alone = F.trim(F.regexp_replace(title, r"(?i)\s+(feat|ft)\.?\s.*$", ""))
    return F.filter(F.array_distinct(F.array(F.trim(title), plain, head, alone)), lambda x: x != "")


def contains_with_ratio(long: Column, short: Column, ratio: float = 0.5, least: int = 4) -> Column:
    """Whether one holds the other, which has at least so many characters and this share of its length."""
    return F.contains(long, short) & (F.length(short) >= least) & (F.length(short) >= ratio * F.length(long))


def fragments(df: DataFrame, text: str, n: int) -> DataFrame:
    """Distinct n-character fragments of each key."""
    key = F.col("_key")
    rows = df.withColumn("_key", match_key(F.col(text)))
    at = F.sequence(F.lit(1), F.greatest(F.length(key) - (n - 1), F.lit(1)))
    return rows.withColumn("fragment", F.explode(F.array_distinct(F.transform(at, lambda i: F.substr(key, i, F.lit(n)))))).drop("_key")


def multiset_overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Characters that two texts share, counted as often as both have them, by key."""
    def chars(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn("ch", F.explode(F.split("text", ""))).where("ch <> ''").groupBy(*keys, "ch").agg(F.count(F.lit(1)).alias(name))

    both = chars(a, "x").join(chars(b, "y"), [*keys, "ch"])
    return both.groupBy(*keys).agg(F.sum(F.least("x", "y")).alias("shared"))


def docs(spark, d):
    return table(spark, d, "documents")


def chats(spark, d):
    return table(spark, d, "conversations")


def q_lyric_lines(spark, d):
    return lyric_lines(docs(spark, d))


def q_lyrics_hash(spark, d):
    return docs(spark, d).select("doc_id", lyrics_hash(F.col("text")).alias("lyrics_hash"))


def q_lines_fingerprint(spark, d):
    """md5 of a document's line keys, in order, without empty ones."""
    keys = lyric_lines(docs(spark, d)).select("song", "line", match_key(F.col("text")).alias("k")).where("k <> ''")
    whole = keys.groupBy("song").agg(F.array_sort(F.collect_list(F.struct("line", "k"))).alias("k"))
    return whole.select("song", F.md5(F.concat_ws("\n", "k.k")).alias("fingerprint"))


def q_script_census(spark, d):
    return docs(spark, d).groupBy("lang").agg(*(F.sum(count_script(F.col("text"), s)).alias(s) for s in SCRIPTS))


def q_lang_detect(spark, d):
    """Language by script and by letters that only one language has."""
    n = {k: F.length(F.regexp_replace("text", f"[^{v}]", "")) for k, v in {"de": "äöüßÄÖÜ", "fr": "èêçàÈÊÇÀ", "es": "ñóíÑÓÍ"}.items()}
    most = F.greatest(*n.values())
    guess = F.when(most * 200 < F.length("text"), "en").when(n["de"] == most, "de").when(n["fr"] == most, "fr").otherwise("es")
    return docs(spark, d).select("doc_id", script_class(F.col("text")).alias("script"), guess.alias("guess"))


def q_lang_mismatch(spark, d):
    """Documents whose label says English though over 1 % of at least 20 visible characters aren't ASCII."""
    visible = F.length(F.regexp_replace("text", r"\s", ""))
    foreign = F.length(F.regexp_replace("text", r"[\x00-\x7F]", ""))
    wrong = (F.col("lang") == "en") & (foreign * 100 > visible) | (F.col("lang") != "en") & (foreign == 0)
    return docs(spark, d).where((visible >= 20) & wrong).select("doc_id", "lang", visible.alias("visible"), foreign.alias("foreign"))


def q_title_candidates(spark, d):
    title = F.concat("p_name", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" ("), F.col("p_brand"), F.lit(")"))).otherwise(F.concat(F.lit(" - "), F.col("p_type"))), F.lit(" feat. "), F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", F.explode(title_candidates(title)).alias("candidate"))


def q_fragment_df(spark, d):
    """Four-letter fragments that at least two test items have, and how many."""
    items = table(spark, d, "benchmark")
    return fragments(items, "text", 4).groupBy("fragment").agg(F.count_distinct("item_id").alias("df")).where("df >= 2")


def best_others(items: DataFrame, n: int = 8, cap: int = 4, least: float = 0.6, top: int = 3) -> DataFrame:
    """For each item (item_id, text) the best others: by score (1 for equal keys; where one key holds the
    other, the ratio of their lengths, if least or more; else 0), then by how many rare fragments of
    the item they share.  Keys count once, with the least ids of their items.  A fragment is rare if at
    most cap keys have it, or as many as have the item's rarest shared one: no item loses all.  No key
    is left out of equal and containing pairs: a key meets those that hold it at its rarest fragment."""
    keyed = items.select("item_id", match_key(F.col("text")).alias("k")).where("k <> ''")
    keys = keyed.groupBy("k").agg(F.slice(F.array_sort(F.collect_set("item_id")), 1, top + 1).alias("ids"))
    size, at = F.length("k"), F.sequence(F.lit(1), F.greatest(F.length("k") - (n - 1), F.lit(1)))
    f = keys.select("k", F.explode(F.array_distinct(F.transform(at, lambda i: F.substr("k", i, F.lit(n))))).alias("fragment"))
    f = f.join(f.groupBy("fragment").agg(F.count(F.lit(1)).alias("df")), "fragment")
    rarest = f.where("df >= 2").groupBy("k").agg(F.min("df").alias("own"))
    mine = f.where("df >= 2").join(rarest, "k").where(F.col("df") <= F.greatest(F.lit(cap), "own"))
    shared = mine.select("k", "fragment").join(f.select(F.col("k").alias("o"), "fragment"), "fragment").where("k <> o").groupBy("k", "o").agg(F.count(F.lit(1)).alias("shared"))
    # keys of under n letters may stand in others of which they are no fragment: these are short too
    inner = F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(n - 1), size - i + 1)), lambda j: F.substr("k", i, j))))
    small = keys.where(size < n / least).select(F.col("k").alias("o"), F.explode(F.array_distinct(inner)).alias("fragment"))
    meet = f.where(size >= n).groupBy("k").agg(F.min_by("fragment", F.struct("df", "fragment")).alias("fragment"))
    held = meet.join(f.select(F.col("k").alias("o"), "fragment"), "fragment").unionByName(keys.where(size < n).select("k", F.col("k").alias("fragment")).join(small, "fragment"))
    held = held.where(F.expr("k <> o") & contains_with_ratio(F.col("o"), F.col("k"), least, 1)).select("k", "o", (F.length("k") / F.length("o")).alias("score")).distinct()
    held = held.unionByName(held.select(F.col("o").alias("k"), F.col("k").alias("o"), "score"))
    pairs = shared.join(held, ["k", "o"], "full").join(keys.select(F.col("k").alias("o"), "ids"), "o").select("k", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("shared", F.lit(0)).alias("shared"), "ids")
    some = pairs.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("score"), F.desc("shared"), F.col("ids")[0]))).where(F.col("place") <= top).drop("place")
    some = some.unionByName(keys.select("k", F.lit(1.0).alias("score"), F.lit(0).cast("long").alias("shared"), "ids"))
    each = keyed.join(some.select("k", "score", "shared", F.explode("ids").alias("other")), "k").where("item_id <> other")
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), F.desc("shared"), "other")
    return each.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= top).select("item_id", "other", F.round("score", 9).alias("score"), "shared", "place")


def q_fuzzy_rank_all(spark, d):
    """For each test item the three best others, with equal, containing and often shared texts."""
    return best_others(table(spark, d, "benchmark"))


#: Places of the filter that keeps fragments which no item has out of the exchange; the join decides.
PLACES = 1_048_573


def byte_fragments(df: DataFrame, key: str, inner: np.ndarray | None = None, first: np.ndarray | None = None) -> DataFrame:
    """All columns, and size and fragment (as a number): the distinct runs of 4 and of 8 bytes of each key
    (whole: false), and its first 8 bytes, or 4 of a shorter key (whole: true).  inner, first: filters
    by place, (size, PLACES) each, of what to give of the two kinds."""

    names = [*df.columns, "size", "fragment", "whole"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                texts = [(t or "").encode() for t in part.column(key).to_pylist()]
                ends = np.cumsum([len(t) for t in texts])
                raw = np.frombuffer(b"".join(texts), np.uint8)
                of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
                start = (ends - [len(t) for t in texts])[of] if len(raw) else of
                out = []
                for k, size in enumerate((4, 8)):
                    n = len(raw) - size + 1
                    if n <= 0:
                        continue
                    value = np.zeros(n, np.uint64)
                    for j in range(size):
                        value |= raw[j : j + n].astype(np.uint64) << np.uint64(8 * j)
                    value = value.view(np.int64)
                    place = np.mod(value, PLACES)
                    inside = of[:n] == of[size - 1 :]
                    long = ends[of[:n]] - start[:n] >= 8
                    head = inside & (start[:n] == np.arange(n)) & (long == (size == 8))
                    for whole, mask, known in ((False, inside, inner), (True, head, first)):
                        at = np.flatnonzero(mask if known is None else mask & known[k][place])
                        order = at[np.lexsort((value[at], of[at]))]
                        same = (of[order][1:] == of[order][:-1]) & (value[order][1:] == value[order][:-1])
                        order = order[np.append(True, ~same)] if len(order) else order
                        out.append((of[order], value[order], size, whole))
                for row, fragment, size, whole in out:
                    if len(row):
                        got = part.take(pa.array(row))
                        yield pa.RecordBatch.from_arrays([*got.columns, pa.array([size] * len(row), pa.int32()), pa.array(fragment, pa.int64()), pa.array([whole] * len(row))], names=names)

    return df.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in df.dtypes) + ", size int, fragment long, whole boolean")


def places(fragments: DataFrame) -> np.ndarray:
    """Which places fragments take, by size: at most 2 * PLACES numbers for the driver."""
    out = np.zeros((2, PLACES), bool)
    for r in fragments.select("size", F.pmod("fragment", F.lit(PLACES)).alias("place")).distinct().collect():
        out[r.size // 8, r.place] = True
    return out


def contained_lines(lines: DataFrame, items: DataFrame, least: int = 4, tenths: int = 3) -> DataFrame:
    """Pairs of lines (song, line, text) and item lines (the same) whose anchor keys have at least so many
    characters and of which the item's stands in the line's, or the line's, of at least so many tenths
    of its length, in the item's.  An item's key meets a line at its rarest 8 bytes (4 of a shorter
    key), wherever they stand; a line's key meets an item at its own first."""
    def keys(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn(name, anchor_key(F.col("text"))).where(F.length(name) >= least)

    marks = keys(items, "short").select(F.col("song").alias("item_id"), F.col("line").alias("item_line"), "short")
    every = byte_fragments(marks.select("short").distinct(), "short").where("NOT whole").drop("whole")
    own = every.where("size = CASE WHEN octet_length(short) >= 8 THEN 8 ELSE 4 END")
    rare = own.join(own.groupBy("size", "fragment").agg(F.count(F.lit(1)).alias("df")), ["size", "fragment"])
    rare = rare.groupBy("short").agg(F.min(F.struct("df", "size", "fragment")).alias("m")).select("short", "m.size", "m.fragment", F.lit(False).alias("whole"))
    meet = rare.unionByName(every.withColumn("whole", F.lit(True)))
    found = byte_fragments(keys(lines, "long").select("song", "line", "long"), "long", places(rare), places(every))
    n, m = F.length("long"), F.length("short")
    hit = found.join(meet, ["size", "fragment", "whole"]).where(F.contains("long", "short") | F.contains("short", "long") & (10 * n >= tenths * m))
    return hit.select("song", "line", "short").distinct().join(marks, "short").select("song", "line", "item_id", "item_line")


def q_containment_lines(spark, d):
    """Document lines and lines of test items of which one holds the other."""
    return contained_lines(lyric_lines(docs(spark, d)), lyric_lines(table(spark, d, "benchmark"), "item_id"))


def q_char_multiset_f1(spark, d):
    """For each conversation, characters that its first user and first assistant turn share."""
    t = chats(spark, d).where("role <> 'system'")
    one = {r: t.where(F.col("role") == r).groupBy("conv_id").agg(F.min_by("text", "turn").alias("text")) for r in ("user", "assistant")}
    shared = multiset_overlap(one["user"], one["assistant"], ["conv_id"])
    size = one["user"].select("conv_id", F.char_length("text").alias("x")).join(one["assistant"].select("conv_id", F.char_length("text").alias("y")), "conv_id")
    return shared.join(size, "conv_id").select("conv_id", "shared", F.round(2 * F.col("shared") / (F.col("x") + F.col("y")), 9).alias("f1"))


def q_caption_islands(spark, d):
    """Runs of equal event types per user as one caption."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("fresh", F.when(F.lag("event_type").over(w) == F.col("event_type"), 0).otherwise(1))
    runs = e.withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("user_id", "run", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


def q_gloss_cycle(spark, d):
    """Conversations whose turns are user and assistant by turns in at least 90 %."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = chats(spark, d).where("role <> 'system'").withColumn("i", F.row_number().over(w) - 1)
    right = F.count_if(F.col("role") == F.when(F.col("i") % 2 == 0, "user").otherwise("assistant"))
    return t.groupBy("conv_id").agg(right.alias("fit"), F.count(F.lit(1)).alias("n")).where("n >= 2").select("conv_id", (F.col("fit") * 10 >= F.col("n") * 9).alias("cycles"))


def q_line_split_words(spark, d):
    """Words of a turn with even times in a second."""
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    t = chats(spark, d).select("conv_id", "turn", words.alias("w"))
    return t.select("conv_id", "turn", F.posexplode("w").alias("k", "word"), F.size("w").alias("n")).select("conv_id", "turn", "k", "word", F.floor(F.col("k") * 1_000_000 / F.col("n")).alias("at"))


def q_line_split_chars(spark, d):
    """How many visible characters each line of a document has, and where in the document it starts."""
    lines = lyric_lines(docs(spark, d)).withColumn("n", F.length(F.regexp_replace("text", r"\s", "")).cast("long"))
    w = Window.partitionBy("song").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return lines.select("song", "line", "n", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))


def cell_text(html: Column) -> Column:
    """Text of a cell: without ruby, tags and entities, white space as one blank."""
    out = F.regexp_replace(html, r"(?is)<(script|style|rt|rp)\b.*?</\1>", "")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def q_html_cell_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(cell_text(F.col("html"))).alias("text_md5"))


def q_html_list_items(spark, d):
    """List items of a page in order, by three: link text, and the place in its row."""
    items = F.regexp_extract_all("html", F.lit(r"<li>(.*?)</li>"), 1)
    return table(spark, d, "pages").select("page_id", F.posexplode(items).alias("k", "cell")).select("page_id", F.floor(F.col("k") / 3).cast("int").alias("row"), (F.col("k") % 3).alias("column"), cell_text(F.col("cell")).alias("cell"))


def q_filename_slug(spark, d):
    slug = F.trim(F.regexp_replace(F.lower(F.regexp_extract("url", r"://([^?#]*)", 1)), "[^a-z0-9]+", "-"), F.lit("-"))
    return table(spark, d, "pages").select("page_id", F.substring(slug, 1, 40).alias("slug"))


def q_failure_code(spark, d):
    """First pattern that fits an event's type, else a class by its value."""
    t = F.col("event_type")
    return table(spark, d, "events").groupBy(F.when(t.contains("err"), "engine").when(t.rlike("^(click|view)$"), "client").when(F.col("value") > 50, "large").alias("code")).agg(F.count(F.lit(1)).alias("n"))


def q_credit_lines(spark, d):
    """Lines that are no lyrics: licenses, addresses, links."""
    return lyric_lines(docs(spark, d)).where(F.col("text").rlike(r"(?i)(licensed under|copyright|https?://|@[a-z0-9-]+\.)")).select("song", "line")


def q_edge_trim(spark, d):
    """Lines left after up to two short lines at each edge go, if four stay."""
    lines = lyric_lines(docs(spark, d)).withColumn("short", F.length("text") < 15)
    up, down = Window.partitionBy("song").orderBy("line"), Window.partitionBy("song").orderBy(F.desc("line"))
    run = [F.min(F.col("short")).over(w.rowsBetween(Window.unboundedPreceding, 0)) for w in (up, down)]
    rows = lines.withColumns({"head": run[0] & (F.row_number().over(up) <= 2), "tail": run[1] & (F.row_number().over(down) <= 2)})
    all_ = Window.partitionBy("song")
    rows = rows.withColumn("left", F.count_if(~F.col("head") & ~F.col("tail")).over(all_))
    return rows.where((F.col("left") < 4) | ~F.col("head") & ~F.col("tail")).select("song", "line")


def _n(cls: str) -> str:
    return f"length(regexp_replace(text, '[^{cls}]', '', 'g'))"


S = {k: v for k, v in SCRIPTS.items()}
L = LYRICS_SQL
KEY = "lower(regexp_replace({}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))"
ANCHOR = KEY.format(r"regexp_replace(text, '\([^)]*\)', '', 'g')")
MOST = "greatest(" + ", ".join(_n(v) for v in S.values()) + ")"
CLASS = "CASE " + " ".join(f"WHEN {MOST} > 0 AND {_n(v)} = {MOST} THEN '{k}'" for k, v in S.items()) + " ELSE 'none' END"
DE, FR, ES = (_n(x) for x in ("äöüßÄÖÜ", "èêçàÈÊÇÀ", "ñóíÑÓÍ"))


def _fragments(n: int) -> str:
    return f"(SELECT DISTINCT item_id, substr(k, i, {n}) AS fragment FROM (SELECT item_id, k, unnest(range(1, greatest(length(k) - {n - 1}, 1) + 1)) AS i FROM (SELECT item_id, {KEY.format('text')} AS k FROM benchmark)))"


CELL = r"regexp_replace(regexp_replace(regexp_replace({}, '(?is)<script\b.*?</script>|<style\b.*?</style>|<rt\b.*?</rt>|<rp\b.*?</rp>', '', 'g'), '(?i)<br\s*/?>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
for _e, _c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    CELL = f"replace({CELL}, '{_e}', '{_c}')"
CELL = rf"trim(regexp_replace({CELL}, '\s+', ' ', 'g'))"

BEST = f"""WITH i AS (SELECT item_id, {KEY.format('text')} AS k FROM benchmark), k AS (SELECT DISTINCT k FROM i WHERE k <> ''),
f AS (SELECT DISTINCT k, substr(k, j, 8) AS fragment FROM (SELECT k, unnest(range(1, greatest(length(k) - 7, 1) + 1)) AS j FROM k)),
c AS (SELECT *, count(*) OVER (PARTITION BY fragment) AS df FROM f), m AS (SELECT *, min(df) OVER (PARTITION BY k) AS own FROM c WHERE df >= 2),
s AS (SELECT a.k, b.k AS o, count(*) AS shared FROM m a JOIN f b ON a.fragment = b.fragment AND a.k <> b.k AND a.df <= greatest(4, a.own) GROUP BY 1, 2),
p AS (SELECT a.item_id, b.item_id AS other, coalesce(shared, 0) AS shared, CASE WHEN a.k = b.k THEN 1::DOUBLE WHEN (contains(a.k, b.k) OR contains(b.k, a.k)) AND least(length(a.k), length(b.k)) >= 0.6::DOUBLE * greatest(length(a.k), length(b.k)) THEN least(length(a.k), length(b.k))::DOUBLE / greatest(length(a.k), length(b.k)) ELSE 0 END AS score
FROM i a JOIN i b ON a.item_id <> b.item_id AND a.k <> '' AND b.k <> '' LEFT JOIN s ON s.k = a.k AND s.o = b.k)
SELECT item_id, other, round(score, 9) AS score, shared, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, shared DESC, other) AS place FROM p WHERE score > 0 OR shared > 0 QUALIFY place <= 3"""

QUERIES = {
    "lyric_lines": (q_lyric_lines, f"SELECT song, line, text FROM {L}"),
    "lyrics_hash": (q_lyrics_hash, "SELECT doc_id, left(sha256(trim(text, ' ' || chr(9) || chr(13) || chr(10))), 16) AS lyrics_hash FROM documents"),
    "lines_fingerprint": (q_lines_fingerprint, f"SELECT song, md5(string_agg(k, chr(10) ORDER BY line)) AS fingerprint FROM (SELECT song, line, {KEY.format('text')} AS k FROM {L}) WHERE k <> '' GROUP BY 1"),
    "script_census": (q_script_census, "SELECT lang, " + ", ".join(f"sum({_n(v)}) AS {k}" for k, v in S.items()) + " FROM documents GROUP BY 1"),
    "lang_detect": (q_lang_detect, f"SELECT doc_id, {CLASS} AS script, CASE WHEN greatest({DE}, {FR}, {ES}) * 200 < length(text) THEN 'en' WHEN {DE} = greatest({DE}, {FR}, {ES}) THEN 'de' WHEN {FR} = greatest({DE}, {FR}, {ES}) THEN 'fr' ELSE 'es' END AS guess FROM documents"),
    "lang_mismatch": (q_lang_mismatch, r"SELECT doc_id, lang, length(regexp_replace(text, '\s', '', 'g')) AS visible, length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) AS foreign FROM documents WHERE length(regexp_replace(text, '\s', '', 'g')) >= 20 AND (lang = 'en' AND length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) * 100 > length(regexp_replace(text, '\s', '', 'g')) OR lang <> 'en' AND length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) = 0)".replace("AS foreign", 'AS "foreign"')),
    "title_candidates": (q_title_candidates, r"WITH t AS (SELECT p_partkey, p_name || CASE WHEN p_size % 2 = 0 THEN ' (' || p_brand || ')' ELSE ' - ' || p_type END || ' feat. ' || p_brand AS t FROM part) SELECT DISTINCT p_partkey, c AS candidate FROM (SELECT p_partkey, unnest([trim(t), trim(regexp_replace(t, '[\(\[][^\)\]]*[\)\]]', '', 'g')), trim(CASE WHEN contains(t, ' - ') THEN left(t, instr(t, ' - ') - 1) ELSE t END), trim(regexp_replace(t, '(?i)\s+(feat|ft)\.?\s.*$', ''))]) AS c FROM t) WHERE c <> ''"),
    "fragment_df": (q_fragment_df, f"SELECT fragment, count(*) AS df FROM {_fragments(4)} GROUP BY 1 HAVING count(*) >= 2"),
    "fuzzy_rank_all": (q_fuzzy_rank_all, BEST),
    "containment_lines": (q_containment_lines, f"WITH b AS (SELECT song AS item_id, line AS item_line, {ANCHOR} AS short FROM {LYRICS_SQL.replace('doc_id', 'item_id').replace('documents', 'benchmark')}), l AS (SELECT song, line, {ANCHOR} AS long FROM {L}) SELECT song, line, item_id, item_line FROM l JOIN b ON contains(long, short) OR contains(short, long) AND 10 * length(long) >= 3 * length(short) WHERE length(long) >= 4 AND length(short) >= 4"),
    "char_multiset_f1": (q_char_multiset_f1, "WITH t AS (SELECT conv_id, role, arg_min(text, turn) AS text FROM conversations WHERE role <> 'system' GROUP BY 1, 2), c AS (SELECT conv_id, role, ch, count(*) AS n FROM (SELECT conv_id, role, unnest(string_split(text, '')) AS ch FROM t) GROUP BY ALL), s AS (SELECT a.conv_id, sum(least(a.n, b.n)) AS shared FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.ch = b.ch AND a.role = 'user' AND b.role = 'assistant' GROUP BY 1) SELECT s.conv_id, shared, round(2 * shared::DOUBLE / (length(x.text) + length(y.text)), 9) AS f1 FROM s JOIN t x ON x.conv_id = s.conv_id AND x.role = 'user' JOIN t y ON y.conv_id = s.conv_id AND y.role = 'assistant'"),
    "caption_islands": (q_caption_islands, "WITH e AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e) SELECT user_id, run, event_type, count(*) AS n, min(event_id) AS first_event FROM r GROUP BY 1, 2, 3"),
    "gloss_cycle": (q_gloss_cycle, "WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations WHERE role <> 'system') SELECT conv_id, count(*) FILTER (role = CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END) * 10 >= count(*) * 9 AS cycles FROM t GROUP BY 1 HAVING count(*) >= 2"),
    "line_split_words": (q_line_split_words, r"WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM conversations) SELECT conv_id, turn, k::INT AS k, word, floor(k * 1000000 / n::DOUBLE)::BIGINT AS at FROM (SELECT conv_id, turn, unnest(range(len(w))) AS k, unnest(w) AS word, len(w) AS n FROM w)"),
    "line_split_chars": (q_line_split_chars, rf"SELECT song, line, n, coalesce(sum(n) OVER (PARTITION BY song ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT song, line, length(regexp_replace(text, '\s', '', 'g')) AS n FROM {L})"),
    "html_cell_text": (q_html_cell_text, f"SELECT page_id, md5({CELL.format('html')}) AS text_md5 FROM pages"),
    "html_list_items": (q_html_list_items, f"SELECT page_id, (k // 3)::INT AS row, (k % 3)::INT AS \"column\", {CELL.format('c')} AS cell FROM (SELECT page_id, unnest(c) AS c, unnest(range(len(c))) AS k FROM (SELECT page_id, regexp_extract_all(html, '<li>(.*?)</li>', 1) AS c FROM pages))"),
    "filename_slug": (q_filename_slug, "SELECT page_id, left(trim(regexp_replace(lower(regexp_extract(url, '://([^?#]*)', 1)), '[^a-z0-9]+', '-', 'g'), '-'), 40) AS slug FROM pages"),
    "failure_code": (q_failure_code, "SELECT CASE WHEN contains(event_type, 'err') THEN 'engine' WHEN event_type IN ('click', 'view') THEN 'client' WHEN value > 50 THEN 'large' END AS code, count(*) AS n FROM events GROUP BY 1"),
    "credit_lines": (q_credit_lines, rf"SELECT song, line FROM {L} WHERE regexp_matches(text, '(?i)(licensed under|copyright|https?://|@[a-z0-9-]+\.)')"),
    "edge_trim": (q_edge_trim, f"WITH l AS (SELECT song, line, length(text) < 15 AS short FROM {L}), r AS (SELECT *, min(short) OVER (PARTITION BY song ORDER BY line ROWS UNBOUNDED PRECEDING) AND row_number() OVER (PARTITION BY song ORDER BY line) <= 2 AS h, min(short) OVER (PARTITION BY song ORDER BY line DESC ROWS UNBOUNDED PRECEDING) AND row_number() OVER (PARTITION BY song ORDER BY line DESC) <= 2 AS t FROM l), c AS (SELECT *, count(*) FILTER (NOT h AND NOT t) OVER (PARTITION BY song) AS k FROM r) SELECT song, line FROM c WHERE k < 4 OR NOT h AND NOT t"),
}
