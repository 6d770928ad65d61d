"""Moras of Japanese lines, and pronunciations in Hangul aligned to them.

A mora is a struct (kana, a, b): a from 1 is its first letter in the text, b the letter after its last.
Tokens (surface, reading in kana) are an input: whoever has a dictionary makes them; their surfaces in a
row are the text.  A word in ASCII letters outside Japanese tokens is one mora; spaces, marks and Hangul
are none.  Costs are whole hundredths, so that equal ways are equal; of these a match goes before a mora
that is passed over, and that before a syllable of its own.

A null text, pronunciation or token list gives null; empty ones give empty lists; a null surface or reading
is empty.  Lines that are equal give equal results; there is no other order between rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.functions.readings import FIRST, PAIRS, TO_HANGUL, hiragana, kana_hangul
from lineweave.functions.readings import LONG as LONG_VOWELS
from lineweave.operators.words import letter_times, letters_found, once, syllable_times
from lineweave.sources.tables import dealt, table

#: Small kana that are one mora with the kana before them.
SMALL = "ゃゅょぁぃぅぇぉゎ"
JAPANESE = r"\x{3040}-\x{30FF}\x{3400}-\x{9FFF}"
WORD = r"[A-Za-z0-9&＆]+(?:['’-][A-Za-z0-9]+)*"
MORAS = "array<struct<kana: string, a: int, b: int>>"


def kana_moras(reading: Column) -> Column:
    """A reading in hiragana, cut before each kana that isn't small."""
    return F.filter(F.regexp_extract_all(hiragana(reading), F.lit(rf"(?s).[{SMALL}]*"), 0), lambda x: x != "")


def token_moras(surface: Column, reading: Column, start: Column) -> Column:
    """Moras of one token.  Kana of the surface stand for themselves; what is between (Han characters)
    shares the moras of the reading up to the next such kana, one at least.  If surface and reading
    don't fit, all moras share the whole token."""
    parts = F.regexp_extract_all(surface, F.lit(rf"(?s)[\x{{3040}}-\x{{30FF}}][{SMALL}{'ャュョァィゥェォヮ'}]*|[^\x{{3040}}-\x{{30FF}}]+"), 0)
    is_kana = lambda x: x.rlike(r"^[\x{3040}-\x{30FF}]")

    def fit(moras: Column, parts: Column) -> Column:
        n = F.size(moras)
        first = F.struct(F.lit(0).alias("r"), start.cast("int").alias("at"), F.lit(True).alias("ok"), F.array().cast(MORAS).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            end = acc.at + F.length(x.part)
            rest = F.slice(moras, acc.r + 1, F.greatest(n - acc.r, F.lit(0)))
            here = F.get(moras, acc.r)
            many = F.when(is_kana(x.part), F.when(here == hiragana(x.part), 1).otherwise(0)).when(x.next.isNull(), n - acc.r).otherwise(F.array_position(rest, hiragana(x.next)).cast("int") - 1)
            took = F.transform(F.slice(rest, F.lit(1), F.greatest(many, F.lit(0))), lambda m: F.struct(m.alias("kana"), acc.at.alias("a"), end.alias("b")))
            return F.struct((acc.r + F.greatest(many, F.lit(0))).alias("r"), end.alias("at"), (acc.ok & (many > 0)).alias("ok"), F.concat(acc.out, took).alias("out"))

        pairs = F.transform(parts, lambda x, i: F.struct(x.alias("part"), F.get(parts, i + 1).alias("next")))
        whole = F.transform(moras, lambda m: F.struct(m.alias("kana"), start.cast("int").alias("a"), (start + F.length(surface)).cast("int").alias("b")))
        return once(F.aggregate(pairs, first, step), lambda x: F.when(x.ok & (x.r == n), x.out).otherwise(whole))

    return once(F.struct(kana_moras(reading).alias("m"), parts.alias("p")), lambda x: fit(x.m, x.p))


def word_moras(masked: Column) -> Column:
    """A mora for each word in ASCII letters."""
    first = F.struct(F.lit(1).alias("at"), F.array().cast(MORAS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        end = acc.at + F.length(x)
        mora = F.when(x.rlike(r"^[A-Za-z0-9&＆]"), F.array(F.struct(x.alias("kana"), acc.at.alias("a"), end.alias("b")))).otherwise(F.array().cast(MORAS))
        return F.struct(end.alias("at"), F.concat(acc.out, mora).alias("out"))

    pieces = F.filter(F.regexp_extract_all(masked, F.lit(rf"(?s){WORD}|[^A-Za-z0-9&＆]+"), 0), lambda x: x != "")
    return F.aggregate(pieces, first, step, lambda acc: acc.out)


def text_moras(tokens: Column) -> Column:
    """Moras of a line in order of the text.  tokens: array of struct(surface, reading)."""
    clean = F.transform(tokens, lambda t: F.struct(F.coalesce(t.surface, F.lit("")).alias("surface"), F.coalesce(t.reading, F.lit("")).alias("reading")))
    ends = F.transform(clean, lambda t, i: F.struct(t.surface, t.reading, (F.aggregate(F.slice(clean, F.lit(1), i), F.lit(1), lambda n, x: n + F.length(x.surface))).alias("start"), t.surface.rlike(f"[{JAPANESE}]").alias("japanese")))

    def line(found: Column) -> Column:
        own = F.flatten(F.transform(F.filter(found, lambda t: t.japanese), lambda t: token_moras(t.surface, t.reading, t.start)))
        masked = F.array_join(F.transform(found, lambda t: F.when(t.japanese, F.repeat(F.lit("あ"), F.length(t.surface))).otherwise(t.surface)), "")
        by_place = F.transform(F.concat(own, word_moras(masked)), lambda m, i: F.struct(m.a.alias("a"), i.alias("i"), m.alias("m")))
        return F.transform(F.array_sort(by_place), lambda x: x.m)

    return once(ends, line)


# The rows of kana with their vowels in order, the Hangul initials that each row may be written
# with, and the vowel that each of Hangul's 21 vowels sounds like (5: none of the five; eo and eu).
ROWS = ["あいうえお", "かきくけこ", "がぎぐげご", "さしすせそ", "ざじずぜぞ", "たちつてと", "だぢづでど", "なにぬねの", "はひふへほ", "ばびぶべぼ", "ぱぴぷぺぽ", "まみむめも", "や ゆ よ", "らりるれろ", "わゐ ゑを"]
INITIALS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
ROW_INITIALS = "ㅇ ㄱㅋㄲ ㄱㄲ ㅅㅆ ㅈㅉ ㄷㅌㄸㅊㅉ ㄷㄸ ㄴ ㅎ ㅂㅃ ㅍㅃ ㅁ ㅇ ㄹ ㅇ".split()
SOUNDS = [0, 3, 0, 3, 5, 3, 5, 3, 4, 0, 3, 3, 4, 2, 5, 3, 1, 2, 5, 1, 1]
SMALL_VOWELS = dict(zip("ゃゅょぁぃぅぇぉゎ", [0, 2, 4, 0, 1, 2, 3, 4, 0]))
#: Hundredths: a likely pair, a pair that is half right, one that is open, one that is wrong; a mora without
#: a syllable, a syllable without a mora, and a syllable of a word in ASCII letters.
LOW, PARTIAL, OPEN, WRONG, SKIP, EXTRA, ASCII = 5, 35, 50, 90, 55, 60, 10
KANA = {k: (r, v) for r, row in enumerate(ROWS) for v, k in enumerate(row) if k != " "}
ALLOWED = np.array([[c in allowed for c in INITIALS] for allowed in ROW_INITIALS])
#: Classes of moras beside the rows: unknown kana, nasal, small tsu, long sign, word.
UNKNOWN, NASAL, STOP, LONG, ASCII_WORD = range(15, 20)


def mora_class(kana: str) -> tuple[int, int]:
    """Row or class, and vowel (-1: none)."""
    if kana and (kana[0].isascii() and (kana[0].isalnum() or kana[0] == "&") or kana[0] == "＆"):
        return ASCII_WORD, -1
    if kana in ("ん", "っ", "ー"):
        return {"ん": NASAL, "っ": STOP, "ー": LONG}[kana], -1
    base = KANA.get(kana[:1])
    if base is None or len(kana) > 2 or len(kana) == 2 and kana[1] not in SMALL_VOWELS:
        return UNKNOWN, -1
    return base[0], SMALL_VOWELS[kana[1]] if len(kana) == 2 else base[1]


def pair_costs(rows: np.ndarray, vowels: np.ndarray, initial: np.ndarray, sound: np.ndarray) -> np.ndarray:
    """Costs [line, mora, syllable]; initial is -1 for what isn't a Hangul syllable."""
    r, v, c, s = rows[:, :, None], vowels[:, :, None], initial[:, None, :], sound[:, None, :]
    onset = ALLOWED[np.minimum(r, 14), np.maximum(c, 0)]
    cost = np.where(onset & (v == s), 0, np.where(onset | (v == s), PARTIAL, WRONG))
    before = np.concatenate((np.full((len(rows), 1, 1), -1), v[:, :-1]), axis=1)
    cost = np.where(r == LONG, np.where((before >= 0) & (before == s), LOW, np.where(c == 11, PARTIAL, WRONG)), cost)
    cost = np.where(r == NASAL, np.where(np.isin(c, (2, 6, 11)), LOW, WRONG), cost)
    cost = np.where((r == STOP) | (r == UNKNOWN), OPEN, cost)
    return np.where(r == ASCII_WORD, ASCII, np.where(c < 0, WRONG, cost))


def edit_table(rows: np.ndarray, n_moras: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least costs [line, i, j] of the first i moras and j syllables, and the last step (0 match, 1 mora
    passed over, 2 syllable of its own) of the best way there, for all lines along anti-diagonals."""
    lines, m, s = pair.shape
    skip = np.where((rows == STOP) | (rows == NASAL), LOW, SKIP)
    words = np.concatenate((rows == ASCII_WORD, np.zeros((lines, 1), bool)), axis=1)
    words[np.arange(m + 1)[None, :] >= n_moras[:, None]] = False
    extra = np.where(words, ASCII, EXTRA)
    cost, last = np.zeros((lines, m + 1, s + 1), np.int32), np.zeros((lines, m + 1, s + 1), np.int8)
    cost[:, 1:, 0], last[:, 1:, 0] = np.cumsum(skip, axis=1), 1
    cost[:, 0, 1:], last[:, 0, 1:] = extra[:, :1] * np.arange(1, s + 1), 2
    for d in range(2, m + s + 1):
        i = np.arange(max(1, d - s), min(m, d - 1) + 1)
        j = d - i
        ways = np.stack((cost[:, i - 1, j - 1] + pair[:, i - 1, j - 1], cost[:, i - 1, j] + skip[:, i - 1], cost[:, i, j - 1] + extra[:, i]))
        last[:, i, j] = ways.argmin(axis=0)  # of equal ones the first
        cost[:, i, j] = ways.min(axis=0)
    return cost, last


def read_back(kana: list[str], syllables: list[str], pair: np.ndarray, last: np.ndarray) -> tuple[list[dict], float]:
    """Syllables with their moras [first, until) from 0, -1 without one; and the quality from 0 to 1."""
    i, j, steps = len(kana), len(syllables), []
    while i or j:
        steps.append((int(last[i, j]), i, j))
        i, j = i - (steps[-1][0] < 2), j - (steps[-1][0] != 1)
    out, likeness, end = [], 0, None
    for step, i, j in reversed(steps):
        if step == 1:
            if kana[i - 1] in ("っ", "ん") and out and out[-1]["first"] >= 0 and end == i - 1:
                out[-1]["until"] = end = i
            continue
        mora = i - 1 if step == 0 else i if i < len(kana) and mora_class(kana[i])[0] == ASCII_WORD else -1
        out.append({"text": syllables[j - 1], "first": mora, "until": mora + 1 if mora >= 0 else -1})
        if mora >= 0:
            likeness, end = likeness + 100 - (int(pair[i - 1, j - 1]) if step == 0 else ASCII), mora + 1
    return out, likeness / 100 / len(out) if out else 0.0


#: Cells of edit tables that a task has at a time, but for one line's own.
CELLS = 1 << 21
SYLLABLES = "syllables array<struct<text: string, first: int, until: int>>, quality double"


def aligned_batch(moras: list[list[str]], prons: list[list[str]]) -> list[tuple[list[dict], float]]:
    m, s = max(map(len, moras)), max(map(len, prons))
    rows, vowels = np.full((len(moras), m), UNKNOWN), np.full((len(moras), m), -1)
    initial, sound = np.full((len(prons), s), -1), np.full((len(prons), s), 5)
    for k, (x, y) in enumerate(zip(moras, prons)):
        if x:
            rows[k, : len(x)], vowels[k, : len(x)] = zip(*map(mora_class, x))
        for at, c in enumerate(y):
            if FIRST <= ord(c) <= FIRST + 11171:
                initial[k, at], sound[k, at] = (ord(c) - FIRST) // 588, SOUNDS[(ord(c) - FIRST) % 588 // 28]
    pair = pair_costs(rows, vowels, initial, sound)
    _, last = edit_table(rows, np.array([len(x) for x in moras]), pair)
    return [read_back(x, y, pair[k], last[k]) for k, (x, y) in enumerate(zip(moras, prons))]


def align_syllables(lines: DataFrame) -> DataFrame:
    """The lines, with syllables (text, first, until) of ``pron`` aligned to ``moras`` and the quality: the
    share of syllables with a mora, times how alike these are.  Lines meet no others; a task looks at as
    many together as CELLS allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moras = [None if x is None else [m["kana"] for m in x] for x in batch.column("moras").to_pylist()]
            prons = [None if x is None else [c for c in x if not c.isspace()] for x in batch.column("pron").to_pylist()]
            found: list = [None if x is None or y is None else ([], 0.0) for x, y in zip(moras, prons)]
            todo = sorted((k for k in range(len(moras)) if moras[k] and prons[k]), key=lambda k: (len(moras[k]), len(prons[k])))
            while todo:
                some = [todo.pop()]
                m, s = len(moras[some[0]]), len(prons[some[0]])
                while todo and (m + 1) * (max(s, len(prons[todo[-1]])) + 1) * (len(some) + 1) <= CELLS:
                    some.append(todo.pop())
                    s = max(s, len(prons[some[-1]]))
                for k, x in zip(some, aligned_batch([moras[k] for k in some], [prons[k] for k in some])):
                    found[k] = x
            of = pa.list_(pa.struct([("text", pa.string()), ("first", pa.int32()), ("until", pa.int32())]))
            out = batch.append_column("syllables", pa.array([x and x[0] for x in found], of))
            yield out.append_column("quality", pa.array([x and x[1] for x in found], pa.float64()))

    schema = ", ".join(f"`{c}` {t}" for c, t in lines.dtypes)
    return lines.mapInArrow(run, f"{schema}, {SYLLABLES}")


def syllable_segments(syllables: Column, quality: Column, mora_times: Column, least: float = 0.6) -> Column:
    """Array of (text, s, e): syllables with the time of their moras; those of the same moras share it in
    equal parts; none starts before the one before has ended.  Null where the quality is too low."""

    def at(rows: Column, times: Column, x: Column, i: Column) -> Column:
        same = F.filter(rows, lambda y: (y.first == x.first) & (y.until == x.until))
        before = F.size(F.filter(F.slice(rows, F.lit(1), i), lambda y: (y.first == x.first) & (y.until == x.until)))
        s, e = F.get(times, x.first).s, F.get(times, x.until - 1).e
        long = F.greatest(e - s, F.lit(0))
        return F.struct(x.text.alias("text"), (s + F.floor(long * before / F.size(same))).alias("s"), (s + F.floor(long * (before + 1) / F.size(same))).alias("e"))

    def in_order(rows: Column) -> Column:
        late = lambda i: F.array_max(F.transform(F.slice(rows, F.lit(1), i), lambda x: F.greatest(x.s, x.e)))
        return F.transform(rows, lambda x, i: once(F.struct(F.greatest(x.s, F.when(i > 0, late(i))).alias("s")), lambda y: F.struct(x.text.alias("text"), y.s.alias("s"), F.greatest(x.e, y.s).alias("e"))))

    own = F.struct(F.filter(syllables, lambda x: x.first >= 0).alias("rows"), mora_times.alias("times"))
    timed = once(own, lambda v: F.transform(v.rows, lambda x, i: at(v.rows, v.times, x, i)))
    return F.when(quality >= least, once(timed, lambda rows: F.when(F.size(rows) > 0, in_order(rows))))


# Queries: words of part names as tokens.  Letters stand for kana; in the surface some are a Han character.
_LATIN, _KANA, _HAN = "abcdefghijklmnopqrstuvwxyz", "あばかでえふがひいじきらみんおぱくるしっーゔわょゃざ", "ai"


def _tokens(spark, d) -> DataFrame:
    p = dealt(table(spark, d, "part"), "p_partkey")
    kana = lambda w: F.translate(w, _LATIN, _KANA)
    token = lambda w: F.struct(kana(F.regexp_replace(w, f"[{_HAN}]+", "漢")).alias("surface"), kana(w).alias("reading"))
    words = F.concat(F.transform(F.split("p_name", " "), token), F.array(F.struct(F.concat(F.lit(" "), "p_brand", F.lit("! & co")).alias("surface"), F.lit("").alias("reading"))))
    return p.select("p_partkey", words.alias("tokens"), F.array_join(words["surface"], "").alias("text"), "p_name", "p_type")


def _moras(spark, d) -> DataFrame:
    return _tokens(spark, d).withColumn("moras", text_moras(F.col("tokens")))


def q_text_moras(spark, d):
    return _moras(spark, d).select("p_partkey", F.posexplode_outer("moras").alias("k", "m")).where("k IS NOT NULL").select("p_partkey", "k", "m.kana", "m.a", "m.b")


def _aligned(spark, d) -> DataFrame:
    """Names against themselves in Hangul, without s and t, some with other letters or without every third,
    and with syllables for the word at the end;
    every fourth after syllables that aren't in the name."""
    t = _moras(spark, d)
    plain = F.regexp_replace("p_name", "[st ]", "")
    heard = F.when(F.col("p_partkey") % 3 == 0, F.regexp_replace(plain, "(..).", "$1")).when(F.col("p_partkey") % 3 == 1, F.translate(plain, "roel", "kuan")).otherwise(plain)
    pron = F.concat(F.when(F.col("p_partkey") % 4 == 1, "헤 갸르뭬헤 ").otherwise(""), kana_hangul(F.translate(heard, _LATIN, _KANA)), F.lit("브 랜드"))
    return align_syllables(t.select("p_partkey", "text", "moras", pron.alias("pron")))


def q_align_syllables(spark, d):
    t = _aligned(spark, d)
    return t.select("p_partkey", F.round("quality", 9).alias("quality"), F.posexplode("syllables").alias("k", "x")).select("p_partkey", "quality", "k", "x.text", "x.first", "x.until")


def q_syllable_segments(spark, d):
    """Every other letter of the text is found, 0.1 s each."""
    t = _aligned(spark, d)
    spans = F.transform(F.sequence(F.lit(1), F.floor((F.length("text") + 1) / 2).cast("int")), lambda k: F.struct(F.substr("text", 2 * k - 1, F.lit(1)).alias("letter"), (k.cast("long") * 200_000).alias("s"), (k.cast("long") * 200_000 + 60_000).alias("e")))
    t = t.withColumn("spans", spans).withColumn("hits", letters_found("text", "spans"))
    times = once(letter_times(F.col("text"), F.col("hits")), lambda x: syllable_times(F.transform("moras", lambda m: F.struct(m.a.alias("a"), m.b.alias("b"))), x))
    t = t.withColumn("found", syllable_segments(F.col("syllables"), F.col("quality"), times))
    return t.select("p_partkey", F.posexplode_outer("found").alias("k", "x")).where("k IS NOT NULL").select("p_partkey", "k", "x.text", "x.s", "x.e")


def _quoted(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_RANGE, _TABLE = "\\x{3040}-\\x{30FF}", "".join(ROWS)
_TO_HANGUL = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in TO_HANGUL.items()) + "}"
#: v: tokens; n: a step through the parts of a token; m: moras of a line.
MORAS_SQL = f"""u AS (SELECT p_partkey AS p, i, translate(regexp_replace(w, '[{_HAN}]+', '漢', 'g'), '{_LATIN}', '{_KANA}') AS su, translate(w, '{_LATIN}', '{_KANA}') AS re FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, unnest(range(len(string_split(p_name, ' ')))) AS i FROM part)),
v AS (SELECT *, (1 + coalesce(sum(length(su)) OVER (PARTITION BY p ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS start, regexp_extract_all(su, '[{_RANGE}][{SMALL}]*|[^{_RANGE}]+') AS parts, regexp_extract_all(re, '.[{SMALL}]*') AS ms FROM u),
n AS (SELECT p, i, 0 AS k, 0 AS r, start AS pos, true AS ok, []::STRUCT(kana VARCHAR, a INT, b INT)[] AS found FROM v
UNION ALL SELECT p, i, k + 1, r + greatest(many, 0), pos + length(parts[k + 1])::INT, ok AND many > 0, list_concat(found, list_transform(list_slice(ms, r + 1, r + greatest(many, 0)), lambda x: {{'kana': x, 'a': pos, 'b': pos + length(parts[k + 1])::INT}})) FROM (SELECT n.*, parts, ms, (CASE WHEN NOT regexp_matches(parts[k + 1], '^[{_RANGE}]') THEN CASE WHEN len(parts) = k + 1 THEN len(ms) - r ELSE coalesce(list_position(list_slice(ms, r + 1, len(ms)), parts[k + 2]), 0) - 1 END WHEN ms[r + 1] = parts[k + 1] THEN 1 ELSE 0 END)::INT AS many FROM n JOIN v USING (p, i) WHERE k < len(parts))),
t AS (SELECT p, i, CASE WHEN ok AND r = len(ms) THEN found ELSE list_transform(ms, lambda x: {{'kana': x, 'a': start, 'b': start + length(su)::INT}}) END AS found FROM n JOIN v USING (p, i) WHERE k = len(parts)),
z AS (SELECT p, max(start + length(su))::INT - 1 AS past, string_agg(su, '' ORDER BY i) AS text FROM v GROUP BY 1),
b AS (SELECT p, [{{'kana': 'Brand', 'a': past + 2, 'b': past + 7}}, {{'kana': no, 'a': past + 8, 'b': past + 8 + length(no)::INT}}, {{'kana': '&', 'a': past + 10 + length(no)::INT, 'b': past + 11 + length(no)::INT}}, {{'kana': 'co', 'a': past + 12 + length(no)::INT, 'b': past + 14 + length(no)::INT}}] AS found, text || ' ' || p_brand || '! & co' AS text FROM (SELECT z.*, p_brand, substr(p_brand, 7) AS no FROM z JOIN part ON p_partkey = p)),
m AS (SELECT p, list_concat(flatten(list(t.found ORDER BY i)), any_value(b.found)) AS ms, any_value(text) AS text FROM t JOIN b USING (p) GROUP BY 1)"""
#: ho: pronunciations; o: lines with classes; c: cells of the edit table in order; w: steps back; y: syllables.
ALIGN_SQL = f"""h0 AS (SELECT p_partkey AS p, regexp_replace(p_name, '[st ]', '', 'g') AS x FROM part),
hk AS (SELECT p, array_to_string(list_transform(regexp_extract_all(translate(CASE p % 3 WHEN 0 THEN regexp_replace(x, '(..).', '\\1', 'g') WHEN 1 THEN translate(x, 'roel', 'kuan') ELSE x END, '{_LATIN}', '{_KANA}'), '{"|".join(PAIRS)}|.'), lambda x: coalesce({_TO_HANGUL}[x], x)), '') AS l FROM h0),
hs AS (SELECT p, unnest(regexp_extract_all(l, '^[っんー]+|[^っんー][っんー]*')) AS x, unnest(range(len(regexp_extract_all(l, '^[っんー]+|[^っんー][っんー]*')))) AS i FROM hk),
hf AS (SELECT p, i, x, CASE WHEN regexp_matches(x, '^[っんー]') THEN '' ELSE x[1] END AS y, CASE WHEN regexp_matches(x, '^[っんー]') THEN 0 ELSE 1 END AS d FROM hs
UNION ALL SELECT p, i, x, CASE WHEN x[d + 1] = 'ん' THEN CASE WHEN code >= 0 AND code % 28 = 0 THEN y[:-2] || chr((code + {FIRST} + 4)::INT) ELSE y || '응' END WHEN x[d + 1] = 'っ' THEN CASE WHEN code >= 0 AND code % 28 = 0 THEN y[:-2] || chr((code + {FIRST} + 19)::INT) ELSE y || 'っ' END ELSE CASE WHEN code >= 0 THEN y || '{LONG_VOWELS}'[(code // 28 % 21)::INT + 1] ELSE y END END, d + 1 FROM (SELECT *, CASE WHEN y = '' OR unicode(y[-1]) NOT BETWEEN {FIRST} AND {FIRST + 11171} THEN -1 ELSE unicode(y[-1]) - {FIRST} END AS code FROM hf WHERE d < length(x))),
ho AS (SELECT p, string_split(CASE WHEN p % 4 = 1 THEN '헤갸르뭬헤' ELSE '' END || string_agg(y, '' ORDER BY i) || '브랜드', '') AS ss FROM hf WHERE d = length(x) GROUP BY 1),
o AS (SELECT p, ms, text, ss, list_transform(ms, lambda x: CASE WHEN regexp_matches(x.kana, '^[A-Za-z0-9&＆]') THEN {ASCII_WORD} WHEN x.kana = 'ん' THEN {NASAL} WHEN x.kana = 'っ' THEN {STOP} WHEN x.kana = 'ー' THEN {LONG} WHEN length(x.kana) > 2 OR strpos('{_TABLE}', x.kana[1]) = 0 THEN {UNKNOWN} ELSE (strpos('{_TABLE}', x.kana[1]) - 1) // 5 END) AS cl,
list_transform(ms, lambda x: CASE WHEN regexp_matches(x.kana, '^[A-Za-z0-9&＆]') OR length(x.kana) > 2 OR strpos('{_TABLE}', x.kana[1]) = 0 THEN -1 WHEN length(x.kana) = 2 THEN {[*SMALL_VOWELS.values()]}[strpos('{"".join(SMALL_VOWELS)}', x.kana[2])] ELSE (strpos('{_TABLE}', x.kana[1]) - 1) % 5 END) AS vo,
list_transform(ss, lambda x: CASE WHEN unicode(x) BETWEEN {FIRST} AND {FIRST + 11171} THEN (unicode(x) - {FIRST}) // 588 ELSE -1 END) AS ini, list_transform(ss, lambda x: CASE WHEN unicode(x) BETWEEN {FIRST} AND {FIRST + 11171} THEN {SOUNDS}[((unicode(x) - {FIRST}) % 588 // 28)::INT + 1] ELSE 5 END) AS so FROM m JOIN ho USING (p)),
pc AS (SELECT p, i, j, CASE WHEN cl[i] = {ASCII_WORD} THEN {ASCII} WHEN ini[j] < 0 THEN {WRONG} WHEN cl[i] IN ({STOP}, {UNKNOWN}) THEN {OPEN} WHEN cl[i] = {NASAL} THEN CASE WHEN ini[j] IN (2, 6, 11) THEN {LOW} ELSE {WRONG} END WHEN cl[i] = {LONG} THEN CASE WHEN i > 1 AND vo[i - 1] >= 0 AND vo[i - 1] = so[j] THEN {LOW} WHEN ini[j] = 11 THEN {PARTIAL} ELSE {WRONG} END ELSE CASE contains({_quoted(ROW_INITIALS)}[cl[i]::INT + 1], '{INITIALS}'[ini[j]::INT + 1])::INT + (vo[i] = so[j])::INT WHEN 2 THEN 0 WHEN 1 THEN {PARTIAL} ELSE {WRONG} END END AS x FROM (SELECT *, unnest(range(1, len(ss) + 1))::INT AS j FROM (SELECT *, unnest(range(1, len(ms) + 1))::INT AS i FROM o))),
pl AS (SELECT p, list(x ORDER BY i, j) AS pc FROM pc GROUP BY 1),
a AS (SELECT p, cl, pc, (len(ss) + 1)::INT AS wide, len(ms)::INT AS high FROM o JOIN pl USING (p)),
c AS (SELECT p, 0 AS pos, [0]::INT[] AS cost, [-1]::INT[] AS back FROM o
UNION ALL SELECT p, pos + 1, list_append(cost, least(x, y, z)::INT), list_append(back, CASE WHEN x <= least(y, z) THEN 0 WHEN y <= z THEN 1 ELSE 2 END) FROM (SELECT *, CASE WHEN i > 0 AND j > 0 THEN cost[pos + 1 - wide] + pc[(i - 1) * (wide - 1) + j] ELSE 1000000 END AS x, CASE WHEN i > 0 THEN cost[pos + 2 - wide] + CASE WHEN cl[i] IN ({STOP}, {NASAL}) THEN {LOW} ELSE {SKIP} END ELSE 1000000 END AS y, CASE WHEN j > 0 THEN cost[pos + 1] + CASE WHEN coalesce(cl[i + 1], -1) = {ASCII_WORD} THEN {ASCII} ELSE {EXTRA} END ELSE 1000000 END AS z FROM (SELECT c.*, cl, pc, wide, high, (pos + 1) // wide AS i, (pos + 1) % wide AS j FROM c JOIN a USING (p)) WHERE i <= high)),
f AS (SELECT p, max_by(back, pos) AS back FROM c GROUP BY 1),
w AS (SELECT p, 0 AS k, len(ms)::INT AS i, len(ss)::INT AS j, -1 AS step FROM o
UNION ALL SELECT p, k + 1, i - CASE WHEN s < 2 THEN 1 ELSE 0 END, j - CASE WHEN s <> 1 THEN 1 ELSE 0 END, s FROM (SELECT w.*, back[i * wide + j + 1] AS s FROM w JOIN f USING (p) JOIN a USING (p) WHERE i > 0 OR j > 0)),
x AS (SELECT p, k, step, i, j, cl[i + 1] AS c, sum(CASE WHEN step <> 1 THEN 1 ELSE 0 END) OVER (PARTITION BY p ORDER BY k DESC) AS g FROM w JOIN o USING (p) WHERE k > 0),
xr AS (SELECT *, row_number() OVER (PARTITION BY p, g ORDER BY k DESC) - 1 AS nth FROM x),
ext AS (SELECT p, g, coalesce(min(nth) FILTER (nth > 0 AND c NOT IN ({STOP}, {NASAL})), max(nth) + 1) - 1 AS more FROM xr GROUP BY 1, 2),
ys AS (SELECT xr.p, (g - 1)::INT AS k, ss[j + 1] AS text, CASE WHEN step = 0 OR coalesce(c, -1) = {ASCII_WORD} THEN i ELSE -1 END AS first, more, CASE WHEN step = 0 THEN pc[i * len(ss) + j + 1] ELSE {ASCII} END AS cost FROM xr JOIN ext USING (p, g) JOIN o USING (p) JOIN pl USING (p) WHERE step <> 1),
y AS (SELECT p, k, text, first::INT AS first, (CASE WHEN first < 0 THEN -1 ELSE first + 1 + more END)::INT AS until, sum(CASE WHEN first >= 0 THEN 100 - cost ELSE 0 END) OVER (PARTITION BY p) / 100.0::DOUBLE / count(*) OVER (PARTITION BY p) AS quality FROM ys)"""
#: d: hits of letters; l: times of letters; e: of moras; q: of syllables.
SEGMENTS_SQL = """d AS (SELECT p, 0 AS k, 0 AS pos, false AS hit FROM o
UNION ALL SELECT p, k + 1, CASE WHEN here > 0 THEN pos + here ELSE pos END, here > 0 FROM (SELECT d.*, strpos(substr(text, pos + 1), text[2 * k + 1])::INT AS here FROM d JOIN o USING (p) WHERE 2 * k + 1 <= length(text))),
lp AS (SELECT o.p, o.pos, any_value(k) * 200000 AS s, any_value(k) * 200000 + 60000 AS e FROM (SELECT p, unnest(range(1, length(text) + 1)) AS pos FROM o) o LEFT JOIN d ON d.p = o.p AND d.pos = o.pos AND hit GROUP BY 1, 2),
lk AS (SELECT *, CASE WHEN s IS NOT NULL THEN pos END AS known FROM lp),
la AS (SELECT *, last_value(known IGNORE NULLS) OVER w AS a_p, last_value(s IGNORE NULLS) OVER w AS a_s, last_value(e IGNORE NULLS) OVER w AS a_e, first_value(known IGNORE NULLS) OVER z AS b_p, first_value(s IGNORE NULLS) OVER z AS b_s, first_value(e IGNORE NULLS) OVER z AS b_e FROM lk WINDOW w AS (PARTITION BY p ORDER BY pos ROWS UNBOUNDED PRECEDING), z AS (PARTITION BY p ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT p, pos, CASE WHEN a_p IS NULL THEN b_s WHEN b_p IS NULL OR a_p = pos THEN a_s ELSE floor(a_e + (b_s - a_e)::DOUBLE / (b_p - a_p) * (pos - a_p - 1))::BIGINT END AS s, CASE WHEN a_p IS NULL THEN b_e WHEN b_p IS NULL OR a_p = pos THEN a_e ELSE floor(a_e + (b_s - a_e)::DOUBLE / (b_p - a_p) * (pos - a_p))::BIGINT END AS e FROM la),
em AS (SELECT p, k, ms[k + 1].a AS a, ms[k + 1].b AS b FROM (SELECT p, ms, unnest(range(len(ms)))::INT AS k FROM o)),
ec AS (SELECT *, count(*) OVER (PARTITION BY p, a, b) AS n, row_number() OVER (PARTITION BY p, a, b ORDER BY k) - 1 AS r FROM em),
e AS (SELECT ec.p, ec.k, f.s + greatest(g.e - f.s, 0) * r // n AS s, f.s + greatest(g.e - f.s, 0) * (r + 1) // n AS e FROM ec JOIN l f ON f.p = ec.p AND f.pos = ec.a JOIN l g ON g.p = ec.p AND g.pos = ec.b - 1),
qn AS (SELECT p, (row_number() OVER (PARTITION BY p ORDER BY k) - 1)::INT AS k, text, first, until, count(*) OVER (PARTITION BY p, first, until) AS n, row_number() OVER (PARTITION BY p, first, until ORDER BY k) - 1 AS r FROM y WHERE first >= 0 AND quality >= 0.6::DOUBLE),
qt AS (SELECT qn.p, qn.k, text, f.s + greatest(g.e - f.s, 0) * r // n AS s, f.s + greatest(g.e - f.s, 0) * (r + 1) // n AS e FROM qn JOIN e f ON f.p = qn.p AND f.k = first JOIN e g ON g.p = qn.p AND g.k = until - 1),
q AS (SELECT p, k, text, greatest(s, coalesce(max(greatest(s, e)) OVER (PARTITION BY p ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s)) AS s, e FROM qt)"""

QUERIES = {
    "text_moras": (q_text_moras, f"WITH RECURSIVE {MORAS_SQL} SELECT p AS p_partkey, k, ms[k + 1].kana AS kana, ms[k + 1].a AS a, ms[k + 1].b AS b FROM (SELECT p, ms, unnest(range(len(ms)))::INT AS k FROM m)"),
    "syllable_alignment": (q_align_syllables, f"WITH RECURSIVE {MORAS_SQL}, {ALIGN_SQL} SELECT p AS p_partkey, k, text, first, until, round(quality, 9) AS quality FROM y"),
    "syllable_segments": (q_syllable_segments, f"WITH RECURSIVE {MORAS_SQL}, {ALIGN_SQL}, {SEGMENTS_SQL} SELECT p AS p_partkey, k, text, s, greatest(e, s) AS e FROM q"),
}
