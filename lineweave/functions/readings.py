"""Readings by rule: kana in Latin and Hangul letters, Hangul in Latin letters, numbers in kana.

All are expressions over the letters of one text.  A null text has no reading and an empty one an empty
one; letters that a rule doesn't know stay as they are; there are no ties.  Words that need a dictionary
(Han characters, English) aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lineweave.sources.tables import table

# Kana in the order of their table, with their usual Latin and Hangul spellings.
KANA = (
    "あいうえお かきくけこ がぎぐげご さしすせそ ざじずぜぞ たちつてと だぢづでど なにぬねの はひふへほ ばびぶべぼ ぱぴぷぺぽ まみむめも"
    " やゆよ らりるれろ わゐゑを ゔゎゕゖ ぁぃぅぇぉ ゃゅょ"
).replace(" ", "")
LATIN = (
    "a i u e o ka ki ku ke ko ga gi gu ge go sa shi su se so za ji zu ze zo ta chi tsu te to da ji zu de do na ni nu ne no"
    " ha hi fu he ho ba bi bu be bo pa pi pu pe po ma mi mu me mo ya yu yo ra ri ru re ro wa i e o vu wa ka ke a i u e o ya yu yo"
).split()
HANGUL = (
    "아이우에오 카키쿠케코 가기구게고 사시스세소 자지즈제조 타치츠테토 다지즈데도 나니누네노 하히후헤호 바비부베보 파피푸페포 마미무메모"
    " 야유요 라리루레로 와이에오 부와카케 아이우에오 야유요"
).replace(" ", "")
# Loan pairs with a small vowel.
LOANS = "ふぁ ふぃ ふぇ ふぉ ふゅ うぃ うぇ うぉ ゔぁ ゔぃ ゔぇ ゔぉ てぃ でぃ とぅ どぅ しぇ じぇ ちぇ いぇ".split()
LOANS_LATIN = "fa fi fe fo fyu wi we wo va vi ve vo ti di tu du she je che ye".split()
LOANS_HANGUL = "파 피 페 포 퓨 위 웨 워 바 비 베 보 티 디 투 두 셰 제 체 예".split()
SMALL = "ゃゅょぁぃぅぇぉゎ"
KATAKANA = "".join(chr(c) for c in range(0x30A1, 0x30F7))
HIRAGANA = "".join(chr(ord(c) - 0x60) for c in KATAKANA)
#: The first Hangul syllable; syllables are (initial * 21 + vowel) * 28 + final from there on.
FIRST = 0xAC00


def palatal() -> dict[str, tuple[str, str]]:
    """Kana of the i column with a small ya, yu, yo: Latin and Hangul by rule."""
    found = {}
    for kana, latin, syllable in zip(KANA, LATIN, HANGUL):
        if kana in "きぎしじちぢにひびぴみり":
            stem, soft = latin[:-1], latin in ("shi", "chi", "ji")
            # After j and ch Hangul writes a plain vowel: the y is in the consonant.
            vowels = (0, 13, 8) if latin in ("chi", "ji") else (2, 17, 12)
            for small, vowel, number in zip("ゃゅょ", "auo", vowels):
                found[kana + small] = (stem + ("" if soft else "y") + vowel, chr(ord(syllable) + (number - 20) * 28))
    return found


PAIRS = {k: (a, b) for k, a, b in zip(LOANS, LOANS_LATIN, LOANS_HANGUL)} | palatal()
TO_LATIN = dict(zip(KANA, LATIN)) | {k: a for k, (a, _) in PAIRS.items()}
TO_HANGUL = dict(zip(KANA, HANGUL)) | {k: b for k, (_, b) in PAIRS.items()}

# Letters of Hangul's initials, vowels and finals, and what a final is before a vowel.
INITIALS = "g kk n d tt r m b pp s ss - j jj ch k t p h".replace("-", "").split(" ")
VOWELS = "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split()
FINALS = "- k k k n n n t l k m l l l p l m p p t t ng t t k t p -".replace("-", "").split(" ")
MOVED = {1: "g", 2: "kk", 4: "n", 6: "n", 7: "d", 8: "r", 15: "r", 16: "m", 17: "b", 19: "s", 20: "ss", 22: "j", 23: "ch", 24: "k", 25: "t", 26: "p", 27: ""}
#: Syllable that lengthens each vowel.
LONG = "아애아애어에어에오아애에오우어에이우우이이"

# Digits, irregular hundreds and thousands, and powers of ten thousand.
ONES = ["", "いち", "に", "さん", "よん", "ご", "ろく", "なな", "はち", "きゅう"]
HUNDREDS = {1: "ひゃく", 3: "さんびゃく", 6: "ろっぴゃく", 8: "はっぴゃく"}
THOUSANDS = {1: "せん", 3: "さんぜん", 8: "はっせん"}
POWERS = ["", "まん", "おく", "ちょう"]


def one_of(values: list[str | None], i: Column) -> Column:
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), i.cast("int"))


def looked_up(table_: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table_.items() for x in kv]), key)


def letter(code: Column) -> Column:
    """The letter of a code point below 65536."""
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 4, "0")), "UTF-16BE")


def hiragana(text: Column) -> Column:
    return F.translate(text, KATAKANA, HIRAGANA)


def kana_latin(text: Column) -> Column:
    """Kana in Latin letters: a small tsu doubles the next consonant (t before ch), n before a vowel or y
    has an apostrophe, a long sign repeats the vowel before it."""
    moras = F.regexp_extract_all(hiragana(text), F.lit(rf"(?s)ー+(?![{SMALL}])|[぀-ヿ][{SMALL}]*|."), 0)
    base = F.transform(moras, lambda m: F.when(~m.rlike("^(っ|ん|ー+)$"), F.coalesce(looked_up(TO_LATIN, m), m)))
    both = F.arrays_zip(moras.alias("m"), base.alias("b"))

    def at(rows: Column, x: Column, i: Column) -> Column:
        after = F.get(rows, i + 1)
        after = F.coalesce(after.b, F.when(after.m == "ん", "n"), F.lit(""))
        before = F.coalesce(F.when(i > 0, F.get(rows, i - 1).b), F.lit(""))
        small = F.when(after.startswith("ch"), "t").otherwise(F.left(after, F.lit(1)))
        nasal = F.when(after.rlike("^[aeiouy]"), "n'").otherwise("n")
        vowel = F.repeat(F.regexp_extract(before, "([aeiou])[^aeiou]*$", 1), F.length(x.m))
        return F.when(x.b.isNotNull(), x.b).when(x.m == "っ", small).when(x.m == "ん", nasal).otherwise(vowel)

    spelled = F.transform(F.array(both), lambda rows: F.array_join(F.transform(rows, lambda x, i: at(rows, x, i)), ""))
    return F.get(spelled, 0)


def kana_hangul(text: Column) -> Column:
    """Kana in Hangul: a small tsu and n close the syllable before them, a long sign repeats its vowel."""
    pairs = "|".join(PAIRS)
    letters = F.transform(F.regexp_extract_all(hiragana(text), F.lit(rf"(?s){pairs}|."), 0), lambda m: F.coalesce(looked_up(TO_HANGUL, m), m))
    parts = F.regexp_extract_all(F.array_join(letters, ""), F.lit("(?s)^[っんー]+|[^っんー][っんー]*"), 0)

    def sign(out: Column, x: Column) -> Column:
        code = F.ascii(F.right(out, F.lit(1))) - FIRST
        syllable, closed = code.between(0, 11171), lambda k: F.concat(F.left(out, F.length(out) - 1), letter(code + FIRST + k))
        is_open = syllable & (code % 28 == 0)
        nasal = F.when(is_open, closed(4)).otherwise(F.concat(out, F.lit("응")))
        long = F.when(syllable, F.concat(out, one_of(list(LONG), F.floor(code / 28) % 21))).otherwise(out)
        return F.when(x == "ん", nasal).when((x == "っ") & is_open, closed(19)).when(x == "ー", long).otherwise(out)

    def part(p: Column) -> Column:
        head = F.when(p.rlike("^[っんー]"), F.lit("")).otherwise(F.left(p, F.lit(1)))
        return F.aggregate(F.split(F.substr(p, F.length(head) + 1), ""), head, sign)

    return F.array_join(F.transform(parts, part), "")


def hangul_latin(text: Column) -> Column:
    """Hangul in Latin letters: a final before a vowel is that syllable's initial, n or l with r are ll."""
    codes = F.transform(F.split(text, ""), lambda c: F.struct(c.alias("c"), F.when(F.ascii(c).between(FIRST, FIRST + 11171), F.ascii(c) - FIRST).alias("k")))

    def at(rows: Column, x: Column, i: Column) -> Column:
        initial, final = F.floor(x.k / 588), x.k % 28
        prev = F.coalesce(F.when(i > 0, F.get(rows, i - 1).k % 28), F.lit(0))
        after = F.coalesce(F.floor(F.get(rows, i + 1).k / 588), F.lit(-1))
        moved = lambda t: one_of([MOVED.get(k) for k in range(28)], t)
        head = F.when((initial == 11) & moved(prev).isNotNull(), moved(prev)).when((initial == 5) & prev.isin(4, 8), "l").otherwise(one_of(INITIALS, initial))
        tail = F.when((after == 11) & moved(final).isNotNull(), "").when((after == 5) & final.isin(4, 8), "l").otherwise(one_of(FINALS, final))
        return F.when(x.k.isNull(), x.c).otherwise(F.concat(head, one_of(VOWELS, F.floor(x.k / 28) % 21), tail))

    return F.get(F.transform(F.array(codes), lambda rows: F.array_join(F.transform(rows, lambda x, i: at(rows, x, i)), "")), 0)


def number_reading(n: Column) -> Column:
    """A whole number from 0 to below 10 ** 16 in kana; null beyond."""

    def group(g: Column) -> Column:
        place = lambda p, irregular, unit: one_of(["", *[irregular.get(d, ONES[d] + unit) for d in range(1, 10)]], F.floor(g / p) % 10)
        return F.concat(place(1000, THOUSANDS, "せん"), place(100, HUNDREDS, "ひゃく"), place(10, {1: "じゅう"}, "じゅう"), one_of(ONES, g % 10))

    groups = [(F.floor(n / 10 ** (4 * k)) % 10000, unit) for k, unit in reversed(list(enumerate(POWERS)))]
    read = F.concat(*[F.when(g > 0, F.concat(group(g), F.lit(unit))).otherwise("") for g, unit in groups])
    return F.when(n == 0, "ゼロ").when((n > 0) & (n < 10**16), read)


#: Letters that words of kana are made of in the queries.
LETTERS = KANA[:71]


def _kana(spark, d):
    k = F.col("p_partkey")
    pick = lambda x: F.substr(F.lit(LETTERS), (x % len(LETTERS) + 1).cast("int"), F.lit(1))
    word = F.concat(pick(k), one_of(["っ", "ん", "ー", ""], k % 4), pick(F.floor(k / 4)), one_of(["ゃ", "ゅ", "ょ", "", ""], k % 5), F.lit("ん"))
    return table(spark, d, "part").select("p_partkey", word.alias("word"))


def q_kana_latin(spark, d):
    return _kana(spark, d).select("p_partkey", "word", kana_latin(F.col("word")).alias("latin"))


def q_kana_hangul(spark, d):
    return _kana(spark, d).select("p_partkey", "word", kana_hangul(F.col("word")).alias("hangul"))


def q_hangul_latin(spark, d):
    k = F.col("p_partkey")
    word = F.concat(letter(k * 7919 % 11172 + FIRST), letter(k * 31 % 588 + 11 * 588 + FIRST), letter(k * 127 % 588 + 5 * 588 + FIRST), F.lit(" a"))
    return table(spark, d, "part").select("p_partkey", word.alias("word")).select("p_partkey", "word", hangul_latin(F.col("word")).alias("latin"))


def q_number_reading(spark, d):
    n = F.col("o_orderkey") * 13579 * (F.col("o_orderkey") % 1000)
    return table(spark, d, "orders").select("o_orderkey", number_reading(n).alias("reading"))


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _map(d: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in d.items()) + "}"


_WORDS = f"(SELECT p_partkey, substr('{LETTERS}', (p_partkey % {len(LETTERS)} + 1)::INT, 1) || {_list(['っ', 'ん', 'ー', ''])}[p_partkey % 4 + 1] || substr('{LETTERS}', (p_partkey // 4 % {len(LETTERS)} + 1)::INT, 1) || {_list(['ゃ', 'ゅ', 'ょ', '', ''])}[p_partkey % 5 + 1] || 'ん' AS word FROM part)"
_SYLLABLES = f"chr((p_partkey * 7919 % 11172 + {FIRST})::INT) || chr((p_partkey * 31 % 588 + {11 * 588 + FIRST})::INT) || chr((p_partkey * 127 % 588 + {5 * 588 + FIRST})::INT) || ' a'"
_PLACE = lambda p, irregular, unit: f"{_list(['', *[irregular.get(k, ONES[k] + unit) for k in range(1, 10)]])}[g // {p} % 10 + 1]"
_GROUP = f"{_PLACE(1000, THOUSANDS, 'せん')} || {_PLACE(100, HUNDREDS, 'ひゃく')} || {_PLACE(10, {1: 'じゅう'}, 'じゅう')} || {_list(ONES)}[g % 10 + 1]"
QUERIES = {
    "kana_latin": (
        q_kana_latin,
        f"WITH w AS {_WORDS}, m AS (SELECT p_partkey, word, regexp_extract_all(word, '[\\x{{3040}}-\\x{{30FF}}][{SMALL}]*') AS m FROM w), u AS (SELECT p_partkey, word, unnest(m) AS m, unnest(range(len(m))) AS i FROM m), b AS (SELECT *, CASE WHEN m NOT IN ('っ', 'ん', 'ー') THEN coalesce({_map(TO_LATIN)}[m], m) END AS b FROM u), n AS (SELECT *, coalesce(lead(b) OVER w, CASE WHEN lead(m) OVER w = 'ん' THEN 'n' END, '') AS a, coalesce(lag(b) OVER w, '') AS p FROM b WINDOW w AS (PARTITION BY p_partkey ORDER BY i)) SELECT p_partkey, word, string_agg(CASE WHEN b IS NOT NULL THEN b WHEN m = 'っ' THEN CASE WHEN a LIKE 'ch%' THEN 't' ELSE a[1] END WHEN m = 'ん' THEN CASE WHEN regexp_matches(a, '^[aeiouy]') THEN 'n''' ELSE 'n' END ELSE regexp_extract(p, '([aeiou])[^aeiou]*$', 1) END, '' ORDER BY i) AS latin FROM n GROUP BY 1, 2",
    ),
    "kana_hangul": (
        q_kana_hangul,
        f"WITH w AS {_WORDS}, m AS (SELECT p_partkey, word, list_transform(regexp_extract_all(word, '{'|'.join(PAIRS)}|.'), lambda m: coalesce({_map(TO_HANGUL)}[m], m)) AS l FROM w), s AS (SELECT p_partkey, word, unnest(regexp_extract_all(array_to_string(l, ''), '[^っんー][っんー]*')) AS s, unnest(range(5)) AS i FROM m), c AS (SELECT *, unicode(s) - {FIRST} AS k FROM s WHERE s IS NOT NULL) SELECT p_partkey, word, string_agg(CASE WHEN s LIKE '%っ' THEN chr((k + {FIRST} + 19)::INT) WHEN s LIKE '%ん' THEN chr((k + {FIRST} + 4)::INT) WHEN s LIKE '%ー' THEN s[1] || '{LONG}'[(k // 28 % 21)::INT + 1] ELSE s END, '' ORDER BY i) AS hangul FROM c GROUP BY 1, 2",
    ),
    "hangul_latin": (
        q_hangul_latin,
        f"WITH w AS (SELECT p_partkey, {_SYLLABLES} AS word FROM part), u AS (SELECT p_partkey, word, i, unicode(word[i]) - {FIRST} AS k FROM w, range(1, 4) r(i)), n AS (SELECT *, k // 588 AS a, k // 28 % 21 AS b, k % 28 AS c, coalesce(lag(k % 28) OVER w, 0) AS p, coalesce(lead(k // 588) OVER w, -1) AS q FROM u WINDOW w AS (PARTITION BY p_partkey ORDER BY i)), x AS (SELECT *, {_list([MOVED.get(k) for k in range(28)])} AS moved FROM n) SELECT p_partkey, word, string_agg(CASE WHEN a = 11 AND moved[p + 1] IS NOT NULL THEN moved[p + 1] WHEN a = 5 AND p IN (4, 8) THEN 'l' ELSE {_list(INITIALS)}[a + 1] END || {_list(VOWELS)}[b + 1] || CASE WHEN q = 11 AND moved[c + 1] IS NOT NULL THEN '' WHEN q = 5 AND c IN (4, 8) THEN 'l' ELSE {_list(FINALS)}[c + 1] END, '' ORDER BY i) || ' a' AS latin FROM x GROUP BY 1, 2",
    ),
    "number_reading": (
        q_number_reading,
        f"WITH n AS (SELECT o_orderkey, o_orderkey * 13579 * (o_orderkey % 1000) AS n FROM orders), g AS (SELECT o_orderkey, n, k, (n // (10 ** (4 * k))::BIGINT) % 10000 AS g FROM n, range(4) r(k)) SELECT o_orderkey, CASE WHEN n = 0 THEN 'ゼロ' ELSE string_agg(CASE WHEN g > 0 THEN {_GROUP} || {_list(POWERS)}[k + 1] ELSE '' END, '' ORDER BY k DESC) END AS reading FROM g GROUP BY o_orderkey, n",
    ),
}
