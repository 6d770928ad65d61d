"""Letters that an aligner's vocabulary lacks, by the nearest ones that it has.

All are expressions over one letter.  A null letter has no substitute, and neither has a string of several
letters or none; the first candidate in order wins, so there are no ties.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lineweave.functions.readings import FIRST, letter
from lineweave.operators.words import once
from lineweave.sources.tables import dealt, table

# Tense initials and the plain ones, vowels with a glide and those without, by their numbers
# among Hangul's 19 initials and 21 vowels.
PLAIN = {1: 0, 4: 3, 8: 7, 10: 9, 13: 12}
GLIDELESS = {2: 0, 3: 1, 6: 4, 7: 5, 12: 8, 17: 13}


def _softer(number: Column, table_: dict[int, int]) -> Column:
    out = number
    for a, b in table_.items():
        out = F.when(number == a, b).otherwise(out)
    return out


def substitutes(syllable: Column) -> Column:
    """Array of Hangul syllables near this one, nearest first: without its final; with a vowel without its
    glide; with a plain initial; with both.  Itself isn't among them; none for other letters."""

    def near(code: Column) -> Column:
        initial, vowel, final = F.floor(code / 588), F.floor(code / 28) % 21, code % 28
        forms = [(i, v, f) for i in (initial, _softer(initial, PLAIN)) for v in (vowel, _softer(vowel, GLIDELESS)) for f in (final, F.lit(0))]
        codes = F.array(*[(i * 588 + v * 28 + f).cast("long") for i, v, f in forms])
        return F.transform(F.array_distinct(F.filter(codes, lambda c: c != code)), lambda c: letter(c + FIRST))

    code = F.when((F.char_length(syllable) == 1) & F.ascii(syllable).between(FIRST, FIRST + 11171), F.ascii(syllable) - FIRST)
    return once(code.cast("long"), lambda c: F.when(c.isNotNull(), near(c)).otherwise(F.array().cast("array<string>")))


def in_vocabulary(symbol: Column, vocabulary: str) -> Column:
    """What stands for a letter in a vocabulary of single letters: itself, its lower case, or the first of its
    substitutes that is there; null for none."""
    known = lambda c: F.contains(F.lit(vocabulary), c)
    one = F.char_length(symbol) == 1
    found = F.get(F.filter(F.concat(F.array(symbol, F.lower(symbol)), substitutes(symbol)), lambda c: known(c) & (F.char_length(c) == 1)), 0)
    return F.when(one, found)


#: Queries: open syllables, and those that end in n or ng, of plain initials and vowels without a glide; small letters.
SMALL = "".join(chr(FIRST + i * 588 + v * 28 + f) for i in range(19) if i not in PLAIN for v in range(21) if v not in GLIDELESS and v != 15 for f in (0, 4, 21)) + "abcdefghijklmnopqrstuvwxyz"


def q_substitutes(spark, d):
    """Letters of brands, and a Hangul syllable for each letter of a part's name, all kinds by its key."""
    p = dealt(table(spark, d, "part"), "p_partkey")
    syllables = F.transform(F.split("p_name", ""), lambda c, i: letter((F.ascii(c) * 7919 + F.col("p_partkey") * 31 + i * 127) % 11172 + FIRST))
    t = p.select("p_partkey", F.posexplode(F.concat(F.split("p_brand", ""), syllables)).alias("k", "letter"))
    return t.select("p_partkey", "k", "letter", in_vocabulary(F.col("letter"), SMALL).alias("stands_for"))


def _case(x: str, d: dict[int, int]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {a} THEN {b}" for a, b in d.items()) + f" ELSE {x} END"


_I, _V, _F = "c // 588", "c // 28 % 21", "c % 28"
_FORMS = ", ".join(f"({i}) * 588 + ({v}) * 28 + {f}" for i in (_I, _case(_I, PLAIN)) for v in (_V, _case(_V, GLIDELESS)) for f in (_F, "0"))
QUERIES = {
    "vocabulary_substitutes": (
        q_substitutes,
        f"WITH p AS (SELECT p_partkey, list_concat(string_split(p_brand, ''), list_transform(string_split(p_name, ''), lambda c, i: chr(((unicode(c) * 7919 + p_partkey * 31 + (i - 1) * 127) % 11172 + {FIRST})::INT))) AS l FROM part), u AS (SELECT p_partkey, unnest(range(len(l)))::INT AS k, unnest(l) AS letter FROM p), c AS (SELECT *, CASE WHEN unicode(letter) BETWEEN {FIRST} AND {FIRST + 11171} THEN unicode(letter) - {FIRST} END AS c FROM u) SELECT p_partkey, k, letter, list_filter(list_concat([letter, lower(letter)], CASE WHEN c IS NULL THEN [] ELSE list_transform([{_FORMS}], lambda x: chr((x + {FIRST})::INT)) END), lambda x: strpos('{SMALL}', x) > 0)[1] AS stands_for FROM c",
    ),
}
