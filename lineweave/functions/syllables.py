"""English words in syllables: as many pieces of the spelling as a pronunciation has vowels, and the phones of
each.

Where a spelling shows no boundary for that many, it is cut evenly, so that the number always holds.  A null
or empty word has no pieces; a word without vowel letters or an unknown one without them is one piece; equal
words give equal pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.sources.payloads import parse_pronunciations
from lineweave.sources.tables import table

# Vowels of the phone alphabet, vowel letters that are two syllables, and pairs of consonant
# letters that are one sound, by the side of a boundary that they go to.
VOWELS = "AA AE AH AO AW AY EH ER EY IH IY OW OY UH UW".split()
APART = "ia io ua uo eo ie ii ao oi yi ui ae oe".split()
OPENING, CLOSING = "th sh ch wh ph qu".split(), "ng ck gh".split()


def beside(word: str, cut: int) -> int:
    """The cut, moved out of a pair of letters that is one sound."""
    pair = word[max(cut - 1, 0) : cut + 1]
    return cut + (pair in CLOSING) - (pair in OPENING)


def vowel_groups(word: str, want: int) -> list[tuple[int, int]]:
    """Runs of vowel letters; a silent e (at the end, also before s and d, then elsewhere) belongs to the run
    before while there are too many; runs that are two syllables are cut while there are too few."""
    runs = [m.span() for m in re.finditer("[aeiouy]+", word)]
    while len(runs) > max(want, 1) and word[runs[-1][0] :] in ("e", "es", "ed"):
        end = runs.pop()[1]
        runs[-1] = (runs[-1][0], end)
    k = 1
    while k < len(runs) and len(runs) > want:
        if word[slice(*runs[k])] == "e":
            runs[k - 1 : k + 1] = [(runs[k - 1][0], runs[k][1])]
        else:
            k += 1
    out: list[tuple[int, int]] = []
    for n, (a, b) in enumerate(runs):
        cut = next((x for x in range(a + 1, b) if word[x - 1 : x + 1] in APART), None)
        if cut and len(out) + len(runs) - n < want:
            out += [(a, cut), (cut, b)]
        else:
            out.append((a, b))
    return out


def spelled(word: str, want: int) -> list[str]:
    """The word in ``want`` pieces: one consonant between vowels opens the next, of more half close the one
    before."""
    low = word.lower()
    runs = vowel_groups(low, want)
    if runs and len(runs) == want:
        cuts = [min(max(beside(low, b + ((a - b) // 2 if a - b > 1 else 0)), b), a) for (_, b), (a, _) in zip(runs, runs[1:])]
    elif want <= 1 or len(word) <= want:
        return [word]
    else:
        cuts = []
        for k in range(1, want):
            at = beside(low, round(k * len(word) / want))
            cuts.append(min(max(at, (cuts or [0])[-1] + 1), len(word) - want + k))
    return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]


def unknown(word: str) -> list[str]:
    """A word without a pronunciation: a syllable for each run of vowel letters but a last e."""
    runs = re.findall("[aeiouy]+", word.lower())
    want = len(runs) - (len(runs) > 1 and word.lower().endswith("e") and runs[-1] == "e")
    return spelled(word, want) if want else [word]


def phones_of_syllables(phones: list[str], want: int) -> list[list[str]]:
    """Phones by syllable: a consonant right before a vowel opens its syllable, others stay with the one before."""
    out: list[list[str]] = [[] for _ in range(want)]
    at = -1
    for k, phone in enumerate(phones):
        vowel = phone in VOWELS
        opens = not vowel and k + 1 < len(phones) and phones[k + 1] in VOWELS
        if vowel and not (k and phones[k - 1] not in VOWELS) or opens:
            at = min(at + 1, want - 1)
        out[max(at, 0)].append(phone)
    return out


def syllables(words: DataFrame, entries: DataFrame) -> DataFrame:
    """word, entry (from 0; null without a pronunciation), k, piece, phones of the distinct words, for every entry
    of each in the list of pronunciations (word in small letters, entries: strings of phones)."""
    own = words.where("word <> ''").select("word").distinct().withColumn("low", F.lower(F.trim("word", F.lit("'"))))
    known = entries.select(F.col("word").alias("low"), F.posexplode("entries").alias("entry", "phones"))
    rows = own.join(known, "low", "left").select("word", "entry", "phones")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for word, entry, phones in zip(*(batch.column(c).to_pylist() for c in ("word", "entry", "phones"))):
                parts = (phones or "").split()
                want = sum(p in VOWELS for p in parts)
                pieces = spelled(word, want) if want else unknown(word)
                by = phones_of_syllables(parts, len(pieces)) if want else [[] for _ in pieces]
                out += [(word, entry, k, piece, " ".join(p)) for k, (piece, p) in enumerate(zip(pieces, by))]
            table_ = pd.DataFrame(out, columns=["word", "entry", "k", "piece", "phones"]).astype({"entry": "Int32", "k": "int32"})
            yield pa.RecordBatch.from_pandas(table_, preserve_index=False)

    return rows.mapInArrow(run, "word string, entry int, k int, piece string, phones string")


def _entries(spark, d) -> DataFrame:
    """A list of pronunciations of the words of parts: a phone for each letter; every third word has a second
    entry without its last vowel, every fifth has none."""
    words = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    vowel = F.create_map(*[F.lit(x) for kv in zip("aeiouy", ("AE1", "EH0", "IH1", "OW0", "UW1", "IY0")) for x in kv])
    phones = lambda w: F.array_join(F.transform(F.split(w, ""), lambda c: F.coalesce(F.try_element_at(vowel, c), F.upper(c))), " ")
    n: Column = F.crc32(F.col("w").cast("binary"))
    first = F.when(n % 5 != 0, F.concat(F.upper("w"), F.lit("  "), phones(F.col("w"))))
    second = F.when((n % 5 != 0) & (n % 3 == 0), F.concat(F.upper("w"), F.lit("(2)  "), phones(F.regexp_replace("w", "[aeiouy]([^aeiouy]*)$", "$1"))))
    return parse_pronunciations(words.select(F.explode(F.array(first, second)).alias("value")).where("value IS NOT NULL"))


def q_syllables(spark, d):
    return syllables(table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")), _entries(spark, d))


#: No SQL: the rules walk back and forth along a word; tests/core/test_syllables.py has them by hand and by search.
QUERIES = {"english_syllables": (q_syllables, None)}
