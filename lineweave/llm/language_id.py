"""Language identification by rank-order profiles.

A profile is the list of the most frequent character n-grams (1 to 3 letters, words padded with one
boundary sign) in falling order.  A document's own list is held against each language's: an n-gram
that stands k places away costs k, one that the language lacks costs the length of a profile; the
language with the least sum wins (of equal ones, the first by name).

Cases: a null text or one without a letter is ``und`` with score 0.  With no language learned,
every document is ``und``.  Rows are never merged; a null doc_id stays null, isn't held out and
isn't learned from.  An empty table gives no rows.  Extra columns are ignored.  Texts count whole,
whatever their length; n-grams of equal count stand in order of their letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineweave.llm.common import slices

#: Letters of planes 0 to 3 end below this code point.
CODES = 0x33480
BITS = 21
#: Languages that can be learned at once.
LANGUAGES = 2000
U64 = np.uint64


@dataclass(frozen=True)
class Profiles:
    """languages ascending; grams ascending, and rank[i, j]: the place of gram i in language j (size:
    it isn't in it), with a last row for unknown grams."""

    languages: tuple[str, ...]
    grams: np.ndarray
    rank: np.ndarray
    size: int


@cache
def letters() -> np.ndarray:
    """Code point to its lower-case letter, 0 for what is no letter."""
    out = np.zeros(CODES, np.uint32)
    for code in range(CODES):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            out[code] = ord(low) if len(low) == 1 and ord(low) < CODES else code
    return out


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, n-gram) pairs in order, as arrays: text, n-gram (up to three code points of
    21 bits, the first highest; 1 stands for a boundary), and how often it occurs."""
    # a sign before and after each text, so that its first and last words have a boundary
    codes = np.frombuffer("".join(f"\0{t}\0" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    low = letters()[np.minimum(codes, CODES - 1)]
    is_letter = low > 0
    before = np.concatenate(([False], is_letter[:-1]))
    after = np.concatenate((is_letter[1:], [False]))
    # a boundary between words: of several signs between them, the one after a word closes it and the one before a word opens it
    kept = is_letter | before | after
    low, text = low[kept], text[kept]
    low[low == 0] = 1
    alphabet, dense = np.unique(low, return_inverse=True)
    bits = max(1, int(len(alphabet)).bit_length())
    if 3 * bits + int(len(texts)).bit_length() > 64:
        raise ValueError("too many texts in a slice")
    dense = dense.astype(U64) + U64(1)
    of = text.astype(U64) << U64(3 * bits)
    real = low > 1
    one = dense << U64(2 * bits)
    pair = one[:-1] | dense[1:] << U64(bits)
    same = (text[:-1] == text[1:]) & (real[:-1] | real[1:])
    three = pair[:-1] | dense[2:]
    inside = (text[:-2] == text[2:]) & real[1:-1]
    keys = np.concatenate(((of | one)[real], (of[:-1] | pair)[same], (of[:-2] | three)[inside]))
    keys.sort()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    mask = U64((1 << bits) - 1)
    code = np.concatenate(([0], alphabet)).astype(U64)
    gram = code[keys >> U64(2 * bits) & mask] << U64(2 * BITS) | code[keys >> U64(bits) & mask] << U64(BITS) | code[keys & mask]
    return (keys >> U64(3 * bits)).astype(np.int64), gram, count


def ranked(text: np.ndarray, count: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text's n-grams, the size most frequent (of equal ones, the first): index and place."""
    top = int(count.max(initial=0))
    order = np.argsort(text * (top + 1) + (top - count), kind="stable")
    t = text[order]
    start = np.searchsorted(t, t, side="left")
    place = np.arange(len(t)) - start
    keep = place < size
    return order[keep], place[keep]


def predict(texts: list[str], profiles: Profiles) -> tuple[np.ndarray, np.ndarray]:
    """For each text the number of its language (-1: none), and its score: 1 less the share of the
    largest possible distance."""
    text, gram, count = grams(texts)
    best, score = np.full(len(texts), -1, np.int64), np.zeros(len(texts))
    if not len(profiles.languages) or not len(text):
        return best, score
    at, place = ranked(text, count, profiles.size)
    text, gram = text[at], gram[at]
    found = np.minimum(np.searchsorted(profiles.grams, gram), len(profiles.grams) - 1)
    found = np.where(profiles.grams[found] == gram, found, len(profiles.grams))
    rank = profiles.rank[found]
    cost = np.where(rank == profiles.size, profiles.size, np.abs(rank - place[:, None]))
    used = np.bincount(text, minlength=len(texts))
    total = np.stack([np.bincount(text, cost[:, j], len(texts)) for j in range(len(profiles.languages))], axis=1)
    some = used > 0
    best[some] = total[some].argmin(axis=1)
    score[some] = 1 - total[some].min(axis=1) / (used[some] * profiles.size)
    return best, score


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for a, b in slices(batch, "text", 1 << 20):
        for at in range(a, b, 4096):
            yield batch.slice(at, min(4096, b - at))


def learn(labelled: DataFrame, size: int = 400, documents: int = 4000) -> Profiles:
    """Profiles of ``size`` n-grams from (doc_id, text, lang) rows with a lang.  Of a language with
    more rows than ``documents``, about that many are read, chosen by a hash of doc_id."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    share = rows.groupBy("lang").agg(F.least(F.lit(1.0), documents / F.count(F.lit(1))).alias("share")).limit(LANGUAGES + 1).collect()
    if len(share) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages: each is a column of the table that every task holds")
    share = labelled.sparkSession.createDataFrame(share, "lang string, share double")
    chosen = rows.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("lang", "text")  # LANGUAGES rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                names, of = np.unique(np.array(part.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
                text, gram, count = grams([t or "" for t in part.column("text").to_pylist()])
                order = np.lexsort((gram, of[text]))
                lang, gram, count = of[text][order], gram[order], count[order]
                if not len(lang):
                    continue
                first = np.flatnonzero(np.concatenate(([True], (lang[1:] != lang[:-1]) | (gram[1:] != gram[:-1]))))
                yield pa.RecordBatch.from_pydict({"lang": pa.array(names[lang[first]]), "gram": pa.array(gram[first].astype(np.int64)), "n": pa.array(np.add.reduceat(count, first))})

    total = chosen.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = total.withColumn("place", place - 1).where(F.col("place") < size).collect()  # size rows for each language
    languages = tuple(sorted({r.lang for r in top}))
    known = np.array(sorted({r.gram for r in top}), U64)
    rank = np.full((len(known) + 1, len(languages)), size, np.int64)
    for r in top:
        rank[np.searchsorted(known, U64(r.gram)), languages.index(r.lang)] = r.place
    return Profiles(languages, known, rank, size)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*profiles.languages, "und"], dtype=object)
        for batch in batches:
            for part in _slices(batch):
                best, score = predict([t or "" for t in part.column("text").to_pylist()], profiles)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id="doc_id"):
    """Whether crc32 of doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = learn(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return identify(docs, profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
