"""Benchmark decontamination: every training passage is a query to a BM25 index of the test items.

The index is inverted: of each term, the items with its impact and, for blocks of items, the largest
impact.  A passage is first bounded by the sum of its terms' largest impacts anywhere, then block by
block; blocks that can't reach the threshold of any of their items are passed over and the rest are
scored exactly (block-max WAND, for many passages at once).  An item is retrieved where it scores at
least ``share`` of what its own text scores; then shingles of five words decide: it has leaked if
``overlap`` of its shingles are in the passage, or that much of its question and of its answer.

Passages are windows of twice the longest item's words, each half over the one before, so that any
item lies in one whole.  Terms are runs of letters and digits without regard to the case of A-Z; the
answer of an item is its last sentence, if it has several.

Items are dealt to indexes of a bounded size by hash.  Document frequencies, the number of items, their
mean length and the longest one come from Spark over all items, so what is found doesn't depend on the
number of indexes.  Each index is built and sent out by itself, and every passage asks each.

Cases: null and empty texts have no passage and items without a term are never found.  Rows of
documents are judged one by one, also repeated ones; null doc_ids stay null.  Of items with equal
item_ids each counts.  Items shorter than five words are one shingle.  Of passages that overlap an item
equally the first counts.  Texts are asked whole, whatever their length.  An empty table of documents or
of items gives no leaks.  Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.llm import kernels as K
from lineweave.llm.common import Scratch, slices, utf8, written

#: Bytes of items in one index.  More items make more indexes, each asked by every passage.
INDEX_BYTES = 8 << 20
BLOCK = 8
K1, B = 1.2, 0.75


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence is the answer; a text of one sentence has none."""
    cut = [m.end() for m in re.finditer(r"[.!?\n]+\s*", text.rstrip().rstrip(".!?"))]
    return (text[: cut[-1]], text[cut[-1] :]) if cut else (text, "")


def shingles(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Distinct hashes of k consecutive terms; of fewer terms, one of all."""
    return np.unique(K.window_hash(h, min(k, len(h)))) if len(h) else np.zeros(0, np.uint64)


@dataclass(frozen=True)
class Options:
    share: float = 0.5
    overlap: float = 0.8
    shingle: int = 5


@dataclass(frozen=True)
class Totals:
    """Over all items: how many, their mean and largest number of terms, and in how many each of some
    terms (ascending hashes) is."""

    n: int
    mean: float
    longest: int
    terms: np.ndarray
    df: np.ndarray


class Index:
    """Impacts by term: post[start[t]:start[t + 1]] are (item, impact), blocks the same by block.
    totals: of all items, where these are some of them."""

    def __init__(self, items: list[tuple[int | None, str]], options: Options = Options(), totals: Totals | None = None):
        self.options = options
        self.item_ids = [i for i, _ in items]
        raw, off = utf8(pa.array([t or "" for _, t in items], pa.string()))
        h, first = K.terms(raw, off)
        n = len(items)
        size = np.diff(first)
        of = np.repeat(np.arange(n), size)
        self.terms = np.unique(h)
        code = np.searchsorted(self.terms, h)
        pair, tf = np.unique(code * max(1, n) + of, return_counts=True)
        term, self.item = pair // max(1, n), pair % max(1, n)
        here = np.bincount(term, minlength=len(self.terms))
        if totals is None:
            totals = Totals(n, size.mean() if n else 1, int(size.max(initial=1)), self.terms, here)
        self.window = 2 * max(1, totals.longest)
        df = totals.df[np.searchsorted(totals.terms, self.terms)]
        idf = np.log1p((totals.n - df + 0.5) / (df + 0.5))
        self.impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[self.item] / max(1e-9, totals.mean)))
        self.start = np.concatenate(([0], np.cumsum(here)))
        own = np.bincount(self.item, self.impact, n) if n else np.zeros(0)
        self.threshold = np.where(size > 0, options.share * own, np.inf)
        # largest impacts by block of items and overall
        self.n_blocks = -(-n // BLOCK)
        key = term * max(1, self.n_blocks) + self.item // BLOCK
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        self.block = (key[at] % max(1, self.n_blocks)) if len(key) else at
        self.block_impact = np.maximum.reduceat(self.impact, at) if len(key) else np.zeros(0)
        self.block_start = np.searchsorted(key[at] // max(1, self.n_blocks), np.arange(len(self.terms) + 1)) if len(key) else np.zeros(1, np.int64)
        self.block_threshold = np.array([self.threshold[b * BLOCK : (b + 1) * BLOCK].min() for b in range(self.n_blocks)])
        self.top = np.maximum.reduceat(self.impact, self.start[:-1]) if len(self.terms) else np.zeros(0)
        self.lowest = float(self.threshold.min(initial=np.inf))
        k = options.shingle
        parts = [question_and_answer(t or "") for _, t in items]
        self.parts = []  # of each item: (shingles, words in one) of the whole, the question and the answer
        for i in range(n):
            each = [h[first[i] : first[i + 1]], *(K.terms(*utf8(pa.array([x], pa.string())))[0] for x in parts[i])]
            self.parts.append([(shingles(x, k), min(k, len(x))) for x in each])
        # terms by their low bits, with probing
        self.mask = (1 << max(10, int(len(self.terms) * 8).bit_length())) - 1
        self.slot = np.full(self.mask + 1, -1, np.int64)
        self.probes = 1
        for t, x in enumerate((self.terms & np.uint64(self.mask)).astype(np.int64).tolist()):
            p = 1
            while self.slot[x] >= 0:
                x, p = (x + 1) & self.mask, p + 1
            self.slot[x] = t
            self.probes = max(self.probes, p)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each term, -1 if no item has it."""
        out = np.full(len(h), -1, np.int64)
        if not len(self.terms):
            return out
        at = (h & np.uint64(self.mask)).astype(np.int64)
        todo = np.arange(len(h))
        for _ in range(self.probes):
            t = self.slot[at]
            hit = (t >= 0) & (self.terms[np.maximum(t, 0)] == h[todo])
            out[todo[hit]] = t[hit]
            more = (t >= 0) & ~hit
            todo, at = todo[more], (at[more] + 1) & self.mask
            if not len(todo):
                break
        return out

    def retrieve(self, code: np.ndarray, passage: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) of all pairs at or above the item's threshold; (passage, code) are
        the distinct terms of n passages, in order of passage."""
        bound = np.bincount(passage, self.top[code], n)
        on = bound[passage] >= self.lowest * (1 - 1e-9)
        code, passage = code[on], passage[on]
        p, b, x = self._postings(code, passage, self.block_start, self.block, self.block_impact)
        key, at = np.unique(p * self.n_blocks + b, return_inverse=True)
        live = np.bincount(at, x, len(key)) >= self.block_threshold[key % self.n_blocks] * (1 - 1e-9) if len(key) else np.zeros(0, bool)
        key = key[live]
        if not len(key):
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        on = np.isin(passage, key // self.n_blocks)
        p, i, x = self._postings(code[on], passage[on], self.start, self.item, self.impact)
        n_items = len(self.item_ids)
        on = np.isin(p * self.n_blocks + i // BLOCK, key)
        pair, at = np.unique(p[on] * n_items + i[on], return_inverse=True)
        score = np.bincount(at, x[on], len(pair))
        good = score >= self.threshold[pair % n_items] * (1 - 1e-9)
        return pair[good] // n_items, pair[good] % n_items, score[good]

    @staticmethod
    def _postings(code, passage, start, value, weight):
        size = start[code + 1] - start[code]
        at = np.repeat(start[code] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return np.repeat(passage, size), value[at], weight[at]

    def leaks(self, raw: np.ndarray, off: np.ndarray) -> list[tuple[int, int, float, float, float, float]]:
        """(text, item, score, overlap, question overlap, answer overlap) of the leaks in a batch: for
        each text and item, of the passage with the largest overlap, the first if there are several."""
        h, first = K.terms(raw, off)
        code = self.find(h)
        half = self.window // 2
        size = np.diff(first)
        many = np.maximum(1, -(-size // half) - 1) * (size > 0)
        text = np.repeat(np.arange(len(size)), many)
        at = first[text] + half * (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many))
        end = np.minimum(at + self.window, first[text + 1])
        # each word is in the passage that begins with its half and in the one before
        known = np.flatnonzero(code >= 0)
        doc = np.searchsorted(first, known, side="right") - 1
        base = np.cumsum(many) - many
        low = base[doc] + np.maximum(0, (known - first[doc]) // half - 1)
        high = np.minimum(base[doc] + (known - first[doc]) // half, base[doc] + many[doc] - 1)
        n_terms = max(1, len(self.terms))
        two = high > low
        key = np.unique(np.concatenate((low, high[two])) * n_terms + np.concatenate((code[known], code[known][two])))
        found: dict[tuple[int, int], tuple] = {}
        o = self.options
        for p, i, score in zip(*self.retrieve(key % n_terms, key // n_terms, len(text))):
            own = h[at[p] : end[p]]
            share = [float(np.isin(x, K.window_hash(own, k)).mean()) if len(x) else 1.0 for x, k in self.parts[i]]
            if share[0] >= o.overlap or (share[1] >= o.overlap and share[2] >= o.overlap):
                old = found.get((text[p], i))
                if old is None or share[0] > old[1]:
                    found[text[p], i] = (float(score), *share)
        return [(int(t), int(i), *found[t, i]) for t, i in sorted(found)]


def item_terms(items: DataFrame) -> DataFrame:
    """part, term (a hash; null: the row is about the part as a whole), n (items with it), words (of all
    items), longest: sums over the items of a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch, "text"):
                part = batch.slice(a, b - a)
                h, first = K.terms(*utf8(part.column("text")))
                of = part.column("part").to_numpy()
                text = np.repeat(np.arange(len(part)), np.diff(first))
                order = np.lexsort((h, text))
                fresh = order[np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])))] if len(h) else order
                zero = np.zeros(len(fresh), np.int64)
                yield pa.RecordBatch.from_pydict({
                    "part": np.concatenate((of[text[fresh]], of)), "term": pa.array(np.concatenate((h[fresh].view(np.int64), np.zeros(len(part), np.int64))), mask=np.arange(len(fresh) + len(part)) >= len(fresh)),
                    "n": np.ones(len(fresh) + len(part), np.int64), "words": np.concatenate((zero, np.diff(first))), "longest": np.concatenate((zero, np.diff(first))),
                })

    each = items.select("part", "text").mapInArrow(run, "part long, term long, n long, words long, longest long")
    return each.groupBy("part", "term").agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.max("longest").alias("longest"))


def indexes(items: DataFrame, options: Options = Options(), index_bytes: int = INDEX_BYTES) -> list[Broadcast]:
    """Broadcast indexes of (item_id, text) rows, each of about index_bytes of text, which bounds what
    the driver and a task hold at once."""
    spark = items.sparkSession
    rows = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-total // index_bytes))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
    counted = written(item_terms(rows), "item_terms")
    n, words, longest = counted.where("term IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.max("longest"), F.lit(1))).first()
    of_all = counted.where("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("df"))
    found = []
    for i in range(shards):
        own = counted.where((F.col("part") == i) & F.col("term").isNotNull()).select("term")
        df = of_all.join(own, "term").toArrow()  # terms of one index
        h = df.column("term").to_numpy().view(np.uint64)
        order = np.argsort(h)
        totals = Totals(n, words / n if n else 1.0, max(1, longest), h[order], df.column("df").to_numpy()[order])
        found.append(spark.sparkContext.broadcast(Index(sorted((tuple(r) for r in rows.where(F.col("part") == i).select("item_id", "text").collect()), key=str), options, totals)))
    return found


def find_leaks(docs: DataFrame, found_in: list[Broadcast]) -> DataFrame:
    """A row for each document and test item that has leaked into it: doc_id, item_id, score, overlap,
    question_overlap, answer_overlap."""

    def asked(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b in slices(batch, "text"):
                    part = batch.slice(a, b - a)
                    rows = [(shared.value.item_ids[i], t, *x) for t, i, *x in shared.value.leaks(*utf8(part.column("text")))]
                    if rows:
                        item, text, *x = zip(*rows)
                        yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(text)), pa.array(item, pa.int64()), *(pa.array(v, pa.float64()) for v in x)], names=["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"])

        return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double")

    return reduce(DataFrame.unionByName, map(asked, found_in))


def drop_contaminated(docs: DataFrame, found_in: list[Broadcast]) -> DataFrame:
    """The documents, with all their columns, into which no test item has leaked.  What one index
    leaves is written before the next is asked, so that a task holds one."""

    def left(docs: DataFrame, shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b in slices(batch, "text"):
                    part = batch.slice(a, b - a)
                    bad = {t for t, *_ in shared.value.leaks(*utf8(part.column("text")))}
                    yield part.filter(pa.array([i not in bad for i in range(len(part))]))

        return docs.mapInArrow(run, docs.schema)

    scratch = Scratch(docs.sparkSession) if len(found_in) > 1 else None
    for i, shared in enumerate(found_in[:-1]):
        docs = scratch.write(left(docs, shared), f"left_{i}")
        scratch.keep(f"left_{i}")
    return left(docs, found_in[-1])


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found_in = indexes(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), found_in)
