"""Quality rules as a ledger of failure bits.

``ledger`` evaluates every rule once over each whole text and keeps the measurements and one bit
for each rule that failed.  A policy is a versioned choice of rules: ``apply_policy`` is a bitwise
AND on stored bits, and ``ablate`` tells from the same bits what each rule alone decides, without
reading a text again.

Abuse in languages without a list is learned: ``learn_stems`` counts, over a bounded sample of the
documents that people have labelled, how words begin in toxic and in clean ones, and gives ``ledger``
a bounded list.

Cases: a null text has no words, so its measurements are 0 and it fails ``few_words``.  Rows are
never merged: repeated doc_ids give a row each.  Null doc_ids stay null.  Extra columns of the
input are ignored; the ledger has the columns of LEDGER only.  A text is measured whole, whatever its
length.  An empty table gives no rows, and without labels no stems are learned.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.llm import kernels as K
from lineweave.llm.common import slices, utf8

#: Insults; a text with two of them and over one in a thousand words is abuse.  A parameter of ``ledger``.
FLAGGED_WORDS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")

#: Words as of ``kernels.terms``, in lower-case bytes, and how many bytes a stem has.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
STEM_BYTES = range(4, 17)
#: Labelled documents of each class, toxic and clean, that stems are learned from.
LABELLED = 10_000

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_flagged", "n_stems")
LEDGER = ("doc_id", *MEASURES, "fail_bits")


@dataclass(frozen=True)
class Rule:
    """fails: a test on the measurements, over doubles; NULL never occurs."""

    name: str
    fails: Column


def default_rules() -> tuple[Rule, ...]:
    """The rules, bit 0 first.  New rules are added at the end: stored bits keep their meaning."""
    c = {m: F.col(m) for m in MEASURES}
    return (
        Rule("few_words", c["n_words"] < 50),
        Rule("repeated_windows", 100 * c["n_repeat_words"] > 50 * c["n_words"]),
        Rule("symbols", 10 * c["n_symbols"] > 3 * c["n_words"]),
        Rule("repeated_lines", 2 * c["n_dup_lines"] > c["n_lines"]),
        Rule("short_words", c["word_chars"] < 2 * c["n_words"]),
        Rule("long_words", c["word_chars"] > 15 * c["n_words"]),
        Rule("shouting", 2 * c["n_upper"] > c["word_chars"]),
        Rule("abuse", (c["n_flagged"] >= 2) & (1000 * c["n_flagged"] > c["n_words"])),
        Rule("learned_abuse", (c["n_stems"] >= 2) & (100 * c["n_stems"] >= c["n_words"])),
    )


@dataclass(frozen=True)
class Policy:
    """A document is kept if none of the named rules failed."""

    version: str
    rules: tuple[str, ...]

    def bits(self, rules: tuple[Rule, ...]) -> int:
        names = [r.name for r in rules]
        return sum(1 << names.index(r) for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
V1 = Policy("v1", (*BASE.rules, "symbols", "repeated_lines", "short_words", "long_words"))
V2 = Policy("v2", (*V1.rules, "shouting", "abuse"))
POLICIES = (BASE, V1, V2, Policy("v3", (*V2.rules, "learned_abuse")))
CURRENT = POLICIES[-1]


def stem_hits(raw: np.ndarray, off: np.ndarray, stems: tuple[bytes, ...]) -> np.ndarray:
    """How many words of each text begin with one of the stems, none of which begins with another."""
    if not stems:
        return np.zeros(len(off) - 1, np.int64)
    low = K.LOWER[raw]
    a, b, first = K.runs(K.IS_TERM[low], off)
    hit = np.zeros(len(a), bool)
    near = np.flatnonzero(b - a >= STEM_BYTES[0])
    lead = sum(low[a[near] + j].astype(np.uint32) << np.uint32(8 * j) for j in range(4))
    near = near[np.isin(lead, np.array([int.from_bytes(s[:4], "little") for s in stems], np.uint32))]
    for n in {len(s) for s in stems}:
        at = near[b[near] - a[near] >= n]
        hit[at] |= np.isin(K.segment_hash(low, a[at], a[at] + n), flagged_hashes(tuple(s for s in stems if len(s) == n)))
    return K.counts(first, hit)


def measure(raw: np.ndarray, off: np.ndarray, flagged: np.ndarray, stems: tuple[bytes, ...] = ()) -> dict[str, np.ndarray]:
    """The measurements of each text of a batch.  Windows and lines are compared by 64-bit hashes
    within one slice; flagged: hashes of the flagged words; stems: as of ``learn_stems``."""
    a, b, first = K.words(raw, off)
    n_words = np.diff(first)
    out = {"n_words": n_words}
    space = K.IS_SPACE[raw]
    out["word_chars"] = K.counts(off, ((raw & 0xC0) != 0x80) & ~space)
    symbol = np.zeros(256, bool)
    symbol[list(b"#*$%&|<>")] = True
    out["n_symbols"] = K.counts(off, symbol[raw])
    out["n_upper"] = K.counts(off, (raw >= 0x41) & (raw <= 0x5A))

    h = K.segment_hash(raw, a, b)
    inside, text = K.windows_in_texts(first, 3)
    key = K.window_hash(h, 3) ^ K.mix(text.astype(K.U64) + K.U64(1))
    at = np.flatnonzero(inside)
    order = at[np.argsort(key[at])]
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(len(h) + 2, bool)
    for j in range(3):
        covered[order[twice] + j] = True
    out["n_repeat_words"] = K.counts(first, covered[: len(h)])

    # punctuation around a word doesn't matter for the list of flagged words
    term, at = K.terms(raw, off)
    out["n_flagged"] = K.counts(at, np.isin(term, flagged))
    out["n_stems"] = stem_hits(raw, off, stems)

    starts = np.zeros(len(raw) + 1, bool)
    starts[off[:-1]] = True
    starts[np.flatnonzero(raw == 0x0A) + 1] = True
    la = np.flatnonzero(starts[: len(raw)])
    lb = np.append(la[1:], len(raw))[: len(la)]
    lb = lb - ((lb > la) & (raw[np.maximum(lb, 1) - 1] == 0x0A))  # the line without its \n
    of = np.searchsorted(off, la, side="right") - 1
    total = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(~space, out=total[1:])
    real = total[lb] > total[la]
    la, lb, of = la[real], lb[real], of[real]
    h = K.segment_hash(raw, la, lb)
    order = np.lexsort((h, of))
    hs, os_ = h[order], of[order]
    again = np.zeros(len(order), bool)
    again[1:] = (hs[1:] == hs[:-1]) & (os_[1:] == os_[:-1])
    out["n_lines"] = np.bincount(of, minlength=len(off) - 1)
    out["n_dup_lines"] = np.bincount(os_[again], minlength=len(off) - 1)
    return out


def ledger(docs: DataFrame, rules: tuple[Rule, ...] | None = None, flagged_words: tuple[str, ...] = FLAGGED_WORDS, stems: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the measurements (long), and fail_bits (long): bit i is set where rule i failed."""
    return measured(docs.select("doc_id", "text"), flagged_words, stems).select("doc_id", *MEASURES, fail_bits(default_rules() if rules is None else rules).alias("fail_bits"))


def measured(docs: DataFrame, flagged_words: tuple[str, ...], stems: tuple[str, ...]) -> DataFrame:
    """The rows of docs with their measurements, made where they lie, without an exchange."""
    flagged, begins, names = tuple(w.encode() for w in flagged_words), tuple(s.encode() for s in stems), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = flagged_hashes(flagged)
        for batch in batches:
            for a, b in slices(batch, "text"):
                part = batch.slice(a, b - a)
                found = measure(*utf8(part.column("text")), known, begins)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(found[m].astype(np.int64)) for m in MEASURES)], names=[*names, *MEASURES])

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + "".join(f", {m} long" for m in MEASURES)
    return docs.mapInArrow(run, schema)


def flagged_hashes(words: tuple[bytes, ...]) -> np.ndarray:
    return np.array([K.segment_hash(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0] for w in words], np.uint64)


def fail_bits(rules: tuple[Rule, ...]) -> Column:
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(rule.fails, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return bits


def failed(policy: Policy, rules: tuple[Rule, ...] | None = None) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy.bits(default_rules() if rules is None else rules)).cast("long")) != 0


def apply_policy(book: DataFrame, policy: Policy = CURRENT, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """The ledger with base_failed and kept."""
    return book.withColumns({"base_failed": failed(BASE, rules), "kept": ~failed(BASE, rules) & ~failed(policy, rules)})


def ablate(book: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """For each policy and rule in it: how many documents the rule fails, how many only it fails,
    and how many the policy would keep without it.  One aggregation by distinct bit pattern (at most
    2 ** rules rows), then bit operations on the counts."""
    rules = default_rules() if rules is None else rules
    names = [r.name for r in rules]
    choice = [(p.version, r, p.bits(rules), 1 << names.index(r)) for p in policies for r in p.rules]
    table = book.sparkSession.createDataFrame(choice, "policy string, rule string, policy_bits long, rule_bit long")
    patterns = book.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    inside = F.col("fail_bits").bitwiseAND(F.col("policy_bits"))
    return (
        patterns.crossJoin(F.broadcast(table))  # at most 2 ** rules patterns by a few rules: neither grows with the input
        .groupBy("policy", "rule")
        .agg(
            F.sum(F.when(F.col("fail_bits").bitwiseAND(F.col("rule_bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(inside == F.col("rule_bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
            F.sum(F.when(inside.bitwiseAND(F.bitwise_not(F.col("rule_bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
    )


def with_label(docs: DataFrame, labels: DataFrame, documents: int = LABELLED) -> DataFrame:
    """lang, text and toxic of the documents that labels (doc_id, toxic) names: of each class all, or
    about ``documents``, chosen by a hash of doc_id.  So few ids meet the texts where they lie."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = {r.toxic: min(1.0, documents / r.n) for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect() if r.toxic in (0, 1)}  # two rows
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << 30))
    chosen = marks.where(F.coalesce(*(F.when(F.col("toxic") == t, place < int(x * (1 << 30))) for t, x in share.items()), F.lit(False)))
    return docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id").select("lang", "text", "toxic")  # about 2 * documents ids


def begins_of(word: bytes) -> list[bytes]:
    """What a word begins with: whole characters, of STEM_BYTES bytes."""
    return [word[:n] for n in STEM_BYTES if n <= len(word) and not (n < len(word) and 0x80 <= word[n] < 0xC0)]


def count_stems(texts: DataFrame, wanted: dict[str, set[bytes]] | None = None, limit: int = 200_000) -> DataFrame:
    """lang, stem, docs (texts with it; only where nothing is wanted) and n (words that begin so), over
    all texts; the empty stem counts texts and words.  wanted: the only stems of each language to count."""
    schema = "lang string, stem string, docs long, n long"

    def rows(lang: list, stem: list, docs: list, n: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array([s.decode() for s in stem], pa.string()), pa.array(docs, pa.int64()), pa.array(n, pa.int64())], names=["lang", "stem", "docs", "n"])

    def flush(count: dict[str, tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for lang, (docs, n) in count.items():
            if wanted is not None:  # n has whole words
                known, words, n = wanted.get(lang, set()), n, Counter({b"": n.pop(b"", 0)})
                for w, c in words.items():
                    for s in begins_of(w):
                        if s in known:
                            n[s] += c
            if n:
                yield rows([lang] * len(n), list(n), [docs[s] for s in n], list(n.values()))
        count.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[str, tuple[Counter, Counter]] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                docs, n = count.setdefault(lang or "", (Counter(), Counter()))
                words = TERM.findall((text or "").encode().lower())
                docs[b""] += 1
                n[b""] += len(words)
                if wanted is None:
                    here: Counter = Counter()
                    for w, c in Counter(words).items():
                        for s in begins_of(w):
                            here[s] += c
                    docs.update(here.keys())
                    n.update(here)
                else:
                    n.update(words)
                if sum(len(x[1]) for x in count.values()) > limit:
                    yield from flush(count)
        yield from flush(count)

    return texts.select("lang", "text").mapInArrow(run, schema).groupBy("lang", "stem").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def learn_stems(docs: DataFrame, labels: DataFrame, share: float = 0.2, odds: int = 10, least: int = 5, documents: int = LABELLED) -> tuple[str, ...]:
    """Stems that mark toxic texts of a language: this share of its labelled toxic texts, and least of
    them, have a word that begins so, and such words are over odds times as frequent as in its labelled
    clean texts.  Of each class at most about ``documents`` labelled rows count, chosen by hash.  As each
    text has few stems, so has a language: at most a text's number of stems by 1 / share."""
    labelled = with_label(docs, labels, documents)
    texts = labelled.where("toxic = 1")
    whole = texts.groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(F.count(F.lit(1)).alias("all_docs"))
    common = count_stems(texts).join(whole, "lang").where((F.col("docs") >= least) & (F.col("docs") >= share * F.col("all_docs")))
    toxic = {(r.lang, r.stem.encode()): (r.docs, r.n) for r in common.collect()}
    wanted: dict[str, set[bytes]] = {}
    for lang, s in toxic:
        if s:
            wanted.setdefault(lang, set()).add(s)
    if not wanted:
        return ()
    clean = {(r.lang, r.stem.encode()): r.n for r in count_stems(labelled.where("toxic = 0"), wanted).collect()}
    out: set[bytes] = set()
    for lang, some in wanted.items():
        ok = {s for s in some if toxic[lang, s][1] * clean.get((lang, b""), 0) > odds * toxic[lang, b""][1] * max(1, clean.get((lang, s), 0))}
        # the longest that says the same: 'pathetic', not 'path'
        longer = Counter()
        for s in ok:
            for p in begins_of(s)[:-1]:
                longer[p] = max(longer[p], toxic[lang, s][1])
        out |= {s for s in ok if 10 * longer[s] < 9 * toxic[lang, s][1]}
    return tuple(sorted(s.decode() for s in out if not any(p in out for p in begins_of(s)[:-1])))


def keep_documents(docs: DataFrame, policy: Policy = CURRENT, stems: tuple[str, ...] = (), flagged_words: tuple[str, ...] = FLAGGED_WORDS) -> DataFrame:
    """The documents, with all their columns, that the policy and the base rules keep."""
    names = [n if n == "text" else f"of_caller_{i}" for i, n in enumerate(docs.columns)]
    book = measured(docs.toDF(*names), flagged_words, stems).withColumn("fail_bits", fail_bits(default_rules()))
    return apply_policy(book, policy).where("kept").select(*names).toDF(*docs.columns)


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    book = ledger(docs, stems=learn_stems(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return apply_policy(book).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_upper", "n_flagged", "fail_bits", "n_stems")
