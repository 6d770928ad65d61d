import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lineweave.llm import level_packing as P

BYTE = public_tokenizers.path("byte_bpe_50k.json")
CLASH = "doc_id long, text string, IDS string, Start string, sequence_id string"


def paid(fill, size):
    """Padding of a window."""
    return 0 if fill & (fill - 1) == 0 else size - fill


def squares(fills, size):
    return sum(n * n for f, n in fills.items() if f != size and f & (f - 1))


def naive(lengths, size):
    """Each remainder by trying every level and adding up all squares."""
    fills, out = defaultdict(int), []
    for n in lengths:
        best = None
        for level in [0, *(f for f, k in fills.items() if k and f < size)]:
            if level + n <= size:
                after = defaultdict(int, fills)
                if level:
                    after[level] -= 1
                after[level + n] += 1
                cost = (squares(after, size), -level)
                if best is None or cost < best[0]:
                    best = (cost, level, after)
        fills = best[2]
        out.append(best[1])
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 31), max_size=60))
def test_each_goes_where_the_squares_grow_least(lengths):
    levels = P.Levels(32)
    assert [levels.place(n)[1] for n in lengths] == naive(lengths, 32)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 31), max_size=60))
def test_windows_hold_all_without_padding(lengths):
    seen, fills = defaultdict(list), defaultdict(list)
    for i, start, n, window, offset in P.level_pack(lengths, 32):
        assert n > 0
        seen[i].append((start, n))
        fills[window].append((offset, n))
    for i, n in enumerate(lengths):
        at = 0
        for start, k in sorted(seen[i]):
            assert start == at
            at += k
        assert at == n
    for parts in fills.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 32 and paid(at, 32) == 0


def test_few_are_cut():
    lengths = np.random.default_rng(3).integers(1, 1024, 20_000).tolist()
    found = P.level_pack(lengths, 1024)
    assert len(found) < 1.12 * len(lengths)
    windows = {w for *_, w, _ in found}
    assert len(windows) < 1.03 * sum(lengths) / 1024 + 11


def check(rows, texts, size):
    own, fills = defaultdict(list), defaultdict(list)
    for r in rows:
        own[r.doc_id].append(r)
        fills[r.sequence_id].append((r.offset, r.length))
    tokenizer, want, got = Tokenizer.from_file(BYTE), defaultdict(list), defaultdict(list)
    for doc_id, text in texts:
        want[doc_id].append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0])
    assert set(own) == set(want)
    for doc_id, all_ids in want.items():
        assert sum(len(x) for x in all_ids) == sum(r.length for r in own[doc_id])
        slices = {(len(x), a, b, zlib.crc32(np.array(x[a:b], "<u4").tobytes())) for x in all_ids for r in own[doc_id] for a, b in [(r.start, r.start + r.length)]}
        assert all((r.doc_tokens, r.start, r.start + r.length, r.ids_crc32) in slices for r in own[doc_id])
    for parts in fills.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= size and paid(at, size) == 0


def test_query_against_the_library(spark):
    folder = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    check(P.op13_level_packing(spark, folder).collect(), texts, 1024)


def test_odd_rows_in_any_order(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "no id"), (None, None), (3, "a b  c\n" * 900), (4, "word " * 63), (4, "word " * 63), (5, "x"), (6, "word " * 127), (7, "é" * 40)]
    ways = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame([(*r, "i", "s", "q") for r in order], CLASH).repartition(3 if order is rows else 1)
        found = P.pack_documents(docs, BYTE, size=64, group=100).collect()
        check(found, rows, 64)
        ways.append(sorted(map(str, found)))
    assert ways[0] == ways[1]
    check(P.pack_documents(docs, BYTE, size=64, group=3).collect(), rows, 64)


def test_no_documents(spark):
    assert P.pack_documents(spark.createDataFrame([], CLASH), BYTE).collect() == []
