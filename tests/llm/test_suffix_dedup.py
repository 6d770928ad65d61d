import hashlib
import random

import numpy as np
import pytest

from lineweave.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string, tag string, places string"


def brute(docs, size=50):
    least = {}
    raw = [(d, (t or "").encode()) for d, t in docs]
    for d, x in raw:
        if d is not None:
            for i in range(len(x) - size + 1):
                least[x[i : i + size]] = min(d, least.get(x[i : i + size], d))
    out = []
    for d, x in raw:
        gone = [False] * len(x)
        if d is not None:
            for i in range(len(x) - size + 1):
                if least[x[i : i + size]] < d:
                    gone[i : i + size] = [True] * size
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(x), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(x, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_rolling_hashes_follow_content():
    raw = np.frombuffer(b"abcabcabcabcabcabcabcabcxabcabcabcabcabcabcabcabc" * 3, np.uint8)
    for k in (1, 2, 3, 5, 8, 16, 20, 31):
        h = S.rolling(raw, k)
        assert len(h) == len(raw) - k + 1
        strings = [raw[i : i + k].tobytes() for i in range(len(h))]
        assert len(set(h.tolist())) == len(set(strings)) == len(set(zip(h.tolist(), strings)))


def test_every_window_has_its_anchors():
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab") for _ in range(n)).encode() for n in (0, 49, 50, 51, 300)] + [b"z" * 120, b"xy" * 100]
    raw, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    at, text, h = S.anchors(raw, off, 50)
    all_h = S.rolling(raw, S.K_BYTES)
    S.CACHED = 1 << 16
    want = set()
    for t in range(len(texts)):
        for i in range(off[t], off[t + 1] - 49):
            own = all_h[i : i + 50 - S.K_BYTES + 1]
            want |= set((i + np.flatnonzero(own == own.min())).tolist())
    assert at.tolist() == sorted(want) and (all_h[at] == h).all()
    assert all(off[t] <= a < off[t + 1] for a, t in zip(at, text))


def test_multikey_sort():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 2, (400, 21)).astype(np.uint8)
    rows[200:, :17] = rows[0, :17]
    order, common = S.multikey_sort(rows)
    got = [rows[i].tobytes() for i in order]
    assert got == sorted(r.tobytes() for r in rows)
    for i in range(1, len(got)):
        assert common[i] == next((j for j in range(21) if got[i][j] != got[i - 1][j]), 21)


def planted(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (6, 9, 12, 30, 200)] + ["=" * 90, "ab" * 60]
    docs = []
    for i in range(120):
        parts = [text(rng.randrange(30))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts += [p[a : a + rng.randrange(20, 400)], text(rng.randrange(12))]
        docs.append(rng.choice(["", " "]).join(parts))
    docs += [docs[3], docs[3], docs[40][:60], docs[41] + docs[42]]
    rng.shuffle(docs)
    ids = rng.sample(range(-50, 900), len(docs))
    return list(zip(ids, docs))


@pytest.mark.parametrize(("seed", "held", "dealing"), [(1, 150_000, {}), (2, 50, {}), (3, 100, {"bucket_bytes": 500, "hot_least": 3}), (4, 30, {"bucket_bytes": 50})])
def test_planted_passages(spark, seed, held, dealing, monkeypatch):
    """Also in very small buckets, and with anchors that fill them."""
    monkeypatch.setattr(S, "HELD", held)
    docs = planted(seed)
    want = brute(docs)
    assert sum(r[2] for r in want) > 1000
    frame = spark.createDataFrame([(*d, "", "") for d in docs], SCHEMA).repartition(3)
    if "hot_least" in dealing:
        assert len(S.choose_deal(frame, 50, **dealing).hot)
    assert found(S.measure_repeats(frame, **dealing)) == want


def test_null_ids_that_look_like_another_row(spark):
    """Rows without a doc_id are dealt by a hash of their text; a document with that very number is another."""
    p = "a passage of well over fifty bytes that several rows of this small table have in common. "
    key = spark.sql(f"SELECT xxhash64('{p}') AS k").first().k
    docs = [(None, p), (None, p), (key, p), (min(key, 0) - 1, p + "end")]
    assert found(S.measure_repeats(spark.createDataFrame([(*d, None, None) for d in docs], SCHEMA))) == brute(docs)


def test_odd_rows(spark):
    p = "a passage of well over fifty bytes, with é and ü, that several rows have in common. "
    docs = [(1, p), (1, p), (1, "x" + p * 2), (2, None), (3, ""), (4, p[:40]), (5, "né " + p), (None, p), (6, p[:60]), (7, "é" * 4000), (8, "é" * 5000), (9, "e" + "é" * 30), (2**40, p + p)]
    frame = spark.createDataFrame([(*d, None, None) for d in docs], SCHEMA)
    assert found(S.measure_repeats(frame)) == brute(docs)
    assert S.measure_repeats(frame.limit(0)).collect() == []
    kept = {(r.doc_id, r.text) for r in S.remove_repeats(frame).collect()}
    assert {(5, "né"), (2, None), (None, p), (1, p)} <= {(i, t and (t.strip() if i == 5 else t)) for i, t in kept}
    assert S.remove_repeats(frame).columns == frame.columns


def test_documents_match_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert found(S.op1_suffix_dedup(spark, "/root/testdata/sf0.001")) == brute(docs)
