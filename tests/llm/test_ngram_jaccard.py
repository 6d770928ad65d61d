import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lineweave.llm import ngram_jaccard as N
from lineweave.llm.components import connected

SCHEMA = "doc_id long, text string, digest string, n string, node string, label string"


def sets(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(docs, join):
    s = [sets(t, join.k) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            c = len(s[i] & s[j])
            if c and 100 * c >= join.percent * (len(s[i]) + len(s[j]) - c):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s[i]), least.get(find(i)) if s[i] else d) for i, (d, _) in enumerate(docs)), key=str)


def found(df):
    return sorted((tuple(r) for r in df.drop("text_hash").collect()), key=str)


def family(rng, size, words=120):
    base = [f"w{rng.randrange(900)}" for _ in range(words)]
    out = []
    for _ in range(size):
        x = list(rng.choice(out) if out and rng.random() < 0.7 else base)
        for _ in range(rng.randrange(4)):
            x[rng.randrange(len(x))] = f"z{rng.randrange(50)}"
        out.append(x)
    return [" ".join(x) for x in out]


@pytest.mark.parametrize(("tile", "near"), [(20_000, 64), (15, 64), (20_000, 1), (15, 0)])
def test_families_match_brute_force(spark, monkeypatch, tile, near):
    """Also with small tiles, and where round 1 finds little or nothing."""
    monkeypatch.setattr(N, "TILE_ROWS", tile)
    monkeypatch.setattr(N, "NEAR", near)
    rng = random.Random(7)
    texts = [t for size in (2, 5, 40) for t in family(rng, size)] + [" ".join(f"u{rng.randrange(300)}" for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    texts += ["a passage that all of these share word for word " * 3 + f"{i} " * rng.randrange(9) for i in range(30)]
    texts += [family(rng, 1, 3000)[0] + t for t in ("", " one more", " two more words")]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    frame = spark.createDataFrame([(*d, "", "", "", "") for d in docs], SCHEMA)
    for join in (N.Join(4, 85), N.Join()):
        want = brute(docs, join)
        assert found(N.group_documents(frame, join)) == want
        assert len({c for _, _, c in want}) < len(want)


def test_odd_rows(spark):
    docs = [(5, "A b c d e"), (3, "a B c d e"), (3, "a B c d e"), (9, None), (8, ""), (7, " \n\t"), (6, "one"), (2, "ONE"), (None, "one"), (None, "alone here"), (1, "é Ü " * 3000), (4, "é Ü " * 3001), (10, "x y"), (11, "y x")]
    frame = spark.createDataFrame([(*d, "", None, None, None) for d in docs], SCHEMA)
    assert found(N.group_documents(frame, N.Join(4, 85))) == brute(docs, N.Join(4, 85))
    assert N.group_documents(frame.limit(0), N.Join(4, 85)).collect() == []


def test_sql_on_documents(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    want = sorted(con.execute(N.OP3_SQL).fetchall(), key=str)
    assert found(N.op3_ngram_jaccard(spark, "/root/testdata/sf0.001")) == want
    assert any(d != c for d, _, c in want)


def test_bitmaps_never_exceed_the_difference():
    rng = np.random.default_rng(1)
    for n, m in ((30, 40), (900, 1030), (2000, 2300), (2100, 2040)):
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate((x[: n // 2], rng.integers(0, 1 << 63, m - n // 2).astype(np.uint64))))
        count = N._apart(pa.array([N.bitmap(x).tobytes(), N.bitmap(y).tobytes()], pa.binary()), np.array([len(x), len(y)]))
        apart = count(np.array([0]), np.array([1]))[0]
        real = len(np.setxor1d(x, y))
        assert min(0.3 * real, 0.4 * N.bitmap_bits(min(len(x), len(y)))) < apart <= real


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (7, 7)] + [(200, x) for x in range(201, 260)]
    got = dict(tuple(r) for r in connected(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100} | {x: 200 for x in range(200, 260)}


def test_components_of_null_repeated_and_no_edges(spark):
    edges = spark.createDataFrame([(1, 2), (1, 2), (None, 5), (6, None), (None, None), (3, 3)], "a long, b long")
    assert sorted(tuple(r) for r in connected(edges, "a", "b").collect()) == [(1, 1), (2, 1)]
    assert connected(edges.limit(0), "a", "b").collect() == []


def test_only_needed_tables_stay(spark):
    from pathlib import Path

    from lineweave.llm.common import Scratch

    scratch = Scratch(spark)
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "x y z")], "doc_id long, text string")
    got = N.group_documents(docs, N.Join(), scratch)
    assert sorted(scratch.names) == sorted(p.name for p in Path(scratch.folder.removeprefix("file:")).iterdir()) == ["components", "copies", "profiles"]
    assert found(got) == [(1, 1, 1), (2, 1, 1), (3, 1, 3)]


def test_pairs_of_mixed_tiles():
    """All pairs between components, in large tiles of nearly one component too."""
    rng = np.random.default_rng(8)
    h = np.repeat([1, 2, 3, 4], [200, 30, 1, 150])
    n = np.concatenate([np.sort(rng.integers(50, 90, m)) for m in (200, 30, 1, 150)])
    label = np.where(rng.random(len(h)) < 0.04, rng.integers(5, 9, len(h)), 1)
    label[200:230] = rng.integers(1, 4, 30)
    block = rng.integers(0, 2, len(h))
    low, high = np.zeros(len(h), int), (h == 4).astype(int)
    join = N.Join()
    got = sorted((int(min(x)), int(max(x))) for now, other in N._pairs(h, low, high, block, n, label, join) for x in zip(now, other))
    want = [(i, j) for i in range(len(h)) for j in range(i + 1, len(h)) if h[i] == h[j] and label[i] != label[j] and 100 * n[i] >= 80 * n[j] and (low[i] == high[i] or block[i] != block[j])]
    assert got == want and len(want) > 1000


def test_rows_split_by_partners(spark):
    """All rows with a partner are in the first part, hardly any other is, and no row is lost."""
    from lineweave.llm.common import split_by

    rows = spark.createDataFrame([(i if i % 50 else None, f"t{i}", "b", "m") for i in range(3000)], "id long, bits_ string, word string, may string")
    others = spark.createDataFrame([(i,) for i in range(0, 3000, 7)] + [(None,)] * 3 + [(9000,)], "other long")
    may, rest = split_by(rows, F.xxhash64("id"), others, F.xxhash64("other"))
    assert may.columns == rest.columns == rows.columns
    may, rest = ([tuple(r) for r in x.collect()] for x in (may, rest))
    assert sorted(may + rest, key=str) == sorted((tuple(r) for r in rows.collect()), key=str)
    want = {i for i in range(0, 3000, 7) if i % 50} | {None}
    assert want <= {r[0] for r in may} and len({r[0] for r in may}) < len(want) + 5 and not want & {r[0] for r in rest}
    may, rest = split_by(rows, F.xxhash64("id"), others.limit(0), F.xxhash64("other"))
    assert (may.count(), rest.count()) == (0, 3000)


def test_texts_without_a_partner_are_not_exchanged(spark):
    """Only the shingles of prefixes are, and what takes part."""
    rng = random.Random(4)
    texts = [" ".join(f"{rng.randrange(1 << 40):x}" for _ in range(2000)) for _ in range(150)]
    texts += [texts[0] + " and more", texts[1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def moved():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = moved()
    assert {c for d, _, c in found(N.group_documents(docs)) if d >= 150} == {0, 1}
    assert moved() - before < 0.7 * sum(map(len, texts))
