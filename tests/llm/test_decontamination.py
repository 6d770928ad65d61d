import math
import re
from collections import Counter

import numpy as np

from lineweave.llm import decontamination as D
from lineweave.llm.common import utf8

DOCS = "doc_id long, text string, item_id string, score string"


def terms(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def sh(words, k=5):
    k = min(k, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set(), k


def brute(docs, items, o=D.Options()):
    words = [terms(t) for _, t in items]
    n, mean = len(items), sum(map(len, words)) / max(1, len(items))
    df = Counter(w for x in words for w in set(x))

    def bm25(query, x):
        c = Counter(x)
        return sum(math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * len(x) / mean)) for w in set(query) & set(x))

    half = max([1, *map(len, words)])
    out = {}
    for d, (doc_id, text) in enumerate(docs):
        w = terms(text)
        for at in range(0, max(1, len(w) - half), half) if w else ():
            own = w[at : at + 2 * half]
            for i, (item_id, t) in enumerate(items):
                if words[i] and (s := bm25(own, words[i])) >= o.share * bm25(words[i], words[i]) - 1e-9:
                    share = []
                    for x in (words[i], *map(terms, D.question_and_answer(t or ""))):
                        want, k = sh(x)
                        have = {tuple(own[j : j + k]) for j in range(len(own) - k + 1)} if k else set()
                        share.append(len(want & have) / len(want) if want else 1.0)
                    if (share[0] >= 0.8 or min(share[1:]) >= 0.8) and share[0] > out.get((d, i), (0, -1))[1]:
                        out[d, i] = (s, *share)
    return sorted(((docs[d][0], items[i][0], *v) for (d, i), v in out.items()), key=str)


def close(found, want):
    found = sorted(found, key=str)
    assert [x[:2] for x in found] == [x[:2] for x in want]
    assert np.allclose([x[2:] for x in found], [x[2:] for x in want])


def test_question_and_answer():
    assert D.question_and_answer("One two. Three?\nFour five.") == ("One two. Three?\n", "Four five.")
    assert D.question_and_answer("just one.") == ("just one.", "") and D.question_and_answer("") == ("", "")


def test_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{d}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    found = [tuple(r) for r in D.op9_decontamination(spark, d).collect()]
    want = brute(docs, items)
    assert len(want) > 2
    close(found, want)


def test_the_threshold_loses_no_overlap(spark):
    """Every document with 0.8 of an item's shingles anywhere is found."""
    d = "/root/testdata/sf0.01"
    items = {r.item_id: sh(terms(r.text))[0] for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    want = set()
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        own = sh(terms(r.text))[0]
        want |= {(r.doc_id, i) for i, s in items.items() if len(s & own) >= 0.8 * len(s)}
    assert want and {(r.doc_id, r.item_id) for r in D.op9_decontamination(spark, d).collect()} >= want


def test_odd_rows(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta. The answer is kappa lambda mu nu xi."
    items = [(1, item), (1, item), (2, None), (3, ""), (4, "..."), (5, "Short One"), (None, "unnamed item with some words in it")]
    long = "w%d " * 4000 % tuple(range(4000))
    docs = [(1, long + item.upper().replace(" ", "\n") + long), (2, None), (3, ""), (4, item[:40]), (5, "x short, ONE y"), (None, "unnamed item with some words in it"), (7, item), (7, item), (8, "epsilon " * 500), (9, item.split(". ")[0] + " and so on and on " + item.split(". ")[1])]
    frame = spark.createDataFrame([(*r, "", None) for r in docs], DOCS)
    tests = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, doc_id int")
    found_in = D.indexes(tests)
    found = [tuple(r) for r in D.find_leaks(frame, found_in).collect()]
    close(found, brute(docs, items))
    assert {r[0] for r in found} == {1, 5, None, 7, 9}
    left = D.drop_contaminated(frame, found_in)
    assert left.columns == frame.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 8]
    # many indexes find the same, with the same scores
    several = D.indexes(tests, index_bytes=2)
    assert len(several) > 64
    some = [several[i] for i in range(len(several)) if several[i].value.item_ids]
    close([tuple(r) for r in D.find_leaks(frame, some).collect()], brute(docs, items))
    assert sorted(r.doc_id for r in D.drop_contaminated(frame, some).collect()) == [2, 3, 4, 8]
    no_items = D.indexes(tests.limit(0))
    assert D.find_leaks(frame, no_items).collect() == [] and D.find_leaks(frame.limit(0), found_in).collect() == []


def test_bounds_are_above_scores():
    rng = np.random.default_rng(3)
    items = [(i, " ".join(f"t{x}" for x in rng.zipf(1.5, 20) % 60)) for i in range(50)]
    index = D.Index(items)
    for t in range(len(index.terms)):
        own = slice(index.start[t], index.start[t + 1])
        assert index.top[t] == index.impact[own].max()
        for b, x in zip(index.block[index.block_start[t] : index.block_start[t + 1]], index.block_impact[index.block_start[t] : index.block_start[t + 1]]):
            assert x == index.impact[own][index.item[own] // D.BLOCK == b].max()
    texts = [" ".join(f"t{x}" for x in rng.zipf(1.5, 90) % 60) for _ in range(40)]
    found = index.leaks(*utf8(__import__("pyarrow").array(texts)))
    close([(t, i, *x) for t, i, *x in found], brute(list(enumerate(texts)), items))
