from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lineweave.llm import language_id as L

SCHEMA = "doc_id long, text string, lang string, score string, held_out string"


def brute_grams(text):
    out = Counter()
    word = ""
    words = []
    for c in text + "\0":
        if c.isalpha():
            word += c.lower() if len(c.lower()) == 1 else c
        elif word:
            words.append(word)
            word = ""
    for i, w in enumerate(words):
        out.update(w)
    return out, words


def test_ngrams_match_brute_force():
    texts = ["", "Ab, cab!", "12", "x", "ÀÉ é", "日本語 日本", "a" * 50, "ß ǅ İ"]
    text, gram, count = L.grams(texts)
    found = {}
    for t, g, n in zip(text.tolist(), gram.tolist(), count.tolist()):
        found[t, "".join(chr(c) for c in (g >> 42, g >> 21 & 0x1FFFFF, g & 0x1FFFFF) if c).replace("\1", "_")] = n
    for i, t in enumerate(texts):
        single, words = brute_grams(t)
        assert {k: n for (j, k), n in found.items() if j == i and len(k) == 1} == dict(single)
        three = Counter()
        for w in words:
            p = f"_{w}_"
            three.update(p[k : k + 3] for k in range(len(p) - 2))
        assert {k: n for (j, k), n in found.items() if j == i and len(k) == 3} == dict(three), t
        # a sign alone between two words closes one and opens the other
        two = Counter(p for w in words for p in zip(f"_{w}", f"{w}_"))
        assert {k: n for (j, k), n in found.items() if j == i and len(k) == 2} == {"".join(p): n for p, n in two.items()}, t


def test_predict_matches_brute_force():
    langs = {"aa": ["th", "e", "he"], "bb": ["e", "d", "er"]}
    code = lambda g: sum(ord(c) << s for c, s in zip(g, (42, 21, 0)))
    known = sorted({code(g) for v in langs.values() for g in v})
    rank = np.full((len(known) + 1, 2), 3)
    for j, v in enumerate(langs.values()):
        for place, g in enumerate(v):
            rank[known.index(code(g)), j] = place
    p = L.Profiles(("aa", "bb"), np.array(known, np.uint64), rank, 3)
    texts = ["the the e", "der er", "..", "zzz"]
    text, gram, count = L.grams(texts)
    for i, (b, s) in enumerate(zip(*L.predict(texts, p))):
        own = sorted(((-n, g) for t, g, n in zip(text, gram.tolist(), count.tolist()) if t == i))[:3]
        if not own:
            assert (b, s) == (-1, 0)
            continue
        cost = [sum(abs(place - rank[known.index(g), j]) if g in known and rank[known.index(g), j] < 3 else 3 for place, (_, g) in enumerate(own)) for j in range(2)]
        assert b == int(np.argmin(cost)) and abs(s - (1 - min(cost) / (3 * len(own)))) < 1e-12


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = L.op2_language_id(spark, "/root/testdata/sf0.01")
    rows = found.join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id").collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    assert 150 < len(out) < 350
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97


def test_odd_rows(spark):
    rows = [(i, "the and of " * 9, "en", "", "") for i in range(9)] + [(20 + i, "der und die " * 9, "de", "", "") for i in range(9)]
    rows += [(5, None, "en", None, None), (6, "", None, None, None), (7, "123 ...", "en", None, None), (None, "der die", "xx", None, None), (8, "und der " * 40_000, None, None, None), (8, "und der " * 40_000, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    p = L.learn(docs, size=50)
    assert p.languages == ("de", "en")
    found = L.identify(docs, p).collect()
    assert len(found) == len(rows)
    assert Counter((r.doc_id, r.lang_pred) for r in found if r.doc_id in (5, 6, 7, 8, None))[8, "de"] == 2
    assert sum(r.lang_pred == "und" and r.score == 0 for r in found) == 3
    empty = spark.createDataFrame([], SCHEMA)
    assert L.identify(empty, p).collect() == [] and L.learn(empty).languages == ()
    assert {r.lang_pred for r in L.identify(docs, L.learn(empty)).collect()} == {"und"}
