import re
from collections import Counter

from pyspark.sql import functions as F

from lineweave.llm import quality_rules as Q

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, fail_bits string"


def brute(text):
    text = text or ""
    w = re.findall(WORD, text)
    c = Counter(zip(w, w[1:], w[2:]))
    hit = [False] * len(w)
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            hit[i] = hit[i + 1] = hit[i + 2] = True
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, sum(hit)


TEXTS = [None, "", " \n\t", "one", "a b c a b c", "é ü\n" * 3 + "é ü", "x" * 5000 + " y" * 3000, "l1 a\nl2 b\nl1 a\n\n\nl1 a\r\nl1 a", "## ** a|b <c>", "idiot! you stupid, stupid clown " * 20]


def test_measurements_match_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "en", "clash") for i, t in enumerate(TEXTS)] + [(3, "one", "en", "clash"), (None, "two words", None, None)], SCHEMA)
    rows = Q.apply_policy(Q.ledger(docs)).collect()
    assert len(rows) == len(TEXTS) + 2
    texts = dict(enumerate(TEXTS)) | {None: "two words"}
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id]), r
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in Q.ledger(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])


def test_policies_and_ablation(spark):
    book = Q.ledger(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).cache()
    bits = [r.fail_bits for r in book.select("fail_bits").collect()]
    names = [r.name for r in Q.default_rules()]
    found = {(r.policy, r.rule): (r.n_failed, r.n_only_this, r.n_kept_without) for r in Q.ablate(book).collect()}
    for p in Q.POLICIES:
        mask = p.bits(Q.default_rules())
        for rule in p.rules:
            bit = 1 << names.index(rule)
            assert found[p.version, rule] == (sum(bool(b & bit) for b in bits), sum(b & mask == bit for b in bits), sum(not b & mask & ~bit for b in bits))
    book.unpersist()


def test_labels_agree(spark):
    """Documents that people called good and harmless stay; abuse in the language of the list goes."""
    d = "/root/testdata/sf0.1"
    kept = Q.apply_policy(Q.ledger(spark.read.parquet(f"{d}/documents.parquet")))
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    rows = kept.filter(~F.col("base_failed")).join(docs, "doc_id").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("lang", "quality", "toxic", "kept").collect()

    def share(of, verdict):
        return sum(r.kept == verdict for r in of) / len(of)

    assert share([r for r in rows if r.quality and not r.toxic], True) > 0.999
    assert share([r for r in rows if r.toxic and r.lang == "en"], False) > 0.9
    assert share([r for r in rows if not r.quality and not r.toxic], False) > 0.5


def test_empty_table(spark):
    assert Q.apply_policy(Q.ledger(spark.createDataFrame([], SCHEMA))).collect() == []


def test_stems_of_words():
    raw, off = Q.utf8(Q.pa.array(["Bome bomente abome bom", None, "r\u00e9eux, R\u00e9eu r\u00e9"]))
    assert Q.stem_hits(raw, off, ("bome".encode(), "r\u00e9eu".encode())).tolist() == [2, 0, 2]
    assert Q.stem_hits(raw, off, ()).tolist() == [0, 0, 0]
    assert Q.begins_of("r\u00e9eu\u00e9".encode()) == ["r\u00e9e".encode(), "r\u00e9eu".encode(), "r\u00e9eu\u00e9".encode()]


def test_abuse_is_caught_in_every_language(spark):
    """As test_labels_agree, of op5 itself: what people called toxic goes in each language, not only in English."""
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    rows = Q.op5_quality_rules(spark, d).where("NOT base_failed").join(docs, "doc_id").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("lang", "quality", "toxic", "kept").collect()
    for lang in ("en", "de", "fr", "es"):
        toxic = [r for r in rows if r.toxic and r.lang == lang]
        good = [r for r in rows if r.quality and not r.toxic and r.lang == lang]
        assert sum(not r.kept for r in toxic) > 0.9 * len(toxic) > 0, lang
        assert sum(r.kept for r in good) > 0.98 * len(good) > 0, lang


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b c", "en"), (None, None, None)], "doc_id long, text string, lang string")
    assert Q.learn_stems(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")) == ()
    assert Q.learn_stems(docs, spark.createDataFrame([(None, 1, 1), (1, 1, None), (1, 1, 1)], "doc_id long, quality int, toxic int")) == ()


def test_labelled_sample_is_bounded(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    n = {r.toxic: r.n for r in Q.with_label(docs, labels, 30).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    assert 10 < n[0] < 60 and 0 < n[1] < 60
    assert Q.with_label(docs, labels.unionByName(labels)).count() == labels.where("toxic IS NOT NULL").select("doc_id").distinct().count()
