import corpus_pipeline as C
import pyarrow as pa
import test_decontamination as leaks
import test_ngram_jaccard as near
import test_quality_rules as quality
import test_suffix_dedup as repeats
import test_tokens as tokens
from lineweave.llm import best_fit_packing as P
from lineweave.llm import ngram_jaccard as N
from lineweave.llm import quality_rules as Q
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"


def by_hand(spark, docs):
    """doc_id and text after each stage."""
    kept = {r.doc_id for r in Q.apply_policy(Q.ledger(docs)).where("kept").collect()}
    now = [(r.doc_id, r.text) for r in docs.collect()]
    for doc_id, text in now:
        n, _, _, _, repeated = quality.brute(text)
        assert doc_id not in kept or (n >= 50 and 100 * repeated <= 50 * n)
    now = [r for r in now if r[0] in kept]
    yield sorted(now)
    stay = {d for d, _, c in near.brute(now, N.Join(5, 80)) if d == c}
    now = [r for r in now if r[0] in stay]
    yield sorted(now)
    least = {}
    raw = [(d, t.encode()) for d, t in now]
    for d, x in raw:
        for i in range(len(x) - 49):
            least[x[i : i + 50]] = min(d, least.get(x[i : i + 50], d))
    after = []
    for d, x in raw:
        gone = [False] * len(x)
        for i in range(len(x) - 49):
            if least[x[i : i + 50]] < d:
                gone[i : i + 50] = [True] * 50
        text = bytes(b for b, g in zip(x, gone) if not g).decode("utf-8", "ignore")
        if text:
            after.append((d, text))
    now = after
    yield sorted(now)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    bad = {r[0] for r in leaks.brute(now, items)}
    now = [r for r in now if r[0] not in bad]
    yield sorted(now)


def test_stages_match_the_plain_version(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    for (_, stage), want in zip(C.STAGES[:-1], by_hand(spark, docs)):
        docs = C.written(stage(spark, docs, DIR), "stage")
        assert docs.columns == columns
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == want
    assert all(r.n_chars == len(r.text) for r in docs.collect() if r.text)
    whole = {r.doc_id: r.n for r in C.run(spark, DIR).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    ids = tokens.library(tokens.WORD, [t for _, t in want])
    assert whole == {d: len(i) + 1 for (d, _), i in zip(want, ids)}


def test_no_documents_and_odd_rows(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert C.run.__doc__ and len(C.STAGES) == 5
    odd = docs.limit(3).unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string"))).withColumn("fail_bits", F.lit("clash")).withColumn("places", F.lit(1))
    for frame in (odd, odd.limit(0)):
        for _, stage in C.STAGES[:-1]:
            frame = C.written(stage(spark, frame, DIR), "stage")
            assert frame.columns == odd.columns
        C.STAGES[-1][1](spark, frame, DIR).collect()


def test_batches_of_wide_rows_are_bounded(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    C.packing(spark, docs, DIR)
    try:
        wide = spark.range(0, 4000, 1, 1).withColumn("text", F.repeat(F.lit("0123456789"), 1000))  # 40 MB
        sizes = wide.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
        assert sum(r.n for r in sizes) >= 40_000_000
        assert max(r.n for r in sizes) <= 1.5 * C.BATCH_BYTES
    finally:
        spark.conf.unset(key)


def test_packing_of_the_pipeline_is_that_with_all_strings_remembered(spark):
    import public_tokenizers

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    pieces = [P.cut_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False, remembered=n) for n in (None, 2000)]
    want, found = (sorted(map(tuple, x.collect())) for x in pieces)
    assert found == want
