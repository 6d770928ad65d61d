"""The training-corpus pipeline.  Each stage calls one operator of lineweave.llm on all that the stage
before it kept; stages but the last return the columns of documents."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.llm.best_fit_packing import cut_pieces, pack
from lineweave.llm.common import Scratch, split_by, written
from lineweave.llm.decontamination import drop_contaminated, indexes
from lineweave.llm.ngram_jaccard import Join, group_documents
from lineweave.llm.quality_rules import keep_documents, learn_stems
from lineweave.llm.suffix_dedup import remove_repeats

#: Bytes of an Arrow batch.  Texts are wide: Spark's 10,000 rows or 64 MB are held by the JVM and by the Python worker, several times each.
BATCH_BYTES = 4 << 20
#: Strings whose ids a Python worker remembers: fewer than packing alone may, as all stages share an executor and its workers.
REMEMBERED = 300_000


def in_small_batches(stage: Callable) -> Callable:
    """The stage with Arrow batches of about BATCH_BYTES at most.  It's set for the session, as what a stage
    returns is written afterwards."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy rejects go; abuse is learned from the labels.  Null texts have
    no words and go; repeated rows are judged alike."""
    return keep_documents(docs, stems=learn_stems(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@in_small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8), the smallest doc_id stays.

    Null and wordless texts are in no group and stay.  Rows without a doc_id go if their group has a
    document with one.  Of rows with one doc_id those go whose own text is a copy of a smaller one; a
    row that is repeated with its doc_id is one document, and all its rows stay or go together."""
    scratch = Scratch(spark)
    groups = group_documents(docs, Join(k=5, percent=80), scratch)
    gone = groups.where("component_id IS NOT NULL AND NOT (doc_id <=> component_id)").select(F.col("doc_id").alias("gone_id"), "text_hash").distinct()
    gone = scratch.write(gone, "near_copies")
    scratch.keep("near_copies")
    # few texts go: only those that may are exchanged
    may, rest = split_by(docs, F.xxhash64("doc_id", F.xxhash64("text")), gone, F.xxhash64("gone_id", "text_hash"))
    may = may.join(gone, may["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(may["text"]) == gone["text_hash"]), "left_anti")
    return rest.unionByName(may.select(*docs.columns))


@in_small_batches
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that a document with a smaller doc_id has go; so does a document of which
    nothing is left.  Null texts stay; rows without a doc_id, and rows with equal ones, keep all that no
    smaller doc_id has."""
    rest = remove_repeats(docs, 50)
    return rest.where(F.coalesce(F.col("text") != "", F.lit(True)))


@in_small_batches
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which a test item has leaked go.  Null texts stay; repeated rows are judged alike."""
    return drop_contaminated(docs, indexes(spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


@in_small_batches
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, packed into sequences.  A null text is its end id alone; each row
    is a document; equal pieces are packed in order of doc_id, piece and ids."""
    import public_tokenizers

    return pack(written(cut_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False, remembered=REMEMBERED), "pieces"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", packing),
]

#: SQL has neither the tokenizer nor bytes of texts; tests/llm/test_pipeline.py has the plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage_{i}")
    return docs
