"""Token ids as fixed-width bit-packed files with block offsets.

A file holds one range of doc_id, in ascending order (rows with the same doc_id: by text):

    "LWB1" | bits u8 | blocks of BLOCK ids, each packed in bits * BLOCK / 8 bytes | index | footer

Every id takes the same ``bits``, the fewest that hold the largest id of the vocabulary, so the id
at position p lies in block p // BLOCK at a known byte.  The index is, for each document, doc_id
(int64; I64_MIN for null) and the position of its first id (int64); the footer says how many
documents, ids and bits there are.  A reader fetches the footer and then any blocks, in any order.

Cases: a null text is an empty text and has the end id alone.  Null doc_ids come first.  Rows with
equal doc_ids are separate documents.  An empty table gives no file.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineweave.llm.common import shared_dir, slices
from lineweave.llm.token_ids import encoder

MAGIC = b"LWB1"
BLOCK = 4096  # ids; a multiple of 8, so that blocks end on bytes
FOOTER = np.dtype([("n_docs", "<i8"), ("n_ids", "<i8"), ("bits", "<i8"), ("magic", "S8")])
INDEX = np.dtype([("doc_id", "<i8"), ("first", "<i8")])
NULL_ID = np.iinfo(np.int64).min
#: Ids that one task reads at a time.
READ_BLOCKS = 256


def width(vocab_size: int) -> int:
    """The fewest bits for ids 0 .. vocab_size - 1."""
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids to a stream of bits, least significant first; length a multiple of 8 ids or padded."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(planes[:, :bits].reshape(-1), bitorder="little").tobytes()


def unpack(raw: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    planes = np.zeros((n, 32), np.uint8)
    planes[:, :bits] = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return np.packbits(planes, axis=1, bitorder="little").view("<u4").reshape(-1)


class Writer:
    """Appends ids; holds less than one block and the index of one file."""

    def __init__(self, out, bits: int):
        self.out, self.bits = out, bits
        self.rest, self.n_ids = np.zeros(0, np.uint32), 0
        self.index: list[np.ndarray] = []
        out.write(MAGIC + bytes([bits]))

    def add(self, doc_ids: np.ndarray, ids: np.ndarray, off: np.ndarray) -> None:
        index = np.empty(len(doc_ids), INDEX)
        index["doc_id"], index["first"] = doc_ids, self.n_ids + off[:-1]
        self.index.append(index)
        self.n_ids += len(ids)
        ids = np.concatenate((self.rest, ids))
        full = len(ids) // BLOCK * BLOCK
        self.out.write(pack(ids[:full], self.bits))
        self.rest = ids[full:]

    def close(self) -> tuple[int, int]:
        last = np.zeros(-(-len(self.rest) // BLOCK) * BLOCK, np.uint32)
        last[: len(self.rest)] = self.rest
        self.out.write(pack(last, self.bits))
        index = np.concatenate(self.index) if self.index else np.zeros(0, INDEX)
        self.out.write(index.tobytes())
        self.out.write(np.array([(len(index), self.n_ids, self.bits, MAGIC)], FOOTER).tobytes())
        return len(index), self.n_ids


class Reader:
    """Random access to one file: ids by position, documents by number."""

    def __init__(self, path: str):
        fs, self.path = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(self.path)
        size = self.file.size()
        foot = np.frombuffer(self.file.read_at(FOOTER.itemsize, size - FOOTER.itemsize), FOOTER)[0]
        if foot["magic"] != MAGIC:
            raise ValueError(f"{path} isn't a bit-packed token file")
        self.n_docs, self.n_ids, self.bits = int(foot["n_docs"]), int(foot["n_ids"]), int(foot["bits"])
        self.index_at = size - FOOTER.itemsize - self.n_docs * INDEX.itemsize

    def documents(self, a: int, b: int) -> np.ndarray:
        """Index entries a .. b - 1."""
        return np.frombuffer(self.file.read_at((b - a) * INDEX.itemsize, self.index_at + a * INDEX.itemsize), INDEX)

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids at positions a .. b - 1, by way of the blocks that hold them."""
        if b <= a:
            return np.zeros(0, np.uint32)
        first, last = a // BLOCK, -(-b // BLOCK)
        size = self.bits * BLOCK // 8
        found = unpack(self.file.read_at((last - first) * size, 5 + first * size), (last - first) * BLOCK, self.bits)
        return found[a - first * BLOCK : b - first * BLOCK]

    def close(self) -> None:
        self.file.close()


def write_ids(docs: DataFrame, tokenizer: str, folder: str, end_id: int, cut: str = "space", vocab_size: int | None = None) -> DataFrame:
    """Write one file for each range of doc_id below folder; a row for each file: its number, path,
    documents and ids.  Texts are dealt by sampled ranges of doc_id, so no range needs another's.

    The row set is the written manifest: files of a task that was run again replace its first ones.
    """
    if vocab_size is None:
        from tokenizers import Tokenizer

        vocab_size = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    bits = width(vocab_size)
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        ours = encoder(tokenizer, cut)
        out = fs = None
        for batch in batches:
            for a, b in slices(batch, "text", 2 << 20):
                part = batch.slice(a, b - a)
                ids, off = ours.encode([t or "" for t in part.column("text").to_pylist()])
                n = len(part)
                with_end = np.full(len(ids) + n, end_id, np.uint32)
                with_end[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(off))] = ids
                if out is None:
                    fs, where = pafs.FileSystem.from_uri(folder)
                    fs.create_dir(where, recursive=True)
                    path = f"ids-{number:06d}.lwb"
                    out = Writer(fs.open_output_stream(f"{where}/.{path}.{attempt}"), bits)
                keys = part.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
                out.add(keys, with_end, off + np.arange(n + 1))
        if out is not None:
            n_docs, n_ids = out.close()
            out.out.close()
            fs.move(f"{where}/.{path}.{attempt}", f"{where}/{path}")
            yield pa.RecordBatch.from_pydict({"file": pa.array([number], pa.int64()), "path": [f"{folder}/{path}"], "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    dealt = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    files = dealt.mapInArrow(run, "file long, path string, n_docs long, n_ids long")
    files.write.parquet(f"{folder}/manifest")
    return spark.read.schema(files.schema).parquet(f"{folder}/manifest")


def read_ids(manifest: DataFrame, with_ids: bool = True, docs_in_task: int = 2000) -> DataFrame:
    """A row for each document of the files: doc_id, start (ids before it in all files), n_tokens,
    ids_crc32, and ids unless with_ids is false.  Files are read by ranges of documents, in parallel."""
    order = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))
    ranges = placed.withColumn("a", F.explode(F.expr(f"sequence(0L, n_docs - 1, {docs_in_task}L)"))).select("path", "before", "a", F.least(F.col("a") + docs_in_task, "n_docs").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file = Reader(row["path"])
                index = file.documents(row["a"], min(row["b"] + 1, file.n_docs))
                first = np.append(index["first"], file.n_ids)[: row["b"] - row["a"] + 1]
                keys = index["doc_id"][: len(first) - 1]
                at = 0
                while at < len(keys):
                    to = max(at + 1, int(np.searchsorted(first, first[at] + READ_BLOCKS * BLOCK, side="right")) - 1)
                    ids = file.ids(int(first[at]), int(first[to]))
                    cut = (first[at : to + 1] - first[at]).astype(np.int64)
                    raw = ids.astype("<u4").tobytes()
                    out = {
                        "doc_id": pa.array(keys[at:to], mask=keys[at:to] == NULL_ID),
                        "start": pa.array(first[at:to] + row["before"]),
                        "n_tokens": pa.array(np.diff(cut)),
                        "ids_crc32": pa.array([zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(cut[:-1], cut[1:])], pa.int64()),
                    }
                    if with_ids:
                        out["ids"] = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids.astype(np.int64)))
                    yield pa.RecordBatch.from_pydict(out)
                    at = to
                file.close()

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return ranges.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, schema)


def op10_bit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = write_ids(docs, public_tokenizers.path("byte_bpe_50k.json"), f"{shared_dir(spark)}/ids", end_id=2)
    return read_ids(files, with_ids=False)
