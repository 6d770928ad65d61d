"""Vector best-fit packing of token pieces into training sequences.

A piece demands tokens, one document place, and attention cost (its length squared).  A sequence
has a capacity for each.  Pieces are taken in falling order of their largest share of a capacity;
each goes to the open sequence that can hold it under every capacity and that has the best score:
the smallest weighted norm of what would be left ("norm"), or the largest weighted dot product of
demand and residual ("dot").  If none can hold it, it opens a sequence.

Pieces are dealt evenly into groups of bounded size and each group is packed by itself, so the loss
against one global packing is one part-filled sequence or so for each ``group`` pieces.

Cases: a null text is empty and is one piece with the end id alone.  Rows with equal doc_ids, also
repeated rows, are separate documents.  Null doc_ids stay null.  An empty table gives no rows.
Extra columns are ignored.  Of sequences with equal scores the one that was opened first takes the
piece, and of equal pieces the one with the smaller doc_id, piece and ids_crc32 goes first, whatever order
their rows come in.  A text of any length is cut up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm.common import SLICE_BYTES, slices, written
from lineweave.llm.token_ids import encoder

#: Pieces that one task packs.
GROUP = 20_000


@dataclass(frozen=True)
class Capacity:
    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    #: Of tokens, documents and attention in scores.
    weights: tuple[float, float, float] = (1.0, 0.05, 0.1)
    rule: str = "norm"


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, max_tokens: int = 2048, cut: str = "word", with_ids: bool = True, remembered: int | None = None) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, and ids unless with_ids is
    false.  Only documents of over max_tokens ids are cut.  Fewer ``remembered`` strings take less memory in
    each Python worker and more time; texts then go in smaller slices, as a slice's new strings have to fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ours = encoder(tokenizer, cut, remembered)
        for batch in batches:
            for a, b in slices(batch, "text", SLICE_BYTES if remembered else 2 << 20):
                part = batch.slice(a, b - a)
                ids, off = ours.encode([t or "" for t in part.column("text").to_pylist()])
                n = len(part)
                with_end = np.full(len(ids) + n, end_id, "<u4")
                with_end[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(off))] = ids
                off = off + np.arange(n + 1)
                many = -(-np.diff(off) // max_tokens)
                row = np.repeat(np.arange(n), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * max_tokens
                length = np.minimum(np.diff(off)[row] - start, max_tokens)
                at = off[row] + start
                raw = memoryview(with_end.tobytes())
                out = {
                    "doc_id": part.column("doc_id").take(pa.array(row)),
                    "piece": pa.array(piece.astype(np.int32)),
                    "start": pa.array(start),
                    "length": pa.array(length),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * x : 4 * (x + y)]) for x, y in zip(at.tolist(), length.tolist())], pa.int64()),
                }
                if with_ids:  # pieces follow each other, and so their ends are offsets
                    out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(at, len(with_end)).astype(np.int32)), pa.array(with_end.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def best_fit(length: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each piece, and its offset there."""
    limit = np.array([capacity.tokens, capacity.documents, capacity.attention], float)
    demand = np.stack([length, np.ones(len(length)), length.astype(float) ** 2], axis=1) / limit
    if len(demand) and demand.max() > 1 + 1e-12:
        raise ValueError("a piece is larger than an empty sequence")
    weights = np.array(capacity.weights)
    order = np.lexsort((np.arange(len(length)), -demand.max(axis=1)))
    smallest = np.minimum.accumulate(demand[order][::-1], axis=0)[::-1]  # of the pieces still to come
    where, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    left = np.zeros((3, 256))
    name, filled = np.zeros(256, np.int64), np.zeros(256, np.int64)
    n = opened = 0
    for step, i in enumerate(order):
        d = demand[i]
        if step % 512 == 0 and n:  # close what can take no piece that is to come
            keep = np.flatnonzero((left[:, :n] + 1e-9 >= smallest[step][:, None]).all(axis=0))
            left[:, : len(keep)], name[: len(keep)], filled[: len(keep)] = left[:, keep], name[keep], filled[keep]
            n = len(keep)
        at = np.flatnonzero(left[0, :n] + 1e-9 >= d[0])
        if len(at):
            at = at[(left[1, at] + 1e-9 >= d[1]) & (left[2, at] + 1e-9 >= d[2])]
        if len(at):
            if capacity.rule == "dot":
                j = at[np.argmax((weights * d) @ left[:, at])]
            else:
                j = at[np.argmin(weights @ (left[:, at] - d[:, None]) ** 2)]
        else:
            if n == left.shape[1]:
                left = np.concatenate((left, np.zeros_like(left)), axis=1)
                name, filled = (np.concatenate((x, np.zeros_like(x))) for x in (name, filled))
            j, n = n, n + 1
            left[:, j], name[j], filled[j] = 1.0, opened, 0
            opened += 1
        where[i], offset[i] = name[j], filled[j]
        left[:, j] -= d
        filled[j] += length[i]
    return where, offset


def pack(pieces: DataFrame, capacity: Capacity = Capacity(), group: int = GROUP) -> DataFrame:
    """The pieces with sequence_id and offset.  ``pieces`` should be a written table: it is counted
    to choose the number of groups, and read again."""
    groups = max(1, -(-pieces.count() // group))
    names = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batches = [b for b in batches if b.num_rows]  # one group
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        where, offset = best_fit(table.column("length").to_numpy(), capacity)
        sequence = where + (np.int64(TaskContext.get().partitionId()) << 32)
        table = table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        yield from table.to_batches(4096)

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes)
    order = [n for n in ("doc_id", "piece", "ids_crc32", "length") if n in names]
    return pieces.select(*names).repartition(groups).sortWithinPartitions(*order).mapInArrow(run, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, and doc_ids and lengths in order: one row for each sequence, which holds at
    most the capacity.  ``packed`` has ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.length").alias("lengths"))


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = written(cut_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False), "pieces")
    return pack(pieces)
