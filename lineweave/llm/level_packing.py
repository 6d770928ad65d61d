"""Sum-of-squares packing of documents into training windows, online, by an array of fill levels.

A window holds ``size`` ids.  It is padded up to that, but for one whose fill is a power of two.  So a
window is *partly filled* if its fill is neither ``size`` nor a power of two, and the packing keeps the
sum over all levels of the squared number of partly filled windows small: a few windows at each of many
levels will find what fills them up, many at one level won't.

Documents come in order.  Each whole ``size`` ids of one are a window of their own; what remains goes to
the level (0: a new window) where the sum of squares grows least, of equal ones to the fullest.  Only
the number of windows at each level matters for that, so a choice is one look along the level array.
What is still partly filled when all documents have come is joined, cut at window ends, and the last
rest is cut into powers of two: nothing is padded, and few documents are cut but for their length.

Documents are dealt evenly into groups, each packed by itself; a group ends with ten more small windows
at most.  A task holds the remainders (fewer than ``size`` ids each) of one group; whole windows pass.

Cases: a null text is empty and has the end id alone.  Rows with equal doc_ids, also repeated rows, are
separate documents; of equal rows it doesn't matter which is which.  Null doc_ids stay null.  An empty
table gives no rows.  Extra columns are ignored.  A text of any length is cut up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lineweave.llm.common import slices
from lineweave.llm.token_ids import encoder

#: Documents that one task packs.
GROUP = 20_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, size: int, cut: str = "space") -> DataFrame:
    """A row for each whole window and for the remainder of a document: PIECE, and the ids of a
    remainder (little-endian unsigned 32-bit; null for whole windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ours = encoder(tokenizer, cut)
        for batch in batches:
            for a, b in slices(batch, "text", 2 << 20):
                part = batch.slice(a, b - a)
                ids, off = ours.encode([t or "" for t in part.column("text").to_pylist()])
                n = len(part)
                with_end = np.full(len(ids) + n, end_id, "<u4")
                with_end[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(off))] = ids
                off = off + np.arange(n + 1)
                tokens = np.diff(off)
                many = -(-tokens // size)
                row = np.repeat(np.arange(n), many)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)) * size
                length = np.minimum(tokens[row] - start, size)
                raw = memoryview(with_end.tobytes())
                bounds = list(zip((4 * (off[row] + start)).tolist(), (4 * (off[row] + start + length)).tolist()))
                out = {
                    "doc_id": part.column("doc_id").take(pa.array(row)),
                    "start": pa.array(start),
                    "length": pa.array(length),
                    "ids_crc32": pa.array([zlib.crc32(raw[x:y]) for x, y in bounds], pa.int64()),
                    "doc_tokens": pa.array(tokens[row]),
                    "ids": pa.array([bytes(raw[x:y]) if y - x < 4 * size else None for x, y in bounds], pa.binary()),
                }
                yield pa.RecordBatch.from_pydict(out)

    return docs.select("doc_id", "text").mapInArrow(run, f"{PIECE}, ids binary")


def power_of_two(n: np.ndarray) -> np.ndarray:
    return (n > 0) & (n & (n - 1) == 0)


class Levels:
    """The windows that can take more, by fill."""

    def __init__(self, size: int):
        level = np.arange(size + 1)
        self.size = size
        self.counts = np.zeros(size + 1, np.int64)
        self.weight = np.where((level == size) | (level == 0) | power_of_two(level), 0, 1)
        #: What the sum of squares grows by when a window comes to a level, and shrinks by when one leaves it.
        self.comes = self.weight.copy()
        self.leaves = np.full(size + 1, -(1 << 60), np.int64)
        self.leaves[0] = 0
        self.at: list[list[int]] = [[] for _ in range(size + 1)]
        self.opened = 0

    def _count(self, level: int, change: int) -> None:
        self.counts[level] += change
        n, w = self.counts[level], self.weight[level]
        self.comes[level] = w * (2 * n + 1)
        self.leaves[level] = w * (2 * n - 1) if n else -(1 << 60)

    def place(self, length: int) -> tuple[int, int]:
        """Window and offset of a remainder of fewer than ``size`` ids."""
        cost = self.comes[length:] - self.leaves[: self.size + 1 - length]
        level = len(cost) - 1 - int(cost[::-1].argmin())
        if level:
            window = self.at[level].pop()
            self._count(level, -1)
        else:
            window, self.opened = self.opened, self.opened + 1
        full = level + length
        if full < self.size:
            self.at[full].append(window)
            self._count(full, 1)
        return window, level

    def partly_filled(self) -> list[int]:
        """Windows that would be padded, the fullest first."""
        return [w for level in np.flatnonzero(self.weight)[::-1] for w in self.at[level]]


def powers(n: int) -> list[int]:
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def level_pack(lengths: list[int], size: int) -> list[tuple[int, int, int, int, int]]:
    """(row, start, length, window, offset) of each piece of remainders, whose lengths are below size."""
    levels = Levels(size)
    placed = [levels.place(n) for n in lengths]
    again = {w: k for k, w in enumerate(levels.partly_filled())}
    out = [(i, 0, n, w, at) for i, (n, (w, at)) in enumerate(zip(lengths, placed)) if w not in again]
    rest = sorted((again[w], at, i) for i, (w, at) in enumerate(placed) if w in again)
    left = sum(lengths[i] for _, _, i in rest)
    ends = [*[size] * (left // size), *powers(left % size)]  # sizes of the windows that the rest fills
    window, fill = levels.opened, 0
    for _, _, i in rest:
        start = 0
        while start < lengths[i]:
            n = min(lengths[i] - start, ends[0] - fill)
            out.append((i, start, n, window, fill))
            start, fill = start + n, fill + n
            if fill == ends[0]:
                ends.pop(0)
                window, fill = window + 1, 0
    return out


def pack_levels(pieces: DataFrame, size: int, groups: int) -> DataFrame:
    """The pieces of ``tokenized`` with sequence_id and offset; remainders that are cut become more rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, whole, rest = np.int64(TaskContext.get().partitionId()) << 32, 0, []
        for batch in batches:
            full = batch.filter(pa.compute.equal(batch.column("length"), size)).drop_columns(["ids"])
            if full.num_rows:
                sequence = base + whole + np.arange(full.num_rows)
                whole += full.num_rows
                yield full.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(np.zeros(full.num_rows, np.int64)))
            rest.append(batch.filter(pa.compute.less(batch.column("length"), size)))
        table = pa.Table.from_batches(rest) if rest else None
        if table is None or not table.num_rows:
            return
        row, start, length, window, offset = np.array(level_pack(table.column("length").to_pylist(), size), np.int64).T
        ids, own = table.column("ids").to_pylist(), table.column("length").to_numpy()
        crc = table.column("ids_crc32").to_numpy()[row]
        for k in np.flatnonzero(length < own[row]).tolist():
            crc[k] = zlib.crc32(ids[row[k]][4 * start[k] : 4 * (start[k] + length[k])])
        out = pa.table(
            {
                "doc_id": table.column("doc_id").take(pa.array(row)),
                "start": table.column("start").to_numpy()[row] + start,
                "length": length,
                "ids_crc32": crc,
                "doc_tokens": table.column("doc_tokens").to_numpy()[row],
                "sequence_id": base + whole + window,
                "offset": offset,
            }
        )
        yield from out.combine_chunks().to_batches(4096)

    dealt = pieces.repartition(groups).sortWithinPartitions("doc_id", "doc_tokens", "ids_crc32", "start")
    return dealt.mapInArrow(run, f"{PIECE}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = 1024, cut: str = "space", group: int = GROUP) -> DataFrame:
    """A row for each piece: PIECE, sequence_id, offset."""
    if size & (size - 1):
        raise ValueError("a window's size is a power of two")
    groups = max(1, -(-docs.count() // group))
    return pack_levels(tokenized(docs, tokenizer, end_id, size, cut), size, groups)


def op13_level_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
