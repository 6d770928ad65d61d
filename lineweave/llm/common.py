"""What the training-data operators share: the shared work folder, written tables, and
walking Arrow batches in slices of bounded size."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.sources.tables import work_dir as shared_dir

#: Bytes of text that a numpy kernel looks at together: few, so that its arrays stay in the cache.  A longer text is a slice of its own: texts stay whole.
SLICE_BYTES = 1 << 18
#: Bits of the table by which ``split_by`` tells rows without a partner: 262,144 words at most, however many keys there are.
PARTNER_BITS = 1 << 24


class Scratch:
    """Written tables of one job in a folder of its own, which go when nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, shared_dir(spark)
        self.names: list[str] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """The same rows, read from a Parquet table: lineage ends there, and lost executors cost only
        the tasks that they ran."""
        df.write.parquet(f"{self.folder}/{name}")
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def keep(self, *names: str) -> None:
        """Delete the tables but these.  Only for tables whose readers have themselves been written."""
        for name in [n for n in self.names if n not in names]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            self.names.remove(name)


def written(df: DataFrame, name: str) -> DataFrame:
    """As of ``Scratch.write``, for a table that stays."""
    return Scratch(df.sparkSession).write(df, name)


def fresh_name(taken: list[str], stem: str) -> str:
    """A column name that no column of the caller has (Spark compares names without case)."""
    low = {c.lower() for c in taken}
    name = stem
    while name.lower() in low:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of a batch whose texts have at most ``limit`` bytes, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = 0
    while a < len(sizes):
        b = a + max(1, int(np.searchsorted(np.cumsum(sizes[a:]), limit, side="right")))
        yield a, min(b, len(sizes))
        a = b


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array and its row offsets (null: empty)."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def split_by(rows: DataFrame, key: Column, others: DataFrame, other_key: Column) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be among the keys of others (all that are, and a few more), and the rest.  Keys
    are 64-bit hashes, and one bit stands for each.  Where few rows have a partner, only these need be exchanged
    to meet it.  Rows are read once for each of the two."""
    word, bits, may = (fresh_name(rows.columns, c) for c in ("word", "bits_", "may"))
    place = lambda k: F.pmod(k, F.lit(PARTNER_BITS))
    at = lambda k: F.shiftright(place(k), 6)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (place(other_key) % 64).cast("int"))
    told = others.select(at(other_key).alias(word), one.alias(bits)).groupBy(word).agg(F.bit_or(bits).alias(bits))
    rows = rows.withColumn(word, at(key)).join(F.broadcast(told), word, "left")
    rows = rows.withColumn(may, F.coalesce(F.getbit(bits, (place(key) % 64).cast("int")) == 1, F.lit(False)))
    return tuple(rows.where(F.col(may) == x).drop(word, bits, may) for x in (True, False))
