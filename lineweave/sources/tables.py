"""Readers: tables by name, and their views as timed lines, frames and lyric lines."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds that one unit of events.value lasts: an event is a line from ts to ts + value * this.
LINE_SECONDS = 600
#: The same views in DuckDB's SQL.
TIMED_SQL = f"(SELECT user_id AS song, event_id AS line, event_type AS text, epoch_us(ts) AS s, epoch_us(ts) + round(value * {LINE_SECONDS}000000)::BIGINT AS e, value FROM events)"
LYRICS_SQL = "(SELECT doc_id AS song, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS l FROM documents))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by keys to as many tasks as there are shuffle partitions.  A small file is read by one
    task, and small partitions become one, however long the work on each row takes.  Lists made of such rows are
    opened by posexplode_outer: for posexplode Spark makes each list once more, to test it before the rows are dealt."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def by_song(rows: DataFrame, order: list[str], fold: Callable[[list[tuple]], list[tuple]], schema: pa.Schema) -> DataFrame:
    """Rows that fold makes of each song's rows, in this order: a task goes through its songs one after the other
    and holds one of them.  The first column is the song; schema is that of the result, song included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def songs() -> Iterator[list[tuple]]:
            held: list[tuple] = []
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    if held and held[0][0] != row[0]:
                        yield held
                        held = []
                    held.append(row)
            if held:
                yield held

        out: list[tuple] = []
        made = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)
        for rows in songs():
            out += ((rows[0][0], *r) for r in fold(rows))
            if len(out) >= 10_000:
                yield made()
                out = []
        yield made()

    kinds = {pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean"}
    dealt_rows = dealt(rows.select(F.col("song").cast("long").alias("song"), *(c for c in rows.columns if c != "song")), "song").sortWithinPartitions("song", *order)
    return dealt_rows.mapInArrow(run, ", ".join(f"{f.name} {kinds[f.type]}" for f in schema))


def work_dir(spark: SparkSession) -> str:
    """A fresh folder below the shared one that the cluster names in spark.checkpoint.dir; where that is
    unset, below the context's checkpoint folder.  Only on a local master (a laptop, tests) is one made."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lineweave-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/lineweave-{uuid.uuid4().hex}"


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts) if isinstance(ts, str) else ts)


def timed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """song, line, text, s and e (start and end in microseconds), value."""
    start = micros("ts")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("song"), F.col("event_id").alias("line"), F.col("event_type").alias("text"), start.alias("s"), (start + F.round(F.col("value") * (LINE_SECONDS * 1_000_000)).cast("long")).alias("e"), "value")


def lyric_lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """song, line (from 1), text of each line that isn't blank.  Leading and interior blank lines take
    no number."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x, F.lit(" \t\r"))), lambda x: x != "")
    return docs.select(F.col(key).alias("song"), F.posexplode(lines).alias("line", "text")).withColumn("line", F.col("line").cast("long") + 1)
