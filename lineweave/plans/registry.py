"""The queries of the library, by name, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lineweave.functions import lyrics, moras, readings, syllables, text, vocabulary
from lineweave.operators import anchors, arrays, choices, fixes, intervals, layers, line_words, matching, melody, offsets, queues, relational, repairs, scaffolds, sequential, shown, stats, titles, tracks, verdicts, voiced, words
from lineweave.sources import answers, pages, payloads, subtitles
from lineweave.streaming import jobs, timers

MODULES = (relational, intervals, stats, text, arrays, sequential, choices, fixes, repairs, layers, anchors, words, line_words, matching, melody, offsets, queues, shown, scaffolds, titles, tracks, verdicts, voiced, lyrics, readings, moras, syllables, vocabulary, subtitles, payloads, answers, pages, jobs, timers)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.gap_table(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for m in MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql is not None}
