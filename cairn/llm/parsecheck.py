"""Source files that do not parse (problem 6), by memoised parsing with derivatives."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.languages import judge_file


def verdicts(files: DataFrame, *, file_id: str, path: str, text: str) -> DataFrame:
    """``(file_id, verdict, failing_offset)`` of every row, whole texts.

    verdict: valid, conflict (the failing token is a merge marker), broken, truncated; null for a null text or an extension of no
    known language. failing_offset: characters before the failing token, -1 if there is none. An empty text is valid. Repeated rows
    give repeated results; no shuffle.
    """
    kind = files.schema[file_id].dataType.simpleString()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [judge_file(p, t) for p, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v for v, _ in got], pa.string()), pa.array([a for _, a in got], pa.int64())], ["file_id", "verdict", "failing_offset"])

    return files.select(F.col(file_id).alias("file_id"), F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("text")).mapInArrow(check, f"file_id {kind}, verdict string, failing_offset bigint")


def rates(verdict: DataFrame, about: DataFrame, groups: list[str]) -> DataFrame:
    """Files, judged files and those of each verdict per group. about: ``file_id`` and ``groups``, one row per file."""
    joined = about.join(verdict, "file_id", "left")
    bad = F.col("verdict").isin("conflict", "broken", "truncated")
    return joined.groupBy(*groups).agg(
        F.count("verdict").alias("n_judged"),
        F.sum(bad.cast("int")).cast("bigint").alias("n_bad"),
        *[F.count(F.when(F.col("verdict") == v, 1)).alias(f"n_{v}") for v in ("conflict", "broken", "truncated")],
        (F.sum(bad.cast("int")) / F.count("verdict")).alias("bad_rate"),
    )
