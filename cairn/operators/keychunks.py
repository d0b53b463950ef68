"""Per-key results although a few keys hold most records (problem 3).

Exact offset chunking: keys are counted per input partition, prefix sums over the partitions give each (partition, key)
its offset, so every row gets its exact number within its key without sorting the key anywhere. Equal-sized chunks of
a key are processed as independent groups; the ordered boundary states of the chunks are merged at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows per chunk: what one group of the parallel part may hold at most.
CHUNK_ROWS = 50_000


def numbered(df: DataFrame, key: str, keep: list[str], order: list[str] | None = None) -> DataFrame:
    """``key``, ``keep`` and ``pos``: the row's number, from 0, among the rows of its key, in the order of the input.

    An input partition is a block of a file of the scan (``_metadata.file_path`` and block start), which a lost task
    reads again exactly as before; the rows within it are ordered by ``order`` or, without it, by their place in the file.
    The input has to be a file scan (write anything else to a table first). A null key is a key of its own.
    """
    block = [F.xxhash64("_metadata.file_path").alias("_p"), F.col("_metadata.file_block_start").alias("_b")]
    # The null key as an ordinary value, so that window and join agree on one partitioning.
    code = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("_k")
    src = df.select(code, *[F.col(c) for c in keep], *block, *([] if order else [F.col("_metadata.row_index").alias("_r")]))
    counts = df.select(code, *block).groupBy("_k", "_p", "_b").agg(F.count("*").alias("n"))
    # One row per input partition and key: a hot key has as many as there are partitions.
    before = Window.partitionBy("_k").orderBy("_p", "_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_k", "_p", "_b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    rows = src.withColumn("rn", F.row_number().over(Window.partitionBy("_p", "_b", "_k").orderBy(*(order or ["_r"]))))
    value = F.when(F.col("_k") != "", F.substring("_k", 2, 2**31 - 1)).cast(df.schema[key].dataType)
    return rows.join(offsets, ["_p", "_b", "_k"]).select(value.alias("k"), *keep, (F.col("off") + F.col("rn") - 1).alias("pos"))


def chunk_states(rows: DataFrame, state: list[Column], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row ``(k, chunk, *state)`` per key and chunk of ``chunk_rows`` rows."""
    return rows.withColumn("chunk", F.floor(F.col("pos") / F.lit(chunk_rows))).groupBy("k", "chunk").agg(*state)


def key_counts(df: DataFrame, key: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(k, n_rows, n_chunks)`` of every key, the null key included, by way of the chunks."""
    states = chunk_states(numbered(df, key, []), [F.count("*").alias("n")], chunk_rows)
    return states.groupBy("k").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_chunks"))


def heavy_keys(df: DataFrame, key: str, share: float = 0.02, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(key_value, n_rows)`` of the non-null keys with at least ``share`` of all delivered rows; none for an empty table."""
    per_key = key_counts(df, key, chunk_rows)
    total = df.agg(F.count("*")).scalar()
    return per_key.where(F.col("k").isNotNull() & (F.col("n_rows") >= total * F.lit(share))).select(F.col("k").alias("key_value"), "n_rows")


def runs_per_key(df: DataFrame, key: str, value: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Ordered result: ``(key_value, n_rows, n_runs, first_value, last_value)`` in the order of the input.

    A run is a longest stretch of consecutive rows of the key with the same ``value`` (nulls are equal). Each chunk yields
    its count of runs and its boundary values; two chunks that meet with the same value share one run.
    """
    rows = numbered(df, key, [value]).withColumn("chunk", F.floor(F.col("pos") / F.lit(chunk_rows)))
    w = Window.partitionBy("k", "chunk").orderBy("pos")
    flagged = rows.withColumn("start", F.when(F.lag("pos").over(w).isNull() | ~F.lag(value).over(w).eqNullSafe(F.col(value)), 1).otherwise(0))
    states = flagged.groupBy("k", "chunk").agg(F.count("*").alias("n"), F.sum("start").alias("runs"), F.min_by(F.struct(value), "pos").alias("first"), F.max_by(F.struct(value), "pos").alias("last"))
    v = Window.partitionBy("k").orderBy("chunk")
    met = F.when(F.lag("chunk").over(v).isNotNull() & F.lag("last").over(v).eqNullSafe(F.col("first")), 1).otherwise(0)
    merged = states.withColumn("met", met).groupBy("k").agg(
        F.sum("n").alias("n_rows"), (F.sum("runs") - F.sum("met")).alias("n_runs"), F.min_by("first", "chunk").alias("f"), F.max_by("last", "chunk").alias("l")
    )
    return merged.select(F.col("k").alias("key_value"), "n_rows", "n_runs", F.col(f"f.{value}").alias("first_value"), F.col(f"l.{value}").alias("last_value"))
