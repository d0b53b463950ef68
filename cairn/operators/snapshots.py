"""What changed between full snapshots (problem 1).

Gaps and islands: the rows of a key, ordered by snapshot, fall into islands of consecutive snapshots with the same
content. Each island is a validity interval; its start, its end and its adjacency to the next interval are the change
events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def standing_rows(snapshots: DataFrame, *, period: str, key: str, ref: str, delivered: str) -> DataFrame:
    """One row ``(period, key, ref)`` per period and key: the one delivered last.

    Ties in ``delivered`` are won by the greater ``ref`` (null is least); a null ``delivered`` is older than any other.
    Rows with a null period or key are no members of any snapshot. Repeated deliveries, also very many of one key, are
    reduced before the shuffle.
    """
    last = F.max(F.struct(F.col(delivered).alias("d"), F.col(ref).alias("r")))
    return (
        snapshots.where(F.col(period).isNotNull() & F.col(key).isNotNull())
        .groupBy(F.col(period).alias("period"), F.col(key).alias("key"))
        .agg(last.alias("x"))
        .select("period", "key", F.col("x.r").alias("ref"))
    )


def validity_intervals(snapshots: DataFrame, contents: DataFrame, *, period: str, key: str, ref: str, delivered: str, content_id: str, content_hash: str) -> DataFrame:
    """Intervals ``(key, first_period, last_period, content_hash, opened, closed_in)`` of equal content.

    ``opened`` is null for an interval that starts with the very first snapshot, ``added`` after a gap and ``changed``
    if the interval before it ends in the snapshot before. ``closed_in`` is the period from which the key is missing, null if
    it stays or passes into another interval. Hashes are compared without letter case and nulls are equal; a ``ref``
    without a row in ``contents`` has a null hash, a null ``ref`` means that the key is absent. Empty tables give no rows.
    """
    rows = standing_rows(snapshots, period=period, key=key, ref=ref, delivered=delivered)
    # One row per snapshot, never per record: the number of deliveries so far.
    periods = snapshots.where(F.col(period).isNotNull() & F.col(key).isNotNull()).select(F.col(period).alias("period")).distinct()
    in_order = Window.orderBy("period")
    periods = periods.select("period", F.row_number().over(in_order).alias("idx"), F.lead("period").over(in_order).alias("next_period"))
    hashes = contents.where(F.col(content_id).isNotNull()).groupBy(F.col(content_id).alias("ref")).agg(F.max(F.lower(F.col(content_hash).cast("string"))).alias("hash"))
    present = rows.where(F.col("ref").isNotNull()).join(hashes, "ref", "left").join(periods, "period")

    w = Window.partitionBy("key").orderBy("idx")
    starts = F.lag("idx").over(w).isNull() | (F.lag("idx").over(w) < F.col("idx") - 1) | ~F.lag("hash").over(w).eqNullSafe(F.col("hash"))
    islands = present.withColumn("start", starts.cast("int")).withColumn("island", F.sum("start").over(w))
    intervals = islands.groupBy("key", "island").agg(
        F.min("idx").alias("s"), F.max("idx").alias("e"), F.min("period").alias("first_period"), F.max("period").alias("last_period"), F.max_by("next_period", "idx").alias("after"), F.max("hash").alias("content_hash")
    )
    v = Window.partitionBy("key").orderBy("s")
    adjacent = F.lag("e").over(v).eqNullSafe(F.col("s") - 1)
    goes_on = F.lead("s").over(v).eqNullSafe(F.col("e") + 1)
    return intervals.select(
        "key", "first_period", "last_period", "content_hash",
        F.when(adjacent, "changed").when(F.col("s") > 1, "added").alias("opened"),
        F.when(~goes_on, F.col("after")).alias("closed_in"),
    )


def snapshot_changes(snapshots: DataFrame, contents: DataFrame, **columns: str) -> DataFrame:
    """Events ``(period, key, change_kind)``: added, removed, changed, for each snapshot but the first."""
    intervals = validity_intervals(snapshots, contents, **columns)
    events = F.array(
        F.when(F.col("opened").isNotNull(), F.struct(F.col("first_period").alias("period"), F.col("opened").alias("change_kind"))),
        F.when(F.col("closed_in").isNotNull(), F.struct(F.col("closed_in").alias("period"), F.lit("removed").alias("change_kind"))),
    )
    return intervals.select("key", F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select("e.period", "key", "e.change_kind")
