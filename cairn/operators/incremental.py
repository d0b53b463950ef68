"""Processing only new or changed records (problem 2).

The deliveries are the partitions of the source. Each run takes their fingerprints (row count and additive row hash) and
compares them with those of the last commit: a delivery that is new, altered, late or gone differs, whatever its number, and
only such deliveries are read again. Files of the source that have not changed since they were fingerprinted are not read for
it: their fingerprints add up.

The state, one row per key, is a parquet table in hash buckets whose number follows the data. The buckets that hold a key of
a differing delivery are recomputed and replaced by dynamic partition overwrite. The fingerprints are written last: they are
the commit.

Dynamic overwrite moves each partition into place by a rename after removing the old one; a run that dies between the
two leaves a bucket missing, which the next run finds and rebuilds from the deliveries up to the last commit.

Exactly once: a row of the state keeps, where the run that wrote it changed it, its value at the last commit before. A run that
dies between replacing buckets and its commit leaves rows whose run is not committed; the next run, under whatever id,
compares with the kept values, so nothing is skipped and nothing reported twice.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Commit(NamedTuple):
    """A committed run: its id, the delivery it went up to, the table and number of the buckets, and ``{delivery: (rows, sum of row hashes)}``."""

    run_id: int | None = None
    upto: int | None = None
    table: str = "state"
    buckets: int = 0
    prints: dict[int, tuple[int, int]] = {}  # noqa: RUF012 (never written to)


@dataclass
class ChangeFeed:
    """Incremental runs over a table of deliveries.

    key: the record; newest: the column whose greatest value is the state; delivery: number of the delivery; watched: the
    columns that make a change (nulls are equal). Rows with a null key, ``newest`` or ``delivery`` have no state and are ignored.
    Ties in ``newest`` are won by the greater delivery, then by the greater watched values. A key of which all rows were withdrawn
    leaves the state and is not reported. ``bucket_rows``: rows of a bucket, which one task rewrites; the number of buckets doubles as
    the table grows. ``buckets``: the number to begin with, by default from the size of the table.
    """

    spark: SparkSession
    folder: str
    key: str
    newest: str
    delivery: str
    watched: Sequence[str]
    bucket_rows: int = 200_000
    buckets: int | None = None
    _known: Commit | None = field(default=None, init=False, repr=False)  # this writer's last commit

    # --- layout -------------------------------------------------------------------------------------------------
    def _path(self, part: str) -> str:
        return f"{self.folder}/{part}"

    def _stored(self, part: str) -> DataFrame | None:
        """The stored table, or None while no partition of it has been put in place."""
        try:
            return self.spark.read.parquet(self._path(part))
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def _replace(self, df: DataFrame, part: str, by: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(self._path(part))

    @staticmethod
    def _bucket(col: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(col), F.lit(buckets)).cast("int")

    def _valid(self, rows: DataFrame) -> DataFrame:
        return rows.where(F.col(self.key).isNotNull() & F.col(self.newest).isNotNull() & F.col(self.delivery).isNotNull())

    # --- fingerprints -------------------------------------------------------------------------------------------
    def committed(self) -> Commit:
        """Last commit, with one fingerprint per delivery."""
        if self._known:
            return self._known
        prints = self._stored("prints")
        last = None if prints is None else prints.agg(F.max("run_id")).first()[0]
        if last is None:
            return Commit()
        rows = prints.where(F.col("run_id") == last).collect()  # one row per delivery
        return Commit(last, rows[0]["upto"], rows[0]["table"], rows[0]["buckets"], {r["part"]: (r["n_rows"], r["row_sum"]) for r in rows if r["part"] is not None})

    def _sums(self, rows: DataFrame, keep: list[Column]) -> DataFrame:
        row = F.xxhash64(F.col(self.key), F.col(self.newest), F.col(self.delivery), *[F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in self.watched])
        per = self._valid(rows).groupBy(*keep, F.col(self.delivery).cast("bigint").alias("part"))
        return per.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("s"))

    def fingerprints(self, rows: DataFrame) -> dict[int, tuple[int, int]]:
        """Count and sum of row hashes of each delivery; sums wrap at 2**61 so that they can be added up.

        Of a scan of files only those are read that were not fingerprinted before with the same size and time of change.
        """
        if not rows.inputFiles():
            total = self._sums(rows, [])
        else:
            keep = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").cast("bigint").alias("time")]
            there, seen = rows.select(*keep).distinct(), self._stored("scanned")  # reads no column
            new = there if seen is None else there.join(seen, ["file", "size", "time"], "left_anti")
            names = [r["file"] for r in new.collect()]  # one row per new file
            if names:
                own = rows if seen is None else rows.where(F.col("_metadata.file_path").isin(names))
                # A file without any valid row is noted as well.
                new.join(self._sums(own, keep), ["file", "size", "time"], "left").coalesce(1).write.mode("append").parquet(self._path("scanned"))
                seen = self._stored("scanned")
            if seen is None:
                return {}
            # A run that died after noting a file may be followed by one that notes it again.
            total = seen.distinct().join(there, ["file", "size", "time"], "left_semi").where("part is not null").groupBy("part").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        return {r["part"]: (r["n"], int(r["s"]) % 2**61) for r in total.collect()}  # one row per delivery

    # --- one run ------------------------------------------------------------------------------------------------
    def run(self, run_id: int, rows: DataFrame, upto: int) -> None:
        """Take in what differs, among the deliveries up to ``upto``, from the last successful run, as run ``run_id`` (greater than those before)."""
        old = self.committed()
        if old.run_id is not None and run_id <= old.run_id:
            return  # this run is already committed
        prints = {d: p for d, p in self.fingerprints(rows).items() if d <= upto}
        differing = sorted(d for d in prints if prints[d] != old.prints.get(d))
        altered = sorted(d for d in old.prints if prints.get(d) != old.prints[d])  # below the old mark: changed or gone
        valid = self._valid(rows).where(F.col(self.delivery) <= upto)
        size = sum(n for n, _ in prints.values())
        buckets, target = old.buckets or self.buckets or max(1, -(-size // self.bucket_rows)), old.table
        if self.buckets is None and size > 2 * buckets * self.bucket_rows:
            buckets *= 2 ** (size // (buckets * self.bucket_rows)).bit_length() // 2
            target = f"state_{buckets}"
        whole = buckets != old.buckets  # the first run, or one that splits the buckets: everything is written
        state = self._stored(old.table) if old.buckets else None
        dirty, lost = self._leftovers(state, old)
        if state is None and old.prints:
            state = self._rebuilt(valid, None, old)
        elif lost and old.prints:
            state = state.unionByName(self._rebuilt(valid, lost, old))

        own = valid.where(F.col(self.delivery).isin(differing))
        keys = own.select(F.col(self.key).alias("key"))
        again = None
        if altered or dirty:
            # State rows that came from an altered delivery or from a dead run, and keys with a row in a differing one, are taken anew from all their rows.
            again = keys
            if state is not None:
                again = again.unionByName(state.where(F.col("delivery").isin(altered) | F.col("bucket").isin(dirty)).select("key"))
            again = again.distinct()
            fresh = self._newest(valid.join(again.withColumnRenamed("key", self.key), self.key, "left_semi"))
            pairs = again.join(fresh, "key", "left")
            if state is not None:
                pairs = pairs.join(state.select("key", F.struct("newest", "delivery", "now").alias("old"), F.col("bucket").isin(dirty).alias("dirty")), "key", "left")
                pairs = pairs.where(~F.col("x").eqNullSafe(F.col("old")) | F.coalesce("dirty", F.lit(False))).drop("old", "dirty")
            # Written down, so that only the buckets of keys that do differ are rewritten.
            pairs.write.mode("overwrite").parquet(self._path("again"))
            pairs = self.spark.read.schema(pairs.schema).parquet(self._path("again"))
            keys = again = pairs.select("key")
            delta = pairs.where("x is not null")
        else:
            delta = self._newest(own)
        todo = None
        if not whole:
            touched = keys.select(self._bucket(F.col("key"), buckets)).distinct().collect() if differing or altered else []  # at most one row per bucket
            todo = sorted({*[r[0] for r in touched], *dirty, *lost})
        if whole or todo:
            merged = self._merged(delta, state, again, todo, buckets, old.run_id, run_id)
            if whole:
                merged.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(self._path(target))
            else:
                self._replace(merged, target, "bucket")
        now = self._stored(target) if whole or todo else None
        # The null key stands for the run, so that it replaces what a dead run of the same id reported.
        found = self.spark.createDataFrame([(None, run_id)], "key string, run_id bigint").withColumn("key", F.col("key").cast(rows.schema[self.key].dataType))
        if now is not None:
            changed = now.where((F.col("run") == run_id) & F.col("changed"))
            found = found.unionByName((changed if whole else changed.where(F.col("bucket").isin(todo))).select("key", F.lit(run_id).cast("bigint").alias("run_id")))
        self._replace(found, "changes", "run_id")
        commit = [(d, n, s, upto, target, buckets, run_id) for d, (n, s) in sorted(prints.items())] or [(None, 0, 0, upto, target, buckets, run_id)]
        self._replace(self.spark.createDataFrame(commit, "part bigint, n_rows bigint, row_sum bigint, upto bigint, table string, buckets int, run_id bigint").coalesce(1), "prints", "run_id")
        self._known = Commit(run_id, upto, target, buckets, prints)

    def _leftovers(self, state: DataFrame | None, old: Commit) -> tuple[list[int], list[int]]:
        """Buckets that a dead run replaced but never committed, and those that it removed and did not put back. This writer's own last run left none of the first."""
        there = {}
        if state is not None:
            run = F.lit(old.run_id) if self._known else F.max("run")
            there = {r["bucket"]: r["run"] for r in state.groupBy("bucket").agg(run.alias("run")).collect()}  # one row per bucket
        return [b for b, run in there.items() if old.run_id is None or run > old.run_id], [b for b in range(old.buckets) if b not in there]

    def _newest(self, rows: DataFrame) -> DataFrame:
        """``(key, x)``: the newest row of each key, reduced before the shuffle: a key with very many rows is no hot spot."""
        now = F.struct(*[F.col(c).alias(f"w{i}") for i, c in enumerate(self.watched)])
        return rows.groupBy(F.col(self.key).alias("key")).agg(F.max(F.struct(F.col(self.newest).alias("newest"), F.col(self.delivery).cast("bigint").alias("delivery"), now.alias("now"))).alias("x"))

    def _rebuilt(self, valid: DataFrame, buckets: list[int] | None, old: Commit) -> DataFrame:
        """The state of some buckets, or all, as it was committed, from the deliveries up to then."""
        rows = valid.where(F.col(self.delivery) <= old.upto)
        if buckets is not None:
            rows = rows.where(self._bucket(F.col(self.key), old.buckets).isin(buckets))
        own = self._newest(rows).select("key", "x.newest", "x.delivery", "x.now")
        return own.select("*", F.lit(None).cast(own.schema["now"].dataType).alias("was"), F.lit(False).alias("changed"), F.lit(old.run_id).cast("bigint").alias("run"), self._bucket(F.col("key"), old.buckets).alias("bucket"))

    def _merged(self, delta: DataFrame, state: DataFrame | None, again: DataFrame | None, todo: list[int] | None, buckets: int, last: int | None, run_id: int) -> DataFrame:
        blank = F.lit(None).cast(delta.schema["x"].dataType["now"].dataType)
        both = delta.select("key", "x", blank.alias("was"), F.lit(False).alias("had"))
        if state is not None:
            # What held at the last commit: the present value, unless a run without commit changed the row.
            committed = ~F.col("changed") | ((F.col("run") <= last) if last is not None else F.lit(False))
            old = state if again is None else state.join(again.withColumn("again", F.lit(True)), "key", "left")
            if todo is not None:
                old = old.where(F.col("bucket").isin(todo))
            x = F.struct("newest", "delivery", "now")
            both = both.unionByName(old.select("key", (x if again is None else F.when(F.col("again").isNull(), x)).alias("x"), F.when(committed, F.col("now")).otherwise(F.col("was")).alias("was"), F.lit(True).alias("had")))
        out = both.withColumn("bucket", self._bucket(F.col("key"), buckets)).repartition(F.col("bucket")).groupBy("bucket", "key").agg(F.max("x").alias("x"), F.max(F.when(F.col("had"), F.col("was"))).alias("was")).where("x is not null")
        changed = ~F.col("x.now").eqNullSafe(F.col("was"))
        return out.select("key", "x.newest", "x.delivery", "x.now", F.when(changed, F.col("was")).alias("was"), changed.alias("changed"), F.lit(run_id).cast("bigint").alias("run"), "bucket")

    def changes(self) -> DataFrame:
        """All ``(run_id, key)`` reported by committed runs."""
        found, prints = self._stored("changes"), self._stored("prints")
        if found is None or prints is None:
            return self.spark.createDataFrame([], "run_id bigint, key bigint")
        done = prints.select("run_id").distinct()
        return found.where("key is not null").join(done, "run_id", "left_semi").select(F.col("run_id").cast("bigint").alias("run_id"), "key")
