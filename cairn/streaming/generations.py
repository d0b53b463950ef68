"""Generations: immutable versions of a table, published by one atomic step, read pinned, merged by a stream and collected."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Files:
    """The few file-system steps needed, on whatever file system the folder is."""

    def __init__(self, spark: SparkSession, folder: str):
        self._jvm = spark.sparkContext._jvm
        self.folder = folder
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, part: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}" if part else self.folder)

    def names(self, part: str) -> list[str]:
        p = self.path(part)
        return [s.getPath().getName() for s in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def claim(self, part: str) -> bool:
        """Create an empty file; False if it is there already."""
        p = self.path(part)
        self.fs.mkdirs(p.getParent())
        return bool(self.fs.createNewFile(p))

    def drop(self, part: str) -> None:
        self.fs.delete(self.path(part), True)


class GenerationStore:
    """A table in numbered generations below a folder. A generation is written whole under ``data``; an empty file in ``committed`` then publishes it, in one step.

    Readers resolve the newest committed number once and read that directory only; single writer.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.files = spark, folder, Files(spark, folder)

    def generations(self) -> list[int]:
        """Committed generations in order."""
        return sorted(int(n) for n in self.files.names("committed") if n.isdigit())

    def current(self) -> int | None:
        """The newest one."""
        return (self.generations() or [None])[-1]

    def publish(self, rows: DataFrame, partition_by: list[str] | None = None) -> int:
        """Write the next generation and switch to it. What a writer that died left under the same number is overwritten."""
        number = (self.current() or 0) + 1
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.folder}/data/gen={number}")
        self.files.claim(f"committed/{number}")
        return number

    def read(self, generation: int | None = None) -> DataFrame | None:
        """Rows of a generation, the current one by default; None while there is none."""
        number = generation if generation is not None else self.current()
        return None if number is None else self.spark.read.parquet(f"{self.folder}/data/gen={number}")

    def read_pinned(self, use: Callable[[DataFrame], object]) -> tuple[object, bool]:
        """Apply ``use`` to the current generation; the flag says whether another one was published meanwhile."""
        before = self.current()
        result = use(self.read(before))
        return result, self.current() != before

    def merge(self, changes: DataFrame, key: str, newest: list[str], deleted: str) -> int:
        """Publish the next generation: per key the row with the greatest ``newest``, of the present rows and the changes; keys whose last change is a deletion are left out."""
        base = self.read()
        rows = changes if base is None else base.withColumn(deleted, F.lit(False)).unionByName(changes)
        others = [c for c in rows.columns if c not in (key, *newest)]
        best = rows.groupBy(key).agg(F.max(F.struct(*newest, *others)).alias("x"))
        return self.publish(best.select(key, "x.*").where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted))

    def collect(self, keep: int, leased: Iterable[int] = ()) -> list[int]:
        """Drop all but the last ``keep`` generations and the leased ones; gives those dropped."""
        old = [g for g in self.generations()[:-keep] if g not in set(leased)] if keep > 0 else []
        for g in old:
            self.files.drop(f"committed/{g}")
            self.files.drop(f"data/gen={g}")
        return old

    # --- streaming ----------------------------------------------------------------------------------------------
    def maintain(self, changes: DataFrame, key: str, newest: list[str], deleted: str, checkpoint: str, interval: str | None = None):
        """Start a query that merges each micro-batch of a stream as one generation. A batch that was merged before a failure is recognised by its number and not merged again."""

        def batch(rows: DataFrame, number: int) -> None:
            done = f"batches/{number}"
            if str(number) in self.files.names("batches"):
                return
            if not rows.isEmpty():
                self.merge(rows, key, newest, deleted)
            self.files.claim(done)

        writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


class SegmentStore:
    """A base segment and delta segments; a path in a later segment shadows its rows in all earlier ones."""

    MOST_SEGMENTS, SHARE = 64, 4

    def __init__(self, spark: SparkSession, folder: str):
        self.store, self.spark = GenerationStore(spark, folder), spark

    def append(self, rows: DataFrame, path: str, touched: DataFrame | None = None) -> int:
        """Add a segment; ``touched`` are paths that it replaces, also without rows of their own."""
        marks = rows.select(path) if touched is None else rows.select(path).unionByName(touched.select(path))
        body = rows.withColumn("_row", F.lit(True)).unionByName(marks.distinct().withColumn("_row", F.lit(False)), allowMissingColumns=True)
        return self.store.publish(body)

    def _all(self) -> DataFrame:
        parts = [self.store.read(g).withColumn("_seg", F.lit(g)) for g in self.store.generations()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def read(self, path: str) -> DataFrame:
        """The visible rows."""
        rows = self._all()
        last = rows.groupBy(path).agg(F.max("_seg").alias("_seg"))
        return rows.where("_row").join(last, [path, "_seg"], "left_semi").drop("_row", "_seg")

    def needs_compaction(self) -> bool:
        """Sixty-four deltas, or more delta rows than a quarter of the base."""
        g = self.store.generations()
        if len(g) < 2:
            return False
        count = lambda n: self.store.read(n).where("_row").count()
        return len(g) - 1 >= self.MOST_SEGMENTS or sum(count(n) for n in g[1:]) > count(g[0]) / self.SHARE

    def compact(self, path: str) -> None:
        """Replace all segments by one with the visible rows."""
        old = self.store.generations()
        self.append(self.read(path), path)
        for g in old:
            self.store.files.drop(f"committed/{g}")
            self.store.files.drop(f"data/gen={g}")


def stream_table(spark: SparkSession, folder: str, name: str, **options: str) -> DataFrame:
    """A table of a folder as a stream: its files one after another, whether it is one file or a directory."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    files = Files(spark, folder)
    single = files.fs.getFileStatus(files.path(f"{name}.parquet")).isFile()
    reader = spark.readStream.schema(schema).options(**options)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if single else reader.parquet(f"{folder}/{name}.parquet")


def accept_counts(events: DataFrame, keys: list[str]) -> DataFrame:
    """Running counts of an event stream by keys."""
    return events.groupBy(*keys).agg(F.count("*").alias("accepts"))


def windowed_counts(events: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """Counts per tumbling window and key; rows later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def run_to_table(result: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Run a streaming aggregate over all that is there now; gives the table that it leaves."""
    out = f"{folder}/out"

    def put(rows: DataFrame, _number: int) -> None:
        rows.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    result.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(out)
