"""Queries over sources, sinks and streams: S2, S4, S6, S11, S13 to S16, R3 to R10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.common import fresh_folder, table
from cairn.functions import paths as P
from cairn.plans import version_queries as VQ
from cairn.plans.base import LIVE_SQL, files, live_anchors
from cairn.sources import scan
from cairn.streaming import generations as G


def s2_discover(spark: SparkSession, folder: str) -> DataFrame:
    """The table files of the folder found by a walk: name and size."""
    config = scan.WorkspaceConfig(extensions=["parquet"])
    return scan.discover(spark, folder, config).select("path", "size", "ext")


def s6_config(spark: SparkSession, folder: str) -> DataFrame:
    """Paths in the scope of a loaded configuration."""
    config, _ = scan.load_config('{"include": ["harborlight", "tinderlane"], "exclude": ["harborlight/net"], "extensions": [".c", ".go"], "nonsense": 1}')
    return files(spark, folder).where(P.in_scope(F.col("path"), config.include, config.exclude, config.extensions, config.excluded_dirs)).select("path")


def s11_go_modules(spark: SparkSession, folder: str) -> DataFrame:
    """Module paths and used directories read from module files, which are made of the top directories."""
    top = files(spark, folder).where("source = 'workspace'").select(F.split("path", "/")[0].alias("dir")).distinct()
    mod = F.concat(F.lit("// x\nmodule "), F.col("dir"), F.lit(".example\n\ngo 1.22\n"))
    work = F.concat(F.lit("go 1.22\n\nuse (\n\t./"), F.col("dir"), F.lit("\n\t./lib\n)\nuse ./tools\n"))
    return top.select("dir", scan.module_path(mod).alias("module"), F.array_join(F.sort_array(scan.work_dirs(work)), ",").alias("uses"))


def s14_published_generation(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors written as a generation by family, published, and read back."""
    store = G.GenerationStore(spark, fresh_folder(spark, "anchors"))
    a = live_anchors(spark, folder).select("id", "name", "semantic_family")
    store.publish(a.limit(0))
    store.publish(a, ["semantic_family"])
    return store.read().select("id", "name", "semantic_family")


def s16_json_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Revisions per repository as lines."""
    return scan.as_lines(VQ.a2_coverage(spark, folder).select("repo", "revisions"))


def r4_streamed_state(spark: SparkSession, folder: str) -> DataFrame:
    """State of the files after the deliveries went through the stream as upserts into generations."""
    base = fresh_folder(spark, "entries")
    store = G.GenerationStore(spark, f"{base}/store")
    rows = G.stream_table(spark, folder, "file_entries").where("id is not null").select("id", "indexed_at", "delivery_no", "delivered_at", "hash", "size", F.lit(False).alias("deleted"))
    store.maintain(rows, "id", ["indexed_at", "delivery_no", "delivered_at", "hash"], "deleted", f"{base}/checkpoint").awaitTermination()
    found = store.read()
    return (found if found is not None else table(spark, folder, "file_entries").limit(0)).select("id", "hash", "size")


def r5_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Names after two delta segments over the base: each replaces the paths it touches; compacted if it has to be."""
    store = G.SegmentStore(spark, fresh_folder(spark, "segments"))
    a = live_anchors(spark, folder).where("path is not null").select("id", "path", "name")
    store.append(a, "path")
    store.append(a.where("length(path) % 3 = 0").withColumn("name", F.concat(F.lit("b_"), F.col("name"))), "path")
    store.append(a.where("length(path) % 7 = 0 and id % 2 = 0"), "path", a.where("length(path) % 7 = 0"))
    if store.needs_compaction():
        store.compact("path")
    return store.read("path").select("id", "name")


def r8_retention(spark: SparkSession, folder: str) -> DataFrame:
    """Generations that stay after four publications, of which the last two and a leased one are kept."""
    store = G.GenerationStore(spark, fresh_folder(spark, "kept"))
    a = live_anchors(spark, folder).select("id")
    for _ in range(4):
        store.publish(a)
    store.collect(2, leased=[1])
    _, changed = store.read_pinned(lambda df: df.count())
    return spark.createDataFrame([(g, changed) for g in store.generations()], "generation int, changed boolean")


def r10_streamed_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Accept events counted by user and kind in a stream."""
    return G.run_to_table(G.accept_counts(G.stream_table(spark, folder, "events"), ["user_id", "event_type"]), fresh_folder(spark, "accepts"))


def r10_windowed_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Events per day and kind in a stream with a watermark."""
    e = G.stream_table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return G.run_to_table(G.windowed_counts(e, "ts", "event_type", "1 day", "400 days"), fresh_folder(spark, "windows"))


QUERIES = {f.__name__: f for f in (s2_discover, s6_config, s11_go_modules, s14_published_generation, s16_json_lines, r4_streamed_state, r5_segments, r8_retention, r10_streamed_counts, r10_windowed_counts)}
SQL = {
    "s6_config": f"select path from {VQ.FILES_SQL} where lower(regexp_extract(path, '[^/]\\.([^./]*)$', 1)) in ('c', 'go') and (starts_with(path, 'harborlight/') or starts_with(path, 'tinderlane/')) and not starts_with(path, 'harborlight/net/') and not regexp_matches(lower(path), '(^|/)(\\.git|\\.vscode|node_modules|target|out|build)/')",
    "s11_go_modules": f"select distinct d as dir, d || '.example' as module, array_to_string(list_sort([d, 'lib', 'tools']), ',') as uses from (select split_part(path, '/', 1) d from {VQ.FILES_SQL} where source = 'workspace')",
    "s14_published_generation": f"select id, name, semantic_family from {LIVE_SQL}",
    "s16_json_lines": "select '{\"repo\":\"' || repo || '\",\"revisions\":' || n || '}' as line from (select repo, count(distinct id) n from file_revisions group by 1)",
    "r4_streamed_state": f"select id, hash, size from {VQ._ENTRIES}",
    "r5_segments": f"select id, case when length(path) % 3 = 0 and length(path) % 7 <> 0 then 'b_' || name else name end as name from {LIVE_SQL} where path is not null and (length(path) % 7 <> 0 or id % 2 = 0)",
    "r8_retention": "select g as generation, false as changed from (values (1), (3), (4)) t(g)",
    "r10_streamed_counts": "select user_id, event_type, count(*) as accepts from events group by 1, 2",
    "r10_windowed_counts": "select date_trunc('day', ts)::timestamp as window_start, event_type, count(*) as n from events group by 1, 2",
}
