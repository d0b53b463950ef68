"""Queries p1 to p4 over the index tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.common import fresh_folder, table
from cairn.operators import incremental, keychunks, orphans, snapshots

_SNAP = {"period": "generation", "key": "file_id", "ref": "revision_id", "delivered": "delivered_at", "content_id": "id", "content_hash": "hash"}


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Files added, removed or changed per generation of ``active_file_revisions``."""
    events = snapshots.snapshot_changes(table(spark, folder, "active_file_revisions"), table(spark, folder, "file_revisions"), **_SNAP)
    return events.select(F.col("period").alias("generation"), F.col("key").alias("file_id"), "change_kind")


def p1_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Validity intervals of each file's content."""
    found = snapshots.validity_intervals(table(spark, folder, "active_file_revisions"), table(spark, folder, "file_revisions"), **_SNAP)
    return found.select(F.col("key").alias("file_id"), F.col("first_period").alias("first_generation"), F.col("last_period").alias("last_generation"), F.col("content_hash").alias("hash"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Files that each published run has to process: the runs are made one after another, each from the state the last one left."""
    builds = table(spark, folder, "index_builds").where((F.col("state") == "published") & F.col("last_delivery").isNotNull())
    runs = builds.groupBy("id").agg(F.max("last_delivery").alias("upto")).orderBy("id").collect()  # one row per run
    feed = incremental.ChangeFeed(spark, fresh_folder(spark, "feed"), key="id", newest="indexed_at", delivery="delivery_no", watched=["hash", "size"])
    entries = table(spark, folder, "file_entries")
    for run in runs:
        feed.run(run["id"], entries, run["upto"])
    return feed.changes().select(F.col("run_id").alias("build_id"), F.col("key").alias("file_id"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Names with at least 2 % of the rows of their table."""
    parts = [(t, k) for t, k in (("call_sites", "callee_name"), ("callable_anchors", "name"))]
    found = [keychunks.heavy_keys(table(spark, folder, t), k).select(F.lit(t).alias("table_name"), F.col("key_value").cast("string").alias("key_value")) for t, k in parts]
    return found[0].unionByName(found[1])


def p3_callee_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Per callee: rows and the runs of one generation in delivery order."""
    return keychunks.runs_per_key(table(spark, folder, "call_sites"), "callee_name", "generation").select(F.col("key_value").alias("callee_name"), "n_rows", "n_runs", F.col("first_value").alias("first_generation"), F.col("last_value").alias("last_generation"))


def p3_callee_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per callee, the null name included."""
    return keychunks.key_counts(table(spark, folder, "call_sites"), "callee_name").select(F.col("k").alias("callee_name"), "n_rows")


def _p4(spark: SparkSession, folder: str) -> DataFrame:
    anchors = table(spark, folder, "callable_anchors")
    parent = F.explode(F.array(F.struct(F.lit("caller_entity_key").alias("field"), F.lower("entity_key").alias("key")), F.struct(F.lit("callee_name").alias("field"), F.col("name").alias("key"))))
    parents = anchors.select(parent.alias("x"), F.col("generation").alias("since"), F.col("retired_generation").alias("until")).select("x.field", "x.key", "since", "until")
    return orphans.find_orphans(table(spark, folder, "call_sites"), parents, row_id="id", period="generation", fields={"caller_entity_key": "lower(caller_entity_key)", "callee_name": "callee_name"})


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """References of call sites to callables that do not exist in their generation."""
    return _p4(spark, folder).select(F.col("field").alias("ref_field"), F.col("period").cast("int").alias("generation"), F.col("row_id").alias("site_id"))


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references per field and generation."""
    return orphans.orphan_report(_p4(spark, folder)).select(F.col("field").alias("ref_field"), F.col("period").cast("int").alias("generation"), "n_orphans")


_STAND = """
with last as (select generation, file_id, max_by(revision_id, delivered_at) filter (where revision_id is not null) r, max(delivered_at) filter (where revision_id is not null) d, max(delivered_at) a
              from active_file_revisions where generation is not null and file_id is not null group by 1, 2),
 pick as (select generation, file_id, r as revision_id from last where d = a),
 gens as (select generation, row_number() over (order by generation) idx, lead(generation) over (order by generation) nxt from (select distinct generation from active_file_revisions)),
 hashes as (select id, max(lower(hash)) h from file_revisions group by 1),
 live as (select p.file_id, g.idx, g.generation, g.nxt, coalesce(h.h, '-') h from pick p join gens g using (generation) left join hashes h on h.id = p.revision_id)
"""

P1_FOUND_SQL = (
    _STAND
    + """
select a.generation, a.file_id, case when b.file_id is null then 'added' else 'changed' end as change_kind
from live a left join live b on b.file_id = a.file_id and b.idx = a.idx - 1 where a.idx > 1 and (b.file_id is null or b.h <> a.h)
union all
select a.nxt, a.file_id, 'removed' from live a left join live b on b.file_id = a.file_id and b.idx = a.idx + 1 where a.nxt is not null and b.file_id is null
"""
)

P1_INTERVALS_SQL = (
    _STAND
    + """
select file_id, min(generation) as first_generation, max(generation) as last_generation, nullif(h, '-') as hash
from (select *, sum(s) over (partition by file_id order by idx) island from
 (select *, case when lag(idx) over w = idx - 1 and lag(h) over w = h then 0 else 1 end s from live window w as (partition by file_id order by idx)))
group by file_id, island, h
"""
)

P2_FOUND_SQL = """
with runs as (select id, max(last_delivery) upto, lag(max(last_delivery)) over (order by id) before from index_builds where state = 'published' group by id),
 st as (select r.id build_id, r.upto, r.before, e.id file_id, arg_max(struct_pack(h := e.hash, s := e.size), e.indexed_at) now,
          arg_max(struct_pack(h := e.hash, s := e.size), e.indexed_at) filter (where e.delivery_no <= r.before) was, count(*) filter (where e.delivery_no <= r.before) had
        from runs r join file_entries e on e.delivery_no <= r.upto group by 1, 2, 3, 4)
select build_id, file_id from st where had = 0 or now.h is distinct from was.h or now.s is distinct from was.s
"""

P3_FOUND_SQL = """
select 'call_sites' as table_name, callee_name as key_value from call_sites where callee_name is not null group by 2 having count(*) >= 0.02 * (select count(*) from call_sites)
union all
select 'callable_anchors', name from callable_anchors where name is not null group by 2 having count(*) >= 0.02 * (select count(*) from callable_anchors)
"""

P3_COUNTS_SQL = "select callee_name, count(*) as n_rows from call_sites group by 1"

P3_RUNS_SQL = """
with r as (select callee_name, generation, row_number() over () as n from call_sites),
 w as (select *, row_number() over (partition by callee_name order by n) as k, count(*) over (partition by callee_name) as m, lag(generation) over (partition by callee_name order by n) as p from r)
select callee_name, count(*) as n_rows, count(*) filter (where k = 1 or generation is distinct from p) as n_runs, max(generation) filter (where k = 1) as first_generation, max(generation) filter (where k = m) as last_generation from w group by 1
"""

P4_FOUND_SQL = """
select distinct 'caller_entity_key' as ref_field, generation, id as site_id from call_sites s where caller_entity_key is not null and generation is not null and not exists
 (select 1 from callable_anchors a where lower(a.entity_key) = lower(s.caller_entity_key) and a.generation <= s.generation and (a.retired_generation is null or a.retired_generation > s.generation))
union all
select distinct 'callee_name', generation, id from call_sites s where callee_name is not null and generation is not null and not exists
 (select 1 from callable_anchors a where a.name = s.callee_name and a.generation <= s.generation and (a.retired_generation is null or a.retired_generation > s.generation))
"""

QUERIES = {"p1_found": p1_found, "p1_intervals": p1_intervals, "p2_found": p2_found, "p3_found": p3_found, "p3_callee_counts": p3_callee_counts, "p3_callee_runs": p3_callee_runs, "p4_found": p4_found, "p4_report": p4_report}
SQL = {
    "p1_found": P1_FOUND_SQL,
    "p1_intervals": P1_INTERVALS_SQL,
    "p2_found": P2_FOUND_SQL,
    "p3_found": P3_FOUND_SQL,
    "p3_callee_counts": P3_COUNTS_SQL,
    "p3_callee_runs": P3_RUNS_SQL,
    "p4_found": P4_FOUND_SQL,
    "p4_report": f"select ref_field, generation, count(*) as n_orphans from ({P4_FOUND_SQL}) group by 1, 2",
}
