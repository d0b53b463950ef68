"""The remaining lines of the inventory as queries of their own: S4, S10, S13, J23, W5, T12, X10, X25, X26, X32, X34, E2, P1, P4, P7, P16, R3, R6, R7, R9."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.common import cut, fresh_folder, table
from cairn.functions import cursor as U
from cairn.functions import ranking as R
from cairn.operators import callables as C
from cairn.operators import candidates as K
from cairn.operators import files as FL
from cairn.operators import search
from cairn.operators import versions as V
from cairn.plans import callable_queries as CQ
from cairn.plans import fact_queries as FQ
from cairn.plans import graph_queries as GQ
from cairn.plans import name_queries as NQ
from cairn.plans import version_queries as VQ
from cairn.plans.base import LIVE_SQL, SITES_SQL, live_anchors, sites
from cairn.sources import extract as X
from cairn.streaming import generations as G


def s4_external_modules(spark: SparkSession, folder: str) -> DataFrame:
    """Go files below each module root, roots over a cap left out whole."""
    e = VQ._entries(spark, folder).where("lower(extension) = 'go'").withColumn("root", F.split("path", "/")[0])
    return FL.capped_roots(e).select("root", "path")


def s10_proto_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Packages and messages per protocol definition."""
    return FQ.e13_proto_declarations(spark, folder).groupBy("path", "kind").agg(F.count("*").alias("n"))


def s13_staged_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Call sites written in staged batches by generation, and what a reader of three of them finds."""
    store = G.GenerationStore(spark, fresh_folder(spark, "sites"))
    store.publish(sites(spark, folder).select("id", "callee_name", "generation"), ["generation"])
    return store.read().where("generation in (1, 2, 3)").groupBy("generation").agg(F.count("*").alias("n"))


def j23_scope_tiers(spark: SparkSession, folder: str) -> DataFrame:
    """Tier of each candidate of the stated names."""
    return CQ._candidates(spark, folder).select("query", "id", "tier")


def _colorable(spark: SparkSession, folder: str) -> DataFrame:
    """Macros, types and enumerators that bear a name used in a stated file (ids divisible by 100) and lie in its colouring scope: ``current, name, label, path``."""
    stated = FQ._texts(spark, folder).where("file_id % 100 = 0")
    words = U.apply(stated, ["path", "text"], lambda p, x: [(w,) for w in X.extract_words(x, p.lower().endswith(".go"))], "word string", pa.schema([("word", pa.string())]), ["path"])
    label = F.when(F.col("kind").isin("type", "alias"), "type").when(F.col("kind") == "macro", "macro").when(F.col("kind") == "enum_constant", "enum_member")
    found = FQ._facts(spark, folder, "declaration").select("name", label.alias("label"), "path", F.startswith("path", F.lit("/")).alias("external")).where("label is not null")
    used = words.select(F.col("path").alias("current"), F.col("word").alias("name")).distinct().join(found, "name")
    used = K.with_tiers(used, *GQ.reach_of(spark, folder, stated.select(F.col("path").alias("origin")).distinct()))
    return used.where(R.coloring_allowed(F.col("tier"), F.col("in_heuristic"))).select("current", "name", "label", "path")


def a4_scoped_kind_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Colourable kinds of the names of each stated file, counted over its colouring scope."""
    return _colorable(spark, folder).groupBy("current", "name", "label").agg(F.count("*").alias("n"))


def a5_dominant_kind(spark: SparkSession, folder: str) -> DataFrame:
    """The kind that colours each name: the one that most declarations have, those of the file itself before all others; nothing on a tie."""
    return K.dominant_kind(_colorable(spark, folder).withColumn("own", (F.col("path") == F.col("current")).cast("int")), ["current", "name"])


def w5_degrees(spark: SparkSession, folder: str) -> DataFrame:
    """Links of each definition and header declaration."""
    return CQ.j16_counterparts(spark, folder).where("degree > 0").select("id", "degree")


def t12_fallback_order(spark: SparkSession, folder: str) -> DataFrame:
    """Fallback members in their order."""
    return FQ.a11_fallback_members(spark, folder).select("position", "lower_name", "kind")


def x10_scope_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of the tiers and confidences that occur."""
    c = CQ.x8_confidence(spark, folder).select("tier", "confidence").distinct()
    return c.withColumn("label", R.scope_label(F.col("tier"), F.col("confidence")))


def x25_signature_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """Arity of all function definitions of the indexed texts of the workspace (external ones count as declarations)."""
    return FQ.indexed_callables(spark, folder).where("role = 'definition' and not startswith(path, '/')").select("file_id", "name", "start_byte", "signature", "min_arity", "max_arity", "variadic")


def x26_canonical_signatures(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical signatures of all function definitions of the indexed texts of the workspace by number of bearers."""
    return FQ.indexed_callables(spark, folder).where("role = 'definition' and not startswith(path, '/')").groupBy("canonical_signature").agg(F.count("*").alias("n"))


def _labelled_reach(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """What tiers and pairings need of the include graph, by one search from the current files of the candidates and the sources of the pairings: files, scopes, direct external targets; the candidates' ``(current, path, external)``; the anchors."""
    a = cut(CQ.live_anchors(spark, folder).select("id", "name", "path", "external", "kind", "role", "qualified_name", "canonical_signature", "owner_kind", "linkage_kind", "signature_fidelity"))
    rows = cut(CQ.asked_anchors(a)[1].select("current", "path", "external").distinct())
    pairs = GQ.provable(spark, folder, C.counterpart_paths(a).toDF("origin", "path"))
    # The tier of the current file itself needs no search.
    asked = cut(rows.where("path <> current").select(F.col("current").alias("origin"), "path").unionByName(pairs).distinct())
    return *GQ.reach_of(spark, folder, asked.select("origin"), asked), rows, a


def x32_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Visibility of each tier and label of each pairing that occurs."""
    reached, scopes, direct, rows, a = _labelled_reach(spark, folder)
    tiers = K.with_tiers(rows, reached, scopes, direct).select("tier").distinct().select(F.col("tier").alias("value"), R.lookup(F.col("tier"), R.VISIBILITY).alias("label"))
    proven = reached.where("not is_heuristic").select(F.col("origin").alias("source_path"), F.col("path").alias("header_path"))
    pairs = C.counterparts(a, proven).select("evidence", "degree").distinct()
    return tiers.unionByName(pairs.select(F.concat_ws(":", "evidence", F.col("degree").cast("string")).alias("value"), R.pairing_label(F.col("evidence"), F.col("degree")).alias("label")))


def x34_builtins(spark: SparkSession, folder: str) -> DataFrame:
    """Built-in scalar functions over the anchors' names."""
    n = F.col("name")
    return live_anchors(spark, folder).where("name is not null").select("id", F.lower(n).alias("low"), F.hex(F.substring(n, 1, 2)).alias("hexed"), F.decode(F.unhex(F.hex(n)), "UTF-8").alias("back"), F.length(n).alias("size"), F.coalesce("owner", n).alias("owner_or_name"))


def e2_visited_files(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of each C and C++ file from one pass."""
    t = FQ._texts(spark, folder).where("not endswith(path, '.go')")
    return X.parse_files(t, file_id="revision_id", path="path", text="text").groupBy("file_id").agg(*[F.count(F.when(F.col("fact") == k, 1)).alias(k) for k in ("include", "declaration", "callable", "call", "member", "record", "type_alias", "local")])


def p1_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Workspace symbols for the query scan, 200 at most."""
    return search.ranked(NQ._in_context(spark, folder), ["scan_re"], 200).select("position", "id", "packed")


def p4_calls(spark: SparkSession, folder: str) -> DataFrame:
    """First page of a hundred callers of each stated entity, by key."""
    asked = CQ._anchors(spark, folder).where("id % 100 = 0").select(F.col("entity").alias("callee")).distinct()
    r = CQ.a12_relations(spark, folder).join(asked, "callee", "left_semi")
    return C.relation_page(r, "callee", ["caller", F.col("ambiguity_site").asc_nulls_first(), "confidence"], 0, 100).select("callee", "caller", "confidence", "n_sites", "position", "total")


def p7_include_completion(spark: SparkSession, folder: str) -> DataFrame:
    """Headers offered first to each stated file."""
    return VQ.t13_include_candidates(spark, folder).where("position = 1").select("src", "path")


def p16_index_report(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the index by category."""
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("category"), "n")
    parts = [count(live_anchors(spark, folder), "callables"), count(sites(spark, folder), "call_sites"), count(table(spark, folder, "file_revisions").select("id").distinct(), "revisions"), count(VQ._entries(spark, folder), "files")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def r3_debounced(spark: SparkSession, folder: str) -> DataFrame:
    """The same maintenance with a processing interval instead of one pass, stopped once it has caught up."""
    base = fresh_folder(spark, "debounced")
    store = G.GenerationStore(spark, f"{base}/store")
    rows = G.stream_table(spark, folder, "file_entries").where("id is not null").select("id", "indexed_at", "delivery_no", "delivered_at", "hash", "size", F.lit(False).alias("deleted"))
    query = store.maintain(rows, "id", ["indexed_at", "delivery_no", "delivered_at", "hash"], "deleted", f"{base}/checkpoint", "350 milliseconds")
    query.processAllAvailable()
    query.stop()
    found = store.read()
    return (found if found is not None else table(spark, folder, "file_entries").limit(0)).select("id", "hash", "size")


def r6_pinned_read(spark: SparkSession, folder: str) -> DataFrame:
    """Rows read from a generation while the next one is published, and whether the reader was told."""
    store = G.GenerationStore(spark, fresh_folder(spark, "pinned"))
    a = live_anchors(spark, folder).select("id")
    store.publish(a)
    rows, changed = store.read_pinned(lambda df: (store.publish(a.where("id % 2 = 0")), df.count())[1])
    return spark.createDataFrame([(rows, changed, store.read().count())], "rows_read bigint, changed boolean, rows_now bigint")


def r7_committed(spark: SparkSession, folder: str) -> DataFrame:
    """Files after staged upserts and tombstones were committed as one generation."""
    store = G.GenerationStore(spark, fresh_folder(spark, "committed"))
    active, pending = VQ._pending(spark, folder)
    store.publish(active)
    store.publish(V.effective(store.read(), pending, "id", "deleted"))
    return store.read().select("id", "size")


def r9_live_overlay(spark: SparkSession, folder: str) -> DataFrame:
    """Call sites with those of the stated files (lengths divisible by 11) replaced by what an editor holds: none of generation 1."""
    s = sites(spark, folder).where("path is not null").select("id", "path", "generation")
    own = s.where("length(path) % 11 = 0")
    return s.join(own.select("path").distinct(), "path", "left_anti").unionByName(own.where("generation <> 1").select("path", "id", "generation")).select("id", "path")


QUERIES = {f.__name__: f for f in (a4_scoped_kind_counts, a5_dominant_kind, s4_external_modules, s10_proto_scan, s13_staged_rows, j23_scope_tiers, w5_degrees, t12_fallback_order, x10_scope_labels, x25_signature_shapes, x26_canonical_signatures, x32_labels, x34_builtins, e2_visited_files, r3_debounced, r6_pinned_read, r7_committed, r9_live_overlay)}
QUERIES |= {"q_" + f.__name__: f for f in (p1_symbols, p4_calls, p7_include_completion, p16_index_report)}

_STATED_WORDS = f"(select t.path as current, w.word as name from (select revision_id, path from {FQ._TEXTS} where file_id % 100 = 0) t join ({FQ.SQL['x21_words']}) w using (revision_id))"
_KINDS = f"(select owner as name, 'type' as label, path from {FQ._BODIES} union all select m.name, 'macro', t.path from ({FQ.SQL['e4_macros']}) m join {FQ._TEXTS} t on t.revision_id = m.file_id)"
_COLORABLE = f"(select current, name, label, path from {CQ.tiered_sql(f'(select w.current, k.*, starts_with(k.path, chr(47)) as external from {_STATED_WORDS} w join {_KINDS} k using (name))')} where tier in ('current', 'reachable', 'external') or (tier = 'unknown' and in_heuristic))"
SQL = {
    "a4_scoped_kind_counts": f"select current, name, label, count(*) as n from {_COLORABLE} group by 1, 2, 3",
    "a5_dominant_kind": f"select current, name, case when count(*) = 1 then max(label) end as dominant from (select *, max(n) over (partition by current, name) as most from (select current, name, label, count(*) as n from (select *, max((path = current)::int) over (partition by current, name) as best from {_COLORABLE}) where (path = current)::int = best group by 1, 2, 3)) where n = most group by 1, 2",
    "t12_fallback_order": f"select position, lower_name, kind from {FQ._FALLBACK} where position <= 40",
    "s4_external_modules": f"with e as (select *, split_part(path, '/', 1) as root from {VQ._ENTRIES} where lower(extension) = 'go') select root, path from e where root in (select root from e group by 1 having count(*) <= 20000 and coalesce(sum(size), 0) <= 536870912)",
    "s13_staged_rows": f"select generation, count(*) as n from {SITES_SQL} where generation in (1, 2, 3) group by 1",
    "j23_scope_tiers": f"select query, id, tier from {CQ._CAND}",
    "w5_degrees": f"select id, degree from {CQ._PAIRS} where degree > 0",
    "x10_scope_labels": f"select distinct tier, confidence, label from ({CQ.SQL['x8_confidence']})",
    "x25_signature_shapes": f"select file_id, name, start_byte, signature, min_arity, max_arity, \"variadic\" from {FQ._INDEXED} where role = 'definition'",
    "x26_canonical_signatures": f"select canonical_signature, count(*) as n from {FQ._INDEXED} where role = 'definition' group by 1",
    "x32_labels": f"select distinct tier as value, case tier when 'current' then 'current_visible' when 'reachable' then 'reachable' when 'external' then 'external_first_layer' when 'unknown' then 'uncertain' else 'workspace_fallback' end as label from {CQ._CAND} union all select distinct evidence || ':' || degree, case when evidence = 'ambiguous' then 'ambiguous:' || degree else evidence end from {CQ._PAIRS}",
    "x34_builtins": f"select id, lower(name) as low, hex(substr(name, 1, 2)) as hexed, name as back, length(name) as size, coalesce(owner, name) as owner_or_name from {LIVE_SQL} where name is not null",
    "q_p1_symbols": f"select position, id, packed from (select id, packed, row_number() over (order by {NQ._ORDER}) as position from {NQ._GATED} where needle = 'scan_re') where position <= 200",
    "q_p4_calls": f"select callee, caller, confidence, n_sites, position, total from (select *, row_number() over (partition by callee order by caller, ambiguity_site nulls first, confidence) as position, count(*) over (partition by callee) as total from {CQ._RELATIONS} where callee in (select entity from {CQ._A} where id % 100 = 0)) where position <= 100",
    "q_p7_include_completion": f"select src, path from ({VQ.SQL['t13_include_candidates']}) where position = 1",
    "q_p16_index_report": f"select 'callables' as category, count(*) as n from {LIVE_SQL} union all select 'call_sites', count(*) from {SITES_SQL} union all select 'revisions', count(distinct id) from file_revisions union all select 'files', count(distinct id) from file_entries",
    "r3_debounced": f"select id, hash, size from {VQ._ENTRIES}",
    "r6_pinned_read": f"select count(*) as rows_read, true as changed, count(*) filter (where id % 2 = 0) as rows_now from {LIVE_SQL}",
    "r7_committed": VQ.SQL["j6_effective"],
    "r9_live_overlay": f"select id, path from {SITES_SQL} where path is not null and (length(path) % 11 <> 0 or generation <> 1)",
}
