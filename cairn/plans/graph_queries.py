"""Queries over includes, packages and reachability: J2, J9 to J15, A17 to A19, G1 to G7, S3, S11, S12, X16, F8, P7, P8, P14, P15."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.common import kept, table
from cairn.functions import paths as P
from cairn.operators import graph, includes, packages
from cairn.plans.base import FILES_SQL, INCLUDES_SQL, files, include_lines, raw_includes

ROOTS = ("/opt/sdk", "/usr/include")
#: Tables that the include graph is made of.
GRAPH_TABLES = ("source_texts", "call_sites", "callable_anchors")


def _resolved(spark: SparkSession, folder: str) -> DataFrame:
    lines = kept(spark, folder, GRAPH_TABLES, "includes", lambda: include_lines(spark, folder))
    return includes.resolve_includes(lines, files(spark, folder), ROOTS)


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    return includes.include_edges(_resolved(spark, folder), files(spark, folder))


_FORM = "(select src, target_text, case when regexp_extract(target_text, '^[^\"<]*([\"<])', 1) = '\"' then nullif(regexp_extract(target_text, '\"([^\"]*)\"', 1), '') when regexp_extract(target_text, '^[^\"<]*([\"<])', 1) = '<' then nullif(regexp_extract(target_text, '<([^>]*)>', 1), '') end as rel, case regexp_extract(target_text, '^[^\"<]*([\"<])', 1) when '\"' then 'quote' when '<' then 'angle' end as form, regexp_replace(src, '/?[^/]*$', '') as folder from " + INCLUDES_SQL + ")"
_RESOLVED = f"""(with f as (select path from {FILES_SQL}), i as (select src, target_text, trim(rel) rel, case when rel is not null then form end form, folder from {_FORM}),
 k as (select src, target_text, 0 as rank, folder || '/' || rel as key, 'relative_exact' as kind from i where form = 'quote' and folder <> ''
  union all select src, target_text, case form when 'quote' then 1 else 4 end, rel, 'workspace_exact' from i
  union all select src, target_text, 2, '/opt/sdk/' || rel, 'external_exact' from i union all select src, target_text, 3, '/usr/include/' || rel, 'external_exact' from i),
 e as (select src, target_text, arg_min(kind, rank) kind, arg_min(key, rank) dst from k where key in (select path from f) group by 1, 2),
 s as (select i.src, i.target_text, count(distinct p.path) n, min(p.path) least from i join {FILES_SQL} p on p.source = 'workspace' and (p.path = i.rel or ends_with(p.path, '/' || i.rel)) group by 1, 2)
 select i.src, i.target_text, i.rel, case when e.dst is not null or coalesce(s.n, 0) = 1 then 'edge' when s.n > 1 then 'ambiguous' else 'unresolved' end as status,
  case when e.dst is not null then e.kind when s.n >= 1 then 'suffix_match' end as kind, case when e.dst is not null then e.dst when s.n = 1 then s.least end as dst, case when e.dst is not null then 1 else coalesce(s.n, 0) end as n_candidates
 from i left join e using (src, target_text) left join s using (src, target_text))"""
_EDGES = f"""(select src, dst, coalesce(min(kind) filter (where kind = 'relative_exact'), min(kind) filter (where kind = 'workspace_exact'), min(kind) filter (where kind = 'external_exact'), 'suffix_match') as resolution from (
 select src, dst, kind from {_RESOLVED} where status = 'edge' union all select r.src, p.path, 'suffix_match' from {_RESOLVED} r join {FILES_SQL} p on p.source = 'workspace' and (p.path = r.rel or ends_with(p.path, '/' || r.rel)) where r.status = 'ambiguous') where src <> dst group by 1, 2)"""


def j10_include_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """Each include with the tier that resolves it."""
    return _resolved(spark, folder).drop("rel")


def j11_include_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Include edges, the strongest per pair."""
    return _edges(spark, folder)


def j2_edge_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Edges over file ids looked up at both ends."""
    ids = table(spark, folder, "source_texts").select("path", "file_id").where("path is not null").groupBy("path").agg(F.min("file_id").alias("file_id"))
    s, d = ids.select(F.col("path").alias("src"), F.col("file_id").alias("src_id")), ids.select(F.col("path").alias("dst"), F.col("file_id").alias("dst_id"))
    return _edges(spark, folder).join(s, "src").join(d, "dst").select("src_id", "dst_id", "resolution")


def j9_directly_included(spark: SparkSession, folder: str) -> DataFrame:
    """External files with the flag that a workspace file includes them."""
    return includes.directly_included(_edges(spark, folder), files(spark, folder))


def j12_affected_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Sources to look at again when every tenth file changes."""
    changed = table(spark, folder, "source_texts").where("file_id % 10 = 0 and path is not null").select("path")
    return includes.affected_sources(raw_includes(spark, folder), changed)


def a17_external_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct external targets."""
    return _edges(spark, folder).where("resolution = 'external_exact'").select("dst").distinct()


def a18_open_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Unresolved and ambiguous includes per file."""
    return includes.open_counts(_resolved(spark, folder))


def a19_external_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Number of sources per direct external target."""
    return graph.direct_external(_edges(spark, folder)).groupBy("dst").agg(F.count("*").alias("n_sources"))


def x16_include_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Form and path of each include."""
    t = F.col("target_text")
    return raw_includes(spark, folder).select("target_text").distinct().select("target_text", P.include_form(t).alias("form"), P.include_path(t).alias("rel"))


def _origins(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "source_texts").where("file_id % 100 = 0 and path is not null").select(F.col("path").alias("origin")).distinct()


def graph_of(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The resolved includes and the include edges, written once for a state of the tables."""
    resolved = kept(spark, folder, GRAPH_TABLES, "resolved", lambda: _resolved(spark, folder).select("src", "rel", "status", "kind", "dst"))
    return resolved, kept(spark, folder, GRAPH_TABLES, "edges", lambda: includes.include_edges(resolved, files(spark, folder)))


def reach_of(spark: SparkSession, folder: str, origins: DataFrame, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files (of ``wanted``, rows ``origin, path``, if given) and scopes of the reach of ``origin``s, and the first-layer external targets of all files."""
    resolved, edges = graph_of(spark, folder)
    return *graph.reach(origins, edges, includes.open_nodes(resolved), wanted=wanted), graph.direct_external(edges)


def provable(spark: SparkSession, folder: str, pairs: DataFrame) -> DataFrame:
    """Those of the ``pairs``, ``(origin, path)``, that the reach can prove: a proven way leaves the origin and arrives at the file by edges that are no guesses. The others need no search."""
    return graph.provable(pairs, graph_of(spark, folder)[1])


def _reach(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return reach_of(spark, folder, _origins(spark, folder))[:2]


def g1_reach_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files reached from the stated origins (file ids divisible by 100)."""
    return _reach(spark, folder)[0]


def g1_reach_scopes(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the scopes of the stated origins are open, and why."""
    return _reach(spark, folder)[1]


def g3_visit_order(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of each source in visiting order."""
    return graph.normalized_edges(_edges(spark, folder))


def g4_open_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """The reason that stands for each open file."""
    return includes.open_nodes(_resolved(spark, folder))


def g5_direct_external(spark: SparkSession, folder: str) -> DataFrame:
    """First-layer external targets."""
    return graph.direct_external(_edges(spark, folder))


def g6_refreshed_graph(spark: SparkSession, folder: str) -> DataFrame:
    """The graph after every tenth source has lost its edges of odd length."""
    e = _edges(spark, folder)
    src = table(spark, folder, "source_texts").where("file_id % 10 = 0 and path is not null").select(F.col("path").alias("src"))
    return graph.replaced_sources(e, e.where("length(dst) % 2 = 0"), src)


def g7_request_overlay(spark: SparkSession, folder: str) -> DataFrame:
    """Request overrides over the base graph: the stated origins have but weak edges."""
    e = _edges(spark, folder)
    fresh = e.select("src", "dst", F.lit("suffix_match").alias("resolution"))
    return graph.replaced_sources(e, fresh, _origins(spark, folder).select(F.col("origin").alias("src")))


# --- Go packages ------------------------------------------------------------------------------------------------
def _go_files(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "source_texts").where("path is not null and endswith(path, '.go') and text is not null and not startswith(path, '/')")
    name = F.regexp_extract("text", r"(?m)^package[ \t]+(\w+)", 1)
    return t.select("path", "text", P.dirname(F.col("path")).alias("dir"), name.alias("name")).where("name <> ''").withColumn("package", packages.package_key(F.col("path"), F.col("name")))


def _modules(spark: SparkSession, folder: str) -> DataFrame:
    top = F.split("path", "/")[0]
    return files(spark, folder).where("source = 'workspace'").select(top.alias("dir")).distinct().select("dir", F.concat("dir", F.lit(".example")).alias("module"))


def _packages(spark: SparkSession, folder: str) -> DataFrame:
    return _go_files(spark, folder).select("package", "dir", "name").distinct()


def _importable(spark: SparkSession, folder: str) -> DataFrame:
    return packages.import_paths(_packages(spark, folder), _modules(spark, folder))


def _imports(spark: SparkSession, folder: str) -> DataFrame:
    """Import lines, and for each package its siblings' directories as if imported."""
    g = _go_files(spark, folder)
    lines = g.select(F.col("package").alias("src"), F.explode(F.regexp_extract_all("text", F.lit(r'(?m)^\t"([^"\n]*)"\r?$'), F.lit(1))).alias("import_path"))
    siblings = g.select(F.col("package").alias("src"), F.concat(F.split("dir", "/")[0], F.lit(".example/"), F.when(F.length("package") % 2 == 0, "net").otherwise("src")).alias("import_path"))
    return lines.unionByName(siblings).distinct()


def j14_import_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Import path of each package by its nearest module."""
    return _importable(spark, folder)


def j13_package_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of the package graph."""
    return packages.package_edges(_imports(spark, folder), _importable(spark, folder))[0]


def j13_open_packages(spark: SparkSession, folder: str) -> DataFrame:
    """Packages with imports that lead nowhere or to several."""
    return packages.package_edges(_imports(spark, folder), _importable(spark, folder))[1]


def g2_package_reach(spark: SparkSession, folder: str) -> DataFrame:
    """Files reached from the packages of the files with ids divisible by 100."""
    e = packages.package_edges(_imports(spark, folder), _importable(spark, folder))[0]
    m = _go_files(spark, folder).select("package", "path")
    o = m.join(_origins(spark, folder).withColumnRenamed("origin", "path"), "path", "left_semi").select(F.col("package").alias("origin")).distinct()
    return graph.package_reach(o, e, m)


def j15_nearest_project(spark: SparkSession, folder: str) -> DataFrame:
    """Deepest directory at or above each file among the top ones and every second one of the second level."""
    f = files(spark, folder).where("source = 'workspace'").select("path")
    d = f.select(P.dirname(F.col("path")).alias("dir")).distinct()
    owners = d.select(F.split("dir", "/")[0].alias("dir")).unionByName(d.where("length(dir) % 2 = 0")).distinct().withColumn("value", F.col("dir"))
    return packages.nearest_ancestor(f, owners, fold_case=True).select("path", "dir")


def p14_header_jump(spark: SparkSession, folder: str) -> DataFrame:
    """Where the includes of the stated origins lead."""
    r = _resolved(spark, folder)
    return r.join(_origins(spark, folder).withColumnRenamed("origin", "src"), "src", "left_semi").where("dst is not null").select("src", "target_text", "dst", "kind")


def p8_import_completion(spark: SparkSession, folder: str) -> DataFrame:
    """The first hundred import paths under each of two prefixes."""
    p = _importable(spark, folder).where("import_path is not null").select("import_path").distinct()
    found = [p.where((F.col("import_path") >= a) & (F.col("import_path") < a[:-1] + chr(ord(a[-1]) + 1))).orderBy("import_path").limit(100).select(F.lit(a).alias("prefix"), "import_path") for a in ("harborlight.", "t")]
    return found[0].unionByName(found[1])


_OPEN = f"(select src, case when count(*) filter (where status = 'unresolved') > 0 then 'unresolved_include' else 'ambiguous_include' end as reason from {_RESOLVED} where status <> 'edge' group by 1)"


def reach_sql(origins: str) -> str:
    """Common tables ``edges_``, ``files`` and ``scopes`` of the reach of the rows ``(origin)``: level by level in visiting order, each round carrying on what is known."""
    return f"""with recursive edges_ as materialized (select * from {_EDGES}), opened as materialized (select * from {_OPEN}),
 steps as materialized (select src, dst, resolution = 'suffix_match' as step_weak, row_number() over (partition by src order by (resolution <> 'external_exact')::int, dst) as place from edges_),
 s(round, origin, node, weak, depth, rank, fresh) as (select 0, origin, origin, false, 0, 1::bigint, true from (select distinct origin from {origins} where origin is not null)
  union all
  select * from (with c as (select s.round, s.origin, e.dst as node, s.weak or e.step_weak as weak, s.rank as parent, s.rank * 4098 + e.place as seq_ from s join steps e on e.src = s.node where s.depth = s.round and s.fresh is not null and s.round < 32),
   k as (select origin, node, bool_or(not weak) as proven from s where fresh is not null group by 1, 2), n as (select origin, count(*) n from k group by 1),
   c1 as (select c.*, k.node is not null as is_known, coalesce(k.proven, false) as proven, min(seq_) over (partition by c.origin, c.node) as fst from c left join k on k.origin = c.origin and k.node = c.node),
   c2 as (select c1.*, n.n + count(*) filter (where not is_known and seq_ = fst) over (partition by c1.origin order by seq_) as there from c1 join n on n.origin = c1.origin),
   c3 as (select *, not is_known and max(there) filter (where seq_ = fst) over (partition by origin, node) > 4096 as refused from c2),
   c4 as (select *, min(seq_) filter (where refused) over (partition by origin, parent) as stop from c3),
   c5 as (select *, min(seq_) filter (where not refused and not weak) over (partition by origin, node) as sf from c4 where stop is null or seq_ <= stop)
   select round + 1, origin, node, weak, depth, rank, fresh from s where exists (select 1 from c)
   union all select round + 1, origin, node, weak, round + 1, row_number() over (partition by origin order by seq_), case when not refused then not is_known end from c5
    where (refused and seq_ = stop) or (not refused and ((not is_known and seq_ = fst) or (not proven and seq_ = sf))))),
 reached as materialized (select * from s where round = (select max(round) from s)),
 files as materialized (select origin, node as path, bool_and(weak) as is_heuristic, min(depth) as depth from reached where fresh is not null group by 1, 2),
 causes as (select origin, depth, rank, reason from reached join opened on src = node where fresh is not null union all select origin, depth, rank, 'node_limit' from reached where fresh is null
  union all select origin, 33, rank, 'depth_limit' from reached where depth = 32 and fresh is not null),
 scopes as materialized (select o.origin, c.reason is not null as open, c.reason from (select distinct origin from files) o left join (select origin, arg_min(reason, depth::bigint * 1000000000 + rank) as reason from causes group by 1) c using (origin))"""


_REACH = reach_sql("(select path as origin from source_texts where file_id % 100 = 0)")
_GO = r"""(select path, text, regexp_replace(path, '/?[^/]*$', '') as dir, regexp_extract(text, '(?m)^package[ \t]+(\w+)', 1) as name, regexp_replace(path, '/?[^/]*$', '') || '#' || regexp_extract(text, '(?m)^package[ \t]+(\w+)', 1) as package
 from source_texts where ends_with(path, '.go') and text is not null and not starts_with(path, '/') and regexp_extract(text, '(?m)^package[ \t]+(\w+)', 1) <> '')"""
_IMPORTABLE = f"(select distinct package, dir, split_part(dir, '/', 1) || '.example' || substr(dir, length(split_part(dir, '/', 1)) + 1) as import_path from {_GO} where name <> 'main' and not ends_with(name, '_test'))"
_IMPORTS = rf"""(select distinct * from (select package as src, unnest(regexp_extract_all(text, '(?m)^\t"([^"\n]*)"\r?$', 1)) as import_path from {_GO}
 union all select package, split_part(dir, '/', 1) || '.example/' || case when length(package) % 2 = 0 then 'net' else 'src' end from {_GO}))"""
_JUDGED = f"(select i.src, i.import_path, n from {_IMPORTS} i left join (select import_path, count(distinct package) n from {_IMPORTABLE} group by 1) using (import_path))"
_PEDGES = f"(select j.src, p.package as dst, min(case when n = 1 then 'exact' else 'heuristic' end) as resolution from {_JUDGED} j join (select distinct package, import_path from {_IMPORTABLE}) p using (import_path) where j.import_path <> 'C' and j.src <> p.package group by 1, 2)"
_OWNERS = "(select distinct dir from (select split_part(path, '/', 1) as dir from source_texts where not starts_with(path, '/') union all select d from (select regexp_replace(path, '/?[^/]*$', '') d from source_texts where not starts_with(path, '/')) where length(d) % 2 = 0))"

QUERIES = {
    "j10_include_resolution": j10_include_resolution, "j11_include_edges": j11_include_edges, "j2_edge_paths": j2_edge_paths, "j9_directly_included": j9_directly_included, "j12_affected_sources": j12_affected_sources,
    "a17_external_targets": a17_external_targets, "a18_open_counts": a18_open_counts, "a19_external_sources": a19_external_sources, "x16_include_targets": x16_include_targets,
    "g1_reach_files": g1_reach_files, "g1_reach_scopes": g1_reach_scopes, "g3_visit_order": g3_visit_order, "g4_open_reasons": g4_open_reasons, "g5_direct_external": g5_direct_external, "g6_refreshed_graph": g6_refreshed_graph, "g7_request_overlay": g7_request_overlay,
    "j14_import_paths": j14_import_paths, "j13_package_edges": j13_package_edges, "j13_open_packages": j13_open_packages, "g2_package_reach": g2_package_reach, "j15_nearest_project": j15_nearest_project, "q_p14_header_jump": p14_header_jump, "q_p8_import_completion": p8_import_completion,
}

SQL = {
    "g2_package_reach": f"""with recursive pe as materialized (select * from {_PEDGES}), mem as materialized (select distinct package, path from {_GO}), o as (select distinct package as origin from mem where path in (select path from source_texts where file_id % 100 = 0)),
 s(round, origin, node, weak, depth) as (select 0, origin, origin, false, 0 from o
  union all
  select * from (with n as (select s.round, s.origin, pe.dst as node, min((s.weak or pe.resolution <> 'exact')::int) = 1 as weak from s join pe on pe.src = s.node where s.depth = s.round and s.round < 32 and not exists (select 1 from s k where k.origin = s.origin and k.node = pe.dst) group by 1, 2, 3)
   select round + 1, origin, node, weak, depth from s where exists (select 1 from n) union all select round + 1, origin, node, weak, round + 1 from n))
 select s.origin, m.path, bool_and(s.weak) as is_heuristic from s join mem m on m.package = s.node where round = (select max(round) from s) group by 1, 2""",
    "j10_include_resolution": f"select src, target_text, status, kind, dst, n_candidates from {_RESOLVED}",
    "j11_include_edges": f"select * from {_EDGES}",
    "j2_edge_paths": f"with ids as (select path, min(file_id) file_id from source_texts where path is not null group by 1) select s.file_id as src_id, d.file_id as dst_id, resolution from {_EDGES} e join ids s on s.path = e.src join ids d on d.path = e.dst",
    "j9_directly_included": f"select f.path, f.path in (select e.dst from {_EDGES} e join {FILES_SQL} w on w.path = e.src and w.source = 'workspace' where e.resolution = 'external_exact') as directly_included from {FILES_SQL} f where f.source = 'external'",
    "j12_affected_sources": f"with c as (select path, regexp_extract(path, '([^/]*)$', 1) base from source_texts where file_id % 10 = 0 and path is not null) select distinct src from (select src, trim(rel) rel from {_FORM}) where regexp_extract(rel, '([^/]*)$', 1) in (select base from c) or rel in (select path from c)",
    "a17_external_targets": f"select distinct dst from {_EDGES} where resolution = 'external_exact'",
    "a18_open_counts": f"select src, count(*) filter (where status = 'unresolved') as unresolved_includes, count(*) filter (where status = 'ambiguous') as ambiguous_includes from {_RESOLVED} where status <> 'edge' group by 1",
    "a19_external_sources": f"select dst, count(distinct src) as n_sources from {_EDGES} where resolution = 'external_exact' and starts_with(dst, '/') group by 1",
    "x16_include_targets": f"select distinct target_text, case when rel is not null then form end as form, trim(rel) as rel from {_FORM}",
    "g1_reach_files": f"{_REACH} select * from files",
    "g1_reach_scopes": f"{_REACH} select * from scopes",
    "g3_visit_order": f"select src, row_number() over (partition by src order by case when resolution = 'external_exact' then 0 else 1 end, dst, resolution) - 1 as position, dst, resolution from {_EDGES}",
    "g4_open_reasons": f"select * from {_OPEN}",
    "g5_direct_external": f"select src, dst from {_EDGES} where resolution = 'external_exact' and starts_with(dst, '/')",
    "g6_refreshed_graph": f"select * from {_EDGES} where src not in (select path from source_texts where file_id % 10 = 0 and path is not null) or length(dst) % 2 = 0",
    "g7_request_overlay": f"select src, dst, case when src in (select path from source_texts where file_id % 100 = 0 and path is not null) then 'suffix_match' else resolution end as resolution from {_EDGES}",
    "j14_import_paths": f"select * from {_IMPORTABLE}",
    "j13_package_edges": f"select * from {_PEDGES}",
    "j13_open_packages": f"select src, case min(case when import_path = 'C' then 0 when n is null then 1 else 2 end) when 0 then 'boundary' when 1 then 'unresolved_import' else 'ambiguous_import' end as reason from {_JUDGED} where import_path = 'C' or n is null or n > 1 group by 1",
    "j15_nearest_project": f"select f.path, max_by(o.dir, length(o.dir)) as dir from {FILES_SQL} f join {_OWNERS} o on starts_with(lower(f.path), lower(o.dir) || '/') where f.source = 'workspace' group by 1",
    "q_p14_header_jump": f"select src, target_text, dst, kind from {_RESOLVED} where dst is not null and src in (select path from source_texts where file_id % 100 = 0)",
    "q_p8_import_completion": f"select prefix, import_path from (select p.prefix, i.import_path, row_number() over (partition by p.prefix order by i.import_path) r from (select distinct import_path from {_IMPORTABLE}) i join (values ('harborlight.'), ('t')) p(prefix) on starts_with(i.import_path, p.prefix)) where r <= 100",
}
