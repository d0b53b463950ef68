"""Queries over files, revisions and events: S1 to S8, S12, F1, F12, F15 to F17, F19, J1, J6, J7, J19, J24, A1 to A6, A14, A16, A20 to A22, W1, W10, T4, T7, T13, U1 to U3, X13, X31, R1, R2, R9, R10, P3, P7, P15."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.common import table
from cairn.functions import names as N
from cairn.functions import paths as P
from cairn.functions import ranking as R
from cairn.operators import candidates as K
from cairn.operators import files as FL
from cairn.operators import packages, references, snapshots
from cairn.operators import versions as V
from cairn.plans import callable_queries as CQ
from cairn.plans.base import FILES_SQL, LIVE_SQL, SITES_SQL, files, live_anchors, sites
from cairn.sources import extract as X


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    """The state of each file: its row of the last scan."""
    e = table(spark, folder, "file_entries").where("id is not null")
    w = Window.partitionBy("id").orderBy(F.desc("indexed_at"), F.desc("delivery_no"), F.desc("delivered_at"), F.desc_nulls_last("hash"))
    return e.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


_ENTRIES = "(select * from (select *, row_number() over (partition by id order by indexed_at desc, delivery_no desc, delivered_at desc, hash desc nulls last) r_ from file_entries where id is not null) where r_ = 1)"
_STAND = "(select generation, file_id, revision_id from (select *, row_number() over (partition by generation, file_id order by delivered_at desc, revision_id desc nulls last) r_ from active_file_revisions) where r_ = 1)"
_LAST = f"(select file_id, revision_id from {_STAND} where generation = (select max(generation) from active_file_revisions) and revision_id is not null)"


def _active(spark: SparkSession, folder: str) -> DataFrame:
    """``(file_id, revision_id)`` of the newest snapshot."""
    a = table(spark, folder, "active_file_revisions")
    newest = a.agg(F.max("generation")).scalar()
    rows = snapshots.standing_rows(a, period="generation", key="file_id", ref="revision_id", delivered="delivered_at")
    return rows.where((F.col("period") == newest) & F.col("ref").isNotNull()).select(F.col("key").alias("file_id"), F.col("ref").alias("revision_id"))


def s1_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Files in the scope of the workspace that its ignore files (at the top, and in one repository) do not leave out."""
    rules = P.ignore_rules([("", "# generated\ninternal/\n*_test.go\n/tinderlane/app/**/slot*.c\n"), ("wickerdb", "*.h\n!/lib/*.h\n")])
    return files(spark, folder).where(P.in_scope(F.col("path"), exclude=("harborlight/pkg",)) & ~P.ignored(F.col("path"), rules)).select("path")


def s3_capped_roots(spark: SparkSession, folder: str) -> DataFrame:
    """Files of the external roots within both caps; a root over one is left out whole."""
    e = _entries(spark, folder).withColumn("root", F.array_join(F.slice(F.split("path", "/"), 1, 2), "/"))
    return FL.capped_roots(e).select("root", "path")


def s5_scope(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each path is in a scope of two included and one excluded directory."""
    return files(spark, folder).select("path", P.in_scope(F.col("path"), ("Harborlight", "tinderlane"), ("harborlight/net",), ("c", "go")).alias("in_scope"))


def s7_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of each path, two overrides applied."""
    return files(spark, folder).select("path", P.language_for(F.col("path"), [("**/*.h", "cpp"), ("harborlight/**", "c"), ("harborlight/net/*.go", "go")]).alias("language"))


def s8_to_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of the last delivery that differ from what was stored before in path, size, time or extension."""
    e = table(spark, folder, "file_entries")
    e = e.withColumn("last", e.agg(F.max("delivery_no")).scalar())
    keys = ["path", "size", "mtime_ns", "extension"]
    return V.to_parse(e.where("delivery_no = last").select("id", *keys).distinct(), e.where("delivery_no < last"), keys, "mtime_ns").select("id", "path").distinct()


def s12_markers(spark: SparkSession, folder: str) -> DataFrame:
    """Directories with project markers; the markers are made of the files' directories."""
    d = files(spark, folder).where("source = 'workspace'").select(P.dirname(F.col("path")).alias("dir")).distinct()
    name = F.when(F.length("dir") % 3 == 0, "Makefile").when(F.length("dir") % 3 == 1, "go.mod").otherwise("readme.md")
    return packages.project_markers(d.select(F.concat("dir", F.lit("/"), name).alias("path")).unionByName(d.select(F.concat("dir", F.lit("/CMakeLists.txt")).alias("path"))))


def f1_active_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors of the active revisions."""
    return V.active_facts(live_anchors(spark, folder), _active(spark, folder), ["file_id", "revision_id"]).select("id", "file_id", "revision_id")


def j1_active_revisions(spark: SparkSession, folder: str) -> DataFrame:
    """The active revisions with their parse results."""
    r = table(spark, folder, "file_revisions").dropDuplicates(["id"]).select(F.col("id").alias("revision_id"), "language", "parse_error_count")
    return _active(spark, folder).join(r, "revision_id")


def f19_fact_mask(spark: SparkSession, folder: str) -> DataFrame:
    """Revisions whose parse covered calls."""
    return table(spark, folder, "file_revisions").where(F.col("fact_mask").bitwiseAND(128) != 0).select("id").distinct()


def _pending(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    e = _entries(spark, folder).select("id", "path", "size", "hash", "status")
    base = e.where("id % 3 <> 0")
    return base.drop("status"), e.where("id % 5 = 0").select("id", "path", (F.col("size") + 1).alias("size"), "hash", (F.col("status") == "error").alias("deleted"))


def j6_effective(spark: SparkSession, folder: str) -> DataFrame:
    """Files as they will be with the staged changes: upserts and tombstones."""
    return V.effective(*_pending(spark, folder), "id", "deleted").select("id", "size")


def u1_union_all(spark: SparkSession, folder: str) -> DataFrame:
    """Active and pending rows side by side."""
    a, p = _pending(spark, folder)
    return a.select("id", "size").unionByName(p.select("id", "size"))


def j7_obsolete(spark: SparkSession, folder: str) -> DataFrame:
    """Revisions that are not active, not of the last delivery's files and not leased (every fiftieth)."""
    r = table(spark, folder, "file_revisions").select(F.col("id").alias("revision_id"), "file_id").dropDuplicates(["revision_id"])
    staged = r.where("file_id % 10 = 0").select("revision_id")
    return V.obsolete(r, _active(spark, folder), staged, r.where("revision_id % 50 = 0"), "revision_id").select("revision_id")


def j19_overlay(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors with every seventh file's rows replaced by those of an overlay, which renames them."""
    a = live_anchors(spark, folder).where("path is not null").select("id", "path", "name")
    over = a.where("length(path) % 7 = 0").withColumn("name", F.concat(F.lit("new_"), F.col("name")))
    return V.overlaid(a, over, "path")


def j24_merged_roots(spark: SparkSession, folder: str) -> DataFrame:
    """The lists of the first 200 symbols of each root, by name and id, merged into one list of 200: a symbol of several roots once, from the first root."""
    a = live_anchors(spark, folder).where("name is not null and path is not null").select(F.split("path", "/")[0].alias("root"), "name", "id", "qualified_name")
    per = a.withColumn("r", F.row_number().over(Window.partitionBy("root").orderBy("name", "id"))).where("r <= 200")
    merged = per.groupBy("name", "qualified_name").agg(F.min(F.struct("root", "id")).alias("x"), F.count("*").alias("n"))
    return merged.select("name", "x.root", "x.id", "n").orderBy("name", "id").limit(200)


def u2_unreferenced(spark: SparkSession, folder: str) -> DataFrame:
    """Callee names of the dictionary that no live anchor bears as name or qualified name."""
    words = sites(spark, folder).where("callee_name is not null").select(F.col("callee_name").alias("text")).distinct()
    a = live_anchors(spark, folder)
    return V.unreferenced(words, "text", a.select("name"), a.select("qualified_name"))


def u3_missing(spark: SparkSession, folder: str) -> DataFrame:
    """Files of the first delivery that the second did not mention again."""
    e = table(spark, folder, "file_entries")
    return V.missing(e.where("delivery_no = 1"), e.where("delivery_no = 2"), "path")


def a1_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Declarations, external ones, and revisions."""
    revisions = table(spark, folder, "file_revisions").agg(F.countDistinct("id")).scalar()
    return live_anchors(spark, folder).agg(F.count("*").alias("declarations"), F.count(F.when(F.col("external"), 1)).alias("external")).withColumn("revisions", revisions)


def a2_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Per repository: revisions, those that cover calls, with errors, and fallbacks."""
    r = table(spark, folder, "file_revisions").dropDuplicates(["id"])
    some = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    return r.groupBy("repo").agg(F.count("*").alias("revisions"), some(F.col("fact_mask").bitwiseAND(128) != 0).alias("with_calls"), some(F.col("parse_error_count") > 0).alias("with_errors"), some(F.col("fallback_used") > 0).alias("fallbacks"))


def a3_kind_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Definitions of workspace or directly included files by name and kind."""
    a = live_anchors(spark, folder).where("role = 'definition' and (not external or directly_included) and name is not null")
    return a.groupBy("name", "kind").agg(F.count("*").alias("n"))


def a6_largest_path(spark: SparkSession, folder: str) -> DataFrame:
    """The path with the most anchors."""
    return live_anchors(spark, folder).where("path is not null").groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(1)


def _accepts(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.select("user_id", "event_type", N.prefix_bucket(F.coalesce("props", F.lit(""))).alias("bucket"))


def a14_accept_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted completions by user, kind and prefix."""
    return _accepts(spark, folder).groupBy("user_id", "event_type", "bucket").agg(F.count("*").alias("accepts"))


def x13_history_boost(spark: SparkSession, folder: str) -> DataFrame:
    """Boost by what each user accepted of a kind."""
    return _accepts(spark, folder).groupBy("user_id", "event_type").agg(F.count("*").alias("n")).select("user_id", "event_type", R.history_boost(F.col("n")).alias("boost"))


def s15_newest_accepts(spark: SparkSession, folder: str) -> DataFrame:
    """The newest 4096 events of the log."""
    return table(spark, folder, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(4096).select("event_id")


def a16_basename_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Frequency of base names, twenty at most."""
    return files(spark, folder).groupBy(N.lower_ascii(P.basename(F.col("path"))).alias("base")).agg(F.least(F.count("*"), F.lit(20)).alias("freq"))


def a20_size_categories(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes by source and extension, saturated at the greatest long."""
    return _entries(spark, folder).groupBy("source", P.extension(F.col("path")).alias("ext")).agg(F.least(F.sum(F.col("size").cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("bigint").alias("bytes"))


def a21_recall_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates per tier."""
    c = CQ._candidates(spark, folder)
    return c.groupBy("query").agg(*[F.count(F.when(F.col("tier") == t, 1)).alias(t) for t in N.TIERS], F.count("*").alias("total"))


def a22_extensions(spark: SparkSession, folder: str) -> DataFrame:
    """Histogram of extensions."""
    return files(spark, folder).groupBy(P.extension(F.col("path")).alias("ext")).agg(F.count("*").alias("n"))


def w1_focused_candidate(spark: SparkSession, folder: str) -> DataFrame:
    """The first candidate of each group."""
    return K.grouped(CQ._candidates(spark, folder)).where("position = 1").select("query", "group_key", "id")


def t4_declaration_order(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates of each group in their order."""
    return K.grouped(CQ._candidates(spark, folder)).select("query", "group_key", "position", "id")


def w10_relative_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Callee tokens of each file as differences to the one before."""
    s = sites(spark, folder).where("path is not null").select("id", "path", F.col("callee_range.start_line").alias("line"), F.col("callee_range.start_character").alias("start"), (F.col("callee_range.end_character") - F.col("callee_range.start_character")).alias("length"))
    return references.relative_tokens(s, "path", ["line", "start", "id"]).select("id", "delta_line", "delta_start", "length")


def f12_role_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Which roles may colour which kinds."""
    kinds, roles = ("type", "macro", "enum_member", "parameter", "variable"), ("declaration", "definition", "call", "write", "type_use", "read")
    one = table(spark, folder, "subject_areas").limit(1).select(F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind"))
    return one.select("kind", F.explode(F.array(*[F.lit(r) for r in roles])).alias("role")).withColumn("allowed", R.role_allows_color(F.col("kind"), F.col("role")))


def f15_line_range(spark: SparkSession, folder: str) -> DataFrame:
    """Call tokens of the lines 10 to 20."""
    return sites(spark, folder).where(F.col("callee_range.start_line").between(10, 20)).select("id")


def f16_low_trust(spark: SparkSession, folder: str) -> DataFrame:
    """Names whose evidence is of low trust."""
    m = K.merged(CQ._evidence(spark, folder), ["current"])
    return m.where(R.low_trust(F.col("tier"), F.col("confidence"), F.col("sources").rlike("local|overlay"), F.col("sources").contains("word"))).select("current", "name")


def f17_rescue_suppression(spark: SparkSession, folder: str) -> DataFrame:
    """Rescue rows (external ones) of the files' directories; none where eight or more names of the directory itself are there and its scope is closed (even length)."""
    a = live_anchors(spark, folder).where("path is not null and name is not null").withColumn("scope", F.element_at(F.split(P.dirname(F.col("path")), "/"), -1))
    return FL.rescued(a.where("not external"), a.where("external"), "scope", F.length("scope") % 2 == 0, 8).select("scope", "id")


def p3_references(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences of stated names in all texts with place and syntactic role, in the order of role, path, line and column; the first 2000 of each."""
    names = ("log_line", "reset", "slot", "run")
    texts = table(spark, folder, "source_texts").where("text is not null and path is not null")
    held = texts.where(F.col("text").rlike(references.whole_word(names)))
    facts = X.parse_files(held, file_id="revision_id", path="path", text="text", wanted=frozenset(["occurrence"])).where(F.col("name").isin(*names))
    return references.occurrences(texts, facts.select("path", "name", F.col("start_line").alias("line"), F.col("start_character").alias("col"), "role"), names, text="text", path="path", limit=2000)


def t7_reference_order(spark: SparkSession, folder: str) -> DataFrame:
    """Places of the references by role."""
    return p3_references(spark, folder).groupBy("name", "role").agg(F.count("*").alias("n"), F.min("position").alias("first_position"))


def t13_include_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Headers offered to the files with ids divisible by 100, with the boost of directory, frequency and depth."""
    src = table(spark, folder, "source_texts").where("file_id % 100 = 0 and path is not null").select(F.col("path").alias("src")).distinct()
    heads = files(spark, folder).where(R.is_header_path(F.col("path"))).select("path")
    return FL.include_candidates(src, heads, 20).select("src", "path", "boost", "position")


def x31_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Paths below the SDK's root, and an identity of each path."""
    p = files(spark, folder).select("path")
    return p.select("path", P.relative_slash_path(F.col("path"), F.lit("/opt/sdk/")).alias("rel"), P.normalized_path(F.concat(F.col("path"), F.lit("//"))).alias("normal"), P.digest(F.col("path"), length=16).alias("digest"))


def r1_change_classes(spark: SparkSession, folder: str) -> DataFrame:
    """What each delivered entry asks for: a full pass, a refresh of the project, a dirty file, or nothing."""
    e = table(spark, folder, "file_entries").select("id", "delivery_no", F.when(F.col("id") % 97 == 0, F.concat(P.dirname(F.col("path")), F.lit("/go.mod"))).when(F.col("id") % 89 == 0, F.lit("cairn.json")).when(F.col("id") % 83 == 0, F.lit("x/Makefile")).otherwise(F.col("path")).alias("path"), (F.col("status") == "error").alias("deleted"))
    return FL.classified_changes(e).select("id", "delivery_no", "decision").distinct()


def r2_coalesced(spark: SparkSession, folder: str) -> DataFrame:
    """The queue after coalescing: the last change of each file, none of roots that get a full pass."""
    e = table(spark, folder, "file_entries").withColumn("root", F.split("path", "/")[0]).withColumn("deleted", F.col("status") == "error")
    e = FL.classified_changes(e).withColumn("decision", F.when(F.col("id") % 1501 == 7, "full").otherwise(F.col("decision")))
    return FL.coalesced(e, "root", "path", ["delivery_no", "delivered_at", "indexed_at"]).select("root", "path", "decision")


def p15_projects(spark: SparkSession, folder: str) -> DataFrame:
    """Files per nearest project."""
    near = packages.nearest_ancestor(files(spark, folder).where("source = 'workspace'").select("path"), s12_markers(spark, folder).select("dir", F.col("markers").alias("value")), fold_case=True)
    return near.groupBy("dir", "value").agg(F.count("*").alias("n_files"))


_EXT = "lower(regexp_extract({0}, '[^/]\\.([^./]*)$', 1))"
_SCOPED = _EXT.format("path") + " in ('c', 'h', 'cc', 'cpp', 'cxx', 'hh', 'hpp', 'hxx', 'inl', 'go') and not regexp_matches(lower(path), '(^|/)(\\.git|\\.vscode|node_modules|target|out|build)/')"
_DIR = "regexp_replace({0}, '/?[^/]*$', '')"
_ACCEPTS = "(select user_id, event_type, coalesce(nullif(substr(lower(regexp_replace(coalesce(props, ''), '[^A-Za-z0-9_]', '', 'g')), 1, 2), ''), 'none') as bucket from events)"
_MARKED = f"(select lower(dir) as dir, array_to_string(list_sort(list(distinct lower(m))), ',') as markers, count(distinct lower(m)) as n_markers from (select distinct dir, unnest(case length(dir) % 3 when 0 then ['makefile', 'cmakelists.txt'] when 1 then ['go.mod', 'cmakelists.txt'] else ['cmakelists.txt'] end) m from (select distinct {_DIR.format('path')} dir from {FILES_SQL} where source = 'workspace')) group by 1)"
_CHANGE = f"case when lower(path) = 'cairn.json' then 'full' when lower(regexp_extract(path, '([^/]*)$', 1)) in ('go.mod', 'go.work') then 'full' when lower(regexp_extract(path, '([^/]*)$', 1)) in ('makefile', 'gnumakefile', 'cmakelists.txt', 'build.ninja', 'meson.build', 'build', 'build.bazel', 'workspace', 'workspace.bazel') then 'project' when {_SCOPED} then case when status = 'error' then 'delete' else 'upsert' end else 'ignored' end"
#: A text with its comments and literals blanked, every place kept.
_BLANKED = r"""array_to_string(list_transform(regexp_extract_all(text, '/\*(?:[^*]|\*+[^*/])*\*+/|//[^\n]*|"(?:[^"\\\n]|\\.)*"|''(?:[^''\\\n]|\\.)+''|[^/"'']+|[\s\S]'), lambda x: case when regexp_matches(x, '^(/\*|//|"|''.)') then regexp_replace(x, '[^\n]', ' ', 'g') else x end), '')"""
_REFS = rf"""(with l as (select path, unnest(generate_series(0, len(ls) - 1)) as line, unnest(ls) as s, unnest(ms) as m from (select path, string_split(text, chr(10)) ls, string_split({_BLANKED}, chr(10)) ms from source_texts where text is not null and path is not null)),
 n as (select * from (values ('log_line'), ('reset'), ('slot'), ('run')) n(name)),
 h as (select n.name, l.path, l.line, l.m, string_split_regex(l.s, '\b' || n.name || '\b') p from l join n on regexp_matches(l.s, '\b' || n.name || '\b')),
 o as (select name, path, line, m, list_sum(list_transform(p[1:k], lambda x: length(x) + length(regexp_replace(x, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))) + (k - 1) * length(name) as col, (list_sum(list_transform(p[1:k], lambda x: length(x))) + (k - 1) * length(name))::bigint as at_ from h, unnest(generate_series(1, len(p) - 1)) as t(k)),
 q as (select *, substr(m, 1, at_) as before, substr(m, at_ + 1, length(name)) as here, substr(m, at_ + length(name) + 1) as after from o)
 select name, path, line, col::bigint as col, case when here <> name then 'read' when regexp_matches(before, '(struct|union|class|enum|typename|type)\s+$') then case when regexp_matches(after, '^\s*(\{{|struct|interface)') then 'definition' else 'type_use' end
  when regexp_matches(after, '^\s*\(') then case when ends_with(path, '.go') and regexp_matches(before, '^func\s*(\([^)]*\)\s*)?$') then 'definition' when not ends_with(path, '.go') and regexp_matches(before, '^([A-Za-z_][\w:<>]*[\s*&]+)*(\w+::)*$') then case when regexp_matches(after, ';\s*$') then 'declaration' else 'definition' end else 'call' end
  when regexp_matches(after, '^\s*([-+*/|&^%]?=[^=]|\+\+|--)') then 'write' when not ends_with(path, '.go') and regexp_matches(after, '^\s+[A-Za-z_]') then 'type_use' else 'read' end as role from q)"""
_REFS_RANKED = f"(select * from (select *, row_number() over (partition by name order by case role when 'definition' then 0 when 'declaration' then 1 when 'call' then 2 when 'write' then 3 when 'type_use' then 4 else 5 end, path, line, col) as position from {_REFS}) where position <= 2000)"

QUERIES = {
    f.__name__: f
    for f in (
        s1_scan, s3_capped_roots, s5_scope, s7_language, s8_to_parse, s12_markers, f1_active_facts, j1_active_revisions, f19_fact_mask, j6_effective, u1_union_all, j7_obsolete, j19_overlay, j24_merged_roots, u2_unreferenced, u3_missing,
        a1_counts, a2_coverage, a3_kind_counts, a6_largest_path, a14_accept_counts, x13_history_boost, s15_newest_accepts, a16_basename_counts, a20_size_categories, a21_recall_metrics, a22_extensions,
        w1_focused_candidate, t4_declaration_order, w10_relative_tokens, f12_role_gate, f15_line_range, f16_low_trust, f17_rescue_suppression, t7_reference_order, t13_include_candidates, x31_paths, r1_change_classes, r2_coalesced,
    )
} | {"q_p3_references": p3_references, "q_p15_projects": p15_projects}

SQL = {
    "s1_scan": f"select path from {FILES_SQL} where {_SCOPED} and not (lower(path) = 'harborlight/pkg' or starts_with(lower(path), 'harborlight/pkg/')) and not regexp_matches(path, '(^|/)internal/') and not regexp_matches(path, '_test\\.go$') and not regexp_matches(path, '^tinderlane/app/(.*/)?slot[^/]*\\.c$') and not (regexp_matches(path, '^wickerdb/.*\\.h$') and not regexp_matches(path, '^wickerdb/lib/[^/]*\\.h$'))",
    "s3_capped_roots": f"with e as (select *, array_to_string(string_split(path, '/')[1:2], '/') as root from {_ENTRIES}) select root, path from e where root in (select root from e group by 1 having count(*) <= 20000 and coalesce(sum(size), 0) <= 536870912)",
    "s5_scope": f"select path, {_EXT.format('path')} in ('c', 'go') and (starts_with(lower(path), 'harborlight/') or starts_with(lower(path), 'tinderlane/')) and not starts_with(lower(path), 'harborlight/net/') and not regexp_matches(lower(path), '(^|/)(\\.git|\\.vscode|node_modules|target|out|build)/') as in_scope from {FILES_SQL}",
    "s7_language": f"select path, case when regexp_matches(path, '^harborlight/net/[^/]*\\.go$') then 'go' when starts_with(path, 'harborlight/') then 'c' when ends_with(path, '.h') then 'cpp' when {_EXT.format('path')} in ('cc', 'cpp', 'cxx', 'hh', 'hpp', 'hxx', 'inl') then 'cpp' when {_EXT.format('path')} = 'go' then 'go' else 'c' end as language from {FILES_SQL}",
    "s8_to_parse": "with m as (select max(delivery_no) m from file_entries) select distinct id, path from file_entries e, m where e.delivery_no = m.m and not exists (select 1 from file_entries s, m where s.delivery_no < m.m and s.mtime_ns <> 0 and s.path = e.path and s.size = e.size and s.mtime_ns = e.mtime_ns and s.extension = e.extension)",
    "s12_markers": f"select * from {_MARKED}",
    "f1_active_facts": f"select a.id, a.file_id, a.revision_id from {LIVE_SQL} a join {_LAST} l using (file_id, revision_id)",
    "j1_active_revisions": f"select l.file_id, l.revision_id, r.language, r.parse_error_count from {_LAST} l join (select distinct id, language, parse_error_count from file_revisions) r on r.id = l.revision_id",
    "f19_fact_mask": "select distinct id from file_revisions where fact_mask & 128 <> 0",
    "j6_effective": f"with e as {_ENTRIES}, p as (select *, size + 1 as s, status = 'error' as deleted from e where id % 5 = 0) select id, size from e where id % 3 <> 0 and id not in (select id from p) union all select id, s from p where not coalesce(deleted, false)",
    "u1_union_all": f"with e as {_ENTRIES} select id, size from e where id % 3 <> 0 union all select id, size + 1 from e where id % 5 = 0",
    "j7_obsolete": f"select distinct id as revision_id from file_revisions where id not in (select revision_id from {_LAST}) and file_id % 10 <> 0 and id % 50 <> 0",
    "j19_overlay": f"select id, path, case when length(path) % 7 = 0 then 'new_' || name else name end as name from {LIVE_SQL} where path is not null",
    "j24_merged_roots": f"select name, root, id, n from (select name, qualified_name, arg_min(id, row(root, id)) as id, min(root) as root, count(*) as n from (select split_part(path, '/', 1) as root, name, qualified_name, id, row_number() over (partition by split_part(path, '/', 1) order by name, id) r from {LIVE_SQL} where name is not null and path is not null) where r <= 200 group by 1, 2) order by name, id limit 200",
    "u2_unreferenced": f"select distinct callee_name as text from {SITES_SQL} where callee_name is not null and callee_name not in (select name from {LIVE_SQL} where name is not null) and callee_name not in (select qualified_name from {LIVE_SQL} where qualified_name is not null)",
    "u3_missing": "select distinct path from file_entries where delivery_no = 1 and path not in (select path from file_entries where delivery_no = 2 and path is not null)",
    "a1_counts": f"select count(*) as declarations, count(*) filter (where external) as external, (select count(distinct id) from file_revisions) as revisions from {LIVE_SQL}",
    "a2_coverage": "select repo, count(*) as revisions, count(*) filter (where fact_mask & 128 <> 0) as with_calls, count(*) filter (where parse_error_count > 0) as with_errors, count(*) filter (where fallback_used > 0) as fallbacks from (select distinct id, repo, fact_mask, parse_error_count, fallback_used from file_revisions) group by 1",
    "a3_kind_counts": f"select name, kind, count(*) as n from {LIVE_SQL} where role = 'definition' and (not external or directly_included) and name is not null group by 1, 2",
    "a6_largest_path": f"select path, count(*) as n from {LIVE_SQL} where path is not null group by 1 order by n desc, path limit 1",
    "a14_accept_counts": f"select user_id, event_type, bucket, count(*) as accepts from {_ACCEPTS} group by 1, 2, 3",
    "x13_history_boost": f"select user_id, event_type, least(700, 120 * count(*))::int as boost from {_ACCEPTS} group by 1, 2",
    "s15_newest_accepts": "select event_id from events order by ts desc, event_id desc limit 4096",
    "a16_basename_counts": f"select lower(regexp_extract(path, '([^/]*)$', 1)) as base, least(count(*), 20) as freq from {FILES_SQL} group by 1",
    "a20_size_categories": f"select source, {_EXT.format('path')} as ext, sum(size)::bigint as bytes from {_ENTRIES} group by 1, 2",
    "a21_recall_metrics": f"select query, count(*) filter (where tier = 'current') as current, count(*) filter (where tier = 'reachable') as reachable, count(*) filter (where tier = 'external') as external, count(*) filter (where tier = 'unknown') as unknown, count(*) filter (where tier = 'global') as \"global\", count(*) as total from {CQ._CAND} group by 1",
    "a22_extensions": f"select {_EXT.format('path')} as ext, count(*) as n from {FILES_SQL} group by 1",
    "w1_focused_candidate": f"select query, group_key, id from {CQ._GROUPED} where position = 1",
    "t4_declaration_order": f"select query, group_key, position, id from {CQ._GROUPED}",
    "w10_relative_tokens": f"select id, line - coalesce(pl, 0) as delta_line, case when line - coalesce(pl, 0) = 0 then start - coalesce(ps, 0) else start end as delta_start, length from (select id, line, start, length, lag(line) over w pl, lag(start) over w ps from (select id, path, callee_range.start_line as line, callee_range.start_character as start, callee_range.end_character - callee_range.start_character as length from {SITES_SQL} where path is not null) window w as (partition by path order by line, start, id))",
    "f12_role_gate": "select kind, role, case when role = 'declaration' then false when kind = 'type' then role in ('type_use', 'definition', 'read') when kind in ('macro', 'enum_member') then true else role <> 'type_use' end as allowed from (values ('type'), ('macro'), ('enum_member'), ('parameter'), ('variable')) k(kind), (values ('declaration'), ('definition'), ('call'), ('write'), ('type_use'), ('read')) r(role)",
    "f15_line_range": f"select id from {SITES_SQL} where callee_range.start_line between 10 and 20",
    "f16_low_trust": f"select current, name from {CQ._MERGED} where tier = 'global' and not regexp_matches(sources, 'local|overlay') and (contains(sources, 'word') or confidence = 'fallback')",
    "f17_rescue_suppression": f"with a as (select *, string_split({_DIR.format('path')}, '/')[-1] as scope from {LIVE_SQL} where path is not null and name is not null) select scope, id from a where external and not (length(scope) % 2 = 0 and scope in (select scope from a where not external group by 1 having count(distinct name) >= 8))",
    "t7_reference_order": f"select name, role, count(*) as n, min(position) as first_position from {_REFS_RANKED} group by 1, 2",
    "t13_include_candidates": f"with s as (select distinct path as src from source_texts where file_id % 100 = 0 and path is not null), h as (select path, lower(regexp_extract(path, '([^/]*)$', 1)) base from {FILES_SQL} where regexp_matches(lower(path), '[^/]\\.(h|hh|hpp|hxx|inl)$')), f as (select base, least(count(*), 20) n from h group by 1), c as (select s.src, h.path, least(49, case when {_DIR.format('s.src')} = {_DIR.format('h.path')} then 35 else 0 end + f.n - least(20, 3 * (length(h.path) - length(replace(h.path, '/', ''))))) as boost from s join h on split_part(s.src, '/', 1) = split_part(h.path, '/', 1) join f using (base)) select src, path, boost, position from (select *, row_number() over (partition by src order by boost desc, path) as position from c) where position <= 20",
    "x31_paths": f"select path, case when starts_with(path, '/opt/sdk/') then substr(path, 10) end as rel, path as normal, substr(sha256('=' || path), 1, 16) as digest from {FILES_SQL}",
    "r1_change_classes": f"select distinct id, delivery_no, {_CHANGE} as decision from (select id, delivery_no, status, case when id % 97 = 0 then {_DIR.format('path')} || '/go.mod' when id % 89 = 0 then 'cairn.json' when id % 83 = 0 then 'x/Makefile' else path end as path from file_entries)",
    "r2_coalesced": f"with c as (select *, split_part(path, '/', 1) as root, case when id % 1501 = 7 then 'full' else {_CHANGE} end as decision from file_entries), f as (select distinct root from c where decision = 'full'), l as (select *, row_number() over (partition by root, path order by delivery_no desc, delivered_at desc, indexed_at desc, decision desc) r from c where decision in ('upsert', 'delete') and root not in (select root from f)) select root, null as path, 'full' as decision from f union all select root, path, decision from l where r = 1",
    "q_p3_references": f"select name, path, line, col, role, position from {_REFS_RANKED}",
    "q_p15_projects": f"select dir, value, count(*) as n_files from (select f.path, max_by(m.dir, length(m.dir)) as dir, max_by(m.markers, length(m.dir)) as value from {FILES_SQL} f join {_MARKED} m on starts_with(lower(f.path), m.dir || '/') where f.source = 'workspace' group by 1) group by 1, 2",
}
