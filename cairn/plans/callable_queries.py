"""Queries over callables and candidate sets: J3, J4, J16 to J18, A7 to A10, A12, A13, W1 to W3, W5 to W9, W11, W12, T3 to T6, T9, T10, T13, G8, G9, F9, F10, F13, F18, X8 to X14, X32, P2, P4, P13, P18."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.common import cut, kept, table
from cairn.functions import names as N
from cairn.functions import ranking as R
from cairn.operators import callables as C
from cairn.operators import candidates as K
from cairn.operators import search
from cairn.plans import graph_queries as GQ
from cairn.plans import name_queries as NQ
from cairn.plans.base import LIVE_SQL, SITES_SQL, live_anchors, sites
from cairn.sources.lexer import C_KEYWORDS, GO_KEYWORDS


def _family(path):
    return F.when(F.endswith(N.lower_ascii(path), F.lit(".go")), "go").otherwise("c_family")


_FAMILY = "case when ends_with(lower(path), '.go') then 'go' else 'c_family' end"


def _calls(spark: SparkSession, folder: str) -> DataFrame:
    return sites(spark, folder).select(F.col("id").alias("site_id"), _family(F.col("path")).alias("family"), "path", F.col("callee_name").alias("name"), F.col("call_form").alias("form"), "qualified_name", F.col("argument_count").alias("n_args"), F.lower("caller_entity_key").alias("caller_key"))


def _anchors(spark: SparkSession, folder: str) -> DataFrame:
    return live_anchors(spark, folder).withColumn("entity", F.lower("entity_key")).withColumn("family", _family(F.col("path"))).where("entity is not null")


def _entities(spark: SparkSession, folder: str) -> DataFrame:
    return C.primary_anchors(_anchors(spark, folder))


def _resolved(spark: SparkSession, folder: str) -> DataFrame:
    return C.resolve_calls(_calls(spark, folder), _entities(spark, folder))


def _callers(spark: SparkSession, folder: str) -> DataFrame:
    return C.resolve_callers(_calls(spark, folder), _anchors(spark, folder).select(F.col("entity").alias("key"), F.concat_ws("@", "entity", F.when(F.col("linkage_kind") == "internal", F.col("path"))).alias("entity"), "role", "path"))


_A = f"(select *, lower(entity_key) as entity, {_FAMILY} as family from {LIVE_SQL} where entity_key is not null)"
_E = f"(select * from (select *, max(has_body::int) over (partition by entity) = 1 as any_body, row_number() over (partition by entity order by (role is distinct from 'definition')::int, (provenance is distinct from 'ast')::int, path nulls first, start_byte nulls first, id) as r_ from {_A}) where r_ = 1)"
_C = f"(select id as site_id, {_FAMILY} as family, path, callee_name as name, call_form as form, qualified_name, argument_count as n_args, lower(caller_entity_key) as caller_key from {SITES_SQL})"
_ARITY = "case when min_arity is null then null when n_args < min_arity then false when max_arity is not null then n_args <= max_arity when coalesce(\"variadic\", false) then true end"
_RESOLVED = f"""(select site_id, entity as callee, case when bits = 0 then 16 else bits end as supports, count(*) over (partition by site_id) as n_candidates from (
 select c.site_id, e.entity, (case when c.qualified_name is not null then 1 else 0 end) + (case when e.path = c.path then 2 else 0 end) + (case when e.linkage_kind = 'internal' then 4 else 0 end) + (case when c.n_args is not null and coalesce({_ARITY}, false) then 8 else 0 end) as bits
 from {_C} c join {_E} e on e.name = c.name and e.family = c.family
 where c.form in ('direct_name', 'qualified_name', 'parenthesized_name') and e.kind = 'function' and not (e.owner is not null and coalesce(e.owner_kind = 'unknown', false))
  and (c.form = 'qualified_name' or coalesce(e.owner_kind <> 'record', true)) and (c.qualified_name is null or coalesce(c.qualified_name = e.qualified_name, false))
  and (coalesce(e.linkage_kind, '') <> 'internal' or coalesce(e.linkage_file, e.path) = c.path) and (c.n_args is null or coalesce({_ARITY}, true))))"""
_OWN = f"(select distinct entity as key, entity || case when linkage_kind = 'internal' and path is not null then '@' || path else '' end as entity, case when role = 'definition' then path end as home from {_A})"
_CALLERS = f"""(select c.site_id, case when p.n = 1 then p.only_ when h.m = 1 then h.local_ end as caller from {_C} c left join (select key, count(distinct entity) n, min(entity) only_ from {_OWN} group by 1) p on p.key = c.caller_key
 left join (select key, home, count(distinct entity) m, min(entity) local_ from {_OWN} where home is not null group by 1, 2) h on h.key = c.caller_key and h.home = c.path)"""
_CONF = "case when supports & 5 <> 0 then 'high' when supports & 10 <> 0 then 'medium' else 'low' end"
_RELATIONS = f"(select caller, callee, case when n_candidates > 1 then 'ambiguous' else {_CONF} end as confidence, case when n_candidates > 1 then site_id end as ambiguity_site, count(*) as n_sites, bit_or(supports) as supports, min(site_id) as first_site from {_RESOLVED} join {_CALLERS} using (site_id) where caller is not null group by 1, 2, 3, 4)"


def j3_anchor_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors with their optional owner, linkage file and guard looked up."""
    a = live_anchors(spark, folder)
    owners = a.where("owner is not null").groupBy(F.col("owner")).agg(F.count("*").alias("owner_size"))
    return a.select("id", "name", "owner", "linkage_file", "guard").join(owners, "owner", "left")


def j4_sites_with_callers(spark: SparkSession, folder: str) -> DataFrame:
    """Call sites with the number of anchors of their caller."""
    a = live_anchors(spark, folder).groupBy(F.lower("entity_key").alias("caller_key")).agg(F.count("*").alias("n_anchors"))
    return _calls(spark, folder).select("site_id", "caller_key", "name").join(a, "caller_key", "left")


def j16_counterparts(spark: SparkSession, folder: str) -> DataFrame:
    """Pairing of definitions and header declarations: the header has to lie in the proven reach of the source. Only sources with a header declaration of the same callable are searched from."""
    return kept(spark, folder, GQ.GRAPH_TABLES, "counterparts", lambda: _counterparts(spark, folder))


def _counterparts(spark: SparkSession, folder: str) -> DataFrame:
    a = live_anchors(spark, folder)
    asked = cut(GQ.provable(spark, folder, C.counterpart_paths(a).toDF("origin", "path")))
    # Guesses are followed as well: they count towards the limit of files, so that they decide about what is proven.
    reached = GQ.reach_of(spark, folder, asked.select("origin"), asked)[0].where("not is_heuristic")
    return C.counterparts(a, reached.select(F.col("origin").alias("source_path"), F.col("path").alias("header_path")))


def g9_pairing_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Number of anchors per pairing label."""
    return j16_counterparts(spark, folder).groupBy(R.pairing_label(F.col("evidence"), F.col("degree")).alias("label")).agg(F.count("*").alias("n"))


def j17_resolved_calls(spark: SparkSession, folder: str) -> DataFrame:
    """All callables that each call can mean, with the evidence."""
    return _resolved(spark, folder)


def w6_ambiguous_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Calls with more than one candidate."""
    return _resolved(spark, folder).where("n_candidates > 1").select("site_id", "n_candidates").distinct()


def j18_callers(spark: SparkSession, folder: str) -> DataFrame:
    """The caller of each call."""
    return _callers(spark, folder)


def a12_relations(spark: SparkSession, folder: str) -> DataFrame:
    """Call relations."""
    return C.relations(_resolved(spark, folder), _callers(spark, folder))


def a13_confidences(spark: SparkSession, folder: str) -> DataFrame:
    """Relations per confidence."""
    return a12_relations(spark, folder).groupBy("confidence").agg(F.count("*").alias("n_relations"), F.sum("n_sites").alias("n_sites"))


def t9_relation_page(spark: SparkSession, folder: str) -> DataFrame:
    """Second page of five relations of each callee."""
    page = C.relation_page(a12_relations(spark, folder), "callee", ["caller", F.col("ambiguity_site").asc_nulls_first(), "confidence"], 5, 5)
    return page.select("callee", "caller", "confidence", "position", "total", "n_sites")


def g8_one_hop(spark: SparkSession, folder: str) -> DataFrame:
    """Callers and callees of the stated entities: those of the anchors with ids divisible by 100."""
    asked = _anchors(spark, folder).where("id % 100 = 0").select(F.col("entity").alias("asked")).distinct()
    r = a12_relations(spark, folder).withColumn("caller", F.split("caller", "@")[0])
    out = r.join(asked, r["caller"] == asked["asked"]).select("asked", F.lit("outgoing").alias("direction"), F.col("callee").alias("other"), "confidence", "n_sites")
    inc = r.join(asked, r["callee"] == asked["asked"]).select("asked", F.lit("incoming").alias("direction"), F.col("caller").alias("other"), "confidence", "n_sites")
    return out.unionByName(inc)


def t10_cursors(spark: SparkSession, folder: str) -> DataFrame:
    """Cursors of the pages of the call sites' generations, and what reading them again gives."""
    g, o = F.col("generation"), F.col("id")
    made = sites(spark, folder).select("id", "generation", C.encode_cursor(g, F.lit(3), F.lit(7), F.lit("incoming"), o).alias("cursor"))
    return made.select("id", "cursor", C.decode_cursor(F.col("cursor"), g, F.lit(3), F.lit(7), F.lit("incoming")).alias("back"), C.decode_cursor(F.col("cursor"), g + 1, F.lit(3), F.lit(7), F.lit("incoming")).alias("stale"))


def f9_point_in_range(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors whose body holds the place where a call of the same file begins."""
    s = sites(spark, folder).select(F.col("id").alias("site_id"), "path", F.col("expression_range.start_line").alias("line"), F.col("expression_range.start_character").alias("character"))
    at = lambda end: F.struct(F.col(f"body_range.{end}_line").alias("line"), F.col(f"body_range.{end}_character").alias("character"))
    a = live_anchors(spark, folder).where("has_body").select("id", "path", at("start").alias("first"), at("end").alias("last"))
    return C.ranges_at(s, a, ["path"]).select("site_id", "id")


def f10_arity(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each anchor takes two arguments: yes, no or unknown."""
    return live_anchors(spark, folder).select("id", R.accepts_arity(F.lit(2), F.col("min_arity"), F.col("max_arity"), F.col("variadic")).alias("accepts"))


def t6_arity_policy(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates of the stated calls (ids divisible by 100) after the arity policy."""
    asked = _calls(spark, folder).where("site_id % 100 = 0").select("site_id", "family", "name", "n_args")
    cand = _anchors(spark, folder).where("kind = 'function'").select("id", "family", "name", "min_arity", "max_arity", "variadic")
    return C.arity_policy(asked.join(cand, ["family", "name"]), "site_id", F.col("n_args")).select("site_id", "id", "compatibility", "outcome")


def f18_external_demotion(spark: SparkSession, folder: str) -> DataFrame:
    """External anchors as mere declarations without bodies."""
    a = live_anchors(spark, folder)
    return a.select("id", F.when(F.col("external") & (F.col("role") == "definition"), "declaration").otherwise(F.col("role")).alias("role"), (F.col("has_body") & ~F.col("external")).alias("has_body"))


def w8_expansion_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Calls of each file within the budget of 32,768 candidates."""
    costs = _anchors(spark, folder).where("name is not null").groupBy("name").agg(F.countDistinct("path", "anchor_fingerprint", "start_byte").alias("cost"))
    return C.expansion_budget(_calls(spark, folder), costs, "path", ["site_id"], 32_768).select("site_id", "cost", "spent")


def w9_group_caps(spark: SparkSession, folder: str) -> DataFrame:
    """Call sites of the files with at most 20,000 of them and at most 2**29 arguments in all."""
    return C.group_caps(_calls(spark, folder), "path", "n_args", 20_000, 2**29).select("site_id", "path")


def w11_closest_locator(spark: SparkSession, folder: str) -> DataFrame:
    """For each anchor with an id divisible by 100 the anchor of its file and signature that stands closest to its old place, ten bytes on."""
    a = live_anchors(spark, folder)
    asked = a.where("id % 100 = 0").select(F.col("id").alias("query_id"), "path", "canonical_signature", (F.col("start_byte") + 10).alias("old"))
    pairs = asked.join(a.select("id", "path", "canonical_signature", "start_byte"), ["path", "canonical_signature"])
    return pairs.groupBy("query_id").agg(F.min(F.struct(F.abs(F.col("start_byte") - F.col("old")).alias("d"), "id")).alias("x")).select("query_id", "x.id", F.col("x.d").alias("distance"))


def w12_primary_anchor(spark: SparkSession, folder: str) -> DataFrame:
    """The anchor that stands for each entity."""
    return _entities(spark, folder).select("entity", "id", "any_body")


def overlay_names(anchors: DataFrame) -> DataFrame:
    """Anchors as an overlay of every seventh file (by the length of its path) shows them: their names have changed."""
    return anchors.withColumn("name", F.when(F.length("path") % 7 == 0, F.concat(F.lit("new_"), F.col("name"))).otherwise(F.col("name")))


# --- candidate sets ---------------------------------------------------------------------------------------------
def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates for the names of the stated anchors (ids divisible by 100) seen from the least of their files: tiers by that file's reach. Written once for a state of the tables."""
    return kept(spark, folder, GQ.GRAPH_TABLES, "candidates", lambda: _tiered_candidates(spark, folder))


def asked_anchors(anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The names of the stated anchors as ``query`` with the least of their files as ``current``, and the anchors that bear them."""
    a = anchors.where("name is not null and path is not null")
    asked = a.where("id % 100 = 0").groupBy(F.col("name").alias("query")).agg(F.min("path").alias("current"))
    return asked, a.join(asked, a["name"] == asked["query"])


def _tiered_candidates(spark: SparkSession, folder: str) -> DataFrame:
    asked, c = asked_anchors(live_anchors(spark, folder))
    reached, scopes, direct = GQ.reach_of(spark, folder, asked.select(F.col("current").alias("origin")), c.select(F.col("current").alias("origin"), "path").distinct())
    c = K.with_tiers(c, reached, scopes, direct)
    fidelity = F.when(F.col("signature_fidelity") != "ast_exact", "partial").when(F.coalesce("syntax_error_overlap", F.lit(False)), "low").otherwise("authoritative")
    return c.select("query", "current", "id", F.lower("entity_key").alias("logical_key"), "kind", "tier", fidelity.alias("fidelity"), "role", "guard", F.lit(0).alias("origin_rank"), "path", "start_byte", "start_line", "external", "in_heuristic", "open_reason")


def _focused(spark: SparkSession, folder: str) -> DataFrame:
    return K.focus(K.grouped(_candidates(spark, folder)), F.lit("call"))


def tiered_sql(rows: str) -> str:
    """Rows ``(current, path, external, ...)`` with ``tier, in_heuristic, open_reason`` by the reach of their current file."""
    return f"""({GQ.reach_sql(f"(select current as origin from {rows})")}
 select a.*, case when a.external and d.dst is not null then 'external' when a.path = a.current then 'current' when not f.is_heuristic then 'reachable' when f.is_heuristic then 'unknown' when s.open then 'unknown' else 'global' end as tier,
  coalesce(f.is_heuristic, false) as in_heuristic, s.reason as open_reason from {rows} a left join files f on f.origin = a.current and f.path = a.path left join scopes s on s.origin = a.current
  left join (select distinct src, dst from edges_ where resolution = 'external_exact' and starts_with(dst, '/')) d on d.src = a.current and d.dst = a.path)"""


_ASKED = f"(select q.query, q.current, a.* from {LIVE_SQL} a join (select name as query, min(path) as current from {LIVE_SQL} where id % 100 = 0 and name is not null and path is not null group by 1) q on a.name = q.query where a.path is not null)"
_CAND = f"""(select query, current, id, lower(entity_key) as logical_key, kind, role, guard, path, start_byte, start_line, external, in_heuristic, open_reason, tier,
 case when signature_fidelity <> 'ast_exact' then 'partial' when coalesce(syntax_error_overlap, false) then 'low' else 'authoritative' end as fidelity,
 case tier when 'current' then 4 when 'reachable' then 3 when 'external' then 2 when 'unknown' then 1 else 0 end as tier_rank from {tiered_sql(_ASKED)})"""
_ROLE3 = "case role when 'definition' then 3 when 'tentative' then 2 when 'declaration' then 1 else 0 end"
_GROUPED = f"""(select *, row_number() over (partition by query, group_key order by tier_rank desc, case fidelity when 'authoritative' then 2 when 'partial' then 1 else 0 end desc, {_ROLE3} desc, (coalesce(trim(guard), '') = '')::int desc, path, start_byte, id) as position,
 max(tier_rank) over (partition by query, group_key) as group_tier, bool_or(fidelity = 'authoritative') over (partition by query, group_key) as authoritative, count(*) over (partition by query, group_key) as group_size
 from (select *, case when fidelity = 'low' or logical_key is null then '#' || id else '=' || logical_key end as group_key from {_CAND}))"""
_FOCUSED = f"""(select *, eligible and group_tier = max(group_tier) filter (where eligible) over (partition by query) as focused from (select *, accepted = bool_or(accepted) over (partition by query) as eligible from
 (select *, bool_or(kind in ('function', 'method')) over (partition by query, group_key) as accepted from {_GROUPED})))"""


def a7_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates grouped by logical entity, in the order of their group."""
    return K.grouped(_candidates(spark, folder)).select("query", "id", "group_key", "position", "group_tier", "authoritative", "group_size")


def w2_focus(spark: SparkSession, folder: str) -> DataFrame:
    """Groups in focus: those of the highest tier."""
    return _focused(spark, folder).where("focused and position = 1").select("query", "group_key", "id")


def a8_dispositions(spark: SparkSession, folder: str) -> DataFrame:
    """How far each candidate set can be trusted."""
    return K.dispositions(_focused(spark, folder), F.col("open_reason").isNull())


def w3_definitions(spark: SparkSession, folder: str) -> DataFrame:
    """What a jump to the definition presents."""
    return K.navigation(_focused(spark, folder), declaration=False).select("query", "id", "role")


def w3_declarations(spark: SparkSession, folder: str) -> DataFrame:
    """What a jump to the declaration presents."""
    return K.navigation(_focused(spark, folder), declaration=True).select("query", "id", "role")


def _packed(df: DataFrame) -> DataFrame:
    base = R.definition_base(F.col("role"), F.col("kind"), F.col("path"), F.col("guard"))
    return df.withColumn("base", base).withColumn("packed", N.pack_score(F.col("tier"), base, N.locality(F.col("path"), F.col("current"))))


def t3_candidate_order(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates of each query in the order of packed score, path and line."""
    from pyspark.sql import Window

    w = Window.partitionBy("query").orderBy(F.desc("packed"), "path", "start_line", "id")
    return _packed(_candidates(spark, folder)).withColumn("position", F.row_number().over(w)).select("query", "id", "packed", "position")


def t5_group_order(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of each query by tier and kind."""
    from pyspark.sql import Window

    w = Window.partitionBy("query").orderBy(F.desc("group_tier"), R.lookup(F.col("kind"), K.KIND_RANK, 9), "group_key")
    return K.grouped(_candidates(spark, folder)).where("position = 1").withColumn("place", F.row_number().over(w)).select("query", "group_key", "place")


def x8_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """Confidence, reason, label and visibility of each candidate."""
    conf = R.confidence_for(F.col("tier"), F.lit(True), F.col("open_reason"))
    c = _candidates(spark, folder).withColumn("confidence", conf)
    return c.select("query", "id", "tier", "confidence", R.reason_for(F.col("tier")).alias("reason"), R.scope_label(F.col("tier"), F.col("confidence")).alias("label"), R.lookup(F.col("tier"), R.VISIBILITY).alias("visibility"))


def x9_definition_base(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of each anchor as a definition."""
    return live_anchors(spark, folder).select("id", R.definition_base(F.col("role"), F.col("kind"), F.col("path"), F.col("guard")).alias("base"))


def f11_coloring_scope(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates whose scope may colour tokens."""
    return _candidates(spark, folder).where(R.coloring_allowed(F.col("tier"), F.col("in_heuristic"))).select("query", "id")


def f13_intent_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Which intents accept each kind of anchor."""
    each = F.explode(F.array(*[F.lit(i) for i in ("call", "type", "value", "neutral")]))
    return live_anchors(spark, folder).select("kind").distinct().withColumn("intent", each).withColumn("accepts", R.intent_accepts(F.col("intent"), F.col("kind")))


def a9_best_per_name(spark: SparkSession, folder: str) -> DataFrame:
    """The best candidate of each name."""
    c = _candidates(spark, folder)
    return K.best_per_name(c, "query", [N.tier_rank(F.col("tier")), R.lookup(F.col("fidelity"), K.FIDELITY_RANK, 0)], [F.col("id")]).select("query", "id", "tier")


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """``(current, cursor, prefix)``: completions asked for in the stated files (file ids divisible by 100), at half of their calls, after two letters of the name used last."""
    stated = table(spark, folder, "source_texts").where("file_id % 100 = 0 and path is not null").select("path").distinct()
    return _usage(spark, folder).join(stated, "path", "left_semi").groupBy(F.col("path").alias("current")).agg(F.max("cursor").alias("cursor"), F.substring(F.max_by("name", "nearest"), 1, 2).alias("prefix"))


_KEYWORDS = sorted(f"{family} {w}" for family, words in (("go", GO_KEYWORDS), ("c_family", C_KEYWORDS)) for w in words)


def _evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence for each request: indexed names with the tier of its reach, those of the open file as its overlay, words used before the cursor, keywords of the language. Written once for a state of the tables."""
    return kept(spark, folder, GQ.GRAPH_TABLES, "evidence", lambda: _gathered_evidence(spark, folder))


def _gathered_evidence(spark: SparkSession, folder: str) -> DataFrame:
    asked = requests(spark, folder)
    a = live_anchors(spark, folder).where("name is not null and path is not null")
    a = a.join(search.by_word_start(a.select("name").distinct(), asked), "name").join(asked, "prefix")
    a = K.with_tiers(a, *GQ.reach_of(spark, folder, asked.select(F.col("current").alias("origin"))))
    kind = F.when(F.col("kind") == "function_like_macro", "macro").otherwise("function")
    exact = N.lower_ascii(F.col("name")) == N.lower_ascii(F.col("prefix"))
    near = F.split("path", "/")[0] == F.split("current", "/")[0]
    ind = a.select(
        "current", "name", F.when(F.col("path") == F.col("current"), "overlay").otherwise("indexed").alias("source"), "tier", R.confidence_for(F.col("tier"), exact, F.col("open_reason")).alias("confidence"), F.col("score").cast("int").alias("score"),
        F.lit(0).alias("proximity"), F.when(near, R.PROJECT_MOST).otherwise(0).alias("project"), kind.alias("kind"), "role", F.col("id").alias("seq"),
    )
    plain = [F.lit("global").alias("tier"), F.lit("fallback").alias("confidence")]
    none = F.lit(None).cast("string").alias("role")
    used = _usage(spark, folder).drop("cursor").join(asked, F.col("path") == F.col("current")).withColumn("score", N.word_score(F.col("prefix"), F.col("name"), F.lit(0))).where("score is not null")
    words = used.select("current", "name", F.lit("word").alias("source"), *plain, F.col("score").cast("int").alias("score"), R.proximity(F.col("cursor") - F.col("nearest"), F.col("uses")).alias("proximity"), F.lit(0).alias("project"), F.lit("text").alias("kind"), none, (F.col("nearest") + 10**9).alias("seq"))
    known = asked.withColumn("word", F.explode(F.array(*[F.lit(w) for w in _KEYWORDS]))).where(F.split("word", " ")[0] == _family(F.col("current"))).withColumn("name", F.split("word", " ")[1])
    known = known.withColumn("score", N.match_score(F.col("prefix"), F.col("name"))).where(F.col("score").isNotNull() & N.passes_short_gate(F.col("prefix"), F.col("score")))
    builtin = known.select("current", "name", F.lit("builtin").alias("source"), *plain, F.col("score").cast("int").alias("score"), F.lit(0).alias("proximity"), F.lit(0).alias("project"), F.lit("keyword").alias("kind"), none, F.lit(2 * 10**9).cast("bigint").alias("seq"))
    return ind.unionByName(words).unionByName(builtin).withColumn("match_score", F.col("score"))


def _history(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    """Rows with ``accepts``: how often something of the name's prefix bucket was accepted before."""
    log = table(spark, folder, "events").groupBy(N.prefix_bucket(F.coalesce("props", F.lit(""))).alias("bucket")).agg(F.count("*").alias("accepts"))
    return rows.withColumn("bucket", N.prefix_bucket(F.col("name"))).join(log, "bucket", "left").drop("bucket").withColumn("accepts", F.coalesce("accepts", F.lit(0)))


_USAGE = f"(select s.path, s.name, count(*) as uses, max(s.at) as nearest, max(c.cursor) as cursor from (select path, callee_name as name, callee_range.start_byte as at from {SITES_SQL} where callee_name is not null) s join (select path, max(callee_range.start_byte) // 2 as cursor from {SITES_SQL} where callee_name is not null group by 1) c using (path) where s.at + strlen(s.name) <= c.cursor group by 1, 2)"
_REQUESTS = f"(select path as current, max(cursor) as cursor, substr(arg_max(name, nearest), 1, 2) as prefix from {_USAGE} where path in (select path from source_texts where file_id % 100 = 0) group by 1)"
_GATE = "(strlen(prefix) >= 3 or score >= 650)"
_ASKED_NAMES = f"(select * from (select a.*, r.current, r.prefix, {NQ._sql_score('r.prefix', 'a.name')} as score from {LIVE_SQL} a, {_REQUESTS} r where a.name is not null and a.path is not null) where score is not null and {_GATE})"
_WORDSCORE = f"case when lower(name) = lower(prefix) then 700 when starts_with(lower(name), lower(prefix)) then 550 when instr(lower(name), lower(prefix)) > 0 and (strlen(prefix) >= 3 or {NQ._sql_boundary('name', 'instr(lower(name), lower(prefix))')}) then 250 end"
_PROXIMITY = "least(200, case when cursor - nearest <= 32 then 120 when cursor - nearest <= 128 then 90 when cursor - nearest <= 512 then 60 when cursor - nearest <= 2048 then 30 else 10 end + 20 * least(uses - 1, 4))::int"
_EVIDENCE = f"""(select *, score as match_score from (select current, name, case when path = current then 'overlay' else 'indexed' end as source, tier,
  case when tier = 'current' and lower(name) = lower(prefix) then 'exact' when tier in ('current', 'reachable') then 'reachable' when tier = 'external' then 'heuristic' when tier = 'unknown' and open_reason = 'ambiguous_include' then 'ambiguous' else 'fallback' end as confidence,
  score::int as score, 0 as proximity, case when split_part(path, '/', 1) = split_part(current, '/', 1) then 350 else 0 end as project, case when kind = 'function_like_macro' then 'macro' else 'function' end as kind, role, id as seq from {tiered_sql(_ASKED_NAMES)}
 union all select current, name, 'word', 'global', 'fallback', score::int, {_PROXIMITY}, 0, 'text', null, nearest + 1000000000 from (select r.current, r.prefix, u.*, {_WORDSCORE} as score from {_USAGE} u join {_REQUESTS} r on r.current = u.path) where score is not null
 union all select current, name, 'builtin', 'global', 'fallback', score::int, 0, 0, 'keyword', null, 2000000000 from (select current, prefix, name, {NQ._sql_score('prefix', 'name')} as score from (select r.current, r.prefix, split_part(w, ' ', 2) as name from {_REQUESTS} r, (select unnest([{", ".join(f"'{w}'" for w in _KEYWORDS)}]) as w) where split_part(w, ' ', 1) = {_FAMILY.replace('path', 'r.current')})) where score is not null and {_GATE}))"""
_SP = "case source when 'local' then 5 when 'overlay' then 4 when 'indexed' then 3 when 'builtin' then 2 when 'word' then 1 else 0 end"
_TR = "case tier when 'current' then 4 when 'reachable' then 3 when 'external' then 2 when 'unknown' then 1 else 0 end"
_CR = "case confidence when 'exact' then 4 when 'reachable' then 3 when 'heuristic' then 2 when 'ambiguous' then 1 else 0 end"
_RP = "case role when 'declaration' then 4 when 'tentative' then 3 when 'definition' then 2 when 'unknown' then 1 else 0 end"
_MERGED = f"""(select current, name, arg_max(source, r) as source, arg_max(coalesce(role, ''), r) as role, arg_max(kind, r) as kind, arg_max(tier, {_TR}) as tier, arg_max(confidence, {_CR}) as confidence, max(score) as score, max(match_score) as match_score, max(proximity) as proximity, max(project) as project,
 array_to_string(list_sort(list(distinct source)), ',') as sources from (select *, -row_number() over (partition by current, name order by {_SP} desc, {_TR} desc, {_CR} desc, project desc, {_RP} desc, score desc, seq) as r from {_EVIDENCE}) group by current, name)"""
_BUCKET = "coalesce(nullif(substr(lower(regexp_replace({0}, '[^A-Za-z0-9_]', '', 'g')), 1, 2), ''), 'none')"
_ACCEPTED = f"(select m.*, coalesce(h.n, 0) as accepts from {_MERGED} m left join (select {_BUCKET.format(chr(99) + 'oalesce(props, ' + chr(39) * 2 + ')')} as bucket, count(*) as n from events group by 1) h on h.bucket = {_BUCKET.format('m.name')})"


def a10_merged_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence of each name from all sources."""
    return K.merged(_evidence(spark, folder), ["current"]).withColumn("role", F.coalesce("role", F.lit("")))


def x11_final_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Final rank of each name of each request, low-trust ones capped."""
    return ranked_evidence(spark, folder).select("current", "name", "final_rank", "low_trust")


def ranked_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Merged evidence with its final rank."""
    m = _history(spark, folder, K.merged(_evidence(spark, folder), ["current"]))
    intent = R.intent_adjustment(F.lit("call_target"), F.lit("medium"), F.col("kind"), F.col("source"), F.col("tier"))
    rank = R.final_rank(F.col("source"), F.col("tier"), F.col("confidence"), F.col("match_score"), F.col("proximity"), F.col("project"), intent, R.history_boost(F.col("accepts")))
    strong = F.col("sources").rlike("local|overlay")
    low = R.low_trust(F.col("tier"), F.col("confidence"), strong, F.col("sources").contains("word"))
    cap = R.LOW_TRUST_CAP + R.clamp(F.col("project"), R.PROJECT_MOST)
    return m.withColumn("low_trust", low).withColumn("final_rank", F.when(low, F.least(rank, cap)).otherwise(rank).cast("int"))


def x12_intent_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """What each intent and confidence add to each kind, source and tier of the evidence."""
    e = _evidence(spark, folder).select("kind", "source", "tier").distinct()
    e = e.withColumn("intent", F.explode(F.array(*[F.lit(i) for i in (*R.INTENTS, "declaration_name", "neutral")]))).withColumn("confidence", F.explode(F.array(*[F.lit(c) for c in R.DIVISOR])))
    return e.withColumn("adjustment", R.intent_adjustment(F.col("intent"), F.col("confidence"), F.col("kind"), F.col("source"), F.col("tier")))


def a15_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Uses of each name before the middle of its file: count and nearest place."""
    return _usage(spark, folder)


def _usage(spark: SparkSession, folder: str) -> DataFrame:
    s = sites(spark, folder).where("callee_name is not null").select("path", F.col("callee_name").alias("name"), F.col("callee_range.start_byte").alias("at"))
    cursor = s.groupBy("path").agg(F.floor(F.max("at") / 2).alias("cursor"))
    near = s.join(cursor, "path").where(F.col("at") + F.octet_length("name") <= F.col("cursor"))
    return near.groupBy("path", "name").agg(F.count("*").alias("uses"), F.max("at").alias("nearest"), F.max("cursor").alias("cursor"))


def x14_proximity(spark: SparkSession, folder: str) -> DataFrame:
    """Nearness score of each used name."""
    return _usage(spark, folder).select("path", "name", R.proximity(F.col("cursor") - F.col("nearest"), F.col("uses")).alias("proximity"))


def p18_callable_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Callables offered for the stated calls: same family and name, no record-owned ones, internal ones only of the file, after the arity policy."""
    asked = _calls(spark, folder).where("site_id % 100 = 0").select("site_id", "family", "name", "n_args", F.col("path").alias("call_path"))
    cand = _anchors(spark, folder).where("kind = 'function' and coalesce(owner_kind, '') <> 'record'").select("id", "family", "name", "min_arity", "max_arity", "variadic", "linkage_kind", "path")
    fit = asked.join(cand, ["family", "name"]).where((F.coalesce("linkage_kind", F.lit("")) != "internal") | (F.col("path") == F.col("call_path")))
    return C.arity_policy(fit, "site_id", F.col("n_args")).select("site_id", "id", "compatibility", "outcome")


_DEFBASE = "case role when 'definition' then 1000 when 'tentative' then 750 when 'declaration' then 500 else 0 end + case when kind in ('function', 'method') and regexp_matches(lower(path), '[^/]\\.(c|cc|cpp|cxx)$') then 100 else 0 end - case when coalesce(trim(guard), '') <> '' then 1 else 0 end"
_LOCAL = "10 * least(10, coalesce(list_position(list_transform(range(1, greatest(len(string_split(path, '/')), len(string_split(current, '/'))) + 1), lambda i: coalesce(string_split(path, '/')[i] = string_split(current, '/')[i], false)), false) - 1, len(string_split(path, '/'))))"
_SRC, _HDR = "regexp_matches(lower(path), '[^/]\\.(c|cc|cpp|cxx)$')", "regexp_matches(lower(path), '[^/]\\.(h|hh|hpp|hxx|inl)$')"
_FIT = f"(select * from {LIVE_SQL} where kind = 'function' and (owner_kind is null or owner_kind = 'namespace') and linkage_kind = 'external' and signature_fidelity = 'ast_exact' and coalesce(canonical_signature, '') <> '')"
_LINKS = f"(select s.id sid, h.id hid, s.path as source_path, h.path as header_path from {_FIT} s join {_FIT} h using (name, qualified_name, canonical_signature) where s.role = 'definition' and {_SRC.replace('path', 's.path')} and h.role = 'declaration' and {_HDR.replace('path', 'h.path')})"
_PAIRS = f"""({GQ.reach_sql(f"(select source_path as origin from {_LINKS})")}, l as (select k.* from {_LINKS} k join files f on f.origin = k.source_path and f.path = k.header_path and not f.is_heuristic),
 d as (select *, count(*) over (partition by sid) ds, count(*) over (partition by hid) dh from l), e as (select sid id, ds deg, hid other, ds = 1 and dh = 1 pair from d union all select hid, dh, sid, ds = 1 and dh = 1 from d),
 p as (select id, max(deg) deg, bool_or(pair) pair, max(other) filter (where pair) other from e group by 1)
 select a.id, case when p.pair then 'strict_one_to_one' when p.deg is null then 'unpaired' else 'ambiguous' end as evidence, coalesce(p.deg, 0) as degree, p.other as counterpart_id from {LIVE_SQL} a left join p using (id))"""


def _arity_sql(where: str) -> str:
    return f"""with c as (select s.site_id, a.id, s.n_args, {_ARITY} ok from {_C} s join {_A} a on a.family = s.family and a.name = s.name where s.site_id % 100 = 0 and a.kind = 'function' {where}),
 l as (select *, case when n_args is null or ok is null then 1 when ok then 2 else 0 end lv from c), b as (select *, max(lv) over (partition by site_id) best from l)
 select site_id, id, case lv when 2 then 'compatible' when 1 then 'unknown' else 'incompatible' end as compatibility, case when n_args is null then 'not_applied' when best = 2 then 'filtered' when best = 1 then 'unknown_only' else 'mismatch_fallback' end as outcome
 from b where n_args is null or best = 0 or (best = 2 and lv > 0) or (best = 1 and lv = 1)"""


def _matrix_sql() -> str:
    value = {}
    for intent, kinds in R.INTENTS.items():
        value[intent] = "case kind " + " ".join(f"when '{k}' then {v}" for k, v in kinds.items()) + " else 0 end"
    value["declaration_name"] = "case when source in ('local', 'overlay', 'word', 'fallback') then 900 when source = 'builtin' or (source = 'indexed' and tier = 'global') then -5000 else 0 end"
    value["neutral"] = "0"
    per = "case intent " + " ".join(f"when '{i}' then {v}" for i, v in value.items()) + " end"
    return f"select kind, source, tier, intent, confidence, (trunc(({per}) / case confidence when 'high' then 1 when 'medium' then 2 else 4 end))::int as adjustment from (select distinct kind, source, tier from {_EVIDENCE}), (values " + ", ".join(f"('{i}')" for i in value) + ") i(intent), (values ('high'), ('medium'), ('low')) c(confidence)"


QUERIES = {
    f.__name__: f
    for f in (
        j3_anchor_dictionary, j4_sites_with_callers, j16_counterparts, g9_pairing_labels, j17_resolved_calls, w6_ambiguous_calls, j18_callers, a12_relations, a13_confidences, t9_relation_page, g8_one_hop, t10_cursors,
        f9_point_in_range, f10_arity, t6_arity_policy, f18_external_demotion, w8_expansion_budget, w9_group_caps, w11_closest_locator, w12_primary_anchor, a7_groups, w2_focus, a8_dispositions, w3_definitions, w3_declarations,
        t3_candidate_order, t5_group_order, x8_confidence, x9_definition_base, f11_coloring_scope, f13_intent_gate, a9_best_per_name, a10_merged_evidence, x11_final_rank, x12_intent_matrix, a15_usage, x14_proximity,
    )
}
QUERIES["q_p18_callable_candidates"] = p18_callable_candidates

SQL = {
    "j3_anchor_dictionary": f"select a.id, a.name, a.owner, a.linkage_file, a.guard, o.n as owner_size from {LIVE_SQL} a left join (select owner, count(*) n from {LIVE_SQL} where owner is not null group by 1) o using (owner)",
    "j4_sites_with_callers": f"select site_id, caller_key, name, n as n_anchors from {_C} left join (select lower(entity_key) as caller_key, count(*) n from {LIVE_SQL} group by 1) using (caller_key)",
    "j16_counterparts": f"select * from {_PAIRS}",
    "g9_pairing_labels": f"select case when evidence = 'ambiguous' then 'ambiguous:' || degree else evidence end as label, count(*) as n from {_PAIRS} group by 1",
    "j17_resolved_calls": f"select * from {_RESOLVED}",
    "w6_ambiguous_calls": f"select distinct site_id, n_candidates from {_RESOLVED} where n_candidates > 1",
    "j18_callers": f"select * from {_CALLERS}",
    "a12_relations": f"select * from {_RELATIONS}",
    "a13_confidences": f"select confidence, count(*) as n_relations, sum(n_sites)::bigint as n_sites from {_RELATIONS} group by 1",
    "t9_relation_page": f"select callee, caller, confidence, position, total, n_sites from (select *, row_number() over (partition by callee order by caller, ambiguity_site nulls first, confidence) as position, count(*) over (partition by callee) as total from {_RELATIONS}) where position > 5 and position <= 10",
    "g8_one_hop": f"with q as (select distinct entity as asked from {_A} where id % 100 = 0), r as (select split_part(caller, '@', 1) as caller, callee, confidence, n_sites from {_RELATIONS}) select asked, 'outgoing' as direction, callee as other, confidence, n_sites from r join q on r.caller = q.asked union all select asked, 'incoming', caller, confidence, n_sites from r join q on r.callee = q.asked",
    "t10_cursors": f"select id, printf('%x', generation) || '.3.7.i.' || printf('%x', id) as cursor, id as back, null::bigint as stale from {SITES_SQL}",
    "f9_point_in_range": f"select s.id as site_id, a.id from {SITES_SQL} s join {LIVE_SQL} a on a.path = s.path and a.has_body where (s.expression_range.start_line, s.expression_range.start_character) >= (a.body_range.start_line, a.body_range.start_character) and (s.expression_range.start_line, s.expression_range.start_character) <= (a.body_range.end_line, a.body_range.end_character)",
    "f10_arity": f"select id, case when min_arity is null then null when 2 < min_arity then false when max_arity is not null then 2 <= max_arity when \"variadic\" then true end as accepts from {LIVE_SQL}",
    "t6_arity_policy": _arity_sql(""),
    "f18_external_demotion": f"select id, case when external and role = 'definition' then 'declaration' else role end as role, has_body and not external as has_body from {LIVE_SQL}",
    "w8_expansion_budget": f"select * from (select site_id, cost, sum(cost) over (partition by path order by site_id rows unbounded preceding)::bigint as spent from (select c.*, greatest(coalesce(k.n, 1), 1) as cost from {_C} c left join (select name, count(distinct (path, anchor_fingerprint, start_byte)) n from {_A} where name is not null group by 1) k using (name))) where spent <= 32768",
    "w9_group_caps": f"select site_id, path from {_C} where path in (select path from {_C} group by 1 having count(*) <= 20000 and coalesce(sum(n_args), 0) <= 536870912)",
    "w11_closest_locator": f"select query_id, id, d as distance from (select q.id as query_id, a.id, abs(a.start_byte - q.start_byte - 10) as d, row_number() over (partition by q.id order by abs(a.start_byte - q.start_byte - 10), a.id) r from {LIVE_SQL} q join {LIVE_SQL} a on a.path = q.path and a.canonical_signature = q.canonical_signature where q.id % 100 = 0) where r = 1",
    "w12_primary_anchor": f"select entity, id, any_body from {_E}",
    "a7_groups": f"select query, id, group_key, position, group_tier, authoritative, group_size from {_GROUPED}",
    "w2_focus": f"select query, group_key, id from {_FOCUSED} where focused and position = 1",
    "a8_dispositions": f"select query, n_groups, n_focused, alternative_count, case when n_auth = 0 then 'fallback' when n_focused > 1 then 'ambiguous' when n_focused = 0 or not ok then 'fallback' when complete then 'exact' else 'preferred' end as disposition from (select query, bool_and(open_reason is null) as complete, count(*) as n_groups, count(*) filter (where focused) as n_focused, count(*) filter (where authoritative) n_auth, coalesce(bool_and(authoritative) filter (where focused), false) ok, coalesce(sum(group_size) filter (where not focused), 0)::bigint as alternative_count from {_FOCUSED} where position = 1 group by 1)",
    "w3_definitions": f"select query, id, role from (select *, min(rr) over (partition by query, group_key) b from (select *, case role when 'definition' then 0 when 'tentative' then 1 when 'declaration' then 2 when 'unknown' then 3 else 9 end rr from {_FOCUSED} where focused)) where case when b = 9 then position = 1 else rr = b end",
    "w3_declarations": f"select query, id, role from (select *, min(rr) over (partition by query, group_key) b from (select *, case role when 'declaration' then 0 else 9 end rr from {_FOCUSED} where focused)) where case when b = 9 then position = 1 else rr = b end",
    "t3_candidate_order": f"select query, id, packed, row_number() over (partition by query order by packed desc, path, start_line, id) as position from (select *, tier_rank * 2048 + {_DEFBASE} + {_LOCAL} as packed from {_CAND})",
    "t5_group_order": f"select query, group_key, row_number() over (partition by query order by group_tier desc, case kind when 'function' then 0 when 'method' then 1 when 'type' then 2 when 'alias' then 3 when 'object' then 4 when 'enum_constant' then 5 when 'macro' then 6 else 9 end, group_key) as place from {_GROUPED} where position = 1",
    "x8_confidence": f"select query, id, tier, confidence, case tier when 'current' then 'current_file' when 'reachable' then 'reachable_include' when 'external' then 'external_first_layer' else 'global_fallback' end as reason, case when tier <> 'current' then case confidence when 'reachable' then 'reachable' when 'heuristic' then 'external' when 'ambiguous' then 'ambiguous' when 'fallback' then 'global' end end as label, case tier when 'current' then 'current_visible' when 'reachable' then 'reachable' when 'external' then 'external_first_layer' when 'unknown' then 'uncertain' else 'workspace_fallback' end as visibility from (select *, case when tier = 'current' then 'exact' when tier = 'reachable' then 'reachable' when tier = 'external' then 'heuristic' when tier = 'unknown' and open_reason = 'ambiguous_include' then 'ambiguous' else 'fallback' end as confidence from {_CAND})",
    "x9_definition_base": f"select id, {_DEFBASE} as base from {LIVE_SQL}",
    "f11_coloring_scope": f"select query, id from {_CAND} where tier in ('current', 'reachable', 'external') or (tier = 'unknown' and in_heuristic)",
    "f13_intent_gate": f"select kind, intent, case intent when 'neutral' then true when 'call' then kind in ('function', 'method') when 'type' then kind in ('type', 'alias') else kind in ('object', 'enum_constant', 'macro', 'function', 'method') end as accepts from (select distinct kind from {LIVE_SQL}), (values ('call'), ('type'), ('value'), ('neutral')) i(intent)",
    "a9_best_per_name": f"select query, id, tier from (select *, row_number() over (partition by query order by tier_rank desc, case fidelity when 'authoritative' then 2 when 'partial' then 1 else 0 end desc, id) r from {_CAND}) where r = 1",
    "a10_merged_evidence": f"select * from {_MERGED}",
    "x11_final_rank": f"""select current, name, (case when low_trust then least(rank, 8000 + least(greatest(project, 0), 350)) else rank end)::int as final_rank, low_trust from (select *,
 case source when 'local' then 12000 when 'overlay' then 9000 when 'indexed' then 5000 when 'builtin' then 2000 when 'word' then 0 else -1000 end + case tier when 'current' then 6000 when 'reachable' then 4800 when 'external' then 4200 when 'unknown' then 3200 else 2400 end + case confidence when 'exact' then 2000 when 'reachable' then 1500 when 'heuristic' then 1000 when 'ambiguous' then 500 else 0 end
 + match_score + least(greatest(proximity, 0), 750) + least(greatest(project, 0), 350) + case when kind in ('function', 'macro') then 800 when kind = 'variable' then -225 else 0 end + least(700, 120 * accepts) as rank,
 tier = 'global' and not regexp_matches(sources, 'local|overlay') and (contains(sources, 'word') or confidence = 'fallback') as low_trust from {_ACCEPTED})""",
    "x12_intent_matrix": _matrix_sql(),
    "a15_usage": f"select * from {_USAGE}",
    "x14_proximity": f"select path, name, least(200, case when cursor - nearest <= 32 then 120 when cursor - nearest <= 128 then 90 when cursor - nearest <= 512 then 60 when cursor - nearest <= 2048 then 30 else 10 end + 20 * least(uses - 1, 4))::int as proximity from {_USAGE}",
    "q_p18_callable_candidates": _arity_sql("and coalesce(a.owner_kind, '') <> 'record' and (coalesce(a.linkage_kind, '') <> 'internal' or a.path = s.path)"),
}
