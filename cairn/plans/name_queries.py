"""Queries over names: scalar functions X1 to X7, X15, X22, X33, look-ups F2 to F8, ranked search T1, T2, T8, T14, T15, W4, U4, U5, P1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import names as N
from cairn.operators import search
from cairn.plans.base import LIVE_SQL, NEEDLES, NEEDLES_SQL, live_anchors, needles


def _distinct_names(spark: SparkSession, folder: str) -> DataFrame:
    return live_anchors(spark, folder).where(F.col("name").isNotNull()).select("name").distinct()


_NAMES = f"(select distinct name from {LIVE_SQL} where name is not null) n"


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    return search.asked(_distinct_names(spark, folder), NEEDLES)


# --- SQL of the match functions ----------------------------------------------------------------------------------
def _sql_boundary(name: str, at: str) -> str:
    p, c = f"substr({name}, {at} - 1, 1)", f"substr({name}, {at}, 1)"
    return f"({at} = 1 or ({p} = '_' and {c} <> '_') or (regexp_matches({p}, '[a-z]') and regexp_matches({c}, '[A-Z]')) or (regexp_matches({p}, '[A-Za-z]') and regexp_matches({c}, '[0-9]')))"


def _sql_initials(name: str) -> str:
    return f"array_to_string(list_transform(list_filter(range(1, length({name}) + 1), lambda i: {_sql_boundary(name, 'i')}), lambda i: lower(substr({name}, i, 1))), '')"


def _sql_pattern(needle: str) -> str:
    return f"array_to_string(list_transform(string_split({needle}, ''), lambda c: regexp_escape(c)), '.*')"


def _sql_score(needle: str, name: str) -> str:
    n, low = f"lower({needle})", f"lower({name})"
    return f"""case when {low} = {n} then 1000 when starts_with({low}, {n}) then 800 when instr({low}, {n}) > 0 and {_sql_boundary(name, f'instr({low}, {n})')} then 650
 when instr({low}, {n}) > 0 then 500 when regexp_matches({_sql_initials(name)}, {_sql_pattern(n)}) then 400 when regexp_matches({low}, {_sql_pattern(n)}) then 200 end"""


SCORE = _sql_score("needle", "name")
_MATCHES = f"(select needle, name, {SCORE} as score from {_NAMES}, {NEEDLES_SQL})"


def x1_match_score(spark: SparkSession, folder: str) -> DataFrame:
    """Score of every stated needle against every name that it matches."""
    return _asked(spark, folder).withColumn("score", N.match_score(F.col("needle"), F.col("name"))).where("score is not null")


def x2_boundary_initials(spark: SparkSession, folder: str) -> DataFrame:
    """Characters at word boundaries of every name."""
    return _distinct_names(spark, folder).withColumn("initials", N.boundary_initials(F.col("name")))


def x3_subsequence(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a needle runs through a name's boundaries, or through the name at all."""
    p = N.subsequence_pattern(N.lower_ascii(F.col("needle")))
    return _asked(spark, folder).select("needle", "name", F.regexp_like(N.boundary_initials(F.col("name")), p).alias("by_initials"), F.regexp_like(N.lower_ascii(F.col("name")), p).alias("anywhere"))


def x4_word_score(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of words of the current file."""
    return _asked(spark, folder).withColumn("score", N.word_score(F.col("needle"), F.col("name"), F.lit(50))).where("score is not null")


def x5_short_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Matches that the gate for short needles lets through."""
    return x1_match_score(spark, folder).where(N.passes_short_gate(F.col("needle"), F.col("score")))


def _in_context(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors with the first path of their repository as the current file."""
    repo = F.split("path", "/")[0]
    a = live_anchors(spark, folder).where("path is not null").withColumn("repo", repo)
    return a.join(a.groupBy("repo").agg(F.min("path").alias("current")), "repo")


_CONTEXT = f"(select a.*, min(path) over (partition by split_part(path, '/', 1)) as current from {LIVE_SQL} a where path is not null)"
_SHARED = "coalesce(list_position(list_transform(range(1, greatest(len(string_split(path, '/')), len(string_split(current, '/'))) + 1), lambda i: coalesce(string_split(path, '/')[i] = string_split(current, '/')[i], false)), false) - 1, len(string_split(path, '/')))"
_LOCAL = f"10 * least(10, {_SHARED})"


def x6_locality(spark: SparkSession, folder: str) -> DataFrame:
    """Nearness of every path to its repository's first one."""
    return _in_context(spark, folder).select("path", "current").distinct().withColumn("locality", N.locality(F.col("path"), F.col("current")))


def x7_pack_score(spark: SparkSession, folder: str) -> DataFrame:
    """Packed score of every anchor, its tier by whether it stands in the current file."""
    tier = F.when(F.col("path") == F.col("current"), "current").otherwise("global")
    return _in_context(spark, folder).select("id", N.pack_score(tier, F.lit(500), N.locality(F.col("path"), F.col("current"))).alias("packed"))


def x15_prefix_bucket(spark: SparkSession, folder: str) -> DataFrame:
    """Bucket of the prefix of every name."""
    return _distinct_names(spark, folder).withColumn("bucket", N.prefix_bucket(F.col("name")))


def x22_name_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Inverted index of names: trigrams, and triples of boundary characters."""
    n = _distinct_names(spark, folder)
    near = n.select("name", F.lit(False).alias("boundary"), F.explode(N.trigrams(F.col("name"))).alias("token"))
    return near.unionByName(n.select("name", F.lit(True).alias("boundary"), F.explode(N.initial_trigrams(N.boundary_initials(F.col("name")))).alias("token")))


def x22_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Names that hold a needle of three characters or more, found by way of the inverted index and then verified."""
    return search.by_trigrams(_distinct_names(spark, folder), needles(spark))


def x33_receiver_hint(spark: SparkSession, folder: str) -> DataFrame:
    """Names read as receivers."""
    return _distinct_names(spark, folder).withColumn("hint", N.receiver_hint(F.col("name")))


# --- look-ups ---------------------------------------------------------------------------------------------------
_WANTED = ("reset", "init", "close", "nothing_of_that_name")


def f2_exact_name(spark: SparkSession, folder: str) -> DataFrame:
    """The first 50 anchors of each stated name by id, and whether there are more."""
    wanted = spark.createDataFrame([(n,) for n in _WANTED], "name string")
    return search.first_by_name(live_anchors(spark, folder), wanted, 50).select("name", "id", "truncated")


def f3_exact_name_of_family(spark: SparkSession, folder: str) -> DataFrame:
    """The same within Go, and within the C family."""
    wanted = spark.createDataFrame([(n, f) for n in _WANTED for f in ("go", "c_family")], "name string, family string")
    a = live_anchors(spark, folder).withColumn("family", F.when(F.col("semantic_family") == "go", "go").otherwise("c_family"))
    return search.first_by_name(a, wanted, 50, ["family"]).select("name", "family", "id", "truncated")


def f4_name_in_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors of the stated names in the paths that define main."""
    a = live_anchors(spark, folder)
    paths = a.where("name = 'main'").select("path").distinct()
    return a.where(F.col("name").isin(*_WANTED)).join(paths, "path", "left_semi").select("name", "path", "id")


def f5_by_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors of stated ids: those of the first hundred per thousand call sites."""
    wanted = live_anchors(spark, folder).where(F.col("id") % 100 == 0).select("id")
    return live_anchors(spark, folder).join(wanted, "id", "left_semi").select("id", "name", "path")


def f6_by_key_and_name(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors that share both the entity key, without letter case, and the name of a stated anchor."""
    a = live_anchors(spark, folder).withColumn("key", F.lower("entity_key"))
    return search.same_entity(a, a.where(F.col("id") % 100 == 0)).select("query_id", "id")


def f7_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """Names that begin with a needle, letter case aside; underscores and per cent signs stand for themselves."""
    return _asked(spark, folder).where(F.startswith(N.lower_ascii(F.col("name")), N.lower_ascii(F.col("needle"))))


def f8_path_suffix(spark: SparkSession, folder: str) -> DataFrame:
    """Paths that end with the base name of a stated anchor's path."""
    p = live_anchors(spark, folder).where("path is not null").select("path").distinct()
    asked = live_anchors(spark, folder).where((F.col("id") % 100 == 0) & F.col("path").isNotNull()).select(F.element_at(F.split("path", "/"), -1).alias("rel")).distinct()
    return search.by_suffix(asked, p)


# --- ranked search ----------------------------------------------------------------------------------------------
_RANKED = ["needle", "position", "id", "packed"]


def t1_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The hundred best anchors of each needle in the total order of the search."""
    return search.ranked(_in_context(spark, folder), NEEDLES, 100).select(*_RANKED)


def t2_top_names(spark: SparkSession, folder: str) -> DataFrame:
    """The hundred best names over all needles."""
    return x1_match_score(spark, folder).orderBy(F.desc("score"), F.length("name"), "name", "needle").limit(100)


def t8_completion_order(spark: SparkSession, folder: str) -> DataFrame:
    """Order of completions: class of the match before its score, then length and name."""
    found = x5_short_gate(spark, folder).withColumn("match_class", N.match_class(F.col("needle"), F.col("name")))
    w = Window.partitionBy("needle").orderBy(F.desc("match_class"), F.desc("score"), F.char_length("name"), "name")
    return found.withColumn("position", F.row_number().over(w)).where("position <= 100").select("needle", "position", "name", "match_class")


def t14_prefix_range(spark: SparkSession, folder: str) -> DataFrame:
    """Prefix search as a range of the sorted names, which prunes row groups by their bounds."""
    return search.prefix_range(_distinct_names(spark, folder), "name", "reset", "str", "Pack")


def t15_workspace_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """The best 200 symbols over all roots, each root searched on its own."""
    return search.merged_roots(search.ranked(_in_context(spark, folder), ["reset"], 200, per=["repo"]), 200).select("position", "id", "packed")


def w4_recall_quotas(spark: SparkSession, folder: str) -> DataFrame:
    """Recall of each needle with quotas per channel, filled up from the global order."""
    return search.with_quotas(_in_context(spark, folder), NEEDLES, 40).select("needle", "position", "id", "channel")


def u4_priority_union(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors named reset of the priority paths first, then all of them, each once."""
    a = live_anchors(spark, folder).where("name = 'reset'").select("id", "path")
    first = a.where(F.length("path") % 5 == 0)
    return search.first_wins([first, a], "id", ["path"]).select("id", "path", "part")


def u5_narrowed_pool(spark: SparkSession, folder: str) -> DataFrame:
    """The pool of a longer needle taken from that of its beginning, which holds it."""
    pool = _distinct_names(spark, folder).withColumn("score", N.match_score(F.lit("re"), F.col("name"))).where("score is not null").select("name")
    return pool.withColumn("score", N.match_score(F.lit("res"), F.col("name"))).where("score is not null")


_ROLE = "case role when 'declaration' then 4 when 'tentative' then 3 when 'definition' then 2 when 'unknown' then 1 else 0 end"
_PACKED = f"""(select q.needle, c.*, split_part(path, '/', 1) as repo, ({SCORE.replace('name', 'c.name').replace('needle', 'q.needle')}) as score,
  case when external and directly_included then 2 when path = current then 4 else 0 end as tier, {_LOCAL} as local from {_CONTEXT} c, {NEEDLES_SQL} where name is not null)"""
_ORDER = f"packed desc, strlen(name), name, {_ROLE} desc, path, id"
_GATED = f"(select *, tier * 2048 + score + local as packed from {_PACKED} where score is not null and (strlen(needle) >= 3 or score >= 650))"

QUERIES = {
    "x1_match_score": x1_match_score, "x2_boundary_initials": x2_boundary_initials, "x3_subsequence": x3_subsequence, "x4_word_score": x4_word_score, "x5_short_gate": x5_short_gate,
    "x6_locality": x6_locality, "x7_pack_score": x7_pack_score, "x15_prefix_bucket": x15_prefix_bucket, "x22_name_tokens": x22_name_tokens, "x22_recall": x22_recall, "x33_receiver_hint": x33_receiver_hint,
    "f2_exact_name": f2_exact_name, "f3_exact_name_of_family": f3_exact_name_of_family, "f4_name_in_paths": f4_name_in_paths, "f5_by_ids": f5_by_ids, "f6_by_key_and_name": f6_by_key_and_name, "f7_prefix": f7_prefix, "f8_path_suffix": f8_path_suffix,
    "t1_ranked_search": t1_ranked_search, "t2_top_names": t2_top_names, "t8_completion_order": t8_completion_order, "t14_prefix_range": t14_prefix_range, "t15_workspace_symbols": t15_workspace_symbols,
    "w4_recall_quotas": w4_recall_quotas, "u4_priority_union": u4_priority_union, "u5_narrowed_pool": u5_narrowed_pool,
}

_WANTED_SQL = "(" + ", ".join(f"'{n}'" for n in _WANTED) + ")"
_TRI = "list_distinct(list_transform(case when length(name) - 2 <= 64 then range(1, length(name) - 1) else list_transform(range(0, 64), lambda i: (i * (length(name) - 3)) // 63 + 1) end, lambda i: substr(lower(name), i, 3)))"
_INI = f"substr({_sql_initials('name')}, 1, 8)"

SQL = {
    "x1_match_score": f"select * from {_MATCHES} where score is not null",
    "x2_boundary_initials": f"select name, {_sql_initials('name')} as initials from {_NAMES}",
    "x3_subsequence": f"select needle, name, regexp_matches({_sql_initials('name')}, {_sql_pattern('lower(needle)')}) as by_initials, regexp_matches(lower(name), {_sql_pattern('lower(needle)')}) as anywhere from {_NAMES}, {NEEDLES_SQL}",
    "x4_word_score": f"select * from (select needle, name, 50 + case when lower(name) = lower(needle) then 700 when starts_with(lower(name), lower(needle)) then 550 when instr(lower(name), lower(needle)) > 0 and (strlen(needle) >= 3 or {_sql_boundary('name', 'instr(lower(name), lower(needle))')}) then 250 end as score from {_NAMES}, {NEEDLES_SQL}) where score is not null",
    "x5_short_gate": f"select * from {_MATCHES} where score is not null and (strlen(needle) >= 3 or score >= 650)",
    "x6_locality": f"select distinct path, current, {_LOCAL} as locality from {_CONTEXT}",
    "x7_pack_score": f"select id, (case when path = current then 4 else 0 end) * 2048 + 500 + {_LOCAL} as packed from {_CONTEXT}",
    "x15_prefix_bucket": f"select name, coalesce(nullif(substr(lower(regexp_replace(name, '[^A-Za-z0-9_]', '', 'g')), 1, 2), ''), 'none') as bucket from {_NAMES}",
    "x22_name_tokens": f"select name, false as boundary, unnest({_TRI}) as token from {_NAMES} where length(name) > 2 union all select distinct name, true, substr(ini, i, 1) || substr(ini, j, 1) || substr(ini, k, 1) from (select name, {_INI} ini from {_NAMES}) t, range(1, 9) a(i), range(1, 9) b(j), range(1, 9) c(k) where i < j and j < k and k <= length(ini)",
    "x22_recall": f"select needle, name from {_NAMES}, {NEEDLES_SQL} where length(needle) >= 3 and instr(lower(name), lower(needle)) > 0",
    "x33_receiver_hint": f"select name, lower(regexp_replace(name, '^[_0-9]+', '')) as hint from {_NAMES}",
    "f2_exact_name": f"select name, id, n > 50 as truncated from (select name, id, row_number() over (partition by name order by id) r, count(*) over (partition by name) n from {LIVE_SQL} where name in {_WANTED_SQL}) where r <= 50",
    "f3_exact_name_of_family": f"select name, family, id, n > 50 as truncated from (select name, family, id, row_number() over (partition by name, family order by id) r, count(*) over (partition by name, family) n from (select *, case when semantic_family = 'go' then 'go' else 'c_family' end family from {LIVE_SQL}) where name in {_WANTED_SQL}) where r <= 50",
    "f4_name_in_paths": f"select name, path, id from {LIVE_SQL} where name in {_WANTED_SQL} and path in (select path from {LIVE_SQL} where name = 'main')",
    "f5_by_ids": f"select id, name, path from {LIVE_SQL} where id % 100 = 0",
    "f6_by_key_and_name": f"select q.id as query_id, a.id from {LIVE_SQL} q join {LIVE_SQL} a on lower(a.entity_key) = lower(q.entity_key) and a.name = q.name where q.id % 100 = 0",
    "f7_prefix": f"select needle, name from {_NAMES}, {NEEDLES_SQL} where starts_with(lower(name), lower(needle))",
    "f8_path_suffix": f"select distinct q.rel, p.path from (select distinct regexp_extract(path, '([^/]*)$', 1) rel from {LIVE_SQL} where id % 100 = 0 and path is not null) q join (select distinct path from {LIVE_SQL} where path is not null) p on p.path = q.rel or ends_with(p.path, '/' || q.rel)",
    "t1_ranked_search": f"select needle, position, id, packed from (select needle, id, packed, row_number() over (partition by needle order by {_ORDER}) as position from {_GATED}) where position <= 100",
    "t2_top_names": f"select * from {_MATCHES} where score is not null order by score desc, length(name), name, needle limit 100",
    "t8_completion_order": f"select needle, position, name, match_class from (select *, row_number() over (partition by needle order by match_class desc, score desc, length(name), name) as position from (select *, case when lower(name) = lower(needle) then 2 when starts_with(lower(name), lower(needle)) then 1 else 0 end as match_class from {_MATCHES} where score is not null and (strlen(needle) >= 3 or score >= 650))) where position <= 100",
    "t14_prefix_range": f"select p.prefix, n.name from {_NAMES} join (values ('reset'), ('str'), ('Pack')) p(prefix) on starts_with(n.name, p.prefix)",
    "t15_workspace_symbols": f"select row_number() over (order by {_ORDER}) as position, id, packed from {_GATED} where needle = 'reset' order by position limit 200",
    "w4_recall_quotas": f"""with g as (select *, case when tier >= 3 then 'reachable' when tier = 2 then 'external' when tier = 1 then 'unknown' else 'global' end as channel, row_number() over (partition by needle order by {_ORDER}) as place from {_GATED}),
 c as (select *, row_number() over (partition by needle, channel order by place) as r from g),
 k as (select *, (channel = 'reachable' and r <= 40) or (channel = 'external' and r <= 20) or (channel = 'unknown' and r <= 20) or (channel = 'global' and r <= 40) as quota from c),
 f as (select *, row_number() over (partition by needle order by quota desc, place) as taken from k)
 select needle, row_number() over (partition by needle order by place) as position, id, channel from (select * from f where taken <= 120) qualify position <= 40""",
    "u4_priority_union": f"select id, path, case when length(path) % 5 = 0 then 0 else 1 end as part from {LIVE_SQL} where name = 'reset'",
    "u5_narrowed_pool": f"select name, {_sql_score(chr(39) + 'res' + chr(39), 'name')} as score from {_NAMES} where ({_sql_score(chr(39) + 'res' + chr(39), 'name')}) is not null",
}
