"""Candidate sets: grouping by logical entity, focus, disposition, presentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import names as N
from cairn.functions import ranking as R

# Order of kinds and roles.
KIND_RANK = {"function": 0, "method": 1, "type": 2, "alias": 3, "object": 4, "enum_constant": 5, "macro": 6}
ROLE_RANK = {"definition": 3, "tentative": 2, "declaration": 1, "unknown": 0}
FIDELITY_RANK = {"authoritative": 2, "partial": 1, "low": 0}


def blank(c: Column) -> Column:
    """Null or nothing but space."""
    return F.coalesce(F.trim(c), F.lit("")) == ""


def with_tiers(rows: DataFrame, reached: DataFrame, scopes: DataFrame, direct: DataFrame) -> DataFrame:
    """Rows ``(current, path, external, ...)`` with their ``tier``, ``in_heuristic`` and ``open_reason`` by the reach of the current file.

    reached: ``origin, path, is_heuristic``; scopes: ``origin, open, reason``; direct: ``src, dst``, first-layer external targets. A null current file is no context: global.
    """
    files = reached.select(F.col("origin").alias("current"), "path", "is_heuristic")
    first = direct.select(F.col("src").alias("current"), F.col("dst").alias("path"), F.lit(True).alias("direct"))
    c = rows.join(files, ["current", "path"], "left").join(first, ["current", "path"], "left")
    c = c.join(scopes.select(F.col("origin").alias("current"), F.col("open").alias("open_"), F.col("reason").alias("open_reason")), "current", "left")
    yes = lambda x: F.coalesce(x, F.lit(False))
    known = F.col("open_").isNotNull()
    tier = R.scope_tier(yes(F.col("external")), yes(F.col("direct")), F.col("current").isNotNull(), F.col("path") == F.col("current"), known, yes(~F.col("is_heuristic")), yes(F.col("is_heuristic")), yes(F.col("open_")))
    return c.withColumn("tier", tier).withColumn("in_heuristic", yes(F.col("is_heuristic"))).drop("is_heuristic", "direct", "open_")


def candidate_order() -> list[Column]:
    """Order of candidates within a group."""
    return [F.desc("tier_rank"), F.desc(R.lookup(F.col("fidelity"), FIDELITY_RANK, 0)), F.desc(R.lookup(F.col("role"), ROLE_RANK, 0)), F.desc(blank(F.col("guard")).cast("int")), F.desc("origin_rank"), F.col("path"), F.col("start_byte"), F.col("id")]


def grouped(candidates: DataFrame) -> DataFrame:
    """Candidates with their group: ``query, group_key, position`` and the group's tier, authority, fidelity and size.

    candidates: ``query, id, logical_key, kind, tier, fidelity (authoritative, partial, low), role, guard, origin_rank, path, start_byte``. Rows of low
    fidelity, and those without a key, stay on their own; the others are one group per key of a query.
    """
    alone = (F.col("fidelity") == "low") | F.col("logical_key").isNull()
    key = F.when(alone, F.concat(F.lit("#"), F.col("id").cast("string"))).otherwise(F.concat(F.lit("="), F.col("logical_key")))
    rows = candidates.withColumn("group_key", key).withColumn("tier_rank", N.tier_rank(F.col("tier")))
    w = Window.partitionBy("query", "group_key")
    return (
        rows.withColumn("position", F.row_number().over(w.orderBy(*candidate_order())))
        .withColumn("group_tier", F.max("tier_rank").over(w))
        .withColumn("authoritative", F.max((F.col("fidelity") == "authoritative").cast("int")).over(w) == 1)
        .withColumn("low_fidelity", F.max((F.col("fidelity") == "authoritative").cast("int")).over(w) == 0)
        .withColumn("group_size", F.count("*").over(w))
    )


def focus(groups: DataFrame, intent: Column) -> DataFrame:
    """Grouped candidates with ``focused``: the group has the highest tier among those the intent accepts, or among all if it accepts none."""
    accepts = R.intent_accepts(intent, F.col("kind")).cast("int")
    per_group = groups.groupBy("query", "group_key").agg(F.max(accepts).alias("accepted"), F.max("group_tier").alias("top"))
    # Per query by aggregation, not by a window: a frequent name's candidates never come together in one task.
    per_query = per_group.groupBy("query").agg(F.max("accepted").alias("any_accepted"), F.max(F.struct("accepted", "top")).alias("x")).select("query", "any_accepted", F.col("x.top").alias("best"))
    focused = per_group.join(per_query, "query").select("query", "group_key", ((F.col("accepted") == F.col("any_accepted")) & (F.col("top") == F.col("best"))).alias("focused"))
    return groups.join(focused, ["query", "group_key"])


def dispositions(focused: DataFrame, complete: Column) -> DataFrame:
    """Per query: groups, focused groups, alternatives outside them, and the disposition. complete: whether the query's scope is closed and nothing was cut off."""
    one = focused.where("position = 1")
    per = one.groupBy("query").agg(
        F.count("*").alias("n_groups"),
        F.sum(F.col("focused").cast("int")).alias("n_focused"),
        F.sum(F.col("authoritative").cast("int")).alias("n_authoritative"),
        F.coalesce(F.min(F.when(F.col("focused"), (F.col("authoritative") & ~F.col("low_fidelity")).cast("int"))), F.lit(0)).alias("ok"),
        F.sum(F.when(~F.col("focused"), F.col("group_size")).otherwise(0)).alias("alternative_count"),
        (F.min(complete.cast("int")) == 1).alias("complete"),
    )
    return per.select("query", "n_groups", "n_focused", "alternative_count", R.disposition(F.col("n_authoritative"), F.col("n_focused"), F.col("ok") == 1, F.col("complete")).alias("disposition"))


def navigation(focused: DataFrame, declaration: bool) -> DataFrame:
    """What a jump presents: of each focused group the rows of the preferred role. A jump to the declaration prefers declarations and falls back to the first candidate."""
    rows = focused.where("focused")
    w = Window.partitionBy("query", "group_key")
    rank = R.lookup(F.col("role"), {"declaration": 0} if declaration else {"definition": 0, "tentative": 1, "declaration": 2, "unknown": 3}, 9)
    rows = rows.withColumn("role_rank", rank).withColumn("best", F.min("role_rank").over(w))
    return rows.where(F.when(F.col("best") == 9, F.col("position") == 1).otherwise(F.col("role_rank") == F.col("best")))


def best_per_name(rows: DataFrame, name: str, rank: list[Column], order: list[Column]) -> DataFrame:
    """One row per name: the highest rank, the first of equals by ``order``."""
    w = Window.partitionBy(name).orderBy(*[r.desc() for r in rank], *order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def merged(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Evidence of one name from several sources as one row per ``name``, and per request where ``keys`` name it.

    rows: ``name, source, tier, confidence, score, match_score, proximity, project, kind, role, seq``. The winner (by source, tier, confidence, project
    score, role, score, and the earliest) gives source and role; the other fields are maxima of their own; the sources are gathered.
    """
    rank = F.struct(
        R.lookup(F.col("source"), R.SOURCE_PRIORITY).alias("s"), N.tier_rank(F.col("tier")).alias("t"), R.lookup(F.col("confidence"), R.CONFIDENCE_RANK).alias("c"), F.col("project").alias("p"),
        R.lookup(F.col("role"), R.ROLE_PRIORITY, 0).alias("r"), F.col("score").alias("x"), (-F.col("seq")).alias("o"),
    )
    best = lambda c, values: F.max_by(c, R.lookup(F.col(c), values))
    return rows.groupBy(*(keys or []), "name").agg(
        F.max_by(F.struct("source", "role", "kind"), rank).alias("w"),
        F.max_by("tier", N.tier_rank(F.col("tier"))).alias("tier"),
        best("confidence", R.CONFIDENCE_RANK).alias("confidence"),
        *[F.max(c).alias(c) for c in ("score", "match_score", "proximity", "project")],
        F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"),
    ).select(*(keys or []), "name", F.col("w.source").alias("source"), F.col("w.role").alias("role"), F.col("w.kind").alias("kind"), "tier", "confidence", "score", "match_score", "proximity", "project", "sources")


def dominant_kind(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, dominant)``: the label that most rows have, null on a tie. rows: ``keys, label, own``; where a key has rows with ``own`` 1 only those count."""
    per = rows.groupBy(*keys, "own", "label").agg(F.count("*").alias("n"))  # few rows per key from here on
    w = Window.partitionBy(*keys)
    top = per.withColumn("best", F.max("own").over(w)).where("own = best").withColumn("most", F.max("n").over(w)).where("n = most")
    return top.groupBy(*keys).agg(F.when(F.count("*") == 1, F.max("label")).alias("dominant"))
