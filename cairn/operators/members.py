"""Records, type aliases and members."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.common import cut
from cairn.functions import names as N

MAX_HOPS = 16
STATUS = ("truncated", "cycle", "ambiguous", "unresolved", "unique_record")


def members_of(members: DataFrame, records: DataFrame) -> DataFrame:
    """Members of the given records: by record id where the member has one, else by the record's key within its file.

    members: ``record_id, file_id, record_key, ...``; records: ``record_id, file_id, record_key``. The two cases exclude each other.
    """
    by_id = members.where("record_id is not null").join(records.select("record_id").where("record_id is not null").distinct(), "record_id", "left_semi")
    by_key = members.where("record_id is null").join(records.select("file_id", "record_key").distinct(), ["file_id", "record_key"], "left_semi")
    return by_id.unionByName(by_key)


def resolve_aliases(queries: DataFrame, aliases: DataFrame, records: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """``(query, status, record, depth)``: where a chain of type names ends.

    queries: ``query`` (a name); aliases: ``name, target``; records: ``name``. A name that is a record ends its chain; several targets of one name make it ambiguous, a name
    met before a cycle, one without anything unresolved; what is still running after ``hops`` steps is truncated.
    """
    a = aliases.where("name is not null and target is not null").select("name", "target").distinct()
    a = cut(a.groupBy("name").agg(F.count("*").alias("n"), F.min("target").alias("target")))
    r = cut(records.where("name is not null").select("name").distinct().withColumn("is_record", F.lit(True)))
    running = queries.where("query is not null").select("query", F.col("query").alias("name"), F.array("query").alias("seen")).distinct()
    ended = []
    for depth in range(hops + 1):
        step = cut(running.join(r, "name", "left").join(a, "name", "left"))
        status = (
            F.when(F.col("is_record"), "unique_record")
            .when(F.col("n").isNull(), "unresolved")
            .when(F.col("n") > 1, "ambiguous")
            .when(F.array_contains("seen", F.col("target")), "cycle")
            .when(F.lit(depth == hops), "truncated")
        )
        step = step.withColumn("status", status)
        ended.append(step.where("status is not null").select("query", "status", F.when(F.col("is_record"), F.col("name")).alias("record"), F.lit(depth).alias("depth")))
        running = step.where("status is null").select("query", F.col("target").alias("name"), F.array_append("seen", F.col("target")).alias("seen"))
        if running.isEmpty():
            break
    return reduce(DataFrame.unionByName, ended)


def walk_chains(chains: DataFrame, members: DataFrame) -> DataFrame:
    """``(chain_id, record, ambiguous)``: the record that a member chain ends in.

    chains: ``chain_id, record, names array<string>``; members: ``owner, name, type_name``. Each hop is an equi-join; a hop with several types takes the least and marks
    the chain; a chain with an unknown member is missing.
    """
    m = members.where("owner is not null and type_name is not null").groupBy("owner", "name").agg(F.countDistinct("type_name").alias("n"), F.min("type_name").alias("type_name"))
    m = cut(m)
    running = chains.select("chain_id", "record", "names", F.lit(False).alias("ambiguous"))
    done = []
    while True:
        done.append(running.where("size(names) = 0").select("chain_id", "record", "ambiguous"))
        open_ = running.where("size(names) > 0").select("chain_id", "ambiguous", F.col("names")[0].alias("name"), F.expr("slice(names, 2, size(names))").alias("names"), F.col("record").alias("owner"))
        running = cut(open_.join(m, ["owner", "name"]).select("chain_id", F.col("type_name").alias("record"), "names", (F.col("ambiguous") | (F.col("n") > 1)).alias("ambiguous")))
        if running.isEmpty():
            return reduce(DataFrame.unionByName, done)


def fallback_members(members: DataFrame, limit: int) -> DataFrame:
    """Members of whatever record by name and kind: ``lower_name, kind, freq``, the best tier and its least signature, in the order of tier, frequency, kind and name; the first ``limit``, ``truncated`` if there are more.

    members: ``name, kind, tier, signature``.
    """
    rank = N.tier_rank(F.col("tier"))
    per = members.where("name is not null").groupBy(N.lower_ascii(F.col("name")).alias("lower_name"), "kind").agg(
        F.count("*").alias("freq"), F.max(rank).alias("tier_rank"), F.min(F.struct((-rank).alias("t"), F.coalesce("signature", F.lit("")).alias("signature"), "name")).alias("b")
    )
    per = per.select("lower_name", "kind", "freq", "tier_rank", F.col("b.name").alias("name"), F.col("b.signature").alias("signature"))
    order = [F.desc("tier_rank"), F.desc("freq"), (F.col("kind") != "method").cast("int"), F.col("name"), F.col("signature")]
    top = per.orderBy(*order).limit(limit + 1)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order))).withColumn("truncated", F.max("position").over(Window.partitionBy()) > limit).where(F.col("position") <= limit)
