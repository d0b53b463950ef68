"""Look-ups and ranked retrieval of names."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import names as N
from cairn.functions.ranking import ROLE_PRIORITY, lookup


def first_by_name(rows: DataFrame, wanted: DataFrame, limit: int, also: list[str] | None = None) -> DataFrame:
    """The first ``limit`` rows by id of each wanted name, with ``truncated`` if there are more. A wanted name without rows has none."""
    keys = ["name", *(also or [])]
    found = rows.join(wanted.distinct(), keys, "left_semi")
    w = Window.partitionBy(*keys).orderBy("id")
    probed = found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit + 1)  # kept per group before the shuffle
    more = Window.partitionBy(*keys)
    return probed.withColumn("truncated", F.max("r").over(more) > limit).where(F.col("r") <= limit)


def same_entity(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows with both the key and the name of an asked one, as ``(query_id, id)``; null keys or names match nothing."""
    return asked.select(F.col("id").alias("query_id"), "key", "name").join(rows.select("id", "key", "name"), ["key", "name"])


def by_trigrams(names: DataFrame, needles: DataFrame) -> DataFrame:
    """``(needle, name)`` of the names that hold a needle of three or more characters: all its trigrams are looked up in the inverted index of the names, then the match is verified."""
    low = lambda c: N.lower_ascii(F.col(c))
    every = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substr(low(c), i, F.lit(3)))
    index = names.where(F.length("name") >= 3).select("name", F.explode(F.array_distinct(every("name"))).alias("token"))
    asked = needles.where(F.length("needle") >= 3).select("needle", F.array_distinct(every("needle")).alias("tokens"))
    wanted = asked.select("needle", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    hits = index.join(wanted, "token").groupBy("needle", "name", "n").agg(F.count("*").alias("found")).where("found = n")
    return hits.where(F.instr(low("name"), low("needle")) > 0).select("needle", "name")


def by_word_start(names: DataFrame, asked: DataFrame) -> DataFrame:
    """``(prefix, name, score)``: the names in which a prefix of one or two characters begins a word, and what the match is worth. An equi-join on the first two characters of every word of the names; the match is verified."""
    low = N.lower_ascii(F.col("name"))
    starts = F.filter(F.sequence(F.lit(1), F.length("name")), lambda i: N.starts_word(F.col("name"), i))
    words = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(F.substr(low, i, F.lit(1)), F.substr(low, i, F.lit(2))))))
    index = names.where(F.length("name") > 0).select("name", F.explode(words).alias("token"))
    wanted = asked.where(F.length("prefix").between(1, 2)).select("prefix", N.lower_ascii(F.col("prefix")).alias("token")).distinct()
    hits = index.join(wanted, "token").select("prefix", "name", N.match_score(F.col("prefix"), F.col("name")).alias("score"))
    return hits.where(F.col("score").isNotNull() & N.passes_short_gate(F.col("prefix"), F.col("score")))


def by_suffix(asked: DataFrame, paths: DataFrame) -> DataFrame:
    """``(rel, path)``: the paths that are ``rel`` or end with it behind a slash, by an equi-join on all suffixes of whole segments."""
    parts = F.split("path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    return paths.select("path", F.explode(suffixes).alias("rel")).join(asked.distinct(), "rel").select("rel", "path").distinct()


def asked(rows: DataFrame, needles: Sequence[str]) -> DataFrame:
    """Each row with every one of the stated needles; without needles no rows."""
    return rows.withColumn("needle", F.explode(F.array(*[F.lit(n) for n in needles]).cast("array<string>")))


def scored(rows: DataFrame, needles: Sequence[str]) -> DataFrame:
    """Rows ``(id, name, path, role, external, directly_included, current)`` with each needle they match, the score, the tier and the packed score.

    The needles are the stated queries of a search and go to all rows; a null name matches nothing.
    """
    found = asked(rows.where(F.col("name").isNotNull()), needles)
    score = N.match_score(F.col("needle"), F.col("name"))
    tier = F.when(F.coalesce(F.col("external") & F.col("directly_included"), F.lit(False)), "external").when(F.col("path") == F.col("current"), "current").otherwise("global")
    found = found.withColumn("score", score).where(F.col("score").isNotNull() & N.passes_short_gate(F.col("needle"), F.col("score")))
    return found.withColumn("tier", tier).withColumn("packed", N.pack_score(F.col("tier"), F.col("score"), N.locality(F.col("path"), F.col("current"))))


def search_order() -> list[Column]:
    """Total order of a search."""
    return [F.desc("packed"), F.octet_length("name"), F.col("name"), F.desc(lookup(F.col("role"), ROLE_PRIORITY, 0)), F.col("path"), F.col("id")]


def ranked(rows: DataFrame, needles: Sequence[str], limit: int, per: list[str] | None = None) -> DataFrame:
    """The first ``limit`` rows of each needle (and of each value of ``per``) with their ``position``."""
    w = Window.partitionBy("needle", *(per or [])).orderBy(*search_order())
    return scored(rows, needles).withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)


def merged_roots(parts: DataFrame, limit: int) -> DataFrame:
    """Results of several roots in one order."""
    top = parts.drop("position").orderBy(*search_order()).limit(limit)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*search_order())))  # at most ``limit`` rows


def with_quotas(rows: DataFrame, needles: Sequence[str], limit: int) -> DataFrame:
    """Recall with quotas: at most ``limit`` reachable and global rows and half as many external and unknown ones, then the best of the rest up to three times ``limit``; the first ``limit`` of these in order."""
    channel = F.when(F.col("tier").isin("current", "reachable"), "reachable").otherwise(F.col("tier"))
    found = scored(rows, needles).withColumn("channel", channel)
    # No row behind the first 3 * limit of its channel can be taken; they are dropped before the shuffle.
    near = Window.partitionBy("needle", "channel").orderBy(*search_order())
    found = found.withColumn("r", F.row_number().over(near)).where(F.col("r") <= 3 * limit)
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("needle").orderBy(*search_order())))
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("needle", "channel").orderBy("place")))
    quota = F.when(F.col("channel").isin("reachable", "global"), limit).otherwise(limit // 2)
    found = found.withColumn("spare", (F.col("r") > quota).cast("int"))
    found = found.withColumn("taken", F.row_number().over(Window.partitionBy("needle").orderBy("spare", "place"))).where(F.col("taken") <= 3 * limit)
    return found.withColumn("position", F.row_number().over(Window.partitionBy("needle").orderBy("place"))).where(F.col("position") <= limit)


def prefix_range(rows: DataFrame, column: str, *prefixes: str) -> DataFrame:
    """Rows whose column begins with a prefix, as range predicates that reach the scan's statistics."""
    found = []
    for p in prefixes:
        above = p[:-1] + chr(ord(p[-1]) + 1)
        found.append(rows.where((F.col(column) >= p) & (F.col(column) < above)).select(F.lit(p).alias("prefix"), column))
    return reduce(DataFrame.unionByName, found)


def first_wins(parts: list[DataFrame], key: str, keep: list[str]) -> DataFrame:
    """Union of parts in their order, each key once, where it comes first: ``key, part, *keep``."""
    rows = reduce(DataFrame.unionByName, [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)])
    return rows.groupBy(key).agg(F.min(F.struct("part", *keep)).alias("x")).select(key, "x.*")


def top_per_key(rows: DataFrame, key: str, order: list[Column], limit: int, salts: int = 32) -> DataFrame:
    """The first ``limit`` rows of each key with their ``position``, for limits above what the optimizer cuts before the shuffle: every key is cut in ``salts`` parts first."""
    salted = rows.withColumn("_s", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)))
    part = salted.withColumn("_p", F.row_number().over(Window.partitionBy(key, "_s").orderBy(*order))).where(F.col("_p") <= limit).drop("_s", "_p")
    return part.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("position") <= limit)
