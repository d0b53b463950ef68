"""Include resolution: raw include texts to files, in tiers of decreasing strength."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import paths as P


def _suffix_index(files: DataFrame) -> DataFrame:
    """Per suffix of whole segments of a workspace path: how many files end with it, and the least of them."""
    parts = F.split("path", "/")
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    return files.where("source = 'workspace'").select("path").distinct().select("path", F.explode(every).alias("rel"))


def resolve_includes(includes: DataFrame, files: DataFrame, roots: Sequence[str] = ()) -> DataFrame:
    """``(src, target_text, rel, status, kind, dst, n_candidates)`` per include.

    includes: ``src, target_text``; files: ``path, source``. Quoted targets are looked up beside the source, then from the workspace's top, then
    below each root in order; angled ones below the roots first, then from the top. What no exact tier finds is matched by suffix
    against workspace files: one match is an edge, several are ambiguous, none or no well-formed target is unresolved. Each tier is an
    equi-join on a key, made once per distinct target except beside the source; matches by suffix are counted, not listed, so frequent base names cost nothing.
    """
    text = F.col("target_text")
    rows = includes.select("src", "target_text").distinct()
    targets = includes.select("target_text").distinct().withColumn("form", P.include_form(text)).withColumn("rel", P.include_path(text))
    below = [F.concat(F.lit(r.rstrip("/") + "/"), F.col("rel")) for r in roots]
    n = len(roots)
    keys = [
        F.struct(F.when(F.col("form") == "quote", 1).otherwise(2 + n).alias("rank"), F.col("rel").alias("key"), F.lit("workspace_exact").alias("kind")),
        *[F.struct(F.lit(2 + i).alias("rank"), k.alias("key"), F.lit("external_exact").alias("kind")) for i, k in enumerate(below)],
    ]
    known = files.select(F.col("path").alias("key")).distinct()
    tried = targets.select("target_text", F.explode(F.array(*keys)).alias("k")).select("target_text", "k.*")
    exact = tried.join(known, "key").groupBy("target_text").agg(F.min(F.struct("rank", "kind", F.col("key").alias("dst"))).alias("e"))
    by_suffix = _suffix_index(files).groupBy("rel").agg(F.count("*").alias("n"), F.min("path").alias("least"))
    targets = targets.join(exact, "target_text", "left").join(by_suffix, "rel", "left")
    folder = P.dirname(F.col("src"))
    # Only what stands beside the source depends on the source as well; a line that looks for nothing there has a key of its own that no path equals.
    beside = F.when((F.col("form") == "quote") & (folder != ""), F.concat(folder, F.lit("/"), F.col("rel")))
    joined = rows.join(targets.hint("shuffle_hash"), "target_text", "left").withColumn("beside", F.coalesce(beside, F.concat(F.lit("\0"), "src")))
    joined = joined.join(known.select(F.col("key").alias("beside"), F.lit(True).alias("near")).hint("shuffle_hash"), "beside", "left")
    # A line of no known source leads nowhere.
    found = F.col("src").isNotNull() & (F.col("near").isNotNull() | F.col("e").isNotNull())
    count = F.when(F.col("src").isNull(), 0).otherwise(F.coalesce(F.col("n"), F.lit(0)))
    return joined.select(
        "src", "target_text", "rel",
        F.when(found | (count == 1), "edge").when(count > 1, "ambiguous").otherwise("unresolved").alias("status"),
        F.when(F.col("near"), "relative_exact").when(found, F.col("e.kind")).when(count >= 1, "suffix_match").alias("kind"),
        F.when(F.col("near"), F.col("beside")).when(found, F.col("e.dst")).when(count == 1, F.col("least")).alias("dst"),
        F.when(found, F.lit(1)).otherwise(count).cast("long").alias("n_candidates"),
    )


def include_edges(resolved: DataFrame, files: DataFrame) -> DataFrame:
    """``(src, dst, resolution)``, the strongest per pair, without self-edges; ambiguous includes give weak edges to all their candidates."""
    sure = resolved.where("status = 'edge'").select("src", "dst", F.col("kind").alias("resolution"))
    wide = resolved.where("status = 'ambiguous'").select("src", "rel").distinct().join(_suffix_index(files), "rel").select("src", F.col("path").alias("dst"), F.lit("suffix_match").alias("resolution"))
    every = sure.unionByName(wide).where("src <> dst")
    order = {"relative_exact": 0, "workspace_exact": 1, "external_exact": 2, "suffix_match": 3}
    rank = F.coalesce(*[F.when(F.col("resolution") == k, v) for k, v in order.items()])
    return every.groupBy("src", "dst").agg(F.min_by("resolution", rank).alias("resolution"))


def open_counts(resolved: DataFrame) -> DataFrame:
    """Unresolved and ambiguous includes per file that has any."""
    per = resolved.groupBy("src").agg(F.count(F.when(F.col("status") == "unresolved", 1)).alias("unresolved_includes"), F.count(F.when(F.col("status") == "ambiguous", 1)).alias("ambiguous_includes"))
    return per.where("unresolved_includes + ambiguous_includes > 0")


def open_nodes(resolved: DataFrame) -> DataFrame:
    """``(src, reason)`` of files whose includes leave their scope open: unresolved goes before ambiguous."""
    return open_counts(resolved).select("src", F.when(F.col("unresolved_includes") > 0, "unresolved_include").otherwise("ambiguous_include").alias("reason"))


def directly_included(edges: DataFrame, files: DataFrame) -> DataFrame:
    """``(path, directly_included)`` of external files: whether a workspace file includes them as an exact external target."""
    inside = files.where("source = 'workspace'").select(F.col("path").alias("src"))
    hit = edges.where("resolution = 'external_exact'").join(inside, "src", "left_semi").select(F.col("dst").alias("path")).distinct()
    outside = files.where("source = 'external'").select("path")
    return outside.join(hit.withColumn("directly_included", F.lit(True)), "path", "left").select("path", F.coalesce("directly_included", F.lit(False)).alias("directly_included"))


def affected_sources(includes: DataFrame, changed: DataFrame) -> DataFrame:
    """Sources to resolve again after the changed paths came or went: those with an include of the same base name or of the very path."""
    rows = includes.withColumn("rel", P.include_path(F.col("target_text"))).where("rel is not null").withColumn("base", P.basename(F.col("rel")))
    names = changed.select(P.basename(F.col("path")).alias("base")).distinct()
    whole = changed.select(F.col("path").alias("rel")).distinct()
    return rows.join(names, "base", "left_semi").select("src").unionByName(rows.join(whole, "rel", "left_semi").select("src")).distinct()
