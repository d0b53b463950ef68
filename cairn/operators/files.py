"""Files of a workspace: caps of external roots, include offers, change events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import names as N
from cairn.functions import paths as P


def capped_roots(entries: DataFrame, most_files: int = 20_000, most_bytes: int = 512 * 2**20) -> DataFrame:
    """Entries ``(root, size, ...)`` of the roots within both caps; a root over one of them is left out whole."""
    fit = entries.groupBy("root").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("s")).where((F.col("n") <= most_files) & (F.col("s") <= most_bytes))
    return entries.join(fit.select("root"), "root", "left_semi")


def rescued(primary: DataFrame, rescue: DataFrame, scope: str, closed: Column, enough: int = 8) -> DataFrame:
    """Rescue rows, without those of closed scopes in which the primary rows have ``enough`` distinct names."""
    full = primary.groupBy(scope).agg(F.countDistinct("name").alias("n")).where(F.col("n") >= enough).where(closed).select(scope)
    return rescue.join(full, scope, "left_anti")


def include_candidates(sources: DataFrame, headers: DataFrame, limit: int) -> DataFrame:
    """``(src, path, boost, position)``: headers of the source's own top directory, by directory, frequency of the base name and depth.

    Only the first ``limit`` headers of each top directory and of each directory can be offered; they are ranked once, before any source is looked at.
    """
    base = N.lower_ascii(P.basename(F.col("path")))
    h = headers.select("path", base.alias("base"), F.split("path", "/")[0].alias("top"), P.dirname(F.col("path")).alias("dir"))
    freq = h.groupBy("base").agg(F.least(F.count("*"), F.lit(20)).alias("freq"))
    depth = F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))
    worth = h.join(freq, "base").withColumn("worth", F.col("freq") - F.least(depth * 3, F.lit(20))).withColumn("near", F.least(F.col("worth") + 35, F.lit(49)))
    first = lambda key, by: worth.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(by), "path"))).where(F.col("_r") <= limit)
    s = sources.select("src", F.split("src", "/")[0].alias("top"), P.dirname(F.col("src")).alias("own"))
    far = s.join(first("top", "worth"), "top").where("own <> dir").select("src", "path", F.col("worth").alias("boost"))
    near = s.drop("top").join(first("dir", "near"), F.col("own") == F.col("dir")).select("src", "path", F.col("near").alias("boost"))
    w = Window.partitionBy("src").orderBy(F.desc("boost"), "path")
    return far.unionByName(near).withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)


def classified_changes(events: DataFrame, config_file: str = "cairn.json") -> DataFrame:
    """Change events ``(path, deleted, ...)`` with their ``decision``: full, project, upsert, delete or ignored. The configuration file and Go's module files ask for a full pass, other markers for the project."""
    low = N.lower_ascii(P.basename(F.col("path")))
    decision = (
        F.when(N.lower_ascii(F.col("path")) == config_file, "full")
        .when(low.isin("go.mod", "go.work"), "full")
        .when(P.is_marker(F.col("path")), "project")
        .when(P.in_scope(F.col("path")), F.when(F.col("deleted"), "delete").otherwise("upsert"))
        .otherwise("ignored")
    )
    return events.withColumn("decision", decision)


def coalesced(changes: DataFrame, root: str, path: str, newest: list[str]) -> DataFrame:
    """The queue to work off: one full pass per root that asks for it, else the last change of each file."""
    full = changes.where("decision = 'full'").select(root).distinct()
    rank = F.struct(*newest, "decision")
    dirty = changes.where("decision in ('upsert', 'delete')").join(full, root, "left_anti").groupBy(root, path).agg(F.max_by("decision", rank).alias("decision"))
    return full.withColumn(path, F.lit(None).cast("string")).withColumn("decision", F.lit("full")).unionByName(dirty)
