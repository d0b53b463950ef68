"""Go packages: modules, import paths, package graph; project markers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import paths as P
from cairn.functions.names import lower_ascii


#: Fixed value: levels above a package at which its module is looked for.
MODULE_LEVELS = 64


def nearest_ancestor(files: DataFrame, owners: DataFrame, *, fold_case: bool = False, most: int | None = None) -> DataFrame:
    """``(path, dir, value)``: the deepest owner directory at or above each file, at most ``most`` levels up if that is given; files without one are missing.

    files: ``path``; owners: ``dir, value``. An as-of join on path prefixes: the ancestors are exploded and joined by equality. Of several values
    of one directory the least is taken.
    """
    key = lower_ascii if fold_case else (lambda c: c)
    above = F.reverse(P.ancestors(F.col("path")))
    up_to = above if most is None else F.slice(above, 1, most)
    up = files.select("path").distinct().select("path", F.explode(up_to).alias("dir"))
    own = owners.groupBy(key(F.col("dir")).alias("k")).agg(F.min("value").alias("value"), F.min("dir").alias("own_dir"))
    return up.join(own, key(F.col("dir")) == F.col("k")).groupBy("path").agg(F.max_by(F.struct("own_dir", "value"), F.length("dir")).alias("x")).select("path", F.col("x.own_dir").alias("dir"), "x.value")


def package_key(path, name):
    """Physical package: directory and name."""
    d = P.dirname(path)
    return F.concat(F.when(d == "", ".").otherwise(d), F.lit("#"), name)


def import_paths(packages: DataFrame, modules: DataFrame) -> DataFrame:
    """``(package, dir, import_path)``: what follows ``vendor/``, else the nearest module's path and the rest; null without either.

    packages: ``package, dir, name``; modules: ``dir, module``. main and external test packages cannot be imported.
    """
    ok = packages.where("name <> 'main' and not endswith(name, '_test')")
    near = nearest_ancestor(ok.select(F.concat("dir", F.lit("/x")).alias("path")), modules.withColumnRenamed("module", "value"), most=MODULE_LEVELS).select(F.expr("left(path, length(path) - 2)").alias("dir"), F.col("dir").alias("module_dir"), F.col("value").alias("module"))
    joined = ok.join(near, "dir", "left")
    vendored = F.regexp_extract("dir", r"(?:^|.*/)vendor/(.+)$", 1)
    rest = F.when(F.col("module_dir") == F.col("dir"), "").when(F.col("module_dir") == "", F.concat(F.lit("/"), F.col("dir"))).otherwise(F.expr("substr(dir, length(module_dir) + 1)"))
    return joined.select("package", "dir", F.when(vendored != "", vendored).otherwise(F.concat("module", rest)).alias("import_path"))


def package_edges(imports: DataFrame, importable: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges ``(src, dst, resolution)`` and open packages ``(src, reason)``.

    imports: ``src, import_path``; importable: ``package, import_path``. One provider is an exact edge, several are heuristic ones and leave the
    package open, none leaves it open; ``C`` is a boundary. The strongest reason stands: boundary, unresolved, ambiguous.
    """
    asked = imports.where("import_path is not null").select("src", "import_path").distinct()
    known = importable.where("import_path is not null").select(F.col("package").alias("dst"), "import_path").distinct()
    count = known.groupBy("import_path").agg(F.count("*").alias("n"))
    judged = asked.join(count, "import_path", "left")
    edges = judged.where("n is not null and import_path <> 'C'").join(known, "import_path").where("src <> dst").groupBy("src", "dst").agg(F.min(F.when(F.col("n") == 1, "exact").otherwise("heuristic")).alias("resolution"))
    rank = F.when(F.col("import_path") == "C", 0).when(F.col("n").isNull(), 1).when(F.col("n") > 1, 2)
    names = F.when(F.col("r") == 0, "boundary").when(F.col("r") == 1, "unresolved_import").otherwise("ambiguous_import")
    return edges, judged.withColumn("r", rank).where("r is not null").groupBy("src").agg(F.min("r").alias("r")).select("src", names.alias("reason"))


def project_markers(files: DataFrame) -> DataFrame:
    """``(dir, markers, n_markers)``: directories with marker files, without letter case."""
    found = files.select("path").where(P.is_marker(F.col("path"))).select(lower_ascii(P.dirname(F.col("path"))).alias("dir"), P.basename(F.col("path")).alias("marker"))
    return found.groupBy("dir").agg(F.array_join(F.sort_array(F.collect_set(lower_ascii(F.col("marker")))), ",").alias("markers"), F.countDistinct(lower_ascii(F.col("marker"))).alias("n_markers"))
