"""Sources: trees of files, configuration, Go modules, history; sinks for results."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import paths as P


@dataclass
class WorkspaceConfig:
    """Scope and languages of a workspace."""

    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    extensions: list[str] = field(default_factory=lambda: list(P.LANGUAGE_OF))
    excluded_dirs: list[str] = field(default_factory=lambda: list(P.EXCLUDED_DIRS))
    language_overrides: list[tuple[str, str]] = field(default_factory=list)
    include_roots: list[str] = field(default_factory=list)


def load_config(text: str | None) -> tuple[WorkspaceConfig, list[str]]:
    """Configuration from JSON with the issues found; what is missing or wrong has its default."""
    config, issues = WorkspaceConfig(), []
    if text is None:
        return config, issues
    try:
        raw = json.loads(text)
    except ValueError as e:
        return config, [f"not readable: {e}"]
    if not isinstance(raw, dict):
        return config, ["not an object"]
    for name in ("include", "exclude", "extensions", "excluded_dirs", "include_roots"):
        value = raw.pop(name, None)
        if value is None:
            continue
        if isinstance(value, list) and all(isinstance(v, str) for v in value):
            setattr(config, name, [v.lstrip(".").lower() if name == "extensions" else v.replace("\\", "/").strip("/") if name in ("include", "exclude") else v for v in value])
        else:
            issues.append(f"{name}: not a list of strings")
    over = raw.pop("language_overrides", [])
    for o in over if isinstance(over, list) else []:
        if isinstance(o, dict) and isinstance(o.get("glob"), str) and o.get("language") in ("c", "cpp", "go"):
            config.language_overrides.append((o["glob"], o["language"]))
        else:
            issues.append("language_overrides: entry without glob and known language")
    issues += [f"{k}: unknown" for k in raw]
    return config, issues


def tree_rules(spark: SparkSession, root: str) -> list[tuple[str, bool, bool]]:
    """Rules of the ignore files of a tree. Spark's listing hides their names, so they are looked up in every directory that holds or leads to a file; there are few, and small ones."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = P.relative_slash_path(F.regexp_extract("path", "^(?:[a-z]+:/*)?(/.*)$", 1), F.lit(root))
    dirs = raw.select(F.explode(P.ancestors(rel)).alias("dir")).distinct().collect()  # one row per directory
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(conf)
    found = []
    for d in sorted(r["dir"] for r in dirs if r["dir"] is not None):
        path = jvm.org.apache.hadoop.fs.Path("/".join(x for x in (root, d, ".gitignore") if x))
        if fs.exists(path):
            stream = fs.open(path)
            try:
                found.append((d, bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")))
            finally:
                stream.close()
    return P.ignore_rules(found)


def discover(spark: SparkSession, root: str, config: WorkspaceConfig | None = None) -> DataFrame:
    """``(path, size, mtime, ext, language)`` of the files of a tree in scope, paths relative to the root, without those that the tree's ignore files leave out; no other contents are read."""
    config = config or WorkspaceConfig()
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).select("path", "length", "modificationTime")
    rel = F.regexp_extract("path", "^(?:[a-z]+:/*)?(/.*)$", 1)
    found = raw.select(P.relative_slash_path(rel, F.lit(base)).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime")).where("path is not null")
    keep = P.in_scope(F.col("path"), config.include, config.exclude, config.extensions, config.excluded_dirs) & ~P.ignored(F.col("path"), tree_rules(spark, base))
    return found.where(keep).withColumn("ext", P.extension(F.col("path"))).withColumn("language", P.language_for(F.col("path"), config.language_overrides))


def read_texts(spark: SparkSession, root: str, config: WorkspaceConfig | None = None, most_proto_bytes: int = 16 * 2**20) -> DataFrame:
    """``(path, text)`` of the files of a tree in scope, whole; only larger protocol definitions than ``most_proto_bytes`` have a null text."""
    config = config or WorkspaceConfig()
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    rel = P.relative_slash_path(F.regexp_extract("path", "^(?:[a-z]+:/*)?(/.*)$", 1), F.lit(base))
    text = F.when((P.extension(F.col("path")) != "proto") | (F.col("length") <= most_proto_bytes), F.decode("content", "UTF-8"))
    keep = P.in_scope(F.col("rel"), config.include, config.exclude, config.extensions, config.excluded_dirs) & ~P.ignored(F.col("rel"), tree_rules(spark, base))
    return raw.withColumn("rel", rel).where(F.col("rel").isNotNull() & keep).select(F.col("rel").alias("path"), text.alias("text"))


def module_path(text: Column) -> Column:
    """Module path of a go.mod text."""
    return F.nullif(F.regexp_extract(text, r"(?m)^[ \t]*module[ \t]+\"?([^\s\"]+)", 1), F.lit(""))


def work_dirs(text: Column) -> Column:
    """Directories that a go.work text uses, in single lines and in blocks."""
    block = F.regexp_extract(text, r"(?ms)^[ \t]*use[ \t]*\(([^)]*)\)", 1)
    inner = F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]*(?:\./)?([^\s/][^\s]*|\.)"), F.lit(1))
    single = F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*use[ \t]+(?:\./)?([^\s(][^\s]*)"), F.lit(1))
    return F.array_distinct(F.concat(single, inner))


def history(spark: SparkSession, path: str, most: int = 4096) -> DataFrame:
    """The newest accept events of a JSON log."""
    schema = "candidate string, kind string, intent string, prefix_bucket string, accepted_at bigint"
    return spark.read.schema(schema).json(path).orderBy(F.desc("accepted_at"), "candidate").limit(most)


def as_lines(df: DataFrame) -> DataFrame:
    """Result rows as JSON lines."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("line"))
