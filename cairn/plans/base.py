"""Role views over the index tables that the reference operators' queries share, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.common import table
from cairn.functions import paths

#: The stated needles of the name searches.
NEEDLES = ("reset", "scan_re", "psb", "ru", "xq", "index", "PackEn", "e", "rwl", "slot1")


def needles(spark: SparkSession) -> DataFrame:
    """The stated needles."""
    return spark.createDataFrame([(n,) for n in NEEDLES], "needle string")


NEEDLES_SQL = "(values " + ", ".join(f"('{n}')" for n in NEEDLES) + ") as q(needle)"


def anchors(spark: SparkSession, folder: str) -> DataFrame:
    """Callable anchors, delivered duplicates removed."""
    a = table(spark, folder, "callable_anchors").withColumn("start_byte", F.col("name_range.start_byte")).withColumn("start_line", F.col("name_range.start_line")).withColumn("has_body", F.col("body_range").isNotNull())
    return a.dropDuplicates(["id"]).withColumn("external", F.col("source") == "external")


ANCHORS_SQL = """(select * from (select *, name_range.start_byte as start_byte, name_range.start_line as start_line, body_range is not null as has_body, source = 'external' as external,
 row_number() over (partition by id) rn_ from callable_anchors) where rn_ = 1)"""


def live_anchors(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors of the newest generation."""
    return anchors(spark, folder).where(F.col("retired_generation").isNull())


LIVE_SQL = f"(select * from {ANCHORS_SQL} where retired_generation is null)"


def sites(spark: SparkSession, folder: str) -> DataFrame:
    """Call sites, delivered duplicates removed."""
    return table(spark, folder, "call_sites").dropDuplicates(["id"])


SITES_SQL = "(select * from (select *, row_number() over (partition by id) rn_ from call_sites) where rn_ = 1)"


def files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, source)`` of the files that have a text."""
    return table(spark, folder, "source_texts").select("path").where(F.col("path").isNotNull()).distinct().withColumn("source", F.when(F.startswith("path", F.lit("/")), "external").otherwise("workspace"))


FILES_SQL = "(select distinct path, case when starts_with(path, '/') then 'external' else 'workspace' end as source from source_texts where path is not null)"


def raw_includes(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct rows of :func:`include_lines`."""
    return include_lines(spark, folder).distinct()


def include_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``(src, target_text)``, some of them several times: the include lines of the source texts, and for each file the files that define what it calls, written as includes in turn by base name, by path and by directory."""
    lines = table(spark, folder, "source_texts").where(F.col("text").isNotNull())
    lines = lines.select(F.col("path").alias("src"), F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^[ \t]*#[ \t]*include[ \t]*([^\r\n]*)"), F.lit(1))).alias("target_text"))
    known = files(spark, folder)
    a = live_anchors(spark, folder).where(F.col("name").isNotNull()).join(known.select("path"), "path", "left_semi")
    unique = a.groupBy("name").agg(F.count("*").alias("n"), F.max("path").alias("dst")).where("n = 1")
    # Delivered duplicates are removed after the first join, which leaves about a quarter of the sites.
    called = table(spark, folder, "call_sites").select("id", F.col("path").alias("src"), F.col("callee_name").alias("name")).join(unique.hint("shuffle_hash"), "name").where(F.col("src") != F.col("dst"))
    called = called.select("id", "src", "dst").dropDuplicates(["id"]).join(known.select(F.col("path").alias("src")).hint("shuffle_hash"), "src", "left_semi")
    way = F.when(F.startswith("dst", F.lit("/")), 1).otherwise(F.length("dst") % 3)
    text = F.when(way == 0, F.concat(F.lit('"'), paths.basename(F.col("dst")), F.lit('"'))).when(way == 1, F.concat(F.lit("<"), F.regexp_replace("dst", "^/opt/sdk/", ""), F.lit(">"))).otherwise(F.concat(F.lit('"'), F.col("dst"), F.lit('"')))
    outside = known.where("source = 'external'").select("path", F.split("path", "/")[3].alias("repo"))
    first = known.where("source = 'workspace'").groupBy(F.split("path", "/")[0].alias("repo")).agg(F.min("path").alias("src"))
    headers = outside.join(first, "repo").select("src", F.concat(F.lit("<"), F.regexp_replace("path", "^/opt/sdk/", ""), F.lit(">")).alias("target_text"))
    return lines.unionByName(called.select("src", text.alias("target_text"))).unionByName(headers)


INCLUDES_SQL = f"""(select distinct src, target_text from (
 select path as src, unnest(regexp_extract_all(text, '(?m)^[ \\t]*#[ \\t]*include[ \\t]*([^\\r\\n]*)', 1)) as target_text from source_texts where text is not null
 union all
 select src, case (case when starts_with(dst, '/') then 1 else length(dst) % 3 end) when 0 then '"' || regexp_extract(dst, '([^/]*)$', 1) || '"' when 1 then '<' || regexp_replace(dst, '^/opt/sdk/', '') || '>' else '"' || dst || '"' end
 from (select distinct s.path as src, u.dst from {SITES_SQL} s join (select name, max(path) dst from {LIVE_SQL} where name is not null and path in (select path from source_texts) group by name having count(*) = 1) u on u.name = s.callee_name
  where s.path <> u.dst and s.path in (select path from source_texts))
 union all
 select w.src, '<' || regexp_replace(e.path, '^/opt/sdk/', '') || '>' from {FILES_SQL} e join (select split_part(path, '/', 1) repo, min(path) src from {FILES_SQL} where source = 'workspace' group by 1) w on w.repo = split_part(e.path, '/', 4) where e.source = 'external'))"""
