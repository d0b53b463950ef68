"""Occurrences of names in texts, and tokens relative to each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.search import top_per_key

# Order of the roles in a list of references.
ROLE_RANK = {"definition": 0, "declaration": 1, "call": 2, "write": 3, "type_use": 4, "read": 5}


def _utf16(c: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def occurrences(texts: DataFrame, roles: DataFrame, names: Sequence[str], *, text: str, path: str, limit: int) -> DataFrame:
    """``(name, path, line, col, role, position)``: whole-word occurrences of the stated names, the first ``limit`` of each by role, path, line and column.

    The texts are split into lines once and each line is tested for each name; columns count UTF-16 units. roles: ``path, name, line, col, role``, the
    classified identifiers; an occurrence that is none (in a comment or a literal) is a read. The join neither adds nor moves hits. Null texts have none.
    """
    lines = texts.where(F.col(text).isNotNull() & F.col(path).isNotNull()).select(F.col(path).alias("path"), F.posexplode(F.split(text, "\n")).alias("line", "s"))
    some = lines.where(F.col("s").rlike(whole_word(names)))
    each = some.withColumn("name", F.explode(F.array(*[F.lit(n) for n in names])))
    parts = F.split(F.col("s"), F.concat(F.lit(r"\b"), F.col("name"), F.lit(r"\b")), -1)
    hits = each.withColumn("p", parts).where(F.size("p") > 1)
    hits = hits.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("p") - 1)))
    col = F.aggregate(F.expr("slice(p, 1, k)"), F.lit(0), lambda a, x: a + _utf16(x)) + (F.col("k") - 1) * F.length("name")
    hits = hits.select("name", "path", F.col("line").cast("long").alias("line"), col.cast("long").alias("col"))
    found = hits.join(roles.select("path", "name", F.col("line").cast("long").alias("line"), F.col("col").cast("long").alias("col"), "role").distinct(), ["path", "name", "line", "col"], "left").withColumn("role", F.coalesce("role", F.lit("read")))
    rank = F.coalesce(*[F.when(F.col("role") == r, i) for r, i in ROLE_RANK.items()])
    return top_per_key(found.select("name", "path", "line", "col", "role"), "name", [rank, F.col("path"), F.col("line"), F.col("col")], limit)


def whole_word(names: Sequence[str]) -> str:
    """Regular expression of the stated names as whole words."""
    return r"\b(" + "|".join(names) + r")\b"


def relative_tokens(tokens: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Tokens ``(line, start, ...)`` with their line and start relative to the token before in the group."""
    w = Window.partitionBy(group).orderBy(*order)
    line, start = F.coalesce(F.lag("line").over(w), F.lit(0)), F.coalesce(F.lag("start").over(w), F.lit(0))
    rows = tokens.withColumn("delta_line", F.col("line") - line).withColumn("previous", start)
    return rows.withColumn("delta_start", F.when(F.col("delta_line") == 0, F.col("start") - F.col("previous")).otherwise(F.col("start")))
