"""Local bindings that can be seen from a cursor: lexical nesting and declaration before use."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def visible_bindings(bindings: DataFrame, cursors: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, at, name, kind, decl_byte)``: the bindings that can be completed at each cursor.

    bindings: ``keys`` (the file and the function), ``name, kind, decl_byte, fn_start, fn_end, scope_start, scope_end``; cursors: ``keys, at``, byte
    offsets all. A binding is seen within its function and its scope, after its declaration; the end of both still counts. An equi-join on the
    function, whose bindings and cursors are few; the five inequalities follow. Null offsets and keys see nothing. Repeated rows count once.
    """
    b = bindings.select(*keys, "name", "kind", "decl_byte", "fn_start", "fn_end", "scope_start", "scope_end").distinct()
    c = cursors.select(*keys, "at").distinct()
    inside = (F.col("fn_start") < F.col("at")) & (F.col("at") <= F.col("fn_end")) & (F.col("scope_start") < F.col("at")) & (F.col("at") <= F.col("scope_end"))
    return c.join(b, keys).where(inside & (F.col("decl_byte") < F.col("at"))).select(*keys, "at", "name", "kind", "decl_byte")


def nearest_binding(bindings: DataFrame, cursors: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, at, name, decl_byte)``: the binding that the name at each cursor refers to, the one declared last of those in sight.

    cursors: ``keys, at, name``. A cursor on the declaration itself refers to it.
    """
    b = bindings.select(*keys, "name", "decl_byte", "fn_start", "fn_end", "scope_start", "scope_end").distinct()
    c = cursors.select(*keys, "at", "name").distinct()
    inside = (F.col("fn_start") < F.col("at")) & (F.col("at") <= F.col("fn_end")) & (F.col("scope_start") < F.col("at")) & (F.col("at") <= F.col("scope_end")) & (F.col("decl_byte") < F.col("at"))
    here = (F.col("decl_byte") <= F.col("at")) & (F.col("at") <= F.col("decl_byte") + F.octet_length("name"))
    return c.join(b, [*keys, "name"]).where(inside | here).groupBy(*keys, "at", "name").agg(F.max("decl_byte").alias("decl_byte"))


def local_completions(seen: DataFrame, keys: list[str], score, limit: int) -> DataFrame:
    """The bindings in sight at each cursor that match what is typed, best first, each name once: ``position`` by score, nearness of the declaration and name. score: a column over ``seen``, null for no match."""
    per = Window.partitionBy(*keys, "at", "name").orderBy(F.desc("score"), F.desc("decl_byte"))
    once = seen.withColumn("score", score).where("score is not null").withColumn("_r", F.row_number().over(per)).where("_r = 1").drop("_r")
    return once.withColumn("position", F.row_number().over(Window.partitionBy(*keys, "at").orderBy(F.desc("score"), F.desc("decl_byte"), "name"))).where(F.col("position") <= limit)
