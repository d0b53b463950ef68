"""Association of generated headers with the protocol definitions they come from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import paths as P
from cairn.functions.names import lower_ascii


def proto_sources(headers: DataFrame, protos: DataFrame) -> DataFrame:
    """``(header, proto, kind)``: the definition at the header's own path (relative_path), else, only for headers without one, those of the same base name. Letter case does not count; headers are ``*.pb-c.h``."""
    h = headers.select(F.col("path").alias("header")).where(lower_ascii(F.col("header")).rlike(r"\.pb-c\.h$")).distinct()
    want = F.regexp_replace(lower_ascii(F.col("header")), r"\.pb-c\.h$", ".proto")
    h = h.withColumn("want", want).withColumn("base", P.basename(want))
    p = protos.select(F.col("path").alias("proto"), lower_ascii(F.col("path")).alias("low")).distinct().withColumn("base", P.basename(F.col("low")))
    exact = h.join(p.drop("base"), F.col("want") == F.col("low")).select("header", "proto", F.lit("relative_path").alias("kind"))
    rest = h.join(exact.select("header").distinct(), "header", "left_anti")
    return exact.unionByName(rest.join(p, "base").select("header", "proto", F.lit("same_basename").alias("kind")))
