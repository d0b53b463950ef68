"""Callables: counterpart pairing, arity policy, call resolution, relations and their pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import ranking as R

# Kinds of evidence, by bit.
EVIDENCE = ("explicit_qualifier", "same_file", "internal_linkage", "compatible_arity", "name_only")
RESOLVED_FORMS = ("direct_name", "qualified_name", "parenthesized_name")


def _links(anchors: DataFrame) -> DataFrame:
    """``(source_id, source_path, header_id, header_path)``: definitions in sources and declarations in headers of the same free function of exact fidelity and external linkage."""
    free = F.col("owner_kind").isNull() | (F.col("owner_kind") == "namespace")
    fit = anchors.where((F.col("kind") == "function") & free & (F.col("linkage_kind") == "external") & (F.col("signature_fidelity") == "ast_exact") & (F.coalesce("canonical_signature", F.lit("")) != ""))
    key = ["name", "qualified_name", "canonical_signature"]
    src = fit.where((F.col("role") == "definition") & R.is_source_path(F.col("path"))).select(*key, F.col("id").alias("source_id"), F.col("path").alias("source_path"))
    hdr = fit.where((F.col("role") == "declaration") & R.is_header_path(F.col("path"))).select(*key, F.col("id").alias("header_id"), F.col("path").alias("header_path"))
    return src.join(hdr, key).drop(*key)


def counterpart_paths(anchors: DataFrame) -> DataFrame:
    """``(source_path, header_path)``: the sources whose reach decides about a pairing, with the headers asked for."""
    return _links(anchors).select("source_path", "header_path").distinct()


def counterparts(anchors: DataFrame, reach: DataFrame) -> DataFrame:
    """``(id, evidence, degree, counterpart_id)`` of every anchor.

    A source definition and a header declaration are linked if name, qualified name and canonical signature are equal, both are free functions
    of exact fidelity and external linkage, and the header is in the proven reach of the source (``source_path, header_path``). A pair stands if neither has another
    link: strict_one_to_one; otherwise ambiguous with its number of links, or unpaired.
    """
    links = _links(anchors).join(reach.select("source_path", "header_path").distinct(), ["source_path", "header_path"], "left_semi").select("source_id", "header_id")
    links = links.withColumn("ds", F.count("*").over(Window.partitionBy("source_id"))).withColumn("dh", F.count("*").over(Window.partitionBy("header_id")))
    ends = F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.col("ds").alias("degree"), F.col("header_id").alias("other")), F.struct(F.col("header_id").alias("id"), F.col("dh").alias("degree"), F.col("source_id").alias("other"))))
    per = links.select(ends.alias("x"), ((F.col("ds") == 1) & (F.col("dh") == 1)).alias("pair")).groupBy("x.id").agg(F.max("x.degree").alias("degree"), F.max("pair").alias("pair"), F.max(F.when(F.col("pair"), F.col("x.other"))).alias("counterpart_id"))
    out = anchors.select("id").join(per, "id", "left")
    evidence = F.when(F.coalesce("pair", F.lit(False)), "strict_one_to_one").when(F.col("degree").isNull(), "unpaired").otherwise("ambiguous")
    return out.select("id", evidence.alias("evidence"), F.coalesce("degree", F.lit(0)).alias("degree"), "counterpart_id")


def ranges_at(points: DataFrame, ranges: DataFrame, keys: list[str], lines: int = 32) -> DataFrame:
    """Points with every range that holds them, both ends included.

    points: ``keys, line, character, ...``; ranges: ``keys, first, last`` (structs of line and character), ``...``. A join on the keys and on blocks of
    ``lines`` lines, so that a long file's points meet only the ranges near them. Null ends and places hold nothing.
    """
    p = points.withColumn("_block", F.floor(F.col("line") / lines))
    r = ranges.withColumn("_block", F.explode(F.sequence(F.floor(F.col("first.line") / lines), F.greatest(F.floor(F.col("last.line") / lines), F.floor(F.col("first.line") / lines)))))
    at = F.struct("line", "character")
    return p.join(r, [*keys, "_block"]).where((at >= F.col("first")) & (at <= F.col("last"))).drop("_block")


def arity_policy(candidates: DataFrame, group: str, n: Column) -> DataFrame:
    """Candidates of each group after the arity policy, with ``compatibility`` and ``outcome``.

    Compatible candidates drive out incompatible ones (filtered); without them only unknown ones stay (unknown_only); if all are
    incompatible all stay as a fallback (mismatch_fallback). An unknown number of arguments filters nothing (not_applied).
    """
    ok = R.accepts_arity(n, F.col("min_arity"), F.col("max_arity"), F.coalesce("variadic", F.lit(False)))
    level = F.when(n.isNull() | ok.isNull(), 1).when(ok, 2).otherwise(0)
    w = Window.partitionBy(group)
    rows = candidates.withColumn("level", level).withColumn("best", F.max("level").over(w)).withColumn("applied", n.isNotNull())
    keep = ~F.col("applied") | (F.col("best") == 0) | F.when(F.col("best") == 2, F.col("level") > 0).otherwise(F.col("level") == 1)
    outcome = F.when(~F.col("applied"), "not_applied").when(F.col("best") == 2, "filtered").when(F.col("best") == 1, "unknown_only").otherwise("mismatch_fallback")
    name = F.when(F.col("level") == 2, "compatible").when(F.col("level") == 1, "unknown").otherwise("incompatible")
    return rows.where(keep).withColumn("compatibility", name).withColumn("outcome", outcome).drop("level", "best", "applied")


def primary_anchors(anchors: DataFrame) -> DataFrame:
    """One anchor per ``entity``: definitions first, then parsed ones, then by path and place; with ``has_body`` of any of them."""
    w = Window.partitionBy("entity").orderBy((F.col("role") != "definition").cast("int"), (F.col("provenance") != "ast").cast("int"), "path", "start_byte", "id")
    first = anchors.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return first.join(anchors.groupBy("entity").agg((F.max(F.col("has_body").cast("int")) == 1).alias("any_body")), "entity")


def resolve_calls(calls: DataFrame, entities: DataFrame) -> DataFrame:
    """``(site_id, callee, supports, n_candidates)``: all callables that a call can mean.

    calls: ``site_id, family, path, name, form, qualified_name, n_args``; entities: ``entity, family, name, qualified_name, path, kind, owner, owner_kind, linkage_kind, linkage_file, min_arity,
    max_arity, variadic``, one row each. Candidates share name and family; methods need a qualified call, a qualifier has to agree, callables with internal linkage have to
    stand in the caller's file, and an arity that excludes the call excludes the candidate. Internal callables are joined by name and file, so the many
    file-local functions of a frequent name never meet all its calls. supports: bits of :data:`EVIDENCE`.
    """
    c = calls.where(F.col("form").isin(*RESOLVED_FORMS) & F.col("name").isNotNull())
    e = entities.where((F.col("kind") == "function") & ~(F.col("owner").isNotNull() & F.coalesce(F.col("owner_kind") == "unknown", F.lit(False))))
    e = e.select("entity", "family", "name", F.col("qualified_name").alias("e_qualified"), F.col("path").alias("e_path"), "owner_kind", "linkage_kind", "linkage_file", "min_arity", "max_arity", "variadic")
    internal = F.coalesce(F.col("linkage_kind") == "internal", F.lit(False))
    home = F.coalesce("linkage_file", "e_path")
    near = c.join(e.where(internal).withColumn("path", home), ["family", "name", "path"])
    far = c.join(e.where(~internal), ["family", "name"])
    pairs = near.unionByName(far.select(*near.columns))
    qualified = F.col("qualified_name").isNotNull()
    arity = R.accepts_arity(F.col("n_args"), F.col("min_arity"), F.col("max_arity"), F.coalesce("variadic", F.lit(False)))
    pairs = pairs.where((F.col("form") == "qualified_name") | F.coalesce(F.col("owner_kind") != "record", F.lit(True)))
    pairs = pairs.where(~qualified | F.coalesce(F.col("qualified_name") == F.col("e_qualified"), F.lit(False))).where(F.col("n_args").isNull() | F.coalesce(arity, F.lit(True)))
    bit = lambda cond, i: F.when(F.coalesce(cond, F.lit(False)), 1 << i).otherwise(0)
    bits = bit(qualified, 0) + bit(F.col("e_path") == F.col("path"), 1) + bit(F.coalesce(F.col("linkage_kind") == "internal", F.lit(False)), 2) + bit(F.col("n_args").isNotNull() & arity, 3)
    pairs = pairs.withColumn("supports", F.when(bits == 0, 1 << 4).otherwise(bits))
    return pairs.select("site_id", F.col("entity").alias("callee"), "supports", F.count("*").over(Window.partitionBy("site_id")).alias("n_candidates"))


def confidence(supports: Column) -> Column:
    """Confidence of an unambiguous relation."""
    return F.when(supports.bitwiseAND(0b101) != 0, "high").when(supports.bitwiseAND(0b1010) != 0, "medium").otherwise("low")


def resolve_callers(calls: DataFrame, anchors: DataFrame) -> DataFrame:
    """``(site_id, caller)``: the one entity of the caller's key, else the one whose definition stands in the call's file; null otherwise.

    calls: ``site_id, path, caller_key``; anchors: ``key, entity, role, path``.
    """
    keyed = calls.where("caller_key is not null")
    own = anchors.where("key is not null").select("key", "entity", F.when(F.col("role") == "definition", F.col("path")).alias("home")).distinct()
    per = own.groupBy("key").agg(F.countDistinct("entity").alias("n"), F.min("entity").alias("only"))
    homes = own.where("home is not null").groupBy("key", "home").agg(F.countDistinct("entity").alias("m"), F.min("entity").alias("local"))
    joined = keyed.join(per, keyed["caller_key"] == per["key"], "left").drop("key").join(homes, (keyed["caller_key"] == homes["key"]) & (keyed["path"] == homes["home"]), "left")
    found = joined.select("site_id", F.when(F.col("n") == 1, F.col("only")).when(F.col("m") == 1, F.col("local")).alias("caller"))
    return calls.select("site_id").join(found, "site_id", "left")


def relations(resolved: DataFrame, callers: DataFrame) -> DataFrame:
    """``(caller, callee, confidence, ambiguity_site, n_sites, supports, first_site)``: calls gathered by caller and callee; an ambiguous call is a relation of its own."""
    rows = resolved.join(callers.where("caller is not null"), "site_id")
    many = F.col("n_candidates") > 1
    rows = rows.withColumn("confidence", F.when(many, "ambiguous").otherwise(confidence(F.col("supports")))).withColumn("ambiguity_site", F.when(many, F.col("site_id")))
    return rows.groupBy("caller", "callee", "confidence", "ambiguity_site").agg(F.count("*").alias("n_sites"), F.bit_or("supports").alias("supports"), F.min("site_id").alias("first_site"))


def relation_page(relations: DataFrame, by: str, order: list[str], skip: int, take: int) -> DataFrame:
    """Rows ``skip`` to ``skip + take`` of each value of ``by`` in order, with ``position`` and the ``total``."""
    top = relations.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("position") <= skip + take)
    return top.where(F.col("position") > skip).join(relations.groupBy(by).agg(F.count("*").alias("total")), by)


def expansion_budget(calls: DataFrame, costs: DataFrame, group: str, order: list[str], limit: int) -> DataFrame:
    """The leading calls of each group whose summed costs stay within ``limit``. costs: ``name, cost``; a call without candidates costs one."""
    joined = calls.join(costs, "name", "left").withColumn("cost", F.greatest(F.coalesce("cost", F.lit(1)), F.lit(1)))
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.withColumn("spent", F.sum("cost").over(w)).where(F.col("spent") <= limit)


def group_caps(rows: DataFrame, group: str, size: str, most_rows: int, most_size: int) -> DataFrame:
    """All rows of the groups within both caps; a group over a cap is left out whole."""
    fit = rows.groupBy(group).agg(F.count("*").alias("n"), F.sum(size).alias("s")).where((F.col("n") <= most_rows) & (F.coalesce("s", F.lit(0)) <= most_size))
    return rows.join(fit.select(group), group, "left_semi")


def encode_cursor(generation: Column, epoch: Column, resolver: Column, direction: Column, offset: Column) -> Column:
    """Cursor of a page: hexadecimal numbers and the direction's first letter between full stops."""
    h = lambda c: F.lower(F.hex(c))
    return F.concat_ws(".", h(generation), h(epoch), h(resolver), F.when(direction == "incoming", "i").otherwise("o"), h(offset))


def decode_cursor(cursor: Column, generation: Column, epoch: Column, resolver: Column, direction: Column) -> Column:
    """Offset of a cursor; null if anything in it differs from the present revision or is malformed."""
    p = F.split(cursor, r"\.")
    number = lambda i: F.when(p[i].rlike("^[0-9a-fA-F]{1,15}$"), F.conv(p[i], 16, 10).cast("bigint"))
    same = (F.size(p) == 5) & (number(0) == generation) & (number(1) == epoch) & (number(2) == resolver) & (p[3] == F.when(direction == "incoming", "i").otherwise("o"))
    return F.when(same, number(4))
