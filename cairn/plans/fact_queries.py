"""Queries over parsed sources: S9 to S11, E1 to E14, X17 to X21, X23 to X30, F14, W7, J5, J20 to J22, A11, T11, T12, and the product queries P2, P5, P6, P9 to P13, P17, P19."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.common import materialize, table
from cairn.functions import cursor as U
from cairn.functions import names as N
from cairn.functions import paths as P
from cairn.functions import ranking as R
from cairn.operators import bindings as B
from cairn.operators import candidates as K
from cairn.operators import members as M
from cairn.operators import proto, references
from cairn.plans import callable_queries as CQ
from cairn.plans import name_queries as NQ
from cairn.plans.base import ANCHORS_SQL, LIVE_SQL, SITES_SQL, anchors, live_anchors, sites
from cairn.sources import extract as X


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "source_texts").where("text is not null and path is not null").dropDuplicates(["revision_id"])


_TEXTS = "(select revision_id, file_id, path, text from (select *, row_number() over (partition by revision_id) r_ from source_texts where text is not null and path is not null) where r_ = 1)"


def _facts(spark: SparkSession, folder: str, *kinds: str) -> DataFrame:
    return X.parse_files(_texts(spark, folder), file_id="revision_id", path="path", text="text", wanted=frozenset(kinds) if kinds else None)


def s9_parsed_files(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of all files by kind."""
    return _facts(spark, folder).groupBy("fact", "kind").agg(F.count("*").alias("n"))


def e1_includes(spark: SparkSession, folder: str) -> DataFrame:
    """Include lines of C and C++ files."""
    return _facts(spark, folder, "include").where("not endswith(path, '.go')").select("file_id", "name")


def e3_declarations(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical declarations, one per place, name and kind."""
    return _facts(spark, folder, "declaration").select("file_id", "name", "kind", "role", "start_byte", "qualified_name").dropDuplicates(["file_id", "start_byte", "name", "kind"])


def e4_macros(spark: SparkSession, folder: str) -> DataFrame:
    """Object-like and function-like macros with a value."""
    return _facts(spark, folder, "declaration").where("kind = 'macro' and detail is not null").select("file_id", "name")


def e4_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Objects at file scope."""
    return _facts(spark, folder, "declaration").where("kind = 'object'").select("file_id", "name", "role", "linkage_kind", "detail")


def e5_members(spark: SparkSession, folder: str) -> DataFrame:
    """Members of records, methods defined outside of them included."""
    return _facts(spark, folder, "member").select("file_id", "owner", "name", "kind", "detail")


def e6_type_aliases(spark: SparkSession, folder: str) -> DataFrame:
    """Typedefs, using aliases and defined types."""
    return _facts(spark, folder, "type_alias").select("file_id", "name", "kind", "detail")


def indexed_callables(spark: SparkSession, folder: str) -> DataFrame:
    """All functions and methods found in the texts of which the index has any, as long as the text neither breaks off nor holds remains of a merge."""
    indexed = anchors(spark, folder).where("kind = 'function' and revision_id is not null").select("revision_id").distinct()
    t = _texts(spark, folder).where(~F.col("text").rlike(r"(?m)^(<{7}|={7}|>{7})") & F.col("text").rlike(r"(\}|;|#endif[^\n]*)\s*\z")).join(indexed, "revision_id", "left_semi")
    return X.parse_files(t, file_id="revision_id", path="path", text="text", wanted=frozenset(["callable"]))


_INDEXED = f"(select distinct revision_id as file_id, name, start_byte, owner, owner_kind, qualified_name, signature, canonical_signature, linkage_kind, min_arity, max_arity, \"variadic\", role from {ANCHORS_SQL} where kind = 'function' and revision_id in (select revision_id from {_TEXTS} where not regexp_matches(text, '(?m)^(<{{7}}|={{7}}|>{{7}})') and regexp_matches(text, '(\\}}|;|#endif[^\\n]*)\\s*\\z')))"


def e7_callables(spark: SparkSession, folder: str) -> DataFrame:
    """Functions and methods of the indexed texts."""
    return indexed_callables(spark, folder).select("file_id", "name", "start_byte", F.when(F.col("owner_kind") == "record", F.col("owner")).alias("owner"), "qualified_name", "canonical_signature", "linkage_kind", "min_arity")


def e7_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Calls of the texts by form."""
    return _facts(spark, folder, "call").groupBy("name", "form").agg(F.count("*").alias("n"), F.countDistinct("caller").alias("callers"))


def e8_occurrences(spark: SparkSession, folder: str) -> DataFrame:
    """Identifiers by syntactic role."""
    return _facts(spark, folder, "occurrence").groupBy("name", "role").agg(F.count("*").alias("n"))


def e9_locals(spark: SparkSession, folder: str) -> DataFrame:
    """Parameters and local variables of each function."""
    return _facts(spark, folder, "local").select("file_id", "caller", "name", "kind", "start_line", "body_start_line", "body_end_line")


_FUNCTION = ["file_id", "caller"]


def _bindings(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Bindings of all functions, and the calls in them as cursors."""
    f = materialize(_facts(spark, folder, "local", "call").where("caller is not null").select("fact", *_FUNCTION, "name", "kind", "start_byte", "fn_start", "fn_end", "scope_start", "scope_end"), "bindings")
    return f.where("fact = 'local'").withColumnRenamed("start_byte", "decl_byte"), f.where("fact = 'call'").select(*_FUNCTION, "name", F.col("start_byte").alias("at"))


def f14_visible_locals(spark: SparkSession, folder: str) -> DataFrame:
    """Bindings that can be seen from the place of each call."""
    return B.visible_bindings(*_bindings(spark, folder), _FUNCTION).select(*_FUNCTION, "at", "name", "decl_byte")


def w7_nearest_binding(spark: SparkSession, folder: str) -> DataFrame:
    """For each call and each name in sight there, the binding that the name means."""
    local, calls = _bindings(spark, folder)
    seen = B.visible_bindings(local, calls, _FUNCTION)
    return B.nearest_binding(local, seen.select(*_FUNCTION, "at", "name"), _FUNCTION)


def e10_packages(spark: SparkSession, folder: str) -> DataFrame:
    """Package of each Go file."""
    return _facts(spark, folder, "package").where("endswith(path, '.go')").select("file_id", "name")


def e10_imports(spark: SparkSession, folder: str) -> DataFrame:
    """Imports of each Go file."""
    return _facts(spark, folder, "import").where("endswith(path, '.go')").select("file_id", "name")


def e11_fallback_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names of low trust from the files that yield no declaration."""
    return _facts(spark, folder, "fallback").groupBy("file_id").agg(F.count("*").alias("n_names"))


def e12_recovered(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with attributes and export macros blanked: length and how many characters."""
    def blanked(text: str) -> list[tuple]:
        r = X.recovery_source(text)
        return [(len(r), sum(a != b for a, b in zip(text, r, strict=True)))]

    return U.apply(_texts(spark, folder), ["text"], blanked, "n_chars int, n_blanked int", pa.schema([("n_chars", pa.int32()), ("n_blanked", pa.int32())]), ["revision_id"])


def _proto_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Protocol definitions made from the records of the texts: one message per record, its fields numbered."""
    m = _facts(spark, folder, "member").where("kind = 'field' and owner is not null").select("file_id", "path", "owner", "name").distinct()
    fields = m.groupBy("file_id", "path", "owner").agg(F.array_join(F.transform(F.sort_array(F.collect_set("name")), lambda n: F.concat(F.lit("  int32 "), n, F.lit(" = 1;\n"))), "").alias("f"))
    msg = F.concat(F.lit("message "), F.col("owner"), F.lit(" {\n"), F.col("f"), F.lit("}\n"))
    return fields.groupBy("file_id", "path").agg(F.concat(F.lit('syntax = "proto3";\npackage p;\n'), F.array_join(F.sort_array(F.collect_list(msg)), "")).alias("text")).withColumn("path", F.concat(F.regexp_replace("path", r"\.\w+$", ""), F.lit(".proto")))


_PROTO = pa.schema([("kind", pa.string()), ("name", pa.string()), ("full_name", pa.string()), ("line", pa.int32())])


def e13_proto_declarations(spark: SparkSession, folder: str) -> DataFrame:
    """Declarations of protocol definitions."""
    return U.apply(_proto_texts(spark, folder), ["text"], X.proto_declarations, "kind string, name string, full_name string, line int", _PROTO, ["file_id", "path"])


def j22_proto_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Generated headers and the protocol definitions that they come from."""
    p = _proto_texts(spark, folder).select("path")
    heads = p.withColumn("n", F.length("path") % 3).select(F.when(F.col("n") == 0, F.regexp_replace("path", r"\.proto$", ".pb-c.h")).when(F.col("n") == 1, F.concat(F.lit("gen/"), P.basename(F.regexp_replace("path", r"\.proto$", ".PB-C.h")))).otherwise("none/x.pb-c.h").alias("path")).distinct()
    return proto.proto_sources(heads, p)


def e14_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels within functions of C and C++ texts."""
    t = _texts(spark, folder).where("not endswith(path, '.go')")
    return U.apply(t, ["text"], X.labels, "label string, line int, function string", pa.schema([("label", pa.string()), ("line", pa.int32()), ("function", pa.string())]), ["revision_id"])


# --- cursor positions -------------------------------------------------------------------------------------------
def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line and column of each call's place in the text of its file."""
    s = sites(spark, folder).select("id", "path", F.col("callee_range.start_line").alias("line"), F.col("callee_range.start_character").alias("col"))
    t = _texts(spark, folder).select("path", F.split("text", "\r?\n").alias("lines"))
    return s.join(t, "path").where("line < size(lines)").select("id", "line", "col", F.expr("lines[line]").alias("text"))


def x17_intents(spark: SparkSession, folder: str) -> DataFrame:
    """Intents of a completion at the call places."""
    return U.apply(_lines(spark, folder), ["text", "col"], lambda t, c: [U.completion_intent(t, c)], "intent string, confidence string", pa.schema([("intent", pa.string()), ("confidence", pa.string())]), ["id"])


def x18_words(spark: SparkSession, folder: str) -> DataFrame:
    """Word at and prefix before the call places."""
    return U.apply(_lines(spark, folder), ["text", "col"], lambda t, c: [(U.word_at(t, c), U.prefix_at(t, c))], "word string, prefix string", pa.schema([("word", pa.string()), ("prefix", pa.string())]), ["id"])


def x19_member_chains(spark: SparkSession, folder: str) -> DataFrame:
    """Member chains that end at a member access of any line."""
    def chains(text: str) -> list[tuple]:
        out = []
        for k, line in enumerate(text.split("\n")):
            at = 0
            while (at := min((x for x in (line.find(".", at), line.find("->", at)) if x >= 0), default=-1)) >= 0:
                at += 2 if line.startswith("->", at) else 1
                got = U.member_chain_at(line, len(line[:at].encode("utf-16-le")) // 2)
                if got and not got[0].isdigit():
                    out.append((k, got[0], got[1]))
        return out

    return U.apply(_texts(spark, folder), ["text"], chains, "line int, receiver string, members array<string>", pa.schema([("line", pa.int32()), ("receiver", pa.string()), ("members", pa.list_(pa.string()))]), ["revision_id"])


def x20_byte_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """Byte offset of the calls' lines and columns in their texts."""
    s = sites(spark, folder).select("id", "path", F.col("callee_range.start_line").alias("line"), F.col("callee_range.start_character").alias("col"))
    return U.apply(s.join(_texts(spark, folder).select("path", "text"), "path"), ["text", "line", "col"], lambda t, a, c: [(U.byte_offset_at(t, a, c),)], "offset bigint", pa.schema([("offset", pa.int64())]), ["id"])


def x21_words(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct identifiers of each text."""
    t = _texts(spark, folder)
    return U.apply(t, ["path", "text"], lambda p, x: [(w,) for w in X.extract_words(x, p.lower().endswith(".go"))], "word string", pa.schema([("word", pa.string())]), ["revision_id"])


def x23_call_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """Open call and argument index five characters after the call places."""
    schema = pa.schema([("name", pa.string()), ("argument", pa.int32())])
    return U.apply(_lines(spark, folder), ["text", "col"], lambda t, c: [x] if (x := U.call_at(t, c + 5)) else [], "name string, argument int", schema, ["id"])


def x24_parameters(spark: SparkSession, folder: str) -> DataFrame:
    """Parameters in each anchor's signature."""
    a = live_anchors(spark, folder).where("canonical_signature is not null").select("id", "canonical_signature")
    return U.apply(a, ["canonical_signature"], lambda s: [(i, s[x:y]) for i, (x, y) in enumerate(U.parameter_spans(s))], "n int, parameter string", pa.schema([("n", pa.int32()), ("parameter", pa.string())]), ["id"])


def x27_comments(spark: SparkSession, folder: str) -> DataFrame:
    """Documentation of the live definitions as Markdown."""
    a = live_anchors(spark, folder).where("role = 'definition'").select("id", "revision_id", F.col("declaration_range.start_line").alias("line"))
    rows = a.join(_texts(spark, folder).select("revision_id", "text"), "revision_id")
    return U.apply(rows, ["text", "line"], lambda t, k: [(m,)] if (m := U.comment_markdown(U.comment_lines(t, k))) else [], "markdown string", pa.schema([("markdown", pa.string())]), ["id"])


def x28_excerpts(spark: SparkSession, folder: str) -> DataFrame:
    """Bodies of the live anchors with ids divisible by 100."""
    a = live_anchors(spark, folder).where("has_body and id % 100 = 0").select("id", "revision_id", F.col("body_range.start_line").alias("a"), F.col("body_range.end_line").alias("b"))
    rows = a.join(_texts(spark, folder).select("revision_id", "text"), "revision_id")
    return U.apply(rows, ["text", "a", "b"], lambda t, a, b: [(U.source_excerpt(t, a, b),)], "excerpt string", pa.schema([("excerpt", pa.string())]), ["id"])


def x29_build_guards(spark: SparkSession, folder: str) -> DataFrame:
    """Build constraint of each Go text."""
    t = _texts(spark, folder).where("endswith(path, '.go')")
    return U.apply(t, ["path", "text"], lambda p, x: [(U.build_guard(p, x),)], "build_guard string", pa.schema([("build_guard", pa.string())]), ["revision_id"])


def x30_guards(spark: SparkSession, folder: str) -> DataFrame:
    """Preprocessor guards of the declarations."""
    return _facts(spark, folder, "declaration").where("guard is not null").select("file_id", "name", "guard")


# --- records, aliases, members ----------------------------------------------------------------------------------
def _member_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Members of the parsed files with the key of their record; those of every second file have the record's id as well."""
    f = _facts(spark, folder, "member", "record")
    rec = f.where("fact = 'record'").select("file_id", F.col("name").alias("owner"), F.concat_ws("@", "name", F.col("file_id").cast("string")).alias("rid")).distinct()
    m = f.where("fact = 'member'").select("file_id", "path", "owner", "name", "kind", "signature", F.col("detail").alias("type_name"), "start_byte")
    return m.join(rec, ["file_id", "owner"], "left").select(F.when(F.col("file_id") % 2 == 0, F.col("rid")).alias("record_id"), "file_id", F.col("owner").alias("record_key"), "path", "name", "kind", "signature", "type_name", "start_byte")


def j5_members(spark: SparkSession, folder: str) -> DataFrame:
    """Members of the records named slot or Slot, by id or by key."""
    r = _facts(spark, folder, "record").where("lower(name) = 'slot'").select(F.concat_ws("@", "name", F.col("file_id").cast("string")).alias("record_id"), "file_id", F.col("name").alias("record_key"))
    return M.members_of(_member_rows(spark, folder), r).select("file_id", "name", "kind")


def t11_member_order(spark: SparkSession, folder: str) -> DataFrame:
    """The first fifty members in the order of path, place, name and kind, and whether there are more."""
    order = ["path", "start_byte", "name", "kind", F.coalesce("signature", F.lit(""))]
    top = _member_rows(spark, folder).orderBy(*order).limit(51)
    w = Window.orderBy(*order)
    return top.withColumn("position", F.row_number().over(w)).withColumn("truncated", F.count("*").over(Window.partitionBy()) > 50).where("position <= 50").select("position", "path", "name", "truncated")


def _aliases(spark: SparkSession, folder: str) -> DataFrame:
    """Alias chains made of the names: each third live name stands for the one that follows it, some for two."""
    n = live_anchors(spark, folder).where("name is not null").select("name").distinct().withColumn("h", F.length("name") % 4)
    nxt = n.select("name", "h", F.lead("name").over(Window.partitionBy(F.substring("name", 1, 1)).orderBy("name")).alias("target"))
    return nxt.where("h in (0, 1) and target is not null").select("name", "target").unionByName(nxt.where("h = 0 and length(name) % 5 = 0").select("name", F.lit("reset").alias("target"))).unionByName(nxt.where("h = 3 and length(name) % 7 = 0").select("name", F.col("name").alias("target")))


_ALIASES = f"(with n as (select name, length(name) % 4 h, lead(name) over (partition by substr(name, 1, 1) order by name) target from (select distinct name from {LIVE_SQL} where name is not null)) select name, target from n where h in (0, 1) and target is not null union select name, 'reset' from n where h = 0 and length(name) % 5 = 0 union select name, name from n where h = 3 and length(name) % 7 = 0)"


def j20_alias_chains(spark: SparkSession, folder: str) -> DataFrame:
    """Where the chains of aliases end; names of a length that leaves 2 by 4 are records."""
    n = live_anchors(spark, folder).where("name is not null").select("name").distinct()
    return M.resolve_aliases(n.select(F.col("name").alias("query")), _aliases(spark, folder), n.where("length(name) % 4 = 2"))


def j21_member_chains(spark: SparkSession, folder: str) -> DataFrame:
    """Records at the end of member chains: names as records, their aliases as members called next."""
    a = _aliases(spark, folder).select(F.col("name").alias("owner"), F.lit("next").alias("name"), F.col("target").alias("type_name"))
    chains = a.select(F.col("owner").alias("chain_id"), F.col("owner").alias("record"), F.array_repeat(F.lit("next"), 2).alias("names")).distinct()
    return M.walk_chains(chains, a)


def a11_fallback_members(spark: SparkSession, folder: str) -> DataFrame:
    """Members by name and kind over all records, the forty most frequent of the best tier."""
    m = _member_rows(spark, folder).withColumn("tier", F.when(F.startswith("path", F.lit("/")), "external").otherwise("global"))
    return M.fallback_members(m, 40).select("lower_name", "kind", "freq", "position", "truncated")


# --- product queries --------------------------------------------------------------------------------------------
def p2_definitions(spark: SparkSession, folder: str) -> DataFrame:
    """Definitions that a jump from each stated name presents, best first."""
    nav = CQ._packed(K.navigation(K.focus(K.grouped(CQ._candidates(spark, folder)), F.lit("call")), declaration=False))
    w = Window.partitionBy("query").orderBy(F.desc("packed"), "path", "start_line", "id")
    return nav.withColumn("place", F.row_number().over(w)).select("query", "place", "id", "packed")


def p5_completion(spark: SparkSession, folder: str) -> DataFrame:
    """The hundred completions of each request, in their final order."""
    rank = CQ.ranked_evidence(spark, folder).join(CQ.requests(spark, folder), "current").withColumn("match_class", N.match_class(F.col("prefix"), F.col("name")))
    order = [F.desc("match_class"), F.desc("final_rank"), F.desc(R.lookup(F.col("source"), R.SOURCE_PRIORITY)), F.desc("match_score"), F.char_length("name"), F.col("name")]
    return rank.withColumn("position", F.row_number().over(Window.partitionBy("current").orderBy(*order))).where("position <= 100").select("current", "position", "name", "final_rank")


def p6_member_completion(spark: SparkSession, folder: str) -> DataFrame:
    """Members offered behind the receivers of the Go texts that are declared with a record type."""
    loc = _facts(spark, folder, "local").where("detail is not null").select("file_id", "caller", F.col("name").alias("receiver"), F.regexp_extract("detail", r"(\w+)\s*$", 1).alias("owner"))
    mem = _facts(spark, folder, "member").where("owner is not null").select("file_id", "owner", F.col("name").alias("member"), F.col("kind").alias("member_kind")).distinct()
    return loc.join(mem, ["file_id", "owner"]).groupBy("file_id", "caller", "receiver", "owner").agg(F.array_join(F.sort_array(F.collect_set("member")), ",").alias("members"))


def p9_hover(spark: SparkSession, folder: str) -> DataFrame:
    """What a hover over each documented definition shows: signature, documentation and pairing."""
    a = live_anchors(spark, folder).select("id", "presentation_signature", "path")
    return x27_comments(spark, folder).join(a, "id").join(CQ.j16_counterparts(spark, folder).select("id", "evidence"), "id").select("id", F.concat(F.lit("```\n"), F.col("presentation_signature"), F.lit("\n```\n\n"), F.col("markdown")).alias("markdown"), "path", "evidence")


def p10_signature_help(spark: SparkSession, folder: str) -> DataFrame:
    """The ten signatures shown for each stated call, those that take its arguments first."""
    shown = CQ.p18_callable_candidates(spark, folder).join(live_anchors(spark, folder).select("id", "presentation_signature", "path", "start_byte"), "id")
    w = Window.partitionBy("site_id").orderBy(R.lookup(F.col("compatibility"), {"compatible": 0, "unknown": 1}, 2), "path", "start_byte", "id")
    return shown.withColumn("n", F.row_number().over(w)).where("n <= 10").select("site_id", "n", "id", "presentation_signature")


def p11_document_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols of each file in the order of their places."""
    d = e3_declarations(spark, folder)
    w = Window.partitionBy("file_id").orderBy("start_byte", "name", "kind")
    return d.withColumn("position", F.row_number().over(w)).select("file_id", "position", "name", "kind")


def p12_semantic_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Coloured tokens of each file: occurrences of names with one dominant kind, as far as their role allows, relative to each other."""
    f = materialize(_facts(spark, folder, "declaration", "occurrence").select("file_id", "fact", "name", "kind", "role", "start_line", "start_character"), "facts")
    label = F.when(F.col("kind").isin("type", "alias"), "type").when(F.col("kind") == "macro", "macro").when(F.col("kind") == "enum_constant", "enum_member")
    counts = f.where("fact = 'declaration'").select("name", label.alias("label")).where("label is not null").groupBy("name", "label").agg(F.count("*").alias("n"))
    top = counts.withColumn("most", F.max("n").over(Window.partitionBy("name"))).where("n = most").groupBy("name").agg(F.count("*").alias("k"), F.max("label").alias("label")).where("k = 1").select("name", "label")
    tokens = f.where("fact = 'occurrence'").join(top, "name").where(R.role_allows_color(F.col("label"), F.col("role")))
    t = tokens.select("file_id", "name", "label", F.col("start_line").alias("line"), F.col("start_character").alias("start"))
    return references.relative_tokens(t, "file_id", ["line", "start", "name"]).select("file_id", "line", "delta_line", "delta_start", F.length("name").alias("length"), "label")


def p13_possible_targets(spark: SparkSession, folder: str) -> DataFrame:
    """All candidates of each stated name, none suppressed, with group and tier."""
    return K.focus(K.grouped(CQ._candidates(spark, folder)), F.lit("neutral")).select("query", "id", "tier", "focused", "position")


def p17_resolved_handles(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates looked up again by handle: those whose identity is still that of the handle; the handles of names that an overlay has renamed since are stale."""
    a = live_anchors(spark, folder)
    d = P.digest(F.lower("entity_key"), F.col("name"))
    handles = a.select("id", d.alias("digest"))
    now = CQ.overlay_names(a)
    return handles.join(now.select("id", d.alias("digest"), "presentation_signature"), ["id", "digest"]).select("id", "presentation_signature")


def p19_type_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Records and how many members each has over all files."""
    f = _facts(spark, folder, "record", "member")
    r = f.where("fact = 'record'").select("file_id", F.col("name").alias("owner"), F.col("kind").alias("tag")).distinct()
    m = f.where("fact = 'member'").select("file_id", "owner", "name").distinct().groupBy("file_id", "owner").agg(F.count("*").alias("n"))
    return r.join(m, ["file_id", "owner"], "left").groupBy("owner", "tag").agg(F.count("*").alias("n_records"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_members"))


QUERIES = {
    f.__name__: f
    for f in (
        s9_parsed_files, e1_includes, e3_declarations, e4_macros, e4_objects, e5_members, e6_type_aliases, e7_callables, e7_calls, e8_occurrences, e9_locals, f14_visible_locals, w7_nearest_binding, e10_packages, e10_imports, e11_fallback_names, e12_recovered,
        e13_proto_declarations, j22_proto_sources, e14_labels, x17_intents, x18_words, x19_member_chains, x20_byte_offsets, x21_words, x23_call_contexts, x24_parameters, x27_comments, x28_excerpts, x29_build_guards, x30_guards, j5_members, t11_member_order,
        j20_alias_chains, j21_member_chains, a11_fallback_members,
    )
}
QUERIES |= {"q_" + f.__name__: f for f in (p2_definitions, p5_completion, p6_member_completion, p9_hover, p10_signature_help, p11_document_symbols, p12_semantic_tokens, p13_possible_targets, p17_resolved_handles, p19_type_candidates)}

# Fixed values of the SQL: comments and literals, keywords, and how members stand in the texts.
_NOISE = r"""/\*(?:[^*]|\*+[^*/])*\*+/|//[^\n]*|"(?:[^"\\\n]|\\.)*"|''(?:[^''\\\n]|\\.)*''"""
_WORDS_OF = "list_distinct(list_filter(regexp_extract_all({0}, '[\\p{{L}}_][\\p{{L}}\\p{{N}}_]*'), lambda w: regexp_matches(w, '^[A-Za-z_][A-Za-z0-9_]*$') and not list_contains([{1}], w)))"
_quoted = lambda words: ", ".join(f"'{w}'" for w in sorted(words))
_LINES_SQL = rf"(select s.id, s.line, s.col, rtrim(ls[s.line + 1], chr(13)) as text from (select id, path, callee_range.start_line as line, callee_range.start_character as col from {SITES_SQL}) s join (select path, string_split(text, chr(10)) ls from {_TEXTS}) t using (path) where s.line < len(ls))"
_BODIES = rf"(select revision_id as file_id, path, text, regexp_extract(rec, '^(?:type |struct |class )(\w+)', 1) as owner, regexp_extract(rec, '^(?:type \w+ )?(struct|class)', 1) as tag, rec from (select revision_id, path, text, unnest(regexp_extract_all(text, '(?m)^(?:type \w+ struct|struct \w+|class \w+)[ \t]*\{{[^}}]*\}}')) as rec from {_TEXTS}) where starts_with(rec, 'type ') = ends_with(path, '.go'))"
_MEMBERS = rf"""(select file_id, path, owner, name, kind, signature, start_byte, type_name from (
 select file_id, path, owner, regexp_extract(l, case when ends_with(path, '.go') then '^[ \t]+(\w+)' else '^[ \t]+\w+ (\w+)' end, 1) as name, 'field' as kind, null::varchar as signature, regexp_extract(l, case when ends_with(path, '.go') then '^[ \t]+\w+ (\w+)' else '^[ \t]+(\w+)' end, 1) as type_name, strlen(substr(text, 1, strpos(text, rec) - 1)) + strlen(substr(rec, 1, strpos(rec, l) - 1)) + strlen(regexp_extract(l, case when ends_with(path, '.go') then '^[ \t]+' else '^[ \t]+\w+ ' end)) as start_byte
 from (select *, unnest(regexp_extract_all(rec, '(?m)^[ \t]+(?:\w+ \w+(?: = \d+)?;|\w+ \w+\r?$)')) as l from {_BODIES})))"""
_METHODS = rf"""(select * from (
 select revision_id as file_id, path, regexp_extract(h, '^func \(\w+ \*?(\w+)\)', 1) as owner, regexp_extract(h, '\) (\w+)\($', 1) as name, null::varchar as detail, h, text from (select revision_id, path, unnest(regexp_extract_all(text, '(?m)^func \(\w+ \*?\w+\) \w+\(')) as h, text from {_TEXTS} where ends_with(path, '.go'))
 union all select revision_id, path, regexp_extract(h, '(\w+)::\w+\($', 1), regexp_extract(h, '::(\w+)\($', 1), nullif(trim(regexp_replace(regexp_extract(h, '^([\s\S]*?)\w+::\w+\($', 1), '\s+', ' ', 'g')), ''), h, text from (select revision_id, path, text, unnest(regexp_extract_all(text, '(?m)^(?:[A-Za-z_][\w ]*[ *&\r\n]+)?\w+::\w+\(')) as h from {_TEXTS} where not ends_with(path, '.go'))))"""
def _intent_sql() -> str:
    """The rules of the intent at a cursor, in their order."""
    typeish = lambda w: f"(regexp_matches({w}, '^[A-Z]') or {w} in ({_quoted(U.TYPEISH)}) or ends_with({w}, '_t'))"
    return rf"""select id, split_part(x, ' ', 1) as intent, split_part(x, ' ', 2) as confidence from (select id, case when directive in ('if', 'ifdef', 'ifndef', 'elif', 'define') then 'macro_preprocessor high' when starts_with(ltrim(after), '(') then 'call_target high'
 when token in ({_quoted(U.TYPE_CUES)}) then 'type_name high' when token in ('*', '&', '**', '&&') and earlier <> '' and {typeish('earlier')} then 'declaration_name medium' when token in ({_quoted(U.EXPRESSION_CUES)}) then 'expression_value medium'
 when token <> '' and {typeish("trim(token, '*&')")} then 'declaration_name medium' else 'neutral low' end as x
 from (select *, case when regexp_matches(bare, '[\p{{L}}\p{{N}}_*&]$') then regexp_extract(bare, '[\p{{L}}\p{{N}}_*&]+$') else right(bare, 1) end as token, regexp_extract(bare, '(\w+)\s*[*&]+$', 1) as earlier
 from (select id, substr(text, col + 1) as after, regexp_extract(substr(text, 1, col), '^\s*#\s*(\w+)', 1) as directive, regexp_replace(regexp_replace(substr(text, 1, col), '[A-Za-z0-9_]*$', ''), '\s+$', '') as bare from {_LINES_SQL})))"""


_ALL_MEMBERS = f"(select file_id, path, owner, name, kind, start_byte from {_MEMBERS} union all select file_id, path, owner, name, 'method', strlen(substr(text, 1, strpos(text, h) - 1)) + strlen(h) - strlen(name) - 1 from {_METHODS})"
_FALLBACK = f"(select *, row_number() over (order by tier desc, freq desc, (kind <> 'method')::int, name) as position from (select lower(name) as lower_name, kind, count(*) as freq, max(case when starts_with(path, '/') then 2 else 0 end) as tier, arg_min(name, row(case when starts_with(path, '/') then -2 else 0 end, name)) as name from {_ALL_MEMBERS} group by 1, 2))"
_SRC = CQ._SP
SQL = {
    "e1_includes": f"select revision_id as file_id, trim(unnest(regexp_extract_all(text, '(?m)^[ \\t]*#[ \\t]*include[ \\t]*([^\\r\\n]*)', 1))) as name from {_TEXTS} where not ends_with(path, '.go')",
    "e7_callables": f"select file_id, name, start_byte, owner, qualified_name, canonical_signature, linkage_kind, min_arity from {_INDEXED}",
    "e10_packages": f"select revision_id as file_id, regexp_extract(text, '(?m)^package[ \\t]+(\\w+)', 1) as name from {_TEXTS} where ends_with(path, '.go') and regexp_matches(text, '(?m)^package[ \\t]+\\w+')",
    "e10_imports": f"select revision_id as file_id, unnest(regexp_extract_all(text, '(?m)^\\t\"([^\"\\n]*)\"', 1)) as name from {_TEXTS} where ends_with(path, '.go')",
    "x20_byte_offsets": f"select s.id, case when s.line >= len(ls) then strlen(text) else coalesce(list_sum(list_transform(ls[1:s.line], lambda x: strlen(x) + 1)), 0) + strlen(substr(ls[s.line + 1] || case when s.line + 1 < len(ls) then chr(10) else '' end, 1, s.col)) end::bigint as \"offset\" from (select id, path, callee_range.start_line as line, callee_range.start_character as col from {SITES_SQL}) s join (select path, text, string_split(text, chr(10)) ls from {_TEXTS}) t using (path)",
    "x28_excerpts": f"select a.id, array_to_string(string_split(t.text, chr(10))[a.body_range.start_line + 1 : a.body_range.end_line + 1], chr(10)) as excerpt from {LIVE_SQL} a join {_TEXTS} t using (revision_id) where a.has_body and a.id % 100 = 0",
    "x29_build_guards": f"select t.revision_id, nullif(regexp_extract(t.text, '(?m)^//go:build[ \\t]+([^\\r\\n]*)', 1), '') as build_guard from {_TEXTS} t where ends_with(t.path, '.go')",
    "j20_alias_chains": f"""with recursive a as (select name, count(distinct target) n, min(target) target from {_ALIASES} group by 1), q as (select distinct name from {LIVE_SQL} where name is not null),
 c(query, name, seen, depth, status) as (select name, name, [name], 0, case when length(name) % 4 = 2 then 'unique_record' when (select n from a where a.name = q.name) is null then 'unresolved' when (select n from a where a.name = q.name) > 1 then 'ambiguous' when (select target from a where a.name = q.name) = name then 'cycle' end from q
  union all select c.query, n.name, list_append(c.seen, n.name), c.depth + 1, case when length(n.name) % 4 = 2 and n.name in (select name from q) then 'unique_record' when b.n is null then 'unresolved' when b.n > 1 then 'ambiguous' when list_contains(list_append(c.seen, n.name), b.target) then 'cycle' when c.depth + 1 = 16 then 'truncated' end
  from c join a on a.name = c.name cross join lateral (select a.target as name) n left join a b on b.name = n.name where c.status is null)
 select query, status, case when status = 'unique_record' then name end as record, depth from c where status is not null""",
    "j21_member_chains": f"with m as (select name as owner, count(distinct target) n, min(target) t from {_ALIASES} group by 1) select a.owner as chain_id, b.t as record, a.n > 1 or b.n > 1 as ambiguous from m a join m b on b.owner = a.t",
    "q_p2_definitions": f"select query, row_number() over (partition by query order by packed desc, path, start_line, id) as place, id, packed from (select *, tier_rank * 2048 + {CQ._DEFBASE} + {CQ._LOCAL} as packed from (select *, min(rr) over (partition by query, group_key) b from (select *, case role when 'definition' then 0 when 'tentative' then 1 when 'declaration' then 2 when 'unknown' then 3 else 9 end rr from {CQ._FOCUSED} where focused)) where case when b = 9 then position = 1 else rr = b end)",
    "q_p5_completion": f"select current, position, name, final_rank from (select r.current, r.name, r.final_rank, row_number() over (partition by r.current order by case when lower(r.name) = lower(q.prefix) then 2 when starts_with(lower(r.name), lower(q.prefix)) then 1 else 0 end desc, r.final_rank desc, {_SRC} desc, match_score desc, length(r.name), r.name) as position from ({CQ.SQL['x11_final_rank']}) r join {CQ._MERGED} m on m.current = r.current and m.name = r.name join {CQ._REQUESTS} q on q.current = r.current) where position <= 100",
    "q_p10_signature_help": f"select site_id, n, id, presentation_signature from (select c.site_id, a.id, a.presentation_signature, row_number() over (partition by c.site_id order by case c.compatibility when 'compatible' then 0 when 'unknown' then 1 else 2 end, a.path, a.start_byte, a.id) as n from ({CQ.SQL['q_p18_callable_candidates']}) c join {LIVE_SQL} a using (id)) where n <= 10",
    "q_p13_possible_targets": f"select query, id, tier, group_tier = max(group_tier) over (partition by query) as focused, position from {CQ._GROUPED}",
    "q_p17_resolved_handles": f"select id, presentation_signature from {LIVE_SQL} where name is null or path is null or length(path) % 7 <> 0",
    "e4_macros": f"select revision_id as file_id, regexp_extract(d, 'define[ \\t]+(\\w+)', 1) as name from (select revision_id, unnest(regexp_extract_all(text, '(?m)^[ \\t]*#[ \\t]*define[ \\t]+\\w+[ \\t]+[^\\s/][^\\n]*')) as d from {_TEXTS} where not ends_with(path, '.go'))",
    "e4_objects": f"select revision_id as file_id, regexp_extract(d, '(\\w+)$', 1) as name, 'definition' as role, 'package' as linkage_kind, regexp_extract(d, '(const|var) ', 1) as detail from (select revision_id, unnest(regexp_extract_all(text, '(?m)^(?:static )?(?:const|var) \\w+')) as d from {_TEXTS} where ends_with(path, '.go'))",
    "x18_words": r"select id, nullif(case when regexp_matches(b || a, '^[0-9]') then '' else b || a end, '') as word, nullif(case when regexp_matches(b, '^[0-9]') then '' else b end, '') as prefix from (select id, regexp_extract(substr(text, 1, col), '[A-Za-z0-9_]*$') as b, regexp_extract(substr(text, col + 1), '^[A-Za-z0-9_]*') as a from " + _LINES_SQL + ")",
    "x21_words": f"select revision_id, unnest(case when ends_with(lower(path), '.go') then {_WORDS_OF.format('go', _quoted(X.GO_KEYWORDS))} else {_WORDS_OF.format('c', _quoted(X.C_KEYWORDS))} end) as word from (select *, regexp_replace(regexp_replace(text, '(?m)^[ \\t]*#[^\\n]*', ' ', 'g'), '{_NOISE}|/\\*[\\s\\S]*|\\b[0-9][0-9A-Za-z_.]*', ' ', 'g') as c, regexp_replace(text, '{_NOISE}|`[^`]*`|/\\*[\\s\\S]*|\\b[0-9][0-9A-Za-z_.]*', ' ', 'g') as go from {_TEXTS})",
    "x24_parameters": f"select id, (n - 1)::int as n, trim(ps[n]) as parameter from (select id, ps, unnest(generate_series(1, len(ps))) as n from (select id, list_filter(string_split(regexp_extract(canonical_signature, '\\(([^)]*)\\)', 1), ','), lambda x: trim(x) <> '') ps from {LIVE_SQL} where canonical_signature is not null))",
    "e12_recovered": rf"select revision_id, length(text)::int as n_chars, coalesce(list_sum(list_transform(list_concat(regexp_extract_all(text, '__attribute__\s*\(\((?:[^()]|\([^()]*\))*\)\)|__declspec\s*\([^()]*\)|\b(?:alignas|_Alignas)\s*\([^()]*\)'), regexp_extract_all(text, '\b([A-Z][A-Z0-9_]*_(?:API|EXPORT))\s+\w', 1)), lambda x: length(regexp_replace(x, '[ \n]', '', 'g')))), 0)::int as n_blanked from {_TEXTS}",
    "q_p19_type_candidates": f"select owner, tag, count(*) as n_records, coalesce(sum(n), 0)::bigint as n_members from (select distinct file_id, owner, tag from {_BODIES}) left join (select file_id, owner, count(distinct name) as n from (select file_id, owner, name from {_MEMBERS} union all select file_id, owner, name from {_METHODS}) group by 1, 2) using (file_id, owner) group by 1, 2",
    "x17_intents": _intent_sql(),
    "j5_members": f"select file_id, name, kind from {_ALL_MEMBERS} where (file_id, owner) in (select (file_id, owner) from {_BODIES} where lower(owner) = 'slot')",
    "t11_member_order": f"select position, path, name, total > 50 as truncated from (select path, name, row_number() over (order by path, start_byte, name, kind) as position, count(*) over () as total from {_ALL_MEMBERS}) where position <= 50",
    "a11_fallback_members": f"select lower_name, kind, freq, position, (select count(*) > 40 from {_FALLBACK}) as truncated from {_FALLBACK} where position <= 40",
    "e5_members": f"select file_id, owner, name, kind, type_name as detail from {_MEMBERS} union all select file_id, owner, name, 'method', detail from {_METHODS}",
}
