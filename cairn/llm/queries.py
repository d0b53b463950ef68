"""Queries p5 to p9 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.common import table
from cairn.llm import bpe, docpairs, leaks, parsecheck, subjects


def _functions(spark: SparkSession, folder: str) -> DataFrame:
    return docpairs.documented_functions(table(spark, folder, "source_texts"), file_id="revision_id", path="path", text="text")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Definitions whose declaration has a description above it."""
    definitions = table(spark, folder, "callable_anchors").where(F.col("role") == "definition")
    return docpairs.matched_anchors(_functions(spark, folder), definitions, anchor_id="id", file_id="revision_id", name="name", name_range="name_range")


def p5_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs themselves: description and code of each documented function whose body has an end."""
    return _functions(spark, folder).where("code is not null").select(F.col("file_id").alias("revision_id"), "name", "name_line", "end_line", "description", "code")


def p5_code(spark: SparkSession, folder: str) -> DataFrame:
    """Head and body of all functions, documented or not, in the texts that the index has definitions of and that neither break off nor hold remains of a merge."""
    indexed = table(spark, folder, "callable_anchors").where("role = 'definition' and body_range is not null").select("revision_id").distinct()
    texts = table(spark, folder, "source_texts").where(~F.col("text").rlike(r"(?m)^(<{7}|={7}|>{7})") & F.col("text").rlike(r"(\}|#endif[^\n]*)\s*\z")).join(indexed, "revision_id", "left_semi")
    found = docpairs.documented_functions(texts, file_id="revision_id", path="path", text="text", least_words=0).where("code is not null")
    return found.select(F.col("file_id").alias("revision_id"), "name", "name_line", "end_line", "code").distinct()


def _verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return parsecheck.verdicts(table(spark, folder, "source_texts"), file_id="revision_id", path="path", text="text")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Revisions whose text is not valid in the language of its extension."""
    return _verdicts(spark, folder).where(F.col("verdict") != "valid").select(F.col("file_id").alias("revision_id")).distinct()


def p6_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Rates of invalid files per repository and language code, beside what the parser reported."""
    about = table(spark, folder, "file_revisions").groupBy(F.col("id").alias("file_id")).agg(F.max("repo").alias("repo"), F.max("language").alias("language"))
    return parsecheck.rates(_verdicts(spark, folder).dropDuplicates(["file_id"]), about, ["repo", "language"])


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode_column(table(spark, folder, "documents"), doc_id="doc_id", text="text")


def p7_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, their tokens, and how many come back unchanged from their ids."""
    docs = table(spark, folder, "documents")
    ids = bpe.encode_column(docs, doc_id="doc_id", text="text")
    back = bpe.decode_column(ids, doc_id="doc_id", ids="ids").select("doc_id", F.col("text").alias("back"))
    same = back.join(docs.select("doc_id", "text"), "doc_id")
    return same.agg(F.count("*").alias("n_docs"), F.count(F.when(F.col("back") == F.coalesce("text", F.lit("")), 1)).alias("n_same"))


def _passages(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked_passages(table(spark, folder, "documents"), table(spark, folder, "eval_items"), doc_id="doc_id", item_id="item_id")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the items of which they hold a passage."""
    return _passages(spark, folder).select("doc_id", "item_id").distinct()


def p8_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold at least half of an item in runs of 13 or more words, in whatever order, with the tiles' figures."""
    return leaks.contaminated(_passages(spark, folder)).select("doc_id", "item_id", "n_tiles", "longest", "covered", "item_words")


def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    """Leaks per test item."""
    return _passages(spark, folder).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("longest").alias("longest"))


def _masses(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.subject_masses(table(spark, folder, "documents"), table(spark, folder, "subject_labels"), table(spark, folder, "subject_areas"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Subjects that each document is about."""
    return subjects.assigned(_masses(spark, folder)).select("doc_id", "subject").distinct()


def p9_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and mass of each subject in the corpus."""
    return subjects.assigned(_masses(spark, folder)).groupBy("subject").agg(F.count("*").alias("n_docs"), F.sum("mass").alias("mass"))


_P8_PAIRS = r"""
with d as (select doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+') w from documents where text is not null),
 i as (select item_id, regexp_extract_all(text, '[\p{L}\p{N}]+') w from eval_items where text is not null),
 dg as (select doc_id, lower(array_to_string(list_slice(w, k, k + 12), ' ')) g from d, unnest(generate_series(1, len(w) - 12)) as t(k)),
 ig as (select item_id, lower(array_to_string(list_slice(w, k, k + 12), ' ')) g from i, unnest(generate_series(1, len(w) - 12)) as t(k))
select distinct doc_id, item_id from dg join ig using (g)
"""

#: Greedy string tiling: from every document and item the longest run of unmarked windows on one diagonal, again and again.
_P8_TILES = r"""
(with recursive d as (select doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+') w from documents where text is not null),
 i as (select item_id, regexp_extract_all(text, '[\p{L}\p{N}]+') w from eval_items where text is not null),
 dg as (select doc_id, k as a, lower(array_to_string(list_slice(w, k, k + 12), ' ')) g from d, unnest(generate_series(1, len(w) - 12)) as t(k)),
 ig as (select item_id, k as b, len(w) as item_words, lower(array_to_string(list_slice(w, k, k + 12), ' ')) g from i, unnest(generate_series(1, len(w) - 12)) as t(k)),
 m as materialized (select distinct doc_id, item_id, item_words, a, b from dg join ig using (g)),
 t(doc_id, item_id, item_words, tiles) as (select distinct doc_id, item_id, item_words, []::struct(k bigint, a bigint, b bigint)[] from m
  union all
  select doc_id, item_id, item_words, list_append(any_value(tiles), min(struct_pack(k := -n, a := a0, b := b0))) from (
   select doc_id, item_id, item_words, any_value(tiles) tiles, min(a) a0, min(b) b0, count(*) + 12 n from (
    select t.*, m.a, m.b, m.a - row_number() over (partition by t.doc_id, t.item_id, m.a - m.b order by m.a) as island from t join m using (doc_id, item_id)
    where len(list_filter(t.tiles, lambda x: not ((m.a + 12 < x.a or m.a >= x.a - x.k) and (m.b + 12 < x.b or m.b >= x.b - x.k)))) = 0) group by doc_id, item_id, item_words, a - b, island) group by 1, 2, 3)
select doc_id, item_id, len(tiles)::int as n_tiles, (-tiles[1].k)::int as longest, list_sum(list_transform(tiles, lambda x: -x.k))::int as covered, item_words::int as item_words from (select *, row_number() over (partition by doc_id, item_id order by len(tiles) desc) r from t) where r = 1 and len(tiles) > 0)
"""

QUERIES = {
    "p5_found": p5_found,
    "p5_pairs": p5_pairs,
    "p5_code": p5_code,
    "p6_found": p6_found,
    "p6_rates": p6_rates,
    "p7_ids": p7_ids,
    "p7_roundtrip": p7_roundtrip,
    "p8_found": p8_found,
    "p8_coverage": p8_coverage,
    "p8_items": p8_items,
    "p9_found": p9_found,
    "p9_composition": p9_composition,
}
SQL: dict[str, str] = {
    "p5_code": "select distinct a.revision_id, a.name, a.name_range.start_line as name_line, a.body_range.end_line as end_line, array_to_string(string_split(t.text, chr(10))[a.declaration_range.start_line + 1 : a.body_range.end_line + 1], chr(10)) as code from callable_anchors a join source_texts t using (revision_id) where a.role = 'definition' and a.body_range is not null and t.text is not null and not regexp_matches(t.text, '(?m)^(<{7}|={7}|>{7})') and regexp_matches(t.text, '(\\}|#endif[^\\n]*)\\s*\\z')",
    "p7_roundtrip": "select count(*) as n_docs, count(*) as n_same from documents", "p8_found": _P8_PAIRS,
    "p8_coverage": f"select * from {_P8_TILES} where covered >= 0.5 * item_words",
    "p8_items": f"select item_id, count(distinct doc_id) as n_docs, max(longest) as longest from {_P8_TILES} group by 1",
}
