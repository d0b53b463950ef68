"""Local bindings with their scopes, and what can be seen of them from a cursor."""

from pyspark.sql import functions as F

from cairn.operators import bindings as B
from cairn.sources import extract as X

C = "int f(int a) {\n  int b = 1;\n  for (int i = 0; i < b; i++) { int c = i; g1(c); }\n  { int b = 2; g2(b); }\n  g3(b);\n}\nint h(int z) { return g4(z); }\n"
GO = "package p\nfunc f(a int) {\n\tb := 1\n\tif c := g0(); c > 0 {\n\t\tb := 2\n\t\tg1(b)\n\t}\n\tg2(b)\n}\n"


def seen(spark, text, path):
    facts = X.parse_files(spark.createDataFrame([(1, path, text), (2, path, None)], "id int, path string, text string"), file_id="id", path="path", text="text")
    local = facts.where("fact = 'local'").withColumnRenamed("start_byte", "decl_byte")
    calls = facts.where("fact = 'call'").select("file_id", "caller", "name", F.col("start_byte").alias("at"))
    keys = ["file_id", "caller"]
    got = B.visible_bindings(local, calls, keys)
    names = {r["at"]: r["name"] for r in calls.collect()}
    sight: dict[str, list] = {}
    for r in got.collect():
        sight.setdefault(names[r["at"]], []).append((r["name"], text[: r["decl_byte"]].count("\n")))
    near = {(names[r["at"]], r["name"]): text[: r["decl_byte"]].count("\n") for r in B.nearest_binding(local, got.select(*keys, "at", "name"), keys).collect()}
    return {k: sorted(v) for k, v in sight.items()}, near


def test_scopes_of_c(spark):
    sight, near = seen(spark, C, "a.c")
    assert sight == {"g1": [("a", 0), ("b", 1), ("c", 2), ("i", 2)], "g2": [("a", 0), ("b", 1), ("b", 3)], "g3": [("a", 0), ("b", 1)], "g4": [("z", 6)]}
    assert near["g2", "b"] == 3 and near["g3", "b"] == 1


def test_scopes_of_go(spark):
    sight, near = seen(spark, GO, "a.go")
    assert sight == {"g0": [("a", 1), ("b", 2), ("c", 3)], "g1": [("a", 1), ("b", 2), ("b", 4), ("c", 3)], "g2": [("a", 1), ("b", 2)]}
    assert near["g1", "b"] == 4 and near["g2", "b"] == 2


def test_edges_of_visibility(spark):
    """At the start of function and scope nothing is seen, at their ends still; a cursor on the declaration means it; nulls see nothing."""
    rows = [(1, "f", "v", "variable", 10, 5, 30, 8, 20), (1, "f", "v", "variable", 10, 5, 30, 8, 20), (1, "f", "w", "variable", 6, 5, 30, 5, 30), (None, "f", "x", "variable", 6, 5, 30, 5, 30), (1, "f", "y", "variable", None, 5, 30, 5, 30)]
    b = spark.createDataFrame(rows, "file_id int, caller string, name string, kind string, decl_byte int, fn_start int, fn_end int, scope_start int, scope_end int")
    at = [5, 6, 7, 10, 11, 20, 21, 30, 31, None]
    c = spark.createDataFrame([(1, "f", x) for x in at] + [(1, "g", 7)], "file_id int, caller string, at int")
    got = {(r["at"], r["name"]) for r in B.visible_bindings(b, c, ["file_id", "caller"]).collect()}
    assert got == {(x, "w") for x in (7, 10, 11, 20, 21, 30)} | {(x, "v") for x in (11, 20)}
    on = spark.createDataFrame([(1, "f", 10, "v"), (1, "f", 9, "v"), (1, "f", 21, "v")], "file_id int, caller string, at int, name string")
    assert [(r["at"], r["decl_byte"]) for r in B.nearest_binding(b, on, ["file_id", "caller"]).collect()] == [(10, 10)]
    done = B.local_completions(B.visible_bindings(b, c, ["file_id", "caller"]), ["file_id", "caller"], F.when(F.col("name") == "v", 2).otherwise(1), 1)
    assert {(r["at"], r["name"]) for r in done.collect()} == {(7, "w"), (10, "w"), (11, "v"), (20, "v"), (21, "w"), (30, "w")}
    assert B.visible_bindings(b.limit(0), c, ["file_id", "caller"]).count() == 0
