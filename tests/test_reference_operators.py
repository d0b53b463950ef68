"""Operators over names, includes, graphs, callables, candidates and versions on small fixtures with known results."""

import random

import pytest
from pyspark.sql import functions as F

from cairn.functions import names as N
from cairn.functions import paths as P
from cairn.functions import ranking as R
from cairn.operators import callables as C
from cairn.operators import candidates as K
from cairn.operators import files as FL
from cairn.operators import graph, includes, packages, proto, references, search
from cairn.operators import members as M
from cairn.operators import versions as V
from cairn.sources import extract


def one(spark, *cols):
    return spark.range(1).select(*cols).collect()[0]


# --- names ------------------------------------------------------------------------------------------------------
def brute_boundary(s, i):
    p, c = s[i - 1] if i else "", s[i]
    return i == 0 or (p == "_" and c != "_") or (p.islower() and c.isupper()) or (p.isalpha() and c.isdigit())


def subsequence(needle, hay):
    it = iter(hay)
    return all(c in it for c in needle)


def brute_score(needle, name):
    n, low = needle.lower(), name.lower()
    if low == n:
        return 1000
    if low.startswith(n):
        return 800
    at = low.find(n)
    if at >= 0:
        return 650 if brute_boundary(name, at) else 500
    initials = "".join(low[i] for i in range(len(name)) if brute_boundary(name, i))
    return 400 if subsequence(n, initials) else 200 if subsequence(n, low) else None


def test_match_score(spark):
    rnd = random.Random(1)
    names = ["hello_value", "KePmmAllocPages", "KeKvaInit", "main", "hello", "device_bind_driver_to_node", "a__b", "x1y2", "_", "B"]
    names += ["".join(rnd.choice("abAB_1") for _ in range(rnd.randrange(1, 9))) for _ in range(150)]
    needles = ["hello", "kpa", "zzz", "dbdtn", "a", "b1", "ab", "_", "1", "A_b"]
    df = search.asked(spark.createDataFrame([(n,) for n in names], "name string"), needles)
    for r in df.withColumn("score", N.match_score(F.col("needle"), F.col("name"))).collect():
        assert r["score"] == brute_score(r["needle"], r["name"]), r
    assert search.asked(spark.createDataFrame([("a",)], "name string"), []).count() == 0
    none = spark.createDataFrame([(None,)], "name string").select(N.match_score(F.lit("a"), F.col("name")), N.boundary_initials(F.col("name"))).collect()[0]
    assert none[0] is None and none[1] is None


def test_ranked_search_of_permuted_names(spark):
    rows = [(i, f"symbol_{i * 7919 % 2000:05d}", f"d{i % 7}/f.c", "definition", i % 50 == 0, i % 100 == 0, "d0/f.c", "x") for i in range(2000)] + [(9999, None, "d0/f.c", None, False, None, "d0/f.c", "x")]
    df = spark.createDataFrame(rows, "id bigint, name string, path string, role string, external boolean, directly_included boolean, current string, tier string")
    top = search.ranked(df, ["symbol", "zzz"], 200).orderBy("position").collect()
    def key(r):
        tier = 2 if r[4] and r[5] else 4 if r[2] == "d0/f.c" else 0
        shared = 2 if r[2] == "d0/f.c" else 0
        return (-(tier * 2048 + 800 + 10 * shared), len(r[1]), r[1], -2, r[2], r[0])
    assert [r["id"] for r in top] == [r[0] for r in sorted((r for r in rows if r[1]), key=key)[:200]]


def test_scalar_functions(spark):
    t = lambda v: F.lit(v)
    assert one(spark, N.match_class(t("WNS_IPC"), t("wns_ipc")), N.match_class(t("wns_ipc"), t("wns_ipc_send")), N.match_class(t("wns_ipc_r"), t("wns__ipc_rsp")), N.match_class(t(""), t("x"))) == (2, 1, 0, 0)
    assert one(spark, N.locality(t("a/b/c.h"), t("a/b/d.h")), N.locality(t("a/x"), F.lit(None).cast("string")), N.locality(t("/".join("abcdefghijklm")), t("/".join("abcdefghijklm")))) == (20, 0, 100)
    assert one(spark, N.prefix_bucket(t("-Ab_c")), N.prefix_bucket(t("--")), N.receiver_hint(t("__9Foo")), N.word_score(t("ab"), t("xab"), t(0)), N.word_score(t("ab"), t("x_ab"), t(5)), N.word_score(t("abc"), t("xabc"), t(0))) == ("ab", "none", "foo", None, 255, 250)
    arity = lambda n, a, b, v: R.accepts_arity(t(n), F.lit(a).cast("int"), F.lit(b).cast("int"), t(v))
    assert one(spark, arity(1, 2, 2, False), arity(2, 2, 2, False), arity(5, 1, None, True), arity(0, None, None, False), arity(5, 1, None, False)) == (False, True, True, None, None)
    texts = ['"hello.h"', "<sys/types.h>", "<windows.h> // platform", '"sub\\dir\\a.h"', "stdio.h", "<unterminated", "<>", None]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").select("i", P.include_form(F.col("x")), P.include_path(F.col("x"))).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [("quote", "hello.h"), ("angle", "sys/types.h"), ("angle", "windows.h"), ("quote", "sub/dir/a.h"), (None, None), (None, None), (None, None), (None, None)]
    assert one(spark, R.disposition(t(0), t(1), t(True), t(True)), R.disposition(t(1), t(2), t(True), t(True)), R.disposition(t(1), t(1), t(False), t(True)), R.disposition(t(1), t(1), t(True), t(True)), R.disposition(t(1), t(1), t(True), t(False))) == ("fallback", "ambiguous", "fallback", "exact", "preferred")
    assert one(spark, R.intent_adjustment(t("declaration_name"), t("medium"), t("function"), t("indexed"), t("global")), R.intent_adjustment(t("call_target"), t("low"), t("variable"), t("word"), t("global")), R.history_boost(t(9)), R.proximity(t(33), t(9))) == (-2500, -112, 700, 170)


def test_scope_tiers(spark):
    rows = [(e, d, c, cur, r, f, h, o) for e in (0, 1) for d in (0, 1) for c in (0, 1) for cur in (0, 1) for r in (0, 1) for f in (0, 1) for h in (0, 1) for o in (0, 1)]
    df = spark.createDataFrame([tuple(map(bool, r)) for r in rows], "a boolean, b boolean, c boolean, d boolean, e boolean, f boolean, g boolean, h boolean")
    for r in df.withColumn("t", R.scope_tier(*[F.col(x) for x in "abcdefgh"])).collect():
        e, d, c, cur, reach, f, h, o, t = r
        want = "external" if e and d else "global" if not c else "current" if cur else "global" if not reach else "reachable" if f else "unknown" if h or o else "global"
        assert t == want


def test_paths_and_scope(spark):
    rows = ["target/a.c", "src/A.HPP", "src/a.txt", "src/x.c", "SRC/deep/y.go", "out/b.c", "noext", "src/.c"]
    df = spark.createDataFrame([(x,) for x in rows], "path string")
    assert {r[0] for r in df.where(P.in_scope(F.col("path"), include=["src"])).collect()} == {"src/A.HPP", "src/x.c", "SRC/deep/y.go"}
    lang = {r[0]: r[1] for r in df.select("path", P.language_for(F.col("path"), [("**/*.c", "cpp"), ("src/*", "go")])).collect()}
    assert lang["src/x.c"] == "go" and lang["target/a.c"] == "cpp" and lang["SRC/deep/y.go"] == "go" and lang["noext"] == "c"
    marks = spark.createDataFrame([(x,) for x in ("a/Makefile", "a/go.mod", "a/MAKEFILE", "b/x.vcxproj", "c/readme", "CMakeLists.txt")], "path string")
    assert {(r["dir"], r["markers"]) for r in packages.project_markers(marks).collect()} == {("a", "go.mod,makefile"), ("b", "x.vcxproj"), ("", "cmakelists.txt")}


# --- includes and graphs ----------------------------------------------------------------------------------------
def test_include_resolution(spark):
    files = [("src/a/foo.c",), ("src/a/util.h",), ("multi/x/util.h",), ("multi/multi_hit.c",), ("include/mini.h",), ("/sdk/sys.h",), ("deep/only.h",)]
    f = spark.createDataFrame([(p, "external" if p[0] == "/" else "workspace") for (p,) in files], "path string, source string")
    inc = [("src/a/foo.c", '"util.h"'), ("src/a/foo.c", "<nope/missing.h>"), ("multi/multi_hit.c", '"util.h"'), ("src/a/foo.c", '"include/mini.h"'), ("src/a/foo.c", "<sys.h>"), ("src/a/foo.c", "<only.h>"), ("src/a/foo.c", "MACRO"), ("top.c", '"util.h"'), ("src/a/foo.c", '"util.h"')]
    i = spark.createDataFrame([(a, b, 1) for a, b in inc], "src string, target_text string, rel int")
    r = includes.resolve_includes(i, f, ["/sdk/"])
    got = {(x["src"], x["target_text"]): (x["status"], x["kind"], x["dst"]) for x in r.collect()}
    assert got[("src/a/foo.c", '"util.h"')] == ("edge", "relative_exact", "src/a/util.h")
    assert got[("src/a/foo.c", "<nope/missing.h>")][0] == got[("src/a/foo.c", "MACRO")][0] == "unresolved"
    assert got[("multi/multi_hit.c", '"util.h"')] == ("ambiguous", "suffix_match", None)
    assert got[("src/a/foo.c", '"include/mini.h"')] == ("edge", "workspace_exact", "include/mini.h")
    assert got[("src/a/foo.c", "<sys.h>")] == ("edge", "external_exact", "/sdk/sys.h")
    assert got[("src/a/foo.c", "<only.h>")] == ("edge", "suffix_match", "deep/only.h")
    edges = includes.include_edges(r, f)
    assert {x["dst"] for x in edges.where("src = 'multi/multi_hit.c'").collect()} == {"src/a/util.h", "multi/x/util.h"}
    files_, scope = graph.reach(spark.createDataFrame([("multi/multi_hit.c",)], "origin string"), edges, includes.open_nodes(r))
    assert {(x["path"], x["is_heuristic"]) for x in files_.collect()} == {("multi/multi_hit.c", False), ("src/a/util.h", True), ("multi/x/util.h", True)}
    assert scope.collect()[0][1:] == (True, "ambiguous_include")
    assert [x["directly_included"] for x in includes.directly_included(edges, f).collect()] == [True]
    assert {x[0] for x in includes.affected_sources(i, spark.createDataFrame([("new/util.h",)], "path string")).collect()} == {"src/a/foo.c", "multi/multi_hit.c", "top.c"}
    assert includes.include_edges(includes.resolve_includes(i.limit(0), f), f).count() == 0


@pytest.mark.parametrize(
    ("edges", "opened", "files", "heuristic", "scope"),
    [
        ([("a", "b", "suffix_match"), ("b", "c", "workspace_exact")], [], {"a"}, {"b", "c"}, (False, None)),
        ([("a", "b", "workspace_exact"), ("b", "c", "workspace_exact"), ("c", "a", "workspace_exact")], [], {"a", "b", "c"}, set(), (False, None)),
        ([("a", "b", "workspace_exact")], [("b", "unresolved_include")], {"a", "b"}, set(), (True, "unresolved_include")),
        ([("a", "b", "workspace_exact")], [("b", "ambiguous_include")], {"a", "b"}, set(), (True, "ambiguous_include")),
        ([("a", "b", "workspace_exact")], [("b", "ambiguous_include"), ("a", "unresolved_include")], {"a", "b"}, set(), (True, "unresolved_include")),
        ([("a", "b", "suffix_match"), ("a", "c", "workspace_exact"), ("c", "b", "workspace_exact")], [], {"a", "b", "c"}, set(), (False, None)),
        ([], [], {"a"}, set(), (False, None)),
    ],
)
def test_reach(spark, edges, opened, files, heuristic, scope):
    e = spark.createDataFrame([*edges, (None, "x", "suffix_match")], "src string, dst string, resolution string")
    o = spark.createDataFrame(opened, "src string, reason string")
    f, s = graph.reach(spark.createDataFrame([("a",), ("a",), (None,)], "origin string"), e, o)
    rows = f.collect()
    assert {r["path"] for r in rows if not r["is_heuristic"]} == files and {r["path"] for r in rows if r["is_heuristic"]} == heuristic
    assert [tuple(r)[1:] for r in s.collect()] == [scope]


def test_reach_limits(spark):
    none = spark.createDataFrame([], "src string, reason string")
    chain = spark.createDataFrame([(f"a{i}", f"a{i + 1}", "workspace_exact") for i in range(6)], "src string, dst string, resolution string")
    o = spark.createDataFrame([("a0",)], "origin string")
    assert graph.reach(o, chain, none, depth=5)[1].collect()[0][1:] == (True, "depth_limit")
    assert graph.reach(o, chain, none, depth=7)[1].collect()[0][1:] == (False, None)
    assert graph.reach(o, chain, none, max_nodes=6)[1].collect()[0][1:] == (True, "node_limit")


def walked(start, edges, opened, depth, most):
    """The search as a queue: files, heuristic files, and the first cause of an open scope."""
    out = {}
    for s, d, r in sorted({(s, d, r) for s, d, r in edges}, key=lambda x: (x[2] != "external_exact", x[1])):
        out.setdefault(s, []).append((d, r == "suffix_match"))
    files, guessed, causes = {start}, set(), [opened[start]] if start in opened else []
    queue = [(start, 0, False)]
    for node, d, weak in queue:
        if d >= depth:
            causes.append("depth_limit")
            continue
        for target, step in out.get(node, []):
            new = target not in files and target not in guessed
            if new and len(files) + len(guessed) >= most:
                causes.append("node_limit")
                break
            if weak or step:
                taken = new
                guessed |= {target} if new else set()
            else:
                taken = target not in files
                files.add(target)
                guessed.discard(target)
            if taken:
                causes += [opened[target]] if target in opened else []
                queue.append((target, d + 1, weak or step))
    return files, guessed, (bool(causes), causes[0] if causes else None)


@pytest.mark.parametrize("seed", range(2))
def test_reach_follows_the_visiting_order(spark, seed):
    """Limits of files and depth, late promotions and causes against the walk, for many origins at once."""
    import random

    rnd = random.Random(seed)
    kinds = ["external_exact", "workspace_exact", "suffix_match", "suffix_match"]
    names = [f"n{i:02}" for i in range(14)]
    edges = [(*x, rnd.choice(kinds)) for x in {(rnd.choice(names), rnd.choice(names)) for _ in range(34)} if x[0] != x[1]]
    opened = {n: rnd.choice(["unresolved_include", "ambiguous_include"]) for n in rnd.sample(names, 4)}
    most, depth = (6, 3) if seed else (4, 30)
    e = spark.createDataFrame(edges, "src string, dst string, resolution string")
    f, s = graph.reach(spark.createDataFrame([(n,) for n in names], "origin string"), e, spark.createDataFrame(list(opened.items()), "src string, reason string"), depth=depth, max_nodes=most)
    rows = f.collect()
    assert len(rows) == len({(r["origin"], r["path"]) for r in rows})
    scopes = {r["origin"]: (r["open"], r["reason"]) for r in s.collect()}
    for n in names:
        own = [r for r in rows if r["origin"] == n]
        got = {r["path"] for r in own if not r["is_heuristic"]}, {r["path"] for r in own if r["is_heuristic"]}, scopes[n]
        assert got == walked(n, edges, opened, depth, most)


def test_reach_of_a_star_beyond_the_limit(spark):
    """4,097 direct targets: the first 4,095 are taken, one of them proven by an edge before the first refused one."""
    edges = [("start.h", f"t{i:04}.h", "suffix_match" if i == 7 else "workspace_exact") for i in range(4097)] + [("t0001.h", "t0007.h", "workspace_exact"), ("t0002.h", "a.h", "workspace_exact"), ("t0002.h", "t0007.h", "workspace_exact")]
    none = spark.createDataFrame([], "src string, reason string")
    files, scope = graph.reach(spark.createDataFrame([("start.h",)], "origin string"), spark.createDataFrame(edges, "src string, dst string, resolution string"), none)
    got = {r["path"]: r["is_heuristic"] for r in files.collect()}
    assert len(got) == 4096 and set(got) == {"start.h", *[f"t{i:04}.h" for i in range(4095)]} and not any(got.values())
    assert [tuple(r) for r in scope.collect()] == [("start.h", True, "node_limit")]


def test_reach_counts_a_file_once(spark):
    """A file that arrives along a guess and along proven edges in one round counts once towards the limit; asked files are those of the whole reach."""
    edges = [("o", "a", "suffix_match"), ("o", "b", "workspace_exact"), ("a", "x", "workspace_exact"), ("b", "x", "workspace_exact"), ("x", "y", "suffix_match"), ("x", "z", "workspace_exact")]
    args = spark.createDataFrame([("o",), ("lone",)], "origin string"), spark.createDataFrame(edges, "src string, dst string, resolution string"), spark.createDataFrame([("z", "unresolved_include")], "src string, reason string")
    f, s = graph.reach(*args, max_nodes=5)
    files, guessed, scope = walked("o", edges, {"z": "unresolved_include"}, 32, 5)
    rows = [r for r in f.collect() if r["origin"] == "o"]
    assert {r["path"] for r in rows if not r["is_heuristic"]} == files == {"o", "b", "x"} and {r["path"] for r in rows if r["is_heuristic"]} == guessed == {"a", "y"}
    assert {tuple(r) for r in s.collect()} == {("o", *scope), ("lone", False, None)} and scope == (True, "node_limit")
    asked = spark.createDataFrame([("o", "y"), ("o", "z"), ("o", "x"), ("o", "o"), ("lone", "lone"), ("lone", "x"), ("o", "none"), (None, "x")], "origin string, path string")
    f, again = graph.reach(*args, max_nodes=5, wanted=asked)
    assert {tuple(r) for r in f.collect()} == {("o", "y", True, 3), ("o", "x", False, 2), ("o", "o", False, 0), ("lone", "lone", False, 0)} and again.collect() and set(again.collect()) == set(s.collect())


def test_package_reach_has_no_promotion(spark):
    e = spark.createDataFrame([("p", "q", "heuristic"), ("p", "r", "exact"), ("r", "q", "exact")], "src string, dst string, resolution string")
    m = spark.createDataFrame([(x, f"{x}/1.go") for x in "pqr"], "package string, path string")
    got = {r["path"]: r["is_heuristic"] for r in graph.package_reach(spark.createDataFrame([("p",)], "origin string"), e, m).collect()}
    assert got == {"p/1.go": False, "q/1.go": True, "r/1.go": False}


def test_go_packages(spark):
    p = spark.createDataFrame([("m/s#s", "m/s", "s"), ("m#main", "m", "main"), ("v/vendor/x/y#y", "v/vendor/x/y", "y"), ("z#z", "z", "z")], "package string, dir string, name string")
    got = {r["package"]: r["import_path"] for r in packages.import_paths(p, spark.createDataFrame([("m", "ex.com/m")], "dir string, module string")).collect()}
    assert got == {"m/s#s": "ex.com/m/s", "v/vendor/x/y#y": "x/y", "z#z": None}
    imports = spark.createDataFrame([("a", "one"), ("a", "two"), ("b", "C"), ("b", "none"), ("c", "one"), ("d", None)], "src string, import_path string")
    known = spark.createDataFrame([("p1", "one"), ("p2", "two"), ("p3", "two")], "package string, import_path string")
    edges, opened = packages.package_edges(imports, known)
    assert {tuple(r) for r in edges.collect()} == {("a", "p1", "exact"), ("a", "p2", "heuristic"), ("a", "p3", "heuristic"), ("c", "p1", "exact")}
    assert {tuple(r) for r in opened.collect()} == {("a", "ambiguous_import"), ("b", "boundary")}


# --- callables --------------------------------------------------------------------------------------------------
ANCHOR = "id bigint, name string, qualified_name string, canonical_signature string, kind string, owner_kind string, linkage_kind string, signature_fidelity string, role string, path string"


def test_counterparts(spark):
    a = lambda i, role, path, name="f", **k: (i, name, k.get("q", name), k.get("sig", "int f(int)"), k.get("kind", "function"), k.get("owner"), k.get("link", "external"), "ast_exact", role, path)
    rows = [a(1, "definition", "a.c"), a(2, "declaration", "a.h"), a(3, "definition", "b.c", "g"), a(4, "declaration", "b.h", "g"), a(5, "declaration", "c.h", "g"), a(6, "definition", "s.c", "h", link="internal"), a(7, "declaration", "a.h", "h"), a(8, "definition", "m.cpp", "k", owner="record"), a(9, "declaration", "far.h", "f")]
    reach = spark.createDataFrame([("a.c", "a.h"), ("b.c", "b.h"), ("b.c", "c.h"), ("s.c", "a.h")], "source_path string, header_path string")
    got = {r["id"]: (r["evidence"], r["degree"], r["counterpart_id"]) for r in C.counterparts(spark.createDataFrame(rows, ANCHOR), reach).collect()}
    assert got[1] == ("strict_one_to_one", 1, 2) and got[2] == ("strict_one_to_one", 1, 1)
    assert got[3] == ("ambiguous", 2, None) and got[4] == got[5] == ("ambiguous", 1, None)
    assert all(got[i] == ("unpaired", 0, None) for i in (6, 7, 8, 9))


def test_guesses_count_towards_the_reach_of_pairings(spark, monkeypatch):
    """G9, X32: 4,094 guessed files and a header fill the reach of a source; a header behind them is not in it, though a proven edge leads there."""
    from cairn.plans import callable_queries, graph_queries

    edges = [("s.c", "a.h", "workspace_exact"), *[("s.c", f"g{i:04}.h", "suffix_match") for i in range(4094)], ("s.c", "z.h", "workspace_exact")]
    e = spark.createDataFrame(edges, "src string, dst string, resolution string")
    resolved = spark.createDataFrame([], "src string, status string")
    anchors = [(1, "definition", "s.c", "f"), (2, "declaration", "a.h", "f"), (3, "definition", "s.c", "g"), (4, "declaration", "z.h", "g")]
    a = spark.createDataFrame([(i, n, n, f"int {n}(int)", "function", None, "external", "ast_exact", r, p) for i, r, p, n in anchors], ANCHOR)
    monkeypatch.setattr(graph_queries, "graph_of", lambda *_: (resolved, e))
    monkeypatch.setattr(callable_queries, "live_anchors", lambda *_: a)
    got = {r["id"]: r["evidence"] for r in callable_queries._counterparts(spark, "").collect()}
    assert got == {1: "strict_one_to_one", 2: "strict_one_to_one", 3: "unpaired", 4: "unpaired"}


def test_labels_follow_the_whole_reach(spark, monkeypatch):
    """X32: a header behind 4,095 guessed files is neither reachable nor paired."""
    from cairn.plans import callable_queries, graph_queries, more_queries

    edges = [*[("s.c", f"g{i:04}.h", "suffix_match") for i in range(4095)], ("s.c", "z.h", "workspace_exact")]
    e = spark.createDataFrame(edges, "src string, dst string, resolution string")
    rest = "entity_key string, guard string, start_byte int, start_line int, external boolean, syntax_error_overlap boolean"
    rows = [(i, "g", "g", "int g(int)", "function", None, "external", "ast_exact", r, p, "g", None, 0, 0, False, False) for i, r, p in ((100, "definition", "s.c"), (200, "declaration", "z.h"))]
    a = spark.createDataFrame(rows, f"{ANCHOR}, {rest}")
    monkeypatch.setattr(graph_queries, "graph_of", lambda *_: (spark.createDataFrame([], "src string, status string"), e))
    monkeypatch.setattr(callable_queries, "live_anchors", lambda *_: a)
    monkeypatch.setattr(callable_queries, "kept", lambda *x: x[-1]())
    assert {tuple(r) for r in more_queries.x32_labels(spark, "").collect()} == {("current", "current_visible"), ("unknown", "uncertain"), ("unpaired:0", "unpaired")}


def test_labels_need_one_search(spark, monkeypatch):
    """X32: tiers and pairings come from one search, from the files whose answer can matter alone."""
    from cairn.plans import callable_queries, graph_queries, more_queries

    edges = [("s.c", "a.h", "workspace_exact"), ("t.c", "b.h", "suffix_match"), ("u.c", "m.h", "workspace_exact"), ("m.h", "c.h", "suffix_match"), ("v.c", "m.h", "workspace_exact"), ("n.h", "d.h", "workspace_exact")]
    e = spark.createDataFrame(edges, "src string, dst string, resolution string")
    rest = "entity_key string, guard string, start_byte int, start_line int, external boolean, syntax_error_overlap boolean"
    named = [(1, "definition", "s.c", "f"), (2, "declaration", "a.h", "f"), (3, "definition", "t.c", "g"), (4, "declaration", "b.h", "g"), (5, "definition", "u.c", "h"), (6, "declaration", "c.h", "h"), (7, "definition", "v.c", "k"), (8, "declaration", "d.h", "k"), (100, "definition", "own.c", "alone"), (200, "definition", "p.c", "q"), (9, "definition", "z.c", "q")]
    rows = [(i, n, n, f"int {n}(int)", "function", None, "external", "ast_exact", r, p, n, None, 0, 0, False, False) for i, r, p, n in named]
    a = spark.createDataFrame(rows, f"{ANCHOR}, {rest}")
    monkeypatch.setattr(graph_queries, "graph_of", lambda *_: (spark.createDataFrame([("p.c", "unresolved")], "src string, status string"), e))
    monkeypatch.setattr(callable_queries, "live_anchors", lambda *_: a)
    monkeypatch.setattr(callable_queries, "kept", lambda *x: x[-1]())
    searched, search = [], graph.reach
    monkeypatch.setattr(graph, "reach", lambda origins, *x, **k: (searched.append({r[0] for r in origins.collect()}), search(origins, *x, **k))[1])
    assert {tuple(r) for r in more_queries.x32_labels(spark, "").collect()} == {("current", "current_visible"), ("unknown", "uncertain"), ("strict_one_to_one:1", "strict_one_to_one"), ("unpaired:0", "unpaired")}
    assert searched == [{"s.c", "p.c", "v.c"}]  # t.c has only a guess to follow, c.h is only guessed, own.c has no other candidate


def test_provable_pairs(spark):
    e = spark.createDataFrame([("a", "b", "workspace_exact"), ("b", "c", "external_exact"), ("a", "d", "suffix_match"), ("e", "c", "suffix_match"), (None, "d", "workspace_exact")], "src string, dst string, resolution string")
    pairs = spark.createDataFrame([("a", "c"), ("a", "d"), ("e", "c"), ("e", "e"), ("b", "b"), ("x", "c"), (None, "c"), ("a", None)], "origin string, path string")
    assert sorted(map(tuple, graph.provable(pairs, e).collect())) == [("a", "c"), ("b", "b"), ("e", "e")]
    proven = {(r["origin"], r["path"]) for r in graph.reach(pairs.select("origin"), e, spark.createDataFrame([], "src string, reason string"))[0].where("not is_heuristic").collect()}
    assert proven & {tuple(r) for r in pairs.collect()} == {("a", "c"), ("b", "b"), ("e", "e")}


def test_includes_of_no_source_lead_nowhere(spark):
    f = spark.createDataFrame([("a/x.h", "workspace"), ("a/y.h", "workspace")], "path string, source string")
    lines = [(None, '"a/x.h"'), (None, '"y.h"'), ("a/m.c", None), ("a/m.c", '"y.h"'), ("m.c", '"y.h"'), ("m.c", '"y.h"')]
    got = {tuple(r)[:2]: tuple(r)[3:] for r in includes.resolve_includes(spark.createDataFrame(lines, "src string, target_text string"), f).collect()}
    nowhere = ("unresolved", None, None, 0)
    assert got == {(None, '"a/x.h"'): nowhere, (None, '"y.h"'): nowhere, ("a/m.c", None): nowhere, ("a/m.c", '"y.h"'): ("edge", "relative_exact", "a/y.h", 1), ("m.c", '"y.h"'): ("edge", "suffix_match", "a/y.h", 1)}


def test_call_resolution(spark):
    ent = "entity string, family string, name string, qualified_name string, path string, kind string, owner string, owner_kind string, linkage_kind string, linkage_file string, min_arity int, max_arity int, variadic boolean"
    rows = [
        ("e1", "c", "f", "f", "a.c", "function", None, None, "internal", "a.c", 1, 1, False),
        ("e2", "c", "f", "f", "b.c", "function", None, None, "external", None, 2, 2, False),
        ("e3", "c", "m", "A::m", "b.c", "function", "A", "record", "external", None, 0, 0, False),
        ("e4", "c", "n", "n", "b.c", "function", None, None, "external", None, None, None, False),
        ("e5", "go", "n", "n", "b.go", "function", None, None, "package", None, 0, 0, False),
        ("e6", "c", "u", "u", "b.c", "function", "X", "unknown", "external", None, 0, 0, False),
        ("e7", "c", "d", "d", "x.c", "function", None, None, "external", None, None, None, False),
        ("e8", "c", "d", "d", "y.c", "function", None, None, "external", None, None, None, False),
    ]
    calls = [(1, "c", "a.c", "f", "direct_name", None, 1), (2, "c", "a.c", "f", "direct_name", None, 2), (3, "c", "z.c", "m", "direct_name", None, 0), (4, "c", "z.c", "m", "qualified_name", "A::m", 0), (5, "c", "z.c", "n", "direct_name", None, 3), (6, "c", "z.c", "u", "direct_name", None, 0), (7, "c", "z.c", "f", "member_dot", None, 2), (8, "c", "z.c", "d", "direct_name", None, None), (9, "c", "z.c", None, "direct_name", None, 0), (10, "c", "z.c", "m", "qualified_name", "B::m", 0)]
    got = {}
    for r in C.resolve_calls(spark.createDataFrame(calls, "site_id bigint, family string, path string, name string, form string, qualified_name string, n_args int"), spark.createDataFrame(rows, ent)).collect():
        got.setdefault(r["site_id"], []).append((r["callee"], r["supports"], r["n_candidates"]))
    assert got == {1: [("e1", 2 + 4 + 8, 1)], 2: [("e2", 8, 1)], 4: [("e3", 1 + 8, 1)], 5: [("e4", 16, 1)], 8: sorted(got[8])}
    assert sorted(got[8]) == [("e7", 16, 2), ("e8", 16, 2)]
    callers = spark.createDataFrame([(i, "me") for i in range(1, 11)], "site_id bigint, caller string")
    rel = C.relations(C.resolve_calls(spark.createDataFrame(calls, "site_id bigint, family string, path string, name string, form string, qualified_name string, n_args int"), spark.createDataFrame(rows, ent)), callers).collect()
    assert {(r["callee"], r["confidence"]) for r in rel} == {("e1", "high"), ("e2", "medium"), ("e3", "high"), ("e4", "low"), ("e7", "ambiguous"), ("e8", "ambiguous")}


def test_callers_pages_budgets_cursors(spark):
    calls = spark.createDataFrame([(1, "a.c", "k"), (2, "b.c", "two"), (3, "z.c", "two"), (4, "a.c", None), (5, "a.c", "gone")], "site_id bigint, path string, caller_key string")
    anchors = spark.createDataFrame([("k", "K", "definition", "q.c"), ("two", "T1", "definition", "b.c"), ("two", "T2", "definition", "c.c")], "key string, entity string, role string, path string")
    assert {r[0]: r[1] for r in C.resolve_callers(calls, anchors).collect()} == {1: "K", 2: "T1", 3: None, 4: None, 5: None}
    rel = spark.createDataFrame([("x", i) for i in range(7)], "callee string, n int")
    assert [(r["n"], r["total"]) for r in C.relation_page(rel, "callee", ["n"], 2, 3).orderBy("n").collect()] == [(2, 7), (3, 7), (4, 7)]
    c = spark.createDataFrame([("f", i, "a" if i < 4 else "none") for i in range(6)], "path string, site_id int, name string")
    assert C.expansion_budget(c, spark.createDataFrame([("a", 3)], "name string, cost int"), "path", ["site_id"], 10).count() == 3
    caps = spark.createDataFrame([("a", 1), ("a", 2), ("b", 9), ("c", None)], "root string, size int")
    assert {r[0] for r in C.group_caps(caps, "root", "size", 2, 5).select("root").collect()} == {"a", "c"}
    assert {r[0] for r in FL.capped_roots(caps, 1, 100).select("root").collect()} == {"b", "c"}
    g = [F.lit(x) for x in (10, 3, 7)]
    cur = C.encode_cursor(*g, F.lit("incoming"), F.lit(200))
    assert one(spark, cur, C.decode_cursor(cur, *g, F.lit("incoming")), C.decode_cursor(cur, *g, F.lit("outgoing")), C.decode_cursor(F.lit("a.3.7.i"), *g, F.lit("incoming")), C.decode_cursor(F.lit("a.3.7.i.zz"), *g, F.lit("incoming"))) == ("a.3.7.i.c8", 200, None, None, None)


def test_arity_policy(spark):
    rows = [(1, 1, 1, 1, 2), (1, 2, None, None, 2), (1, 3, 2, 2, 2), (2, 4, 1, 1, 2), (2, 5, None, None, 2), (3, 6, 1, 1, 2), (4, 7, 1, 1, None)]
    df = spark.createDataFrame(rows, "site int, id int, min_arity int, max_arity int, n int").withColumn("variadic", F.lit(False))
    got = {r["id"]: (r["compatibility"], r["outcome"]) for r in C.arity_policy(df, "site", F.col("n")).collect()}
    assert got == {2: ("unknown", "filtered"), 3: ("compatible", "filtered"), 5: ("unknown", "unknown_only"), 6: ("incompatible", "mismatch_fallback"), 7: ("unknown", "not_applied")}


# --- candidate sets ---------------------------------------------------------------------------------------------
def test_candidate_sets(spark):
    cand = "query string, id int, logical_key string, kind string, tier string, fidelity string, role string, guard string, origin_rank int, path string, start_byte int"
    rows = [("q", 1, "k", "function", "reachable", "authoritative", "declaration", None, 0, "a.h", 1), ("q", 2, "k", "function", "reachable", "authoritative", "definition", " ", 0, "a.c", 1), ("q", 3, "k2", "macro", "current", "authoritative", "definition", None, 0, "m.h", 1), ("q", 4, "k", "function", "reachable", "low", "definition", None, 0, "z.c", 1), ("p", 5, None, "type", "global", "low", "unknown", None, 0, "z.c", 1)]
    g = K.grouped(spark.createDataFrame(rows, cand))
    pos = {r["id"]: (r["group_key"], r["position"]) for r in g.collect()}
    assert pos == {2: ("=k", 1), 1: ("=k", 2), 3: ("=k2", 1), 4: ("#4", 1), 5: ("#5", 1)}
    f = K.focus(g, F.lit("call"))
    assert {r["id"] for r in f.where("focused").collect()} == {1, 2, 4, 5}
    disp = {r["query"]: (r["n_groups"], r["n_focused"], r["alternative_count"], r["disposition"]) for r in K.dispositions(f, F.lit(True)).collect()}
    assert disp == {"q": (3, 2, 1, "ambiguous"), "p": (1, 1, 0, "fallback")}
    assert {r["id"] for r in K.navigation(f, False).collect()} == {2, 4, 5} and {r["id"] for r in K.navigation(f, True).collect()} == {1, 4, 5}


def test_merged_evidence(spark):
    rows = [("n", "word", "global", "fallback", 9, 9, 1, 0, "text", None, 1), ("n", "indexed", "current", "exact", 5, 5, 0, 0, "function", "definition", 2), ("n", "indexed", "current", "exact", 5, 5, 0, 0, "function", "declaration", 3), ("o", "word", "global", "fallback", 1, 1, 1, 1, "text", None, 4)]
    df = spark.createDataFrame(rows, "name string, source string, tier string, confidence string, score int, match_score int, proximity int, project int, kind string, role string, seq bigint")
    got = {r["name"]: r for r in K.merged(df).collect()}
    n = got["n"]
    assert (n["source"], n["role"], n["tier"], n["confidence"], n["score"], n["proximity"], n["sources"]) == ("indexed", "declaration", "current", "exact", 9, 1, "indexed,word")


# --- members, versions, events ----------------------------------------------------------------------------------
def test_aliases_and_chains(spark):
    a = spark.createDataFrame([("A", "B"), ("B", "R"), ("C", "D"), ("D", "C"), ("E", "R"), ("E", "B"), ("F", "none"), *[(f"L{i}", f"L{i + 1}") for i in range(20)]], "name string, target string")
    q = spark.createDataFrame([(x,) for x in ("A", "R", "C", "E", "F", "L0", None)], "query string")
    got = {r["query"]: (r["status"], r["record"]) for r in M.resolve_aliases(q, a, spark.createDataFrame([("R",)], "name string")).collect()}
    assert got == {"A": ("unique_record", "R"), "R": ("unique_record", "R"), "C": ("cycle", None), "E": ("ambiguous", None), "F": ("unresolved", None), "L0": ("truncated", None)}
    m = spark.createDataFrame([("R", "x", "S"), ("S", "y", "T"), ("S", "y", "U"), ("S", "z", None)], "owner string, name string, type_name string")
    c = spark.createDataFrame([(1, "R", ["x", "y"]), (2, "R", []), (3, "R", ["nope"])], "chain_id int, record string, names array<string>")
    assert {tuple(r) for r in M.walk_chains(c, m).collect()} == {(1, "T", True), (2, "R", False)}


def test_members(spark):
    m = spark.createDataFrame([("r1", 1, "k", "a"), (None, 1, "k", "b"), (None, 2, "k", "c"), ("r9", 1, "k", "d")], "record_id string, file_id int, record_key string, name string")
    r = spark.createDataFrame([("r1", 1, "k")], "record_id string, file_id int, record_key string")
    assert {x["name"] for x in M.members_of(m, r).collect()} == {"a", "b"}
    f = spark.createDataFrame([("Get", "method", "global", "b"), ("get", "method", "current", "z"), ("GET", "method", "current", "a"), ("x", "field", "global", None)], "name string, kind string, tier string, signature string")
    got = M.fallback_members(f, 1).collect()
    assert [(g["lower_name"], g["freq"], g["signature"], g["truncated"]) for g in got] == [("get", 3, "a", True)]


def test_versions(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    pend = spark.createDataFrame([(2, "B", False), (3, "c", True), (4, "d", None)], "id int, v string, gone boolean")
    assert {tuple(r) for r in V.effective(base, pend, "id", "gone").collect()} == {(1, "a"), (2, "B"), (4, "d")}
    assert {r[0] for r in V.obsolete(base, base.where("id = 1"), base.where("id = 2"), base.limit(0), "id").collect()} == {3}
    assert {r[0] for r in V.missing(base, base.where("id < 3"), "id").collect()} == {3}
    assert {r[1] for r in V.overlaid(base, spark.createDataFrame([(1, "z"), (1, "y")], "id int, v string"), "id").collect()} == {"z", "y", "b", "c"}
    assert {r[0] for r in V.unreferenced(base.select("v"), "v", spark.createDataFrame([("a",), (None,)], "q string")).collect()} == {"b", "c"}


def test_change_events(spark):
    e = spark.createDataFrame([("r", "cairn.json", False, 1), ("r", "x/go.mod", False, 1), ("s", "Makefile", False, 1), ("s", "a.c", False, 1), ("s", "a.c", True, 2), ("s", "a.txt", False, 1), ("r", "b.c", False, 1)], "root string, path string, deleted boolean, at int")
    c = FL.classified_changes(e)
    assert [r["decision"] for r in c.orderBy("root", "path", "at").collect()] == ["upsert", "full", "full", "project", "upsert", "delete", "ignored"]
    assert {tuple(r) for r in FL.coalesced(c, "root", "path", ["at"]).collect()} == {("r", None, "full"), ("s", "a.c", "delete")}


def test_references(spark):
    t = spark.createDataFrame([("a.c", "x = run(1); // 🛠 run\nstruct run *p;\nrun += 2; rerun(); run"), ("b.c", None)], "path string, text string")
    facts = extract.parse_files(t, file_id="path", path="path", text="text", wanted=frozenset(["occurrence"]))
    roles = facts.select("path", "name", F.col("start_line").alias("line"), F.col("start_character").alias("col"), "role")
    got = references.occurrences(t, roles, ["run"], text="text", path="path", limit=10).orderBy("position").collect()
    assert [(r["line"], r["col"], r["role"]) for r in got] == [(0, 4, "call"), (2, 0, "write"), (1, 7, "type_use"), (0, 18, "read"), (2, 19, "read")]


def test_roles_of_references(spark):
    """A prototype is a declaration, a function with a body a definition, whatever stands on the line before; a use in a body is a call."""
    t = spark.createDataFrame([("a.c", "int foo(void);\nstatic int\nfoo(void)\n{ int x = foo(); return foo(); } /* foo() */"), ("b.go", "package b\nfunc foo() { foo() }\n")], "path string, text string")
    facts = extract.parse_files(t, file_id="path", path="path", text="text", wanted=frozenset(["occurrence"]))
    roles = facts.select("path", "name", F.col("start_line").alias("line"), F.col("start_character").alias("col"), "role")
    got = references.occurrences(t, roles, ["foo"], text="text", path="path", limit=10).orderBy("position").collect()
    assert [(r["path"], r["line"], r["role"]) for r in got] == [("a.c", 2, "definition"), ("b.go", 1, "definition"), ("a.c", 0, "declaration"), ("a.c", 3, "call"), ("a.c", 3, "call"), ("b.go", 1, "call"), ("a.c", 3, "read")]


def test_proto_sources(spark):
    h = spark.createDataFrame([("a/x.pb-c.h",), ("gen/Y.PB-C.H",), ("q.h",)], "path string")
    p = spark.createDataFrame([("a/x.proto",), ("z/x.proto",), ("k/y.proto",), ("l/y.proto",)], "path string")
    assert {tuple(r) for r in proto.proto_sources(h, p).collect()} == {("a/x.pb-c.h", "a/x.proto", "relative_path"), ("gen/Y.PB-C.H", "k/y.proto", "same_basename"), ("gen/Y.PB-C.H", "l/y.proto", "same_basename")}


def test_ranges_at_points(spark):
    """Blocks of lines change nothing: every range that holds a point, both ends included."""
    rnd = random.Random(2)
    points = [(i, rnd.choice(["a", "b", None]), rnd.randrange(90), rnd.randrange(4)) for i in range(60)] + [(60, "a", None, 1)]
    ranges = [(i, rnd.choice(["a", "b", None]), (s := rnd.randrange(80), rnd.randrange(4)), (s + rnd.randrange(40), rnd.randrange(4))) for i in range(30)]
    p = spark.createDataFrame(points, "site int, path string, line int, character int")
    pair = "struct<line int, character int>"
    r = spark.createDataFrame(ranges, f"id int, path string, first {pair}, last {pair}")
    got = {(x["site"], x["id"]) for x in C.ranges_at(p, r, ["path"], lines=7).select("site", "id").collect()}
    assert got == {(i, k) for i, a, line, col in points for k, b, s, e in ranges if a is not None and a == b and line is not None and s <= (line, col) <= e}


def test_include_candidates_are_those_of_all_pairs(spark):
    rnd = random.Random(3)
    heads = sorted({"/".join([rnd.choice("pq"), *[rnd.choice("xyz") for _ in range(rnd.randrange(3))], rnd.choice(["a.h", "b.h", "c.h", "d.h"])]) for _ in range(60)})
    sources = ["p/x/m.c", "p/m.c", "q/z/y/m.c", "r/m.c"]
    got = FL.include_candidates(spark.createDataFrame([(s,) for s in sources], "src string"), spark.createDataFrame([(h,) for h in heads], "path string"), 5).collect()
    freq = {h: min(20, sum(x.rsplit("/", 1)[-1] == h.rsplit("/", 1)[-1] for x in heads)) for h in heads}
    for s in sources:
        every = [(-min(49, (35 if s.rsplit("/", 1)[0] == h.rsplit("/", 1)[0] else 0) + freq[h] - min(20, 3 * h.count("/"))), h) for h in heads if h.split("/")[0] == s.split("/")[0]]
        assert [(r["boost"], r["path"]) for r in sorted(got, key=lambda r: r["position"]) if r["src"] == s] == [(-b, h) for b, h in sorted(every)[:5]]


def test_names_by_the_start_of_a_word(spark):
    names = ["reset", "hard_reset", "Aread", "doRead", "x1", "r", "", None, "prere", "re"]
    n, asked = spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame([("re",), ("R",), ("1",), ("abc",), (None,)], "prefix string")
    got = {(r["prefix"], r["name"]) for r in search.by_word_start(n, asked).collect()}
    assert got == {("re", "reset"), ("re", "hard_reset"), ("re", "doRead"), ("re", "re"), ("R", "reset"), ("R", "r"), ("R", "re"), ("R", "doRead"), ("1", "x1")}


def test_dominant_kind(spark):
    rows = [("f", "a", "type", 0), ("f", "a", "type", 0), ("f", "a", "macro", 0), ("f", "b", "type", 0), ("f", "b", "macro", 0), ("f", "c", "type", 0), ("f", "c", "type", 0), ("f", "c", "macro", 1), ("g", "a", "enum_member", 1)]
    got = {(r["current"], r["name"]): r["dominant"] for r in K.dominant_kind(spark.createDataFrame(rows, "current string, name string, label string, own int"), ["current", "name"]).collect()}
    assert got == {("f", "a"): "type", ("f", "b"): None, ("f", "c"): "macro", ("g", "a"): "enum_member"}
