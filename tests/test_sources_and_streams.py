"""Lexer, fact extraction, cursor functions, scans, generations and streams."""

import json

import pyarrow as pa
import pytest

from cairn.functions import cursor as U
from cairn.functions import paths as P
from cairn.sources import extract as X
from cairn.sources import scan
from cairn.sources.lexer import Places, masked, tokens
from cairn.streaming import generations as G

C_TEXT = """#ifndef MINI_H
#define MINI_H
#include "mini.h" // own
#define LIMIT 3
#define MAX(a, b) ((a) > (b) ? (a) : (b))
typedef struct { int x, *y; } point_t;
struct node { struct node *next; int n : 3; };
enum color { RED, GREEN = 2 };
typedef int (*handler_t)(void *ctx);
extern int shared;
static const int table[] = { 1, 2 };
int tentative;
EXPORT_API
static inline int add(int a, const char *b)
{
    int total = a, other;
    for (int i = 0; i < 3; i++) { total += twice(i, b[0]); }
    (*hook)(total); p->run(1); obj.go(); (plain)(2);
retry:
    if (total) goto retry;
#ifdef WIDE
    if (a) {
#else
    if (!a) {
#endif
        other = 0;
    }
    return total;
}
int no_body(void);
int old_style();
int many(const char *fmt, ...);
#endif
"""

CPP_TEXT = """namespace a { namespace b {
template <typename T> class Box : public Base<T> {
public:
  explicit Box(int n) : n_(n) {}
  T get() const noexcept { return helper::read(n_); }
  virtual void draw(int w, int h = 2) = 0;
private:
  int n_ = 0;
};
using Index = unsigned long;
void Box<int>::put(int v) { new Thing(v); }
static int hidden(void) { return 1; }
} }
extern "C" { int plain(int a); }
"""

GO_TEXT = """package sensor

import (
\tfmtx "fmt"
\t"ex.com/mini/part"
)

type Slot struct {
\tn int
\tname, other string
}

type Reader interface {
\tRead(p []byte) (int, error)
}

type ID = int

const (
\tA = iota
\tB
)

// Run runs.
func (s *Slot) Run(a, b int, rest ...string) (out map[string]int, err error) {
\tx, y := part.Make(a), 2
\tvar z int
\tgo func() { s.Stop(x, y) }()
\treturn nil, nil
}

func Map[T any](t T) T { return t }
"""


def of(facts, kind):
    return [f for f in facts if f.fact == kind]


def test_c_facts():
    f = X.facts_of("a/mini.c", C_TEXT)
    assert [x.name for x in of(f, "include")] == ['"mini.h"']
    decl = {(x.name, x.kind, x.role) for x in of(f, "declaration")}
    assert {("LIMIT", "macro", "definition"), ("MAX", "macro", "definition"), ("point_t", "type", "definition"), ("node", "type", "definition"), ("color", "type", "definition"), ("RED", "enum_constant", "definition"), ("GREEN", "enum_constant", "definition"), ("handler_t", "alias", "definition"), ("shared", "object", "declaration"), ("table", "object", "definition"), ("tentative", "object", "tentative"), ("add", "function", "definition"), ("no_body", "function", "declaration")} <= decl
    assert ("MINI_H", "macro", "definition") not in decl
    add = next(x for x in of(f, "callable") if x.name == "add")
    assert (add.signature, add.linkage_kind, add.min_arity, add.max_arity, add.canonical_signature) == ("add(_, _)", "internal", 2, 2, "static inline int add(int a, const char *b)")
    assert C_TEXT.split("\n")[add.body_end_line] == "}"
    by = {x.name: x for x in of(f, "callable")}
    assert (by["no_body"].min_arity, by["no_body"].max_arity) == (0, 0) and (by["old_style"].min_arity, by["old_style"].max_arity) == (None, None)
    assert (by["many"].min_arity, by["many"].max_arity, by["many"].variadic) == (1, None, True)
    calls = {(x.name, x.form, x.n_args) for x in of(f, "call")}
    assert {("twice", "direct_name", 2), (None, "function_pointer", 1), ("run", "member_arrow", 1), ("go", "member_dot", 0), ("plain", "parenthesized_name", 1)} <= calls
    assert {(x.name, x.kind) for x in of(f, "local")} >= {("a", "parameter"), ("b", "parameter"), ("total", "variable")}
    assert {(x.owner, x.name) for x in of(f, "member")} >= {("node", "next"), ("node", "n"), ("point_t", "x"), ("point_t", "y")} or {("node", "next"), ("node", "n")} <= {(x.owner, x.name) for x in of(f, "member")}
    assert X.labels(C_TEXT) == [("retry", C_TEXT.split("\n").index("retry:"), "add")]


def test_cpp_facts():
    f = X.facts_of("b.cpp", CPP_TEXT)
    by = {x.name: x for x in of(f, "callable")}
    assert by["get"].owner == "Box" and by["get"].role == "definition" and by["draw"].role == "declaration" and (by["draw"].min_arity, by["draw"].max_arity) == (1, 2)
    assert by["put"].qualified_name == "Box::put" and by["hidden"].linkage_kind == "internal" and by["plain"].role == "declaration"
    assert ("Index", "alias") in {(x.name, x.kind) for x in of(f, "declaration")}
    calls = {(x.name, x.form, x.qualified_name) for x in of(f, "call")}
    assert ("read", "qualified_name", "helper::read") in calls and ("Thing", "explicit_construction", None) in calls
    assert ("Box", "n_") in {(x.owner, x.name) for x in of(f, "member")}


def test_go_facts():
    f = X.facts_of("s/sensor.go", GO_TEXT)
    assert [x.name for x in of(f, "package")] == ["sensor"]
    assert [(x.name, x.detail) for x in of(f, "import")] == [("fmt", "fmtx"), ("ex.com/mini/part", None)]
    by = {x.name: x for x in of(f, "callable")}
    assert (by["Run"].qualified_name, by["Run"].owner, by["Run"].max_arity, by["Run"].min_arity) == ("Slot.Run", "Slot", None, 2) and by["Map"].role == "definition"
    assert {(x.name, x.kind) for x in of(f, "declaration")} >= {("Slot", "type"), ("Reader", "type"), ("ID", "alias"), ("A", "object"), ("B", "object"), ("Run", "method"), ("Map", "function")}
    assert {(x.owner, x.name, x.kind) for x in of(f, "member")} >= {("Slot", "n", "field"), ("Reader", "Read", "method"), ("Slot", "Run", "method")}
    assert {(x.name, x.form) for x in of(f, "call")} >= {("Make", "qualified_name"), ("Stop", "qualified_name")}
    assert {x.name for x in of(f, "local") if x.kind == "variable"} == {"x", "y", "z"}


def test_extraction_of_odd_texts(spark):
    assert X.facts_of("a.c", None) == X.facts_of(None, "x") == X.facts_of("a.c", "") == []
    assert [x.name for x in X.facts_of("a.c", "just words ?? here")] == ["just", "words", "here"]
    for text in ("{" * 2000, "}" * 2000, "(" * 2000, "int f(", "struct {", "#define", "/* open", '"open', "template <", "namespace", "a" * 100_000, "x = {{{ ;;; )))", "\x00﻿"):
        for path in ("a.c", "a.cpp", "a.go"):
            X.facts_of(path, text)
    rows = [(1, "a.c", "int f(void) { return g(1); }", "clash"), (1, "a.c", "int f(void) { return g(1); }", "clash"), (2, "b.go", None, "c"), (None, "c.c", "int x;", "c")]
    df = spark.createDataFrame(rows, "rev bigint, path string, text string, name string")
    got = X.parse_files(df, file_id="rev", path="path", text="text", wanted=frozenset({"callable", "call"}))
    assert sorted((r["fact"], r["name"]) for r in got.collect()) == [("call", "g"), ("call", "g"), ("callable", "f"), ("callable", "f")]
    assert X.parse_files(df.limit(0), file_id="rev", path="path", text="text").count() == 0


def test_lexer_places():
    text = 'a /* é */ "x\\"y" 🛠 b // c\nd'
    assert [t.text for t in tokens(text, False) if t.kind == "id"] == ["a", "b", "d"]
    p = Places(text)
    at = text.index("b //")
    assert p.byte(at) == len(text[:at].encode()) and p.line_col(at) == (0, at + 1) and p.line_col(text.index("d", at)) == (1, 0)
    assert masked("x /* y */ 'z'", False) == "x             " [: len("x /* y */ 'z'")]


def test_occurrence_roles():
    roles = {(f.name, f.role) for f in X.occurrences("struct node n; x = call(y); z++; T v = w;", False)}
    assert {("node", "type_use"), ("x", "write"), ("call", "call"), ("y", "read"), ("z", "write"), ("T", "type_use"), ("w", "read")} <= roles
    assert ("F", "definition") in {(f.name, f.role) for f in X.occurrences("func F() { G() }", True)}


def test_proto_and_recovery():
    text = 'syntax = "proto3";\npackage p.q;\n// message No {\nmessage A {\n  int32 n = 1;\n  enum E { X = 0; }\n  message B { string s = 2; }\n}\nservice S { rpc Get (A) returns (A); }\n'
    got = {(k, n, f) for k, n, f, _ in X.proto_declarations(text)}
    assert {("package", "p.q", "p.q"), ("message", "A", "p.q.A"), ("field", "n", "p.q.A.n"), ("enum", "E", "p.q.A.E"), ("enum_value", "X", "p.q.A.E.X"), ("message", "B", "p.q.A.B"), ("service", "S", "p.q.S")} <= got
    assert X.proto_declarations(None) == [] and X.proto_declarations(text, most_tokens=3) == []
    src = "int __attribute__((aligned(4))) x; MY_API int f(void);"
    assert len(X.recovery_source(src)) == len(src) and "aligned" not in X.recovery_source(src) and "int f(void)" in X.recovery_source(src)


@pytest.mark.parametrize(
    ("line", "column", "word", "prefix"),
    [("foo(bar)", 1, "foo", "f"), ("foo(bar)", 3, "foo", "foo"), ("foo(bar)", 4, "bar", None), ("a 12x", 4, None, None), ("", 0, None, None), ("🛠 ab", 3, "ab", None), ("🛠 ab", 4, "ab", "a"), ("+ +", 1, None, None)],
)
def test_words(line, column, word, prefix):
    assert U.word_at(line, column) == word and U.prefix_at(line, column) == prefix


def test_cursor_functions():
    assert U.member_chain_at("x = a.b[i + f(1)]->c.pre", 24) == ("a", ["b", "c"])
    assert U.member_chain_at("(*p).x.", 7) == ("p", ["x"]) and U.member_chain_at("f(1).", 5) is None and U.member_chain_at("plain", 5) is None
    assert U.completion_intent("#if FO", 6) == ("macro_preprocessor", "high") and U.completion_intent("  fo(1)", 4) == ("call_target", "high")
    assert U.completion_intent("struct no", 9) == ("type_name", "high") and U.completion_intent("return re", 9) == ("expression_value", "medium")
    assert U.completion_intent("int va", 6) == ("declaration_name", "medium") and U.completion_intent("int *va", 7) == ("declaration_name", "medium") and U.completion_intent("  x", 3)[0] == "neutral"
    assert U.call_at('f(a, g(1, ")"), ', 16) == ("f", 2) and U.call_at("f(a, g(1, 2", 11) == ("g", 1) and U.call_at("if (a, ", 7) is None
    s = "int f(int (*cb)(int, int), std::map<int, int> m, ...)"
    assert [s[a:b] for a, b in U.parameter_spans(s)] == ["int (*cb)(int, int)", "std::map<int, int> m", "..."] and U.parameter_spans("x") == [] and U.parameter_spans("f( )") == []
    assert U.byte_offset_at("é\n🛠x\n", 1, 2) == 3 + 4 and U.byte_offset_at("ab", 5, 0) == 2
    md = U.comment_markdown(U.comment_lines("/**\n * @brief Adds.\n *\n * @param a one\n * @return sum\n */\nint f;", 6))
    assert md == "Adds.\n\n**Parameters**\n- `a`: one\n\n**Returns** sum"
    assert U.comment_markdown([]) is None and U.comment_lines("// x\n\nint f;", 2) == []
    assert U.build_guard("a/x_linux_amd64.go", "//go:build a || b\n\npackage x") == "(a || b) && linux && amd64" and U.build_guard("x.go", "package x\n//go:build no") is None
    assert U.source_excerpt("a\nb\nc", 1, 9) == "b\nc" and U.source_excerpt(None, 0, 1) is None


def test_apply_to_columns(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "id int, t string")
    got = U.apply(df, ["t"], lambda t: [(c,) for c in t or ""], "c string", pa.schema([("c", pa.string())]), ["id"])
    assert [tuple(r) for r in got.collect()] == [(1, "a"), (1, "b")]


def test_config():
    c, issues = scan.load_config(json.dumps({"include": ["/Src/"], "extensions": [".C", "h"], "exclude": 3, "language_overrides": [{"glob": "*.h", "language": "cpp"}, {"glob": 1}], "extra": 1}))
    assert c.include == ["Src"] and c.extensions == ["c", "h"] and c.exclude == [] and c.language_overrides == [("*.h", "cpp")] and len(issues) == 3
    assert scan.load_config("{")[1] and scan.load_config("[]")[1] == ["not an object"] and scan.load_config(None) == (scan.WorkspaceConfig(), [])


def test_scan_of_a_tree(spark, tmp_path):
    for p, text in {"src/a.c": "int a;", "src/B.HPP": "x", "target/c.c": "x", "note.txt": "x", "go.mod": 'module "ex.com/m"\n', "big.go": "package x\n" * 10}.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(text)
    got = {r["path"]: (r["size"], r["language"]) for r in scan.discover(spark, str(tmp_path)).collect()}
    assert got == {"src/a.c": (6, "c"), "src/B.HPP": (1, "cpp"), "big.go": (100, "go")}
    (tmp_path / "src/a.proto").write_text("package p;\n" * 10)
    (tmp_path / "src/b.proto").write_text("package p;\n")
    config = scan.WorkspaceConfig(extensions=["c", "go", "proto"])
    texts = {r["path"]: r["text"] for r in scan.read_texts(spark, str(tmp_path), config, most_proto_bytes=50).collect()}
    assert texts == {"src/a.c": "int a;", "big.go": "package x\n" * 10, "src/a.proto": None, "src/b.proto": "package p;\n"}  # only protocol definitions have a limit
    (tmp_path / "log.json").write_text("\n".join(json.dumps({"candidate": f"c{i}", "kind": "k", "accepted_at": i}) for i in range(9)))
    assert [r["candidate"] for r in scan.history(spark, str(tmp_path / "log.json"), 2).collect()] == ["c8", "c7"]
    df = spark.createDataFrame([("module ex.com/m\n", "use (\n\t./a\n\t./b/c\n)\nuse ./d\n")], "m string, w string")
    r = df.select(scan.module_path(df["m"]), scan.work_dirs(df["w"])).collect()[0]
    assert r[0] == "ex.com/m" and sorted(r[1]) == ["a", "b/c", "d"]


def test_generations(spark, tmp_path):
    store = G.GenerationStore(spark, str(tmp_path / "g"))
    assert store.current() is None and store.read() is None
    a = spark.createDataFrame([(1, 1, "a", False), (2, 1, "b", False)], "id int, at int, v string, gone boolean")
    store.merge(a, "id", ["at"], "gone")
    (tmp_path / "g/data/gen=2").mkdir()  # what a writer left that died
    store.merge(spark.createDataFrame([(2, 2, "b", True), (3, 1, "c", False), (1, 0, "old", False)], a.schema), "id", ["at"], "gone")
    assert store.generations() == [1, 2] and {(r["id"], r["v"]) for r in store.read().collect()} == {(1, "a"), (3, "c")}
    rows, changed = store.read_pinned(lambda df: (store.publish(df), df.count())[1])
    assert rows == 2 and changed
    assert store.collect(1, leased=[1]) == [2] and store.generations() == [1, 3]


def test_stream_into_generations_survives_a_repeated_batch(spark, tmp_path):
    src = tmp_path / "in"
    schema = "id int, at int, v string, gone boolean"
    store = G.GenerationStore(spark, str(tmp_path / "g"))
    for n, rows in enumerate([[(1, 1, "a", False), (2, 1, "b", False)], [(1, 2, "A", False), (2, 3, "b", True)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        store.maintain(spark.readStream.schema(schema).parquet(str(src)), "id", ["at"], "gone", str(tmp_path / "cp")).awaitTermination()
        assert store.current() == n + 1
    assert [(r["id"], r["v"]) for r in store.read().collect()] == [(1, "A")]
    (tmp_path / "cp/commits/1").unlink()  # the query ended before it noted that the batch was done
    for x in (tmp_path / "cp/commits").glob(".1*"):
        x.unlink()
    store.maintain(spark.readStream.schema(schema).parquet(str(src)), "id", ["at"], "gone", str(tmp_path / "cp")).awaitTermination()
    assert store.current() == 2


def test_segments(spark, tmp_path):
    s = G.SegmentStore(spark, str(tmp_path / "s"))
    rows = lambda *x: spark.createDataFrame(list(x), "path string, name string")
    s.append(rows(("a", "1"), ("a", "2"), ("b", "3"), ("c", "4"), ("d", "5")), "path")
    s.append(rows(("a", "9")), "path", rows(("b", "")).select("path"))
    assert {(r["path"], r["name"]) for r in s.read("path").collect()} == {("a", "9"), ("c", "4"), ("d", "5")} and not s.needs_compaction()
    s.append(rows(("c", "8"), ("d", "7")), "path")
    assert s.needs_compaction()
    s.compact("path")
    assert {(r["path"], r["name"]) for r in s.read("path").collect()} == {("a", "9"), ("c", "8"), ("d", "7")} and len(s.store.generations()) == 1


def test_ignore_files_of_a_tree(spark, tmp_path):
    """Rules at any depth and anchored ones, directories only, exceptions, and what is below an ignored directory."""
    texts = {
        ".gitignore": "# all of these\ngen/\n*.tmp.c\n/top.c\ndocs/**/x.c\n!keep.tmp.c\n\\!odd.c\n[ab]?.h\n", "sub/.gitignore": "/only.c\n!*.tmp.c\n*.go\n",
        "top.c": "", "sub/top.c": "", "a.tmp.c": "", "keep.tmp.c": "", "sub/a.tmp.c": "", "gen/a.c": "", "sub/gen/keep.tmp.c": "", "docs/x.c": "", "docs/p/q/x.c": "", "!odd.c": "", "sub/only.c": "", "sub/deep/only.c": "", "sub/m.go": "", "m.go": "", "a1.h": "", "c1.h": "",
    }
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text or "x")
    want = {"sub/top.c", "keep.tmp.c", "sub/a.tmp.c", "sub/deep/only.c", "m.go", "c1.h"}
    assert {r["path"] for r in scan.discover(spark, str(tmp_path)).collect()} == want
    assert {r["path"] for r in scan.read_texts(spark, str(tmp_path)).collect()} == want
    assert P.ignore_rules([("", "")]) == []


def test_functions_behind_the_remains_of_a_merge():
    text = "int a(int x) {\n<<<<<<< ours\n  if (x) {\n=======\n  if (!x) {\n>>>>>>> theirs\n    b();\n  }\n}\nint c(void) { return 1; }\n"
    assert [(f.name, f.role, f.body_end_line) for f in X.facts_of("a.c", text) if f.fact == "callable"] == [("a", "definition", 8), ("c", "definition", 9)]
