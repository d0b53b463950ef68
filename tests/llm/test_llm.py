"""Problems 5 to 9: brute force, round trips and held-out accuracy, and the edge cases of the docstrings."""

import random

import pytest

from cairn.llm import bpe, derivatives, docpairs, languages, leaks, parsecheck, subjects

C = """#include "a.h"
{doc}
static int
walk_ring(int n, char *p) {{
    if (n > 3) {{ return -1; }}
    return n; /* }} */
}}
"""


@pytest.mark.parametrize(
    ("doc", "found"),
    [
        ("/* Walks the whole ring and counts its slots. */", True),
        ("// Walks the whole ring and counts its slots.\n// NOLINTNEXTLINE(x)", True),
        ("/**\n * @brief Walks the ring of all slots.\n * @param n how many\n */\nEXPORT_API", True),
        ("/** Walks the whole ring and counts slots. */\n[[nodiscard]]", True),
        ("/* Walks the whole ring and counts its slots. */\n", False),
        ("/* Walks the ring. */", False),
        ("/* TODO write down what this one really does */", False),
        ("// TODO write down what\n// this one really does here", False),
        ("/* Copyright (c) 2020 the people of this very tree. */", False),
        ("/* SPDX-License-Identifier: MIT OR Apache-2.0 or others */", False),
        ("// if (n > 3) {\n//     free_all_of_them(n);\n// }", False),
        ("/** @param n\n * @param p\n * @return */", False),
        ("/* walk ring walk ring walk_ring */", False),
        ("int x; // Walks the whole ring and counts its slots.", False),
        ("#define S 3 /* upper bound for all of the entries */", False),
        ("/* coverage:ignore next block of this file */", False),
        ("/* Geht den ganzen Ring ab, zählt alle Plätze. */", True),
        ("", False),
    ],
)
def test_documentation(doc, found):
    for text in (C.format(doc=doc), C.format(doc=doc).replace("\n", "\r\n")):
        got = [d for d in docpairs.extract(text) if d.n_words >= docpairs.LEAST_WORDS]
        assert [d.name for d in got] == (["walk_ring"] if found else [])
        if got:
            assert got[0].end_line - got[0].name_line == 3


def test_documentation_of_go_and_cpp():
    go = 'package a\n\n// Run takes every slot that is left over.\n//go:noinline\nfunc (s *Slot) Run(a int) int {\n\treturn 1\n}\n'
    cpp = "/// Adds the two numbers it is given.\ntemplate <typename T>\nT Vec<T>::add(T a,\n  T b) const noexcept\n{\n  return a + b;\n}\n/* Declared only, defined in another file here. */\nint later(int a);\n"
    assert [(d.name, d.name_line, d.end_line) for d in docpairs.extract(go)] == [("Run", 4, 6)]
    assert [d.name for d in docpairs.extract(cpp)] == ["add"]
    assert docpairs.extract(None) == docpairs.extract("") == []


def test_documented_functions_edges(spark):
    rows = [(1, C.format(doc="// Walks the whole ring and counts slots."), "x"), (2, None, "x"), (3, "", "x"), (1, C.format(doc="// Walks the whole ring and counts slots."), "x"), (None, "int a;", "x"), (4, "// x\n" * 50_000 + "int f(int a) { return 1; }", "x")]
    df = spark.createDataFrame(rows, "rev bigint, text string, name string")
    f = docpairs.documented_functions(df, file_id="rev", text="text")
    assert sorted(r["file_id"] for r in f.collect()) == [1, 1, 4]
    a = spark.createDataFrame([(7, 1, "walk_ring", (3, 0)), (7, 1, "walk_ring", (3, 0)), (8, 1, "walk_ring", (4, 0)), (9, None, None, None)], "id bigint, rev bigint, name string, r struct<start_line int, x int>")
    assert [r[0] for r in docpairs.matched_anchors(f, a, anchor_id="id", file_id="rev", name="name", name_range="r").collect()] == [7]


GOOD_C = '#include <a.h>\n/* =======\n*/\nstruct s { int a : 3; };\nenum e { A = 1, B };\nstatic const int t[] = { [A] = 1, 2 };\nint f(int a) {\n  struct s x = { 1 };\n  for (int i = 0; i < 3; i++) { g("<<<<<<< HEAD"); }\n  switch (a) { case 1: a--; break; default: break; }\n#ifdef X\n  if (a) {\n#else\n  if (!a) {\n#endif\n    a++;\n  }\n  do { a--; } while (a);\nout:\n  return a ? 1 : 2;\n}\n'
GOOD_CPP = 'namespace a::b {\ntemplate <typename T> class V : public W<T> {\npublic:\n  V() : n_{0}, m_(1) {}\n  auto f() const -> int { return R"x(")x"[0]; }\n  enum class E : int { A, B };\nprivate:\n  int n_ = 0;\n};\n}\nextern "C" { int g(void); }\nint main() { auto f = [&](int x) { return x; }; for (auto &x : v) { f(x); } try { h(); } catch (...) { } }\n'
GOOD_GO = 'package a\n\nimport (\n\t"fmt"\n\tx "y"\n)\n\ntype S struct {\n\tn int\n}\n\nconst k = `<<<<<<< HEAD\n`\n\nfunc (s *S) F(a int, b ...string) (int, error) {\n\tx := map[string]int{"a": 1}\n\tfor i := 0; i < 3; i++ {\n\t\tgo func() { x["a"]++ }()\n\t}\n\tif v, ok := x["b"]; ok {\n\t\treturn v, nil\n\t}\n\tswitch a {\n\tcase 1:\n\t\tbreak\n\t}\n\treturn 0, nil // }\n}\n\nfunc g[T any](t T) interface{} { return t }\n'


@pytest.mark.parametrize(("language", "text"), [("c", GOOD_C), ("cpp", GOOD_C), ("cpp", GOOD_CPP), ("go", GOOD_GO)])
def test_whole_and_cut_sources(language, text):
    assert languages.judge(text, language) == ("valid", -1)
    assert languages.judge(text.replace("\n", "\r\n"), language)[0] == "valid"
    assert languages.judge(text.rstrip("\n"), language)[0] == "valid"
    cut = text[: text.rindex("return") + 3]
    assert languages.judge(cut, language)[0] == "truncated"
    lines = text.split("\n")
    at = next(i for i, x in enumerate(lines) if "return" in x)
    conflict = "\n".join([*lines[:at], "<<<<<<< HEAD", lines[at], "=======", lines[at], ">>>>>>> main", *lines[at + 1 :]])
    verdict, offset = languages.judge(conflict, language)
    assert verdict == "conflict" and conflict[offset:].startswith("<<<<<<<")


def test_other_languages():
    md, html, py, sh, yaml = "# Frame\n\nThis page explains.\n\n* One.\n", "<!DOCTYPE html>\n<html></html>\n", "def f(x):\n    for r in x:\n        yield r\n", "#!/bin/sh\nset -eu\n", "a:\n  - b\n"
    for language in ("c", "cpp", "go"):
        assert all(languages.judge(t, language)[0] != "valid" for t in (md, html, py, sh, yaml))
    assert languages.judge(GOOD_GO, "c")[0] != "valid" and languages.judge(GOOD_GO, "cpp")[0] != "valid"
    assert languages.judge(GOOD_CPP, "c")[0] != "valid" and languages.judge(GOOD_CPP, "go")[0] != "valid"
    assert languages.judge_file("a.h", GOOD_CPP)[0] == languages.judge_file("a.H", GOOD_C)[0] == "valid"
    assert languages.judge_file("a.txt", md) == languages.judge_file("a.c", None) == languages.judge_file(None, "x") == (None, -1)
    assert languages.judge_file("a.c", "") == ("valid", -1)


def test_derivatives_against_a_pushdown_automaton():
    """Balanced brackets: the verdicts of the derivatives are those of a counter."""
    g = derivatives.Grammar()
    s = g.ref("s", True)
    g.rule("s", g.alt(g.empty, g.seq(g.tok("("), s, g.tok(")"), s)))
    g.seal()
    rnd = random.Random(2)
    for _ in range(300):
        word = [rnd.choice("()") for _ in range(rnd.randrange(12))]
        depth, want = 0, None
        for i, c in enumerate(word):
            depth += 1 if c == "(" else -1
            if depth < 0:
                want = ("broken", i)
                break
        assert derivatives.run(g, s, word) == (want or ("valid" if depth == 0 else "truncated", len(word)))
    deep = ["("] * 20_000 + [")"] * 20_000
    assert derivatives.run(g, s, deep)[0] == "valid"


def test_verdicts_edges(spark):
    rows = [(1, "a.c", "int f(void) {", "k"), (1, "a.c", "int f(void) {", "k"), (2, "a.c", None, "k"), (3, None, "x", "k"), (None, "a.go", "package a\n", "k"), (4, "b.c", "int a = " + "(" * 3000 + ")" * 3000 + ";", "k")]
    df = spark.createDataFrame(rows, "rev bigint, path string, text string, verdict string")
    got = sorted(((r["file_id"] or 0, r["verdict"]) for r in parsecheck.verdicts(df, file_id="rev", path="path", text="text").collect()), key=str)
    assert got == [(0, "valid"), (1, "truncated"), (1, "truncated"), (2, None), (3, None), (4, "valid")]
    about = spark.createDataFrame([(1, "r"), (2, "r")], "file_id bigint, repo string")
    v = parsecheck.verdicts(df, file_id="rev", path="path", text="text").dropDuplicates(["file_id"])
    assert parsecheck.rates(v, about, ["repo"]).select("n_judged", "n_bad").collect()[0] == (1, 1)


def test_encoding_against_a_library(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(path("byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    rnd = random.Random(1)
    texts = ["", None, " ", "<|endoftext|>", "a" * 20_000, " \n\t  x ", "it's DON'T", "naïve Å 漢字 🛠️ \u200f\x00", "ab" * 5000, *["".join(rnd.choice("abc é漢1_'\n ") for _ in range(60)) for _ in range(60)]]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id bigint, text string, ids array<int>")
    got = {r[0]: r[1] for r in bpe.encode_column(df, doc_id="doc_id", text="text").collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == reference.encode(t or "", add_special_tokens=False).ids
    back = {r[0]: r[1] for r in bpe.decode_column(bpe.encode_column(df, doc_id="doc_id", text="text"), doc_id="doc_id", ids="ids").collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    assert bpe.encode_column(df.limit(0), doc_id="doc_id", text="text").count() == 0


CONFLICT = "<<<<<<< HEAD\nint a(int);\n=======\nint b(int);\n>>>>>>> x\n"


@pytest.mark.parametrize(
    ("text", "verdict"),
    [
        ("/* A. */\n#ifndef A_H\n#define A_H\nint a(int);\n#endif /* A_H */\n", "valid"),
        ("#ifndef A_H\n#define A_H\n" + CONFLICT + "#endif\n", "conflict"),
        ("#if !defined(A_H)\n/* A. */\n#define A_H\n" + CONFLICT + "#endif\n", "conflict"),
        ("#ifndef A_H\r\n#define A_H\r\nint a(int));\r\n#endif\r\n", "broken"),
        ("#ifndef A_H\n#define A_H\nint a(\n#endif\n", "truncated"),
        ("#ifndef A_H\n#define A_H\n#ifdef B\n" + CONFLICT + "#endif\n#endif\n", "valid"),
        ("#ifdef B\n" + CONFLICT + "#else\nint a(int);\n#endif\n", "valid"),
        ("#ifdef B\n" + CONFLICT + "#else\n)\n#endif\nint c;\n", "broken"),
        ("#ifndef B\n#define C\n" + CONFLICT + "#endif\n", "valid"),
        ("#ifndef B\n#define B\n)\n#else\nint b;\n#endif\n", "valid"),
        ("#ifndef B\n#define B 1\n)\n#endif\nint b;\n", "valid"),
        ("<<<<<<< HEAD\n#ifdef B\n=======\n#ifdef C\n>>>>>>> x\nint b;\n#endif\n", "conflict"),
    ],
)
def test_guards_are_no_forks(text, verdict):
    assert languages.judge_file("a.h", text)[0] == verdict


def test_code_of_pairs(spark):
    """From the first line of the head to the end of the body; branches that open the same brace; a body without an end has no code."""
    doc = "/* Walks the whole ring and counts its slots. */\n"
    text = "\n".join([doc + "static int", "first(int a)", "{", "  return a;", "}", "", "#if A", doc + "int second(int a) {", "#else", doc + "int second(long a) {", "#endif", "  if (a) { b(); }", "}", "", doc + "int third(void) { return 3; }", doc + "int lost(void) {", "  x();"])
    for t in (text, text.replace("\n", "\r\n")):
        got = docpairs.extract(t)
        assert [(d.name, d.head_line, d.end_line) for d in got] == [("first", 1, 5), ("second", 9, 15), ("second", 12, 15), ("third", 18, 18), ("lost", 20, None)]
    rows = [(1, "a.c", text), (2, "a.c", None), (3, "a.c", "")]
    out = docpairs.documented_functions(spark.createDataFrame(rows, "id bigint, path string, text string"), file_id="id", path="path", text="text").collect()
    assert [r["code"].split("\n")[0] if r["code"] else None for r in out] == ["static int", "int second(int a) {", "int second(long a) {", "int third(void) { return 3; }", None]


def test_functions_by_indentation_and_end_words():
    python = "\n".join(["# Adds all of the numbers that are there.", "@cache", "def total(a,", "          b):", "    x = 1", "", "    def inner(c):", '        """Gives the very same number back again."""', "        return c", "    return x", "", "class A:", "    async def run(self):", '        """Runs.', "", "        And then it goes on and on.", '        """', "        await x", "y = 2"])
    assert [(d.name, d.head_line, d.end_line, d.n_words >= 5) for d in docpairs.functions_of("a.py", python)] == [("total", 2, 9, True), ("inner", 6, 8, True), ("run", 12, 17, True)]
    ruby = "\n".join(["# Adds all of the numbers that are there.", "def total(a)", "  a.each do |x|", "    puts x if x # end", "    if x", '      puts "end"', "    end", "  end", "end", "def none; end", "def lost", "  x"])
    assert [(d.name, d.end_line, d.n_words >= 5) for d in docpairs.functions_of("a.rb", ruby)] == [("total", 8, True), ("none", 9, False), ("lost", None, False)]
    lua = "\n".join(["-- Adds all of the numbers that are there.", "local function total(a)", "  for i = 1, a do", "    if i then", "      f(function() return 1 end)", "    end", "  end", "end"])
    assert [(d.name, d.end_line, d.n_words >= 5) for d in docpairs.functions_of("a.lua", lua)] == [("total", 7, True)]
    assert docpairs.functions_of("a.py", None) == docpairs.functions_of("a.rb", "") == []


def brute_leaks(docs, items, n):
    grams = lambda t: {tuple(w[i : i + n]) for w in [leaks.words(t)] for i in range(len(w) - n + 1)}
    return {(d, i) for d, x, *_ in docs for i, y, *_ in items if grams(x) & grams(y)}


@pytest.mark.parametrize("most_bits", [1 << 29, 1 << 15])
def test_leaks(spark, monkeypatch, most_bits):
    monkeypatch.setattr(leaks, "MOST_BITS", most_bits)
    monkeypatch.setattr(leaks, "PART_BYTES", 100)
    rnd = random.Random(6)
    text = lambda k: " ".join(rnd.choice(["a", "B", "c_d", "é", "x"]) for _ in range(k))
    items = [(i, text(12), "s") for i in range(12)] + [(50, None, "s"), (51, "", "s"), (52, "a b", "s")]
    items.append((53, items[0][1].upper(), "s"))
    docs = [(i, text(40), "z") for i in range(40)] + [(90, None, "z"), (91, "", "z"), (92, items[3][1].replace(" ", "\n// "), "z"), (92, items[3][1].replace(" ", "\n// "), "z")]
    df, ef = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string"), spark.createDataFrame(items, "item_id bigint, text string, doc_id string")
    got = leaks.leaked_passages(df, ef, doc_id="doc_id", item_id="item_id", least=5).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute_leaks(docs, items, 5)
    assert all(r["covered"] <= r["item_words"] and r["longest"] >= 5 for r in got)
    assert leaks.leaked_passages(df, ef.limit(0), doc_id="doc_id", item_id="item_id", least=5).count() == 0


def brute_tiles(doc, item, least):
    """Greedy string tiling by trying every pair of places."""
    in_doc, in_item, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                k = 0
                while i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k] and i + k not in in_doc and j + k not in in_item:
                    k += 1
                best = max(best, (k, -i, -j))
        if best[0] < least:
            return sorted(out)
        k, i, j = best[0], -best[1], -best[2]
        out.append((i, j, k))
        in_doc.update(range(i, i + k))
        in_item.update(range(j, j + k))


def test_tiles():
    a, b = list(range(1, 21)), list(range(21, 41))
    assert sorted(t[2] for t in leaks.tile(b + [99] + a, a + b, 5)) == [20, 20]
    assert leaks.tile([1] * 9, [1] * 9, 5) == [(0, 0, 9)]
    assert leaks.tile([], [1], 1) == [] == leaks.tile([1, 2], [3], 1)
    rnd = random.Random(1)
    for n in range(60):
        x, y = ([rnd.randrange(3) for _ in range(rnd.randrange(30))] for _ in range(2))
        y = y if n % 3 else y + x[6:] + x[:8]
        assert leaks.tile(x, y, 4) == brute_tiles(x, y, 4)


def test_tiles_of_words_that_repeat_without_end(spark):
    """20,000 equal words on both sides, and words in turn."""
    assert leaks.tile([1] * 21_000, [1] * 20_000, 13) == [(0, 0, 20_000)]
    assert sum(t[2] for t in leaks.tile([1, 2] * 10_000, [1, 1, 2] * 7_000, 2)) == 15_000
    rows = [(1, "row " * 20_000), (2, "row " * 13), (3, "row " * 12)]
    docs, items = spark.createDataFrame(rows, "d bigint, text string"), spark.createDataFrame(rows, "i bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["covered"] for r in leaks.leaked_passages(docs, items, doc_id="d", item_id="i").collect()}
    assert got == {(1, 1): 20_000, (1, 2): 13, (2, 1): 13, (2, 2): 13}


def test_subjects_of_held_out_documents(spark):
    rnd = random.Random(9)
    own = {"law": "court judge plea statute verdict treaty attorney bail".split(), "sport": "league goal coach umpire sprint pitch relay medal".split(), "music": "chord tempo choir score bass organ track scale".split()}
    common = "the module keeps one row and drops whatever is late in the table of the index".split()
    docs, truth, labels = [], {}, []
    for i in range(400):
        about = set(rnd.sample(sorted(own), rnd.choice([0, 1, 1, 2])))
        text = [w for s in about for _ in range(25) for w in (rnd.choice(own[s]), rnd.choice(common), rnd.choice(common))]
        text += [rnd.choice(common) for _ in range(40)] + [rnd.choice(own[rnd.choice(sorted(own))])]
        docs.append((i, " ".join(text), "x"))
        truth[i] = about
        if i % 3 == 0 and about:
            labels += [(i, s.upper() if rnd.random() < 0.5 else f" {s} ", "a") for s in about if rnd.random() < 0.9] or [(i, "music", "b")]
    docs += [(900, None, "x"), (901, "", "x"), (902, "  \n", "x")]
    labels += [(None, "law", "a"), (3, None, "a"), (3, "cooking", "a")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, subject string")
    lf = spark.createDataFrame(labels, "doc_id bigint, subject string, text string")
    af = spark.createDataFrame([("law", "courts"), ("sport", "matches"), ("music", None), (None, "x")], "subject string, description string")
    settings = subjects.Settings(dimensions=1 << 14)
    got = subjects.assigned(subjects.subject_masses(df, lf, af, settings=settings), settings).collect()
    found = {(r["doc_id"], r["subject"]) for r in got}
    held = {(i, s) for i in truth for s in truth[i] if i % 3}
    mine = {x for x in found if x[0] % 3}
    assert len(held & mine) / len(held) > 0.95 and len(held & mine) / len(mine) > 0.95
    assert subjects.subject_masses(df.limit(0), lf, af, settings=settings).count() == 0
    assert subjects.subject_masses(df, lf, af.limit(0), settings=settings).count() == 0
    assert subjects.subject_masses(df.limit(5), lf.limit(0), af, settings=settings).columns == ["doc_id", "subject", "mass", "share"]


def test_a_mass_of_seven_terms_is_enough(spark):
    rows = [(1, "law", 7.0, 0.5), (2, "law", 7.9, 0.1), (3, "law", 6.9, 0.5), (4, "law", 9.0, 0.09)]
    masses = spark.createDataFrame(rows, "doc_id bigint, subject string, mass double, share double")
    assert sorted(r["doc_id"] for r in subjects.assigned(masses).collect()) == [1, 2]


def test_subject_on_a_third_of_the_documents(spark):
    own = {"law": "court judge plea statute verdict treaty attorney bail".split(), "sport": "league goal coach umpire sprint pitch relay medal".split(), "music": "chord tempo choir score bass organ track scale".split(), "food": "bread stew oven spice broth butter dough onion".split()}
    common = "the module keeps one row and drops whatever is late in the table of the index".split()
    docs, truth, labels = [], {}, []
    for i in range(360):
        about = "law" if i % 3 == 0 else ("sport", "music", "food", None)[i % 4]
        docs.append((i, " ".join([*own.get(about, []), *own.get(about, []), *common * 3])))
        truth[i] = about
        if about and i % 5 < 2:
            labels.append((i, about))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    lf = spark.createDataFrame(labels, "doc_id bigint, subject string")
    af = spark.createDataFrame([(s, None) for s in own], "subject string, description string")
    settings = subjects.Settings(dimensions=1 << 14)
    found = {(r["doc_id"], r["subject"]) for r in subjects.assigned(subjects.subject_masses(df, lf, af, settings=settings), settings).collect()}
    assert found == {(i, s) for i, s in truth.items() if s}
