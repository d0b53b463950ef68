"""Token classes and grammars of C, C++ and Go for :mod:`cairn.llm.derivatives`.

The grammars hold declarations, statements, blocks, groups and initialisers, and expressions as operands and operators in
turn: what may follow a name, two names, a number, a literal, an operator or a group. Within brackets, where macros and types
are written as well, only numbers and the words beside them are held to that. That tells a whole file of the language from a cut
one, from one with the remains of a merge and from one in another language, and finds the token at which a statement fails.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

from cairn.llm.derivatives import Grammar, Node, run

# Keywords and extensions of the languages.
CONTROL = ("if", "else", "for", "while", "do", "switch", "case", "default")
TAGS = ("struct", "union", "enum")
NOT_IN_LISTS = ("return", "goto", "break", "continue", "typedef", "static", "extern")
PREFIX_WORDS = ("sizeof", "new", "const", "unsigned", "signed", "volatile", "not", "delete", "alignof", "typename", "co_await", "throw", "co_return", "co_yield", "operator", "template", "requires", "compl")
OPERATOR_WORDS = ("and", "or", "xor", "bitand", "bitor", "not_eq", "and_eq", "or_eq", "xor_eq")
GO_TOP = ("import", "const", "var", "type", "func")
GO_HEADERS = ("if", "for", "switch", "select")
GO_OTHER = ("go", "defer", "return", "goto", "break", "continue", "fallthrough", "range", "map", "chan")
CONDITIONALS = {"if": "#if", "ifdef": "#if", "ifndef": "#if", "elif": "#elif", "elifdef": "#elif", "elifndef": "#elif", "else": "#else", "endif": "#endif"}
DIRECTIVES = ("include", "define", "undef", "pragma", "error", "warning", "line", "import", "include_next", "ident", "embed", "assert", "sccs")
LANGUAGES = {
    "c": ("c",), "h": ("c", "cpp"), "cc": ("cpp",), "cpp": ("cpp",), "cxx": ("cpp",), "c++": ("cpp",), "hh": ("cpp",), "hpp": ("cpp",), "hxx": ("cpp",),
    "inl": ("cpp",), "ipp": ("cpp",), "tcc": ("cpp",), "go": ("go",),
}

#: A conflict marker of a merge stands at the start of a line; seven characters, then a label or nothing.
_MARKER = r"(?P<marker>^(?:<{7}|>{7}|\|{7})(?:[ \t][^\r\n]*)?\r?$|^={7}\r?$)"
_C_TOKENS = re.compile(
    _MARKER
    + r"""|(?P<space>[ \t\r\n\f\v﻿]+|\\\r?\n)
|(?P<comment>//(?:[^\n\\]|\\\r?\n|\\.)*|/\*.*?\*/)
|(?P<cut>/\*.*\Z)
|(?P<dir>^[ \t]*\#(?:[^\n\\/]|\\\r?\n|\\.|/\*.*?\*/|/(?!\*))*)
|(?P<raw>(?:u8|[uUL])?R"(?P<tag>[^ ()\\\t\n]{0,16})\(.*?\)(?P=tag)")
|(?P<str>(?:u8|[uUL])?"(?:[^"\\\n]|\\.|\\\r?\n)*"|(?:u8|[uUL])?'(?:[^'\\\n]|\\.)+')
|(?P<num>\.?[0-9](?:[eEpP][+-]|'(?=[0-9A-Za-z])|[0-9A-Za-z_.])*)
|(?P<id>[^\W\d]\w*)
|(?P<punct>::|:=|->\*?|\.\.\.|\.\*|<<=|>>=|<=>|\+\+|--|&&|\|\||<<|>>|[-+*/%&|^=!<>]=|[(){}\[\];=,:<>!%&*+\-./^|~?])
|(?P<open>["'])|(?P<bad>.)""",
    re.S | re.M | re.X,
)
_GO_TOKENS = re.compile(
    _MARKER
    + r"""|(?P<nl>\n)
|(?P<space>[ \t\r﻿]+)
|(?P<line>//[^\n]*)
|(?P<comment>/\*.*?\*/)
|(?P<cut>/\*.*\Z|`[^`]*\Z)
|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)+'|`[^`]*`)
|(?P<num>\.?[0-9](?:[eEpP][+-]|[0-9A-Za-z_.])*)
|(?P<id>[^\W\d]\w*)
|(?P<punct>:=|\+\+|--|<-|\.\.\.|&&|\|\||<<=?|>>=?|&\^=?|[-+*/%&|^=!<>]=|[(){}\[\];=,:<>!%&*+\-./^|~])
|(?P<open>["'`])|(?P<bad>.)""",
    re.S | re.M | re.X,
)
_DIRECTIVE = re.compile(r"[ \t]*#[ \t]*([A-Za-z_]\w*|\d+|$)?")
#: The start of an include guard: ``#ifndef X`` or ``#if !defined(X)``, then, after nothing but space and comments, ``#define X``.
_GUARD = re.compile(
    r"""[ \t]*\#[ \t]*(?:ifndef[ \t]+|if[ \t]*![ \t]*defined(?:[ \t]*\([ \t]*|[ \t]+))(?P<name>[^\W\d]\w*)[ \t]*\)?(?:\s|//[^\n]*|/\*.*?\*/)*\n(?:\s|//[^\n]*|/\*.*?\*/)*\#[ \t]*define[ \t]+(?P=name)\b""",
    re.S,
)
_CLASS_OF_WORD = {**{w: w for w in CONTROL}, **{w: "tag" for w in TAGS}, **{w: "stmtword" for w in NOT_IN_LISTS}, **{w: "prefix" for w in PREFIX_WORDS}, **{w: "bin" for w in OPERATOR_WORDS}}
# Classes of operators: sign (before or between operands), star (also a part of types), un and tilde (before one), inc (on either side), angle
# (also a bracket of types), mem (before a member), dots, and bin for the others.
_C_PUNCT = {
    **{p: p for p in ("{", "}", "(", ")", "[", "]", ";", "=", ",", ":", "::", ":=")}, "#": "bad", "+": "sign", "-": "sign", "*": "star", "&": "star", "&&": "star", "!": "un", "~": "tilde", "++": "inc", "--": "inc",
    "<": "angle", ">": "angle", ">>": "angle", ".": "mem", "->": "mem", "->*": "mem", ".*": "mem", "...": "dots",
}
_GO_WORDS = {**{w: w for w in ("package", "else", *GO_TOP)}, **{w: "header" for w in GO_HEADERS}, "case": "case", "default": "case", "struct": "struct", "interface": "struct", **{w: "kw" for w in GO_OTHER}}
_GO_PUNCT = {**{p: p for p in ("{", "}", "(", ")", "[", "]", ";", "=", ",", ".", ":")}, ":=": "=", "++": "inc", "--": "inc", "...": "dots", **{p: "un" for p in ("+", "-", "*", "&", "!", "^", "<-", "~")}}
#: Words of Go after which a line break ends no statement.
_GO_OPEN = frozenset(w for w in _GO_WORDS if w not in ("break", "continue", "fallthrough", "return"))


def c_classes(text: str) -> Iterator[tuple[str, int]]:
    """Token classes of C or C++ with their offsets."""
    for m in _C_TOKENS.finditer(text):
        kind = m.lastgroup
        if kind in ("space", "comment"):
            continue
        at = m.start()
        if kind == "id":
            yield _CLASS_OF_WORD.get(m[0], "id"), at
        elif kind == "punct":
            yield _C_PUNCT.get(m[0], "bin"), at
        elif kind in ("str", "raw", "tag"):
            yield "str", at
        elif kind == "dir":
            word = _DIRECTIVE.match(m[0])[1]
            if word in CONDITIONALS:
                yield CONDITIONALS[word], at
            elif word and word not in DIRECTIVES and not word.isdigit():
                yield "bad", at
            elif m[0].lstrip().startswith("#!"):
                yield "bad", at
        elif kind == "open":
            # A literal without its end: at the last line the text may break off here.
            yield ("cut" if text.find("\n", at) in (-1, len(text) - 1) else "bad"), at
        else:
            yield kind, at


def go_classes(text: str) -> Iterator[tuple[str, int]]:
    """Token classes of Go with their offsets; ends of statements by line breaks are made explicit."""
    ends = False
    at = 0
    for m in _GO_TOKENS.finditer(text):
        kind, at = m.lastgroup, m.start()
        if kind in ("space", "line"):
            continue
        if kind == "nl" or kind == "comment":
            if ends and (kind == "nl" or "\n" in m[0]):
                yield ";", at
                ends = False
            continue
        if kind == "id":
            word = m[0]
            ends = word not in _GO_OPEN
            yield _GO_WORDS.get(word, "id"), at
        elif kind == "punct":
            p = m[0]
            ends = p in (")", "]", "}", "++", "--")
            yield _GO_PUNCT.get(p, "bin"), at
        elif kind in ("str", "num"):
            ends = True
            yield kind, at
        elif kind == "open":
            yield ("cut" if text.find("\n", at) in (-1, len(text) - 1) else "bad"), at
        else:
            yield kind, at
    if ends:
        yield ";", len(text)


def _common(g: Grammar, words: tuple[str, ...]) -> tuple[Node, Node, Node]:
    """Groups in brackets: anything between, as long as the brackets pair and no number stands beside a word or another number."""
    t = g.tok
    inner, number, word = g.ref("inner", True), g.ref("number", True), g.ref("word", True)
    paren, square, loose = g.seq(t("("), inner, t(")")), g.seq(t("["), inner, t("]")), g.seq(t("{"), inner, t("}"))
    other = tuple(w for w in words if w not in ("id", "num", "str"))
    rest = g.seq(g.alt(t(*other), square, loose), inner)
    g.rule("inner", g.alt(g.empty, rest, g.seq(t("str"), inner), g.seq(paren, inner), g.seq(t("num"), number), g.seq(t("id"), word)))
    g.rule("number", g.alt(g.empty, rest))
    g.rule("word", g.alt(g.empty, rest, g.seq(t("str"), inner), g.seq(paren, inner), g.seq(t("id"), word)))
    return paren, square, loose


@cache
def c_family(cpp: bool) -> tuple[Grammar, Node]:
    """Grammar of C or C++."""
    g = Grammar()
    t = g.tok
    only = lambda *names: names if cpp else ()
    operators = ("bin", "sign", "star", "un", "tilde", "inc", "angle", "mem", "dots")
    words = ("prefix", "stmtword", "tag")
    paren, square, _ = _common(g, ("id", "num", "str", *words, *operators, ",", ":", *only("::"), *CONTROL, ";", "="))
    stmts, stmt, init = g.ref("stmts", True), g.ref("stmt"), g.ref("init")
    block = g.seq(t("{"), stmts, t("}"))
    g.rule("stmts", g.alt(g.empty, g.seq(stmt, stmts)))

    # Initialiser and enumerator lists: no two names beside each other, no statements.
    first, value, done = g.ref("first"), g.ref("value"), g.ref("listed")
    group = g.alt(paren, square, init, *([block] if cpp else []))
    begun = g.alt(g.seq(t("id", "num"), g.ref("listed_name")), g.seq(g.alt(t("str"), group), done), g.seq(t("sign", "star", "un", "tilde", "inc", "mem", "prefix", "tag", *only("::")), value))
    on = g.alt(t("}"), g.seq(t(","), first), g.seq(t("bin", "sign", "star", "mem", "=", ":", *only("::"), *(() if cpp else ("angle",))), value), g.seq(t("inc", "dots"), done), g.seq(g.alt(t("str"), group), done), *([g.seq(t("angle"), g.ref("listed_type"))] if cpp else []))
    g.rule("init", g.seq(t("{"), first))
    g.rule("first", g.alt(t("}"), begun))
    g.rule("value", begun if not cpp else g.alt(begun, g.seq(t("angle"), g.ref("listed_type"))))
    g.rule("listed_name", on)
    g.rule("listed", g.alt(on, begun))
    if cpp:
        g.rule("listed_type", g.alt(on, begun))

    # Simple statements and declarations, up to a semicolon or, where one may end it, a block. The states are what was read last.
    name, names, number, text, operator, star, word, tag, closed, assigned = (g.ref(n) for n in ("name", "names", "numeral", "text", "operator", "star", "after_word", "after_tag", "closed", "assigned"))
    if cpp:
        body = g.alt(g.seq(g.alt(block, init), closed), block)
    else:
        body = g.none  # in C only after a group, an equals sign or a tag
    to_word = g.alt(g.seq(t("prefix", "stmtword", "dots", ":", *only("::", "angle")), word), g.seq(t("tag"), tag))
    groups = g.alt(g.seq(paren, closed), g.seq(square, closed if cpp else word), body)
    between = ("bin", *(() if cpp else ("angle",)))
    ends = g.alt(t(";"), g.seq(t(","), operator), g.seq(t("="), assigned))
    binary = g.alt(g.seq(t(*between, "sign"), operator), g.seq(t("star"), star))
    names_on = g.alt(g.seq(t("id"), names), g.seq(t("str"), text))
    member = g.seq(t("mem"), word)
    operand = g.alt(g.seq(t("id"), name), g.seq(t("num"), number), g.seq(t("str"), text), g.seq(t("sign", "un", "tilde", "inc"), operator), g.seq(t("star"), star), to_word, groups)
    after_name = g.alt(*([g.seq(t("tilde"), operator)] if cpp else []), ends, g.seq(t("star"), star), g.seq(t("inc"), name), member, names_on, to_word, groups)
    g.rule("name", g.alt(after_name, binary))
    g.rule("names", after_name)
    g.rule("numeral", g.alt(ends, binary, g.seq(t("dots", ":", *only("angle")), word), g.seq(square, closed if cpp else word), body))
    g.rule("text", g.alt(ends, binary, member, names_on, to_word, groups))
    g.rule("operator", operand)
    g.rule("star", g.alt(operand, ends))
    anything = g.alt(operand, ends, binary, member)
    g.rule("after_word", anything)
    g.rule("assigned", g.alt(operand, g.seq(t("default"), name)) if cpp else g.alt(operand, g.seq(init, word)))
    if cpp:
        g.rule("after_tag", anything)
        g.rule("closed", anything)
    else:
        g.rule("after_tag", g.alt(g.seq(t("id"), tag), g.seq(paren, tag), anything, g.seq(g.alt(block, init), word)))
        # After a group: a body, with attributes or old-style parameter declarations before it.
        g.rule("closed", g.alt(g.seq(t("id"), closed), anything, block, g.seq(g.alt(block, init), word)))
    start = operand

    head = g.alt(paren, g.seq(t("id", "un"), paren))
    c0 = g.ref("c0")
    g.rule("c0", g.alt(t(":"), g.seq(t("id", "num", "str", *operators, "prefix", *only("::")), c0), g.seq(paren, c0)))
    control = g.alt(
        g.seq(t("if", "while", "switch", "for"), head, stmt),
        g.seq(t("else"), stmt),
        g.seq(t("do"), stmt, t("while"), paren, t(";")),
        g.seq(t("case"), c0),
        g.seq(t("default"), t(":")),
    )
    linkage = g.seq(t("stmtword"), t("str"), block)
    label = g.seq(t("id", "stmtword"), t(":"), stmt)
    macro_loop = g.seq(t("id"), paren, control)
    g.rule("stmt", g.alt(t(";"), block, control, start, linkage, label, macro_loop, *(() if not cpp else (g.seq(t("id"), t(":")), g.seq(square, stmt)))))
    g.seal()
    return g, stmts


@cache
def go_family() -> tuple[Grammar, Node]:
    """Grammar of Go, over tokens with explicit ends of statements; the last statement of a block may go without."""
    g = Grammar()
    t = g.tok
    any_word = ("id", "num", "str", "bin", "un", "inc", "dots", ",", "=", ".", ":", "kw", "header", "case", "else", "struct")
    paren, square, loose = _common(g, (*any_word, *GO_TOP, ";"))
    body = g.ref("body", True)
    block = g.seq(t("{"), body, t("}"))

    def expressions(p: str, after: Node, brace: Node, plain: bool) -> tuple[Node, ...]:
        """States of a run of operands and operators, with what may come when an operand is whole, and after a brace that follows one."""
        name, value, closed, operand, dot, typed, function, record = (g.ref(p + n, plain and n in ("name", "value", "closed")) for n in ("name", "value", "closed", "operand", "dot", "typed", "function", "record"))
        on = g.alt(after, g.seq(t("bin", "un", "=", ","), operand), g.seq(t("."), dot))
        groups = g.alt(g.seq(paren, closed), g.seq(square, g.alt(typed, closed)))
        g.rule(p + "name", g.alt(on, groups, brace))
        g.rule(p + "value", g.alt(on, g.seq(square, closed)))
        g.rule(p + "closed", g.alt(on, groups, brace))
        # After the brackets of a type: its element, then the braces of a literal.
        g.rule(p + "typed", g.alt(g.seq(t("un", "kw", "."), typed), g.seq(square, typed), g.seq(t("id"), g.alt(typed, closed)), g.seq(loose, closed), g.seq(t("struct"), loose, typed), g.seq(t("func"), paren, typed), g.seq(paren, closed)))
        g.rule(p + "operand", g.alt(g.seq(t("id"), name), g.seq(t("num", "str"), value), g.seq(t("un", "kw"), operand), groups, g.seq(t("func"), paren, function), g.seq(t("struct"), record)))
        g.rule(p + "dot", g.alt(g.seq(t("id"), name), g.seq(paren, closed)))
        g.rule(p + "function", g.alt(g.seq(block, closed), g.seq(g.alt(t("id", "un", ".", "kw"), paren, square), function), g.seq(t("struct"), loose, function), g.seq(t("func"), paren, function)))
        g.rule(p + "record", g.seq(loose, closed))
        return name, operand

    done, header, chain, case, names, jump = g.ref("done", True), g.ref("header_"), g.ref("chain", True), g.ref("case_"), g.ref("names_", True), g.ref("jump", True)
    end = g.alt(g.empty, g.seq(t(";"), body))
    lit = g.ref("lit", True)
    g.rule("done", end)
    name, operand = expressions("x_", g.alt(end, g.seq(t("inc"), done)), g.seq(loose, lit), True)
    g.rule("lit", g.ref("x_closed", True))
    # Between a keyword and its block: statements as well, and no literal of a bare type name.
    _, h_operand = expressions("h_", g.alt(g.seq(block, chain), g.seq(t(";"), header), g.seq(t("inc"), g.alt(g.seq(block, chain), g.seq(t(";"), header)))), g.none, False)
    g.rule("header_", g.alt(h_operand, g.seq(block, chain), g.seq(t(";"), header)))
    g.rule("chain", g.alt(end, g.seq(t("else"), g.alt(g.seq(t("header"), header), g.seq(block, chain)))))
    g.rule("case_", g.alt(g.seq(t(":"), body), g.seq(g.alt(t(*(w for w in any_word if w != ":"), "func"), paren, square, loose), case)))
    g.rule("names_", g.alt(end, g.seq(g.alt(t(*any_word, "func", "type"), paren, square, loose), names)))
    g.rule("jump", g.alt(end, operand))
    label = g.seq(t("id"), t(":"), body)
    g.rule("body", g.alt(end, g.seq(block, done), g.seq(t("header"), header), g.seq(t("case"), case), g.seq(t("kw"), jump), g.seq(t("const", "var", "type"), names), label, operand))

    rest = g.ref("rest")  # the end of a declaration: up to its semicolon
    g.rule("rest", g.alt(t(";"), g.seq(g.alt(t(*any_word, "func"), paren, square, loose), rest)))
    spec = g.seq(g.alt(t("id", "."), g.empty), t("str"), t(";"))
    imports = g.ref("imports", True)
    g.rule("imports", g.alt(g.empty, g.seq(spec, imports)))
    last = g.alt(t("str"), g.seq(t("id", "."), t("str")))
    import_decl = g.seq(t("import"), g.alt(spec, g.seq(t("("), imports, g.alt(g.empty, last), t(")"), t(";"))))
    decl = g.seq(t("const", "var", "type"), g.alt(g.seq(paren, t(";")), g.seq(t("id"), rest)))
    result = g.ref("result")  # result type, then the body or nothing
    g.rule("result", g.alt(t(";"), g.seq(block, t(";")), g.seq(g.alt(t("id", "un", "bin", ".", ",", "kw", "func"), paren, square), result), g.seq(t("struct"), loose, result)))
    func = g.seq(t("func"), g.alt(paren, g.empty), t("id"), g.alt(square, g.empty), paren, result)
    top, tops = g.ref("top"), g.ref("tops", True)
    g.rule("top", g.alt(t(";"), import_decl, decl, func))
    g.rule("tops", g.alt(g.empty, g.seq(top, tops)))
    file = g.seq(t("package"), t("id"), t(";"), tops)
    g.seal()
    return g, g.alt(file, g.empty)


def without_guard(text: str, tokens: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The tokens of C or C++ without the two directives of an include guard: a first conditional ``#ifndef X`` with ``#define X`` that has
    no other branch and whose end is the text's last token. Its body is what an inclusion means, so leaving it out is no setting."""
    if len(tokens) < 2 or tokens[0][0] != "#if" or tokens[-1][0] != "#endif" or not _GUARD.match(text, tokens[0][1]):
        return tokens
    depth = 0
    for i, (c, _) in enumerate(tokens):
        depth += (c == "#if") - (c == "#endif")
        if depth == 0 and i < len(tokens) - 1 or depth == 1 and c in ("#elif", "#else"):
            return tokens
    return tokens[1:-1] if depth == 0 else tokens


def judge(text: str, language: str) -> tuple[str, int]:
    """Verdict (valid, broken, truncated, conflict) and the offset of the failing token, -1 if there is none.

    The body of an include guard has to derive. Any other conditional counts as left out where that makes the text valid, so a conflict marker
    in one of its branches is no conflict as long as another setting derives (another branch or, without #else, none); markers around it are one.
    """
    tokens = list(go_classes(text)) if language == "go" else without_guard(text, list(c_classes(text)))
    grammar, start = go_family() if language == "go" else c_family(language == "cpp")
    verdict, i = run(grammar, start, [c for c, _ in tokens])
    if verdict == "valid":
        return verdict, -1
    at = tokens[i][1] if i < len(tokens) else len(text)
    if verdict == "broken" and i < len(tokens) and tokens[i][0] == "marker":
        verdict = "conflict"
    return verdict, at


def extension_languages(path: str | None) -> tuple[str, ...]:
    """Languages that the extension names; none for an unknown one."""
    name = (path or "").rsplit("/", 1)[-1]
    return LANGUAGES.get(name.rsplit(".", 1)[-1].lower(), ()) if "." in name else ()


def judge_file(path: str | None, text: str | None) -> tuple[str | None, int]:
    """Verdict on a file by its extension; (None, -1) for a null text or an unknown extension. Valid for one language of several is valid."""
    languages = extension_languages(path)
    if text is None or not languages:
        return None, -1
    best: tuple[str, int] | None = None
    for language in languages:
        got = judge(text, language)
        if got[0] == "valid":
            return got
        if best is None or got[1] > best[1]:
            best = got
    return best
