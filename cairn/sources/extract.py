"""Fact extraction from source files: file to rows of all fact kinds, in one tolerant pass.

The lexer's tokens are cut into declarations by brackets and semicolons; what a declaration is follows from its shape.
Broken parts cost the declarations they touch, never the file. Whole texts, one task per batch of files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, fields

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.sources.lexer import C_KEYWORDS, C_TYPES, GO_KEYWORDS, Places, Token, tokens

SCHEMA = (
    "fact string, name string, kind string, role string, owner string, owner_kind string, qualified_name string, signature string, canonical_signature string, linkage_kind string, min_arity int, max_arity int, "
    "variadic boolean, start_byte bigint, end_byte bigint, start_line int, start_character int, decl_start_line int, body_start_line int, body_end_line int, guard string, form string, n_args int, caller string, detail string, fn_start bigint, fn_end bigint, scope_start bigint, scope_end bigint, provenance string"
)


@dataclass
class Fact:
    """One row; which fields are set depends on ``fact``."""

    fact: str
    name: str | None = None
    kind: str | None = None
    role: str | None = None
    owner: str | None = None
    owner_kind: str | None = None
    qualified_name: str | None = None
    signature: str | None = None
    canonical_signature: str | None = None
    linkage_kind: str | None = None
    min_arity: int | None = None
    max_arity: int | None = None
    variadic: bool | None = None
    start_byte: int | None = None
    end_byte: int | None = None
    start_line: int | None = None
    start_character: int | None = None
    decl_start_line: int | None = None
    body_start_line: int | None = None
    body_end_line: int | None = None
    guard: str | None = None
    form: str | None = None
    n_args: int | None = None
    caller: str | None = None
    detail: str | None = None
    fn_start: int | None = None
    fn_end: int | None = None
    scope_start: int | None = None
    scope_end: int | None = None
    provenance: str | None = "ast"


NAMES = [f.name for f in fields(Fact)]
_PAIR = {"(": ")", "[": "]", "{": "}"}


def _match(ts: list[Token]) -> list[int]:
    """For each opening bracket the place of its partner (the end for one without), for others their own place."""
    out, stack = list(range(len(ts))), []
    for i, t in enumerate(ts):
        if t.kind == "punct":
            if t.text in _PAIR:
                stack.append(i)
            elif t.text in ")]}":
                while stack and _PAIR[ts[stack[-1]].text] != t.text and t.text == "}" and ts[stack[-1]].text != "{":
                    out[stack.pop()] = i
                if stack and _PAIR[ts[stack[-1]].text] == t.text:
                    out[stack.pop()] = i
    for i in stack:
        out[i] = len(ts)
    return out


def _one_setting(every: list[Token]) -> list[Token]:
    """Tokens without directives; where the first branch of a conditional does not close what it opens, its other branches are left out."""
    out: list[Token] = []
    stack: list[list] = []  # net braces of the first branch, whether in a later one
    for t in every:
        if t.kind == "dir":
            word = re.match(r"[ \t]*#[ \t]*(\w*)", t.text)[1]
            if word.startswith("if"):
                stack.append([0, False])
            elif word.startswith("el") and stack:
                stack[-1][1] = True
            elif word == "endif" and stack:
                stack.pop()
            continue
        if any(later and net for net, later in stack):
            continue
        if t.kind == "punct" and t.text in "{}" and stack:
            for x in stack:
                if not x[1]:
                    x[0] += 1 if t.text == "{" else -1
        out.append(t)
    return out


def _split(ts: list[Token], pair: list[int], a: int, b: int) -> list[tuple[int, int]]:
    """Parts between commas at the top of ``ts[a:b]``; angle brackets pair as well."""
    parts, start, i, angle = [], a, a, 0
    while i < b:
        t = ts[i]
        if t.text in _PAIR and t.kind == "punct":
            i = pair[i]
        elif t.text == "<":
            angle += 1
        elif t.text == ">" and angle:
            angle -= 1
        elif t.text == "," and not angle:
            parts.append((start, i))
            start = i + 1
        i += 1
    if start < b or parts:
        parts.append((start, b))
    return [p for p in parts if p[0] < p[1]]


def arity(text: str, ts: list[Token], pair: list[int], a: int, b: int, cpp: bool) -> tuple[int | None, int | None, bool, str]:
    """Least and greatest number of arguments, whether variadic, and the shape of a parameter list ``ts[a:b]``."""
    parts = _split(ts, pair, a, b)
    if not parts:
        return (0, 0, False, "") if cpp else (None, None, False, "")
    if len(parts) == 1 and b - a == 1 and ts[a].text == "void":
        return 0, 0, False, ""
    variadic = any(ts[x].text == "..." for x, y in parts if y - x == 1)
    named = [p for p in parts if not (p[1] - p[0] == 1 and ts[p[0]].text == "...")]
    with_default = sum(1 for x, y in named if any(t.text == "=" for t in ts[x:y]))
    return len(named) - with_default, None if variadic else len(named), variadic, ", ".join(["_"] * len(named) + ["..."] * variadic)


def _squeezed(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


_CONFLICT = re.compile(r"^(?:<{7}|={7}|>{7}|\|{7})[^\r\n]*", re.M)


def _as_conditional(text: str) -> str:
    """The remains of a merge as conditional directives of the same length, so that sides that open a brace each do not swallow the rest of the file."""
    word = {"<": "#if 1", "=": "#else", "|": "#else", ">": "#endif"}
    return _CONFLICT.sub(lambda m: word[m[0][0]].ljust(len(m[0])), text)


class CFamily:
    """One file of C or C++."""

    def __init__(self, text: str, path: str, cpp: bool):
        text = _as_conditional(text)
        self.text, self.path, self.cpp = text, path, cpp
        self.places = Places(text)
        every = tokens(text, go=False)
        self.facts: list[Fact] = []
        self.ts = _one_setting(every)
        self.pair = _match(self.ts)
        self.guards = self._directives([t for t in every if t.kind == "dir"])
        self.records: set[str] = set()

    # --- places -------------------------------------------------------------------------------------------------
    def _at(self, t: Token) -> dict:
        line, col = self.places.line_col(t.start)
        return {"start_byte": self.places.byte(t.start), "end_byte": self.places.byte(t.end), "start_line": line, "start_character": col}

    def _line(self, i: int) -> int:
        return self.places.line_col(self.ts[min(i, len(self.ts) - 1)].start)[0]

    def _span(self, first: int, last: int, label: str) -> dict:
        """Bytes from the start of one token to the end of another."""
        ts = self.ts
        return {f"{label}_start": self.places.byte(ts[first].start), f"{label}_end": self.places.byte(ts[min(last, len(ts) - 1)].end)}

    def _guard(self, t: Token) -> str | None:
        found = None
        for at, guard in self.guards:
            if at > t.start:
                break
            found = guard
        return found

    # --- directives: includes, macros, guards -------------------------------------------------------------------
    def _directives(self, ds: list[Token]) -> list[tuple[int, str | None]]:
        stack: list[str] = []
        guards: list[tuple[int, str | None]] = []
        header = None
        for t in ds:
            m = re.match(r"[ \t]*#[ \t]*(\w+)[ \t]*(.*)", t.text, re.S)
            if not m:
                continue
            word, rest = m[1], _squeezed(re.sub(r"/\*.*?\*/|//.*", " ", m[2].replace("\\\n", " ").replace("\\\r\n", " ")))
            if word in ("include", "import", "include_next"):
                self.facts.append(Fact("include", name=rest, **self._at(t)))
            elif word == "define":
                d = re.match(r"(\w+)(\([^)]*\))?\s*(.*)", rest, re.S)
                if d and not (header == d[1] and not d[3]):
                    at = t.start + t.text.index(d[1])
                    place = Token("id", d[1], at)
                    self.facts.append(Fact("declaration", name=d[1], kind="macro", role="definition", signature=d[1] + (d[2] or ""), detail=d[3] or None, guard=self._join(stack), **self._at(place)))
            elif word in ("if", "ifdef", "ifndef"):
                text = rest if word == "if" else f"defined({rest})" if word == "ifdef" else f"!defined({rest})"
                if word == "ifndef" and not stack and header is None:
                    header, text = rest, ""
                stack.append(text)
            elif word in ("elif", "else") and stack:
                stack[-1] = f"!({stack[-1]})" if word == "else" else rest
            elif word == "endif" and stack:
                stack.pop()
            guards.append((t.start, self._join(stack)))
        return guards

    @staticmethod
    def _join(stack: list[str]) -> str | None:
        return " && ".join(s for s in stack if s) or None

    # --- declarations -------------------------------------------------------------------------------------------
    def run(self) -> list[Fact]:
        self._scope(0, len(self.ts), [], None)
        return self.facts

    def _scope(self, i: int, end: int, spaces: list[str], record: str | None) -> None:
        """Declarations of ``ts[i:end]`` within namespaces or a record."""
        ts = self.ts
        while i < end:
            t = ts[i]
            if t.text in (";", "}", ")", "]"):
                i += 1
                continue
            if record and t.text in ("public", "private", "protected") and i + 1 < end and ts[i + 1].text == ":":
                i += 2
                continue
            i = self._declaration(i, end, spaces, record)

    def _declaration(self, i: int, end: int, spaces: list[str], record: str | None) -> int:
        ts, pair = self.ts, self.pair
        first = i
        if ts[i].text == "template" and i + 1 < end and ts[i + 1].text == "<":
            depth, i = 0, i + 1
            while i < end:
                depth += (ts[i].text == "<") - (ts[i].text == ">") - 2 * (ts[i].text == ">>")
                i += 1
                if depth <= 0:
                    break
            first = i
        if i < end and ts[i].text == "namespace" or (i + 1 < end and ts[i].text == "inline" and ts[i + 1].text == "namespace"):
            j = i + 1
            names = []
            while j < end and ts[j].text not in ("{", ";", "="):
                if ts[j].kind == "id" and ts[j].text != "namespace":
                    names.append(ts[j].text)
                j += 1
            if j < end and ts[j].text == "{":
                self._scope(j + 1, min(pair[j], end), [*spaces, *(names or ["(anonymous)"])], None)
                return min(pair[j], end) + 1
            return j + 1
        if i + 2 < end and ts[i].text == "extern" and ts[i + 1].kind == "str" and ts[i + 2].text == "{":
            self._scope(i + 3, min(pair[i + 2], end), spaces, record)
            return min(pair[i + 2], end) + 1
        # An annotation macro on a line of its own is no part of the declaration.
        while first + 1 < end and re.fullmatch(r"[A-Z][A-Z0-9_]{2,}", ts[first].text) and "\n" in self.text[ts[first].end : ts[first + 1].start]:
            first += 1
        # The end: a semicolon or a body at the top.
        j, paren, equals, body, colon = first, None, None, None, None
        while j < end:
            t = ts[j]
            if t.text == ";":
                break
            if t.text == "(":
                if paren is None and equals is None and j > first and ts[j - 1].kind == "id" and ts[j - 1].text not in C_KEYWORDS:
                    paren = j
                elif paren is None and j > first + 1 and ts[j - 2].text == "operator":
                    paren = j
                j = pair[j] + 1
                continue
            if t.text == "[":
                j = pair[j] + 1
                continue
            if t.text == "=" and equals is None:
                equals = j
            if t.text == ":" and paren is not None and colon is None:
                colon = j
            if t.text == "{":
                if equals is not None or (colon is not None and ts[j - 1].kind == "id" and pair[j] + 1 < end and ts[pair[j] + 1].text in (",", "{")):
                    j = pair[j] + 1
                    continue
                body = j
                break
            j += 1
        head = ts[first:j]
        words = [t.text for t in head]
        if body is not None and paren is None and any(w in ("struct", "union", "class", "enum") for w in words):
            return self._record(first, body, end, spaces, record, "typedef" in words)
        if not head or (body is None and j >= end):  # nothing, or no end: not a declaration
            return (pair[body] if body is not None else j) + 1
        if words[0] == "using":
            if equals is not None and len(head) > 2:
                self._named("alias", head[1], "definition", spaces, record, detail=_squeezed(self.text[ts[equals + 1].start : head[-1].end]) if equals + 1 < j else None, fact="type_alias")
        elif words[0] == "typedef":
            name = next((t for t in reversed(head) if t.kind == "id" and t.text not in C_KEYWORDS), None)
            inner = next((k for k in range(first, j) if ts[k].text == "(" and k + 1 < j and ts[k + 1].text == "*"), None)
            if inner is not None and inner + 2 < j:
                name = ts[inner + 2]
            if name:
                self._named("alias", name, "definition", spaces, record, detail=_squeezed(self.text[head[1].start : head[-1].end]), fact="type_alias")
        elif paren is not None and (body is not None or equals is None or equals > paren):
            self._callable(first, paren, body, j, spaces, record)
        elif body is None:
            self._objects(first, j, spaces, record)
        if body is not None:
            return min(pair[body], end) + 1
        return j + 1

    def _named(self, kind: str, t: Token, role: str, spaces: list[str], record: str | None, fact: str = "declaration", **more: object) -> None:
        owner = record or "::".join(spaces) or None
        q = "::".join([*spaces, *([record] if record else []), t.text])
        self.facts.append(Fact("declaration", name=t.text, kind=kind, role=role, owner=owner, owner_kind="record" if record else "namespace" if spaces else None, qualified_name=q, guard=self._guard(t), **self._at(t), **more))
        if fact != "declaration":
            self.facts.append(Fact(fact, name=t.text, kind=kind, owner=owner, qualified_name=q, **self._at(t), **more))

    def _record(self, first: int, body: int, end: int, spaces: list[str], record: str | None, typedef: bool) -> int:
        ts, pair = self.ts, self.pair
        at = next(k for k in range(first, body) if ts[k].text in ("struct", "union", "class", "enum"))
        tag = ts[at].text
        named = [t for t in ts[at + 1 : body] if t.kind == "id" and t.text not in C_KEYWORDS]
        base = next((k for k in range(at, body) if ts[k].text == ":"), body)
        named = [t for t in named if t.start < (ts[base].start if base < len(ts) else 1 << 60)]
        close = min(pair[body], end)
        after = close + 1
        while after < end and ts[after].text != ";":
            after = pair[after] + 1 if ts[after].text in _PAIR else after + 1
        trailing = [t for t in ts[close + 1 : after] if t.kind == "id" and t.text not in C_KEYWORDS]
        name = named[-1] if named else (trailing[0] if typedef and trailing else None)
        label = name.text if name else None
        if name:
            self.records.add(label)
            self._named("type", name, "definition", spaces, record, detail=tag, signature=f"{tag} {label}")
            self.facts.append(Fact("record", name=label, kind=tag, role="named_tag" if named else "anonymous_typedef", owner=record, qualified_name="::".join([*spaces, label]), body_start_line=self._line(body), body_end_line=self._line(close), **self._at(name)))
        if typedef:
            for t in trailing:
                if t is not name:
                    self._named("alias", t, "definition", spaces, record, detail=label, fact="type_alias")
        if tag == "enum":
            for a, b in _split(ts, pair, body + 1, close):
                if ts[a].kind == "id":
                    self._named("enum_constant", ts[a], "definition", spaces, record, detail=label)
        else:
            self._scope(body + 1, close, spaces, label or record or "(anonymous)")
        if not typedef and trailing and record:
            for t in trailing:
                self.facts.append(Fact("member", name=t.text, kind="field", owner=record, detail=label, **self._at(t)))
        elif not typedef:
            for t in trailing:
                self._named("object", t, "definition" if self.cpp else "tentative", spaces, record, detail=label)
        return after + 1

    def _callable(self, first: int, paren: int, body: int | None, stop: int, spaces: list[str], record: str | None) -> None:
        ts, pair = self.ts, self.pair
        name = ts[paren - 1]
        start = paren - 1
        owner = []
        if start > first and ts[start - 1].text in ("~", "operator"):
            start -= 1
        while start - 2 >= first and ts[start - 1].text == "::" and ts[start - 2].kind in ("id", "punct"):
            start -= 2
            if ts[start].text == ">":
                while start > first and ts[start].text != "<":
                    start -= 1
                start -= 1
            owner.insert(0, ts[start].text)
        type_words = [t.text for t in ts[first:start]]
        if not type_words and not (self.cpp and (record or owner)):
            return  # a macro call, not a declaration
        close = min(pair[paren], len(ts))
        least, most, variadic, shape = arity(self.text, ts, pair, paren + 1, close, self.cpp)
        last = ts[stop - 1].end if body is None else ts[body - 1].end
        full = _squeezed(self.text[ts[first].start : last])
        who = "::".join(owner) if owner else record
        kind = "method" if who and (record or self.cpp and owner) else "function"
        static = "static" in type_words and not record
        role = "definition" if body is not None else "declaration"
        namespace = "::".join(spaces) or None
        fact = dict(
            name=name.text, owner=who or namespace, owner_kind="record" if who else "namespace" if namespace else None, role=role, qualified_name="::".join([*([who] if who else []), name.text]),
            signature=f"{name.text}({shape})", canonical_signature=full, linkage_kind="internal" if static or "(anonymous)" in spaces else "external", min_arity=least, max_arity=most, variadic=variadic,
            decl_start_line=self._line(first), guard=self._guard(name), body_start_line=self._line(body) if body is not None else None, body_end_line=self._line(pair[body]) if body is not None else None, **self._at(name),
        )
        self.facts.append(Fact("callable", kind="function", **fact))
        self.facts.append(Fact("declaration", kind=kind, **fact))
        if who:
            self.facts.append(Fact("member", kind="method", detail=" ".join(type_words) or None, **{k: fact[k] for k in ("name", "owner", "signature", "start_byte", "end_byte", "start_line", "start_character")}))
        if body is not None:
            fn = self._span(first, pair[body], "fn")
            self._parameters(paren + 1, close, fact["qualified_name"], body, fn)
            self._body(body + 1, min(pair[body], len(ts)), fact["qualified_name"], body, fn)

    def _parameters(self, a: int, b: int, caller: str, body: int, fn: dict) -> None:
        for x, y in _split(self.ts, self.pair, a, b):
            eq = next((k for k in range(x, y) if self.ts[k].text == "="), y)
            names = [t for t in self.ts[x:eq] if t.kind == "id" and t.text not in C_KEYWORDS]
            if names and (len(names) > 1 or any(t.text in C_TYPES for t in self.ts[x:eq])):
                self.facts.append(Fact("local", name=names[-1].text, kind="parameter", caller=caller, detail=_squeezed(self.text[self.ts[x].start : names[-1].start]), body_start_line=self._line(body), body_end_line=self._line(self.pair[body]), **fn, scope_start=fn["fn_start"], scope_end=fn["fn_end"], **self._at(names[-1])))

    def _objects(self, first: int, stop: int, spaces: list[str], record: str | None) -> None:
        ts, pair = self.ts, self.pair
        words = {t.text for t in ts[first:stop]}
        parts = _split(ts, pair, first, stop)
        for n, (a, b) in enumerate(parts):
            cut = next((k for k in range(a, b) if ts[k].text in ("=", "[", ":", "{", "(")), b)
            ids = [t for t in ts[a:cut] if t.kind == "id" and t.text not in C_KEYWORDS]
            typed = n > 0 or len(ids) > 1 or any(t.text in C_TYPES for t in ts[a:cut])
            if not ids or not typed:
                continue
            name = ids[-1]
            if n == 0 and any(w in words for w in ("struct", "union", "class", "enum")) and len(ids) == 1 and ts[first].text in ("struct", "union", "class", "enum") and stop - first <= 2:
                if not self.cpp:
                    self._named("type", name, "declaration", spaces, record, detail=ts[first].text, signature=f"{ts[first].text} {name.text}")
                continue
            kind_of_type = _squeezed(self.text[ts[first].start : name.start])
            if record:
                self.facts.append(Fact("member", name=name.text, kind="field", owner=record, detail=kind_of_type, **self._at(name)))
                continue
            init = next((k for k in range(cut, b) if ts[k].text == "="), None)
            role = "definition" if init is not None else "declaration" if "extern" in words else "definition" if self.cpp else "tentative"
            internal = "static" in words or (self.cpp and "const" in words and "extern" not in words) or "(anonymous)" in spaces
            self._named("object", name, role, spaces, record, detail=kind_of_type, linkage_kind="internal" if internal else "external")
            if init is not None:
                self._body(init + 1, b, None, None)

    # --- bodies: calls and local bindings -----------------------------------------------------------------------
    def _body(self, a: int, b: int, caller: str | None, body: int | None, fn: dict | None = None) -> None:
        ts, pair = self.ts, self.pair
        begins = True
        scopes: list[tuple[int, int]] = [(body, pair[body])] if body is not None else []  # first and last token
        for i in range(a, b):
            t = ts[i]
            while len(scopes) > 1 and i > scopes[-1][1]:
                scopes.pop()
            if t.text == "{":
                scopes.append((i, pair[i]))
            elif t.text == "for" and i + 1 < b and ts[i + 1].text == "(":
                after = min(pair[i + 1] + 1, b - 1)
                # What the head declares is seen to the end of the loop's statement.
                stop = pair[after] if ts[after].text == "{" else next((k for k in range(after, b) if ts[k].text == ";"), b - 1)
                scopes.append((i, stop))
            if t.text == "(" and i > a:
                self._call(i, caller)
            if begins and caller and t.kind == "id":
                self._local(i, b, caller, body, {**fn, **self._span(*scopes[-1], "scope")} if fn else {})
            begins = t.text in (";", "{", "}") or (t.text == "(" and i > a and ts[i - 1].text == "for")

    def _local(self, i: int, b: int, caller: str, body: int | None, spans: dict) -> None:
        ts = self.ts
        j = i
        while j < b and (ts[j].kind == "id" or ts[j].text in ("*", "&", "::", "<", ">")) and ts[j].text not in ("return", "goto", "case", "else", "delete", "throw"):
            j += 1
        if sum((t.text == "<") - (t.text == ">") for t in ts[i:j]):
            return  # a comparison
        if j - i < 2 or ts[j - 1].kind != "id" or ts[j - 1].text in C_KEYWORDS or j >= b or ts[j].text not in ("=", ";", "[", ",", ":", "{"):
            return
        self.facts.append(Fact("local", name=ts[j - 1].text, kind="variable", caller=caller, detail=_squeezed(self.text[ts[i].start : ts[j - 1].start]), body_start_line=self._line(body) if body is not None else None, body_end_line=self._line(self.pair[body]) if body is not None else None, **spans, **self._at(ts[j - 1])))

    def _call(self, i: int, caller: str | None) -> None:
        ts, pair = self.ts, self.pair
        p = ts[i - 1]
        n = len(_split(ts, pair, i + 1, min(pair[i], len(ts))))
        form, name, qualified = None, None, None
        if p.kind == "id" and p.text not in C_KEYWORDS:
            before = ts[i - 2].text if i >= 2 else ""
            name, form = p, "direct_name"
            if before == ".":
                form = "member_dot"
            elif before == "->":
                form = "member_arrow"
            elif before == "::":
                k, parts = i - 1, [p.text]
                while k >= 2 and ts[k - 1].text == "::" and ts[k - 2].kind == "id":
                    k -= 2
                    parts.insert(0, ts[k].text)
                form, qualified = "qualified_name", "::".join(parts)
            elif before == "new":
                form = "explicit_construction"
            elif i >= 2 and ts[i - 2].kind == "id" and ts[i - 2].text not in C_KEYWORDS:
                return  # a variable built from arguments
        elif p.text == ")":
            opening = next((k for k in range(i - 2, -1, -1) if pair[k] == i - 1 and ts[k].text == "("), None)
            if opening is None:
                return
            inner = ts[opening + 1 : i - 1]
            if inner and inner[0].text == "*":
                form, name = "function_pointer", None
            elif inner and all(t.kind == "id" or t.text == "::" for t in inner) and inner[-1].text not in C_KEYWORDS and len(inner) % 2 == 1:
                form, name = "parenthesized_name", inner[-1]
                qualified = "".join(t.text for t in inner) if len(inner) > 1 else None
                if i >= 2 and opening > 0 and (ts[opening - 1].kind == "id"):
                    return  # condition of a statement, then a group
            else:
                return
        else:
            return
        at = self._at(name or p)
        self.facts.append(Fact("call", name=name.text if name else None, form=form, n_args=n, caller=caller or "<global initializer>", qualified_name=qualified, guard=self._guard(p), **at))


class GoFile:
    """One file of Go."""

    def __init__(self, text: str, path: str):
        self.text, self.path = text, path
        self.places = Places(text)
        every = tokens(text, go=True, keep=frozenset({"nl"}))
        self.ts = [t for t in every if t.kind != "nl"]
        self.breaks = [t.start for t in every if t.kind == "nl"]
        self.pair = _match(self.ts)
        self.facts: list[Fact] = []
        self.package = ""

    _at, _line, _span = CFamily._at, CFamily._line, CFamily._span

    def _next_line(self, i: int) -> int:
        """The first token on a later line than token ``i``, groups skipped."""
        from bisect import bisect_left

        ts = self.ts
        while i < len(ts):
            if ts[i].text in _PAIR and ts[i].kind == "punct":
                i = min(self.pair[i], len(ts) - 1)
            here = bisect_left(self.breaks, ts[i].start)
            i += 1
            if i >= len(ts) or (bisect_left(self.breaks, ts[i].start) > here and ts[i - 1].text not in (",", ".", "+", "&&", "||", "=", ":=")) or ts[i - 1].text == ";":
                return i
        return i

    def run(self) -> list[Fact]:
        ts, i = self.ts, 0
        while i < len(ts):
            w = ts[i].text
            if w == "package" and i + 1 < len(ts):
                self.package = ts[i + 1].text
                self.facts.append(Fact("package", name=self.package, **self._at(ts[i + 1])))
            elif w == "import":
                last = min(self.pair[i + 1], len(ts)) if i + 1 < len(ts) and ts[i + 1].text == "(" else self._next_line(i)
                for k in range(i + 1, last):
                    if ts[k].kind == "str":
                        self.facts.append(Fact("import", name=ts[k].text.strip('"`'), detail=ts[k - 1].text if ts[k - 1].kind == "id" and ts[k - 1].text != "import" or ts[k - 1].text in (".", "_") else None, **self._at(ts[k])))
                i = last
                continue
            elif w == "func":
                i = self._func(i)
                continue
            elif w in ("const", "var", "type") and (i == 0 or ts[i - 1].text == ";" or self._line(i) > self._line(i - 1)):
                i = self._group(i, w)
                continue
            i += 1
        return self.facts

    def _declare(self, kind: str, t: Token, **more: object) -> None:
        self.facts.append(Fact("declaration", name=t.text, kind=kind, role="definition", qualified_name=f"{self.package}::{t.text}", linkage_kind="package", **self._at(t), **more))

    def _group(self, i: int, word: str) -> int:
        ts = self.ts
        if i + 1 < len(ts) and ts[i + 1].text == "(":
            end = min(self.pair[i + 1], len(ts))
            k = i + 2
            while k < end:
                self._spec(k, word)
                k = self._next_line(k)
            return end + 1
        self._spec(i + 1, word)
        return self._next_line(i)

    def _spec(self, k: int, word: str) -> None:
        ts = self.ts
        if k >= len(ts) or ts[k].kind != "id":
            return
        if word != "type":
            self._declare("object", ts[k], detail=word)
            while k + 2 < len(ts) and ts[k + 1].text == "," and ts[k + 2].kind == "id":
                k += 2
                self._declare("object", ts[k], detail=word)
            return
        name, j = ts[k], k + 1
        if j < len(ts) and ts[j].text == "[" and ts[j + 1 : j + 2] and ts[j + 1].kind == "id":
            j = self.pair[j] + 1
        alias = j < len(ts) and ts[j].text == "="
        kind = ts[j].text if j < len(ts) else ""
        if kind in ("struct", "interface") and j + 1 < len(ts) and ts[j + 1].text == "{":
            end = min(self.pair[j + 1], len(ts))
            self._declare("type", name, detail=kind)
            self.facts.append(Fact("record", name=name.text, kind=kind, role="named_tag", qualified_name=f"{self.package}::{name.text}", body_start_line=self._line(j + 1), body_end_line=self._line(end), **self._at(name)))
            m = j + 2
            while m < end:
                nxt = self._next_line(m)
                if ts[m].kind == "id":
                    method = m + 1 < len(ts) and ts[m + 1].text == "("
                    self.facts.append(Fact("member", name=ts[m].text, kind="method" if method else "field", owner=name.text, detail=_squeezed(self.text[ts[m].end : ts[min(nxt, end) - 1].end]) or None, **self._at(ts[m])))
                m = max(nxt, m + 1)
        else:
            stop = self._next_line(k)
            self._declare("alias" if alias else "type", name, detail=_squeezed(self.text[ts[j].start : ts[stop - 1].end]) if j < stop else None)
            self.facts.append(Fact("type_alias", name=name.text, kind="alias" if alias else "defined", detail=_squeezed(self.text[ts[j].start : ts[stop - 1].end]) if j < stop else None, **self._at(name)))

    def _func(self, i: int) -> int:
        ts, pair = self.ts, self.pair
        j, owner = i + 1, None
        if j < len(ts) and ts[j].text == "(":
            receiver = [t.text for t in ts[j + 1 : min(pair[j], len(ts))] if t.kind == "id"]
            owner = receiver[1] if len(receiver) > 1 else receiver[0] if receiver else None
            j = pair[j] + 1
        if j >= len(ts) or ts[j].kind != "id":
            return i + 1
        name = ts[j]
        k = j + 1
        if k < len(ts) and ts[k].text == "[":
            k = pair[k] + 1
        if k >= len(ts) or ts[k].text != "(":
            return j
        close = min(pair[k], len(ts))
        parts = _split(ts, pair, k + 1, close)
        variadic = any(t.text == "..." for t in ts[k + 1 : close])
        body, m = None, close + 1
        stop = self._next_line(close)
        while m < stop:
            if ts[m].text == "{" and ts[m - 1].text not in ("struct", "interface"):
                body = m
                break
            m = pair[m] + 1 if ts[m].text in _PAIR else m + 1
        last = ts[(body if body is not None else stop) - 1].end
        q = f"{owner}.{name.text}" if owner else name.text
        fact = dict(
            name=name.text, role="definition" if body is not None else "declaration", owner=owner, owner_kind="record" if owner else None, qualified_name=q, linkage_kind="package", signature=f"{name.text}({', '.join(['_'] * len(parts))})",
            canonical_signature=_squeezed(self.text[ts[i].start : last]), min_arity=len(parts) - variadic, max_arity=None if variadic else len(parts), variadic=variadic, decl_start_line=self._line(i),
            body_start_line=self._line(body) if body is not None else None, body_end_line=self._line(pair[body]) if body is not None else None, **self._at(name),
        )
        self.facts.append(Fact("callable", kind="function", **fact))
        self.facts.append(Fact("declaration", kind="method" if owner else "function", **fact))
        if owner:
            self.facts.append(Fact("member", name=name.text, kind="method", owner=owner, signature=fact["signature"], **self._at(name)))
        fn = self._span(i, pair[body], "fn") if body is not None else {}
        whole = {**fn, "scope_start": fn["fn_start"], "scope_end": fn["fn_end"]} if fn else {}
        for x, y in parts:
            if ts[x].kind == "id" and y - x > 1:
                self.facts.append(Fact("local", name=ts[x].text, kind="parameter", caller=q, detail=_squeezed(self.text[ts[x].end : ts[y - 1].end]), body_start_line=fact["body_start_line"], body_end_line=fact["body_end_line"], **whole, **self._at(ts[x])))
        if body is None:
            return stop
        end = min(pair[body], len(ts))
        scopes = [(body, pair[body])]
        for n in range(body + 1, end):
            t = ts[n]
            while len(scopes) > 1 and n > scopes[-1][1]:
                scopes.pop()
            if t.text == "{":
                scopes.append((n, pair[n]))
            elif t.text in ("if", "for", "switch") and t.kind == "id":
                # What the head declares is seen to the end of its block.
                opens = next((k for k in range(n + 1, end) if ts[k].text == "{" and ts[k - 1].text not in ("struct", "interface")), None)
                scopes.append((n, pair[opens] if opens is not None else end))
            spans = lambda: {**fn, **self._span(*scopes[-1], "scope")}
            if t.text == "(" and ts[n - 1].kind == "id" and ts[n - 1].text not in GO_KEYWORDS:
                selector = ts[n - 2].text == "."
                self.facts.append(Fact("call", name=ts[n - 1].text, form="qualified_name" if selector else "direct_name", n_args=len(_split(ts, pair, n + 1, min(pair[n], len(ts)))), caller=q, **self._at(ts[n - 1])))
            elif t.text == ":=":
                b = n - 1
                while b > body and (ts[b].kind == "id" and ts[b].text not in GO_KEYWORDS or ts[b].text == ","):
                    if ts[b].kind == "id" and ts[b].text != "_":
                        self.facts.append(Fact("local", name=ts[b].text, kind="variable", caller=q, body_start_line=fact["body_start_line"], body_end_line=fact["body_end_line"], **spans(), **self._at(ts[b])))
                    b -= 1
            elif t.text == "var" and n + 1 < end and ts[n + 1].kind == "id":
                self.facts.append(Fact("local", name=ts[n + 1].text, kind="variable", caller=q, body_start_line=fact["body_start_line"], body_end_line=fact["body_end_line"], **spans(), **self._at(ts[n + 1])))
        return end + 1


def fallback(text: str, go: bool) -> list[Fact]:
    """Names of low trust from a text that yields no declaration: identifiers, each at its first place."""
    places, seen, out = Places(text), set(), []
    for t in tokens(text, go):
        if t.kind == "id" and t.text not in (GO_KEYWORDS if go else C_KEYWORDS) and t.text not in seen and t.text.isascii():
            seen.add(t.text)
            line, col = places.line_col(t.start)
            out.append(Fact("fallback", name=t.text, kind="text", start_byte=places.byte(t.start), end_byte=places.byte(t.end), start_line=line, start_character=col, provenance="lexical"))
    return out


def occurrences(text: str, go: bool, known: list[Fact] = ()) -> list[Fact]:
    """Every identifier outside of comments and literals with its syntactic role: definition, declaration, call, write, type_use or read.

    What the facts of the file say about a place goes first: the names of callables, enumerators, objects, fields, parameters and variables; the
    other roles follow from the tokens around.
    """
    ts = tokens(text, go)
    places, out = Places(text), []
    roles: dict[int, str] = {}
    for f in known:
        if f.fact == "callable" or f.fact == "declaration" and f.kind in ("object", "enum_constant"):
            roles[f.start_byte] = f.role if f.fact == "callable" or go else "definition" if f.kind == "enum_constant" else "declaration"
        elif f.fact == "local" or f.fact == "member" and f.kind == "field":
            roles[f.start_byte] = "declaration"
    for i, t in enumerate(ts):
        if t.kind != "id" or t.text in (GO_KEYWORDS if go else C_KEYWORDS):
            continue
        after, before = (ts[i + 1].text if i + 1 < len(ts) else ""), (ts[i - 1] if i else None)
        at = places.byte(t.start)
        if at in roles:
            role = roles[at]
        elif after == "(":
            role = "definition" if (go and before and (before.text in ("func", ")")) and _heads(ts, i)) else "call"
        elif before and before.text in ("struct", "union", "class", "enum", "typename", "type"):
            role = "definition" if after in ("{", "struct", "interface") else "type_use"
        elif after in (":=",) or (before and before.kind == "id" and before.text in ("var", "const") and go):
            role = "declaration"
        elif after in ("=", "+=", "-=", "*=", "/=", "|=", "&=", "^=", "%=", "++", "--", "<<=", ">>="):
            role = "declaration" if before and (before.kind == "id" and before.text not in ("return", "else") or before.text in ("*", "&") and i > 1 and ts[i - 2].text in C_TYPES) and not go else "write"
        elif i + 1 < len(ts) and ts[i + 1].kind == "id" and ts[i + 1].text not in C_KEYWORDS and not go:
            role = "type_use"
        else:
            role = "read"
        line, col = places.line_col(t.start)
        out.append(Fact("occurrence", name=t.text, role=role, start_byte=at, end_byte=places.byte(t.end), start_line=line, start_character=col))
    return out


def _heads(ts: list[Token], i: int) -> bool:
    k = i - 1
    if ts[k].text == ")":
        while k > 0 and ts[k].text != "(":
            k -= 1
        k -= 1
    return k >= 0 and ts[k].text == "func"


def facts_of(path: str | None, text: str | None, wanted: frozenset[str] | None = None) -> list[Fact]:
    """All facts of a file, or those of the wanted kinds; none of a null text. A text without any declaration yields fallback names."""
    if text is None or path is None:
        return []
    ext = path.rsplit(".", 1)[-1].lower()
    go = ext == "go"
    parser = GoFile(text, path) if go else CFamily(text, path, ext not in ("c", "h"))
    try:
        parser.run()
    except (IndexError, StopIteration, ValueError, RecursionError) as e:
        # What was found before stays; the file is counted as failed.
        parser.facts.append(Fact("failure", name=type(e).__name__, detail=str(e) or None))
    found = parser.facts
    if wanted is not None and "occurrence" in wanted:
        found = found + occurrences(text, go, found)
    if (wanted is None or "fallback" in wanted) and text.strip() and not any(f.fact == "declaration" for f in found):
        found = found + fallback(text, go)
    return found if wanted is None else [f for f in found if f.fact in wanted]


def parse_files(files: DataFrame, *, file_id: str, path: str, text: str, wanted: frozenset[str] | None = None) -> DataFrame:
    """Tagged fact rows ``(file_id, path, fact, ...)`` of all files; ``wanted`` names the kinds of fact to make."""
    kind = files.schema[file_id].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, (p, t) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                found = facts_of(p, t, wanted)
                at += [i] * len(found)
                rows += found
            take = pa.array(at, pa.int64())
            cols = [pa.array([getattr(r, n) for r in rows], _ARROW[n]) for n in NAMES]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *cols], ["file_id", "path", *NAMES])

    src = files.select(F.col(file_id).alias("file_id"), F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(parse, f"file_id {kind}, path string, {SCHEMA}")


_ARROW = {n.split()[0]: {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}[n.split()[1]] for n in SCHEMA.split(", ")}


def as_rows(facts: list[Fact]) -> list[dict]:
    """Facts as plain rows, for tests."""
    return [asdict(f) for f in facts]


# --- extras -----------------------------------------------------------------------------------------------------
_ATTRIBUTE = re.compile(r"__attribute__\s*\(\((?:[^()]|\([^()]*\))*\)\)|__declspec\s*\([^()]*\)|\b(?:alignas|_Alignas)\s*\([^()]*\)|\bPROTOBUF_C__(?:BEGIN|END)_DECLS\b|\bPROTOBUF_C__API\b|\b[A-Z][A-Z0-9_]*_(?:API|EXPORT)\b(?=\s+\w)")


def recovery_source(text: str) -> str:
    """The text with attributes and export macros blanked that keep declarations from being recognised; of the same length."""
    return _ATTRIBUTE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


_PROTO = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|[A-Za-z_][\w.]*|\d+|[{}=;]", re.S)


def proto_declarations(text: str | None, most_tokens: int = 262_144) -> list[tuple[str, str, str, int]]:
    """``(kind, name, full name, line)`` of the package, messages, enums, services and their fields in a protocol definition; none of a text with more than ``most_tokens`` tokens."""
    out: list[tuple[str, str, str, int]] = []
    scope: list[tuple[str, str]] = []
    package, words, n = "", [], 0
    line, at = 0, 0
    for m in _PROTO.finditer(text or ""):
        n += 1
        if n > most_tokens:
            return []
        line += text.count("\n", at, m.start())
        at = m.start()
        t = m[0]
        if t.startswith(("//", "/*", '"')):
            continue
        if t == "{":
            kind = words[0] if words else ""
            name = words[1] if len(words) > 1 else kind
            scope.append((kind, name))
            if kind in ("message", "enum", "service"):
                out.append((kind, name, ".".join([*([package] if package else []), *[x for _, x in scope]]), line))
            words = []
        elif t == "}":
            if scope:
                scope.pop()
            words = []
        elif t == ";":
            plain = words[: words.index("=")] if "=" in words else words
            if words[:1] == ["package"] and len(words) > 1:
                package = words[1]
                out.append(("package", package, package, line))
            elif scope and "=" in words and plain and words[0] not in ("option", "reserved"):
                kind = "enum_value" if scope[-1][0] == "enum" else "field"
                out.append((kind, plain[-1], ".".join([*([package] if package else []), *[x for _, x in scope], plain[-1]]), line))
            words = []
        else:
            words.append(t)
    return out


def labels(text: str) -> list[tuple[str, int, str]]:
    """``(label, line, function)`` of the goto labels within functions."""
    file = CFamily(text, "x.c", False)
    bodies = [(f.body_start_line, f.body_end_line, f.name) for f in file.run() if f.fact == "callable" and f.role == "definition"]
    out = []
    ts = file.ts
    for i in range(1, len(ts) - 1):
        if ts[i].kind == "id" and ts[i + 1].text == ":" and ts[i - 1].text in (";", "{", "}", ":") and ts[i].text not in C_KEYWORDS:
            line = file._line(i)
            owner = next((n for a, b, n in bodies if a is not None and a <= line <= b), None)
            if owner:
                out.append((ts[i].text, line, owner))
    return out


def extract_words(text: str, go: bool) -> list[str]:
    """Distinct ASCII identifiers outside of comments and literals, keywords left out, in order."""
    return sorted({t.text for t in tokens(text, go) if t.kind == "id" and t.text.isascii() and t.text not in (GO_KEYWORDS if go else C_KEYWORDS)})
