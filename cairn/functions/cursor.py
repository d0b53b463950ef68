"""What a cursor position in a line or text means: words, prefixes, member chains, calls, intents, comments. Plain functions, and one that applies them to columns in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words that tell what is expected next.
TYPE_CUES = frozenset("struct union enum class typedef using sizeof new".split())
EXPRESSION_CUES = frozenset("= return ( [ , ? : + - * / % & | ! < >".split())
TYPEISH = frozenset("int char short long float double bool void size_t ssize_t unsigned signed auto const static uint8_t uint16_t uint32_t uint64_t int8_t int16_t int32_t int64_t".split())
_IDENT = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_TAIL = re.compile(r"[A-Za-z0-9_]*$")


def utf16_index(line: str, units: int) -> int:
    """Index of the character at a UTF-16 column; the middle of a pair counts as its beginning."""
    if line.isascii():
        return min(units, len(line))
    seen = 0
    for i, ch in enumerate(line):
        seen_after = seen + (2 if ord(ch) > 0xFFFF else 1)
        if seen >= units or seen_after > units:
            return i
        seen = seen_after
    return len(line)


def byte_offset_at(text: str, line: int, column: int) -> int:
    """Byte offset of a line and UTF-16 column; the end of the text beyond its last line."""
    lines = text.splitlines(keepends=True) if "\r" not in text else re.findall(r"[^\n]*\n|[^\n]+\Z", text)
    before = sum(len(x.encode()) for x in lines[:line])
    if line >= len(lines):
        return len(text.encode())
    return before + len(lines[line][: utf16_index(lines[line], column)].encode())


def word_at(line: str, column: int) -> str | None:
    """The identifier at a column, or just before it."""
    at = utf16_index(line, column)
    for m in re.finditer(r"[A-Za-z0-9_]+", line):
        if m.start() <= at <= m.end():
            if at == m.end() and at < len(line) and re.match(r"[A-Za-z0-9_]", line[at]):
                continue
            return m[0] if not m[0][0].isdigit() else None
    return None


def prefix_at(line: str, column: int) -> str | None:
    """What has been typed of an identifier before the column."""
    typed = _TAIL.search(line[: utf16_index(line, column)])[0]
    return typed if typed and not typed[0].isdigit() else None


def member_chain_at(line: str, column: int) -> tuple[str, list[str]] | None:
    """Receiver and completed members of a chain such as ``a.b[i]->`` before the prefix; None for calls, casts and other expressions."""
    before = _TAIL.sub("", line[: utf16_index(line, column)]).rstrip()
    if before.endswith("."):
        before = before[:-1]
    elif before.endswith("->"):
        before = before[:-2]
    else:
        return None
    for start in range(len(before)):
        if start and (re.match(r"[A-Za-z0-9_]", before[start - 1]) or before[start - 1] in ".>])"):
            continue
        parsed = _chain(before, start)
        if parsed and not before[parsed[2] :].strip():
            return parsed[0], parsed[1]
    return None


def _chain(s: str, at: int) -> tuple[str, list[str], int] | None:
    at = re.compile(r"[\s*&]*").match(s, at).end()
    if at < len(s) and s[at] == "(":
        inner = _chain(s, at + 1)
        if inner is None:
            return None
        name, members, at = inner
        at += len(s[at:]) - len(s[at:].lstrip())
        if at >= len(s) or s[at] != ")":
            return None
        at += 1
    else:
        m = _IDENT.match(s, at)
        if not m:
            return None
        name, members, at = m[0], [], m.end()
    while True:
        step = re.compile(r"\s*(?:(\[)|(?:\.|->)\s*([A-Za-z_]\w*))").match(s, at)
        if not step:
            return name, members, at
        if step[1]:
            depth, k = 0, step.end() - 1
            while k < len(s):
                depth += {"[": 1, "]": -1}.get(s[k], 0)
                k += 1
                if depth == 0:
                    break
            if depth:
                return None
            at = k
        else:
            members.append(step[2])
            at = step.end()


def completion_intent(line: str, column: int) -> tuple[str, str]:
    """Intent and confidence of a completion at the column."""
    at = utf16_index(line, column)
    before, after = line[:at], line[at:]
    bare = _TAIL.sub("", before).rstrip()
    directive = re.match(r"\s*#\s*(\w+)", before)
    if directive and directive[1] in ("if", "ifdef", "ifndef", "elif", "define"):
        return "macro_preprocessor", "high"
    if after.lstrip().startswith("("):
        return "call_target", "high"
    token = ""
    if bare:
        token = re.search(r"[\w*&]+$", bare)[0] if re.search(r"[\w*&]$", bare) else bare[-1]
    if token in TYPE_CUES:
        return "type_name", "high"
    if token in ("*", "&", "**", "&&"):
        earlier = re.search(r"(\w+)\s*[*&]+$", bare)
        if earlier and _typeish(earlier[1]):
            return "declaration_name", "medium"
    if token in EXPRESSION_CUES:
        return "expression_value", "medium"
    if token and _typeish(token.strip("*&")):
        return "declaration_name", "medium"
    return "neutral", "low"


def _typeish(word: str) -> bool:
    return word[:1].isascii() and word[:1].isupper() or word in TYPEISH or word.endswith("_t")


def call_at(line: str, column: int) -> tuple[str, int] | None:
    """Name and argument index of the innermost call that is open at the column; text in literals does not count."""
    stack: list[list] = []
    quote = ""
    before = line[: utf16_index(line, column)]
    i = 0
    while i < len(before):
        ch = before[i]
        if quote:
            if ch == "\\":
                i += 1
            elif ch == quote:
                quote = ""
        elif ch in "\"'":
            quote = ch
        elif ch in "([{":
            name = re.search(r"([A-Za-z_]\w*)\s*$", before[:i]) if ch == "(" else None
            stack.append([name[1] if name else None, 0])
        elif ch in ")]}":
            if stack:
                stack.pop()
        elif ch == "," and stack:
            stack[-1][1] += 1
        i += 1
    for name, index in reversed(stack):
        if name and name not in ("if", "for", "while", "switch", "return", "sizeof"):
            return name, index
    return None


def parameter_spans(signature: str) -> list[tuple[int, int]]:
    """Places of the parameters in a signature, by commas at the top of its parameter list."""
    open_at = signature.find("(")
    if open_at < 0:
        return []
    spans, depth, start = [], 0, open_at + 1
    for i in range(open_at, len(signature)):
        ch = signature[i]
        if ch in "([{<":
            depth += 1
        elif ch in ")]}>" and not (ch == ">" and signature[i - 1] == "-"):
            depth -= 1
            if depth == 0:
                spans.append((start, i))
                break
        elif ch == "," and depth == 1:
            spans.append((start, i))
            start = i + 1
    trimmed = []
    for a, b in spans:
        part = signature[a:b]
        if part.strip():
            trimmed.append((a + len(part) - len(part.lstrip()), a + len(part.rstrip())))
    return trimmed


_PARAM = re.compile(r"[@\\]t?param(?:\[[^\]]*\])?\s+(\w+|\.\.\.)\s*(.*)", re.S)
_RETURN = re.compile(r"[@\\]returns?\b\s*(.*)", re.S)


def comment_lines(text: str, line: int) -> list[str]:
    """Lines, without marks, of the comment directly above a line; none across a blank line."""
    lines, out, k, inside = text.split("\n"), [], min(line, text.count("\n") + 1) - 1, False
    while k >= 0:
        s = lines[k].strip()
        if s.startswith("//"):
            out.append(s.lstrip("/!<").strip())
        elif s.endswith("*/") or inside:
            inside = not s.startswith("/*")
            out.append(re.sub(r"^/\*+[!<]?|^\*+(?!/)|\*+/$", "", re.sub(r"\*+/$", "", s)).strip())
        else:
            break
        k -= 1
    return out[::-1] if not inside else []


def comment_markdown(lines: list[str], most: int = 2000) -> str | None:
    """A documentation comment as Markdown: text, then parameters and return value; None without content."""
    blocks: list[list[str]] = [[]]
    for x in lines:
        x = re.sub(r"</?(?:summary|para|remarks|c|code|see)\b[^>]*>", "", x)
        x = re.sub(r'<param name="(\w+)">(.*?)(?:</param>)?$', r"@param \1 \2", x)
        x = re.sub(r"<returns>(.*?)(?:</returns>)?$", r"@return \1", x)
        if re.match(r"[@\\]\w+", x):
            blocks.append([x])
        elif x:
            blocks[-1].append(x)
        else:
            blocks.append([])
    text, params, returns = [], [], []
    for b in (" ".join(b) for b in blocks if b):
        if m := _PARAM.match(b):
            params.append(f"- `{m[1]}`" + (f": {m[2].strip()}" if m[2].strip() else ""))
        elif m := _RETURN.match(b):
            returns.append(m[1].strip())
        elif m := re.match(r"[@\\](?:brief|details|short|note)\b\s*(.*)", b, re.S):
            text.append(m[1])
        elif m := re.match(r"[@\\](\w+)\s*(.*)", b, re.S):
            text.append(f"**{m[1]}** {m[2]}".rstrip())
        else:
            text.append(b)
    out = [t for t in text if t]
    if params:
        out.append("**Parameters**\n" + "\n".join(params))
    if any(returns):
        out.append("**Returns** " + " ".join(r for r in returns if r))
    joined = "\n\n".join(out).strip()
    return (joined if len(joined) <= most else joined[:most] + "…") or None


def source_excerpt(text: str | None, first: int, last: int, most_bytes: int = 128 * 1024, most_lines: int = 2048) -> str | None:
    """Lines ``first`` to ``last``, within the limits of an excerpt."""
    if text is None or first < 0 or last < first:
        return None
    part = "\n".join(text.split("\n")[first : min(last + 1, first + most_lines)])
    return part.encode()[:most_bytes].decode("utf-8", "ignore")


def build_guard(path: str, text: str | None) -> str | None:
    """Build constraint of a Go file from its ``//go:build`` line and the suffixes of its name."""
    parts = []
    for line in (text or "").split("\n"):
        if m := re.match(r"//go:build\s+(.*)", line.rstrip("\r")):
            parts.append(m[1].strip())
            break
        if line.startswith("package "):
            break
    stem = re.sub(r"(_test)?\.go$", "", path.rsplit("/", 1)[-1])
    words = stem.split("_")[1:]
    if words and words[-1] in GOARCH:
        if len(words) > 1 and words[-2] in GOOS:
            parts.append(f"{words[-2]} && {words[-1]}")
        else:
            parts.append(words[-1])
    elif words and words[-1] in GOOS:
        parts.append(words[-1])
    return " && ".join(f"({p})" if len(parts) > 1 and ("||" in p) else p for p in parts) or None


# Names of systems and processors in file names.
GOOS = frozenset("aix android darwin dragonfly freebsd illumos ios js linux netbsd openbsd plan9 solaris wasip1 windows".split())
GOARCH = frozenset("386 amd64 arm arm64 loong64 mips mips64 mips64le mipsle ppc64 ppc64le riscv64 s390x wasm".split())


def apply(df: DataFrame, columns: list[str], function: Callable, schema: str, arrow: pa.Schema, keep: list[str]) -> DataFrame:
    """Apply a plain function of the columns' values to every row in Arrow batches. It gives a list of tuples for ``arrow``: none or several rows for each; ``keep`` columns are carried along."""
    n = len(keep)
    kept = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, values in enumerate(zip(*[batch.column(n + j).to_pylist() for j in range(len(columns))], strict=True)):
                found = function(*values)
                at += [i] * len(found)
                rows += found
            take = pa.array(at, pa.int64())
            made = [pa.array([r[j] for r in rows], f.type) for j, f in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([*[batch.column(j).take(take) for j in range(n)], *made], [*keep, *arrow.names])

    return df.select(*keep, *[F.col(c).alias(f"_{j}") for j, c in enumerate(columns)]).mapInArrow(run, f"{kept}, {schema}")
