"""Functions paired with their documentation (problem 5).

Per file: one pass over comments, literals and braces gives the comment spans and the nesting; signatures are found by
regular expressions outside comments, bodies are delimited by a stack (of braces, of indentation, or of words that an end word
closes, by the file's extension), and the comment lines that stand directly above a signature are attached by their distance in
lines. Each branch of a conditional directive starts from the stack at its beginning; a brace that several branches open is
closed for all of them at once. A body without an end has no code. The description is what those lines say about the function.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that have to remain for a description.
LEAST_WORDS = 5

_SPANS = re.compile(r"""^[ \t]*\#[ \t]*(?P<dir>if|ifdef|ifndef|elif|elifdef|elifndef|else|endif)\b|//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|[{}]""", re.S | re.M)
_GO_HEAD = re.compile(r"^func[ \t]*(?:\([^()\n]*\)[ \t]*)?([^\W\d]\w*)[ \t]*(?:\[[^\]\n]*\])?\(", re.M)
_GO_FILE = re.compile(r"^package[ \t]+\w+[ \t]*(?://.*)?\r?$", re.M)
# A name before its parameter list, at the start of a line or after type words; then anything but a semicolon up to the body.
_C_HEAD = re.compile(r"^[ \t]*(?:[\w:<>,*&~\[\] \t]*[\s*&:~])?(~?[^\W\d]\w*|operator[^\s(\w]{1,3})[ \t]*\(", re.M)
_NOT_NAMES = frozenset("func if for while switch return sizeof catch do else case defined alignof decltype static_assert __attribute__ __declspec alignas".split())
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-zà-öø-ÿ]+|[^\W\d_A-Za-z]+|\d+")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")

# --- what may stand between a comment and its function -----------------------------------------------------------
_BETWEEN = re.compile(r"""\s*(?:\[\[.*\]\]|__\w+__\s*\(.*\)|__declspec\s*\(.*\)|template\s*<.*>?|requires\b.*|@\w+(?:\(.*\))?|\#\s*pragma\b.*|[A-Z][A-Z0-9_]{2,}(?:\s*\(.*\))?)\s*$""")
# --- lines of a comment that are no description -------------------------------------------------------------------
_DIRECTIVE = re.compile(
    r"""\s*(?:[a-z][\w-]*:[a-z]|NOLINT\w*|nolint\b|clang-format\b|clang-tidy\b|go:\w+|\+build\b|cppcheck-suppress\b|LCOV_\w+|GCOVR?_\w+|GCOV_\w+|IWYU\b|lint:|lint\s*-|NOSONAR|nosec\b|\#nosec|coverity\b|PVS-|eslint|
    astyle\b|uncrustify\b|INDENT-O|\*INDENT-O|noinspection\b|export\s+\w+$|cgo\b|line\s+\S+:\d+|-\*-|vi:|vim:|ex:|fall-?through\b|FALLTHRU|SPDX-|@(?:cond|endcond)\b|\\(?:cond|endcond)\b|@formatter|doxygen\s+(?:off|on)\b|sparse:|codespell)""",
    re.X,
)
_LICENCE = re.compile(r"copyright\b|\(c\)\s*\d|©|SPDX-|licen[sc]ed?\s+(?:under|to)\b|all rights reserved|\blicen[sc]e\b.*\b(?:file|terms|text|details|version|copy)\b|without warranty|permission is hereby|redistribution and use|\bpart of the [\w-]+ (?:source )?(?:tree|project|package|library)\b", re.I)
_TODO = re.compile(r"\s*(?:[@\\]todo\b|(?:TODO|FIXME|XXX|HACK|TBD|WIP)\b)")
_CODE = re.compile(
    r"""^\s*(?:[{}()\[\];,]+\s*$|\#\s*(?:if|ifdef|ifndef|else|endif|define|include|undef)\b.*|(?:else\b|\}\s*else\b).*[{]?\s*$|.*[{;]\s*$(?<=[){;])(?<!\w;)|(?:if|for|while|switch)\s*\(.*|return\b[^.]*;\s*$|(?:const\s+|static\s+|unsigned\s+)*\w+[\s*&]+\w+\s*=.*;\s*$|[\w.\->:]+\s*(?:[-+*/|&^]?=|:=)\s*[^=\s].*|[\w.\->:]+\s*\(.*\)\s*[;{]?\s*$|[\w.\->:]+(?:\+\+|--);?\s*$|func\s+\w*\s*\(.*|defer\s+.*\(.*|(?:case\s+\S+|default):\s*$|break;\s*$|continue;\s*$)""",
    re.X,
)
_TAG = re.compile(r"\{@\w+[^}]*\}|[@\\]\w+(?:\{[^}]*\})?|</?\w+(?:\s+\w+=(?:\"[^\"]*\"|'[^']*'))*\s*/?>")
_PARAM_TAG = re.compile(r"[@\\](?:param|tparam|retval|throws?|exception)\b(?:\s*\[[^\]]*\])?\s+[\w.:*&]+(?:\s*,\s*[\w.:*&]+)*")


@dataclass
class Documented:
    """A function with its name, the lines of name, head and end (None for a body without an end), and the words of its description."""

    name: str
    name_line: int
    head_line: int
    end_line: int | None
    description: str
    n_words: int


def _lines_at(text: str) -> list[int]:
    starts, at = [0], text.find("\n")
    while at >= 0:
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    return starts


def _inner(line: str, block: bool) -> str:
    """A comment line without its marks."""
    line = line.strip()
    if not block:
        return re.sub(r"^//+[!<]?", "", line)
    line = re.sub(r"^/\*+[!<]?", "", line)
    line = re.sub(r"\**\*/$", "", line)
    return re.sub(r"^\s*\*+(?!/)", "", line)


def describe(lines: list[str], name: str) -> tuple[str, int]:
    """The description in comment lines without marks, and its number of words beside tags, their arguments' names and the function's own name."""
    kept: list[str] = []
    todo = False
    for line in lines:
        if not line.strip():
            todo = False
            kept.append("")
            continue
        if _TODO.match(line):
            todo = True
            continue
        if _DIRECTIVE.match(line) or _LICENCE.search(line):
            continue
        if todo and not re.match(r"\s*[@\\]\w+", line):
            continue  # a note that runs on
        todo = False
        if _CODE.match(line):
            continue
        kept.append(line)
    said = " ".join(x.strip() for x in kept).strip()
    bare = _TAG.sub(" ", _PARAM_TAG.sub(" ", said))
    own = {p.lower() for p in _PARTS.findall(name)} | {name.lower()}
    n = 0
    for w in re.sub(rf"(?<!\w){re.escape(name)}(?!\w)", " ", bare).split():
        n += sum(1 for x in _WORD.findall(w) if x.lower() not in own)
    return said, n


def _braces(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]], dict[int, int]]:
    """Spans of comments and literals, those of comments alone, and the place of the closing brace of each opening one."""
    spans: list[tuple[int, int]] = []
    comments: list[tuple[int, int]] = []
    closing: dict[int, int] = {}
    stack: list[tuple[int, ...]] = []  # opening braces; more than one place where branches of a conditional open the same
    forks: list[list] = []  # stack before the conditional, stack after its first branches or None
    for m in _SPANS.finditer(text):
        first = text[m.start()]
        if first == "{":
            stack.append((m.start(),))
        elif first == "}":
            if stack:
                closing.update(dict.fromkeys(stack.pop(), m.start()))
        elif m["dir"]:
            word = m["dir"]
            if word.startswith("if"):
                forks.append([list(stack), None])
            elif forks:
                before, ended = forks[-1]
                if ended is None:
                    ended = stack
                elif len(ended) == len(stack):
                    ended = [p if p == q else (*p, *q) for p, q in zip(ended, stack, strict=True)]
                if word == "endif":
                    stack = ended
                    forks.pop()
                else:
                    forks[-1][1], stack = ended, list(before)
        else:
            spans.append(m.span())
            if first == "/":
                comments.append(m.span())
    return spans, comments, closing


def extract(text: str | None, every: bool = False) -> list[Documented]:
    """Functions of C, C++ or Go with a body that have comment lines directly above, or all with a body, in the order of the file. A null text has none."""
    if not text:
        return []
    starts = _lines_at(text)
    spans, comments, closing = _braces(text)
    if not comments and not every:
        return []
    # Lines that hold nothing but a comment or a part of one.
    own: dict[int, bool] = {}
    for s, e in comments:
        a, b = bisect_right(starts, s) - 1, bisect_right(starts, max(s, e - 1)) - 1
        line_end = starts[b + 1] - 1 if b + 1 < len(starts) else len(text)
        if not text[starts[a] : s].strip() and not text[e:line_end].strip():
            block = text[s + 1] == "*"
            for k in range(a, b + 1):
                own[k] = block
    if not own and not every:
        return []
    lines = text.split("\n")
    begins = [s for s, _ in spans]
    out, seen = [], set()
    for head in (_GO_HEAD,) if _GO_FILE.search(text) else (_C_HEAD,):
        for m in head.finditer(text):
            name, at = m[1], m.start(1)
            if name in _NOT_NAMES:
                continue
            i = bisect_right(begins, at) - 1
            if i >= 0 and spans[i][1] > at:
                continue  # inside a comment or a literal
            top = m.start() + len(m[0]) - len(m[0].lstrip())
            top_line = bisect_right(starts, top) - 1
            name_line = bisect_right(starts, at) - 1
            if top_line in own:
                top_line = name_line
            # Type words may stand on lines of their own above the name.
            while top_line > 0 and (top_line - 1) not in own and re.fullmatch(r"\s*(?:[\w:*&<>, ]|\[\[.*\]\])*[\w*&>]\s*", lines[top_line - 1]) and not _BETWEEN.match(lines[top_line - 1]):
                top_line -= 1
            said = _above(lines, own, top_line)
            if not (said or every) or (name, name_line) in seen:
                continue
            opens = _body(text, m.end() - 1, spans, begins)
            if opens is None:
                continue
            seen.add((name, name_line))
            description, n = describe(said, name)
            end = closing.get(opens)
            out.append(Documented(name, name_line, top_line, None if end is None else bisect_right(starts, end) - 1, description, n))
    return sorted(out, key=lambda d: d.name_line)


# --- languages without braces ---------------------------------------------------------------------------------------
_DEF = re.compile(r"^([ \t]*)(?:async[ \t]+)?def[ \t]+([^\W\d]\w*)")
_DOCSTRING = re.compile(r"""\s*[rRuU]{0,2}(\"{3}|'{3}|"|')(.*?)\1""", re.S)
#: Per extension: how a function begins, words that open a block that ``end`` closes, and the mark of a comment.
_ENDED = {
    "rb": (re.compile(r"^[ \t]*def[ \t]+(?:self\.)?([^\W\d]\w*[?!]?)"), re.compile(r"^[ \t]*(?:def|class|module|if|unless|while|until|case|begin|for)\b|\bdo\b(?:[ \t]*\|[^|]*\|)?[ \t]*$|=[ \t]*(?:if|case|begin|unless)\b", re.M), "#"),
    "lua": (re.compile(r"^[ \t]*(?:local[ \t]+)?function[ \t]+(?:[\w.]+[.:])?([^\W\d]\w*)"), re.compile(r"\b(?:function|do|then)\b"), "--"),
}
_STRINGS = re.compile(r"""\"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'""")


def _marked(lines: list[str], top: int, mark: str) -> list[str]:
    """Comment lines directly above line ``top``, without marks; lines with decorators may lie between."""
    found, k = [], top - 1
    while k >= 0 and (lines[k].lstrip().startswith((mark, "@")) and lines[k].strip()):
        if lines[k].lstrip().startswith(mark):
            found.append(lines[k].strip().lstrip(mark[0]))
        k -= 1
    return found[::-1]


def extract_indented(text: str | None) -> list[Documented]:
    """Functions delimited by indentation, with the comment above or the docstring; a stack holds the indentation of those that are open."""
    if not text:
        return []
    lines = text.split("\n")
    found: list[Documented] = []
    open_: list[tuple[int, int, str]] = []  # indentation, line, name
    last, quote = -1, None

    def close(indent: int) -> None:
        while open_ and open_[-1][0] >= indent:
            _, k, name = open_.pop()
            if last > k:
                said = _marked(lines, k, "#")
                head_end = next((i for i in range(k, last + 1) if lines[i].split("#")[0].rstrip().endswith(":")), k)
                if m := _DOCSTRING.match("\n".join(lines[head_end + 1 : last + 1])):
                    said += [x.strip() for x in m[2].split("\n")]
                description, n = describe(said, name)
                found.append(Documented(name, k, k, last, description, n))

    for k, line in enumerate(lines):
        inside = quote
        for q in re.findall(r'\"{3}|\'{3}', line):
            quote = q if quote is None else None if quote == q else quote
        if not line.strip():
            continue
        if inside is None and not line.lstrip().startswith(("#", ")", "]", "}")):
            indent = len(line.expandtabs()) - len(line.expandtabs().lstrip())
            close(indent)
            if m := _DEF.match(line):
                open_.append((indent, k, m[2]))
        if not line.lstrip().startswith("#"):
            last = k
    close(0)
    return sorted(found, key=lambda d: d.name_line)


def extract_ended(text: str | None, extension: str) -> list[Documented]:
    """Functions of a language whose blocks an end word closes, with the comment above; a stack holds the open blocks."""
    if not text:
        return []
    head, opener, mark = _ENDED[extension]
    lines = text.split("\n")
    found: list[Documented] = []
    stack: list[tuple[int, str | None]] = []
    for k, line in enumerate(lines):
        code = _STRINGS.sub('""', line).split(mark)[0]
        m = head.match(code)
        opened = len(opener.findall(code))
        stack += [(k, m[1] if m and i == 0 else None) for i in range(opened)]
        for _ in range(len(re.findall(r"(?<![\w.:])end(?!\w)", code))):
            if stack:
                at, name = stack.pop()
                if name:
                    description, n = describe(_marked(lines, at, mark), name)
                    found.append(Documented(name, at, at, k, description, n))
    for at, name in stack:
        if name:
            description, n = describe(_marked(lines, at, mark), name)
            found.append(Documented(name, at, at, None, description, n))
    return sorted(found, key=lambda d: d.name_line)


def functions_of(path: str | None, text: str | None, every: bool = False) -> list[Documented]:
    """Functions of a file by the extension of its path; without a path by braces."""
    extension = (path or "").rsplit(".", 1)[-1].lower()
    if extension == "py":
        return extract_indented(text)
    if extension in _ENDED:
        return extract_ended(text, extension)
    return extract(text, every)


def _body(text: str, paren: int, spans: list[tuple[int, int]], begins: list[int]) -> int | None:
    """Place of the brace that opens the body after the parameter list at ``paren``; None for a mere declaration."""
    depth, at, n = 0, paren, len(text)
    while at < n:
        i = bisect_right(begins, at) - 1
        if i >= 0 and spans[i][0] <= at < spans[i][1]:
            at = spans[i][1]
            continue
        ch = text[at]
        if ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
            if depth < 0:
                return None
        elif depth == 0 and ch == "{":
            return at
        elif depth == 0 and (ch == ";" or ch == "="):
            return None
        at += 1
    return None


def _above(lines: list[str], own: dict[int, bool], top: int) -> list[str]:
    """Comment lines directly above line ``top``, top down, without marks; annotations, template heads and directives may lie between."""
    found: list[str] = []
    k = top - 1
    while k >= 0:
        if k in own:
            found.append(_inner(lines[k], own[k]))
        elif not _BETWEEN.match(lines[k]) or not lines[k].strip():
            break
        k -= 1
    return found[::-1]


def documented_functions(files: DataFrame, *, file_id: str, text: str, path: str | None = None, least_words: int = LEAST_WORDS) -> DataFrame:
    """``(file_id, name, name_line, end_line, description, n_words, code)`` of every function whose description has ``least_words`` words; of all functions for 0.

    ``code`` is the lines from the head, return type included, to the end of the body; it and ``end_line`` are null where the body has no end. Lines
    count from 0. Whole texts, no shuffle; null texts have no functions, repeated rows give repeated results. Without ``path`` all texts are read by braces.
    """
    kind = files.schema[file_id].dataType.simpleString()
    names = ["file_id", "name", "name_line", "end_line", "description", "n_words", "code"]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cols = [], [[] for _ in names[1:]]
            for i, (p, t) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                got = [d for d in functions_of(p, t, least_words == 0) if d.n_words >= least_words]
                lines = t.split("\n") if got else []
                for d in got:
                    ids.append(i)
                    code = None if d.end_line is None else "\n".join(lines[d.head_line : d.end_line + 1])
                    for c, v in zip(cols, (d.name, d.name_line, d.end_line, d.description, d.n_words, code), strict=True):
                        c.append(v)
            types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names)

    where = F.col(path).cast("string") if path else F.lit(None).cast("string")
    return files.select(F.col(file_id).alias("file_id"), where.alias("path"), F.col(text).cast("string").alias("text")).mapInArrow(
        pairs, f"file_id {kind}, name string, name_line int, end_line int, description string, n_words int, code string"
    )


def matched_anchors(functions: DataFrame, anchors: DataFrame, *, anchor_id: str, file_id: str, name: str, name_range: str) -> DataFrame:
    """``(anchor_id)`` of the definitions among ``anchors`` that the functions are, once each."""
    a = anchors.select(F.col(anchor_id).alias("anchor_id"), F.col(file_id).alias("file_id"), F.col(name).alias("name"), F.col(f"{name_range}.start_line").alias("name_line"))
    f = functions.select("file_id", "name", "name_line").distinct()
    return a.join(f, ["file_id", "name", "name_line"], "left_semi").select("anchor_id").distinct()
