"""Tolerant lexers of C, C++ and Go: tokens with their places, comments and literals kept apart, nothing ever refused."""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate
from typing import NamedTuple

# Words that are no names.
C_KEYWORDS = frozenset(
    "alignas alignof asm auto bool break case catch char class co_await co_return co_yield concept const consteval constexpr constinit const_cast continue decltype default delete do double "
    "dynamic_cast else enum explicit export extern false final float for friend goto if inline int long mutable namespace new noexcept nullptr operator override private protected public register "
    "reinterpret_cast requires restrict return short signed sizeof static static_assert static_cast struct switch template this thread_local throw true try typedef typeid typename union unsigned using "
    "virtual void volatile wchar_t while _Atomic _Bool _Noreturn _Static_assert _Thread_local __attribute__ __declspec __inline __restrict defined".split()
)
GO_KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var true false nil iota".split())
C_TYPES = frozenset("void char short int long float double signed unsigned bool wchar_t auto size_t ssize_t int8_t int16_t int32_t int64_t uint8_t uint16_t uint32_t uint64_t uintptr_t intptr_t const volatile struct union enum static inline extern register".split())

_C = re.compile(
    r"""(?P<space>[ \t\r\f\v]+|\\\r?\n)|(?P<nl>\n)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<dir>^[ \t]*\#(?:[^\n\\/]|\\\r?\n|\\.|/\*.*?\*/|/(?!\*))*)
|(?P<str>(?:u8|[uUL])?R"(?P<tag>[^ ()\\\t\n]{0,16})\(.*?\)(?P=tag)"|(?:u8|[uUL])?"(?:[^"\\\n]|\\.)*"?|(?:u8|[uUL])?'(?:[^'\\\n]|\\.)*'?)
|(?P<num>\.?[0-9](?:[eEpP][+-]|'(?=[0-9A-Za-z])|[0-9A-Za-z_.])*)|(?P<id>[^\W\d]\w*)|(?P<punct>::|->\*?|\.\.\.|&&|\|\||[-+*/%&|^<>=!]=|<<|>>|\+\+|--|.)""",
    re.S | re.M | re.X,
)
_GO = re.compile(
    r"""(?P<space>[ \t\r]+)|(?P<nl>\n)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<str>"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?|`[^`]*`?)
|(?P<num>\.?[0-9](?:[eEpP][+-]|[0-9A-Za-z_.])*)|(?P<id>[^\W\d]\w*)|(?P<punct>:=|\.\.\.|&&|\|\||<-|[-+*/%&|^<>=!]=|<<|>>|\+\+|--|.)""",
    re.S | re.M | re.X,
)


class Token(NamedTuple):
    """kind: id, num, str, punct, dir, comment, nl."""

    kind: str
    text: str
    start: int

    @property
    def end(self) -> int:
        return self.start + len(self.text)


def tokens(text: str, go: bool, keep: frozenset[str] = frozenset()) -> list[Token]:
    """All tokens but space; comments and line breaks only if asked for."""
    drop = {"space", "comment", "nl"} - keep
    out = []
    for m in (_GO if go else _C).finditer(text):
        kind = "str" if m.lastgroup == "tag" else m.lastgroup
        if kind not in drop:
            out.append(Token(kind, m[0], m.start()))
    return out


def masked(text: str, go: bool) -> str:
    """The text with comments, literals and their contents blanked, places and line breaks kept."""
    out, at = [], 0
    for m in (_GO if go else _C).finditer(text):
        if m.lastgroup in ("comment", "str", "tag"):
            out.append(text[at : m.start()])
            out.append(re.sub(r"[^\n]", " ", m[0]))
            at = m.end()
    return "".join([*out, text[at:]])


class Places:
    """Turns character offsets into byte offsets, lines and UTF-16 columns."""

    def __init__(self, text: str):
        self.text, self.ascii = text, text.isascii()
        self.starts = [0, *[m.end() for m in re.finditer("\n", text)]]
        if not self.ascii:
            sizes = [len(text[a:b].encode("utf-8", "surrogatepass")) for a, b in zip(self.starts, [*self.starts[1:], len(text)], strict=True)]
            self.bytes = [0, *accumulate(sizes)]  # before each line

    def byte(self, at: int) -> int:
        if self.ascii:
            return at
        line = bisect_right(self.starts, at) - 1
        return self.bytes[line] + len(self.text[self.starts[line] : at].encode("utf-8", "surrogatepass"))

    def line_col(self, at: int) -> tuple[int, int]:
        line = bisect_right(self.starts, at) - 1
        part = self.text[self.starts[line] : at]
        return line, len(part) if self.ascii else len(part.encode("utf-16-le", "surrogatepass")) // 2
