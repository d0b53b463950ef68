"""Memoised parsing with derivatives over token classes.

A language is an expression of hash-consed nodes; its derivative by a token class is again such an expression, and each
(expression, class) pair is derived once and then looked up. Non-terminals are opened only when derived, so the grammars
are context-free; they have to be free of left recursion. The derivative becoming the empty language marks the failing
token; an end at which the expression is not nullable means that the text breaks off.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

#: Memo entries kept per grammar before it starts afresh (a bound on a worker's memory, not on any input).
MEMO_ENTRIES = 400_000


class Node:
    """One expression. kind: 0 nothing, 1 empty word, 2 token set, 3 sequence, 4 choice, 5 non-terminal."""

    __slots__ = ("kind", "a", "b", "nullable", "memo")

    def __init__(self, kind: int, a: object = None, b: object = None, nullable: bool = False):
        self.kind, self.a, self.b, self.nullable, self.memo = kind, a, b, nullable, {}


class Grammar:
    """Builds and derives the expressions of one language. Non-terminals are declared with their nullability."""

    def __init__(self) -> None:
        self.none, self.empty = Node(0), Node(1, nullable=True)
        self._made: dict[tuple, Node] = {}
        self._rules: dict[str, Node] = {}
        self._fixed: dict[tuple, Node] = {}
        self.entries = 0

    # --- constructors, which simplify and share ----------------------------------------------------------------
    def _node(self, key: tuple, make: Callable[[], Node]) -> Node:
        found = self._made.get(key)
        if found is None:
            found = self._made[key] = make()
        return found

    def tok(self, *classes: str) -> Node:
        return self._node((2, frozenset(classes)), lambda: Node(2, frozenset(classes)))

    def seq(self, *parts: Node) -> Node:
        out = self.empty
        for p in reversed(parts):
            out = self._pair(p, out)
        return out

    def _pair(self, a: Node, b: Node) -> Node:
        if a.kind == 0 or b.kind == 0:
            return self.none
        if a.kind == 1:
            return b
        if b.kind == 1:
            return a
        if a.kind == 3:  # right-nested, so that a derivative touches the head only
            return self._pair(a.a, self._pair(a.b, b))
        return self._node((3, id(a), id(b)), lambda: Node(3, a, b, a.nullable and b.nullable))

    def alt(self, *parts: Node) -> Node:
        flat: dict[int, Node] = {}
        for p in parts:
            if p.kind == 4:
                flat.update((id(x), x) for x in p.a)
            elif p.kind:
                flat[id(p)] = p
        if not flat:
            return self.none
        if len(flat) == 1:
            return next(iter(flat.values()))
        return self._node((4, frozenset(flat)), lambda: Node(4, tuple(flat.values()), nullable=any(x.nullable for x in flat.values())))

    def ref(self, name: str, nullable: bool = False) -> Node:
        return self._node((5, name), lambda: Node(5, name, nullable=nullable))

    def rule(self, name: str, body: Node) -> None:
        """Give the non-terminal its body, whose nullability has to be the declared one."""
        if body.nullable != self._made[(5, name)].nullable:
            raise ValueError(f"{name}: nullability differs from the declared one")
        self._rules[name] = body

    def seal(self) -> None:
        """The grammar is complete; what exists now is never forgotten."""
        self._fixed = dict(self._made)

    # --- derivation ---------------------------------------------------------------------------------------------
    def derive(self, e: Node, c: str) -> Node:
        found = e.memo.get(c)
        if found is not None:
            return found
        kind = e.kind
        if kind == 2:
            out = self.empty if c in e.a else self.none
        elif kind == 3:
            out = self._pair(self.derive(e.a, c), e.b)
            if e.a.nullable:
                out = self.alt(out, self.derive(e.b, c))
        elif kind == 4:
            out = self.alt(*[self.derive(x, c) for x in e.a])
        elif kind == 5:
            out = self.derive(self._rules[e.a], c)
        else:
            out = self.none
        e.memo[c] = out
        self.entries += 1
        return out

    def relax(self) -> None:
        """Between two texts: forget derived expressions once there are too many."""
        if self.entries > MEMO_ENTRIES:
            for n in self._made.values():
                n.memo = {}
            self._made = dict(self._fixed)
            self.entries = 0


def run(grammar: Grammar, start: Node, classes: Iterable[str]) -> tuple[str, int]:
    """``("valid", n)``, ``("broken", index of the failing token)`` or ``("truncated", n)``.

    The classes ``#if``, ``#elif`` (also for else, then as ``#else``) and ``#endif`` fork and join: the expression after a conditional is
    the choice of those after its branches, so a text counts as valid if some setting makes it so. ``cut`` marks a literal or comment that the
    end of the text leaves open.
    """
    grammar.relax()
    state, forks, i = start, [], -1
    none, derive = grammar.none, grammar.derive
    for i, c in enumerate(classes):
        nxt = state.memo.get(c)
        if nxt is None:
            if c[0] == "#" and len(c) > 1:
                if c == "#if":
                    forks.append((state, none, False))
                    continue
                if not forks:
                    return "broken", i
                entry, so_far, closed = forks.pop()
                so_far = grammar.alt(so_far, state)
                if c == "#endif":
                    state = so_far if closed else grammar.alt(so_far, entry)
                    if state is none:
                        return "broken", i
                    continue
                if closed:
                    return "broken", i
                forks.append((entry, so_far, c == "#else"))
                state = entry
                continue
            if c == "cut":
                return ("broken", i) if state is none and not forks else ("truncated", i)
            nxt = derive(state, c)
        state = nxt
        if nxt is none and not forks:
            return "broken", i
    if forks:
        return "truncated", i + 1
    return ("valid" if state.nullable else "truncated"), i + 1
