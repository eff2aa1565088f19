"""Memoised parsing with derivatives.

A grammar is a graph of expressions over token classes. The derivative of an
expression by a token is what may follow that token; a text is sound when the
derivative by all its tokens still accepts the end. Expressions are hash-consed
and derivatives memoised, so texts of the same kind share one automaton that is
built as they need it. An empty derivative marks the token at which a text
fails; a last derivative that does not accept the end means that the text stops
too early.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

EMPTY, EPS = 0, 1
MEMO_LIMIT = 1_500_000  # derivatives kept by a process; then the memo starts anew


class Grammar:
    """A grammar in EBNF text.

    ``rule = ...`` on a line, continued on indented lines. lower case: a rule;
    UPPER case: a token class; 'x': the token class x; ( ) group, [ ] optional,
    { } any number, | alternatives. Rules must not be left-recursive. The first
    rule is the start.
    """

    def __init__(self, text: str, other: str | None = None):
        self.classes: dict[str, int] = {}
        self.node: list[tuple] = [("empty",), ("eps",)]
        self.null: list[bool | None] = [False, True]
        self.ids: dict[tuple, int] = {}
        self.rules: dict[str, int] = {}
        self.refs: list[str] = []
        self.memo: dict[int, int] = {}
        self.other = other
        bodies = {}
        for chunk in re.split(r"\n(?=\S)", text.strip()):
            name, body = chunk.split("=", 1)
            bodies[name.strip()] = body
        for name, body in bodies.items():
            toks = re.findall(r"'[^']+'|[A-Za-z_0-9]+|[()\[\]{}|]", body)
            self.rules[name], rest = self._alternatives(toks, 0, bodies)
            assert rest == len(toks), name
        if other is not None:
            self.cls(other)
        self.start = self.rules[next(iter(bodies))]
        self._nullable_rules()
        self.size, self.base = 1 << 12, len(self.node)
        assert len(self.classes) < self.size

    # -- building
    def cls(self, name: str) -> int:
        return self.classes.setdefault(name, len(self.classes))

    def _alternatives(self, toks, i, bodies):
        options = []
        while True:
            parts = []
            while i < len(toks) and toks[i] not in ("|", ")", "]", "}"):
                t = toks[i]
                if t in ("(", "[", "{"):
                    inner, i = self._alternatives(toks, i + 1, bodies)
                    parts.append(inner if t == "(" else self.alt([inner, EPS]) if t == "[" else self.make(("star", inner)))
                elif t[0] == "'":
                    parts.append(self.make(("tok", self.cls(t[1:-1]))))
                elif t in bodies:
                    parts.append(self.make(("ref", t)))
                else:
                    assert t == t.upper(), t
                    parts.append(self.make(("tok", self.cls(t))))
                i += 1
            whole = EPS
            for p in reversed(parts):
                whole = self.cat(p, whole)
            options.append(whole)
            if i < len(toks) and toks[i] == "|":
                i += 1
                continue
            return self.alt(options), i

    def make(self, node: tuple) -> int:
        n = self.ids.get(node)
        if n is None:
            n = self.ids[node] = len(self.node)
            self.node.append(node)
            self.null.append(None)
        return n

    def cat(self, a: int, b: int) -> int:
        if a == EMPTY or b == EMPTY:
            return EMPTY
        if a == EPS:
            return b
        if b == EPS:
            return a
        heads = []
        while self.node[a][0] == "cat":
            heads.append(self.node[a][1])
            a = self.node[a][2]
        out = self.make(("cat", a, b))
        for head in reversed(heads):
            out = self.make(("cat", head, out))
        return out

    def alt(self, options: Iterable[int]) -> int:
        flat = set()
        for o in options:
            node = self.node[o]
            flat.update(node[1]) if node[0] == "alt" else flat.add(o)
        flat.discard(EMPTY)
        if len(flat) < 2:
            return flat.pop() if flat else EMPTY
        return self.make(("alt", tuple(sorted(flat))))

    # -- nullability
    def _nullable_rules(self) -> None:
        true: set[str] = set()
        while True:
            before = len(true)
            for name, body in self.rules.items():
                if name not in true and self._null(body, true):
                    true.add(name)
            if len(true) == before:
                self.null_rules = true
                return

    def _null(self, n: int, true: set[str]) -> bool:
        """Nullability of a rule's body, given the rules known to be nullable."""
        node = self.node[n]
        kind = node[0]
        if kind in ("empty", "tok"):
            return False
        if kind in ("eps", "star"):
            return True
        if kind == "ref":
            return node[1] in true
        return (all if kind == "cat" else any)(self._null(x, true) for x in (node[1:] if kind == "cat" else node[1]))

    def nullable(self, n: int) -> bool:
        null, waiting = self.null, [n]
        while waiting:
            at = waiting[-1]
            node = self.node[at]
            kind = node[0]
            if null[at] is not None:
                waiting.pop()
            elif kind in ("tok", "star", "ref"):
                null[at] = kind == "star" or (kind == "ref" and node[1] in self.null_rules)
            else:
                parts = node[1:] if kind == "cat" else node[1]
                known = [null[x] for x in parts]
                settled = (False in known) if kind == "cat" else (True in known)
                if settled or None not in known:
                    null[at] = (kind == "alt") == settled
                else:
                    waiting.append(parts[known.index(None)])
        return null[n]

    # -- derivatives
    def derive(self, n: int, t: int) -> int:
        """The derivative of an expression by a token class; nested as deep as may be, it takes no call for a level."""
        memo, size, waiting = self.memo, self.size, [n]
        while waiting:
            at = waiting[-1]
            if at * size + t in memo:
                waiting.pop()
                continue
            node = self.node[at]
            kind = node[0]
            if kind == "cat":
                parts = [node[1], node[2]] if self.nullable(node[1]) else [node[1]]
            elif kind == "alt":
                parts = node[1]
            elif kind == "star":
                parts = [node[1]]
            else:
                parts = [self.rules[node[1]]] if kind == "ref" else []
            made = [memo.get(x * size + t) for x in parts]
            if None in made:
                waiting.extend(x for x, m in zip(parts, made, strict=True) if m is None)
                continue
            if kind == "cat":
                out = self.cat(made[0], node[2])
                out = self.alt([out, made[1]]) if len(made) > 1 else out
            elif kind == "alt":
                out = self.alt(made)
            elif kind == "star":
                out = self.cat(made[0], at)
            elif kind == "ref":
                out = made[0]
            else:
                out = EPS if kind == "tok" and node[1] == t else EMPTY
            memo[at * size + t] = out
        return memo[n * size + t]

    def _forget(self) -> None:
        """Drop all memoised derivatives and what was made for them."""
        self.memo.clear()
        for node in self.node[self.base :]:
            del self.ids[node]
        del self.node[self.base :], self.null[self.base :]

    def run(self, tokens: Iterable[str]) -> tuple[str, int]:
        """("sound", n), ("fails", index of the token) or ("ends early", n) for a token sequence.

        A class the grammar does not name counts as ``other``, or fails.
        """
        if len(self.memo) > MEMO_LIMIT:
            self._forget()
        state, memo, size, classes = self.start, self.memo, self.size, self.classes
        other = classes.get(self.other, -1) if self.other else -1
        i = -1
        for i, name in enumerate(tokens):
            t = classes.get(name, other)
            if t < 0:
                return "fails", i
            after = memo.get(state * size + t)
            state = self.derive(state, t) if after is None else after
            if state == EMPTY:
                return "fails", i
        return ("sound" if self.nullable(state) else "ends early"), i + 1
