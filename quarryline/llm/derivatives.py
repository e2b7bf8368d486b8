"""Recognition by memoised derivatives.

A language is a node: a set of token kinds, a sequence, a choice, a repetition, a reference to a rule, a guard on the
first token or a condition on the next one. The derivative of a node by a token is the node of what may follow; nodes
are interned and each keeps its derivatives, so a state met before costs one dictionary access per token. The empty
derivative marks the exact token that fails; a last derivative that is not nullable means that the text ends too early.

A kind is an even number; the same kind after a line break is the next odd number.
"""

from __future__ import annotations

import re

END = 0
#: Nodes kept before those that the state does not hold are dropped; changes speed only.
MEMORY = 600_000


class Node:
    __slots__ = ("d", "op", "a", "b", "n")

    def __init__(self, op: str, a=None, b=None):
        self.op, self.a, self.b, self.d, self.n = op, a, b, {}, {}


class Grammar:
    """A grammar from text: ``rule = choice ;`` with '...' for tokens, NAMES for token classes, ( ) * + ? and |.

    ``&cond`` is true of the next token without taking it, ``!{ 'a' 'b' } x`` is x not beginning with one of these.
    ``classes`` maps a name to the kinds it stands for; ``conditions`` maps one to a predicate on a kind (odd after a
    line break, END at the end).
    """

    def __init__(self, text: str, start: str, classes: dict[str, set[str]], conditions: dict | None = None):
        self.kinds: dict[str, int] = {}
        self.classes, self.conditions = classes, conditions or {}
        self.source = {}
        for rule in re.split(r";\s*(?:\n|$)", re.sub(r"(?m)^\s*#.*$", "", text)):
            if rule.strip():
                name, _, body = rule.partition("=")
                self.source[name.strip()] = body.strip()
        for members in classes.values():
            for m in sorted(members):
                self.kind(m)
        self.start_rule = start
        self.forget()

    def kind(self, name: str) -> int:
        return self.kinds.setdefault(name, 2 * len(self.kinds) + 2)

    def forget(self) -> None:
        """Drop all nodes and build the rules again."""
        self.made: dict = {}
        self.limit = MEMORY
        self.empty, self.eps = Node("empty"), Node("eps")
        self.rules = {name: Node("ref", name) for name in self.source}
        self.bodies = {name: self._parse(body) for name, body in self.source.items()}
        self.start = self.rules[self.start_rule]

    # building

    def _node(self, op: str, a=None, b=None) -> Node:
        key = (op, id(a) if isinstance(a, Node) else a, id(b) if isinstance(b, Node) else b)
        node = self.made.get(key)
        if node is None:
            node = self.made[key] = Node(op, a, b)
        return node

    def seq(self, a: Node, b: Node) -> Node:
        if a is self.empty or b is self.empty:
            return self.empty
        if a is self.eps:
            return b
        if b is self.eps:
            return a
        if a.op == "seq":
            return self.seq(a.a, self.seq(a.b, b))
        return self._node("seq", a, b)

    def alt(self, nodes) -> Node:
        flat = {}
        for n in nodes:
            for m in n.a if n.op == "alt" else (n,):
                if m is not self.empty:
                    flat[id(m)] = m
        if len(flat) < 2:
            return next(iter(flat.values()), self.empty)
        key = ("alt", frozenset(flat))
        node = self.made.get(key)
        if node is None:
            node = self.made[key] = Node("alt", tuple(flat.values()))
        return node

    def star(self, a: Node) -> Node:
        return self._node("star", a)

    _LEX = re.compile(r"'(?:[^'\\]|\\.)+'|[A-Za-z_]\w*|&\w+|!\{|[()|*+?}]")

    def _parse(self, body: str) -> Node:
        words = self._LEX.findall(body)
        at = 0

        def choice() -> Node:
            nonlocal at
            out = [row()]
            while at < len(words) and words[at] == "|":
                at += 1
                out.append(row())
            return self.alt(out) if len(out) > 1 else out[0]

        def row() -> Node:
            nonlocal at
            parts = []
            while at < len(words) and words[at] not in ("|", ")"):
                parts.append(part())
            out = self.eps
            for p in reversed(parts):
                out = self.seq(p, out)
            return out

        def part() -> Node:
            nonlocal at
            w = words[at]
            at += 1
            if w == "(":
                out = choice()
                at += 1
            elif w == "!{":
                kinds = set()
                while words[at] != "}":
                    kinds.add(self.kind(words[at][1:-1]))
                    at += 1
                at += 1
                return self._node("guard", frozenset(kinds), part())
            elif w[0] == "'":
                out = self._node("tok", frozenset([self.kind(w[1:-1])]))
            elif w[0] == "&":
                out = self._node("look", w[1:])
            elif w in self.classes:
                out = self._node("tok", frozenset(self.kind(m) for m in self.classes[w]))
            elif w == "NEVER":
                out = self.empty
            else:
                out = self.rules[w]
            while at < len(words) and words[at] in "*+?":
                how = words[at]
                at += 1
                out = self.alt([out, self.eps]) if how == "?" else self.star(out) if how == "*" else self.seq(out, self.star(out))
            return out

        return choice()

    # deriving

    def nullable(self, n: Node, t: int) -> bool:
        """Whether n may be empty when t comes next."""
        op = n.op
        if op in ("eps", "star"):
            return True
        if op in ("tok", "empty"):
            return False
        known = n.n.get(t)
        if known is None:
            if op == "seq":
                known = self.nullable(n.a, t) and self.nullable(n.b, t)
            elif op == "alt":
                known = False
                for m in n.a:  # no generator: the depth of a text must not use up the machine's stack
                    if self.nullable(m, t):
                        known = True
                        break
            elif op == "ref":
                known = self.nullable(self.bodies[n.a], t)
            elif op == "guard":
                known = self.nullable(n.b, t)
            elif op == "line":
                known = self.nullable(n.a, t | 1 if t else t)
            else:
                known = bool(self.conditions[n.a](t))
            n.n[t] = known
        return known

    def derive(self, n: Node, t: int) -> Node:
        """What may follow t in n."""
        out = n.d.get(t)
        if out is not None:
            return out
        op = n.op
        if op == "tok":
            out = self.eps if t & ~1 in n.a else self.empty
        elif op == "seq":
            out = self.seq(self.derive(n.a, t), n.b)
            if self.nullable(n.a, t):
                out = self.alt((out, self.derive(n.b, t)))
        elif op == "alt":
            out = self.alt([self.derive(m, t) for m in n.a])
        elif op == "star":
            out = self.seq(self.derive(n.a, t), n)
        elif op == "ref":
            out = self.derive(self.bodies[n.a], t)
        elif op == "guard":
            out = self.empty if t & ~1 in n.a else self.derive(n.b, t)
        elif op == "line":
            out = self.derive(n.a, t | 1)
        else:
            out = self.empty
        n.d[t] = out
        return out

    def after_line(self, n: Node) -> Node:
        """The state n after a line break."""
        return n if n.op == "line" else self._node("line", n)

    def lean(self, state: Node) -> Node:
        """The same state after all nodes that neither it nor a rule holds have been dropped, with their derivatives.

        A text of any length and depth can so be read on in bounded memory: what is dropped is derived again when it is
        needed. Where the state itself is large the limit grows with it, so no text is given up.
        """
        kept, todo = {}, [state, *self.bodies.values(), *self.rules.values()]
        while todo:
            n = todo.pop()
            if id(n) not in kept:
                kept[id(n)] = n
                n.d.clear()
                n.n.clear()
                todo += n.a if n.op == "alt" else [x for x in (n.a, n.b) if isinstance(x, Node)]
        self.empty.d.clear(), self.eps.d.clear()
        self.made = {}
        for n in kept.values():
            if n.op == "alt":
                self.made["alt", frozenset(map(id, n.a))] = n
            elif n.op not in ("empty", "eps", "ref"):
                self.made[n.op, id(n.a) if isinstance(n.a, Node) else n.a, id(n.b) if isinstance(n.b, Node) else n.b] = n
        self.limit = max(MEMORY, 2 * len(self.made))
        return state

    def fresh(self) -> Node:
        """The first state; nodes are dropped when there are too many."""
        if len(self.made) > MEMORY:
            self.forget()
        return self.start
