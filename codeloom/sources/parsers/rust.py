"""Rust, by tokens and brackets. What stands inside macro calls is not read."""

from __future__ import annotations

from codeloom.sources.parsers.base import Graph, Lexer, Walker, node_id

EXTENSIONS = {".rs"}
LANGUAGE = "rust"
_NOT_CALLS = {"if", "while", "match", "for", "loop", "return", "in", "fn", "let", "mut", "ref", "move", "else", "break", "as", "where", "pub", "impl", "dyn", "unsafe", "async", "await"}


class Rust(Walker):
    def __init__(self, path: str, source: str):
        super().__init__(path, source, LANGUAGE, Lexer(source, quotes='"\'', nested_comments=True, lifetimes=True))
        self.types: dict[str, str] = {}
        for k in range(len(self.t)):
            if self.text(k) in ("struct", "enum", "trait") and self.word(k + 1):
                name = self.t[k + 1].text
                me = node_id(path, name, *self.at(k + 1))
                self.types.setdefault(name, me)

    def start(self, k: int) -> int:
        """Back over pub(...), unsafe, async, const and extern."""
        while k:
            if self.text(k - 1) in ("pub", "unsafe", "async", "const", "default"):
                k -= 1
            elif self.text(k - 1) == ")" and (o := next((i for i in range(k - 2, max(-1, k - 8), -1) if self.text(i) == "("), -1)) > 0 and self.text(o - 1) == "pub":
                k = o - 1
            elif k > 1 and self.t[k - 1].kind == "string" and self.text(k - 2) == "extern":
                k -= 2
            else:
                break
        return k

    def items(self, k: int, stop: int, owner: str | None, kind: str) -> None:
        while k < stop:
            x = self.text(k)
            if x == "#" and self.text(k + 1) in ("[", "!"):
                b = k + 1 if self.text(k + 1) == "[" else k + 2
                k = self.close.get(b, b) + 1
            elif x == "macro_rules" and self.text(k + 1) == "!":
                b = self.find(k + 2, "{ ( [")
                k = self.close[b] + 1 if b > 0 else k + 3
            elif self.word(k) and self.text(k + 1) == "!" and self.text(k + 2) in ("(", "[", "{"):
                k = self.close[k + 2] + 1
            elif x == "use":
                k = self.use(k, owner or self.g.file_id)
            elif x in ("struct", "enum", "trait", "union") and self.word(k + 1):
                k = self.type_(k, x, owner)
            elif x == "impl":
                k = self.impl(k)
            elif x == "mod" and self.word(k + 1) and self.text(k + 2) == "{":
                self.items(k + 3, self.close[k + 2], owner, kind)
                k = self.close[k + 2] + 1
            elif x == "fn" and self.word(k + 1):
                k = self.fn(k, owner, kind)
            elif x == "{":
                self.items(k + 1, self.close[k], owner, kind)
                k = self.close[k] + 1
            else:
                k += 1

    def type_(self, k: int, what: str, owner: str | None) -> int:
        end = self.find(k + 2, "{ ;")
        if end < 0 or what == "union":
            return k + 1
        last = self.close[end] if self.text(end) == "{" else end
        first = self.start(k)
        line, column = self.at(k + 1)
        me = self.g.definition(self.t[k + 1].text, "class", line, column, self.end_line(last), self.code(first, last), owner or self.g.file_id)
        if what == "trait" and self.text(end) == "{":
            self.items(end + 1, last, me, "method")
        return last + 1

    def impl(self, k: int) -> int:
        body = self.find(k + 1, "{ ;")
        if body < 0 or self.text(body) == ";":
            return k + 1
        b = self.skip_angles(k + 1)
        split = next((i for i in range(b, body) if self.text(i) == "for" and self.text(i + 1) != "<"), -1)
        end = next((i for i in range(b, body) if self.text(i) == "where"), body)
        owner = self.types.get(self.code(split + 1 if split > 0 else b, end - 1))
        if split > 0 and owner:
            trait = self.code(b, split - 1)
            if trait in self.types:
                self.g.edge(owner, self.types[trait], "inherits", base_name=trait)
            else:
                self.g.base(owner, trait, *self.at(self.start(k)))
        self.items(body + 1, self.close[body], owner, "method")
        return self.close[body] + 1

    def fn(self, k: int, owner: str | None, kind: str) -> int:
        p = self.skip_angles(k + 2)
        end = self.find(self.close[p] + 1 if self.text(p) == "(" else p, "{ ;")
        if end < 0:
            return k + 1
        if self.text(end) == ";":
            return end + 1  # a signature alone
        last = self.close[end]
        first = self.start(k)
        line, column = self.at(first)
        parent = owner if kind == "method" else self.g.file_id if owner is None else owner
        me = self.g.definition(self.t[k + 1].text, kind, line, column, self.end_line(last), self.code(first, last), parent)
        self.body(end + 1, last, me)
        return last + 1

    def body(self, k: int, stop: int, parent: str) -> None:
        while k < stop:
            x = self.text(k)
            if self.word(k) and self.text(k + 1) == "!" and self.text(k + 2) in ("(", "[", "{"):
                k = self.close[k + 2] + 1
            elif x == "fn" and self.word(k + 1):
                k = self.fn(k, parent, "function")
            elif x in ("struct", "enum", "trait") and self.word(k + 1):
                k = self.type_(k, x, parent)
            elif x == "use":
                k = self.use(k, parent)
            elif x == "impl":
                k = self.impl(k)
            else:
                if self.word(k) and x not in _NOT_CALLS and self.text(k + 1) == "(":
                    self.g.call(x, *self.at(k), parent)
                elif self.word(k) and self.text(k + 1) == "::" and self.text(k + 2) == "<" and self.text(self.skip_angles(k + 2)) == "(":
                    self.g.call(x, *self.at(k), parent)
                k += 1

    def use(self, k: int, parent: str) -> int:
        end = self.find(k, ";")
        end = len(self.t) if end < 0 else end

        def expand(i: int, stop: int, prefix: str) -> None:
            parts, at = prefix, i
            while at < stop:
                x = self.text(at)
                if x == "{":
                    b, close = at + 1, self.close[at]
                    while b < close:
                        e = self.find(b, ",", close)
                        e = close if e < 0 else e
                        expand(b, e, parts)
                        b = e + 1
                    return
                if x == "as":
                    break
                if x == "self" and prefix and at == i:
                    parts = parts.removesuffix("::")
                else:
                    parts += x
                at += 1
            if parts:
                self.g.imported(parts, *self.at(i), parent, self.end_line(max(i, stop - 1)))

        expand(k + 1, end, "")
        return end + 1


def parse(path: str, source: str) -> Graph:
    w = Rust(path, source)
    w.items(0, len(w.t), None, "function")
    return w.g
