"""Java, by tokens and brackets."""

from __future__ import annotations

from codeloom.sources.parsers.base import Graph, Lexer, Walker

EXTENSIONS = {".java"}
LANGUAGE = "java"
_TYPES = {"class", "interface", "enum", "record"}
_NOT_CALLS = {"if", "for", "while", "switch", "catch", "synchronized", "return", "throw", "try", "assert", "super", "this", "do", "else", "case", "yield"}
_MODIFIERS = {"public", "private", "protected", "static", "final", "abstract", "native", "synchronized", "default", "strictfp", "transient", "volatile", "sealed", "non"}


class Java(Walker):
    def start_of_member(self, k: int, floor: int) -> int:
        """Back over modifiers, annotations and types to where a member begins."""
        i = k
        while i - 1 >= floor:
            x = self.text(i - 1)
            if x in ("{", "}", ";") or self.t[i - 1].kind == "punct" and x in ("=", "->"):
                break
            i -= 1
        return i

    def bases(self, child: str, k: int, stop: int) -> None:
        """Plain type names of a list: generics are cut off, qualified names are not plain."""
        while k < stop:
            if self.word(k):
                after = k + 1
                plain = self.text(after) != "." and self.text(k - 1) != "."
                generic = self.text(after) == "<"
                if plain and not generic:
                    self.g.base(child, self.t[k].text, *self.at(k))
                k = self.skip_angles(after)
            else:
                k += 1

    def type_(self, k: int, parent: str, floor: int) -> int:
        """A type whose keyword is at k; where it ends."""
        name = self.t[k + 1].text
        first = self.start_of_member(k, floor)
        body = self.find(k + 2, "{ ;")
        if body < 0 or self.text(body) == ";":
            return k + 1
        last = self.close[body]
        line, column = self.at(first)
        me = self.g.definition(name, "class", line, column, self.end_line(last), self.code(first, last), parent)
        i = self.skip_angles(k + 2)
        if self.text(i) == "(":
            i = self.close[i] + 1
        at = None
        while i <= body:
            x = self.text(i)
            if x in ("extends", "implements", "permits", "{"):
                if at is not None:
                    self.bases(me, at, i)
                at = i + 1 if x in ("extends", "implements") else None
                i += 1
            else:
                i = max(i + 1, self.skip_angles(i))
        self.members(body + 1, last, me, name)
        return last

    def members(self, k: int, stop: int, owner: str, name: str) -> None:
        floor = k
        while k < stop:
            x = self.text(k)
            if x == "@" and self.text(k + 1) == "interface":
                body = self.find(k, "{")
                k = self.close[body] + 1 if body > 0 else k + 1
                floor = k
            elif x == "@" and self.word(k + 1):
                k += 2
                while self.text(k) == ".":
                    k += 2
                if self.text(k) == "(":
                    k = self.close[k] + 1
            elif x in _TYPES and self.word(k + 1) and self.text(k - 1) != "." and (x != "record" or self.text(self.skip_angles(k + 2)) == "("):
                k = self.type_(k, owner, floor) + 1
                floor = k
            elif self.word(k) and self.text(k + 1) == "(" and (self.word(k - 1) or self.text(k - 1) in (">", "]") or x == name) and self.text(k - 1) not in ("new", "return", "."):
                params = self.close[k + 1]
                end = self.find(params + 1, "{ ; =", stop)
                if end > 0 and self.text(end) != "=":
                    first = self.start_of_member(k, floor)
                    last = self.close[end] if self.text(end) == "{" else end
                    line, column = self.at(first)
                    me = self.g.definition(x, "method", line, column, self.end_line(last), self.code(first, last), owner)
                    self.body(end + 1, last, me)
                    k = floor = last + 1
                else:
                    k += 1
            elif x == "{":
                self.body(k + 1, self.close[k], owner)
                k = floor = self.close[k] + 1
            elif x == "=":
                end = self.find(k, ";", stop)
                end = stop if end < 0 else end
                self.body(k + 1, end, owner)
                k = floor = end + 1
            elif x in (";", ","):
                k += 1
                floor = k if x == ";" else floor
            else:
                k += 1

    def body(self, k: int, stop: int, parent: str) -> None:
        while k < stop:
            x = self.text(k)
            if x == "new" and self.word(k + 1):
                i = k + 1
                while self.text(i + 1) == "." and self.word(i + 2):
                    i += 2
                after = self.skip_angles(i + 1)
                if self.text(after) == "(":
                    self.g.call(self.t[i].text, *self.at(i), parent)
                    body = self.close[after] + 1
                    self.body(after + 1, body - 1, parent)
                    k = body
                    if self.text(k) == "{":
                        self.members(k + 1, self.close[k], parent, "")
                        k = self.close[k] + 1
                else:
                    k = after
            elif x in _TYPES and self.word(k + 1) and self.text(k - 1) in ("{", "}", ";", *_MODIFIERS) and self.text(self.skip_angles(k + 2)) in ("{", "extends", "implements", "(") and x != "record":
                k = self.type_(k, parent, k) + 1
            elif self.word(k) and self.text(k + 1) == "(" and x not in _NOT_CALLS:
                self.g.call(x, *self.at(k), parent)
                k += 1
            else:
                k += 1


def parse(path: str, source: str) -> Graph:
    w = Java(path, source, LANGUAGE, Lexer(source))
    k, floor = 0, 0
    while k < len(w.t):
        x = w.text(k)
        if x in ("package", "import"):
            end = w.find(k, ";")
            end = len(w.t) if end < 0 else end
            if x == "import":
                b = k + 2 if w.text(k + 1) == "static" else k + 1
                name = "".join(w.t[i].text for i in range(b, end))
                line, column = w.at(k)
                w.g.imported(name, line, column, w.g.file_id, w.end_line(end))
            k = floor = end + 1
        elif x == "@" and w.text(k + 1) == "interface":
            body = w.find(k, "{")
            k = floor = w.close[body] + 1 if body > 0 else k + 2
        elif x in _TYPES and w.word(k + 1):
            k = floor = w.type_(k, w.g.file_id, floor) + 1
        elif x == "(":
            k = w.close[k] + 1
        else:
            k += 1
    return w.g
