"""Go, by tokens and brackets."""

from __future__ import annotations

from codeloom.sources.parsers.base import Graph, Lexer, Walker, node_id

EXTENSIONS = {".go"}
LANGUAGE = "go"
_NOT_CALLS = {"func", "if", "for", "switch", "select", "return", "go", "defer", "range", "case", "interface", "struct", "map", "chan", "var", "const", "type"}


class Go(Walker):
    types: dict[str, str]

    def type_body(self, k: int) -> int:
        """Where the { of a struct or interface begins whose name is at k; 0 for other types."""
        i = k + 1
        if self.text(i) == "[" and self.text(self.close[i] + 1) in ("struct", "interface"):
            i = self.close[i] + 1
        return i + 1 if self.text(i) in ("struct", "interface") and self.text(i + 1) == "{" else 0

    def type_spec(self, k: int) -> int:
        body = self.type_body(k)
        if not body:
            return k + 1
        last = self.close[body]
        line, column = self.at(k)
        me = self.g.definition(self.t[k].text, "class", line, column, self.end_line(last), self.code(k, last), self.g.file_id)
        self.types[self.t[k].text] = me
        self.fields(body + 1, last, me)
        return last + 1

    def fields(self, k: int, stop: int, owner: str) -> None:
        """A field of one name alone embeds that type."""
        while k < stop:
            line = self.at(k)[0]
            e = k
            while e < stop and self.at(e)[0] == line and self.text(e) != ";":
                e = self.close[e] + 1 if self.text(e) in ("{", "(", "[") else e + 1
            parts = [i for i in range(k, e) if self.t[i].kind != "string"]
            if parts and self.text(parts[0]) == "*":
                parts = parts[1:]
            if len(parts) == 1 and self.word(parts[0]):
                self.g.base(owner, self.t[parts[0]].text, *self.at(parts[0]))
            elif len(parts) == 3 and self.text(parts[1]) == "." and self.word(parts[2]):
                self.g.base(owner, self.t[parts[2]].text, *self.at(parts[2]))
            k = e + 1 if self.text(e) == ";" else max(e, k + 1)

    def receiver(self, k: int) -> str:
        """The type of the receiver list that opens at k."""
        i, last = self.close[k] - 1, ""
        if self.text(i) == "]":
            i = next((o for o, c in self.close.items() if c == i), i) - 1
        if self.word(i):
            last = self.t[i].text
        return last

    def body(self, k: int, stop: int, parent: str) -> None:
        while k < stop:
            x = self.text(k)
            if self.word(k) and x not in _NOT_CALLS:
                if self.text(k + 1) == "(":
                    self.g.call(x, *self.at(k), parent)
            k += 1


def parse(path: str, source: str) -> Graph:
    w = Go(path, source, LANGUAGE, Lexer(source, quotes="\"'", raw="`"))
    w.types = {}
    n, k, depth0 = len(w.t), 0, []
    while k < n:  # top-level items first, so that methods find their types wherever these stand
        depth0.append(k)
        k = w.close[k] + 1 if w.text(k) in ("{", "(", "[") and k in w.close else k + 1
    specs = []
    for k in depth0:
        if w.text(k) == "type":
            if w.text(k + 1) == "(":
                i, end = k + 2, w.close[k + 1]
                while i < end:
                    if w.word(i) and (w.text(i - 1) in ("(", ";", "}") or w.at(i)[0] != w.at(i - 1)[0]):
                        specs.append(i)
                    i = w.close[i] + 1 if w.text(i) in ("{", "(", "[") else i + 1
            elif w.word(k + 1):
                specs.append(k + 1)
    known = {w.t[s].text: s for s in specs if w.type_body(s)}
    ids = {name: node_id(path, name, *w.at(s)) for name, s in known.items()}
    pending = sorted([(s, "type") for s in specs] + [(k, w.text(k)) for k in depth0 if w.text(k) in ("func", "import")])
    for k, what in pending:
        if what == "type":
            w.type_spec(k)
        elif what == "import":
            stop = w.close[k + 1] if w.text(k + 1) == "(" else k + 4
            for i in range(k + 1, min(stop, n)):
                if w.t[i].kind == "string":
                    line, column = w.at(i)
                    w.g.imported(w.t[i].text.strip("\"`"), line, column, w.g.file_id, line)
                    if w.text(k + 1) != "(":
                        break
        else:
            i, owner, kind = k + 1, w.g.file_id, "function"
            if w.text(i) == "(":
                owner, kind = ids.get(w.receiver(i)), "method"
                i = w.close[i] + 1
            if not w.word(i):
                continue
            name, p = w.t[i].text, i + 1
            if w.text(p) == "[":
                p = w.close[p] + 1
            body = p
            if w.text(p) == "(":
                body = w.close[p] + 1
            line = w.end_line(body - 1)
            while body < n and w.text(body) != "{" and w.at(body)[0] == line:
                if w.text(body) in ("interface", "struct") and w.text(body + 1) == "{":
                    body = w.close[body + 1] + 1
                    continue
                body = w.close[body] + 1 if w.text(body) in ("(", "[") else body + 1
            has = body < n and w.text(body) == "{"
            last = w.close[body] if has else body - 1
            line, column = w.at(k)
            me = w.g.definition(name, kind, line, column, w.end_line(last), w.code(k, last), owner)
            if has:
                w.body(body + 1, last, me)
    return w.g
