"""TypeScript and JavaScript, by tokens and brackets."""

from __future__ import annotations

from codeloom.sources.parsers.base import Graph, Lexer, Walker

EXTENSIONS = set(".cjs .js .jsx .mjs .ts .tsx".split())
LANGUAGE = "typescript"
_NOT_CALLS = {"if", "for", "while", "switch", "catch", "return", "typeof", "function", "await", "new", "delete", "void", "in", "of", "throw", "import", "super", "with", "do", "else", "case", "yield", "instanceof"}
_MODIFIERS = {"public", "private", "protected", "static", "readonly", "abstract", "override", "async", "get", "set", "declare", "accessor"}


class TypeScript(Walker):
    def after_type(self, k: int, stop: int) -> int:
        """Past a return type, to the { of a body, the => of an arrow, or what ends a signature."""
        if self.text(k) != ":":
            return k
        k += 1
        first = True
        while k < stop:
            x = self.text(k)
            if x == "{" and not first and self.text(k - 1) not in ("|", "&", "=>", ":", "<", ","):
                return k
            if x in (";", ",", "=", ")") or x == "=>" and self.text(k - 1) != ")":
                return k
            if x == "=>":
                return k
            k = self.close[k] + 1 if x in ("(", "[", "{") else self.skip_angles(k) if x == "<" and self.skip_angles(k) > k else k + 1
            first = False
        return k

    def walk(self, k: int, stop: int, parent: str) -> None:
        while k < stop:
            k = self.one(k, stop, parent)

    def one(self, k: int, stop: int, parent: str) -> int:
        x = self.text(k)
        if x == "import" and self.text(k - 1) != "." and self.text(k + 1) not in ("(", "."):
            return self.import_(k, parent)
        if x == "interface" and self.word(k + 1) and self.text(k - 1) != ".":
            body = self.find(k, "{ ;")
            return self.close[body] + 1 if body > 0 and self.text(body) == "{" else k + 1
        if x == "function" and self.text(k - 1) != ".":
            return self.function(k, stop, parent)
        if x == "class" and self.text(k - 1) != "." and (self.word(k + 1) or self.text(k + 1) == "{"):
            return self.class_(k, parent)
        arrow = self.arrow_at(k, stop)
        if arrow:
            return self.anonymous(k, arrow, stop, parent)
        if x == "new" and self.word(k + 1):
            k += 2
            while self.text(k) == "." and self.word(k + 1):
                k += 2
            return k
        if x == "{" and self.object_at(k):
            self.object_(k + 1, self.close[k], parent)
            return self.close[k] + 1
        if self.word(k) and x not in _NOT_CALLS:
            after = k + 1
            if self.text(after) == "?" and self.text(after + 1) == "." and self.text(after + 2) == "(":
                after += 2
            if self.text(after) == "<":
                skipped = self.skip_angles(after)
                after = skipped if self.text(skipped) == "(" else after
            if self.text(after) == "(":
                self.g.call(x, *self.at(k), parent)
        return k + 1

    def import_(self, k: int, parent: str) -> int:
        i = k + 1
        while i < len(self.t) and self.text(i) not in (";", "=", "("):
            if self.t[i].kind == "string":
                at = self.at(i)
                self.g.imported(self.t[i].text.strip("'\""), *at, parent, None)
                return i + 1
            i = self.close[i] + 1 if self.text(i) == "{" else i + 1
        return k + 1

    def function(self, k: int, stop: int, parent: str) -> int:
        """function at k; async before it belongs to it."""
        first = k - 1 if self.text(k - 1) == "async" else k
        i = k + 2 if self.text(k + 1) == "*" else k + 1
        name = self.t[i].text if self.word(i) else None
        p = self.skip_angles(i + 1 if name else i)
        if self.text(p) != "(":
            return k + 1
        body = self.after_type(self.close[p] + 1, stop)
        if self.text(body) != "{":
            return self.close[p] + 1  # a signature without a body
        kind = "function"
        if not name:
            name, kind = self.name_before(first)
        return self.named(name, kind, first, p, body, self.close[body], parent)

    def named(self, name: str | None, kind: str, first: int, params: int, body: int, last: int, parent: str) -> int:
        me = parent
        if name:
            line, column = self.at(first)
            me = self.g.definition(name, kind, line, column, self.end_line(last), self.code(first, last), parent)
        self.walk(params, body, me)
        if self.text(body) == "{":
            self.walk(body + 1, last, me)
        else:
            self.walk(body, last + 1, me)
        return last + 1

    def arrow_at(self, k: int, stop: int) -> int:
        """Where the => of an arrow function stands that begins at k; 0 if none does."""
        x = self.text(k)
        i = k + 1 if x == "async" and (self.text(k + 1) == "(" or self.word(k + 1) and self.text(k + 2) == "=>") else k
        if self.text(i) == "(" and (self.text(k - 1) not in (".",) and (not self.word(k - 1) or i > k or self.text(k - 1) in ("return", "default", "of", "case", "await", "yield", "in"))):
            end = self.close[i] + 1
            if self.text(end) == ":":
                end = self.after_type(end, stop)
            return end if self.text(end) == "=>" else 0
        if self.text(i) == "<" and i == k:
            p = self.skip_angles(i)
            if p > i and self.text(p) == "(":
                end = self.close[p] + 1
                end = self.after_type(end, stop) if self.text(end) == ":" else end
                return end if self.text(end) == "=>" else 0
        if self.word(i) and self.text(i + 1) == "=>":
            return i + 1
        return 0

    def anonymous(self, k: int, arrow: int, stop: int, parent: str) -> int:
        name, kind = self.name_before(k)
        body = arrow + 1
        if self.text(body) == "{":
            return self.named(name, kind, k, self.inside(k), body, self.close[body], parent)
        i = body
        while i < stop and self.text(i) not in (",", ";", ")", "]", "}"):
            if i > body and self.at(i)[0] != self.end_line(i - 1) and (self.word(i) or self.t[i].kind == "string") and (self.word(i - 1) or self.text(i - 1) in (")", "]", "}") or self.t[i - 1].kind != "punct"):
                break  # the line ended, and with it the statement
            i = self.close[i] + 1 if self.text(i) in ("(", "[", "{") else i + 1
        # Arrow bodies and parameters are walked as one stretch; the arrow itself is no call.
        return self.named(name, kind, k, self.inside(k), body, max(body, i - 1), parent) if name else self._inline(k, body, i, parent)

    def _inline(self, k: int, body: int, end: int, parent: str) -> int:
        self.walk(self.inside(k), body - 1, parent)
        self.walk(body, end, parent)
        return end

    def inside(self, k: int) -> int:
        """Where the parameters of an arrow function that begins at k are, past what would make it one again."""
        return k + 2 if self.text(k) == "async" else k + 1

    def name_before(self, k: int) -> tuple[str | None, str]:
        """What a function without a name is assigned to."""
        i = k - 1
        if self.text(i) == "=":
            j = i - 1
            depth_ok = j
            while depth_ok >= 0 and not (self.word(depth_ok) and self.text(depth_ok - 1) in ("const", "let", "var")):  # over a type
                if self.text(depth_ok) in (";", "{", "}", "=") and self.text(depth_ok) != "}" or j - depth_ok > 60:
                    return None, "function"
                depth_ok -= 1
            return (self.t[depth_ok].text, "function") if depth_ok >= 0 else (None, "function")
        if self.text(i) == ":" and 0 <= i - 1:
            if self.text(i - 2) in ("{", ",") and (self.word(i - 1) or self.t[i - 1].kind in ("string", "number")):
                return self.t[i - 1].text, "method"
        return None, "function"

    def object_at(self, k: int) -> bool:
        """Whether the { at k opens an object rather than a block."""
        return self.text(k - 1) in ("=", "(", ",", "[", ":", "?", "return", "=>", "default")

    def object_(self, k: int, stop: int, parent: str) -> None:
        start = True
        while k < stop:
            if start:
                m = self.method_at(k, stop)
                if m:
                    name, p, body = m
                    k = self.named(name, "method", k, p, body, self.close[body], parent)
                    start = False
                    continue
            start = self.text(k) == ","
            k = self.one(k, stop, parent)

    def method_at(self, k: int, stop: int) -> tuple[str, int, int] | None:
        """(name, its parameters, its body) of a method that begins at k."""
        while self.text(k) in _MODIFIERS and (self.word(k + 1) or self.text(k + 1) in ("[", "*", "#") or k + 1 < stop and self.t[k + 1].kind == "string"):
            k += 1
        if self.text(k) == "*":
            k += 1
        if self.text(k) == "[" and k in self.close:
            name, i = self.code(k, self.close[k]), self.close[k] + 1
        elif k < stop and self.t[k].kind in ("word", "string", "number"):
            name, i = self.t[k].text, k + 1
        else:
            return None
        i = i + 1 if self.text(i) in ("?", "!") else i
        p = self.skip_angles(i)
        if self.text(p) != "(":
            return None
        body = self.after_type(self.close[p] + 1, stop)
        return (name, p, body) if self.text(body) == "{" else None

    def class_(self, k: int, parent: str) -> int:
        named = self.word(k + 1) and self.text(k + 1) not in ("extends", "implements")
        i = self.skip_angles(k + 2 if named else k + 1)
        body, base = i, None
        while body < len(self.t) and self.text(body) != "{":
            if self.text(body) == "extends" and self.word(body + 1) and self.text(body + 2) not in (".", "("):
                base = body + 1
            body = self.skip_angles(body) if self.text(body) == "<" and self.skip_angles(body) > body else body + 1
        if body >= len(self.t):
            return k + 1
        last, me = self.close[body], parent
        if named:
            first = k - 1 if self.text(k - 1) == "abstract" else k
            line, column = self.at(first)
            me = self.g.definition(self.t[k + 1].text, "class", line, column, self.end_line(last), self.code(first, last), parent)
            if base is not None:
                self.g.base(me, self.t[base].text, *self.at(base))
        k, start = body + 1, True
        while k < last:
            x = self.text(k)
            if x == "@":
                k += 1
                while self.word(k):
                    if self.text(k + 1) == "(":
                        self.g.call(self.t[k].text, *self.at(k), me)
                        self.walk(k + 2, self.close[k + 1], me)
                        k = self.close[k + 1] + 1
                        break
                    k = k + 2 if self.text(k + 1) == "." else k + 1
                    if self.text(k - 1) != ".":
                        break
                continue
            m = self.method_at(k, last) if start else None
            if m:
                name, p, b = m
                k = self.named(name, "method", k, p, b, self.close[b], me)
                continue
            field = self.field_at(k, last) if start else None
            if field:
                k = self.field(field, last, me)
                continue
            start = x in (";", "}") or k + 1 < last and self.at(k + 1)[0] != self.end_line(k)
            k = self.close[k] + 1 if x == "{" else k + 1
        return last + 1

    def field_at(self, k: int, stop: int) -> tuple[int, int] | None:
        """(name, =) of a field that begins at k and has a value."""
        while self.text(k) in _MODIFIERS and self.word(k + 1):
            k += 1
        if not self.word(k):
            return None
        i = k + 1 if self.text(k + 1) not in ("?", "!") else k + 2
        if self.text(i) == ":":
            j = i + 1
            while j < stop and self.text(j) not in ("=", ";") and not (j > i + 1 and self.at(j)[0] != self.end_line(j - 1)):
                j = self.close[j] + 1 if self.text(j) in ("(", "{", "[") else j + 1
            i = j
        return (k, i) if self.text(i) == "=" else None

    def field(self, found: tuple[int, int], stop: int, owner: str) -> int:
        name, eq = found
        k = eq + 1
        arrow = self.arrow_at(k, stop)
        if arrow and self.text(arrow + 1) == "{":
            return self.named(self.t[name].text, "method", k, self.inside(k), arrow + 1, self.close[arrow + 1], owner)
        f = k + 1 if self.text(k) == "async" else k
        if self.text(f) == "function":
            p = self.find(f, "(")
            body = self.after_type(self.close[p] + 1, stop)
            if self.text(body) == "{":
                return self.named(self.t[f + 1].text if self.word(f + 1) else self.t[name].text, "function" if self.word(f + 1) else "method", k, p, body, self.close[body], owner)
        end = k
        while end < stop and self.text(end) != ";" and not (end > k and self.at(end)[0] != self.end_line(end - 1) and self.text(end) not in (".", "?", "+", "|", "&")):
            end = self.close[end] + 1 if self.text(end) in ("(", "{", "[") else end + 1
        if arrow:
            return self.named(self.t[name].text, "method", k, self.inside(k), arrow + 1, max(arrow + 1, end - 1), owner)
        self.walk(k, end, owner)
        return end


def parse(path: str, source: str) -> Graph:
    w = TypeScript(path, source, LANGUAGE, Lexer(source, quotes="\"'", raw="`", regexes=True))
    w.walk(0, len(w.t), w.g.file_id)
    return w.g
