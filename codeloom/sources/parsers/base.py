"""What parsers of all languages share: the symbols that they emit, and a lexer for languages with braces."""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import cached_property

SNIPPET = 500


def node_id(file_path: str, name: str, line: int, column: int) -> str:
    return hashlib.sha256(":".join((file_path, name, str(line), str(column))).encode("utf-8", "replace")).hexdigest()[:16]


class Graph:
    """The nodes and edges of one file, as rows in the order of codeloom.schema (without seq)."""

    def __init__(self, path: str, source: str, language: str):
        self.path, self.source, self.language = path, source, language
        self.nodes: list[tuple] = []
        self.edges: list[tuple] = []
        self.file_id = node_id(path, "__file__", 0, 0)
        self._add(self.file_id, re.split(r"[\\/]", path)[-1], "file", 1, source.count("\n") + 1)

    def _add(self, id_: str, name: str, kind: str, line: int, end: int | None, doc: str | None = None, code: str | None = None, meta: dict | None = None) -> None:
        meta = meta or {}
        self.nodes.append((id_, name, kind, self.path, self.language, line, end, doc, code, json.dumps(meta), bool(meta.get("external"))))

    def edge(self, source: str, target: str, kind: str, **meta: str) -> None:
        self.edges.append((source, target, kind, json.dumps(meta), self.path))

    def definition(self, name: str, kind: str, line: int, column: int, end: int, code: str, parent: str | None, doc: str | None = None) -> str:
        me = node_id(self.path, name, line, column)
        self._add(me, name, kind, line, end, doc, code[:SNIPPET])
        if parent:
            self.edge(parent, me, "contains")
        return me

    def base(self, child: str, name: str, line: int, column: int) -> None:
        """A base type by name: a stub, since its definition may be anywhere."""
        me = node_id(self.path, name, line, column)
        self._add(me, name, "class", line, line, meta={"external": True})
        self.edge(child, me, "inherits", base_name=name)

    def imported(self, name: str, line: int, column: int, parent: str, end: int | None) -> None:
        me = node_id(self.path, f"import:{name}", line, column)
        self._add(me, name, "import", line, end)
        self.edge(parent, me, "imports")

    def call(self, name: str, line: int, column: int, parent: str) -> None:
        me = node_id(self.path, f"call:{name}", line, column)
        self._add(me, name, "call", line, None)
        self.edge(parent, me, "calls", call_name=name)


@dataclass(slots=True)
class Token:
    kind: str  # word, number, string, template, punct
    text: str
    start: int
    end: int


class Lines:
    """Lines from 1 and columns in bytes from 0 of places in a text."""

    def __init__(self, source: str):
        self.source = source
        self.starts = [0, *(m.end() for m in re.finditer("\n", source))]
        self.ascii = source.isascii()

    def at(self, place: int) -> tuple[int, int]:
        k = bisect_right(self.starts, place) - 1
        b = self.starts[k]
        return k + 1, place - b if self.ascii else len(self.source[b:place].encode("utf-8", "replace"))


class Closing(dict):
    """Where brackets close. What is no bracket, or wasn't found, closes at the end."""

    def __init__(self, end: int):
        super().__init__()
        self.end = end

    def __missing__(self, k: int) -> int:
        return self.end


class Lexer:
    """Tokens of a language with braces; comments and white space are left out. It never fails: what it can't read is punctuation."""

    WORD = re.compile(r"[^\W\d][\w$]*|[$@#]?[A-Za-z_$][\w$]*")
    NUMBER = re.compile(r"\d[\w.]*")
    PUNCT = re.compile(r"=>|->|::|\.\.\.|&&|\|\||[{}()\[\];,.:<>=+\-*/%!&|^~?@#$\\'\"`]|\S")

    def __init__(self, source: str, quotes: str = "\"'", raw: str = "", regexes: bool = False, nested_comments: bool = False, lifetimes: bool = False):
        self.s, self.quotes, self.raw, self.regexes, self.nested, self.lifetimes = source, quotes, raw, regexes, nested_comments, lifetimes
        self.tokens: list[Token] = []
        self._run(0, len(source))
        self.match = self._brackets()

    def _add(self, kind: str, start: int, end: int) -> None:
        self.tokens.append(Token(kind, self.s[start:end], start, end))

    def _run(self, i: int, stop: int) -> None:
        s = self.s
        while i < stop:
            c = s[i]
            if c.isspace():
                i += 1
            elif s.startswith("//", i):
                i = (s.find("\n", i) + 1 or stop)
            elif s.startswith("/*", i):
                i = self._comment(i)
            elif self.lifetimes and (m := re.compile(r"(?:b|c)?r(#*)\"").match(s, i)):
                end = s.find('"' + m[1], m.end())
                end = stop if end < 0 else end + 1 + len(m[1])
                self._add("string", i, end)
                i = end
            elif self.lifetimes and (m := re.compile(r"'[^\W\d]\w*(?!')").match(s, i)):
                i = m.end()
            elif c in self.raw:
                i = self._template(i, stop) if c == "`" and self.regexes else self._quoted(i, c, escapes=False)
            elif c in self.quotes:
                i = self._quoted(i, c)
            elif m := self.WORD.match(s, i):
                self._add("word", i, m.end())
                i = m.end()
            elif m := self.NUMBER.match(s, i):
                self._add("number", i, m.end())
                i = m.end()
            elif c == "/" and self.regexes and self._regex_may_begin() and (m := re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*").match(s, i)):
                self._add("string", i, m.end())
                i = m.end()
            else:
                m = self.PUNCT.match(s, i)
                self._add("punct", i, m.end())
                i = m.end()

    def _comment(self, i: int) -> int:
        s, depth = self.s, 0
        for m in re.compile(r"/\*|\*/").finditer(s, i):
            depth += 1 if m[0] == "/*" and (self.nested or not depth) else -1 if m[0] == "*/" else 0
            if not depth:
                return m.end()
        return len(s)

    def _quoted(self, i: int, quote: str, escapes: bool = True) -> int:
        s = self.s
        if s.startswith('"""', i) and not self.lifetimes and not self.regexes and quote == '"':
            end = s.find('"""', i + 3)
            end = len(s) if end < 0 else end + 3
        else:
            end = i + 1
            while end < len(s) and s[end] != quote and (s[end] != "\n" or self.lifetimes or not escapes):
                end += 2 if escapes and s[end] == "\\" else 1
            end = min(len(s), end + 1)
        self._add("string", i, end)
        return end

    def _template(self, i: int, stop: int) -> int:
        """A template literal: what stands in ${} is code."""
        s, at = self.s, i + 1
        while at < stop and s[at] != "`":
            if s[at] == "\\":
                at += 2
            elif s.startswith("${", at):
                depth, end = 1, at + 2
                while end < stop and depth:
                    if s[end] == "`":
                        end = self._skip_template(end, stop)
                        continue
                    depth += {"{": 1, "}": -1}.get(s[end], 0)
                    end += 1
                self._add("punct", at + 1, at + 2)
                self._run(at + 2, end - 1)
                if not depth:
                    self._add("punct", end - 1, end)
                at = end
            else:
                at += 1
        self._add("string", i, i + 1)
        return min(stop, at + 1)

    def _skip_template(self, i: int, stop: int) -> int:
        i += 1
        while i < stop and self.s[i] != "`":
            i += 2 if self.s[i] == "\\" else 1
        return min(stop, i + 1)

    def _regex_may_begin(self) -> bool:
        if not self.tokens:
            return True
        t = self.tokens[-1]
        return t.text in ("return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "do", "else") if t.kind == "word" else t.kind == "punct" and t.text not in (")", "]", "}")

    def _brackets(self) -> dict[int, int]:
        """For each opening bracket the index of the one that closes it, the end if none does."""
        out, open_ = Closing(len(self.tokens) - 1), []
        pairs = {")": "(", "]": "[", "}": "{"}
        for k, t in enumerate(self.tokens):
            if t.kind != "punct":
                continue
            if t.text in "([{":
                open_.append(k)
            elif t.text in pairs:
                for back in range(len(open_) - 1, -1, -1):
                    if self.tokens[open_[back]].text == pairs[t.text]:
                        for o in open_[back + 1 :]:
                            out[o] = k
                        out[open_[back]] = k
                        del open_[back:]
                        break
        for o in open_:
            out[o] = len(self.tokens) - 1
        return out


class Walker:
    """A cursor over tokens, with what recognisers need."""

    def __init__(self, path: str, source: str, language: str, lexer: Lexer):
        self.g, self.t, self.close, self.lines, self.source = Graph(path, source, language), lexer.tokens, lexer.match, Lines(source), source

    def text(self, k: int) -> str:
        return self.t[k].text if 0 <= k < len(self.t) and self.t[k].kind != "string" else ""

    def word(self, k: int) -> bool:
        return 0 <= k < len(self.t) and self.t[k].kind == "word"

    def at(self, k: int) -> tuple[int, int]:
        return self.lines.at(self.t[k].start)

    def end_line(self, k: int) -> int:
        return self.lines.at(max(self.t[min(k, len(self.t) - 1)].end - 1, 0))[0]

    def code(self, first: int, last: int) -> str:
        return self.source[self.t[first].start : self.t[min(last, len(self.t) - 1)].end]

    @cached_property
    def angles(self) -> dict[int, int]:
        """For each < the index of the > that closes it, where no statement or block ends between."""
        out, open_ = {}, []
        for k, t in enumerate(self.t):
            if t.kind == "string":
                continue
            if t.text == "<":
                open_.append(k)
            elif t.text == ">" and open_:
                out[open_.pop()] = k
            elif t.text in (";", "{", "}"):
                open_.clear()
        return out

    def skip_angles(self, k: int) -> int:
        """The place after <...> that begins at k, or k if none does."""
        return self.angles[k] + 1 if k in self.angles else k

    def find(self, k: int, wanted: str, stop: int | None = None) -> int:
        """The first of the wanted marks from k on, brackets jumped over; -1 if stop comes first."""
        stop = len(self.t) if stop is None else stop
        while k < stop:
            x = self.text(k)
            if x and x in wanted.split():
                return k
            k = self.close[k] + 1 if x in ("(", "[", "{") and k in self.close else k + 1
        return -1
