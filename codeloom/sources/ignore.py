"""Which files of a repository are left out: built-in rules and gitignore patterns."""

from __future__ import annotations

import os
import re

IGNORED_DIRS = set("__pycache__ .codeloom .egg-info .eggs .git .mypy_cache .pytest_cache .ruff_cache .tox .venv build dist node_modules venv".split())
IGNORED_SUFFIXES = set(".dll .dylib .egg-info .pyc .pyo .so".split())
IGNORE_FILES = (".gitignore", ".codeloomignore")


def built_in(path: str) -> bool:
    """Of a path relative to the repository, whose own place never counts."""
    parts = path.split("/")
    name = parts[-1]
    return any(p in IGNORED_DIRS for p in parts) or name.startswith(".") or os.path.splitext(name)[1] in IGNORED_SUFFIXES


def _translate(pattern: str) -> str:
    """A gitignore glob as a regular expression over paths without a leading slash."""
    anchored = "/" in pattern.rstrip("/")
    p = pattern.strip("/") if anchored else pattern.rstrip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("/**", i) and i + 3 == len(p):
            out, i = out + "/.*", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and (e := p.find("]", i + 2)) > 0:
            body = p[i + 1 : e].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", e + 1
        elif p[i] == "\\" and i + 1 < len(p):
            out, i = out + re.escape(p[i + 1]), i + 2
        else:
            out, i = out + re.escape(p[i]), i + 1
    return ("" if anchored else "(?:.*/)?") + out


class Rules:
    """Patterns of ignore files; the last that fits decides, and a ! takes back."""

    def __init__(self, lines: list[str]):
        self.rules = []
        for line in lines:
            line = line.rstrip("\n").rstrip("\r")
            if line.endswith(" ") and not line.endswith("\\ "):
                line = line.rstrip(" ")
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[1:] if keep else line[1:] if line.startswith(("\\#", "\\!")) else line
            if not line.strip("/"):
                continue
            only_dir = line.endswith("/")
            # Whatever lies in a directory that fits is left out with it.
            self.rules.append((keep, re.compile(_translate(line) + ("/.*$" if only_dir else "(?:/.*)?$"))))

    def ignored(self, path: str) -> bool:
        """Of a relative path, a directory's with a slash at its end."""
        out = False
        for keep, rx in self.rules:
            if rx.match(path):
                out = not keep
        return out


def load(root: str) -> Rules:
    lines: list[str] = []
    for name in IGNORE_FILES:
        p = os.path.join(root, name)
        if os.path.isfile(p):
            with open(p, encoding="utf-8", errors="replace") as f:
                lines += f.read().split("\n")
    return Rules(lines)
