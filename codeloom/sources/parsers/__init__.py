"""Parsers by language. Each has EXTENSIONS, LANGUAGE and parse(path, source)."""

from __future__ import annotations

from codeloom.sources.parsers import go, java, python, rust, typescript
from codeloom.sources.parsers.base import Graph

PARSERS = (python, typescript, go, rust, java)
BY_EXTENSION = {e: p for p in PARSERS for e in p.EXTENSIONS}


def suffix(path: str) -> str:
    name = path.replace("\\", "/").rsplit("/", 1)[-1]
    dot = name.rfind(".")
    return name[dot:] if dot > 0 else ""


def parse(path: str, source: str) -> Graph | None:
    """The symbols of a file; None if no parser takes its extension."""
    p = BY_EXTENSION.get(suffix(path))
    return p.parse(path, source) if p else None
