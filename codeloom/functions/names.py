"""Column expressions over names and paths."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def node_id(file_path: Column, name: Column, line: Column, column: Column) -> Column:
    """16 hex digits that a symbol's place determines."""
    return F.substring(F.sha2(F.concat_ws(":", file_path, name, line.cast("string"), column.cast("string")), 256), 1, 16)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """The file's name without its last extension; a leading dot begins no extension."""
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]*$", "$1")


def import_symbol(name: Column) -> Column:
    """What an import names after its last dot; null without one."""
    return F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1))


def import_tail(name: Column) -> Column:
    """The last segment of an import's module, by slashes if it has any, else by dots."""
    module = F.when(F.contains(name, F.lit(".")), F.regexp_extract(name, r"(?s)^(.*)\.", 1)).otherwise(name)
    module = F.regexp_replace(module, "/+$", "")
    return F.when(F.contains(module, F.lit("/")), F.substring_index(module, "/", -1)).otherwise(F.substring_index(module, ".", -1))


def ascii_fold(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def substring_like(name: Column, text: str) -> Column:
    """Whether name holds text, letters of ASCII in either case; % and _ in text stand for anything, as in LIKE."""
    return ascii_fold(name).like("%" + text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)).replace("\\", "\\\\") + "%")


def forward(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def is_architecture_file(path: Column) -> Column:
    """Neither tests, vendored assets, package markers nor caches."""
    p = forward(path)
    return ~(F.contains(p, F.lit("/tests/")) | F.startswith(p, F.lit("tests/")) | F.contains(p, F.lit("/static/vendor/")) | F.endswith(p, F.lit("/__init__.py")) | F.contains(p, F.lit("/__pycache__/")))


#: Layers in the order in which they are tried, with the path parts that mark them.
LAYERS = (
    ("entrypoints", ("/cli.py", "/__main__.py", "/mcp/server.py")),
    ("queries", ("/queries/",)),
    ("parsers", ("/parser/",)),
    ("graph", ("/graph/",)),
    ("indexer", ("/indexer.py",)),
    ("static", ("/static/",)),
)
LAYER_LABELS = {"other": "Other", "static": "Static assets", "indexer": "Indexer", "parsers": "Parsers by language", "graph": "Graph layer", "queries": "Query layer", "entrypoints": "Entry points"}
_ROLES = (
    ("/cli.py", "command line"), ("/__main__.py", "entry point"), ("/mcp/server.py", "tool server"), ("/indexer.py", "indexing"), ("/graph/store.py", "graph storage"), ("/graph/schema.py", "schema"),
    ("/graph/models.py", "node and edge models"), ("/queries/search.py", "symbol search"), ("/queries/trace.py", "call traces"), ("/queries/impact.py", "change impact"), ("/queries/analysis.py", "dead code and hotspots"),
    ("/queries/export.py", "graph export"), ("/parser/python.py", "Python parser"), ("/parser/typescript.py", "TypeScript parser"), ("/parser/base.py", "parser base"),
)


def layer(path: Column) -> Column:
    p, out = forward(path), F.lit("other")
    for name, marks in reversed(LAYERS):
        hit = F.lit(False)
        for m in marks:
            hit = hit | F.contains(p, F.lit(m))
        out = F.when(hit, name).otherwise(out)
    return out


def component_role(path: Column) -> Column:
    p, out = forward(path), F.lit("component")
    for mark, role in reversed(_ROLES):
        out = F.when(F.contains(p, F.lit(mark)), role).otherwise(out)
    return out
