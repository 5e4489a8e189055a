"""Files to nodes and edges: one narrow pass, a file at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.schema import EDGES, NODES
from codeloom.sources.parsers import parse

_NODE = [("id", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("file_path", pa.string()), ("language", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("docstring", pa.string()), ("code_snippet", pa.string()), ("metadata", pa.string()), ("external", pa.bool_()), ("seq", pa.int64())]
_EDGE = [("source_id", pa.string()), ("target_id", pa.string()), ("kind", pa.string()), ("metadata", pa.string()), ("file_path", pa.string()), ("seq", pa.int64())]
_OUT = pa.schema([("file_path", pa.string()), ("nodes", pa.list_(pa.struct(_NODE))), ("edges", pa.list_(pa.struct(_EDGE))), ("error", pa.string())])


def parsed(files: DataFrame) -> DataFrame:
    """(file_path, nodes, edges, error) of files (file_path, content). A file that can't be read has an error and nothing else; others
    go on. Nodes of one id collapse to the last, edges of one kind between the same ends to the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, text in zip(batch["file_path"].to_pylist(), batch["content"].to_pylist()):
                try:
                    g = parse(path, text or "")
                    nodes = {n[0]: (*n, k) for k, n in enumerate(g.nodes)} if g else {}
                    edges = {}
                    for k, e in enumerate(g.edges if g else []):
                        edges.setdefault(e[:3], (*e, k))
                    rows.append({"file_path": path, "nodes": [dict(zip([c for c, _ in _NODE], n)) for n in nodes.values()], "edges": [dict(zip([c for c, _ in _EDGE], e)) for e in edges.values()], "error": None})
                except Exception as e:  # noqa: BLE001 - any failure is the file's, not the run's
                    rows.append({"file_path": path, "nodes": [], "edges": [], "error": f"{type(e).__name__}: {e}"[:500]})
            yield pa.RecordBatch.from_pylist(rows, schema=_OUT)

    node = "array<struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in NODES) + ">>"
    edge = "array<struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in EDGES) + ">>"
    return files.select("file_path", "content").mapInArrow(run, f"file_path string, nodes {node}, edges {edge}, error string")


def nodes_of(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("nodes").alias("n")).select("n.*")


def edges_of(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("edges").alias("e")).select("e.*")


def symbols(files: DataFrame, content: str = "content") -> DataFrame:
    """Distinct (file_path, name, kind) of the definitions in files; a file whose content is null has none."""
    some = files.where(F.col(content).isNotNull()).select("file_path", F.col(content).alias("content"))
    return nodes_of(parsed(some)).where(F.col("kind").isin("function", "method", "class") & ~F.col("external")).select("file_path", "name", "kind").distinct()
