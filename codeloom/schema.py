"""The property graph as tables: nodes, edges and the index of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFINITION_KINDS = ("function", "method", "class")
EDGE_KINDS = ("contains", "calls", "imports", "inherits")
REFERENCE_KINDS = ("calls", "imports", "inherits")

#: A filter that may be left out.
Maybe = str | None

_S, _I, _L = T.StringType(), T.IntegerType(), T.LongType()

#: seq is the order in which nodes and edges came in; metadata is JSON; external marks stubs of types defined elsewhere.
NODES = T.StructType([
    T.StructField("id", _S), T.StructField("name", _S), T.StructField("kind", _S), T.StructField("file_path", _S), T.StructField("language", _S), T.StructField("line_start", _I), T.StructField("line_end", _I),
    T.StructField("docstring", _S), T.StructField("code_snippet", _S), T.StructField("metadata", _S), T.StructField("external", T.BooleanType()), T.StructField("seq", _L),
])
EDGES = T.StructType([T.StructField("source_id", _S), T.StructField("target_id", _S), T.StructField("kind", _S), T.StructField("metadata", _S), T.StructField("file_path", _S), T.StructField("seq", _L)])
FILES = T.StructType([T.StructField("file_path", _S), T.StructField("content_hash", _S), T.StructField("mtime", T.DoubleType()), T.StructField("indexed_at", T.TimestampType())])


def last_wins(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of rows with one key, the one with the highest seq."""
    w = Window.partitionBy(*key).orderBy(F.col("seq").desc())
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
