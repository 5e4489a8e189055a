"""What changed between two versions: symbols of files, and files themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def symbol_diff(old: DataFrame, new: DataFrame, old_files: DataFrame | None = None, new_files: DataFrame | None = None) -> DataFrame:
    """(file_path, status, added, removed): the symbols (name, kind) that differ between old and new (file_path, name, kind).

    Files of either version that are given count as there even without symbols: those of one version only are always listed, others only
    if symbols differ.
    """
    files = lambda x, given: (x if given is None else given).select("file_path").distinct()
    both = files(old, old_files).withColumn("was", F.lit(True)).join(files(new, new_files).withColumn("is", F.lit(True)), "file_path", "full")
    status = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").otherwise("modified")
    key = ["file_path", "name", "kind"]
    o, n = old.select(*key).distinct(), new.select(*key).distinct()
    changes = n.join(o, key, "left_anti").withColumn("what", F.lit("+")).unionByName(o.join(n, key, "left_anti").withColumn("what", F.lit("-")))
    pairs = lambda sign: F.array_sort(F.collect_list(F.when(F.col("what") == sign, F.struct("name", "kind"))))
    sets = changes.groupBy("file_path").agg(pairs("+").alias("added"), pairs("-").alias("removed"))
    none = F.array().cast("array<struct<name:string,kind:string>>")
    out = both.select("file_path", status.alias("status")).join(sets, "file_path", "left").select("file_path", "status", F.coalesce("added", none).alias("added"), F.coalesce("removed", none).alias("removed"))
    return out.where((F.col("status") != "modified") | (F.size("added") > 0) | (F.size("removed") > 0))


def file_changes(index: DataFrame, disk: DataFrame, root: str | None = None) -> DataFrame:
    """(file_path, change) of created, modified, removed and unchanged files: index and disk have (file_path, content_hash).

    With a root, only indexed files under it can be removed: others belong to another repository in the same store.
    """
    i = index.select("file_path", F.col("content_hash").alias("was"))
    j = i.join(disk.select("file_path", F.col("content_hash").alias("is")), "file_path", "full")
    change = F.when(F.col("was").isNull(), "created").when(F.col("is").isNull(), "removed").when(F.col("was") == F.col("is"), "unchanged").otherwise("modified")
    out = j.select("file_path", change.alias("change"))
    if root is not None:
        out = out.where((F.col("change") != "removed") | F.startswith("file_path", F.lit(root.rstrip("/") + "/")))
    return out


def upsert(rows: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """rows with those of new in place of the ones that share their key; of new rows with one key the last counts."""
    from codeloom.schema import last_wins

    fresh = last_wins(new, key)
    return rows.join(fresh.select(*key), key, "left_anti").unionByName(fresh)


def delete_files(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges without those of files (file_path), and without edges that have an end there."""
    gone = nodes.join(files, "file_path", "left_semi").select("id")
    kept = nodes.join(files, "file_path", "left_anti")
    left = edges.join(gone.select(F.col("id").alias("source_id")), "source_id", "left_anti").join(gone.select(F.col("id").alias("target_id")), "target_id", "left_anti")
    return kept, left.select(*edges.columns)


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    ids = nodes.select("id")
    a = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_anti")
    b = edges.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return a.select(*edges.columns).unionByName(b.select(*edges.columns)).distinct()
