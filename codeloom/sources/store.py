"""Versions of a graph as Parquet: a manifest names the current one, readers keep the one they began with."""

from __future__ import annotations

import json
import os
import shutil
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import diff, spine
from codeloom.schema import EDGES, FILES, NODES
from codeloom.sources import parse as parsing
from codeloom.sources import walk

FORMAT = 1


class NotIndexed(RuntimeError):
    """There is no graph yet."""


class BrokenStore(RuntimeError):
    """The manifest can't be read, or is of a later format."""


class Locked(RuntimeError):
    """Another writer is at work."""


class Store:
    """A folder of versions v=1, v=2, ... Each holds nodes, edges, files, errors and the relations made from them.

    A version is written whole before the manifest is swapped to it, so a file's old symbols are there until its new ones are. There is
    one writer at a time. The two latest versions are kept.
    """

    TABLES = {"nodes": NODES, "edges": EDGES, "files": FILES}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, os.path.abspath(folder)
        self.manifest = os.path.join(self.folder, "CURRENT")

    def version(self) -> int:
        """0 while nothing has been written."""
        if not os.path.exists(self.manifest):
            return 0
        try:
            with open(self.manifest) as f:
                m = json.load(f)
            number, form = int(m["version"]), int(m["format"])
        except (ValueError, KeyError, TypeError) as e:
            raise BrokenStore(f"{self.manifest} can't be read: {e}") from e
        if form > FORMAT:
            raise BrokenStore(f"{self.manifest} has format {form}; this library knows {FORMAT}")
        return number

    def table(self, name: str, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        if not v:
            if name in self.TABLES:
                return self.spark.createDataFrame([], self.TABLES[name])
            raise NotIndexed(f"nothing is indexed in {self.folder}")
        return self.spark.read.parquet(f"{self.folder}/v={v}/{name}")

    @property
    def nodes(self) -> DataFrame:
        return self.table("nodes")

    @property
    def edges(self) -> DataFrame:
        return self.table("edges")

    @property
    def files(self) -> DataFrame:
        return self.table("files")

    def size(self) -> int:
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(f"{self.folder}/v={self.version()}") for f in fs)

    def _lock(self) -> int:
        os.makedirs(self.folder, exist_ok=True)
        path, until = os.path.join(self.folder, "LOCK"), time.time() + 5
        while True:
            try:
                return os.open(path, os.O_CREAT | os.O_EXCL)
            except FileExistsError:
                if time.time() > until:
                    raise Locked(f"{path} exists: another writer is at work, or one was stopped") from None
                time.sleep(0.1)

    def write(self, nodes: DataFrame, edges: DataFrame, files: DataFrame, errors: DataFrame | None = None) -> int:
        """A new version. Edges with an end that is no node go to the table dangling."""
        lock = self._lock()
        try:
            v = self.version() + 1
            at = f"{self.folder}/v={v}"
            shutil.rmtree(at, ignore_errors=True)
            nodes.select(*NODES.names).write.parquet(f"{at}/nodes")
            n = self.spark.read.schema(NODES).parquet(f"{at}/nodes")
            ids = n.select("id")
            e = edges.select(*EDGES.names)
            e.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(*EDGES.names).write.parquet(f"{at}/edges")
            diff.dangling(n, e).write.parquet(f"{at}/dangling")
            files.select(*FILES.names).write.parquet(f"{at}/files")
            (errors if errors is not None else self.spark.createDataFrame([], "file_path string, error string")).write.parquet(f"{at}/errors")
            e = self.spark.read.schema(EDGES).parquet(f"{at}/edges")
            spine.resolved_sites(n).write.parquet(f"{at}/sites")
            sites = self.spark.read.parquet(f"{at}/sites")
            spine.real_refs(n, e, sites).write.parquet(f"{at}/refs")
            spine.resolved_out(n, e).write.parquet(f"{at}/out")
            spine.file_imports(n).write.parquet(f"{at}/file_imports")
            temp = self.manifest + ".new"
            with open(temp, "w") as f:
                json.dump({"version": v, "format": FORMAT}, f)
            os.replace(temp, self.manifest)
            for old in range(v - 3, v - 1):
                shutil.rmtree(f"{self.folder}/v={old}", ignore_errors=True)
            return v
        finally:
            os.close(lock)
            os.unlink(os.path.join(self.folder, "LOCK"))

    def clear(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


def index(store: Store, root: str, force: bool = False, dry_run: bool = False) -> dict[str, list[str]]:
    """Brings the graph up to date with a repository: the files created, modified and removed, and those that failed.

    Files whose content hash is known are not parsed again unless forced. A file that can't be parsed keeps its old symbols and is tried
    again next time. Files of other repositories in the same store stay. A dry run changes nothing.
    """
    spark, root = store.spark, os.path.abspath(root)
    disk = walk.files(spark, root).cache()
    try:
        changes = diff.file_changes(store.files, disk, root).where("change <> 'unchanged'" if not force else "true")
        by: dict[str, list[str]] = {"created": [], "modified": [], "removed": [], "unchanged": [], "failed": []}
        for r in changes.toLocalIterator():
            by[r.change].append(r.file_path)
        if force:
            under = root.rstrip("/") + "/"
            by["modified"] += [p for p in by.pop("unchanged") if p.startswith(under)]
            by["unchanged"] = []
        by = {k: sorted(v) for k, v in by.items()}
        if dry_run or not (by["created"] or by["modified"] or by["removed"]):
            return by
        todo = spark.createDataFrame([(p, k) for k, p in enumerate(sorted(by["created"] + by["modified"]))], "file_path string, nth long")
        rows = parsing.parsed(disk.join(todo, "file_path", "left_semi")).cache()
        failed = rows.where("error is not null").select("file_path", "error")
        by["failed"] = sorted(r.file_path for r in failed.collect())
        good = rows.where("error is null")
        gone = good.select("file_path").unionByName(spark.createDataFrame([(p,) for p in by["removed"]], "file_path string"))
        nodes, edges = diff.delete_files(store.nodes, store.edges, gone)
        base = (store.nodes.agg(F.max("seq")).first()[0] or 0) + 1
        # seq: files in order of path, symbols in order of their place in it.
        fresh = good.join(todo, "file_path").select("file_path", (F.col("nth") * 10_000_000 + base).alias("base"), "nodes", "edges")
        new_nodes = fresh.select("base", F.explode("nodes").alias("n")).select(*(F.col(f"n.{c}") for c in NODES.names[:-1]), (F.col("base") + F.col("n.seq")).alias("seq"))
        new_edges = fresh.select("base", F.explode("edges").alias("e")).select(*(F.col(f"e.{c}") for c in EDGES.names[:-1]), (F.col("base") + F.col("e.seq")).alias("seq"))
        done = disk.join(good.select("file_path"), "file_path", "left_semi").select("file_path", "content_hash", "mtime", F.current_timestamp().alias("indexed_at"))
        files = store.files.join(gone, "file_path", "left_anti").unionByName(done)
        store.write(nodes.unionByName(new_nodes), edges.unionByName(new_edges), files, failed)
        rows.unpersist()
        return by
    finally:
        disk.unpersist()
