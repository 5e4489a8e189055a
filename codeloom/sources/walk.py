"""The files of a repository, as rows."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.sources import ignore
from codeloom.sources.parsers import BY_EXTENSION, suffix


def paths(root: str) -> list[str]:
    """Relative paths of files that a parser takes and no rule leaves out. Ignored directories are not entered."""
    rules, out = ignore.load(root), []
    for here, dirs, files in os.walk(root):
        rel = os.path.relpath(here, root).replace(os.sep, "/")
        prefix = "" if rel == "." else rel + "/"
        dirs[:] = sorted(d for d in dirs if d not in ignore.IGNORED_DIRS and not rules.ignored(f"{prefix}{d}/"))
        out += [prefix + f for f in sorted(files) if suffix(f) in BY_EXTENSION and not ignore.built_in(prefix + f) and not rules.ignored(prefix + f)]
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path in batch["file_path"].to_pylist():
            try:
                with open(path, "rb") as f:
                    rows.append((path, f.read().decode("utf-8", "replace"), os.stat(path).st_mtime))
            except OSError:
                continue  # it went while the walk was on
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.float64()))], ["file_path", "content", "mtime"])


def files(spark: SparkSession, root: str, per_task: int = 200) -> DataFrame:
    """(file_path, content, content_hash, mtime) of a repository's source files; paths are absolute. Executors read the files, which
    have to lie where all of them can; bytes that aren't UTF-8 become U+FFFD. (Spark's own file source would leave out names that begin
    with an underscore, such as __init__.py.)"""
    root = os.path.abspath(root)
    found = [(os.path.join(root, p),) for p in paths(root)]
    if not found:
        return spark.createDataFrame([], "file_path string, content string, content_hash string, mtime double")
    named = spark.createDataFrame(found, "file_path string").repartition(-(-len(found) // per_task), "file_path")
    text = named.mapInArrow(_read, "file_path string, content string, mtime double")
    return text.select("file_path", "content", F.substring(F.sha2("content", 256), 1, 16).alias("content_hash"), "mtime")


def git_versions(spark: SparkSession, root: str, ref: str) -> DataFrame:
    """(file_path, old, new) of source files that differ between ref and the working tree; null where a side has no such file."""
    run = lambda *a: subprocess.run(["git", "-C", root, *a], capture_output=True)
    names = run("diff", "--name-only", "-z", "--relative", ref)
    if names.returncode:
        raise RuntimeError(names.stderr.decode("utf-8", "replace").strip() or f"git can't compare with {ref}")
    rows = []
    for p in sorted(x for x in names.stdout.decode("utf-8", "replace").split("\0") if x and suffix(x) in BY_EXTENSION):
        was = run("show", f"{ref}:./{p}")
        try:
            with open(os.path.join(root, p), "rb") as f:
                now = f.read().decode("utf-8", "replace")
        except OSError:
            now = None
        rows.append((p, None if was.returncode else was.stdout.decode("utf-8", "replace"), now))
    return spark.createDataFrame(rows, "file_path string, old string, new string")
