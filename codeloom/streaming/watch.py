"""Keeping a graph up to date: a stream of ticks, each of which indexes what changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from codeloom.operators.analysis import stats, stats_delta
from codeloom.sources.store import Store, index


def tick(store: Store, root: str) -> tuple[dict[str, list[str]], dict[str, int]]:
    """Indexes once. The changes of files, and by how many files, nodes and edges the graph has grown."""
    before = stats(store.nodes, store.edges).collect()
    was = store.spark.createDataFrame(before, "metric string, key string, value long")
    changes = index(store, root)
    grown = {"total_files": 0, "total_nodes": 0, "total_edges": 0}
    if changes["created"] or changes["modified"] or changes["removed"]:
        grown |= {r.metric: r.delta for r in stats_delta(was, stats(store.nodes, store.edges)).where("key = ''").collect()}
    return changes, grown


def watch(store: Store, root: str, interval: float = 2.0, seen: Callable[[dict, dict], None] | None = None) -> StreamingQuery:
    """Indexes every interval seconds, 0.2 at least, until the query is stopped; seen gets the changes and growth of ticks with any.

    The source only gives the beat: what changed is found by content hash, so edits and removals count, whatever the clock says.
    """
    if interval < 0.2:
        raise ValueError("the interval has to be 0.2 s or more")

    def once(_: DataFrame, __: int) -> None:
        changes, grown = tick(store, root)
        if seen and any(changes[k] for k in ("created", "modified", "removed", "failed")):
            seen(changes, grown)

    beat = store.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return beat.writeStream.foreachBatch(once).trigger(processingTime=f"{int(interval * 1000)} milliseconds").start()
