"""Call traces, shortest dependency paths, change impact and the neighbourhood of a symbol.

Frontiers are joined with the edges a level at a time. A level is saved under the shared folder, so plans stay short and a lost
executor costs one level at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.sources.tables import save


#: References, or what makes those to the nodes of a level (node_id).
References = DataFrame | Callable[[DataFrame], DataFrame]


def _to(refs: References, near: DataFrame) -> DataFrame:
    return refs(near) if callable(refs) else refs


class TooManyPaths(RuntimeError):
    """A tree of paths grew past the bound that was asked for."""


def called(resolved_out: DataFrame) -> DataFrame:
    """(src, dst) of calls, resolved where the target is a call; pairs may repeat."""
    out = resolved_out.where("kind = 'calls'")
    return out.select(F.col("source_id").alias("src"), F.when(F.col("target_kind") == "call", F.col("resolved_id")).otherwise(F.col("target_id")).alias("dst"))


def call_edges(resolved_out: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Distinct (src, dst) of calls, resolved where the target is a call."""
    return called(resolved_out).distinct()


def caller_edges(refs: DataFrame) -> DataFrame:
    """Distinct (src, dst) from a symbol to its callers."""
    return refs.where("kind = 'calls'").select(F.col("node_id").alias("src"), F.col("referrer_id").alias("dst")).distinct()


def trace(roots: DataFrame, steps: References, max_depth: int = 5, max_rows: int | None = 1_000_000) -> DataFrame:
    """(root_id, path, node_id, depth, cycle): the tree of paths from each root (column id) along steps (src, dst).

    A node that the path has already passed is listed with cycle set and not expanded; the node being expanded doesn't count as passed,
    so a direct self-call is listed once as a plain child. Siblings may repeat what other branches hold. Beyond max_rows rows of a
    level it fails rather than cut off.
    """
    level = roots.select(F.col("id").alias("root_id"), F.array("id").alias("path"), F.col("id").alias("node_id"), F.lit(0).alias("depth"), F.lit(False).alias("cycle"))
    found = None
    for depth in range(1, max_depth + 1):
        open_ = level.where("not cycle")
        at = _to(steps, open_.select("node_id"))
        near = at.join(open_.select(F.col("node_id").alias("src")).distinct(), "src", "left_semi")  # before the steps are made distinct, not after
        nxt = open_.join(near, open_.node_id == near.src).select(
            "root_id", F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("node_id"), F.lit(depth).alias("depth"), F.array_contains(F.slice("path", 1, F.size("path") - 1), F.col("dst")).alias("cycle")
        )
        level = save(nxt, "trace")
        n = level.count()
        if max_rows is not None and n > max_rows:
            raise TooManyPaths(f"{n} paths at depth {depth}")
        found = level if found is None else found.unionByName(level)
        if not n:
            break
    return found if found is not None else level.where("false")


def shortest_path(start: DataFrame, nodes: DataFrame, resolved_out: DataFrame, target_name: str, max_depth: int = 10) -> list[str] | None:
    """Ids of a shortest path from the one row of start to a node called target_name, or None.

    Breadth first over resolved calls, then base types. The start itself is never the target. Of several paths the one that first
    reaches its nodes wins: parents in order of discovery, calls before inherits, then edges by seq.
    """
    first = start.select("id").first()
    if first is None:
        return None
    step = resolved_out.select(F.col("source_id").alias("src"), F.col("resolved_id").alias("dst"), F.when(F.col("kind") == "calls", 0).otherwise(1).alias("k"), "seq")
    frontier = start.select("id", F.array("id").alias("path"), F.lit(0).cast("long").alias("place"))
    seen = start.select("id")
    for _ in range(max_depth):
        reached = frontier.join(step, frontier.id == step.src).select(F.col("dst").alias("id"), F.struct("place", "k", "seq", "src", "path").alias("how")).groupBy("id").agg(F.min("how").alias("how"))
        fresh = reached.join(seen, "id", "left_anti").join(nodes.select("id", "name"), "id")
        # Places within a level are dense only per partition of the sort; their order is all that matters.
        fresh = save(fresh.select("id", F.concat("how.path", F.array("id")).alias("path"), "name", "how"), "why")
        hit = fresh.where(F.col("name") == target_name).orderBy("how", "id").select("path").first()
        if hit is not None:
            return list(hit["path"])
        if fresh.limit(1).count() == 0:
            return None
        frontier = save(fresh.orderBy("how", "id").select("id", "path", F.monotonically_increasing_id().alias("place")), "why")
        seen = seen.unionByName(frontier.select("id"))
    return None


def reach(roots: DataFrame, refs: References, max_depth: int = 3) -> DataFrame:
    """(root_id, node_id, depth): every node that depends on a root within max_depth references, with the least depth. A root that
    depends on itself through others is listed too. This is plain reachability; impact() gives the depth-first tree."""
    frontier = roots.select(F.col("id").alias("root_id"), F.col("id").alias("node_id"))
    seen = None
    for depth in range(1, max_depth + 1):
        step = _to(refs, frontier.select("node_id")).select(F.col("node_id").alias("src"), F.col("referrer_id").alias("dst"))
        nxt = frontier.join(step, frontier.node_id == step.src).select("root_id", F.col("dst").alias("node_id")).distinct()
        if seen is not None:
            nxt = nxt.join(seen.select("root_id", "node_id"), ["root_id", "node_id"], "left_anti")
        frontier = save(nxt.withColumn("depth", F.lit(depth)), "reach")
        seen = frontier if seen is None else seen.unionByName(frontier)
        frontier = frontier.select("root_id", "node_id")
    return seen if seen is not None else roots.select(F.col("id").alias("root_id"), F.col("id").alias("node_id"), F.lit(0).alias("depth")).where("false")


def impact(root: DataFrame, refs: References, edges: DataFrame, max_depth: int = 3) -> list[dict]:
    """The tree of what depends on a symbol: dicts of node_id, relation, depth and, where there are any, dependents.

    A node is expanded only where depth-first search first comes to it, and one that it first meets at max_depth may still be expanded
    elsewhere. References are taken by path, then relation, then id. Spark finds the references within max_depth; the tree, whose size
    is what is returned, is put together here.
    """
    first = root.select("id").first()
    if first is None:
        return []
    near = reach(root, refs, max_depth - 1).select("node_id").unionByName(root.select(F.col("id").alias("node_id"))).distinct() if max_depth > 1 else root.select(F.col("id").alias("node_id"))
    of: dict[str, list] = {}
    order = {"calls": 0, "imports": 1, "inherits": 2}
    near = save(near, "near")
    for r in _to(refs, near).join(near, "node_id", "left_semi").select("node_id", "referrer_id", "kind", "path").toLocalIterator():
        of.setdefault(r.node_id, []).append((r.path, order[r.kind], r.referrer_id, r.kind))
    visited: set[str] = set()

    def expand(node: str, depth: int) -> list[dict]:
        if depth >= max_depth or node in visited:
            return []
        visited.add(node)
        out = []
        for _, _, who, kind in sorted(of.get(node, [])):
            entry = {"node_id": who, "relation": kind, "depth": depth + 1}
            if deeper := expand(who, depth + 1):
                entry["dependents"] = deeper
            out.append(entry)
        return out

    return expand(first["id"], 0)


def edges_at(edges: DataFrame, node_id: str, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The edges into a node and out of it, of one kind if given."""
    some = edges if kind is None else edges.where(F.col("kind") == kind)
    return some.where(F.col("target_id") == node_id), some.where(F.col("source_id") == node_id)


def path_counts(paths: DataFrame) -> DataFrame:
    """(depth, paths, cycles) of a trace."""
    return paths.groupBy("depth").agg(F.count("*").alias("paths"), F.count_if("cycle").alias("cycles"))


def tree_size(tree: list[dict], key: str = "dependents") -> tuple[int, int]:
    """How many nodes a tree has, and its greatest depth."""
    count, deepest, todo = 0, 0, list(tree)
    while todo:
        x = todo.pop()
        count, deepest = count + 1, max(deepest, x["depth"])
        todo += x.get(key, [])
    return count, deepest


def context(node_id: str, nodes: DataFrame, edges: DataFrame, depth: int = 1) -> dict[str, DataFrame]:
    """The node, its edges in and out and the nodes of its file; with a greater depth also the edges of its neighbours, one ring."""
    me = nodes.where(F.col("id") == node_id)
    into, out = edges_at(edges, node_id)
    found = {"node": me, "incoming": into, "outgoing": out, "file_nodes": nodes.join(me.select("file_path"), "file_path", "left_semi").orderBy(F.col("line_start").asc_nulls_first(), "seq", "id")}
    if depth > 1:
        ring = into.select(F.col("source_id").alias("n")).unionByName(out.select(F.col("target_id").alias("n"))).where(F.col("n") != node_id).distinct()
        ring = save(ring, "ring")  # of known size: edges aren't shuffled for a few neighbours
        found["deeper_incoming"] = edges.join(ring.select(F.col("n").alias("target_id")), "target_id", "left_semi")
        found["deeper_outgoing"] = edges.join(ring.select(F.col("n").alias("source_id")), "source_id", "left_semi")
    return found
