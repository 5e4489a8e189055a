"""Import cycles: strongly connected components of the file import graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.sources.tables import save

#: Graphs of up to so many edges are settled in the driver, with the same result.
LOCAL_EDGES = 200_000
#: Those of up to so many are settled as arrays in one task, at about 20 bytes an edge, with the same result.
TASK_EDGES = 50_000_000


def trim(edges: DataFrame) -> DataFrame:
    """edges (src, dst) without those at vertices that nothing enters or nothing leaves, over and over: these are in no cycle."""
    edges = save(edges.distinct(), "trim")
    n = edges.count()
    while n:
        kept = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        edges = save(kept.select("src", "dst"), "trim")
        was, n = n, edges.count()
        if n == was:
            break
    return edges


def _labels(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v, label): the least vertex that reaches v along edges."""
    labels = save(vertices.select("v", F.col("v").alias("label")), "label")
    while True:
        come = edges.join(labels, edges.src == labels.v).groupBy("dst").agg(F.min("label").alias("m"))
        new = save(labels.join(come, labels.v == come.dst, "left").select("v", F.least("label", F.coalesce("m", "label")).alias("label"), (F.col("m") < F.col("label")).alias("moved")), "label")
        if not new.where("moved").limit(1).count():
            return labels
        labels = new.select("v", "label")


def _components(edges: list[tuple[str, str]]) -> dict[str, str]:
    """The vertices on cycles, each with the least of its component: Tarjan's algorithm with a stack of its own."""
    of: dict[str, list[str]] = {}
    for a, b in edges:
        of.setdefault(a, []).append(b)
    order, low, stack, on, found = {}, {}, [], set(), {}
    for root in of:
        if root in order:
            continue
        work = [(root, iter(of[root]))]
        order[root] = low[root] = len(order)
        stack.append(root)
        on.add(root)
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in order:
                    order[w] = low[w] = len(order)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(of.get(w, ()))))
                    break
                if w in on:
                    low[v] = min(low[v], order[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == order[v]:
                    part = []
                    while not part or part[-1] != v:
                        part.append(stack.pop())
                        on.discard(part[-1])
                    if len(part) > 1 or v in of.get(v, ()):
                        found |= dict.fromkeys(part, min(part))
    return found


def _numbered(batches: Iterator[pa.RecordBatch]) -> tuple[list[str], np.ndarray]:
    """The vertices, and the edges (src, dst) as numbers of vertices, both in one integer."""
    number: dict[str, int] = {}
    keys = []
    for b in batches:
        ends = []
        for c in (b.column(0), b.column(1)):
            c = c.dictionary_encode()
            of = np.array([number.setdefault(v, len(number)) for v in c.dictionary.to_pylist()], np.int64)
            ends.append(of[c.indices.to_numpy()] if len(of) else np.empty(0, np.int64))
        keys.append(ends[0] << 32 | ends[1])
    return list(number), np.concatenate(keys) if keys else np.empty(0, np.int64)


def _components_of_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_components over arrays: the vertices on cycles, each with the least of its component. Edges may repeat."""
    names, keys = _numbered(batches)
    keys.sort()
    to = (keys & 0xFFFFFFFF).astype(np.int32)
    keys >>= 32
    at = np.searchsorted(keys, np.arange(len(names) + 1)).tolist()
    del keys
    low, order, on = [0] * len(names), [-1] * len(names), bytearray(len(names))
    stack, met = [], 0
    v_out, c_out = [], []
    for root in range(len(names)):
        if order[root] >= 0:
            continue
        work = [(root, iter(to[at[root] : at[root + 1]].tolist()))]
        order[root] = low[root] = met
        met += 1
        stack.append(root)
        on[root] = 1
        while work:
            v, rest = work[-1]
            for w in rest:
                if order[w] < 0:
                    order[w] = low[w] = met
                    met += 1
                    stack.append(w)
                    on[w] = 1
                    work.append((w, iter(to[at[w] : at[w + 1]].tolist())))
                    break
                if on[w] and order[w] < low[v]:
                    low[v] = order[w]
            else:
                work.pop()
                if work and low[v] < low[work[-1][0]]:
                    low[work[-1][0]] = low[v]
                if low[v] == order[v]:
                    k = len(stack) - 1
                    while stack[k] != v:
                        k -= 1
                    part = stack[k:]
                    del stack[k:]
                    for x in part:
                        on[x] = 0
                    if len(part) > 1 or (to[at[v] : at[v + 1]] == v).any():
                        part = [names[x] for x in part]
                        v_out += part
                        c_out += [min(part)] * len(part)
    for k in range(0, len(v_out), 50_000):
        yield pa.RecordBatch.from_pydict({"v": v_out[k : k + 50_000], "component": c_out[k : k + 50_000]}, pa.schema([("v", pa.string()), ("component", pa.string())]))


def strong_components(edges: DataFrame, local_edges: int = LOCAL_EDGES, task_edges: int = TASK_EDGES) -> DataFrame:
    """(v, component): the vertices on cycles, each with the least vertex of its strongly connected component. Self-loops count.

    Up to local_edges edges are gathered and settled at once, up to task_edges as arrays in one task. Beyond that, in each round the
    least vertex that reaches each vertex is found forwards; the vertices that reach it back, within its colour, are its component.
    These go, the rest is trimmed, and the next round begins; how many rounds, depends on how deep the graph is.
    """
    edges = save(edges.select("src", "dst").distinct(), "edges")
    n = edges.count()
    if n <= local_edges:
        return edges.sparkSession.createDataFrame(sorted(_components([(r.src, r.dst) for r in edges.collect()]).items()), "v string, component string")
    if n <= task_edges:
        return save(edges.coalesce(1).mapInArrow(_components_of_arrays, "v string, component string"), "components")
    loops = edges.where("src = dst").select(F.col("src").alias("v")).distinct()
    left, done = trim(edges.where("src <> dst")), None
    while left.limit(1).count():
        vertices = left.select(F.explode(F.array("src", "dst")).alias("v")).distinct()
        colour = _labels(left, vertices)
        same = save(left.join(colour.select(F.col("v").alias("src"), F.col("label").alias("a")), "src").join(colour.select(F.col("v").alias("dst"), F.col("label").alias("b")), "dst").where("a = b").select("src", "dst", F.col("a").alias("label")), "same")
        # Backwards from each colour's own vertex.
        found = save(colour.where("v = label").select("v", "label"), "found")
        frontier = found
        while frontier.limit(1).count():
            back = same.join(frontier.select(F.col("v").alias("dst"), F.col("label").alias("l")), "dst").where("label = l").select(F.col("src").alias("v"), "label").distinct()
            frontier = save(back.join(found, ["v", "label"], "left_anti"), "frontier")
            found = save(found.unionByName(frontier), "found")
        part = found.select("v", F.col("label").alias("component"))
        done = part if done is None else done.unionByName(part)
        rest = left.join(found.select(F.col("v").alias("src")), "src", "left_anti").join(found.select(F.col("v").alias("dst")), "dst", "left_anti")
        left = trim(rest)
    alone = loops if done is None else loops.join(done.select("v"), "v", "left_anti")
    alone = alone.select("v", F.col("v").alias("component"))
    if done is None:
        return alone
    sizes = done.groupBy("component").count().where("count > 1").select("component")
    return done.join(sizes, "component", "left_semi").select("v", "component").unionByName(alone)


def witness(members: list[str], edges: dict[str, list[str]]) -> list[str]:
    """The shortest cycle through the least member of a component, back to where it began; of several, the first in order of names."""
    inside, start = set(members), min(members)
    level, seen = {start: (start,)}, {start}
    while level:
        back = [p for v, p in level.items() if start in edges.get(v, ())]
        if back:
            return [*min(back), start]
        further: dict[str, tuple] = {}
        for v, p in level.items():
            for w in edges.get(v, ()):
                if w in inside and w not in seen:
                    further[w] = min(further.get(w, (*p, w)), (*p, w))
        seen |= further.keys()
        level = further
    return []


_CYCLE = "component string, cycle array<string>"


def _witness_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(component, cycle) of edges (component, src, dst) that come in order of components."""
    schema = pa.schema([("component", pa.string()), ("cycle", pa.list_(pa.string()))])
    now, of, out = None, {}, []
    for b in batches:
        for c, src, dst in zip(*(x.to_pylist() for x in b.columns)):
            if c != now:
                if of:
                    out.append({"component": now, "cycle": witness(list(of), of)})
                now, of = c, {}
            of.setdefault(src, []).append(dst)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if of:
        yield pa.RecordBatch.from_pylist([{"component": now, "cycle": witness(list(of), of)}], schema)


def _witnesses(inside: DataFrame, local_edges: int) -> DataFrame:
    """(component, cycle) for the edges (component, src, dst) within components: many components a task, and those of over local_edges edges together, a level at a time."""
    large = [r.component for r in inside.groupBy("component").count().where(F.col("count") > local_edges).select("component").collect()]
    some = inside.where(~F.col("component").isin(large)) if large else inside
    small = save(some.select("component", "src", "dst").repartition("component").sortWithinPartitions("component").mapInArrow(_witness_each, _CYCLE), "cycles")
    if not large:
        return small
    inside = inside.where(F.col("component").isin(large))
    level = inside.select("component", F.col("component").alias("at"), F.array("component").alias("path")).distinct()
    seen, found = level.select("component", "at"), small
    while True:
        steps = save(level.join(inside.select("component", F.col("src").alias("at"), "dst"), ["component", "at"]).groupBy("component", "dst").agg(F.min(F.concat("path", F.array("dst"))).alias("path")), "cycles")
        found = found.unionByName(steps.where("dst = component").select("component", F.col("path").alias("cycle")))
        on = steps.join(steps.where("dst = component").select("component"), "component", "left_anti").withColumnRenamed("dst", "at").join(seen, ["component", "at"], "left_anti")
        level = save(on.select("component", "at", "path"), "cycles")
        if not level.limit(1).count():
            return found
        seen = seen.unionByName(level.select("component", "at"))


def import_cycles(file_imports: DataFrame, local_edges: int = LOCAL_EDGES, task_edges: int = TASK_EDGES) -> DataFrame:
    """(component, size, files, cycle), greatest first: groups of files that import each other, and one shortest cycle in each."""
    e = save(file_imports.select(F.col("src_file").alias("src"), F.col("dst_file").alias("dst")), "imports")
    members = save(strong_components(e, local_edges, task_edges), "components")
    inside = save(e.join(members.select(F.col("v").alias("src"), "component"), "src").join(members.select(F.col("v").alias("dst"), F.col("component").alias("c2")), "dst").where("component = c2").select("component", "src", "dst"), "inside")
    files = members.groupBy("component").agg(F.count("*").alias("size"), F.sort_array(F.collect_list("v")).alias("files"))
    out = files.join(_witnesses(inside, local_edges), "component").select("component", "size", "files", "cycle")
    return out.orderBy(F.col("size").desc(), F.col("files")[0])
