"""All graph queries over a store, as one object."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import analysis, cycles, diff, export, search, traverse
from codeloom.schema import Maybe
from codeloom.sources import parse, walk
from codeloom.sources.store import NotIndexed, Store, index

FIELDS = ("id", "name", "kind", "file_path", "language", "line_start", "line_end", "docstring", "code_snippet")


def clamp(limit: int) -> int:
    """Between 1 and 500."""
    return max(1, min(int(limit), 500))


class CodeGraph:
    """A version of a store, pinned when the object is made."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.store = spark, Store(spark, folder)
        self.version = self.store.version()

    def index(self, root: str, force: bool = False, dry_run: bool = False) -> dict[str, list[str]]:
        done = index(self.store, root, force, dry_run)
        self.version = self.store.version()
        return done

    def table(self, name: str) -> DataFrame:
        if not self.version:
            raise NotIndexed("there is no graph yet: run init")
        return self.store.table(name, self.version)

    nodes = property(lambda self: self.table("nodes"))
    edges = property(lambda self: self.table("edges"))
    refs = property(lambda self: self.table("refs"))
    out = property(lambda self: self.table("out"))

    # Search

    def search(self, text: str, kind: Maybe = None, language: Maybe = None, limit: int = 50, full_text: bool = False) -> DataFrame:
        find = search.search_full_text if full_text else search.search_nodes
        return find(self.nodes, text, kind, language, limit)

    def pick(self, name: str) -> DataFrame:
        """The node a name stands for, saved for repeated use."""
        return traverse.save(search.pick_symbol(self.nodes, name), "pick")

    def node(self, node_id: str) -> DataFrame:
        return search.by_id(self.nodes, node_id)

    def by_name(self, name: str, kind: str | None = None) -> DataFrame:
        return search.by_name(self.nodes, name, kind)

    def in_file(self, path: str) -> DataFrame:
        return search.in_file(self.nodes, path)

    def context(self, node_id: str, depth: int = 1) -> dict[str, DataFrame]:
        return traverse.context(node_id, self.nodes, self.edges, depth)

    # Traversal

    def _described(self, ids: list[str]) -> dict[str, dict]:
        if not ids:
            return {}
        wanted = self.spark.createDataFrame([(i,) for i in set(ids)], "id string")
        return {r.id: r.asDict() for r in self.nodes.join(wanted, "id", "left_semi").select(*FIELDS).collect()}

    def trace(self, name: str, max_depth: int = 5, direction: str = "both") -> dict:
        """Trees of callers and callees: node, depth, callers or callees, and cycle where the path comes back to what it passed."""
        root = self.pick(name)
        first = root.select(*FIELDS).first()
        out: dict = {"symbol": first.asDict() if first else None, "incoming": [], "outgoing": []}
        if first is None:
            return out
        for way, steps, key in (("incoming", traverse.caller_edges(self.refs), "callers"), ("outgoing", traverse.call_edges(self.out), "callees")):
            if direction not in ("both", way):
                continue
            rows = traverse.trace(root, steps, max_depth).select("path", "depth", "cycle").collect()
            known = self._described([r.path[-1] for r in rows])
            entries: dict[tuple, dict] = {(first.id,): out}
            order = lambda r: (r.depth, [(known.get(x, {}).get("file_path", ""), known.get(x, {}).get("line_start") or 0, x) for x in r.path[1:]])
            for r in sorted(rows, key=order):
                entry = {"node": known.get(r.path[-1]), "depth": r.depth}
                if r.cycle:
                    entry["cycle"] = True
                above = entries[tuple(r.path[:-1])]
                above.setdefault(way if above is out else key, []).append(entry)
                entries.setdefault(tuple(r.path), entry)
        return out

    def impact(self, name: str, max_depth: int = 3) -> dict:
        root = self.pick(name)
        first = root.select(*FIELDS).first()
        if first is None:
            return {"symbol": None, "dependents": []}
        tree, ids = traverse.impact(root, self.refs, self.edges, max_depth), []
        todo = list(tree)
        while todo:
            x = todo.pop()
            ids.append(x["node_id"])
            todo += x.get("dependents", [])
        known, todo = self._described(ids), list(tree)
        while todo:
            x = todo.pop()
            x["node"] = known.get(x.pop("node_id"))
            todo += x.get("dependents", [])
        return {"symbol": first.asDict(), "dependents": tree}

    def why(self, a: str, b: str, max_depth: int = 10) -> dict:
        """A shortest path of calls and base types from a to b, else from b to a; its direction is told, not turned round."""
        found = dict(found=False, direction=None, path=[])
        starts = {n: self.pick(n) for n in (a, b)}
        for n, s in starts.items():
            if not s.limit(1).count():
                return found | {"reason": f"There is no symbol {n}"}
        for direction, source, target in (("forward", a, b), ("backward", b, a)):
            path = traverse.shortest_path(starts[source], self.nodes, self.out, target, max_depth)
            if path:
                known = self._described(path)
                return {"found": True, "direction": direction, "path": [known[i] for i in path], "reason": ""}
        return found | {"reason": f"No path between {a} and {b} within {max_depth} steps"}

    # Analysis

    def dead_code(self, entrypoints: list[str] | None = None, limit: int = 100) -> DataFrame:
        return analysis.dead_code(self.nodes, self.refs, entrypoints, limit)

    def hotspots(self, limit: int = 20, min_references: int = 2) -> DataFrame:
        return analysis.hotspots(self.nodes, self.refs, limit, min_references)

    def metrics(self, name: str) -> DataFrame:
        return analysis.symbol_metrics(self.nodes, self.edges, self.refs, name, self.out)

    def cycles(self) -> DataFrame:
        return cycles.import_cycles(self.table("file_imports"))

    def stats(self) -> dict:
        """Totals, histograms by falling count, and bytes of the store."""
        out: dict = {"language": {}, "kind": {}, "edge_kind": {}}
        for r in sorted(analysis.stats(self.nodes, self.edges).collect(), key=lambda r: (-r.value, r.key)):
            if r.key or r.metric in out:
                out[r.metric][r.key] = r.value
            else:
                out[r.metric] = r.value
        return out | {"store_bytes": self.store.size()}

    def languages(self) -> DataFrame:
        return analysis.languages(self.nodes)

    def diff(self, root: str, ref: str) -> DataFrame:
        """Symbols added and removed in a working tree since ref; the store isn't used."""
        v = walk.git_versions(self.spark, root, ref).cache()
        files = lambda c: v.where(F.col(c).isNotNull()).select("file_path")
        return diff.symbol_diff(parse.symbols(v, "old"), parse.symbols(v, "new"), files("old"), files("new")).orderBy("file_path")

    # Export

    def export(self, form: str, kind: Maybe = None, language: Maybe = None, limit: int | None = None, edge_kinds: list[str] | None = None, diagram_type: str = "flowchart") -> str:
        n, e = export.subgraph(self.nodes, self.edges, kind, language, limit, edge_kinds)
        if form == "mermaid":
            return export.to_mermaid(n, e, diagram_type)
        return {"dot": export.to_dot, "json": export.to_json, "html": export.to_html}[form](n, e)

    def architecture(self) -> str:
        return export.architecture_mermaid(self.nodes, self.edges, self.refs, self.table("sites"))
