"""Graph exports: DOT, Mermaid, JSON, a page for browsers, and the diagram of an architecture.

Lines are made by Spark, one per node or edge; what is returned as one string is limited by what is asked for.
"""

from __future__ import annotations

import json
import re
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.names import LAYER_LABELS, component_role, is_architecture_file, stem
from codeloom.operators.analysis import component_deps, layer_top, stats
from codeloom.operators.search import filtered
from codeloom.schema import Maybe
from codeloom.sources.tables import save

LAYER_ORDER = "entrypoints queries graph parsers indexer static other".split()


def subgraph(nodes: DataFrame, edges: DataFrame, kind: Maybe = None, language: Maybe = None, limit: int | None = None, edge_kinds: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The nodes asked for, in order of seq, and the edges that have both ends among them."""
    n = filtered(nodes, kind, language)
    if limit is not None:
        n = n.orderBy("seq", "id").limit(limit)
    ids = n.select("id")
    e = edges.where(F.col("kind").isin(*edge_kinds)) if edge_kinds else edges
    e = e.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return n, e.select("source_id", "target_id", "kind", "seq")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree) of nodes within edges; a loop counts twice."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def _id(c: str, mark: str) -> Column:
    return F.concat(F.lit(mark), F.replace(F.col(c), F.lit("-"), F.lit("_")))


def _per_kind(values: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(F.col("kind") == k, v).otherwise(out)
    return out


def _lines(df: DataFrame, line: Column, *order: str) -> list[str]:
    return [r.line for r in df.orderBy(*order).select(line.alias("line")).toLocalIterator()]


def dot_lines(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines of nodes and of edges as tables, to be written as text where there are too many for one string."""
    shape = _per_kind({"class": "box"}, "ellipse")
    colour = _per_kind({"class": "lightblue", "function": "lightgreen", "method": "lightyellow"}, "white")
    label = F.replace(F.replace(F.col("name"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    n = nodes.select("seq", "id", F.concat(F.lit("  "), _id("id", "n_"), F.lit(' [label="'), label, F.lit('", shape='), shape, F.lit(", style=filled, fillcolor="), colour, F.lit("];")).alias("line"))
    e = edges.select("seq", "source_id", "target_id", F.concat(F.lit("  "), _id("source_id", "n_"), F.lit(" -> "), _id("target_id", "n_"), F.lit(' [label="'), F.col("kind"), F.lit('"];')).alias("line"))
    return n, e


def to_dot(nodes: DataFrame, edges: DataFrame) -> str:
    n, e = dot_lines(nodes, edges)
    head = ["digraph code {", "  rankdir=LR;", *(f"  {what} [fontsize={size}, fontname=Helvetica];" for what, size in (("node", 11), ("edge", 9)))]
    return "\n".join([*head, *_lines(n, F.col("line"), "seq", "id"), *_lines(e, F.col("line"), "seq", "source_id", "target_id"), "}"])


def mermaid_lines(nodes: DataFrame, edges: DataFrame, diagram_type: str = "flowchart") -> tuple[DataFrame, DataFrame]:
    """The same for Mermaid; of a class diagram, a block for each class, method and function."""
    if diagram_type == "classDiagram":
        arrow = _per_kind({"contains": "*--", "inherits": "--|>"} | dict.fromkeys(("imports", "calls"), "..>"), "-->")
        shown = nodes.where(F.col("kind").isin("class", "method", "function")).withColumn("at", _per_kind({"class": "0", "method": "1"}, "2"))
        block = F.concat(F.lit("  class "), _id("id", "n"), F.lit(" {\n    %% "), F.col("name"), F.when(F.col("kind") == "class", "").otherwise("()"), F.lit("\n  }"))
        link = F.concat(F.lit("  "), _id("source_id", "n"), F.lit(" "), arrow, F.lit(" "), _id("target_id", "n"))
        return shown.select("at", "seq", "id", block.alias("line")), edges.select("seq", "source_id", "target_id", link.alias("line"))
    left, right = _per_kind({"class": "[[", "function": "(", "method": ">"}, "{"), _per_kind({"class": "]]", "function": ")", "method": "]"}, "}")
    box = F.concat(F.lit("  "), _id("id", "n"), left, F.lit('"'), F.replace(F.col("name"), F.lit('"'), F.lit("'")), F.lit('"'), right)
    link = F.concat(F.lit("  "), _id("source_id", "n"), F.lit(" -->|"), F.col("kind"), F.lit("| "), _id("target_id", "n"))
    return nodes.select(F.lit("0").alias("at"), "seq", "id", box.alias("line")), edges.select("seq", "source_id", "target_id", link.alias("line"))


def to_mermaid(nodes: DataFrame, edges: DataFrame, diagram_type: str = "flowchart") -> str:
    n, e = mermaid_lines(nodes, edges, diagram_type)
    return "\n".join(["classDiagram" if diagram_type == "classDiagram" else "flowchart LR", *_lines(n, F.col("line"), "at", "seq", "id"), *_lines(e, F.col("line"), "seq", "source_id", "target_id")])


NODE_FIELDS = ("id", "name", "kind", "file_path", "language", "line_start", "line_end", "docstring")


def json_lines(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    options = {"ignoreNullFields": "false"}
    n = nodes.select("seq", "id", F.to_json(F.struct(*NODE_FIELDS), options).alias("line"))
    e = edges.select("seq", "source_id", "target_id", F.to_json(F.struct("source_id", "target_id", "kind"), options).alias("line"))
    return n, e


def to_json(nodes: DataFrame, edges: DataFrame) -> str:
    n, e = json_lines(nodes, edges)
    data = {"nodes": [json.loads(x) for x in _lines(n, F.col("line"), "seq", "id")], "edges": [json.loads(x) for x in _lines(e, F.col("line"), "seq", "source_id", "target_id")]}
    return json.dumps(data, indent=2)


def html_lines(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JSON of each node, val being its degree, and of each link."""
    sized = nodes.join(degrees(nodes, edges).withColumnRenamed("degree", "val"), "id")
    options = {"ignoreNullFields": "false"}
    n = sized.select("seq", "id", F.to_json(F.struct(*NODE_FIELDS, "val"), options).alias("line"))
    return n, edges.select("seq", "source_id", "target_id", F.to_json(F.struct(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "kind"), options).alias("line"))


def html_payload(nodes: DataFrame, edges: DataFrame) -> str:
    """The graph as JSON that can stand inside a script element."""
    of_nodes, of_links = html_lines(nodes, edges)
    n, e = _lines(of_nodes, F.col("line"), "seq", "id"), _lines(of_links, F.col("line"), "seq", "source_id", "target_id")
    return f'{{"nodes": [{", ".join(n)}], "links": [{", ".join(e)}]}}'.replace("</", "<\\/")


def to_html(nodes: DataFrame, edges: DataFrame) -> str:
    """A page of its own that draws the graph in 3-D, turns it, searches it and shows details; it loads nothing."""
    page = resources.files("codeloom.operators").joinpath("graph_page.html").read_text(encoding="utf-8")
    return page.replace("@@GRAPH@@", html_payload(nodes, edges))


def common_prefix(paths: list[str]) -> str:
    split = [re.split(r"[\\/]", p) for p in paths]
    out = []
    for parts in zip(*split):
        if len(set(parts)) > 1:
            break
        out.append(parts[0])
    return "/".join(out)


def _component_id(path: str, prefix: str) -> str:
    rel = path[len(prefix) :].lstrip("/") if prefix and path.startswith(prefix + "/") else path
    return "comp_" + re.sub(r"src[\\/]", "", rel).translate(str.maketrans("\\/.-", "____"))


def architecture(nodes: DataFrame, refs: DataFrame, sites: DataFrame | None = None, ends: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The components to show, with their layer, place, role, stem, symbols and degree, and the dependencies between them."""
    deps = save(component_deps(nodes, refs, sites, ends), "deps")
    top = save(layer_top(nodes, deps).withColumns({"role": component_role(F.col("file_path")), "stem": stem(F.col("file_path"))}), "top")
    chosen = top.select("file_path")  # some components of each layer
    return top, deps.join(chosen.withColumnRenamed("file_path", "src_file"), "src_file", "left_semi").join(chosen.withColumnRenamed("file_path", "dst_file"), "dst_file", "left_semi").select("src_file", "dst_file", "kinds").orderBy("src_file", "dst_file")


def architecture_mermaid(nodes: DataFrame, edges: DataFrame, refs: DataFrame, sites: DataFrame | None = None) -> str:
    """Layers with their main components, what these depend on, and totals."""
    if not nodes.limit(1).count():
        return "graph TD\n  empty[The graph is empty: run init]"
    files = nodes.where(is_architecture_file(F.col("file_path")))
    ends = files.agg(F.min("file_path").alias("a"), F.max("file_path").alias("z")).first()
    if ends["a"] is None:
        return "graph TD\n  empty[There is no component to show]"
    prefix = common_prefix([ends["a"], ends["z"]])  # what the least and the greatest path share, all share
    top, shown = (x.collect() for x in architecture(nodes, refs, sites))
    out = ["graph TD", *(f"  classDef {name}Class fill:{fill},stroke:#445" for name, fill in (("layer", "#dce9fb"), ("component", "#eef7ee"), ("stats", "#fbf3da")))]
    for name in LAYER_ORDER:
        rows = sorted((r for r in top if r.layer == name), key=lambda r: r.place)
        if not rows:
            continue
        out.append(f'  subgraph {name}["{LAYER_LABELS[name]}"]')
        for r in rows:
            me = _component_id(r.file_path, prefix)
            text = f"{r.stem}<br/>{r.role}<br/>~{r.symbols} symbols, {r.degree} links".replace('"', "'")
            out += [f'    {me}["{text}"]', f"    class {me} componentClass;"]
        out += ["  end", f"  class {_component_id(rows[0].file_path, prefix)} layerClass;"]
    out += [f'  {_component_id(r.src_file, prefix)} -->|"{", ".join(r.kinds)}"| {_component_id(r.dst_file, prefix)}' for r in shown]
    facts = stats(nodes, edges).collect()
    total = {r.metric: r.value for r in facts if not r.key}
    languages = ", ".join(r.key for r in sorted((r for r in facts if r.metric == "language"), key=lambda r: (-r.value, r.key))) or "-"
    out += ["", '  subgraph Stats["Repository Stats"]']
    out += [f'    {k}["{label}: {v}"]' for k, label, v in (("total_nodes", "Total nodes", total["total_nodes"]), ("total_edges", "Total edges", total["total_edges"]), ("total_files", "Total files", total["total_files"]), ("languages", "Languages", languages))]
    return "\n".join([*out, "  end", "  class " + ",".join((*total, "languages")) + " statsClass;"])
