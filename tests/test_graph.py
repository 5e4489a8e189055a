"""Graph operators on hand-made graphs, and against a plain reading of their definitions on random ones."""

import random

import pytest

from codeloom.functions.names import import_symbol, import_tail, stem, substring_like
from codeloom.operators import analysis, cycles, diff, export, search, spine, traverse
from codeloom.schema import EDGES, NODES, last_wins
from pyspark.sql import functions as F


def graph(spark, nodes, edges):
    """nodes: (id, kind, file, name=id, line=None, external=False); edges: (source, target, kind)."""
    rows = []
    for seq, n in enumerate(nodes):
        id_, kind, path, name, line, ext = (*n, *(None, None, False)[len(n) - 3 :])
        rows.append((id_, name or id_, kind, path, "python", line, None, None, None, "{}", ext, seq))
    return spark.createDataFrame(rows, NODES), spark.createDataFrame([(a, b, k, "{}", "", i) for i, (a, b, k) in enumerate(edges)], EDGES)


def refs(spark, nodes, edges):
    n, e = graph(spark, nodes, edges)
    return {(r.node_id, r.referrer_id, r.kind) for r in spine.real_refs(n, e).collect()}


def test_references(spark):
    f = "function"
    call = [("defn", f, "lib.py", "helper"), ("site", "call", "app.py", "helper"), ("caller", f, "app.py")]
    assert ("defn", "caller", "calls") in refs(spark, call, [("caller", "site", "calls")])
    assert [r for r in refs(spark, call, [("caller", "site", "calls"), ("caller", "defn", "calls")]) if r[0] == "defn"] == [("defn", "caller", "calls")]
    stub = [("base", "class", "base.py", "Base"), ("s", "class", "child.py", "Base", None, True), ("child", "class", "child.py")]
    assert ("base", "child", "inherits") in refs(spark, stub, [("child", "s", "inherits")])
    imported = [("g", f, "config.py", "get_config"), ("i", "import", "user.py", "config.get_config"), ("file", "file", "user.py")]
    assert ("g", "file", "imports") in refs(spark, imported, [("file", "i", "imports")])
    both = [("a", f, "mod_a.py", "connect"), ("b", f, "mod_b.py", "connect"), ("i", "import", "caller.py", "mod_a.connect"), ("s", "call", "caller.py", "connect"), ("c", f, "caller.py"), ("file", "file", "caller.py")]
    got = refs(spark, both, [("file", "i", "imports"), ("c", "s", "calls")])
    assert {("a", "file", "imports"), ("a", "c", "calls")} <= got and not any(r[0] == "b" for r in got)


def test_homonyms(spark):
    two = [("x", "class", "x/base.py", "Base"), ("y", "class", "y/base.py", "Base"), ("s", "class", "child.py", "Base", None, True), ("c", "class", "child.py")]
    assert {r for r in refs(spark, two, [("c", "s", "inherits")]) if r[0] in "xy"} == {("x", "c", "inherits")}
    twice = [("a1", "function", "a.py", "run", 1), ("b1", "function", "b.py", "run", 1), ("b2", "function", "b.py", "run", 9), ("s", "call", "b.py", "run"), ("c", "function", "b.py")]
    assert ("a1", "c", "calls") in refs(spark, twice, [("c", "s", "calls")])


def brute_resolve(nodes, name, ref):
    def tail(n):
        m = (n.rpartition(".")[0] if "." in n else n).rstrip("/")
        return m.rsplit("/", 1)[-1] if "/" in m else m.rsplit(".", 1)[-1]

    def stem_of(p):
        from pathlib import PurePosixPath

        return PurePosixPath(p).stem

    c = [(n[2], n[4] or 0, k, n[0]) for k, n in enumerate(nodes) if n[1] in ("function", "method", "class") and not n[5] and n[3] == name]
    if len(c) < 2:
        return c[0][3] if c else None
    same = [x for x in c if x[0] == ref]
    if len(same) == 1:
        return same[0][3]
    brought = [x for x in c if any(i[1] == "import" and i[2] == ref and "." in i[3] and i[3].rpartition(".")[2] == name and tail(i[3]) == stem_of(x[0]) for i in nodes)]
    return brought[0][3] if len(brought) == 1 else min(c)[3]


def test_resolution_on_random_graphs(spark):
    r = random.Random(11)
    files, names = ["a.py", "b.py", "pkg/a.py", "c.d.py"], ["f", "g", "h"]
    for trial in range(4):
        nodes = [(f"n{k}", r.choice(["function", "class", "call", "import"]), r.choice(files), None, r.choice([None, 1, 5]), False) for k in range(40)]
        nodes = [(i, k, p, (f"{r.choice(['a', 'b', 'c.d', 'x/b', '.a'])}.{r.choice(names)}" if k == "import" else r.choice(names)), l, k == "class" and r.random() < 0.3) for i, k, p, _, l, _ in nodes]
        n, _ = graph(spark, nodes, [])
        sites = spark.createDataFrame([(f, x) for f in files for x in [*names, "none"]], "ref_file string, name string")
        for row in spine.resolve_sites(sites, n).collect():
            assert row.def_id == brute_resolve(nodes, row.name, row.ref_file), (trial, row)


ANALYSIS = ([("main", "function", "test.py"), ("helper_a", "function", "a.py", None, 10), ("helper_b", "function", "b.py", None, 20), ("utility", "function", "c.py", None, 30), ("dead_func", "function", "d.py", None, 40), ("orphan_class", "class", "e.py", None, 50)], [("main", "helper_a", "calls"), ("main", "helper_b", "calls"), ("helper_a", "utility", "calls"), ("helper_b", "utility", "calls")])


def test_dead_code_and_hotspots(spark):
    n, e = graph(spark, *ANALYSIS)
    r = spine.real_refs(n, e)
    assert [x.id for x in analysis.dead_code(n, r).collect()] == ["dead_func", "orphan_class"]
    assert {x.id for x in analysis.dead_code(n, r, ["dead_func"]).collect()} == {"main", "orphan_class"}
    assert [(x.id, x.references) for x in analysis.hotspots(n, r).collect()] == [("utility", 2)]
    assert analysis.dead_code(n, r, limit=1).count() == 1


def test_metrics(spark):
    n, e = graph(spark, [("f", "function", "a.py", "helper", 10), ("g", "function", "b.py", "helper"), ("c", "function", "c.py"), ("s", "call", "c.py", "nowhere")], [("c", "f", "calls"), ("c", "s", "calls"), ("c", "f", "inherits")])
    n = n.withColumn("line_end", F.when(F.col("id") == "f", 15).cast("int"))
    rows = {x.id: x for x in analysis.symbol_metrics(n, e, spine.real_refs(n, e), "helper").collect()}
    assert (rows["f"].fan_in, rows["f"]["loc"], rows["g"].fan_in, rows["g"]["loc"]) == (1, 6, 0, None)
    assert analysis.symbol_metrics(n, e, spine.real_refs(n, e), "c").first().fan_out == 2


def test_names(spark):
    cases = {"utils.helpers.greet": ("greet", "helpers"), ".helpers.f": ("f", "helpers"), "..x": ("x", ""), "os.path": ("path", "os"), "fmt": (None, "fmt"), "@app/utils": (None, "utils"), "./utils": ("/utils", ""), "./utils.js": ("js", "utils"), "github.com/foo/bar": ("com/foo/bar", "github"), "std::fs::File": (None, "std::fs::File"), "a/b/": (None, "b")}
    df = spark.createDataFrame([(k,) for k in cases], "n string").select("n", import_symbol(F.col("n")).alias("s"), import_tail(F.col("n")).alias("t"))
    assert {r.n: (r.s, r.t) for r in df.collect()} == cases
    stems = {"a/b.c.py": "b.c", ".hidden": ".hidden", "x/.env.py": ".env", "plain": "plain", "d/": ""}
    assert {r.p: r.s for r in spark.createDataFrame([(k,) for k in stems], "p string").select("p", stem(F.col("p")).alias("s")).collect()} == stems
    like = lambda name, q: spark.createDataFrame([(name,)], "n string").where(substring_like(F.col("n"), q)).count() == 1
    assert like("getUser", "TUS") and like("abc", "a%c") and like("abc", "a_c") and not like("É", "é") and like("a\\b", "\\") and like("x", "")


def test_search_and_pick(spark):
    n, _ = graph(spark, [(f"c{k}", "call", "a.py", "run") for k in range(12)] + [("d", "class", "z.py", "run_all"), ("f", "function", "z.py", "run", 3)], [])
    assert [x.id for x in search.search_nodes(n, "run").collect()][0] == "f"
    assert search.pick_symbol(n, "run").first().id == "f"
    assert search.pick_symbol(n, "run_").first().id == "d"  # the mark stands for any letter, yet "run_all" alone is long enough
    assert search.search_nodes(n, "run", kind="class").count() == 1
    assert search.pick_symbol(n, "absent").count() == 0


def test_full_text(spark):
    rows = [("1", "get_user", "Finds a café", None), ("2", "getUser", None, "def get(): user"), ("3", "other", "get the user", ""), ("4", "user_get", None, None)]
    df = spark.createDataFrame(rows, "id string, name string, docstring string, code_snippet string")
    ids = lambda q: {r.id for r in search.full_text(df, q).collect()}
    assert ids("get user") == {"1", "2"} == ids("get_user") and ids("CAFE") == {"1"} and ids("getuser") == {"2"}
    assert ids("get*") == {"1", "2", "3", "4"} and ids("get AND user NOT the") == {"1", "2", "4"} and ids("café OR other") == {"1", "3"} and ids('foo"bar') == set()
    for bad in ("foo AND", "OR", "(a AND b"):
        with pytest.raises(search.FullTextSyntaxError):
            search.full_text(df, bad)
    assert all(r.score < 0 for r in search.full_text(df, "get*").collect())


def steps(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def roots(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def brute_trace(adj, path, depth):
    out = []
    for d in adj.get(path[-1], []):
        cycle = d in path[:-1]
        out.append((tuple(path + [d]), len(path), cycle))
        if not cycle and depth > 1:
            out += brute_trace(adj, path + [d], depth - 1)
    return out


def test_traces(spark):
    r = random.Random(3)
    cases = [[("a", "b"), ("b", "a")], [("a", "a")], [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], sorted({(r.choice("abcde"), r.choice("abcde")) for _ in range(9)})]
    for pairs in cases:
        adj = {}
        for a, b in pairs:
            adj.setdefault(a, []).append(b)
        got = [(tuple(x.path), x.depth, x.cycle) for x in traverse.trace(roots(spark, "a"), steps(spark, pairs)).collect()]
        assert sorted(got) == sorted(brute_trace(adj, ["a"], 5))
    with pytest.raises(traverse.TooManyPaths):
        traverse.trace(roots(spark, "a"), steps(spark, [("a", "b"), ("a", "c")]), 2, max_rows=1)


def test_why(spark):
    n, e = graph(spark, [(x, "function", "f.py") for x in ("top", "middle", "bottom", "isolated")], [("top", "middle", "calls"), ("middle", "bottom", "calls")])
    out = spine.resolved_out(n, e)
    assert traverse.shortest_path(roots(spark, "top"), n, out, "bottom") == ["top", "middle", "bottom"]
    assert traverse.shortest_path(roots(spark, "bottom"), n, out, "top") is None
    assert traverse.shortest_path(roots(spark, "top"), n, out, "bottom", 1) is None
    assert traverse.shortest_path(roots(spark, "top"), n, out, "bottom", 2) is not None


def brute_impact(adj, node, depth, at=0, visited=None):
    visited = set() if visited is None else visited
    if at >= depth or node in visited:
        return []
    visited.add(node)
    return [(d, at + 1, brute_impact(adj, d, depth, at + 1, visited)) for d in sorted(adj.get(node, []))]


def test_impact_is_depth_first(spark):
    cases = [{"0": ["1", "2"], "1": ["2"], "2": ["3"], "3": ["0", "3"]}, {"0": ["1"], "1": ["0"]}, {}]
    plain = lambda tree: [(x["node_id"], x["depth"], plain(x.get("dependents", []))) for x in tree]
    for adj in cases:
        rows = [(a, b, "calls", "a") for a, bs in adj.items() for b in bs]
        r = spark.createDataFrame(rows, "node_id string, referrer_id string, kind string, path string")
        assert plain(traverse.impact(roots(spark, "0"), r, None, 3)) == brute_impact(adj, "0", 3)
    r = spark.createDataFrame([(a, b, "calls", "a") for a, bs in cases[0].items() for b in bs], "node_id string, referrer_id string, kind string, path string")
    assert {x.node_id for x in traverse.reach(roots(spark, "0"), r, 3).collect()} == {"0", "1", "2", "3"}
    assert traverse.tree_size(traverse.impact(roots(spark, "0"), r, None, 1)) == (2, 1)


def brute_components(pairs):
    v = {x for p in pairs for x in p}
    reach = {x: {b for a, b in pairs if a == x} for x in v}
    for k in v:
        for i in v:
            if k in reach[i]:
                reach[i] |= reach[k]
    return {x: min(y for y in v if y in reach[x] and x in reach[y]) for x in v if x in reach[x]}


def test_components(spark):
    r = random.Random(5)
    cases = [[("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], [("a", "b"), ("b", "c")], [("a", "a"), ("a", "b")], [("a", "b"), ("b", "a"), ("c", "d"), ("d", "c"), ("b", "c")], []]
    cases += [sorted({(r.choice("abcdefghij"), r.choice("abcdefghij")) for _ in range(13)}) for _ in range(2)]
    for pairs in cases:
        for local in (0, cycles.LOCAL_EDGES):
            assert {x.v: x.component for x in cycles.strong_components(steps(spark, pairs), local).collect()} == brute_components(pairs), pairs


def test_import_cycles(spark):
    nodes = [(f"f{x}", "file", f"{x}.py") for x in "abcd"] + [("i1", "import", "a.py", "b"), ("i2", "import", "b.py", "c"), ("i3", "import", "c.py", "a"), ("i4", "import", "d.py", "a"), ("i5", "import", "d.py", "d")]
    n, _ = graph(spark, nodes, [])
    f = spine.file_imports(n)
    assert {(x.src_file, x.dst_file) for x in f.collect()} == {("a.py", "b.py"), ("b.py", "c.py"), ("c.py", "a.py"), ("d.py", "a.py")}
    ring = "a.py b.py c.py".split()
    for local in (0, cycles.LOCAL_EDGES):
        assert [(x["size"], x.files, x.cycle) for x in cycles.import_cycles(f, local).collect()] == [(3, ring, [*ring, "a.py"])]
    pairs = [("a", "d"), ("d", "c"), ("c", "a"), ("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("c", "x")]
    for local in (0, cycles.LOCAL_EDGES):
        got = cycles.import_cycles(spark.createDataFrame(pairs, "src_file string, dst_file string"), local).collect()
        assert [(x["size"], x.cycle) for x in got] == [(4, ["a", "b", "c", "a"]), (2, ["x", "y", "x"])]
    chain = [str(k) for k in range(3000)]
    assert cycles.witness(chain, {a: [b] for a, b in zip(chain, [*chain[1:], chain[0]])})[0] == "0"


def test_cycles_of_large_graphs(spark):
    """Each way gives the same, and a graph as deep as it has vertices takes no round of Spark for each level."""
    r = random.Random(9)
    pairs = sorted({(r.choice("abcdefghij"), r.choice("abcdefghij")) for _ in range(15)})
    for ways in ((0, 0), (0, 100), (100, 0)):
        assert {x.v: x.component for x in cycles.strong_components(steps(spark, pairs), *ways).collect()} == brute_components(pairs), ways
    ring = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "x"), ("x", "y"), ("y", "x")]
    for ways in ((0, 0), (4, 0), (0, 100)):
        got = cycles.import_cycles(spark.createDataFrame(ring, "src_file string, dst_file string"), *ways).collect()
        assert [x.cycle for x in got] == [["a", "b", "c", "a"], ["x", "y", "x"]], ways
    deep = [(f"{k:04}", f"{k + 1:04}") for k in range(2000)] + [(f"{k:04}", f"{k - 3:04}") for k in range(3, 2000, 100)]
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    got = cycles.strong_components(steps(spark, deep), 0).collect()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) - len(before) < 20
    assert len(got) == 80 and len({x.component for x in got}) == 20


def test_exports(spark):
    n, e = graph(spark, [("dog", "class", "a.py", 'D"og</script>'), ("animal", "class", "a.py"), ("speak", "method", "a.py"), ("main", "function", "a.py")], [("dog", "animal", "inherits"), ("main", "dog", "calls"), ("dog", "speak", "contains"), ("main", "gone", "calls")])
    sub = export.subgraph(n, e)
    assert {(x.id, x.degree) for x in export.degrees(*sub).collect()} == {("dog", 3), ("animal", 1), ("speak", 1), ("main", 1)}
    dot = export.to_dot(*sub)
    assert dot.startswith("digraph") and '[label="D\\"og</script>", shape=box' in dot and "n_dog -> n_animal" in dot and "gone" not in dot
    assert '  ndog[["D\'og</script>"]]' in export.to_mermaid(*sub) and "ndog --|> nanimal" in export.to_mermaid(*sub, "classDiagram")
    import json

    assert {x["id"] for x in json.loads(export.to_json(*sub))["nodes"]} == {"dog", "animal", "speak", "main"}
    page = export.to_html(*sub)
    assert "D\\\"og<\\/script>" in page and '"val":3' in page
    assert export.subgraph(n, e, kind="class", limit=1)[0].count() == 1 and export.subgraph(n, e, edge_kinds=["calls"])[1].count() == 1
    text = export.architecture_mermaid(n, e, spine.real_refs(n, e))
    assert "graph TD" in text and "Total nodes: 4" in text and 'subgraph other["Other"]' in text


def test_versions(spark):
    s = lambda rows: spark.createDataFrame(rows, "file_path string, name string, kind string")
    old, new = s([("a", "f", "function"), ("a", "g", "function"), ("b", "x", "class"), ("d", "q", "class")]), s([("a", "f", "function"), ("a", "h", "method"), ("c", "y", "class"), ("d", "q", "class")])
    got = {r.file_path: (r.status, [tuple(x) for x in r.added], [tuple(x) for x in r.removed]) for r in diff.symbol_diff(old, new).collect()}
    assert got == {"a": ("modified", [("h", "method")], [("g", "function")]), "b": ("removed", [], [("x", "class")]), "c": ("added", [("y", "class")], [])}
    n, e = graph(spark, *ANALYSIS)
    assert {r.target_id for r in diff.dangling(n, spark.createDataFrame([("main", "nobody", "calls", "{}", "", 0)], EDGES)).collect()} == {"nobody"}
    gone = spark.createDataFrame([("a.py",)], "file_path string")
    left_n, left_e = diff.delete_files(n, e, gone)
    assert left_n.count() == 5 and left_e.count() == 2
    twice, _ = graph(spark, [("one", "function", "a.py", f"v{k}") for k in range(50)], [])
    assert [r.name for r in last_wins(twice, ["id"]).collect()] == ["v49"]
    assert [r.name for r in diff.upsert(n, twice.withColumn("id", F.lit("main")), ["id"]).where("id = 'main'").collect()] == ["v49"]


def test_plans_have_no_products(spark):
    n, e = graph(spark, *ANALYSIS)
    plan = spine.real_refs(n, e)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_graph_of_tables(spark, tmp_path):
    """Calls and imports are made once, as rows that hold edge and target, so nothing is joined for either; repeated line items and two callers of one key are as in SQL."""
    import duckdb

    from codeloom.plans import queries, relational

    con, d = duckdb.connect(), "/root/testdata/sf0.001"
    for t in relational.TABLES:
        more = {"lineitem": f" union all (select * from '{d}/{t}.parquet' limit 50)", "part": f" union all (select * replace ('odd' as p_name) from '{d}/{t}.parquet' where p_partkey = 3)"}.get(t, "")
        con.execute(f"copy (select * from '{d}/{t}.parquet'{more}) to '{tmp_path}/{t}.parquet'")
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    g = queries.Graph(spark, str(tmp_path))
    for name, got in (("nodes", g.nodes), ("edges", g.edges)):
        columns = [c for c in got.columns if c != "metadata"]
        want = con.sql(f"with {relational.DUCKDB} select {', '.join(columns)} from {name}").fetchall()
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select(columns).collect()), name
    for one in (g.nodes, g.edges, g.links.where("kind in ('calls', 'imports')")):
        plan = one._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("Join") <= 1 and "Aggregate" not in plan
    deps = [analysis.component_deps(g.nodes, g.def_refs, g.sites, ends) for ends in (None, g.ends)]
    rows = [sorted(map(repr, x.collect())) for x in deps]
    assert rows[0] == rows[1] and rows[0]


def test_references_to_few_nodes(spark):
    """What refers to some nodes is found without the references to all others, the same ones."""
    r = random.Random(5)
    files, names = ["a.py", "b.py", "pkg/a.py"], ["f", "g", "h"]
    kinds = [r.choice(["function", "class", "call", "import", "file"]) for _ in range(60)]
    nodes = [(f"n{k}", kind, r.choice(files), f"{r.choice(['a', 'b', 'x'])}.{r.choice(names)}" if kind == "import" else r.choice(names), r.choice([None, 1, 5]), kind == "class" and r.random() < 0.3) for k, kind in enumerate(kinds)]
    edges = sorted({(f"n{r.randrange(60)}", f"n{r.randrange(62)}", r.choice(["calls", "imports", "inherits", "contains"])) for _ in range(150)})
    n, e = graph(spark, nodes, edges)
    every, links, sites = {tuple(x) for x in spine.real_refs(n, e).collect()}, spine.links(n, e), spine.resolved_sites(n)
    assert {x[3] for x in every} == set("abcd")
    for some in ([f"n{k}" for k in range(60)], ["n1"], [f"n{k}" for k in range(0, 60, 7)], ["absent"]):
        near = spark.createDataFrame([(x,) for x in some], "node_id string")
        assert sorted(map(tuple, spine.references_to(near, n, links, sites).collect())) == sorted(x for x in every if x[0] in some)


def test_queries_at_a_root_make_no_references_of_all(spark):
    """Nor resolved edges; a few neighbours are found without a shuffle of edges; metrics by names are those by targets."""
    from codeloom.plans import queries

    g = queries.Graph(spark, "/root/testdata/sf0.001")
    found = {f: getattr(queries, f)(g).count() for f in ("node_by_id", "edges_of_node", "context_depth2", "impact_depth2", "impact_reach", "trace_in")}
    assert all(found.values()) and set(g._made) == {"sites"}
    plan = queries.context_depth2(g)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") and "SortMergeJoin" not in plan
    assert queries.fan_in(g).count() and queries.symbol_metrics(g).count() and set(g._made) == {"sites", "uses"}
    # What is counted by names and modules is what the references of all give.
    for f in (lambda **x: analysis.fan_in(g.nodes, g.refs, **x), lambda **x: analysis.symbol_metrics(g.nodes, g.edges, g.refs, out=g.out, **x)):
        assert sorted(map(tuple, f().collect())) == sorted(map(tuple, f(counts=g.referrers).collect()))
    by_target, by_name = (sorted(map(tuple, analysis.fan_out(g.nodes, g.edges, **x).collect())) for x in ({"out": g.out}, {"used": g.uses}))
    assert by_target == by_name and by_name
    # Targets of calls are counted without telling them apart.
    straight = g.refs.where("kind = 'calls' and path = 'a'").agg(F.count_distinct("node_id")).first()[0]
    assert straight == {(x.kind, x.path): x.targets for x in queries.refs_by_kind(g).collect()}["calls", "a"]


def test_folding(spark):
    """As in Python, for every character, and hardly any text goes there: what does is chosen in the argument, as a condition around the
    function doesn't keep the others from it."""
    every = [chr(k) for k in [*range(1, 0xD800), *range(0xE000, 0x110000)]]
    texts = ["ΟΔΟΣ ΣΑΣ Σ.", "Élan ﬁn", "", "abc É", *("x".join(every[k : k + 300]) + " Z" for k in range(0, len(every), 300)), *(f"x{c}Y" for c in every[:9000])]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", search.folded(F.col("t")).alias("f"))
    assert not [ascii((r.t, r.f)) for r in df.collect() if r.f != search.fold(r.t)]
    assert "f(CASE WHEN" in df._jdf.queryExecution().sparkPlan().toString()
