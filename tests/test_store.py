"""From files to answers: indexing, versions, the facade, the command line, tools and the watch."""

import io
import json
import os
import subprocess
import time

import pytest

from codeloom import cli, tools
from codeloom.api import CodeGraph, clamp
from codeloom.operators import cycles  # noqa: F401
from codeloom.sources import ignore, walk
from codeloom.sources.store import BrokenStore, Locked, NotIndexed, Store, index
from codeloom.streaming import watch

FILES = {
    "main.py": "from utils.helpers import greet\n\ndef main():\n    print(greet('x'))\n",
    "utils/__init__.py": "",
    "utils/helpers.py": 'from main import main\n\ndef greet(name):\n    """Greets somebody."""\n    return add(name, 1)\n\ndef add(a, b):\n    return add(a, b)\n\ndef unused():\n    pass\n',
    "node_modules/x/skip.js": "function skipped() {}",
    "bad.py": "x = " + "-" * 200_000 + "1\n",  # too deep for any parser
    "gen/out.py": "def generated(): pass\n",
    ".gitignore": "gen/\n",
}


def put(root, files):
    for p, t in files.items():
        path = os.path.join(root, p)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(t)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("build")  # a name that is ignored inside repositories, but not above them
    root = str(base / "repo")
    put(root, FILES)
    g = CodeGraph(spark, str(base / "store"))
    return g, root, g.index(root)


def names(df):
    return {(r.name, r.kind) for r in df.collect()}


def test_index(built):
    g, root, done = built
    assert [os.path.relpath(p, root) for p in done["created"]] == ["bad.py", "main.py", "utils/__init__.py", "utils/helpers.py"]
    assert [os.path.relpath(p, root) for p in done["failed"]] == ["bad.py"]
    assert {("main", "function"), ("greet", "function"), ("add", "function"), ("utils.helpers.greet", "import")} <= names(g.nodes)
    assert g.store.table("errors").count() == 1 and g.store.table("dangling").count() == 0


def test_answers(built):
    g, _, _ = built
    assert {r.name for r in g.dead_code().collect()} == {"unused"}
    assert [(r.name, r.references) for r in g.hotspots(min_references=2).collect()] == [("add", 2), ("greet", 2)]
    t = g.trace("greet")
    called = lambda xs: [x["node"]["name"] for x in xs]
    assert called(t["incoming"]) == ["main"] and called(t["outgoing"]) == ["add"]
    again = t["outgoing"][0]["callees"][0]
    assert again["node"]["name"] == "add" and "cycle" not in again and again["callees"][0]["cycle"]
    assert {x["node"]["name"] for x in g.impact("greet")["dependents"]} == {"main", "main.py"}
    assert [n["name"] for n in g.why("main", "add")["path"]] == ["main", "greet", "add"]
    assert g.why("add", "main")["direction"] == "backward" and not g.why("unused", "main")["found"] and "nobody" in g.why("nobody", "main")["reason"]
    assert [r["size"] for r in g.cycles().collect()] == [2]
    assert {r.name for r in g.search("somebody", full_text=True).collect()} == {"greet"}
    m = g.metrics("greet").first()
    assert (m.fan_in, m.fan_out, m["loc"]) == (2, 1, 3)
    assert g.stats()["total_files"] == 3 and clamp(0) == 1 and clamp(9999) == 500
    assert g.trace("nothing") == dict(symbol=None, outgoing=[], incoming=[]) and g.impact("nothing")["symbol"] is None
    assert "digraph" in g.export("dot") and "graph TD" in g.architecture()


def test_versions_follow_the_files(spark, tmp_path):
    root, other = str(tmp_path / "repo"), str(tmp_path / "repo2")
    put(root, {"a.py": "def one(): two()\n", "b.py": "def two(): pass\n"})
    put(other, {"c.py": "def other(): pass\n"})
    s = Store(spark, str(tmp_path / "store"))
    with pytest.raises(NotIndexed):
        CodeGraph(spark, s.folder).stats()
    assert index(s, root, dry_run=True)["created"] and s.version() == 0
    index(s, root)
    index(s, other)
    pinned = CodeGraph(spark, s.folder)
    assert index(s, root)["unchanged"] == [] and s.version() == 2
    put(root, {"b.py": "def three(): pass\n", "d.py": "def one(): pass\n"})
    os.unlink(os.path.join(root, "a.py"))
    done = index(s, root)
    assert ([len(done[k]) for k in ("created", "modified", "removed")]) == [1, 1, 1]
    assert {n for n, k in names(s.nodes) if k == "function"} == {"three", "one", "other"}
    assert {n for n, k in names(pinned.nodes) if k == "function"} == {"one", "two", "other"}
    fresh = Store(spark, str(tmp_path / "fresh"))
    index(fresh, root)
    index(fresh, other)
    key = lambda st: sorted((r.id, r.name, r.kind) for r in st.nodes.collect())
    assert key(fresh) == key(s) and sorted(map(tuple, fresh.table("refs").collect())) == sorted(map(tuple, s.table("refs").collect()))
    assert len(index(s, root, force=True)["modified"]) == 2


def test_broken_and_locked_stores(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    (tmp_path / "CURRENT").write_text("{")
    with pytest.raises(BrokenStore):
        s.version()
    (tmp_path / "CURRENT").write_text('{"version": 1, "format": 99}')
    with pytest.raises(BrokenStore):
        s.version()
    os.unlink(tmp_path / "CURRENT")
    (tmp_path / "LOCK").touch()
    with pytest.raises(Locked):
        s.write(s.nodes, s.edges, s.files)


def test_ignore_rules():
    r = ignore.Rules(["# comment", "*.log", "!keep.log", "/top", "dir/", "a/**/z", "doc/*.txt", "\\!odd", "x?[ab]"])
    yes = ["a.log", "s/b.log", "top", "dir/x", "s/dir/y", "a/z", "a/b/c/z", "doc/a.txt", "!odd", "xya"]
    no = ["keep.log", "s/top", "dir", "doc/s/a.txt", "xyc", "a/zz"]
    assert all(map(r.ignored, yes)) and not any(map(r.ignored, no)) and r.ignored("dir/")
    assert ignore.built_in("build/x.py") and ignore.built_in("a/.hidden.py") and not ignore.built_in("a/b.py")


def test_walk_and_text(spark, tmp_path):
    put(str(tmp_path), {"a.py": "x", "vendor/b.py": "y", ".codeloomignore": "vendor/\n"})
    (tmp_path / "c.go").write_bytes(b"package \xff")
    assert walk.paths(str(tmp_path)) == ["a.py", "c.go"]
    assert {r.content for r in walk.files(spark, str(tmp_path)).collect()} == {"x", "package �"}
    assert walk.files(spark, str(tmp_path / "vendor" / "none")).count() == 0


def test_diff_against_git(spark, tmp_path):
    here = ["git", "-C", str(tmp_path)]
    git = lambda *a: subprocess.run([*here, "-c", "user.name=x", "-c", "user.email=x@y", *a], check=True, capture_output=True)
    git("init", "-q")
    put(str(tmp_path), {"lib.py": "def helper(): pass\ndef old(): pass\n", "gone.py": "def g(): pass\n", "same.py": "def s(): return 1\n", "t.txt": "x"})
    git("add", ".")
    git("commit", "-qm", "base")
    put(str(tmp_path), {"lib.py": "def helper(): pass\ndef new(): pass\n", "same.py": "def s(): return 2\n", "t.txt": "y", "fresh.py": "class C: pass\n"})
    os.unlink(tmp_path / "gone.py")
    git("add", "-A")
    g = CodeGraph(spark, str(tmp_path / "store"))
    got = {r.file_path: (r.status, [x["name"] for x in r.added], [x["name"] for x in r.removed]) for r in g.diff(str(tmp_path), "HEAD").collect()}
    assert got == {"lib.py": ("modified", ["new"], ["old"]), "gone.py": ("removed", [], ["g"]), "fresh.py": ("added", ["C"], [])}
    with pytest.raises(RuntimeError):
        g.diff(str(tmp_path), "no-such-ref")


def test_command_line(built, spark, capsys, tmp_path):
    g, root, _ = built
    run = lambda *a: cli.main(["--store", g.store.folder, *a], spark)
    for args, text in (
        (("search", "greet"), "greet"), (("why", "main", "add"), "main -> greet -> add"), (("trace", "greet"), "callers:"), (("impact", "add"), "dependents"), (("arch",), "python"), (("status",), "total_nodes"), (("dead",), "unused"),
        (("cycles",), "2:"), (("hotspots",), "add"), (("metrics", "greet"), "fan_in"), (("export", "mermaid"), "flowchart"), (("architecture",), "graph TD"), (("init", root, "--dry-run"), "failed"),
    ):
        assert run(*args) == 0 and text in capsys.readouterr().out, args
    assert run("--output-format", "json", "hotspots") == 0 and json.loads(capsys.readouterr().out)[0]["references"] == 2
    assert run("export", "html", "-o", str(tmp_path / "g.html")) == 0 and "graph" in (tmp_path / "g.html").read_text()
    assert run("trace", "nothing") == 1 and run("search", "--full-text", "a AND") == 1
    assert cli.main(["--store", str(tmp_path / "none"), "status"], spark) == 1 and "init" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        cli.main(["trace", "x", "--depth", "11"], spark)
    assert cli.main(["--show-completion"]) == 0 and "hotspots" in capsys.readouterr().out


def test_settings_come_in_order(tmp_path):
    (tmp_path / "c.toml").write_text('store = "file"\noutput_format = "json"\n')
    read = lambda *a, **env: cli.settings(cli.parser().parse_args(["--config", str(tmp_path / "c.toml"), *a, "status"]), env)
    assert read()["store"] == "file" and read(CODELOOM_STORE="env")["store"] == "env" and read("--store", ".codeloom", CODELOOM_STORE="env")["store"] == ".codeloom"


def test_tools(built):
    g, _, _ = built
    lines = [{"jsonrpc": "2.0", "id": 1, "method": "initialize"}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/list"}]
    calls = [("search_symbols", {"query": "greet", "limit": 0}), ("trace_call_path", {"symbol_name": "greet"}), ("analyze_impact", {"symbol_name": "add"}), ("get_architecture", {}), ("get_architecture_mermaid", {}), ("find_dead_code_symbols", {"entrypoints": []}), ("get_hotspots", {}), ("get_symbol_context", {"node_id": g.by_name("add").first().id, "depth": 2}), ("search_symbols", {})]
    lines += [{"jsonrpc": "2.0", "id": 3 + k, "method": "tools/call", "params": {"name": n, "arguments": a}} for k, (n, a) in enumerate(calls)]
    out = io.StringIO()
    tools.serve_stdio(g, io.StringIO("\n".join(map(json.dumps, lines)) + "\n{\n"), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert len(got) == len(lines) and len(got[1]["result"]["tools"]) == 8 and got[-1]["error"]["code"] == -32700
    assert len(json.loads(got[2]["result"]["content"][0]["text"])) == 1 and not any(x["result"]["isError"] for x in got[2:10]) and got[10]["result"]["isError"]
    server = tools.serve_http(g, 0)
    assert server.server_address[0] == tools.LOCAL
    server.server_close()


def test_watch(spark, tmp_path):
    root = str(tmp_path / "repo")
    put(root, {"a.py": "def one(): pass\n"})
    s, seen = Store(spark, str(tmp_path / "store")), []
    with pytest.raises(ValueError):
        watch.watch(s, root, 0.1)
    changes, grown = watch.tick(s, root)
    assert len(changes["created"]) == 1 and grown["total_nodes"] == 2
    assert watch.tick(s, root)[1] == {"total_files": 0, "total_nodes": 0, "total_edges": 0}
    q = watch.watch(s, root, 0.3, lambda c, g: seen.append((c, g)))
    try:
        put(root, {"b.py": "def two(): one()\n"})
        until = time.time() + 60
        while not seen and time.time() < until:
            time.sleep(0.2)
    finally:
        q.stop()
    assert [os.path.basename(p) for p in seen[0][0]["created"]] == ["b.py"] and seen[0][1]["total_files"] == 1
