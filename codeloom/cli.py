"""codeloom on the command line."""

from __future__ import annotations

import argparse
import json
import os
import sys
import tomllib

from codeloom.api import FIELDS, CodeGraph
from codeloom.operators.search import FullTextSyntaxError
from codeloom.operators.traverse import tree_size
from codeloom.sources.store import BrokenStore, Locked, NotIndexed

DEFAULTS = {"output_format": "table", "store": ".codeloom", "color": "auto"}
COMMANDS = "init watch search why trace impact arch architecture mcp status dead cycles hotspots metrics diff export".split()


def settings(args: argparse.Namespace, env: dict[str, str] | None = None) -> dict[str, str]:
    """Command line before environment (CODELOOM_...) before the file of --config before defaults. What was given counts as given, even if
    it equals a default."""
    env = dict(os.environ) if env is None else env
    out = dict(DEFAULTS)
    if args.config:
        with open(args.config, "rb") as f:
            out |= {k: str(v) for k, v in tomllib.load(f).items() if k in DEFAULTS}
    out |= {k: env[f"CODELOOM_{k.upper()}"] for k in DEFAULTS if f"CODELOOM_{k.upper()}" in env}
    return out | {k: getattr(args, k) for k in DEFAULTS if getattr(args, k, None) is not None}


def depth_between(low: int, high: int):
    def read(text: str) -> int:
        n = int(text)
        if not low <= n <= high:
            raise argparse.ArgumentTypeError(f"{n} isn't between {low} and {high}")
        return n

    return read


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codeloom", description="A code knowledge graph on Spark")
    p.add_argument("--output-format", choices=["table", "json"])
    p.add_argument("--store", help="folder of the graph (.codeloom)")
    p.add_argument("--config", help="TOML file with settings")
    p.add_argument("--color", choices=["auto", "always", "never"])
    p.add_argument("--no-color", dest="color", action="store_const", const="never")
    p.add_argument("--quiet", action="store_true")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--install-completion", action="store_true", help="write completion for bash to ~/.bash_completion")
    p.add_argument("--show-completion", action="store_true", help="print completion for bash")
    sub = p.add_subparsers(dest="command")

    def command(name: str, text: str) -> argparse.ArgumentParser:
        return sub.add_parser(name, help=text)

    c = command("init", "index a repository")
    c.add_argument("path", nargs="?", default=".")
    c.add_argument("--repo", help="takes the place of the path")
    c.add_argument("--rebuild", action="store_true", help="start from nothing")
    c.add_argument("--force", action="store_true", help="parse unchanged files too")
    c.add_argument("--dry-run", action="store_true")
    c = command("watch", "keep the graph up to date")
    c.add_argument("path", nargs="?", default=".")
    c.add_argument("--interval", type=float, default=2.0)
    c = command("search", "find symbols")
    c.add_argument("query")
    c.add_argument("--kind")
    c.add_argument("--language")
    c.add_argument("--limit", type=int, default=20)
    c.add_argument("--full-text", action="store_true")
    c = command("why", "how one symbol depends on another")
    c.add_argument("a")
    c.add_argument("b")
    c.add_argument("--max-depth", type=depth_between(1, 50), default=10)
    c = command("trace", "callers and callees")
    c.add_argument("symbol")
    c.add_argument("--direction", choices=["both", "incoming", "outgoing"], default="both")
    c.add_argument("--depth", type=depth_between(1, 10), default=3)
    c = command("impact", "what depends on a symbol")
    c.add_argument("symbol")
    c.add_argument("--depth", type=depth_between(1, 10), default=3)
    command("arch", "totals and languages")
    command("architecture", "a diagram of components").add_argument("-o", "--output")
    c = command("mcp", "serve the queries as tools")
    c.add_argument("--port", type=int, default=8765)
    c.add_argument("--transport", choices=["sse", "stdio"], default="sse")
    command("status", "what is indexed")
    c = command("dead", "definitions that nothing refers to")
    c.add_argument("--entrypoint", action="append", help="names that count as used, in place of the usual ones")
    c.add_argument("--limit", type=int, default=100)
    command("cycles", "files that import each other")
    c = command("hotspots", "definitions with the most referrers")
    c.add_argument("--limit", type=int, default=20)
    c.add_argument("--min-refs", type=int, default=2)
    command("metrics", "fan-in, fan-out and lines of a symbol").add_argument("symbol")
    c = command("diff", "symbols changed since a git ref")
    c.add_argument("ref")
    c.add_argument("--repo", default=".")
    c = command("export", "the graph in another form")
    c.add_argument("format", choices="html json mermaid dot".split())
    c.add_argument("--kind")
    c.add_argument("--language")
    c.add_argument("--limit", type=int)
    c.add_argument("--edge-kind", action="append")
    c.add_argument("--diagram-type", choices=["flowchart", "classDiagram"], default="flowchart")
    c.add_argument("-o", "--output")
    return p


def completion() -> str:
    return f'complete -W "{" ".join(COMMANDS)}" codeloom'


def tree_lines(entries: list[dict], keys: tuple[str, ...], indent: int = 1) -> list[str]:
    out = []
    for e in entries:
        n = e["node"] or {}
        out.append("  " * indent + f"{n.get('name')} ({n.get('kind')}) {n.get('file_path')}:{n.get('line_start')}" + (f" [{e['relation']}]" if "relation" in e else "") + (" [cycle]" if e.get("cycle") else ""))
        for k in keys:
            out += tree_lines(e.get(k, []), keys, indent + 1)
    return out


def table_lines(rows: list[dict]) -> list[str]:
    if not rows:
        return ["(nothing)"]
    heads = list(rows[0])
    cells = [[str(r[h]) if r[h] is not None else "-" for h in heads] for r in rows]
    widths = [max(len(h), *(len(c[i]) for c in cells)) for i, h in enumerate(heads)]
    line = lambda c: "  ".join(x.ljust(w) for x, w in zip(c, widths)).rstrip()
    return [line(heads), *map(line, cells)]


def _show(value: object, as_json: bool, lines: list[str] | None = None) -> None:
    print(json.dumps(value, indent=2, default=str) if as_json else "\n".join(lines if lines is not None else table_lines(value)))


def _write(text: str, output: str | None) -> None:
    if output:
        with open(output, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text)


def run(args: argparse.Namespace, spark=None) -> int:
    conf = settings(args)
    as_json = conf["output_format"] == "json"
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("codeloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        spark.sparkContext.setLogLevel("INFO" if args.verbose else "ERROR")
    g = CodeGraph(spark, conf["store"])
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    c = args.command
    if c == "init":
        if args.rebuild and not args.dry_run:
            g.store.clear()
        done = g.index(args.repo or args.path, args.force, args.dry_run)
        if not args.quiet:
            _show(done, as_json, [f"{k}: {len(v)}" for k, v in done.items()])
    elif c == "watch":
        from codeloom.streaming.watch import watch

        q = watch(g.store, args.path, args.interval, lambda changes, grown: _show({"changes": changes, "growth": grown}, as_json, [f"{k}: {len(v)}" for k, v in changes.items()] + [f"{k}: {v:+d}" for k, v in grown.items()]))
        try:
            q.awaitTermination()
        except KeyboardInterrupt:
            q.stop()
    elif c == "search":
        _show(rows(g.search(args.query, args.kind, args.language, args.limit, args.full_text).select(*(FIELDS if as_json else FIELDS[1:6]))), as_json)
    elif c == "why":
        x = g.why(args.a, args.b, args.max_depth)
        _show(x, as_json, [f"{x['direction']}: " + " -> ".join(n["name"] for n in x["path"])] if x["found"] else [x["reason"]])
        return 0 if x["found"] else 1
    elif c == "trace":
        x = g.trace(args.symbol, args.depth, args.direction)
        if x["symbol"] is None:
            _show(x, as_json, [f"There is no symbol {args.symbol}"])
            return 1
        _show(x, as_json, [x["symbol"]["name"], "callers:", *tree_lines(x["incoming"], ("callers",)), "callees:", *tree_lines(x["outgoing"], ("callees",))])
    elif c == "impact":
        x = g.impact(args.symbol, args.depth)
        if x["symbol"] is None:
            _show(x, as_json, [f"There is no symbol {args.symbol}"])
            return 1
        n, deep = tree_size(x["dependents"])
        _show(x, as_json, [x["symbol"]["name"], *tree_lines(x["dependents"], ("dependents",)), f"{n} dependents, depth {deep}"])
    elif c in ("arch", "status"):
        s = g.stats()
        lines = [f"{k}: {v}" for k, v in s.items() if not isinstance(v, dict)]
        _show(s, as_json, lines + (table_lines(rows(g.languages())) if c == "arch" else [f"version: {g.version}"]))
    elif c == "architecture":
        text = g.architecture()
        if as_json and not args.output:
            _show(g.stats() | {"mermaid": text}, True)
        else:
            _write(text, args.output)
    elif c == "mcp":
        from codeloom import tools

        if args.transport == "stdio":
            tools.serve_stdio(g)
        else:
            tools.serve_http(g, args.port).serve_forever()
    elif c == "dead":
        _show(rows(g.dead_code(args.entrypoint, args.limit)), as_json)
    elif c == "cycles":
        found = rows(g.cycles())
        _show(found, as_json, [f"{x['size']}: " + " -> ".join(x["cycle"]) for x in found] or ["(nothing)"])
    elif c == "hotspots":
        _show(rows(g.hotspots(args.limit, args.min_refs)), as_json)
    elif c == "metrics":
        found = rows(g.metrics(args.symbol))
        _show(found, as_json)
        return 0 if found else 1
    elif c == "diff":
        found = rows(g.diff(args.repo, args.ref))
        _show(found, as_json, [f"{x['file_path']} ({x['status']})" + "".join(f"\n  {sign} {s['kind']} {s['name']}" for sign, key in (("+", "added"), ("-", "removed")) for s in x[key]) for x in found] or ["(nothing)"])
    elif c == "export":
        _write(g.export(args.format, args.kind, args.language, args.limit, args.edge_kind, args.diagram_type), args.output)
    return 0


def main(argv: list[str] | None = None, spark=None) -> int:
    p = parser()
    args = p.parse_args(argv)
    if args.show_completion or args.install_completion:
        if args.install_completion:
            with open(os.path.expanduser("~/.bash_completion"), "a", encoding="utf-8") as f:
                f.write(completion() + "\n")
        print(completion())
        return 0
    if not args.command:
        p.print_help()
        return 2
    try:
        return run(args, spark)
    except (NotIndexed, BrokenStore, Locked, FullTextSyntaxError, RuntimeError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
