"""The queries as tools for assistants: a registry, and a server that speaks JSON-RPC over lines of standard input or over HTTP."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, HTTPServer
from typing import IO

from codeloom.api import FIELDS, CodeGraph, clamp
from codeloom.schema import Maybe

LOCAL = "127.0.0.1"


def _rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def registry(g: CodeGraph) -> dict[str, tuple[Callable[..., object], str]]:
    """name -> (function, what it does). Results are plain values; limits lie between 1 and 500."""

    def search_symbols(query: str, limit: int = 50, kind: Maybe = None, full_text: bool = False, language: Maybe = None):
        return _rows(g.search(query, kind, language, clamp(limit), full_text).select(*FIELDS))

    def get_symbol_context(node_id: str, depth: int = 1):
        return {k: _rows(v) for k, v in g.context(node_id, depth).items()}

    def trace_call_path(symbol_name: str, max_depth: int = 5, direction: str = "both"):
        return g.trace(symbol_name, max_depth, direction)

    def analyze_impact(symbol_name: str, max_depth: int = 3):
        return g.impact(symbol_name, max_depth)

    def get_architecture():
        return g.stats()

    def get_architecture_mermaid():
        return g.architecture()

    def find_dead_code_symbols(entrypoints: list[str] | None = None, limit: int = 100):
        return _rows(g.dead_code(entrypoints or None, clamp(limit)))

    def get_hotspots(limit: int = 20, min_references: int = 2):
        return _rows(g.hotspots(clamp(limit), min_references))

    return {
        "search_symbols": (search_symbols, "Symbols by part of their name, or by full text"),
        "get_symbol_context": (get_symbol_context, "A symbol, its edges and its file"),
        "trace_call_path": (trace_call_path, "Callers and callees of a symbol"),
        "analyze_impact": (analyze_impact, "What depends on a symbol"),
        "get_architecture": (get_architecture, "Totals of the graph"),
        "get_architecture_mermaid": (get_architecture_mermaid, "A diagram of layers and components"),
        "find_dead_code_symbols": (find_dead_code_symbols, "Definitions that nothing refers to"),
        "get_hotspots": (get_hotspots, "Definitions with the most referrers"),
    }


def _schema(f: Callable) -> dict:
    import inspect

    kinds = {"int": "integer", "bool": "boolean", "list": "array"}
    ps = inspect.signature(f).parameters
    props = {n: {"type": next((v for k, v in kinds.items() if str(p.annotation).startswith(k)), "string")} for n, p in ps.items()}
    return {"type": "object", "properties": props, "required": [n for n, p in ps.items() if p.default is p.empty]}


def handle(tools: dict, request: dict) -> dict | None:
    """The answer to one request; None to a notice."""
    method, params, number = request.get("method"), request.get("params") or {}, request.get("id")
    if number is None:
        return None
    answer: dict = {"jsonrpc": "2.0", "id": number}
    try:
        if method == "initialize":
            answer["result"] = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "codeloom", "version": "1"}}
        elif method == "ping":
            answer["result"] = {}
        elif method == "tools/list":
            answer["result"] = {"tools": [{"name": n, "description": d, "inputSchema": _schema(f)} for n, (f, d) in tools.items()]}
        elif method == "tools/call" and params.get("name") in tools:
            value = tools[params["name"]][0](**(params.get("arguments") or {}))
            answer["result"] = {"content": [{"type": "text", "text": value if isinstance(value, str) else json.dumps(value, default=str)}], "isError": False}
        else:
            answer["error"] = {"code": -32601, "message": f"There is no {params.get('name') or method}"}
    except Exception as e:  # noqa: BLE001 - a failing tool is an answer too
        answer["result"] = {"content": [{"type": "text", "text": f"{type(e).__name__}: {e}"}], "isError": True}
    return answer


def serve_stdio(g: CodeGraph, source: IO[str] = sys.stdin, sink: IO[str] = sys.stdout) -> None:
    tools = registry(g)
    for line in source:
        if not line.strip():
            continue
        try:
            answer = handle(tools, json.loads(line))
        except ValueError as e:
            answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
        if answer is not None:
            print(json.dumps(answer), file=sink, flush=True)


def serve_http(g: CodeGraph, port: int = 8765) -> HTTPServer:
    """A server on this machine, not yet running; each POST is a request, and its answer one server-sent event if that is asked for."""
    tools = registry(g)

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:
            try:
                answer = handle(tools, json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0)))))
            except ValueError as e:
                answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
            events = "text/event-stream" in self.headers.get("Accept", "")
            text = "" if answer is None else json.dumps(answer)
            body = (f"event: message\ndata: {text}\n\n" if events and text else text).encode()
            self.send_response(200 if text else 202)
            self.send_header("Content-Type", "text/event-stream" if events else "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_: object) -> None:
            pass

    return HTTPServer((LOCAL, port), Handler)
