"""The tool functions as one table of named operations with checked parameters, over HTTP and over standard input and output."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from . import tools


def _whole(v):
    if isinstance(v, bool) or int(v) != float(v):
        raise ValueError("must be a whole number")
    return int(v)


def _number(v):
    if isinstance(v, bool) or float(v) != float(v):
        raise ValueError("must be a number")
    return float(v)


def _text(v):
    if not isinstance(v, str):
        raise ValueError("must be text")
    return v


def _object(v):
    if not isinstance(v, dict):
        raise ValueError("must be an object")
    return v


def _many(kind):
    def read(v):
        if not isinstance(v, list):
            raise ValueError("must be a list")
        return [kind(x) for x in v]

    return read


def _target(v):
    return {_text(k): _number(x) for k, x in v.items()} if isinstance(v, dict) else _number(v)


#: Kinds of parameters: how a JSON value is read, and its JSON schema.
KINDS = {
    "whole": (_whole, {"type": "integer"}), "number": (_number, {"type": "number"}), "text": (_text, {"type": "string"}), "object": (_object, {"type": "object"}),
    "wholes": (_many(_whole), {"type": "array", "items": {"type": "integer"}}), "texts": (_many(_text), {"type": "array", "items": {"type": "string"}}),
    "records": (_many(_object), {"type": "array", "items": {"type": "object"}}), "target": (_target, {"type": ["number", "object"]}),
}
SOURCE = {"csv_path": "text", "records": "records", "mapping": "text", "freq": "text", "agg": "text"}


@dataclass(frozen=True)
class Operation:
    """said: what it does. takes: its parameters' kinds. needs: those that must be given. run: of a session and the parameters."""

    said: str
    takes: dict[str, str]
    run: Callable
    needs: tuple[str, ...] = ()

    def call(self, spark: SparkSession, given: dict, local: bool):
        """The result for JSON parameters; a remote caller may not name files of this machine."""
        takes = {k: v for k, v in self.takes.items() if local or k != "csv_path"}
        if unknown := sorted(set(given) - set(takes)):
            raise ValueError(f"unknown parameter(s) {unknown}; there are {sorted(takes)}")
        if missing := [k for k in self.needs if given.get(k) is None]:
            raise ValueError(f"missing parameter(s) {missing}")
        read = {}
        for name, value in given.items():
            if value is not None:
                try:
                    read[name] = KINDS[takes[name]][0](value)
                except (TypeError, ValueError, OverflowError) as e:
                    raise ValueError(f"{name}: {e}") from e
        return self.run(spark, **read)

    def schema(self) -> dict:
        return {"type": "object", "properties": {k: KINDS[v][1] for k, v in self.takes.items()}, "required": list(self.needs), "additionalProperties": False}


def _forecast(spark, model: str = "auto_select", model_params: dict | None = None, **more):
    return {"forecast": tools.forecast_one(spark, model, model_params or {}, **more)}


def _compare(spark, level=None, models=("naive", "theta", "auto_ets"), metrics=("mase",), **more):
    return tools.compare_tool(spark, models=tuple(models), metrics=tuple(metrics), level=level, **more)


OPERATIONS = {
    "list_models": Operation("The models that the other tools can run, with family "
        "and description.", {}, lambda spark: tools.list_models_tool(spark)),
    "list_mappings": Operation("The recipes that shape platforms' exports into panels.", {}, lambda spark: tools.list_mappings_tool(spark)),
    "preview_panel": Operation("What a file or records become as a panel: rows, series, range "
        "and first rows.", SOURCE, lambda spark, **more: tools.preview_panel(spark, **more)),
    "forecast": Operation(
        "Forecasts of every series, with bounds of each level.",
        {**SOURCE, "model": "text", "model_params": "object", "h": "whole", "level": "wholes"}, _forecast,
    ),
    "compare": Operation(
        "Walk-forward scores of several models, best first, and the models that failed.",
        {**SOURCE, "models": "texts", "h": "whole", "n_windows": "whole", "metrics": "texts", "level": "wholes", "seasonality": "whole"}, _compare,
    ),
    "quota": Operation(
        "The probability that each series' forecast reaches its quota: one number, or one for each series named.",
        {**SOURCE, "model": "text", "h": "whole", "quota": "target", "level": "whole"}, lambda spark, **more: tools.quota_tool(spark, **more), ("quota",),
    ),
}

#: The HTTP routes.
GET = {"/models": "list_models", "/mappings": "list_mappings"}
POST = {"/preview": "preview_panel", "/forecast": "forecast", "/compare": "compare", "/quota": "quota"}
VERSION = "2"
MOST_BYTES = 64 << 20


def answer(spark: SparkSession, method: str, path: str, body: bytes) -> tuple[int, object]:
    """(status, JSON value) of a request: 400 with the reason for what the caller got wrong."""
    if (method, path) == ("GET", "/health"):
        return 200, {"status": "ok", "version": VERSION}
    name = {"GET": GET, "POST": POST}.get(method, {}).get(path)
    if name is None:
        return 404, {"error": f"no {method} {path}"}
    try:
        given = json.loads(body or b"{}")
        if not isinstance(given, dict):
            raise ValueError("the body must be an object")
        return 200, OPERATIONS[name].call(spark, given, local=False)
    except ValueError as e:  # broken JSON is one too
        return 400, {"error": str(e)}


def http_server(spark: SparkSession, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _reply(self):
            size = int(self.headers.get("Content-Length") or 0)
            status, value = answer(spark, self.command, self.path.partition("?")[0], self.rfile.read(size)) if size <= MOST_BYTES else (413, {"error": "the body is too large"})
            raw = json.dumps(value, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = _reply

        def log_message(self, *a):
            pass

    return ThreadingHTTPServer((host, port), Handler)


def reply(spark: SparkSession, message: dict) -> dict | None:
    """The answer to a JSON-RPC message of a model context client; None to a notification."""
    if "id" not in message:
        return None
    method, given = message.get("method"), message.get("params") or {}
    out = {"jsonrpc": "2.0", "id": message["id"]}
    if method == "initialize":
        return out | {"result": {"protocolVersion": given.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "tidemark", "version": VERSION}}}
    if method == "ping":
        return out | {"result": {}}
    if method == "tools/list":
        return out | {"result": {"tools": [{"name": k, "description": o.said, "inputSchema": o.schema()} for k, o in OPERATIONS.items()]}}
    if method != "tools/call" or given.get("name") not in OPERATIONS:
        return out | {"error": {"code": -32601 if method != "tools/call" else -32602, "message": f"no {method} {given.get('name', '')}".strip()}}
    try:
        value, failed = OPERATIONS[given["name"]].call(spark, given.get("arguments") or {}, local=True), False
    except ValueError as e:
        value, failed = str(e), True
    return out | {"result": {"content": [{"type": "text", "text": value if failed else json.dumps(value, default=str)}], "isError": failed}}


def serve_lines(spark: SparkSession, lines=None, out=None) -> None:
    """Answers JSON-RPC messages, one a line, until the input ends."""
    out = out or sys.stdout
    for line in lines or sys.stdin:
        if not line.strip():
            continue
        try:
            answered = reply(spark, json.loads(line))
        except ValueError:
            answered = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}
        if answered is not None:
            print(json.dumps(answered), file=out, flush=True)
