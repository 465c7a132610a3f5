"""The tools ``inspect`` and ``ask`` over stdio, as JSON-RPC lines of the Model Context Protocol."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import TextIO

TOOLS = [
    {"name": "inspect", "description": "Entities and questions of the notes, or those that match a query.", "inputSchema": {"type": "object", "properties": {"query": {"type": "string"}}}},
    {"name": "ask", "description": "Notes for a question.", "inputSchema": {"type": "object", "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1}, "target": {"type": "string"}}, "required": ["query"]}},
]


def _checked(tool: dict, given: dict) -> dict:
    """The arguments, if they are those of the tool."""
    schema = tool["inputSchema"]
    for name in schema.get("required", []):
        if name not in given:
            raise ValueError(f"{name} is missing")
    for name, value in given.items():
        kind = schema["properties"].get(name)
        if kind is None:
            raise ValueError(f"{name} isn't known")
        if not isinstance(value, {"string": str, "integer": int}[kind["type"]]) or isinstance(value, bool):
            raise ValueError(f"{name} must be of type {kind['type']}")
        if kind["type"] == "integer" and value < kind.get("minimum", value) or kind["type"] == "string" and len(value) < kind.get("minLength", 0):
            raise ValueError(f"{name} is too small")
    return given


def answer(message: dict, tools: dict[str, Callable[..., str]]) -> dict | None:
    """The reply to a message; None where it asks for none."""
    if "id" not in message:
        return None
    reply = {"jsonrpc": "2.0", "id": message["id"]}
    method, params = message.get("method"), message.get("params") or {}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "loamline", "version": "0.1"}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": TOOLS}}
    if method == "tools/call":
        tool = next((t for t in TOOLS if t["name"] == params.get("name")), None)
        if tool is None:
            return reply | {"error": {"code": -32602, "message": "no such tool"}}
        try:
            text, failed = tools[tool["name"]](**_checked(tool, params.get("arguments") or {})), False
        except Exception as e:
            text, failed = str(e), True
        return reply | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}
    return reply | {"error": {"code": -32601, "message": f"no method {method}"}}


def run(tools: dict[str, Callable[..., str]], source: TextIO, sink: TextIO) -> None:
    for line in source:
        if not line.strip():
            continue
        try:
            reply = answer(json.loads(line), tools)
        except json.JSONDecodeError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if reply is not None:
            print(json.dumps(reply), file=sink, flush=True)
