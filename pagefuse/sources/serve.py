"""A stdio front end for tool callers: one JSON-RPC message a line, two tools over functions of DataFrames."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

PROTOCOL = "2024-11-05"
PARSE_ERROR, UNKNOWN_METHOD = -32700, -32601


@dataclass(frozen=True)
class Tool:
    """What a tool says of itself, its arguments as (name, type, required), and what it does: text, or an exception."""

    about: str
    arguments: tuple[tuple[str, str, bool], ...]
    run: Callable[..., str]

    def listed(self, name: str) -> dict:
        """The tool as a listing has it."""
        schema = {"type": "object", "properties": {n: {"type": t} for n, t, _ in self.arguments}, "required": [n for n, _, must in self.arguments if must]}
        return {"name": name, "description": self.about, "inputSchema": schema}


def standard_tools(search: Callable[..., str], fetch: Callable[..., str]) -> dict[str, Tool]:
    """The two tools of the engine: ``search(query, category, limit)`` and ``fetch(url)`` return Markdown."""
    return {
        "search": Tool("Ranked results of many engines for a query, which may hold shortcuts", (("query", "string", True), ("category", "string", False), ("limit", "integer", False)), search),
        "fetch": Tool("One page as clean Markdown", (("url", "string", True),), fetch),
    }


def called(tools: dict[str, Tool], name: object, arguments: dict) -> dict:
    """The result of a call; errors of a tool are a result too, marked as one."""
    tool = tools.get(str(name))
    if tool is None:
        text, bad = f"unknown tool: {name}", True
    else:
        lost = [n for n, _, must in tool.arguments if must and arguments.get(n) is None]
        known = {n: arguments[n] for n, _, _ in tool.arguments if arguments.get(n) is not None}
        try:
            text, bad = (f"missing required argument: {lost[0]}", True) if lost else (tool.run(**known), False)
        except Exception as e:  # noqa: BLE001  a caller gets every failure as text
            text, bad = f"{name} failed: {e}", True
    return {"content": [{"type": "text", "text": text}], "isError": bad}


def answer(line: str, tools: dict[str, Tool], name: str = "pagefuse", version: str = "0") -> dict | None:
    """The response to one message, or none for a notification or a blank line."""
    if not line.strip():
        return None
    try:
        m = json.loads(line)
    except ValueError:
        m = None
    if not isinstance(m, dict):
        return {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": "parse error"}}
    method, params = m.get("method"), m.get("params") or {}
    if m.get("id") is None:
        return None
    out: dict = {"jsonrpc": "2.0", "id": m["id"]}
    if method == "initialize":
        return out | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": name, "version": version}}}
    if method == "ping":
        return out | {"result": {}}
    if method == "tools/list":
        return out | {"result": {"tools": [t.listed(n) for n, t in tools.items()]}}
    if method == "tools/call":
        return out | {"result": called(tools, params.get("name"), params.get("arguments") or {})}
    return out | {"error": {"code": UNKNOWN_METHOD, "message": f"unknown method: {method}"}}


def serve(lines: Iterable[str], tools: dict[str, Tool]) -> Iterator[str]:
    """Response lines for message lines."""
    for line in lines:
        a = answer(line, tools)
        if a is not None:
            yield json.dumps(a, ensure_ascii=False) + "\n"
