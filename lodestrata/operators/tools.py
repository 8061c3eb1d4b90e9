"""Tool registry and parameter checks, outside the data path."""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

FILTERS = ("title", "author", "created_date", "source_type", "language")
_ID = re.compile(r"[A-Za-z0-9_-]{1,100}")
_KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}


def checked_filter(given: dict[str, Any] | None) -> dict[str, Any] | None:
    """Known, non-null clauses; None if there are none. Dates must be ISO dates."""
    clauses = {k: v for k, v in (given or {}).items() if v is not None}
    if unknown := set(clauses) - set(FILTERS):
        raise ValueError(f"unknown filter {sorted(unknown)}")
    if "created_date" in clauses:
        datetime.date.fromisoformat(clauses["created_date"])
    return clauses or None


def checked_parameters(given: dict[str, Any]) -> dict[str, Any]:
    """query of 1 to 10,000 characters, ids of letters, digits, _ and -, max_chunks 1 to 50; nothing else."""
    known = {"query", "session_id", "user_id", "max_chunks"}
    if unknown := set(given) - known:
        raise ValueError(f"unknown parameter {sorted(unknown)}")
    query = given.get("query")
    if not isinstance(query, str) or not 1 <= len(query.strip()) <= 10_000:
        raise ValueError("query: 1 to 10000 characters")
    for name in ("session_id", "user_id"):
        if given.get(name) is not None and not _ID.fullmatch(str(given[name])):
            raise ValueError(f"{name}: letters, digits, _ and -")
    n = given.get("max_chunks")
    if n is not None and (isinstance(n, bool) or not isinstance(n, int) or not 1 <= n <= 50):
        raise ValueError("max_chunks: 1 to 50")
    return given


@dataclass
class Registry:
    """Named handlers with JSON-schema parameters."""

    tools: dict[str, tuple[dict, Callable[..., Any]]] = field(default_factory=dict)

    def add(self, name: str, schema: dict, handler: Callable[..., Any]) -> None:
        if name in self.tools:
            raise ValueError(f"tool {name} exists")
        self.tools[name] = (schema, handler)

    def problems(self, name: str, arguments: dict[str, Any]) -> list[str]:
        if name not in self.tools:
            return [f"unknown tool {name}"]
        schema = self.tools[name][0]
        known = schema.get("properties", {})
        out = [f"{k} is missing" for k in schema.get("required", []) if k not in arguments]
        for k, v in arguments.items():
            kind = known.get(k, {}).get("type")
            if k not in known:
                out.append(f"{k} is unknown")
            elif kind and (not isinstance(v, _KINDS[kind]) or kind in ("integer", "number") and isinstance(v, bool)):
                out.append(f"{k} is not {kind}")
        return out

    def dispatch(self, name: str, arguments: dict[str, Any]) -> dict[str, Any]:
        """{success, result} or {success, error}; a handler's exception is an error."""
        if found := self.problems(name, arguments):
            return {"success": False, "error": "; ".join(found)}
        try:
            return {"success": True, "result": self.tools[name][1](**arguments)}
        except Exception as e:
            return {"success": False, "error": f"{type(e).__name__}: {e}"}
