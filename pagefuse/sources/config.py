"""Configuration: defaults, overlays in TOML, the environment, dotted access."""

from __future__ import annotations

import copy
import json
import os
import re
import tomllib
from typing import Any

DEFAULTS: dict[str, Any] = {
    "general": {"limit": 10, "locale": "en-US", "safe_search": 1, "default_category": "general", "output_format": "markdown"},
    "http": {"max_bytes": 5 * 1024 * 1024, "connect_ms": 2000, "total_ms": 8000, "redirects": True, "max_redirects": 5},
    "sanitizer": {"images": False, "links": "inline", "max_characters": 50_000, "escape_fences": True, "delimit": True},
    "reader": {"detect_spa": True, "rpm": 20, "headless": True, "headless_ms": 6000},
    "cache": {"enabled": True, "ttl_s": 7200, "stale_multiplier": 2},
    "engines": {"weights": {}, "overrides": {}},
}


def overlay(base: dict, top: dict) -> dict:
    """``base`` with the values of ``top``; tables are merged, all else replaced."""
    out = copy.deepcopy(base)
    for k, v in top.items():
        out[k] = overlay(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def load(*texts: str, env: dict[str, str] | None = None, prefix: str = "PAGEFUSE_") -> dict:
    """Defaults, then TOML texts in order, then variables such as ``PAGEFUSE_CACHE__TTL_S``; unknown sections are errors."""
    out = DEFAULTS
    for t in texts:
        got = tomllib.loads(t)
        if unknown := set(got) - set(DEFAULTS):
            raise ValueError(f"unknown sections: {sorted(unknown)}")
        out = overlay(out, got)
    for name, value in sorted((os.environ if env is None else env).items()):
        if name.startswith(prefix) and "__" in name:
            path = name[len(prefix) :].lower().split("__")
            old = get(out, ".".join(path))
            typed: Any = value.lower() in ("1", "true", "yes") if isinstance(old, bool) else int(value) if isinstance(old, int) else value
            for key in reversed(path):
                typed = {key: typed}
            out = overlay(out, typed)
    return out


def get(config: dict, dotted: str) -> Any:
    """A value by its dotted name; None if there is none."""
    at: Any = config
    for k in dotted.split("."):
        if not isinstance(at, dict) or k not in at:
            return None
        at = at[k]
    return at


def as_toml(table: dict, path: tuple[str, ...] = ()) -> str:
    """TOML text of nested tables of texts, numbers, booleans and lists of them."""
    name = lambda k: k if re.fullmatch(r"[A-Za-z0-9_-]+", k) else json.dumps(k, ensure_ascii=False)
    plain = [f"{name(k)} = {json.dumps(v, ensure_ascii=False)}" for k, v in table.items() if not isinstance(v, dict)]
    out = (["[" + ".".join(map(name, path)) + "]"] if path and (plain or not table) else []) + plain
    text = "\n".join(out) + "\n" if out else ""
    for k, v in table.items():
        if isinstance(v, dict):
            text += as_toml(v, (*path, k))
    return text


def with_engine(text: str, engine: str, enabled: bool) -> str:
    """A configuration text after an engine was switched on or off in it; all else that it sets stays."""
    return as_toml(overlay(tomllib.loads(text), {"engines": {"overrides": {engine: {"enabled": enabled}}}}))


def switches(config: dict) -> dict[str, bool]:
    """Engines that a configuration switches, for ``registry.switched``."""
    found = (get(config, "engines.overrides") or {}).items()
    return {name: bool(o["enabled"]) for name, o in found if isinstance(o, dict) and "enabled" in o}
