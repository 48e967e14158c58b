"""Composition of commented JSON configurations: the first definition of a key wins."""

from __future__ import annotations

import json
import re
from pathlib import Path

_COMMENT = re.compile(r'("(?:\\.|[^"\\])*")|//[^\n]*|#[^\n]*|/\*.*?\*/', re.S)


def parse(text: str) -> dict:
    return json.loads(_COMMENT.sub(lambda m: m.group(1) or "", text))


def compose(paths: list[str | Path], _open: tuple = ()) -> dict:
    """Merge files from high to low priority, each followed by those its `add_configs` names, relative to it. A file that includes itself is an error."""
    out: dict = {}
    for p in map(Path, paths):
        if p.resolve() in _open:
            raise ValueError(f"{p} includes itself")
        own = parse(p.read_text())
        below = own.pop("add_configs", [])
        _merge(out, own)
        _merge(out, compose([p.parent / x for x in below], (*_open, p.resolve())))
    return out


def _merge(into: dict, more: dict) -> None:
    for k, v in more.items():
        if k not in into:
            into[k] = v
        elif isinstance(into[k], dict) and isinstance(v, dict):
            _merge(into[k], v)
