"""Project settings in TOML files beside the documents, the nearest first."""

from __future__ import annotations

import tomllib
from pathlib import Path

NAME = ".quire.toml"
SCALARS = ("project_id", "group", "mpn", "manufacturer", "subsystem")


def load(path: Path) -> dict | None:
    """A file's settings; one that can't be read counts as absent."""
    try:
        with path.open("rb") as f:
            return tomllib.load(f)
    except (OSError, tomllib.TOMLDecodeError):
        return None


def find(start: Path, name: str = NAME) -> list[dict]:
    """Settings of a folder and of those above it, nearest first."""
    start = start.resolve()
    return [c for d in (start, *start.parents) if (d / name).is_file() and (c := load(d / name)) is not None]


def merge(configs: list[dict]) -> dict | None:
    """The nearest value of each setting; tags of all, nearest first and once each."""
    if not configs:
        return None
    out = {k: next((c[k] for c in configs if c.get(k)), None) for k in SCALARS}
    return out | {"tags": list(dict.fromkeys(t for c in configs for t in c.get("tags") or [])) or None}


def project(explicit: str | None, everywhere: bool, start: Path, default: str | None = None) -> str | None:
    """The project to search: the one named, none if everywhere is asked for, the folder's, the default."""
    if explicit:
        return explicit
    if everywhere:
        return None
    return (merge(find(start)) or {}).get("project_id") or default or None
