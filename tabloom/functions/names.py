"""Column naming rules."""

from __future__ import annotations

import re

_BAD = re.compile(r"[^a-zA-Z0-9_]")


def safe_name(name: str) -> str:
    """Every character outside letters, digits and underscore becomes ``_``."""
    return _BAD.sub("_", name)


def stripped_name(name: str) -> str:
    """Every character outside letters, digits and underscore is removed."""
    return _BAD.sub("", name)


def feature_name(name: str, position: int) -> str:
    """``_<safe name>_<position>``; the position keeps it unique."""
    return f"_{safe_name(name)}_{position}"


def category_name(column: str, value: object) -> str:
    return safe_name(f"{column}_{'nan' if value is None else value}")


def unique_names(names: list[str]) -> list[str]:
    """Number the second and later uses of a name, skipping taken ones."""
    seen: set[str] = set()
    out = []
    for name in names:
        pick, i = name, 1
        while pick in seen:
            pick, i = f"{name}_{i}", i + 1
        seen.add(pick)
        out.append(pick)
    return out
