"""Settings of the command line in a TOML file; all are optional, and what the command line or environment says comes first."""

from __future__ import annotations

import os
import tomllib

SETTINGS = {"dot": {"clusters": bool, "legend": bool, "theme": str, "rankdir": str, "splines": str, "rounded": bool}, "svg": {"interactive": bool}, "query": {"default_format": str}}


#: Names of the settings file that is looked for in a root.
NAMES = ("weftgraph.toml", ".weftgraph.toml")


def near(root: str) -> dict:
    """The settings of the first such file in a root folder; empty without one."""
    return next((load(p) for p in (os.path.join(root, n) for n in NAMES) if os.path.exists(p)), {})


def load(path: str | None) -> dict:
    """{section: {setting: value}, "root": text}; a file that can't be read, or isn't such a file, counts as empty."""
    if path is None:
        return {}
    try:
        with open(path, "rb") as f:
            found = tomllib.load(f)
    except (OSError, ValueError):
        return {}
    for section, kinds in SETTINGS.items():
        part = found.get(section, {})
        if not isinstance(part, dict) or any(not isinstance(part[k], kind) for k, kind in kinds.items() if k in part):
            return {}
    return found if isinstance(found.get("root", ""), str) else {}
