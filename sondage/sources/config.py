"""Settings of an index in a JSON file."""

from __future__ import annotations

import json
from pathlib import Path

# --- Fixed values: settings of a fresh index -----------------------------------------------
DEFAULTS = {
    "ExcludedPaths": [".git", "node_modules", "anaconda3", "miniconda3"],
    "GPUEnabled": False, "HasGPU": False, "HasCheckedGPU": False,
    "APIEnabled": False, "APIPort": 7700,
}
_PATHS = ("ExcludedPaths", "IncludedDirs")


def distinct_paths(paths: list[str]) -> list[str]:
    """Sorted; of spellings that differ in case only, the first stays."""
    first: dict[str, str] = {}
    for p in paths:
        first.setdefault(p.lower(), p)
    return sorted(first.values())


def save(settings: dict, path: str) -> dict:
    """Writes the settings with their paths in order, and returns them."""
    settings = settings | {k: distinct_paths(settings[k]) for k in _PATHS if settings.get(k)}
    Path(path).write_text(json.dumps(settings, indent=2))
    return settings


def load(path: str, legacy: str | None = None) -> dict:
    """The settings of path over the defaults. Where path is missing, a legacy file, a bare list of excluded paths, is taken over and removed."""
    settings = {k: list(v) if isinstance(v, list) else v for k, v in DEFAULTS.items()}
    if Path(path).exists():
        return settings | json.loads(Path(path).read_text())
    if legacy and Path(legacy).exists():
        settings["ExcludedPaths"] += json.loads(Path(legacy).read_text())
        settings = save(settings, path)
        Path(legacy).unlink()
    return settings
