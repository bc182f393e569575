"""Lists and patterns that come with the package, and their loaders; a path takes the place of the one that is shipped."""

from __future__ import annotations

import json
import os

_HERE = os.path.dirname(__file__)


def entries(name: str, path: str | None = None) -> list[str]:
    """The lines of a list that are neither empty nor comments."""
    with open(path or os.path.join(_HERE, f"{name}.txt"), encoding="utf-8") as f:
        return [x.strip() for x in f if x.strip() and not x.startswith("#")]


def keywords(path: str | None = None) -> dict[str, list[str]]:
    """Phrases by category, from lines ``category: phrase``."""
    out: dict[str, list[str]] = {}
    for line in entries("toxicity_phrases", path):
        kind, colon, phrase = line.partition(":")
        if colon and phrase.strip():
            out.setdefault(kind.strip(), []).append(phrase.strip().lower())
    return out


def patterns(path: str | None = None) -> dict[str, str]:
    """Expressions by kind of personal data, from a JSON object."""
    with open(path or os.path.join(_HERE, "private_patterns.json"), encoding="utf-8") as f:
        return {k: v for k, v in json.load(f).items() if isinstance(v, str)}
