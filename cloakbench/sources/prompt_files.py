"""Prompt texts as package data: one TOML file a package, read once."""

from __future__ import annotations

import functools
import tomllib
from pathlib import Path


@functools.cache
def load_prompts(package: str, folder: str | None = None) -> dict[str, str]:
    """Name -> text of the prompts of a package (detector, generator, judge)."""
    with open(Path(folder or Path(__file__).parent / "prompts") / f"{package}.toml", "rb") as f:
        return tomllib.load(f)
