"""Prompt templates in a folder of ``<version>.txt`` files."""

from __future__ import annotations

from pathlib import Path


def prompt_template(version: str, folder: str | Path = "prompts") -> str:
    return (Path(folder) / f"{version}.txt").read_text()


def prompt_versions(folder: str | Path = "prompts") -> list[str]:
    return sorted(p.stem for p in Path(folder).glob("*.txt"))
