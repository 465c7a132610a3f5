"""Instructions for coding agents that work in a vault: a marked block in their file, and a skill file."""

from __future__ import annotations

import re
from pathlib import Path

START, END = "<!-- loamline:start -->", "<!-- loamline:end -->"
BLOCK = """## Corpus memory

Run `python -m loamline inspect --json` before broad work in this folder to see the entities and questions of its notes. Run `python -m loamline ask "<question>" --json` when a task needs notes or decisions. `python -m loamline serve` offers the same over stdio. After larger changes of the notes run `python -m loamline index`."""
SKILL = """---
name: loamline
description: Look into the local corpus memory before research, planning or implementation.
---

Run `python -m loamline inspect --json` to see what the notes hold, and `python -m loamline ask "<question>" --json` to find the notes for a task.
"""
FILES = {"codex": "AGENTS.md", "claude": "CLAUDE.md"}


def upsert_block(path: Path, block: str) -> None:
    """Puts the block between its marks: over an older one, else at the end. Doing it again changes nothing."""
    text = path.read_text() if path.exists() else ""
    marked = f"{START}\n{block.strip()}\n{END}"
    pattern = re.compile(re.escape(START) + r".*?" + re.escape(END), re.S)
    if pattern.search(text):
        text = pattern.sub(lambda _: marked, text, count=1)
    else:
        text = text.rstrip() + ("\n\n" if text.strip() else "") + marked + "\n"
    path.write_text(text)


def install(vault: str | Path, agent: str) -> list[Path]:
    """Writes the files for an agent and returns them."""
    if agent not in FILES:
        raise ValueError(f"agent must be one of {', '.join(FILES)}")
    at = Path(vault).resolve() / FILES[agent]
    upsert_block(at, BLOCK)
    if agent != "codex":
        return [at]
    skill = at.parent / ".agents" / "skills" / "loamline" / "SKILL.md"
    skill.parent.mkdir(parents=True, exist_ok=True)
    skill.write_text(SKILL)
    return [at, skill]
