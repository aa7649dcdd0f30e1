"""Column names that don't clash."""

from __future__ import annotations


def free(taken: list[str], name: str) -> str:
    """``name``, or a longer one that isn't taken; names are told apart without regard to case."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name += "_"
    return name


def quoted(name: str) -> str:
    """The name as SQL has it, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"
