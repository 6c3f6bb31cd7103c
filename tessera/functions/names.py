"""Names for helper columns that clash with none of a table's."""

from __future__ import annotations

from collections.abc import Iterable


def fresh(columns: Iterable[str], name: str) -> str:
    """``name`` with as many underscores in front as it takes to differ from all ``columns``, in any case."""
    taken = {c.lower() for c in columns}
    name = f"__{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name
