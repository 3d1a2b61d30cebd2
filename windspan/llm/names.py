"""Names of helper columns."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(df: DataFrame, *names: str) -> list[str]:
    """The given names, each with as many underscores behind it as make it no column of `df`,
    whatever the case."""
    taken = {c.lower() for c in df.columns}
    made = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        made.append(name)
    return made
