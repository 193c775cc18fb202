"""Text blocks of the incident log and the report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def section(name: str, details: Column) -> Column:
    return F.concat(F.lit(f"**{name}**\n"), details)


def links(references: Column) -> Column:
    """References as Markdown list items; NULL when there are none."""
    lines = F.transform(references, lambda r: F.concat(F.lit("- ["), r["title"], F.lit("]("), r["url"], F.lit(")")))
    return F.when(F.size(references) > 0, F.array_join(lines, "\n"))
