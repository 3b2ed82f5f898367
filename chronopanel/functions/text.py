"""String columns: normalising, grouping by ordered rules, describing generated names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(x: Column) -> Column:
    """Upper case, trimmed, runs of white space as one space; null as an empty string."""
    return F.upper(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " ")))


def grouped(x: Column, rules: list[tuple[str, tuple[str, ...]]], unavailable: tuple[str, ...], other: str) -> Column:
    """The first rule with a part that the normalised text contains names its group; unavailable markers and empty texts are null, the rest ``other``."""
    n = normalised(x)
    has = lambda parts: F.greatest(*[n.contains(p) for p in parts], F.lit(False))
    out = F.when((n == "") | has(unavailable), None)
    for name, parts in rules:
        out = out.when(has(parts), name)
    return out.otherwise(other)


def described(name: Column) -> Column:
    """``item__stat`` as "stat of item"; other names as they are."""
    item, stat = F.regexp_extract(name, r"^(.+?)__(\w+)$", 1), F.regexp_extract(name, r"^(.+?)__(\w+)$", 2)
    return F.when(item != "", F.concat(stat, F.lit(" of "), item)).otherwise(name)
