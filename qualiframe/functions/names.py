"""Rules about column names, as Column expressions: for tables of names of any length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import strip

# The shapes of name styles.
STYLES = (
    ("snake_case", r"[a-z0-9]+(_[a-z0-9]+)*"), ("kebab-case", r"[a-z0-9]+(-[a-z0-9]+)*"),
    ("space separated", r"[A-Za-z0-9]+( [A-Za-z0-9]+)+"), ("camelCase/PascalCase", r"[A-Za-z](?=.*[A-Z])[a-zA-Z0-9]*"),
)


def normalized(name: Column) -> Column:
    """Lower case, other characters than letters and digits as single underscores; never empty."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(strip(name)), "[^0-9a-z]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("column"))


def hinted(plain: Column, hints: tuple[str, ...]) -> Column:
    """Whether a hint is a word of a normalized name, or, if longer than two letters, its end."""
    found = F.arrays_overlap(F.split(plain, "_"), F.array(*[F.lit(h) for h in hints]))
    for h in hints:
        if len(h) > 2:
            found = found | plain.endswith(h)
    return found


def style(name: Column) -> Column:
    """Style of a column name; null if it follows none."""
    bare = strip(name)
    return F.coalesce(*[F.when(bare.rlike(f"^(?:{shape})$"), style) for style, shape in STYLES])
