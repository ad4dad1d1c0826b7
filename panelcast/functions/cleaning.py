"""Tolerant casts, names, dates and overrides."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snake_case(name: str) -> str:
    """``AgeGroup 20-29`` -> ``age_group_20_29``."""
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    return re.sub(r"[^0-9a-zA-Z]+", "_", spaced).strip("_").lower()


def clean_names(df: DataFrame) -> DataFrame:
    """All columns in snake_case; clashes get a numeric suffix."""
    seen: dict[str, int] = {}
    names = []
    for old in df.columns:
        name = snake_case(old)
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names)


def to_number(c: Column | str) -> Column:
    """Number or NULL, never an error."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(c).try_cast("double")


def numeric_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Tolerant cast of several text columns at once."""
    return df.withColumns({c: to_number(c) for c in cols})


def parse_short_date(c: Column | str) -> Column:
    """``M/d/yy`` text to a date; anything else is NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.try_to_date(c, "M/d/yy")


def days_left(event_date: Column, on: Column) -> Column:
    return F.datediff(event_date, on)


def weeks_left(event_date: Column, on: Column) -> Column:
    """Whole weeks to the event; n/7 never ties at one half."""
    return F.round(F.datediff(event_date, on) / F.lit(7.0)).cast("int")


def fill_from(target: Column | str, source: Column | str) -> Column:
    """``target``, with its gaps filled from ``source``."""
    return F.coalesce(
        F.col(target) if isinstance(target, str) else target,
        F.col(source) if isinstance(source, str) else source,
    )


def round_columns(df: DataFrame, digits: int = 6, cols: Sequence[str] | None = None) -> DataFrame:
    """Every double column (or the named ones) rounded, order kept."""
    chosen = set(cols) if cols is not None else {c for c, t in df.dtypes if t in ("double", "float")}
    return df.select(*[F.round(c, digits).alias(c) if c in chosen else F.col(c) for c in df.columns])


def drop_subheader(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Drop rows on which no measure is a number: sub-headers, preambles, footnotes."""
    return df.filter(F.coalesce(*[to_number(c) for c in measures]).isNotNull())


def override_values(df: DataFrame, overrides: DataFrame, key: str, column: str) -> DataFrame:
    """Replace ``column`` for the keys listed in ``overrides(key, <column>)``.

    Left to Catalyst's own size check: a short list is broadcast, a long one is not.
    """
    repl = overrides.select(F.col(key), F.col(column).alias("__override"))
    return (
        df.join(repl, key, "left")
        .withColumn(column, F.coalesce("__override", column))
        .drop("__override")
    )
