"""Ordered rules and scores as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ladder(rules: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """The label of the first rule that holds."""
    out = None
    for condition, label in rules:
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def weighted(parts: Sequence[tuple[Column, float]]) -> Column:
    """100 times the weighted mean of the parts that are not null, rounded."""
    total = sum((F.coalesce(value * weight, F.lit(0.0)) for value, weight in parts), F.lit(0.0))
    weights = sum((F.when(value.isNotNull(), F.lit(weight)).otherwise(0.0) for value, weight in parts), F.lit(0.0))
    return F.round(F.lit(100.0) * total / F.nullif(weights, F.lit(0.0)))


def worst(severities: Sequence[str], label: Column) -> Column:
    """Place of a label in an order of severities, from 0; unknown labels are -1."""
    return F.array_position(F.array(*map(F.lit, severities)), label).cast("int") - 1
