"""Rates, guards, labels and clamps (Column -> Column)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def guarded_ratio(num: Column | str, den: Column | str, default: float = 0.0) -> Column:
    """``num / den``; ``default`` when the denominator is 0, NULL when it is NULL."""
    num, den = col(num).cast("double"), col(den).cast("double")
    return F.when(den == 0, F.lit(default)).otherwise(num / F.nullif(den, F.lit(0.0)))


def null_rate(num: Column | str, den: Column | str) -> Column:
    """``num / den``; NULL when the denominator is 0 or NULL."""
    return col(num).cast("double") / F.nullif(col(den).cast("double"), F.lit(0.0))


def whip(walks: Column | str, hits: Column | str, plate_appearances: Column | str) -> Column:
    """(walks + hits) per third of the plate appearances; 0 without any appearance."""
    return guarded_ratio(col(walks) + col(hits), col(plate_appearances).cast("double") / F.lit(3.0))


def win_rate(wins: Column | str, losses: Column | str) -> Column:
    """Share of wins; 0 unless the total is positive (so 0 for a NULL total)."""
    wins, losses = col(wins).cast("double"), col(losses).cast("double")
    total = wins + losses
    return F.when(total > 0, wins / F.nullif(total, F.lit(0.0))).otherwise(F.lit(0.0))


def binary_label(c: Column | str, positive: str = "W") -> Column:
    """1 for the positive text (case-insensitive), else 0; NULL gives 0."""
    return F.when(F.upper(col(c)) == positive.upper(), F.lit(1)).otherwise(F.lit(0))


def clamp_upper(c: Column | str, bound: float | int) -> Column:
    """Values above ``bound`` become ``bound``; NULL stays NULL (``least`` would skip it)."""
    c = col(c)
    return F.when(c > bound, F.lit(bound)).otherwise(c)


def differences(triples: Iterable[tuple[Column | str, Column | str, str]]) -> list[Column]:
    """``left - right AS name`` for every ``(left, right, name)``; NULL if either is NULL."""
    return [(col(a) - col(b)).alias(name) for a, b, name in triples]
