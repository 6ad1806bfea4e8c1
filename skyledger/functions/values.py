"""Scalar column functions: codes, flags, safe arithmetic, counts of reviewed rows, logits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text that stands for a missing code, and the probability floor.
MISSING_TEXT = ("", "NAN", "NONE")
PROBABILITY_FLOOR = 1e-6


def normalise_code(c: Column) -> Column:
    """Trimmed upper-case text; blank, ``nan`` and ``None`` become null."""
    text = F.upper(F.trim(c.cast("string")))
    return F.when(text.isin(*MISSING_TEXT), None).otherwise(text)


def tolerant_number(c: Column) -> Column:
    """Number or null; never an error, and infinities and NaN count as unusable."""
    value = c.try_cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def tolerant_binary(c: Column) -> Column:
    """0 or 1, anything else null."""
    value = c.try_cast("double")
    return F.when(value.isin(0.0, 1.0), value.cast("int"))


def is_binary(c: Column) -> Column:
    return F.coalesce(c.try_cast("double").isin(0.0, 1.0), F.lit(False))


def strict_binary(c: Column, name: str) -> Column:
    """0/1 from numbers or true/false text; null stays null; any other value stops the job."""
    text = F.lower(F.trim(c.cast("string")))
    return (
        F.when(c.isNull() | (text == ""), F.lit(None).cast("int"))
        .when(text.isin("1", "1.0", "true"), F.lit(1))
        .when(text.isin("0", "0.0", "false"), F.lit(0))
        .otherwise(F.raise_error(F.concat(F.lit(f"unexpected value in {name}: "), text)).cast("int"))
    )


def to_boolean(c: Column) -> Column:
    """True only for 1 / true; null counts as false."""
    return F.coalesce(c.cast("double") == 1.0, F.lit(False))


def ratio(top: Column, bottom: Column) -> Column:
    """Double ratio, null when the denominator is null or zero."""
    return F.when(bottom != 0, top.cast("double") / bottom.cast("double"))


def review_count(n: Column, fraction: Column) -> Column:
    """ceil(fraction * n) with a small float allowance, at least 1, at most n."""
    return F.least(n.cast("long"), F.greatest(F.lit(1).cast("long"), F.ceil(fraction * n - F.lit(1e-9)).cast("long")))


def nearest_count(n: Column, fraction: Column) -> Column:
    """round-half-even(fraction * n), at least 1, at most n."""
    return F.least(n.cast("long"), F.greatest(F.lit(1).cast("long"), F.bround(fraction * n, 0).cast("long")))


def clip_probability(p: Column, floor: float = PROBABILITY_FLOOR) -> Column:
    return F.least(F.greatest(p.cast("double"), F.lit(floor)), F.lit(1.0 - floor))


def to_logit(p: Column, floor: float = PROBABILITY_FLOOR) -> Column:
    q = clip_probability(p, floor)
    return F.log(q / (F.lit(1.0) - q))


def from_logit(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def log1p_exp(z: Column) -> Column:
    """log(1 + exp(z)) without overflow."""
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
