"""Scalar column functions of the grid engine: all built-in expressions, no UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quant(value: Column, digits: int) -> Column:
    """Round half up by plain IEEE steps, so that other engines get the same double.

    The half is a hair more than 0.5: exact halves, which sums in another order may miss by a bit,
    then lie off the boundary.
    """
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.500001)).cast("double") / F.lit(scale)


def clean(value: Column) -> Column:
    """Missing values as NULL: NaN compares and averages as a number in SQL, a grid's nodata must not."""
    value = value.cast("double")
    return F.when(~F.isnan(value), value)


def or_zero(value: Column) -> Column:
    """NULL, NaN and infinities as 0."""
    value = clean(value)
    return F.coalesce(F.when(F.abs(value) != F.lit(float("inf")), value), F.lit(0.0))


def weight(anomaly: Column, shape: str | Column = "exponential", scale: float | Column = 1.0) -> Column:
    """Weight in [0, 1] of an intervention on a cell: largest at anomaly 0.

    Shape and scale may be columns, as where every scenario has its own; an unknown shape in a column gives NULL.
    """
    scale = scale if isinstance(scale, Column) else F.lit(scale)
    raw = {"exponential": F.exp(-F.abs(anomaly) / scale), "gaussian": F.exp(-(anomaly * anomaly) / (F.lit(2.0) * scale * scale))}
    if isinstance(shape, Column):
        chosen = F.coalesce(*(F.when(shape == name, value) for name, value in raw.items()))
    elif shape in raw:
        chosen = raw[shape]
    else:
        raise ValueError(f"unknown weight shape {shape!r}")
    return F.when(chosen.isNotNull(), F.least(F.greatest(chosen, F.lit(0.0)), F.lit(1.0)))


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, NULL where bottom is 0 or NULL."""
    return top / F.when(bottom != 0, bottom)


def percent_improvement(base: Column, new: Column, absolute: bool = False) -> Column:
    """100 * (base - new) / base, for objectives that are minimised; 0 where base is 0.

    With `absolute` the divisor is |base|, so that the sign tells the direction for a negative base too.
    """
    part = F.coalesce(ratio(base - new, F.abs(base) if absolute else base), F.when(base == 0, F.lit(0.0)))
    return part * 100.0


def min_max(value: Column, low: Column, high: Column, constant: float = 0.5) -> Column:
    """Value scaled to [0, 1]; a constant column gives `constant`."""
    return F.when(value.isNotNull(), F.coalesce(ratio(value - low, high - low), F.lit(constant)))


def if_else(condition: Column, yes: Column, no: Column, na: str = "null") -> Column:
    """Conditional over cells; an unknown condition gives NULL (na='null') or the else value (na='else')."""
    if na not in ("null", "else"):
        raise ValueError(f"unknown na mode {na!r}")
    rest = F.when(condition, yes).otherwise(no)
    return F.when(condition.isNotNull(), rest) if na == "null" else rest


def draw(seed: int | Column, *parts: Column) -> Column:
    """Portable whole number of 32 bits from md5: the same in every engine and partitioning."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    text = F.concat_ws(":", seed.cast("string"), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def uniform(seed: int | Column, *parts: Column) -> Column:
    """Portable uniform number in [0, 1): a draw as a part of all 2 ** 32."""
    return draw(seed, *parts).cast("double") / F.lit(4294967296.0)


def ordered_bits(value: Column) -> Column:
    """A long that rises with a double: its bits, negated below zero.  NULL and NaN give NULL."""
    value = value.cast("double")
    size = F.coalesce(F.abs(value), F.lit(0.0))
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), size).cast("long")
    bits = F.when(value.isNotNull() & ~F.isnan(value), bits)
    return F.when(value < 0, -bits).otherwise(bits)


def linspace(low: float, high: float, n: int) -> list[float]:
    return [low + i * (high - low) / (n - 1) for i in range(n)] if n > 1 else [low]


def class_of(value: Column, breaks: list[float], include_lowest: bool = True) -> Column:
    """Number (from 1) of the right-closed interval between consecutive breaks; outside all, NULL."""
    out = F.lit(None).cast("int")
    for k in range(len(breaks) - 1, 0, -1):
        above = value >= breaks[k - 1] if include_lowest and k == 1 else value > breaks[k - 1]
        out = F.when(above & (value <= breaks[k]), F.lit(k)).otherwise(out)
    return out


def class_among(value: Column, breaks: Column, include_lowest: bool = True) -> Column:
    """class_of for breaks in an array column, as where every row's group has its own."""
    below = F.size(F.filter(breaks, lambda b: b < value))
    inside = (value <= F.element_at(breaks, -1)) & (value >= breaks[0]) & (F.size(breaks) > 1)
    return F.when(inside, F.greatest(below, F.lit(1)) if include_lowest else F.nullif(below, F.lit(0))).cast("int")


def class3(value: Column, sd: Column) -> Column:
    """'3' up to -sd, '2' up to sd, '1' above: right-closed classes of condition."""
    return F.when(value <= -sd, "3").when(value <= sd, "2").when(value.isNotNull() & sd.isNotNull(), "1")


def hex_colour(red: Column, green: Column, blue: Column) -> Column:
    part = lambda c: F.lpad(F.hex(F.floor(c * 255.0 + 0.5).cast("long")), 2, "0")
    return F.concat(F.lit("#"), part(red), part(green), part(blue))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p.isNotNull(), "ns")
