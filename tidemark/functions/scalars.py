"""Scalar column functions; null means "not defined" and never 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(x: Column | str) -> Column:
    """True for values that are neither null, NaN nor infinite."""
    x = col(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def defined(x: Column | str) -> Column:
    """x, with NaN and infinities as null."""
    return F.when(finite(x), col(x))


def clip_unit(x: Column | str) -> Column:
    """x within [-1, 1]; null stays null (least and greatest would skip it)."""
    x = col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0)))


def safe_ln(x: Column | str) -> Column:
    """ln of positive values, else null."""
    x = col(x)
    return F.when(x > 0, F.ln(F.when(x > 0, x)))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0."""
    b = col(b)
    return col(a) / F.when(b != 0, b)


def keyed_uniform(*key: Column | str, low: float = -1.0, high: float = 1.0) -> Column:
    """A reproducible uniform number for each key, whatever the partitioning."""
    digest = F.md5(F.concat_ws("|", *[col(k).cast("string") for k in key]).cast("binary"))
    unit = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)
    return F.lit(low) + (high - low) * unit


def predicted_direction(text: Column | str) -> Column:
    """null, non_positive or positive, from a prediction in words (looked for in this order; null if none is found)."""
    t = F.lower(col(text))
    has = lambda *parts: F.greatest(*[t.contains(p) for p in parts]) if len(parts) > 1 else t.contains(parts[0])
    named = F.when(has("indistinguishable from zero", "= 0 within", "= 0 by construction"), "null")
    return named.when(has("<= 0"), "non_positive").when(has("ic > ", "> 0"), "positive").otherwise("null")


def finite_json(x: Column | str, digits: int = 6) -> Column:
    """A rounded number for JSON; NaN and infinities become null."""
    return F.round(defined(x), digits)
