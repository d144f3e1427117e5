"""Column expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def code(value, width: float) -> Column:
    """Integer grid code, half-even: ``rint(value / width)``."""
    return F.rint(col(value) / F.lit(float(width))).cast("bigint")


def round_share(value: Column, digits: int = 9) -> Column:
    """``round(value, digits)`` of a value from 0 to 1, bit by bit, for many values a row.

    ``round`` goes by way of decimal text. Here a double is scaled and cut off; only what lies so close to a half that
    scaling could err is left to ``round``.
    """
    scale = F.lit(10.0 ** digits)
    near = F.abs(value * scale - F.floor(value * scale) - 0.5)  # NaN is larger than all numbers
    return F.when((value >= 0) & near.between(1e-3, 0.6), F.floor(value * scale + 0.5) / scale).otherwise(F.round(value, digits))


def decode(value, width: float) -> Column:
    """Grid code back to a clean float (rounded to 6 digits)."""
    return F.round(col(value) * F.lit(float(width)), 6)


def floor_bin(value, width: float) -> Column:
    return F.floor(col(value) / F.lit(float(width))) * F.lit(float(width))


def clip(value, low, high) -> Column:
    """``value`` kept inside ``low`` and ``high`` (numbers or columns); null stays null."""
    return F.when(col(value).isNotNull(), F.least(F.greatest(col(value), F.lit(low)), F.lit(high)))


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("bigint")


def weighted_mean(value, weight: str | None = None) -> Column:
    """Mean over rows that stand for ``weight`` rows each; nulls do not count."""
    if weight is None:
        return F.avg(col(value))
    return F.sum(col(value) * F.col(weight)) / F.sum(F.when(col(value).isNotNull(), F.col(weight)))


def micros(ts) -> Column:
    return F.unix_micros(col(ts))


def seconds_between(later, earlier) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def safe_div(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(default))


def hash_fraction(keys, seed: int = 0) -> Column:
    """Repeatable uniform value in [0, 1) per row, independent of partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), *[col(k) for k in keys]), F.lit(1_000_000_007)) / F.lit(1_000_000_007.0)


def linspace(start: float, stop: float, n: int) -> list[float]:
    if n == 1:
        return [float(start)]
    step = (stop - start) / (n - 1)
    return [float(start + i * step) for i in range(n - 1)] + [float(stop)]


def md5_fraction(key, seed: int) -> Column:
    """Number in [0, 1) from the first 32 bits of the MD5 of seed and key columns, joined by ``|``."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(col(k).cast("string"), F.lit("")) for k in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
