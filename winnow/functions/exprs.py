"""Column expressions: missing values, clipping, binning, hashing, the normal CDF."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def no_nan(c: ColumnOrName) -> Column:
    """NaN becomes NULL.  Spark orders NaN above everything and it poisons averages."""
    return F.when(~F.isnan(col(c)), col(c))


def clip(c: Column, lo: Column | float, hi: Column | float) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.least(F.greatest(c, lo), hi)


def r6(c: ColumnOrName, digits: int = 6) -> Column:
    """Round at the edge of a query, where the order of float additions shows."""
    return F.round(col(c), digits)


def ratio(num: Column, den: Column) -> Column:
    """Division that is NULL when the denominator is zero or missing."""
    return F.when(den != 0, num / den)


def uniform(*keys: ColumnOrName, word: int = 0) -> Column:
    """Deterministic uniform in [0, 1) from the row's own keys, independent of partitioning.

    One digest holds four 32-bit words; ``word`` picks one.
    """
    digest = F.md5(F.concat_ws(":", *[col(k).cast("string") for k in keys]))
    digits = F.substring(digest, 1 + 8 * word, 8)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(4294967296.0)


# fixed values: coefficients of Abramowitz and Stegun 26.2.17
_AS_P = 0.2316419
_AS_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
_INV_SQRT_2PI = 0.3989422804014327


def normal_cdf(z: Column) -> Column:
    """Standard normal CDF, absolute error below 7.5e-8."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(_AS_P) * F.abs(z))
    poly = F.lit(_AS_B[4])
    for b in reversed(_AS_B[:4]):
        poly = poly * t + F.lit(b)
    tail = F.lit(_INV_SQRT_2PI) * F.exp(F.lit(-0.5) * z * z) * poly * t
    return F.when(z >= 0, F.lit(1.0) - tail).otherwise(tail)


def equal_width_bin(v: Column, lo: float | Column, inv_width: float | Column) -> Column:
    """Truncating bin index; values just below ``lo`` truncate to 0 like an integer cast."""
    return ((v - lo) * inv_width).cast("bigint")


def clamped_bin(v: Column, lo: Column, width: Column, n: int) -> Column:
    return clip(F.floor((v - lo) / width), F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))


def edge_bin(v: Column, edges: Sequence[float]) -> Column:
    """Class of v among a few literal edges, clamped to the first and last class."""
    idx = F.lit(0).cast("bigint")
    for i, e in enumerate(edges[1:-1], start=1):
        idx = F.when(v >= e, F.lit(i).cast("bigint")).otherwise(idx)
    return F.when(v.isNotNull(), idx)


def closed_bin(v: Column, lo: float, width: float, n: int) -> Column:
    """Histogram bin with the last bin closed on the right; NULL outside the range."""
    hi = lo + width * n
    idx = F.floor((v - F.lit(lo)) / F.lit(width))
    return F.when((v >= lo) & (v <= hi), F.least(idx, F.lit(n - 1).cast("bigint")))


def level(value: Column, warn: float, alarm: float) -> Column:
    """0 / 1 / 2 against a warning and an alarm limit; NULL counts as 0."""
    v = F.coalesce(value, F.lit(float("-inf")))
    return F.when(v >= alarm, F.lit(2)).when(v >= warn, F.lit(1)).otherwise(F.lit(0))


def state_name(rank: Column) -> Column:
    return F.element_at(F.array(F.lit("OK"), F.lit("Warning"), F.lit("Alarm")),
                        (rank + 1).cast("int"))


def canonical(named: Mapping[str, Column]) -> Column:
    """Text of named values that no other names and values share.

    Every value is written behind its name and its length; a missing one is a dash.  So text
    cannot move over a border, and a missing value is not any text.
    """
    parts = []
    for name in sorted(named):
        v = named[name].cast("string")
        parts += [F.lit(f"{name}:"),
                  F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-")),
                  F.lit(";")]
    return F.concat(*parts)
