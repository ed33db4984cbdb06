"""Column functions that several operators use."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_label(index: Column | str, first_year: int = 2024) -> Column:
    """0 -> 'YYYY-01' of the first year, and so on, by whole division."""
    i = F.col(index) if isinstance(index, str) else index
    return F.format_string("%04d-%02d", (F.lit(first_year) + F.floor(i / 12)).cast("int"), (i % 12 + 1).cast("int"))


def month_label_rounded(index: Column | str, first_year: int = 2024) -> Column:
    """The label with the year rounded half to even, as a published set of figures has it; wrong for half the months."""
    i = F.col(index) if isinstance(index, str) else index
    return F.format_string("%04d-%02d", (F.lit(first_year) + F.bround(i / 12)).cast("int"), (i % 12 + 1).cast("int"))


def month_index(label: Column | str, first_year: int = 2024) -> Column:
    s = F.col(label) if isinstance(label, str) else label
    return ((F.substring(s, 1, 4).cast("int") - first_year) * 12 + F.substring(s, 6, 2).cast("int") - 1).cast("int")


def months_since(date: Column | str, first_year: int) -> Column:
    return ((F.year(date) - first_year) * 12 + F.month(date) - 1).cast("int")


def ratio(num: Column, den: Column) -> Column:
    """num / den, null where den is zero or null."""
    return F.when(den != 0, num / den)


def money(column: Column | str) -> Column:
    """The sum as exact cents, given as a double."""
    return F.sum((F.col(column) if isinstance(column, str) else column).cast("decimal(18,2)")).cast("double")


def exact_mean(column: Column | str) -> Column:
    """The mean to four decimals' exact sum, so that the order of rows doesn't matter."""
    c = F.col(column) if isinstance(column, str) else column
    return F.sum(c.cast("decimal(20,4)")).cast("double") / F.count(c)


def half_up(x: Column, digits: int) -> Column:
    """Rounded by plain doubles, so that every engine takes the same side of a tie."""
    return F.floor(x * F.lit(10.0**digits) + 0.5) / F.lit(10.0**digits)


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends on the given values alone; alike in every engine with md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


def logistic(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def finite(x: Column, digits: int = 6) -> Column:
    """Rounded; null for NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(F.round(x, digits))


def erfc(x: Column) -> Column:
    """The complementary error function: a series up to 2, a continued fraction beyond; symmetric for negative values. Null stays null."""
    z = F.abs(x)
    near = F.least(z, F.lit(2.0))
    # erf z = 2 z / sqrt(pi) * exp(-z^2) * sum of (2 z^2)^n / (1 * 3 * ... * (2 n + 1))
    step = lambda acc, n: F.struct((acc["term"] * 2.0 * near * near / (2.0 * n + 1.0)).alias("term"), (acc["total"] + acc["term"] * 2.0 * near * near / (2.0 * n + 1.0)).alias("total"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")), step, lambda acc: acc["total"])
    low = 1.0 - 2.0 / math.sqrt(math.pi) * near * F.exp(-near * near) * series
    # erfc z = exp(-z^2) / sqrt(pi) / (z + (1/2) / (z + 1 / (z + (3/2) / (z + ...))))
    far = F.greatest(z, F.lit(2.0))
    tail = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), far, lambda acc, n: far + n / 2.0 / acc)
    value = F.when(z < 2.0, low).otherwise(F.exp(-far * far) / math.sqrt(math.pi) / tail)
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(F.when(x < 0, 2.0 - value).otherwise(value))


def chi2_tail(x: Column | str) -> Column:
    """Upper tail of chi-square with one degree of freedom."""
    c = F.col(x) if isinstance(x, str) else x
    return erfc(F.sqrt(F.greatest(c, F.lit(0.0)) / 2.0) + F.lit(0.0) * c)
