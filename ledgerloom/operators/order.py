"""Global orders without a global window: positions, tied ranks, equal parts and running sums.

Rows are range-partitioned and sorted; a row's place is its place in its
partition plus the rows of the partitions before. What is known of all rows at
once is one line a partition. Ties are broken by the columns that follow, so a
value that a third of all rows have fills several partitions; its rank comes
from one grouping over values, which combines before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.plans.tables import cut

#: A value that one row in so many has counts as common; there are no more such values than that.
COMMON = 1_024


def positioned(df: DataFrame, *by: Column | str, name: str = "position") -> DataFrame:
    """``df`` and each row's place, from 1, in the order of ``by``, which must tell rows apart if the places are to be repeatable."""
    rows = cut(df.orderBy(*by).withColumn("_at", F.monotonically_increasing_id()))
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    rows = rows.withColumn("_part", part)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_before") + within + 1).drop("_at", "_part", "_before")


def average_ranked(df: DataFrame, column: str, key: str, count: int, name: str) -> DataFrame:
    """``df`` and the rank of ``column`` under ``name``, tied values sharing the mean of their places; ``count`` is the number of rows."""
    placed = cut(positioned(df, column, key, name="_place"))
    ties = cut(placed.groupBy(column).agg(F.count("*").alias("_k"), F.min("_place").alias("_first")).filter("_k > 1"))
    rank = F.col("_first") + (F.col("_k") - 1) / 2.0
    common = F.broadcast(ties.filter(F.col("_k") * COMMON >= count))
    tied = placed.join(common, column).withColumn(name, rank).drop("_k", "_first")
    other = placed.join(common, column, "left_anti").join(ties.filter(F.col("_k") * COMMON < count), column, "left")
    return tied.unionByName(other.withColumn(name, F.coalesce(rank, F.col("_place").cast("double"))).drop("_k", "_first")).drop("_place")


def equal_part(position: Column, count: int, parts: int) -> Column:
    """Which of ``parts`` equal runs of ``count`` rows a position is in, from 1; the first runs take what doesn't divide."""
    size, rest = divmod(count, parts)
    long = rest * (size + 1)
    if not size:
        return position.cast("int")
    return F.when(position <= long, F.ceil(position / (size + 1))).otherwise(rest + F.ceil((position - long) / size)).cast("int")


def bounds(df: DataFrame, column: str, parts: int = 64) -> list:
    """Values that part the rows into about equal ranges; no more than ``parts`` come to the driver."""
    cuts = df.agg(F.percentile_approx(column, [i / parts for i in range(1, parts)], 10_000)).first()[0]
    return sorted(set(cuts or []))


def range_of(column: str, cuts: list) -> Column:
    """The number of the range between ``cuts`` that a value is in."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(column))) if cuts else F.lit(0)


def running(rows: DataFrame, part: str, by: str, sums: list[str], descending: bool = False) -> DataFrame:
    """``rows`` with each of ``sums`` replaced by its sum over all rows up to this one, in the order of ``part``, then ``by``.

    Within a range by a window, over ranges by the ranges' totals, one line each.
    """
    order = (lambda c: F.desc(c)) if descending else F.asc
    within = Window.partitionBy(part).orderBy(order(by)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy(order(part)).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(part).agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    totals = totals.select(part, *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums])
    local = rows.withColumns({c: F.sum(c).over(within) for c in sums})
    return local.join(F.broadcast(totals), part).withColumns({c: F.col(c) + F.col(f"_b_{c}") for c in sums}).drop(*[f"_b_{c}" for c in sums])
