"""A governed metric layer: declared metrics and dimensions, compiled to DataFrame plans over one relation."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import money, ratio
from ledgerloom.plans.tables import Relations


@dataclass(frozen=True)
class Dimension:
    name: str
    column: Callable[[], Column]
    description: str = ""


@dataclass(frozen=True)
class Metric:
    """A ratio of sums; without a denominator, a plain aggregate."""

    name: str
    label: str
    numerator: Callable[[], Column]
    denominator: Callable[[], Column] | None = None
    grain: str = "member_month"
    description: str = ""
    unit: str = "ratio"
    filters: tuple[Callable[[], Column], ...] = ()
    higher_is_better: bool | None = None
    owner: str = "actuarial"


@dataclass
class Registry:
    base_relation: str = "member_month"
    metrics: dict[str, Metric] = field(default_factory=dict)
    dimensions: dict[str, Dimension] = field(default_factory=dict)

    def add_metric(self, metric: Metric) -> None:
        if metric.name in self.metrics:
            raise ValueError(f"metric '{metric.name}' is already defined")
        self.metrics[metric.name] = metric

    def add_dimension(self, dimension: Dimension) -> None:
        if dimension.name in self.dimensions:
            raise ValueError(f"dimension '{dimension.name}' is already defined")
        self.dimensions[dimension.name] = dimension

    def get(self, name: str) -> Metric:
        if name not in self.metrics:
            raise ValueError(f"unknown metric '{name}'; known: {', '.join(sorted(self.metrics))}")
        return self.metrics[name]

    def compile(self, base: DataFrame | Relations, name: str, by: Iterable[str] = (), where: Iterable[Column] = ()) -> DataFrame:
        """value, numerator and denominator of a metric by declared dimensions; names are checked before any plan exists.

        Of declared relations the one that the registry names is taken.
        """
        metric, by = self.get(name), list(by)
        if unknown := [d for d in by if d not in self.dimensions]:
            raise ValueError(f"unknown dimension {unknown}; known: {', '.join(sorted(self.dimensions))}")
        base = base.get(self.base_relation) if isinstance(base, Relations) else base
        for condition in (*(f() for f in metric.filters), *where):
            base = base.filter(condition)
        rows = base.groupBy(*[self.dimensions[d].column().alias(d) for d in by])
        if metric.denominator is None:
            return rows.agg(metric.numerator().alias("numerator")).select(*by, F.col("numerator").alias("value"), "numerator")
        out = rows.agg(metric.numerator().alias("numerator"), metric.denominator().alias("denominator"))
        return out.select(*by, ratio(F.col("numerator"), F.col("denominator")).alias("value"), "numerator", "denominator")

    def catalog(self) -> list[dict]:
        return [{"name": m.name, "label": m.label, "unit": m.unit, "grain": m.grain, "owner": m.owner, "description": m.description, "higher_is_better": m.higher_is_better} for _, m in sorted(self.metrics.items())]

    def catalog_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(x.values()) for x in self.catalog()], "name string, label string, unit string, grain string, owner string, description string, higher_is_better boolean")


def count_rows() -> Column:
    return F.count(F.lit(1)).cast("double")


def standard() -> Registry:
    out = Registry()
    for name, what in (("month", "calendar month, YYYY-MM"), ("region", "the member's region"), ("plan", "plan tier"), ("product", "product line"), ("channel", "how the member was won")):
        out.add_dimension(Dimension(name, lambda name=name: F.col(name), what))
    out.add_dimension(Dimension("age_band", lambda: F.col("age_band").cast("string"), "age band of ten years"))
    paid, premium = lambda: money("paid_amount"), lambda: money("premium_collected")
    total = lambda c: lambda: F.sum(c).cast("double")
    # Names, labels, units, owners of the published catalogue.
    for metric in (
        Metric("loss_ratio", "Loss ratio", paid, premium, higher_is_better=False, description="paid claims over premium collected"),
        Metric("pmpm", "Paid per member per month", paid, count_rows, unit="currency", higher_is_better=False, description="paid claims over member months"),
        Metric("premium_pmpm", "Premium PMPM", premium, count_rows, unit="currency", description="premium collected over member months"),
        Metric("denial_rate", "Denial rate", total("denied_lines"), total("total_lines"), higher_is_better=False, owner="operations", description="denied lines over all lines"),
        Metric("utilisation_per_1000", "Utilisation per 1,000 members", lambda: F.sum("total_lines").cast("double") * 1000.0, count_rows, unit="count", owner="clinical", description="lines per thousand member months"),
        Metric("member_months", "Member months", count_rows, unit="count", description="months of exposure"),
        Metric("paid_amount", "Paid claims", paid, unit="currency", description="paid claims in total"),
    ):
        out.add_metric(metric)
    return out


def without_pharmacy(registry: Registry) -> Registry:
    """The proposed change: the loss ratio, and it alone, leaves pharmacy out."""
    changed = Registry("member_month_with_pharmacy", dict(registry.metrics), dict(registry.dimensions))
    changed.metrics["loss_ratio"] = replace(registry.get("loss_ratio"), label="Loss ratio (ex-pharmacy)", numerator=lambda: money(F.col("paid_amount") - F.col("pharmacy_paid")))
    return changed


STANDARD = standard()
