"""Wrong definitions on purpose: which checks would notice them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import money, ratio
from ledgerloom.plans.metrics import Metric, Registry, count_rows


def mutants(registry: Registry) -> dict[str, Metric]:
    """Declared metrics with one part rewritten: numerator, denominator, rows or aggregate."""
    loss, pmpm, denial, use = (registry.get(m) for m in ("loss_ratio", "pmpm", "denial_rate", "utilisation_per_1000"))
    claimed = F.col("total_lines") > 0
    return {
        "loss_ratio: inverted": replace(loss, numerator=loss.denominator, denominator=loss.numerator),
        "loss_ratio: allowed for paid": replace(loss, numerator=lambda: money("allowed_amount")),
        "loss_ratio: rows for premium": replace(loss, denominator=count_rows),
        "loss_ratio: months with claims only": replace(loss, denominator=lambda: money(F.when(claimed, F.col("premium_collected")))),
        "loss_ratio: largest for sum": replace(loss, numerator=lambda: F.max("paid_amount")),
        "pmpm: claims for months": replace(pmpm, denominator=lambda: F.sum("total_lines").cast("double")),
        "pmpm: months with claims only": replace(pmpm, denominator=lambda: F.count_if(claimed).cast("double")),
        "denial_rate: inverted": replace(denial, numerator=denial.denominator, denominator=denial.numerator),
        "denial_rate: paid for denied": replace(denial, numerator=lambda: F.sum(F.col("total_lines") - F.col("denied_lines")).cast("double")),
        "utilisation_per_1000: not per thousand": replace(use, numerator=lambda: F.sum("total_lines").cast("double")),
    }


def caught(base: DataFrame, registry: Registry) -> DataFrame:
    """(mutant, check, noticed) for each wrong definition and check: originals and mutants from one pass, by region and in total."""
    wrong = mutants(registry)
    told = {**{m.name: registry.get(m.name) for m in wrong.values()}, **wrong}
    alias = {name: f"m{i}" for i, name in enumerate(told)}
    sums = [c for name, m in told.items() for c in (m.numerator().alias(f"{alias[name]}_n"), m.denominator().alias(f"{alias[name]}_d"))]
    cells = base.groupingSets([["region"], []], "region").agg(*sums, F.grouping("region").alias("whole"))
    in_all = lambda c: F.sum(F.when(F.col("whole") == 1, F.col(c))).alias(c)
    in_parts = lambda a: F.sum(F.when(F.col("whole") == 0, F.col(f"{a}_n"))).alias(f"{a}_p")
    one = cells.agg(*[in_all(f"{a}_{x}") for a in alias.values() for x in "nd"], *[in_parts(a) for a in alias.values()])
    value = lambda name: ratio(F.col(f"{alias[name]}_n"), F.col(f"{alias[name]}_d"))

    def checks(name: str, m: Metric) -> dict[str, Column]:
        v, n, p = value(name), F.col(f"{alias[name]}_n"), F.col(f"{alias[name]}_p")
        out = {"regions reconcile to the total": F.abs(p - n) < 0.01, "figure equals the golden one": F.abs(v - value(m.name)) < 1e-9}
        if m.name == "loss_ratio":
            out["loss ratio within a plausible band"] = v.between(0.3, 1.5)
        if m.name == "denial_rate":
            out["rate is no more than one"] = v <= 1
        return out

    rows = [F.struct(F.lit(name).alias("mutant"), F.lit(check).alias("check"), (~F.coalesce(holds, F.lit(False))).alias("noticed")) for name, m in wrong.items() for check, holds in checks(name, m).items()]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
