"""Snapshots of governed figures, and what a change of definition moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import ratio
from ledgerloom.plans.metrics import Registry

#: The figures that are kept.
SPECS = (("loss_ratio", ()), ("loss_ratio", ("plan",)), ("loss_ratio", ("region",)), ("loss_ratio", ("month",)), ("pmpm", ()), ("pmpm", ("region",)), ("denial_rate", ()), ("denial_rate", ("plan",)), ("member_months", ()), ("paid_amount", ("region",)))
ABSOLUTE, RELATIVE = 0.005, 0.01


def figures(base: DataFrame, registries: dict[str, Registry], specs=SPECS) -> DataFrame:
    """(metric, slice) and, under each registry's name, the figure by its definitions, to six places: one pass over ``base``.

    Grouping sets give every slicing at once, and a metric that registries share
    is summed once. A metric with filters of its own sees other rows than the
    rest and is compiled by itself.
    """
    known = {key: r for key, r in registries.items()}
    apart = {name for name, _ in specs for r in known.values() if r.get(name).filters}
    shared = [(name, tuple(by)) for name, by in specs if name not in apart]
    out = None
    if shared:
        dims = {d: next(iter(known.values())).dimensions[d] for _, by in shared for d in by}
        defined: dict[tuple, str] = {}
        for key, r in known.items():
            for name, _ in shared:
                defined.setdefault((name, id(r.get(name))), f"m{len(defined)}")
        metrics = {alias: next(r.get(name) for r in known.values() if id(r.get(name)) == i) for (name, i), alias in defined.items()}
        sums = [c for alias, m in metrics.items() for c in (m.numerator().alias(f"{alias}_n"), *([m.denominator().alias(f"{alias}_d")] if m.denominator else []))]
        sets = list(dict.fromkeys(by for _, by in shared))
        rows = base.select("*", *[x.column().alias(f"by_{d}") for d, x in dims.items()])
        keys = [f"by_{d}" for d in dims]
        marks = [F.grouping(k).alias(f"without_{k}") for k in keys]
        cells = (rows.groupingSets([[f"by_{d}" for d in by] for by in sets], *keys).agg(*sums, *marks)) if keys else rows.agg(*sums)
        value = lambda alias: F.round(ratio(F.col(f"{alias}_n"), F.col(f"{alias}_d")) if metrics[alias].denominator else F.col(f"{alias}_n"), 6)
        told = []
        for name, by in shared:
            here = F.lit(True)
            for d in dims:
                here = here & (F.col(f"without_by_{d}") == (0 if d in by else 1))
            slice_ = F.concat_ws("|", *[F.col(f"by_{d}") for d in by]) if by else F.lit("ALL")
            told.append(F.when(here, F.struct(F.lit("|".join((name, *by))).alias("metric"), slice_.alias("slice"), *[value(defined[name, id(r.get(name))]).alias(key) for key, r in known.items()])))
        out = cells.select(F.explode(F.array_compact(F.array(*told))).alias("x")).select("x.*")
    for name, by in specs:
        if name in apart:
            one = None
            slice_ = F.concat_ws("|", *[F.col(d) for d in by]) if by else F.lit("ALL")
            for key, r in known.items():
                side = r.compile(base, name, by).select(F.lit("|".join((name, *by))).alias("metric"), slice_.alias("slice"), F.round("value", 6).alias(key))
                one = side if one is None else one.join(side, ["metric", "slice"], "full_outer")
            out = one if out is None else out.unionByName(one)
    return out


def snapshot(base: DataFrame, registry: Registry, specs=SPECS) -> DataFrame:
    """(metric, slice, value): slices keyed by all their dimensions, values to six places."""
    return figures(base, {"value": registry}, specs)


def _moves(both: DataFrame, gone: Column, absolute: float, relative: float) -> DataFrame:
    change = F.col("after") - F.col("before")
    missing = gone | (F.col("before").isNull() != F.col("after").isNull())
    share = F.when(F.col("before") != 0, change / F.col("before"))
    moved = missing | F.coalesce(F.abs(change) >= 1e-9, F.lit(False))
    material = missing | (moved & F.coalesce((F.abs(change) >= absolute) | (F.abs(share) >= relative), F.lit(False)))
    return both.select("metric", "slice", "before", "after", F.round(change, 6).alias("change"), F.round(share, 6).alias("relative"), moved.alias("moved"), material.alias("material"))


def diff(before: DataFrame, after: DataFrame, absolute: float = ABSOLUTE, relative: float = RELATIVE) -> DataFrame:
    """Every figure of either snapshot: change, relative change, moved, material. One that only one side has, or knows, has moved materially."""
    both = before.select("metric", "slice", F.col("value").alias("before"), F.lit(True).alias("_a")).join(after.select("metric", "slice", F.col("value").alias("after"), F.lit(True).alias("_b")), ["metric", "slice"], "full_outer")
    return _moves(both, F.col("_a").isNull() | F.col("_b").isNull(), absolute, relative)


def blast_radius(base: DataFrame, current: Registry, changed: Registry) -> DataFrame:
    """What a change of definitions moves; both sides are sums of the same groups, so nothing is joined."""
    return _moves(figures(base, {"before": current, "after": changed}), F.lit(False), ABSOLUTE, RELATIVE)


def first_drift(moves: DataFrame, n: int = 20) -> DataFrame:
    """The report's rows: the first figures that moved, by name and slice."""
    return moves.filter("moved").orderBy("metric", "slice").limit(n)


def largest(moves: DataFrame, n: int = 10) -> DataFrame:
    return moves.filter("moved").orderBy(F.desc(F.abs("change")), "metric", "slice").limit(n)


def golden_status(golden: DataFrame | None, current: DataFrame) -> tuple[str, DataFrame | None]:
    """'created' if there was none to compare with; else 'clean' or 'drift' and what moved."""
    if golden is None:
        return "created", None
    moved = diff(golden, current).filter("moved")
    return ("clean" if moved.isEmpty() else "drift"), moved
