"""Hierarchical forecasts of cost per member month, and ways to make them add up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import money
from ledgerloom.plans.tables import cut

SEASON, HOLDOUT = 12, 6
#: How each level's owner forecasts: window, damping, uplift.
SETTINGS = {"total": (6, 0.95, 0.03), "region": (12, 0.85, 0.0), "product": (9, 0.90, 0.0), "leaf": (12, 0.80, 0.0)}


def leaves(base: DataFrame) -> DataFrame:
    """Paid per member month of each region, product and month."""
    return base.groupBy("region", "product", "month_index").agg((money("paid_amount") / F.count("*")).alias("pmpm"))


def filled(panel: DataFrame) -> DataFrame:
    """Every leaf in every month of the panel; gaps take the value before, a gap at the head the first one after. ``gap`` marks them."""
    months = panel.select("month_index").distinct()
    keys = panel.select("region", "product").distinct()
    dense = keys.join(F.broadcast(months), F.lit(True)).join(panel, ["region", "product", "month_index"], "left")
    line = Window.partitionBy("region", "product").orderBy("month_index")
    back = F.last("pmpm", True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("pmpm", True).over(line.rowsBetween(0, Window.unboundedFollowing))
    return dense.select("region", "product", "month_index", F.coalesce(back, ahead).alias("pmpm"), F.col("pmpm").isNull().alias("gap"))


def hierarchy(panel: DataFrame) -> DataFrame:
    """Total, regions, products and leaves of each month, as sums of the leaves."""
    rolled = panel.cube("region", "product", "month_index").agg(F.sum("pmpm").alias("pmpm"), F.grouping("region").alias("r"), F.grouping("product").alias("p"), F.grouping("month_index").alias("m")).filter("m = 0")
    level = F.when((F.col("r") == 1) & (F.col("p") == 1), "total").when(F.col("p") == 1, "region").when(F.col("r") == 1, "product").otherwise("leaf")
    label = F.when((F.col("r") == 1) & (F.col("p") == 1), "all").when(F.col("p") == 1, F.col("region")).when(F.col("r") == 1, F.col("product")).otherwise(F.concat_ws("|", "region", "product"))
    return rolled.select(level.alias("level"), label.alias("label"), "month_index", "pmpm")


def _by_level(place: int) -> Column:
    """The level's setting: 0 window, 1 damping, 2 uplift."""
    return F.create_map(*[F.lit(x) for level, v in SETTINGS.items() for x in (level, float(v[place]))])[F.col("level")]


def base_forecasts(series: DataFrame, holdout: int = HOLDOUT) -> DataFrame:
    """Each series forecast on its own, by its level's settings, for its last months.

    A damped line through the recent deseasonalised values, seasons added back;
    a series of fewer than fifteen known values repeats its last, one without
    any is zero. All of it is groupings by series, so there may be any number.
    """
    line = Window.partitionBy("level", "label")
    rows = series.select("level", "label", "month_index", "pmpm").withColumns({"i": F.row_number().over(line.orderBy("month_index")) - 1, "m": F.greatest(F.count("*").over(line) - holdout, F.lit(0))})
    rows = cut(rows.withColumns({"place": F.col("i") % SEASON, "window": _by_level(0).cast("int")}))
    known = rows.filter("i < m")
    # Whole cycles only, from the first month on; a season is its mean less the mean of all.
    whole = known.filter(F.col("i") < F.floor(F.col("m") / SEASON) * SEASON).groupBy("level", "label", "place").agg(F.avg("pmpm").alias("mean"))
    seasons = whole.withColumn("season", F.col("mean") - F.avg("mean").over(line)).drop("mean")
    recent = known.filter(F.col("i") >= F.col("m") - F.col("window")).join(seasons, ["level", "label", "place"], "left")
    bare, t = F.col("pmpm") - F.coalesce("season", F.lit(0.0)), F.col("i") - F.col("m") + 1
    fits = recent.groupBy("level", "label").agg(F.coalesce(F.regr_slope(bare, t), F.lit(0.0)).alias("slope"), F.coalesce(F.regr_intercept(bare, t), F.avg(bare)).alias("height"), F.max_by("pmpm", "i").alias("last"))
    future = rows.filter("i >= m").join(fits, ["level", "label"], "left").join(seasons, ["level", "label", "place"], "left")
    damping, h = _by_level(1), F.col("i") - F.col("m") + 1
    ahead = F.when(damping == 1, h.cast("double")).otherwise(damping * (1 - F.pow(damping, h)) / (1 - damping))
    drawn = (F.col("height") + F.col("slope") * ahead + F.coalesce("season", F.lit(0.0))) * (1 + _by_level(2))
    base = F.when(F.col("m") == 0, 0.0).when(F.col("m") < SEASON + 3, F.col("last")).otherwise(drawn)
    return future.select("level", "label", "month_index", F.col("pmpm").alias("actual"), base.alias("base"))


def _members(forecast: DataFrame) -> DataFrame:
    """(level, label, leaf): which leaves each series sums."""
    leaf = forecast.filter("level = 'leaf'").select(F.col("label").alias("leaf")).distinct()
    of = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), v.alias("label")) for k, v in (("total", F.lit("all")), ("region", F.substring_index("leaf", "|", 1)), ("product", F.substring_index("leaf", "|", -1)), ("leaf", F.col("leaf")))]))
    return leaf.select("leaf", of.alias("s")).select("s.level", "s.label", "leaf")


def bottom_up(forecast: DataFrame) -> DataFrame:
    """Every series as the sum of its leaves' forecasts."""
    leaf = forecast.filter("level = 'leaf'").select(F.col("label").alias("leaf"), "month_index", F.col("base").alias("v"))
    return _members(forecast).join(leaf, "leaf").groupBy("level", "label", "month_index").agg(F.sum("v").alias("bottom_up"))


def top_down(forecast: DataFrame, history: DataFrame) -> DataFrame:
    """The total's forecast, dealt to the leaves by their share of the history, and summed up again."""
    past = history.filter("level = 'leaf'").groupBy(F.col("label").alias("leaf")).agg(F.sum("pmpm").alias("s"))
    share = past.select("leaf", (F.col("s") / F.sum("s").over(Window.partitionBy(F.lit(0)))).alias("share"))
    total = forecast.filter("level = 'total'").select("month_index", F.col("base").alias("v"))
    leaf = share.join(F.broadcast(total), F.lit(True)).select("leaf", "month_index", (F.col("v") * F.col("share")).alias("v"))
    return _members(forecast).join(leaf, "leaf").groupBy("level", "label", "month_index").agg(F.sum("v").alias("top_down"))


def residual_spread(history: DataFrame, holdout: int = HOLDOUT) -> DataFrame:
    """(level, label, spread): the variance of what forecasts of the history's last months missed."""
    return base_forecasts(history, holdout).groupBy("level", "label").agg(F.var_pop(F.col("actual") - F.col("base")).alias("spread"))


def _dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def _plus(a: str | Column, times: Column, b: str | Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + times * y)


def reconciled(forecast: DataFrame, spreads: DataFrame, steps: int = 500, tolerance: float = 1e-24) -> DataFrame:
    """(method, level, label, month_index, value): least-squares reconciliation, plain (ols) and weighted by residual variance (mint).

    A leaf's adjustment is its variance times what is owed along its total, its
    region and its product; what these series owe solves a symmetric system in
    as many unknowns as there are regions, products and one. Conjugate gradients
    solve it for all methods and months at once, a row with a list of unknowns
    for each: a step joins them to the leaves and sums what comes back by
    grouping. Nothing but the largest residual comes to the driver, so the
    leaves may be many.
    """
    key = ["method", "month_index"]
    weights = F.explode(F.create_map(F.lit("ols"), F.lit(1.0), F.lit("mint"), F.greatest(F.coalesce("spread", F.lit(0.0)), F.lit(1e-9)))).alias("method", "v")
    weighted = cut(forecast.join(spreads, ["level", "label"], "left").select("level", "label", "month_index", "base", weights))
    upper = weighted.filter("level <> 'leaf'").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.concat_ws("|", "level", "label").alias("name"), "v", "base"))).alias("all"))
    leaf = weighted.filter("level = 'leaf'").select(*key, F.col("label").alias("leaf"), F.substring_index("label", "|", 1).alias("region"), F.substring_index("label", "|", -1).alias("product"), "base", "v")
    place = lambda name: F.array_position("names", name)
    leaf = leaf.join(upper.select(*key, F.col("all.name").alias("names")), key)
    leaf = cut(leaf.select(*key, "leaf", "region", "product", "base", "v", F.array(place(F.lit("total|all")), place(F.concat(F.lit("region|"), "region")), place(F.concat(F.lit("product|"), "product"))).alias("at")))

    def up(rows: DataFrame, value: Column, name: str) -> DataFrame:
        """A list of sums over the leaves of each upper series."""
        sums = rows.select(*key, F.explode("at").alias("i"), value.alias("x")).groupBy(*key, "i").agg(F.sum("x").alias("x"))
        return sums.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(name))

    def along(values: DataFrame, name: str) -> DataFrame:
        """The leaves with the sum of what the series hold that each is in."""
        rows = leaf.join(values.select(*key, F.col(name).alias("values")), key)
        return rows.withColumn("along", sum((F.element_at("values", F.col("at")[i].cast("int")) for i in range(3)), F.lit(0.0))).drop("values")

    state = upper.join(up(leaf, F.col("base"), "sums"), key)
    state = state.select(*key, F.col("all.v").alias("v"), F.transform("all", lambda s: F.lit(0.0)).alias("x"), F.zip_with("all", "sums", lambda s, t: s["base"] - t).alias("r"))
    state = cut(state.withColumns({"p": F.col("r"), "rr": _dot("r", "r"), "start": F.greatest(_dot("r", "r"), F.lit(1e-30))}))
    for _ in range(steps):
        if (state.agg(F.max(F.col("rr") / F.col("start"))).first()[0] or 0.0) <= tolerance:
            break
        q = up(along(state, "p"), F.col("v") * F.col("along"), "summed")
        stepped = state.join(q, key).withColumn("q", F.zip_with("summed", F.zip_with("v", "p", lambda a, b: a * b), lambda a, b: a + b))
        stepped = stepped.withColumn("pq", _dot("p", "q"))
        rate = F.when(F.col("pq") > 0, F.col("rr") / F.col("pq")).otherwise(0.0)
        stepped = stepped.withColumns({"x": _plus("x", rate, "p"), "r": _plus("r", -rate, "q")}).withColumn("now", _dot("r", "r"))
        turn = F.when(F.col("rr") > 0, F.col("now") / F.col("rr")).otherwise(0.0)
        state = cut(stepped.select(*key, "v", "x", "r", _plus("r", turn, "p").alias("p"), F.col("now").alias("rr"), "start"))
    fitted = along(state, "x").withColumn("value", F.col("base") + F.col("v") * F.col("along"))
    of = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), c.alias("label")) for k, c in (("total", F.lit("all")), ("region", F.col("region")), ("product", F.col("product")), ("leaf", F.col("leaf")))]))
    return fitted.select(*key, of.alias("s"), "value").groupBy("method", "s.level", "s.label", "month_index").agg(F.sum("value").alias("value"))


def all_methods(series: DataFrame, holdout: int = HOLDOUT, projected: bool = True) -> DataFrame:
    """(method, level, label, month_index, actual, value) of the base and the reconciled forecasts; without ``projected``, only those that need no equations."""
    last = series.agg(F.max("month_index")).first()[0]
    history = series.filter(F.col("month_index") <= last - holdout)
    forecast = cut(base_forecasts(series, holdout))
    named = lambda df, c: df.select(F.lit(c).alias("method"), "level", "label", "month_index", F.col(c).alias("value"))
    every = named(forecast, "base").union(named(bottom_up(forecast), "bottom_up")).union(named(top_down(forecast, history), "top_down"))
    if projected:
        every = every.union(reconciled(forecast, residual_spread(history)).select("method", "level", "label", "month_index", "value"))
    return every.join(forecast.select("level", "label", "month_index", "actual"), ["level", "label", "month_index"]).select("method", "level", "label", "month_index", "actual", "value")


def incoherence(methods: DataFrame) -> DataFrame:
    """How far each method's series are from the sums of its leaves, in all and in percent of all its values."""
    leaf = methods.filter("level = 'leaf'").select("method", F.col("label").alias("leaf"), "month_index", F.col("value").alias("v"))
    implied = _members(methods).join(leaf, "leaf").groupBy("method", "level", "label", "month_index").agg(F.sum("v").alias("implied"))
    sums = methods.join(implied, ["method", "level", "label", "month_index"]).groupBy("method").agg(F.sum(F.abs(F.col("value") - F.col("implied"))).alias("gap"), F.sum(F.abs("value")).alias("whole"))
    return sums.select("method", F.round("gap", 4).alias("incoherence"), F.round(100 * F.col("gap") / F.col("whole"), 4).alias("incoherence_pct"), (F.col("gap") < 1e-6 * F.greatest(F.col("whole"), F.lit(1.0))).alias("coherent"))


def scores(methods: DataFrame) -> DataFrame:
    """MAPE and RMSE of each method, over all series and by level."""
    return methods.withColumn("level", F.explode(F.array("level", F.lit("ALL")))).groupBy("method", "level").agg(
        F.round(F.avg(F.abs((F.col("actual") - F.col("value")) / F.nullif(F.col("actual"), F.lit(0.0)))) * 100, 3).alias("mape"), F.round(F.sqrt(F.avg(F.pow(F.col("actual") - F.col("value"), 2))), 4).alias("rmse"))


def best(methods: DataFrame) -> DataFrame:
    """The method with the smallest error over all series and the level at which it does worst: one row."""
    table = scores(methods)
    winner = table.filter("level = 'ALL'").agg(F.min_by("method", F.struct("mape", "method")).alias("method"), F.min("mape").alias("mape"))
    worst = table.filter("level <> 'ALL'").groupBy("method").agg(F.max_by("level", F.struct("mape", "level")).alias("worst_level"), F.max("mape").alias("worst_mape"))
    return winner.join(worst, "method").select("method", "mape", "worst_level", "worst_mape")
