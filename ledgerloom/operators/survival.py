"""Survival analysis on spans: one row per distinct time carries every estimate."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import chi2_tail
from ledgerloom.operators.order import bounds, range_of, running
from ledgerloom.plans.tables import cut

Z = 1.96


def subjects(spans: DataFrame, members: DataFrame) -> DataFrame:
    """Spans with the member's group and the covariates of the models."""
    return spans.join(members.select("member_id", "channel", "premium_burden", "plan"), "member_id").withColumns(
        {"burden10": F.col("premium_burden") * 10, "is_individual": (F.col("channel") == "individual").cast("int")})


def life_table(df: DataFrame, by: tuple[str, ...] = (), time: str = "tenure_months", event: str = "event_observed") -> DataFrame:
    """Events and those at risk at each distinct time of each group."""
    at = df.groupBy(*by, F.col(time).alias("time")).agg(F.sum(event).cast("long").alias("events"), F.count("*").alias("leaving"))
    later = Window.partitionBy(*by).orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)
    return at.withColumn("at_risk", F.sum("leaving").over(later).cast("long"))


def kaplan_meier(df: DataFrame, by: tuple[str, ...] = (), **columns) -> DataFrame:
    """Survival at each time with an event, with Greenwood's band at that time, to five places."""
    past = Window.partitionBy(*by).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    d, n = F.col("events"), F.col("at_risk")
    rows = life_table(df, by, **columns).filter("events > 0")
    # A time at which all left ends the product at zero; logarithms are kept off it.
    log = F.sum(F.when(d < n, F.ln(1.0 - d / n)).otherwise(0.0)).over(past)
    over = F.max(F.when(d == n, 1).otherwise(0)).over(past)
    rows = rows.withColumns({"s": F.when(over == 1, 0.0).otherwise(F.exp(log)), "g": F.sum(F.when(d < n, d / (n * (n - d))).otherwise(0.0)).over(past)})
    half = Z * F.col("s") * F.sqrt("g")
    return rows.select(*by, "time", "events", "at_risk", F.round("s", 5).alias("survival"), F.round(F.greatest(F.col("s") - half, F.lit(0.0)), 5).alias("ci_lower"), F.round(F.least(F.col("s") + half, F.lit(1.0)), 5).alias("ci_upper"))


def median_survival(curve: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The first time at which half or fewer are left; null if there is none."""
    return curve.groupBy(*by).agg(F.min(F.when(F.col("survival") <= 0.5, F.col("time"))).alias("median"))


def log_rank(df: DataFrame, first, second, time: str = "tenure_months", event: str = "event_observed", p: bool = False) -> DataFrame:
    """Observed and expected events of the first group, variance, chi-square to four places; null without variance. With ``p``, the p value to six."""
    arm = F.when(first, 1).when(second, 2)
    at = df.withColumn("arm", arm).filter("arm is not null").groupBy(F.col(time).alias("time")).agg(
        *[F.sum(F.when(F.col("arm") == a, F.col(event)).otherwise(0)).cast("double").alias(f"d{a}") for a in (1, 2)], *[F.sum(F.when(F.col("arm") == a, 1).otherwise(0)).alias(f"c{a}") for a in (1, 2)])
    later = Window.orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumns({f"n{a}": F.sum(f"c{a}").over(later).cast("double") for a in (1, 2)})
    d, n = F.col("d1") + F.col("d2"), F.col("n1") + F.col("n2")
    sums = at.filter(d > 0).agg(F.sum("d1").alias("observed"), F.sum(d * F.col("n1") / n).alias("expected"), F.sum(F.when(n > 1, d * (F.col("n1") / n) * (F.col("n2") / n) * (n - d) / (n - 1)).otherwise(0.0)).alias("variance"))
    chi2 = F.when(F.col("variance") > 0, F.pow(F.col("observed") - F.col("expected"), 2) / F.col("variance"))
    # Under names of their own, as an alias that a select makes would be taken for the column inside a lambda.
    exact = sums.withColumn("statistic", chi2).withColumn("tail", chi2_tail("statistic"))
    return exact.select("observed", F.round("expected", 4).alias("expected"), F.round("variance", 4).alias("variance"), F.round("statistic", 4).alias("chi2"), *([F.round("tail", 6).alias("p_value")] if p else []))


def log_rank_pairs(df: DataFrame, by: str, time: str = "tenure_months", event: str = "event_observed") -> DataFrame:
    """The log-rank test of every two groups (first before second by name), from one grouping of the subjects.

    What is joined pair by pair are the few groups' rows of one time; a group that has nobody left at a time brings none.
    """
    at = df.filter(F.col(by).isNotNull()).groupBy(F.col(by).alias("g"), F.col(time).alias("time")).agg(F.sum(event).cast("double").alias("d"), F.count("*").alias("c"))
    # Every group at every time that any has: those at risk are those with this time or a later one.
    grid = at.select("g").distinct().join(at.select("time").distinct(), how="full", on=F.lit(True))
    later = Window.partitionBy("g").orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)
    full = grid.join(at, ["g", "time"], "left").select("g", "time", F.coalesce("d", F.lit(0.0)).alias("d"), F.coalesce(F.sum("c").over(later), F.lit(0)).cast("double").alias("n"))
    one, two = (full.select(F.col("g").alias(f"g{i}"), "time", F.col("d").alias(f"d{i}"), F.col("n").alias(f"n{i}")) for i in (1, 2))
    both = one.join(two, "time").filter("g1 < g2 and d1 + d2 > 0")
    d, n = F.col("d1") + F.col("d2"), F.col("n1") + F.col("n2")
    sums = both.groupBy("g1", "g2").agg(F.sum("d1").alias("observed"), F.sum(d * F.col("n1") / n).alias("expected"), F.sum(F.when(n > 1, d * (F.col("n1") / n) * (F.col("n2") / n) * (n - d) / (n - 1)).otherwise(0.0)).alias("variance"))
    chi2 = F.when(F.col("variance") > 0, F.pow(F.col("observed") - F.col("expected"), 2) / F.col("variance"))
    exact = sums.withColumn("statistic", chi2).withColumn("tail", chi2_tail("statistic"))
    return exact.select(F.col("g1").alias("first"), F.col("g2").alias("second"), "observed", F.round("expected", 4).alias("expected"), F.round("statistic", 4).alias("chi2"), F.round("tail", 6).alias("p_value"))


def cause_mix(spans: DataFrame) -> DataFrame:
    """Share of each cause among those who left."""
    n = F.count("*")
    return spans.filter("event_observed = 1").groupBy("exit_cause").agg(n.alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))


def competing(spans: DataFrame, cause: str = "voluntary") -> DataFrame:
    """One cause's figures at the end: 1 - KM with other causes censored, share of all members, cumulative incidence."""
    own = spans.withColumn("own", F.when(F.col("exit_cause") == cause, 1).otherwise(0))
    km = kaplan_meier(own, event="own").agg(F.round(1.0 - F.min("survival"), 5).alias("one_minus_km"))
    share = own.agg(F.round(F.avg("own"), 5).alias("voluntary_share"))
    last = cumulative_incidence(spans, cause).agg(F.max("cif").alias("cif"))
    return km.join(share, how="full", on=F.lit(True)).join(last, how="full", on=F.lit(True))


def cumulative_incidence(spans: DataFrame, cause: str = "voluntary") -> DataFrame:
    """Aalen-Johansen: the sum of survival just before a time times the cause's hazard there."""
    df = spans.withColumn("own", F.when(F.col("exit_cause") == cause, 1).otherwise(0))
    at = df.groupBy(F.col("tenure_months").alias("time")).agg(F.sum("event_observed").cast("long").alias("events"), F.sum("own").cast("long").alias("own"), F.count("*").alias("leaving"))
    later, past = Window.orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0), Window.orderBy("time")
    at = at.withColumn("n", F.sum("leaving").over(later)).filter("events > 0")
    step = F.when(F.col("events") < F.col("n"), F.ln(1.0 - F.col("events") / F.col("n"))).otherwise(F.lit(-745.0))
    at = at.withColumn("before", F.exp(F.coalesce(F.sum(step).over(past.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))))
    return at.select("time", F.round(F.sum(F.col("before") * F.col("own") / F.col("n")).over(past.rowsBetween(Window.unboundedPreceding, 0)), 5).alias("cif"))


def person_months(df: DataFrame) -> DataFrame:
    """A row per month at risk, the month of leaving included; a denial counts from its month on."""
    months = F.col("tenure_months") + F.col("event_observed")
    rows = df.filter(months > 0).withColumn("tenure", F.explode(F.sequence(F.lit(0), months - 1)))
    denied = (F.col("denial_month") >= 0) & (F.col("tenure") >= F.col("denial_month") - F.col("start_month"))
    lapsed = (F.col("event_observed") == 1) & (F.col("tenure") == F.col("tenure_months"))
    return rows.select("member_id", "tenure", "burden10", "utilisation_low", "is_individual", denied.cast("int").alias("had_denial"), lapsed.cast("int").alias("lapsed"))


@dataclass(frozen=True)
class RiskSets:
    """Subjects with their times dealt to ranges, so that sums over all who are still at risk run range by range."""

    rows: DataFrame
    covariates: tuple[str, ...]
    means: tuple[float, ...]

    @classmethod
    def of(cls, df: DataFrame, covariates: list[str], time: str, event: str, parts: int = 64) -> RiskSets:
        cuts = bounds(df, time, parts)
        rows = df.select(F.col(time).alias("time"), F.col(event).cast("double").alias("event"), *[F.col(c).cast("double").alias(c) for c in covariates]).withColumn("part", range_of("time", cuts))
        # Continuous covariates may make a row a subject, so the rows are kept in the shared folder and not in memory.
        rows = cut(rows)
        means = rows.agg(*[F.avg(c) for c in covariates]).first()
        return cls(rows, tuple(covariates), tuple(float(m or 0.0) for m in means))

    def likelihood(self, beta) -> tuple[float, np.ndarray, np.ndarray]:
        """Log partial likelihood (Breslow), gradient and information at ``beta``: one job, one row back."""
        k = len(self.covariates)
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        x = [F.col(c) - m for c, m in zip(self.covariates, self.means)]
        w = F.exp(sum((float(b) * c for b, c in zip(beta, x)), F.lit(0.0)))
        at = self.rows.groupBy("part", "time").agg(
            F.sum("event").alias("d"), F.sum(w).alias("w"), *[F.sum(F.col("event") * c).alias(f"e{i}") for i, c in enumerate(x)],
            *[F.sum(w * c).alias(f"x{i}") for i, c in enumerate(x)], *[F.sum(w * x[i] * x[j]).alias(f"x{i}_{j}") for i, j in pairs])
        sums = ["w", *[f"x{i}" for i in range(k)], *[f"x{i}_{j}" for i, j in pairs]]
        at = running(at, "part", "time", sums, descending=True).filter("d > 0")
        d, mean = F.col("d"), [F.col(f"x{i}") / F.col("w") for i in range(k)]
        value = sum((F.col(f"e{i}") * float(b) for i, b in enumerate(beta)), F.lit(0.0)) - d * F.ln("w")
        row = at.agg(F.sum(value), *[F.sum(F.col(f"e{i}") - d * mean[i]) for i in range(k)], *[F.sum(d * (F.col(f"x{i}_{j}") / F.col("w") - mean[i] * mean[j])) for i, j in pairs]).first()
        information = np.zeros((k, k))
        for (i, j), v in zip(pairs, row[1 + k :]):
            information[i, j] = information[j, i] = v or 0.0
        return float(row[0] or 0.0), np.array([v or 0.0 for v in row[1 : 1 + k]]), information


def cox(df: DataFrame, covariates: list[str], time: str = "tenure_months", event: str = "event_observed", steps: int = 25, tolerance: float = 1e-9) -> dict:
    """Cox regression, Breslow ties, by Newton steps; each is one job from which sums come back, however many distinct times there are."""
    sets, beta = RiskSets.of(df, covariates, time, event), np.zeros(len(covariates))
    for _ in range(steps):
        value, gradient, information = sets.likelihood(beta)
        firm = information + 1e-12 * np.eye(len(beta))
        step = np.linalg.solve(firm, gradient)
        beta = beta + step
        if np.abs(step).max() < tolerance:
            break
    return {"beta": beta.tolist(), "se": np.sqrt(np.diag(np.linalg.inv(firm))).tolist(), "log_likelihood": value}


def cox_frame(df: DataFrame, covariates: list[str]) -> DataFrame:
    fit = cox(df, covariates)
    return df.sparkSession.createDataFrame([(c, round(b, 5), round(s, 5)) for c, b, s in zip(covariates, fit["beta"], fit["se"])], "covariate string, beta double, se double")


def cox_slope(df: DataFrame, beta: dict[str, float]) -> DataFrame:
    """(covariate, gradient, log_likelihood) at given coefficients: where all gradients are zero, the fit stands."""
    value, gradient, _ = RiskSets.of(df, list(beta), "tenure_months", "event_observed").likelihood(list(beta.values()))
    return df.sparkSession.createDataFrame([(c, round(float(g), 4), round(value, 4)) for c, g in zip(beta, gradient)], "covariate string, gradient double, log_likelihood double")


def logistic(df: DataFrame, label: str, covariates: list[str], c: float = 1e6) -> dict[str, float]:
    """Coefficients of a logistic regression with penalty 1 / C on the summed loss."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=covariates, outputCol="_features").transform(df.select(F.col(label).cast("double").alias("_label"), *[F.col(v).cast("double").alias(v) for v in covariates]))
    fit = LogisticRegression(featuresCol="_features", labelCol="_label", regParam=1.0 / (c * max(1, df.count())), elasticNetParam=0.0, standardization=False, tol=1e-8, maxIter=60).fit(data)
    return dict(zip(covariates, fit.coefficients.toArray().tolist())) | {"intercept": float(fit.intercept)}


def logistic_slope(df: DataFrame, label: str, beta: dict[str, float]) -> DataFrame:
    """(covariate, gradient, log_likelihood) of a logistic regression at given coefficients, the intercept among them: one pass."""
    x = {c: F.lit(1.0) if c == "intercept" else F.col(c).cast("double") for c in beta}
    score = sum((float(b) * x[c] for c, b in beta.items()), F.lit(0.0))
    y = F.col(label).cast("double")
    # log(1 + exp(s)) without overflow.
    value = y * score - (F.greatest(score, F.lit(0.0)) + F.log1p(F.exp(-F.abs(score))))
    sums = df.agg(F.sum(value).alias("value"), *[F.sum((y - 1.0 / (1.0 + F.exp(-score))) * x[c]).alias(c) for c in beta])
    rows = F.array(*[F.struct(F.lit(c).alias("covariate"), F.round(c, 4).alias("gradient"), F.round("value", 4).alias("log_likelihood")) for c in beta])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def hazard(df: DataFrame) -> dict[str, float]:
    """Discrete-time hazard of lapsing on person-months."""
    return logistic(person_months(df), "lapsed", ["burden10", "utilisation_low", "is_individual", "had_denial", "tenure"])


def naive_churn(df: DataFrame) -> dict[str, float]:
    """The control that ignores time: did the member leave at all?"""
    return logistic(df, "event_observed", ["burden10", "utilisation_low", "is_individual", "had_denial"])


def scored(estimates: DataFrame, truth: dict[str, float]) -> DataFrame:
    """(estimator, covariate, error) and each estimator's mean absolute error, for (estimator, covariate, beta) against known effects."""
    known = F.create_map(*[F.lit(x) for pair in truth.items() for x in pair])
    errors = estimates.withColumn("truth", known[F.col("covariate")]).filter("truth is not null").withColumn("error", F.abs(F.col("beta") - F.col("truth")))
    return errors.select("estimator", "covariate", F.round("error", 6).alias("error"), F.round(F.avg("error").over(Window.partitionBy("estimator")), 6).alias("mae"))


def estimates(df: DataFrame) -> DataFrame:
    """(estimator, covariate, beta) of the control that ignores time, Cox's model and the discrete hazard."""
    names = ["burden10", "utilisation_low", "is_individual", "had_denial"]
    fits = {"naive": naive_churn(df), "cox": dict(zip(names, cox(df, names)["beta"])), "discrete": hazard(df)}
    return df.sparkSession.createDataFrame([(k, c, float(b)) for k, fit in fits.items() for c, b in fit.items()], "estimator string, covariate string, beta double")
