"""Prospective risk: a point-in-time dataset, models, calibration, fairness."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import exact_mean, half_up, money
from ledgerloom.operators.order import average_ranked, equal_part, positioned
from ledgerloom.plans.tables import cut
from ledgerloom.sources.payer import INPATIENT

FEATURES = ["age_band", "chronic_count", "prior_cost", "prior_lines", "prior_inpatient", "zip_deprivation_index"]


def dataset(base: DataFrame, claims: DataFrame, members: DataFrame, first_target: int, least_months: int = 3) -> DataFrame:
    """One row a member: features of the months before ``first_target``, the target from it on. One conditional pass over the months."""
    early = F.col("month_index") < first_target
    sums = base.groupBy("member_id").agg(
        F.coalesce(money(F.when(early, F.col("paid_amount"))), F.lit(0.0)).alias("prior_cost"), F.sum(F.when(early, F.col("total_lines")).otherwise(0)).cast("long").alias("prior_lines"), F.count_if(early).alias("prior_months"),
        F.coalesce(money(F.when(~early, F.col("paid_amount"))), F.lit(0.0)).alias("future_cost"), F.count_if(~early).alias("future_months")).filter((F.col("prior_months") > 0) & (F.col("future_months") >= least_months))
    stays = claims.filter(early & (F.col("service_category") == INPATIENT)).groupBy("member_id").agg(F.count("*").alias("prior_inpatient"))
    dim = members.select("member_id", "age_band", "chronic_count", "region", "plan", "zip_deprivation_index")
    return sums.join(dim, "member_id").join(stays, "member_id", "left").select(
        "member_id", "age_band", "chronic_count", "region", "plan", "zip_deprivation_index", "prior_cost", "prior_lines", F.coalesce("prior_inpatient", F.lit(0)).alias("prior_inpatient"), "future_cost", "future_months")


def split(df: DataFrame, share: float = 0.7, seed: str = "1509") -> DataFrame:
    """``train``: the first share of rows by a seeded hash of the member."""
    df = cut(df)
    return positioned(df, F.md5(F.concat_ws("|", "member_id", F.lit(seed))), "member_id").withColumn("train", F.col("position") <= F.floor(F.lit(df.count()) * share)).drop("position")


def fixed_score(df: DataFrame) -> DataFrame:
    """A transparent linear score, for checking the evaluation apart from any model."""
    return df.withColumn("predicted", F.col("prior_cost") * 0.4 + F.col("prior_lines") * 1000.0 + F.col("chronic_count") * 5000.0 + 20000.0)


def calibration(df: DataFrame, actual: str = "future_cost", predicted: str = "predicted", key: str = "member_id", bins: int = 10) -> DataFrame:
    """Mean predicted and actual of each bin of the prediction; the first bins take what doesn't divide."""
    rows = cut(df.select(F.col(key).alias("key"), F.col(predicted).alias("p"), F.col(actual).alias("a")))
    rows = positioned(rows, "p", "key").withColumn("decile", equal_part(F.col("position"), rows.count(), bins))
    p, a = exact_mean("p"), exact_mean("a")
    return rows.groupBy("decile").agg(F.count("*").alias("n"), half_up(p, 2).alias("mean_predicted"), half_up(a, 2).alias("mean_actual"), half_up(F.when(a != 0, p / a), 4).alias("ratio"))


def evaluate(df: DataFrame, actual: str = "future_cost", predicted: str = "predicted", key: str = "member_id") -> DataFrame:
    """Rank correlation, lift of the top decile, R2, MAE, slope and intercept of actual on predicted, total error; one row."""
    rows = cut(df.select(F.col(key).alias("key"), F.col(actual).alias("y"), F.col(predicted).alias("p")))
    n, mean, varied = rows.agg(F.count("*"), F.sum(F.col("y").cast("decimal(20,4)")).cast("double") / F.count("y"), F.max("p") > F.min("p")).first()
    rows = average_ranked(average_ranked(rows, "y", "key", n, "ry"), "p", "key", n, "rp")
    # The last of the ascending order are the top decile.
    rows = positioned(rows, "p", "key").withColumn("top", F.col("position") > n - -(-n // 10))
    # Rank and line need predictions that differ; without, they have no input and are null.
    vp, vrp = (F.when(F.lit(bool(varied)), F.col(c)) for c in ("p", "rp"))
    out = rows.agg(
        F.round(F.corr(F.col("ry"), vrp), 4).alias("spearman"), F.round(F.avg(F.when(F.col("top"), F.col("y"))) / F.avg("y"), 3).alias("top_decile_lift"),
        F.round(1 - F.sum(F.pow(F.col("y") - F.col("p"), 2)) / F.nullif(F.sum(F.pow(F.col("y") - F.lit(mean), 2)), F.lit(0.0)), 4).alias("r2"), half_up(exact_mean(F.abs(F.col("y") - F.col("p"))), 2).alias("mae"),
        F.round(F.regr_slope(F.col("y"), vp), 4).alias("calibration_slope"), F.round(F.regr_intercept(F.col("y"), vp), 1).alias("calibration_intercept"),
        F.round((F.sum("p") - F.sum("y")) / F.sum("y") * 100, 3).alias("payment_error_pct"))
    return out.withColumn("well_calibrated", F.coalesce(F.col("calibration_slope").between(0.9, 1.1), F.lit(False)))


def region_parity(df: DataFrame, actual: str = "future_cost", predicted: str = "predicted") -> DataFrame:
    """Mean predicted against mean actual of each region, and the largest over the smallest ratio."""
    by = df.groupBy("region").agg(F.count("*").alias("n"), exact_mean(predicted).alias("p"), exact_mean(actual).alias("a")).withColumn("r", F.col("p") / F.col("a"))
    one = Window.partitionBy(F.lit(0))
    return by.select("region", "n", half_up(F.col("p"), 2).alias("mean_predicted"), half_up(F.col("a"), 2).alias("mean_actual"), half_up(F.col("r"), 4).alias("ratio"), half_up(F.max("r").over(one) / F.min("r").over(one), 4).alias("disparity"))


@dataclass(frozen=True)
class Moments:
    """Count, means and centred products of features and target: all that a linear fit needs of any number of rows."""

    features: tuple[str, ...]
    n: int
    means: np.ndarray
    products: np.ndarray

    def only(self, features: list[str]) -> Moments:
        at = [self.features.index(f) for f in features] + [len(self.features)]
        return Moments(tuple(features), self.n, self.means[at], self.products[np.ix_(at, at)])

    def ridge(self, alpha: float) -> tuple[np.ndarray, float, np.ndarray]:
        """Coefficients on the features as they are, intercept and standard errors; the penalty is on standardised features."""
        k, s = len(self.features), self.products
        spread = np.sqrt(np.diag(s)[:k] / self.n)
        spread[spread == 0] = 1.0
        gram, moment = s[:k, :k] / np.outer(spread, spread), s[:k, k] / spread
        inverse = np.linalg.inv(gram + alpha * np.eye(k))
        beta = inverse @ moment
        residual = s[k, k] - 2 * beta @ moment + beta @ gram @ beta
        noise = residual / max(1, self.n - k - 1)
        se = np.sqrt(np.maximum(noise * np.diag(inverse @ gram @ inverse), 0.0))
        beta, se = beta / spread, se / spread
        return beta, float(self.means[k] - beta @ self.means[:k]), se


def moments(df: DataFrame, features: list[str] = FEATURES, target: str = "future_cost") -> Moments:
    """One pass: sums of values and of products, as exact decimals, so that no order of rows changes a fit; one row comes back."""
    exact = [F.col(c).cast("decimal(16,4)") for c in (*features, target)]
    m = len(exact)
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    row = df.agg(F.count("*"), *[F.sum(x) for x in exact], *[F.sum((exact[i] * exact[j]).cast("decimal(38,8)")) for i, j in pairs]).first()
    n, sums, products = row[0], row[1 : m + 1], np.zeros((m, m))
    for (i, j), p in zip(pairs, row[m + 1 :]):
        # The difference is taken before anything is rounded.
        products[i, j] = products[j, i] = float(Fraction(p) - Fraction(sums[i]) * Fraction(sums[j]) / n) if n else 0.0
    return Moments(tuple(features), n, np.array([float(Fraction(s) / n) if n else 0.0 for s in sums]), products)


def linear(features: list[str], beta: np.ndarray, intercept: float) -> Column:
    return sum((F.col(f).cast("double") * float(b) for f, b in zip(features, beta)), F.lit(float(intercept)))


def ridge(train: DataFrame, test: DataFrame, features: list[str] = FEATURES, alpha: float = 1.0, target: str = "future_cost") -> DataFrame:
    """``test`` with predictions of a ridge fit on ``train``, with penalty alpha on the summed squares of the standardised features."""
    beta, intercept, _ = moments(train, features, target).ridge(alpha)
    return test.withColumn("predicted", linear(features, beta, intercept))


def ridge_frame(train: DataFrame, features: list[str] = FEATURES, alpha: float = 1.0, target: str = "future_cost") -> DataFrame:
    """(feature, beta, se) of the fit, the intercept as a feature of its own."""
    beta, intercept, se = moments(train, features, target).ridge(alpha)
    rows = [(f, float(b), float(e)) for f, b, e in zip(features, beta, se)] + [("intercept", intercept, None)]
    return train.sparkSession.createDataFrame(rows, "feature string, beta double, se double")


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="x").transform(df.withColumns({c: F.col(c).cast("double") for c in features}))


def boosted(train: DataFrame, test: DataFrame, features: list[str] = FEATURES, target: str = "future_cost", rounds: int = 200) -> DataFrame:
    """``test`` with predictions of boosted trees: ML's histogram trees, residuals checkpointed every ten rounds."""
    from pyspark.ml.regression import GBTRegressor

    # Rounds read the features alone, so those are written once and held while they last.
    rows = cut(_assembled(train, features).select("x", F.col(target).cast("double").alias(target))).persist()
    try:
        fit = GBTRegressor(featuresCol="x", labelCol=target, predictionCol="predicted", maxIter=rounds, maxDepth=3, stepSize=0.05, seed=1509, checkpointInterval=10).fit(rows)
    finally:
        rows.unpersist()
    return fit.transform(_assembled(test, features)).drop("x")


def proxy_cost(train: DataFrame, test: DataFrame, proxy: str = "zip_deprivation_index", alpha: float = 1.0, target: str = "future_cost") -> DataFrame:
    """R2 with and without a feature that has no effect of its own: both fits from one pass over ``train``, both errors from one over ``test``."""
    every = moments(train, FEATURES, target)
    rest = [f for f in FEATURES if f != proxy]
    off = [F.pow(F.col(target) - linear(fs, *m.ridge(alpha)[:2]), 2) for fs, m in ((FEATURES, every), (rest, every.only(rest)))]
    whole = F.var_pop(target) * F.count(target)
    out = test.agg(*[F.round(1 - F.sum(x) / whole, 4).alias(c) for x, c in zip(off, ("r2_with", "r2_without"))])
    return out.withColumn("change", F.round(F.col("r2_without") - F.col("r2_with"), 4))
