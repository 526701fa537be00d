"""Regression: baselines, least squares, ridge, trees and ensembles, blending, errors, learning curves."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import scalar as S
from lodestone.operators.binned import Boosting, Forest


def line(df: DataFrame, y: str, x: str) -> DataFrame:
    """One row: slope, intercept and R2 of y on x."""
    return df.agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 6).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"))


def ridge(df: DataFrame, label: str, alpha: float = 1.0) -> LinearRegression:
    """Ridge with an unpenalised intercept, as the closed form has it: the solver scales its penalty by deviation and count."""
    s = df.agg(F.stddev_pop(label).alias("s"), F.count(F.lit(1)).alias("n")).first()
    return LinearRegression(labelCol=label, solver="normal", elasticNetParam=0.0, standardization=False, regParam=alpha * (s.s or 0.0) / max(1, s.n))


def models(df: DataFrame, label: str = "label") -> dict:
    """The models by name, with the parameters of the survey."""
    return {
        "ols": LinearRegression(labelCol=label, solver="normal", regParam=0.0),
        "ridge": ridge(df, label),
        "tree": DecisionTreeRegressor(labelCol=label, maxDepth=8, minInstancesPerNode=10),
        "random_forest": RandomForestRegressor(labelCol=label, numTrees=200, maxDepth=14, minInstancesPerNode=3, seed=42),
        "gbt": boosting(label),
    }


def sized(df: DataFrame, key: str, rows: int = 50_000) -> DataFrame:
    """df in partitions of about `rows` rows: each round of boosting runs some jobs, and a small table would pay for empty tasks in all of them."""
    return df.repartition(max(1, -(-df.count() // rows)), key)


def boosting(label: str = "label", rounds: int = 300, share: float = 1.0, key: str | None = None) -> Boosting:
    """Gradient boosting with trees of depth 4 at a rate of 0.05. key: the rows' id, by which a share of them is drawn for each round."""
    return Boosting(rounds, 0.05, 4, share, label=label, key=key)


def blend_models(label: str = "label", key: str | None = None) -> dict:
    """The two models that are blended."""
    return {"random_forest": Forest(200, 12, 4, label=label, key=key), "gbt": boosting(label, 400, 0.9, key)}


def metrics(df: DataFrame, actual: str, predicted: str, *by: str) -> DataFrame:
    """n, means, MAE, RMSE, R2 and MAPE % (denominator at least 1e-9), for all rows or by group, in one pass."""
    y, p = F.col(actual), F.col(predicted)
    e = y - p
    own = df.groupBy(*by) if by else df.groupBy()
    return own.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(y), 6).alias("mean_actual"), F.round(F.avg(p), 6).alias("mean_predicted"), F.round(F.avg(F.abs(e)), 6).alias("mae"),
        F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), (F.round(1 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count(F.lit(1)), F.lit(0.0)), 6) + F.lit(0.0)).alias("r2"),
        F.round(100 * F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(1e-9))), 2).alias("mape"),
    )


def residuals(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.withColumn("residual", F.col(actual) - F.col(predicted))


def blend(df: DataFrame, a: str, b: str, actual: str, steps: int = 50) -> DataFrame:
    """(weight, sse): the weight of a against b on the grid with the least squared error, the lowest of ties.

    The error is a quadratic in the weight, so three sums over the rows give it
    for the whole grid: rows are not multiplied by grid points.
    """
    d, e = F.col(a) - F.col(b), F.col(actual) - F.col(b)
    sums = df.agg(F.sum(d * d).alias("dd"), F.sum(d * e).alias("de"), F.sum(e * e).alias("ee"))
    grid = sums.select(F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("i"), "dd", "de", "ee").withColumn("weight", F.round(F.col("i") / steps, 6))
    w = F.col("weight")
    grid = grid.withColumn("sse", F.round(F.col("ee") - 2 * w * F.col("de") + w * w * F.col("dd"), 6))
    return grid.orderBy("sse", "weight").select("weight", "sse").limit(1)


def interval(p: Column, sigma: float | Column) -> dict[str, Column]:
    """The clipped prediction, its tier and the 95 % interval."""
    s = F.lit(sigma) if isinstance(sigma, float) else sigma
    q = S.clip(p, 1.0, 10.0)
    return {"score": F.round(q, 4), "tier": S.tier(q), "low": F.round(S.clip(q - 1.96 * s, 1.0, 10.0), 4), "high": F.round(S.clip(q + 1.96 * s, 1.0, 10.0), 4)}


def ranked(importances: DataFrame) -> DataFrame:
    """(name, importance) with rank and cumulative share; ties by name. One row per feature: small."""
    w = Window.orderBy(F.desc("importance"), "name")
    total = F.sum("importance").over(Window.partitionBy())
    return importances.select("name", "importance", F.row_number().over(w).alias("rank"), F.round(F.sum("importance").over(w.rowsBetween(Window.unboundedPreceding, 0)) / total, 6).alias("cumulative"))


def prefixes(df: DataFrame, key: str, sizes: Sequence[int]) -> DataFrame:
    """df with `first`: the index of the first of the ascending sizes whose rows, in hash order, have the row; rows beyond the last are left out.

    Counts by the hash's first digits tell in which range of hashes a prefix
    ends. Only the rows of such ranges are ranked: no task sorts all rows.
    """
    h = F.coalesce(S.seeded(key), F.lit(""))  # a null key comes first
    names = df.columns
    own = df.withColumns({"__h": h, "__range": F.substring(h, 1, 3)})
    starts, total = [], 0
    for r in sorted(own.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect()):  # up to 4,097
        starts.append((total, total + r.n, r[0]))
        total += r.n
    ends = []  # the range in which each prefix ends, and how many of its rows it has; None: all rows
    for n in sizes:
        ends.append(next(((r, n - low) for low, high, r in starts if n <= high), None) if n < total else None)
    cut = F.col("__range").isin([e[0] for e in ends if e])
    over = Window.partitionBy("__range").orderBy("__h", key)
    ranked = own.where(cut).repartition(max(1, len(sizes)), "__range").withColumn("__place", F.row_number().over(over))
    both = own.where(~cut).withColumn("__place", F.lit(0)).unionByName(ranked)
    beyond = [((F.col("__range") > e[0]) | ((F.col("__range") == e[0]) & (F.col("__place") > e[1]))).cast("int") for e in ends if e]
    out = both.withColumn("first", sum(beyond, F.lit(0))).select(*names, "first")
    return out.where(F.col("first") < len(sizes)) if all(ends) else out


def curve_sizes(n: int) -> list[int]:
    """1,000 of n rows and on, in steps of a tenth of all, at least 1,000; and all rows."""
    return sorted({*range(1000, n + 1, max(1000, n // 10)), n} - {0})


def learning_curve(train: DataFrame, test: DataFrame, model, key: str, sizes: Sequence[int], label: str = "label") -> list[dict]:
    """RMSE on train and test of the model fitted on growing prefixes in hash order. Boosting on whole prefixes is fitted for all sizes at once."""
    sizes = sorted(set(sizes))
    own = prefixes(train, key, sizes).persist()
    if isinstance(model, Boosting) and model.share >= 1 and model.label == label:
        found = model.curve(own, test, len(sizes))
    else:
        found = []
        for i in range(len(sizes)):
            part = own.where(F.col("first") <= i)
            fitted = model.fit(part)
            found.append([metrics(fitted.transform(d), label, "prediction").first().rmse for d in (part, test)])
    own.unpersist()
    return [{"n": n, **{f"rmse_{k}": v if v is None else round(v, 6) for k, v in zip(("train", "test"), pair, strict=True)}} for n, pair in zip(sizes, found, strict=True)]


def cross_validated_rmse(df: DataFrame, model, k: int = 5, fold: str = "fold", label: str = "label") -> float:
    """The mean of the folds' RMSEs."""
    total = 0.0
    for i in range(k):
        scored = model.fit(df.where(F.col(fold) != i)).transform(df.where(F.col(fold) == i))
        total += metrics(scored, label, "prediction").first().rmse or 0.0
    return total / k


def compare(train: DataFrame, test: DataFrame, which: dict, label: str = "label", k: int = 0, fold: str = "fold") -> list[dict]:
    """Metrics of each model on test, with k the cross-validated RMSE on train; the best first."""
    out = []
    for name, m in which.items():
        row = {"model": name, **metrics(m.fit(train).transform(test), label, "prediction").first().asDict()}
        if k:
            row["cv_rmse"] = round(cross_validated_rmse(train, m, k, fold, label), 6)
        out.append(row)
    return sorted(out, key=lambda r: (r["rmse"], r["model"]))


def importances(model, features: Sequence[str]) -> list[tuple[str, float]]:
    """(name, importance) of a fitted tree or forest's features."""
    return [(f, round(float(v), 6)) for f, v in zip(features, model.featureImportances.toArray(), strict=True)]


@dataclass
class Blend:
    """A forest and boosted trees, weighted by their error on a validation part and fitted again on all training rows."""

    forest: object
    gbt: object
    weight: float
    sigma: float
    r2_full: float
    table: list[dict]

    @classmethod
    def fit(cls, fit: DataFrame, validation: DataFrame, test: DataFrame, key: str, label: str = "label", which: dict | None = None) -> "Blend":
        """sigma: the RMSE on test; r2_full: R2 on all rows, those of the training too; table: metrics on test and validation."""
        which = which or blend_models(label, key)
        first = {n: m.fit(fit) for n, m in which.items()}
        on_validation = cls._both(first["random_forest"], first["gbt"], validation, key, label)
        weight = blend(on_validation, "pa", "pb", label).first().weight
        train = fit.unionByName(validation)
        forest, gbt = (which[n].fit(train) for n in ("random_forest", "gbt"))
        own = cls(forest, gbt, weight, 0.0, 0.0, [])
        on_test = own.predict(test, key, label)
        for part, df in (("test", on_test), ("validation", on_validation.withColumn("prediction", own._mix()))):
            for name, column in (("blend", "prediction"), ("random_forest", "pa"), ("gbt", "pb")):
                if part == "test" or name == "blend":
                    own.table.append({"split": part, "model": name, **metrics(df, label, column).first().asDict()})
        own.table.sort(key=lambda r: (r["split"], r["rmse"], r["model"]))
        own.sigma = next(r["rmse"] for r in own.table if r["split"] == "test" and r["model"] == "blend")
        own.r2_full = metrics(own.predict(train.unionByName(test), key, label), label, "prediction").first().r2
        return own

    @staticmethod
    def _both(forest, gbt, on: DataFrame, key: str, label: str) -> DataFrame:
        scored = forest.transform(on).withColumnRenamed("prediction", "pa")
        return gbt.transform(scored).select(key, label, "pa", F.col("prediction").alias("pb"))

    def _mix(self) -> Column:
        return F.lit(self.weight) * F.col("pa") + F.lit(1 - self.weight) * F.col("pb")

    def predict(self, df: DataFrame, key: str, label: str = "label") -> DataFrame:
        """(key, label, pa, pb, prediction) with the interval of `interval` beside it."""
        own = self._both(self.forest, self.gbt, df, key, label).withColumn("prediction", self._mix())
        return own.withColumns(interval(F.col("prediction"), float(self.sigma)))
