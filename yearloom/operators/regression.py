"""Regression of scores on settings, and tables for their plots."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import stars
from .counts import complete_rows
from .series import t_tail


def design_terms(predictors: list[str], interactions: list[tuple[str, str]] = ()) -> list[str]:
    return ["intercept", *predictors, *(f"{a}:{b}" for a, b in interactions)]


def ols(df: DataFrame, outcome: str, predictors: list[str], interactions: list[tuple[str, str]] = ()) -> DataFrame:
    """term, coef, se, t, p, low, high, stars. Sums of products are aggregated; only that small matrix reaches the driver."""
    rows = complete_rows(df, outcome, *predictors)
    terms = design_terms(predictors, interactions)
    x = [F.lit(1.0), *(F.col(p).cast("double") for p in predictors), *(F.col(a).cast("double") * F.col(b).cast("double") for a, b in interactions)]
    y = F.col(outcome).cast("double")
    k = len(x)
    sums = rows.agg(*[F.sum(x[i] * x[j]).alias(f"x{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum(x[i] * y).alias(f"y{i}") for i in range(k)], F.sum(y * y).alias("yy"), F.count("*").alias("n")).first()
    xx = np.array([[sums[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    xy = np.array([sums[f"y{i}"] for i in range(k)], float)
    return _summary(df, terms, xx, xy, float(sums["yy"]), int(sums["n"]))


def _summary(df: DataFrame, terms: list[str], xx: np.ndarray, xy: np.ndarray, yy: float, n: int, scale: float | None = None) -> DataFrame:
    inv = np.linalg.pinv(xx)
    b = inv @ xy
    free = max(n - len(terms), 1)
    s2 = max(yy - float(b @ xy), 0) / free if scale is None else scale
    se = np.sqrt(np.maximum(np.diag(inv) * s2, 0))
    t = np.divide(b, se, out=np.zeros_like(b), where=se > 0)
    q = _quantile(free)
    out = pd.DataFrame({"term": terms, "coef": b, "se": se, "t": t, "p": [t_tail(x, free) for x in t], "low": b - q * se, "high": b + q * se})
    return df.sparkSession.createDataFrame(out).withColumn("stars", stars(F.col("p")))


def _quantile(free: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_tail(mid, free) > 0.05 else (lo, mid)
    return lo


def mixed(df: DataFrame, outcome: str, predictors: list[str], group: str) -> DataFrame:
    """As ols, with a random intercept by group, by restricted maximum likelihood; ols where the groups don't vary or are fewer than two.

    Each group's sums of products are one row of a few numbers: one row a group reaches the driver, and groups
    are years.
    """
    rows = complete_rows(df, outcome, group, *predictors)
    terms = design_terms(predictors)
    x = [F.lit(1.0), *(F.col(p).cast("double") for p in predictors)]
    y, k = F.col(outcome).cast("double"), len(predictors) + 1
    sums = rows.groupBy(group).agg(*[F.sum(x[i] * x[j]).alias(f"x{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum(x[i] * y).alias(f"y{i}") for i in range(k)], F.sum(y).alias("sy"), F.sum(y * y).alias("yy"), F.count("*").alias("n")).toPandas()
    if len(sums) < 2:
        return ols(df, outcome, predictors)
    n = sums["n"].to_numpy(float)
    xx = np.array([[[r[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)] for _, r in sums.iterrows()], float)
    xy = np.array([[r[f"y{i}"] for i in range(k)] for _, r in sums.iterrows()], float)
    sx, sy, yy, total = xx[:, 0, :], sums["sy"].to_numpy(float), sums["yy"].to_numpy(float), n.sum()

    def at(ratio: float) -> tuple[float, np.ndarray, np.ndarray, float]:
        w = ratio / (1 + ratio * n)
        a = xx.sum(axis=0) - np.einsum("g,gi,gj->ij", w, sx, sx)
        c = xy.sum(axis=0) - (w * sy) @ sx
        q = yy.sum() - (w * sy * sy).sum()
        b = np.linalg.pinv(a) @ c
        s2 = max((q - b @ c) / (total - k), 1e-300)
        return (total - k) * np.log(s2) + np.log1p(ratio * n).sum() + np.linalg.slogdet(a)[1], a, c, s2

    steps = np.concatenate([[0.0], np.exp(np.linspace(-12, 8, 400))])
    best = int(np.argmin([at(r)[0] for r in steps]))
    if best == 0:
        return ols(df, outcome, predictors)
    lo, hi = np.log(steps[max(best - 1, 1)]), np.log(steps[min(best + 1, len(steps) - 1)])
    for _ in range(80):
        a, b = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
        lo, hi = (lo, b) if at(np.exp(a))[0] < at(np.exp(b))[0] else (a, hi)
    _, a, c, s2 = at(float(np.exp((lo + hi) / 2)))
    return _summary(df, terms, a, c, 0.0, int(total), s2)


def means(df: DataFrame, metric: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(metric).alias("mean"), F.count(metric).alias("n"))


def mesh(df: DataFrame, metric: str, x: str, y: str, xs: list, fill: float | None = 0.0) -> DataFrame:
    """Means of metric, a row each y and a column each x; what is absent gets fill, or stays null."""
    out = df.groupBy(y).pivot(x, xs).agg(F.avg(metric))
    return out if fill is None else out.fillna(fill)
