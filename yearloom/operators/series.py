"""Series over years: windows, smoothing, trends, correlation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(keys: list[str], order: str = "year"):
    return Window.partitionBy(*keys).orderBy(order)


def rolling_mean(df: DataFrame, value: str, window: int, keys: list[str], out: str = "smooth") -> DataFrame:
    """Centred mean of window rows, as many as there are at the ends; nulls don't count. An even window leans back."""
    return df.withColumn(out, F.avg(value).over(_w(keys).rowsBetween(-(window // 2), (window - 1) // 2)))


def interpolated(df: DataFrame, value: str, keys: list[str], out: str = "filled") -> DataFrame:
    """Nulls on a straight line between their known neighbours by year; flat beyond the first and last."""
    back, ahead = _w(keys).rowsBetween(Window.unboundedPreceding, 0), _w(keys).rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col("year"))
    v0, y0 = F.last(value, True).over(back), F.last(at, True).over(back)
    v1, y1 = F.first(value, True).over(ahead), F.first(at, True).over(ahead)
    between = v0 + (v1 - v0) * (F.col("year") - y0) / F.nullif(y1 - y0, F.lit(0))
    return df.withColumn(out, F.coalesce(F.col(value), between, v0, v1))


def chunk_means(df: DataFrame, value: str, size: int, keys: list[str]) -> DataFrame:
    """Mean year and value of every size rows by year; nulls don't count."""
    c = F.floor((F.row_number().over(_w(keys)) - 1) / size).alias("chunk")
    return df.select(*keys, "year", value, c).groupBy(*keys, "chunk").agg(F.avg("year").alias("year"), F.avg(value).alias(value))


def mean_filled(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    return df.withColumn(value, F.coalesce(F.col(value), F.avg(value).over(Window.partitionBy(*keys))))


def gaussian(df: DataFrame, value: str, sigma: float, keys: list[str], out: str = "smooth") -> DataFrame:
    """Gaussian weights cut at four deviations, rows reflected at both ends. Series are of years: a window, not a shuffle by row."""
    radius = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    w /= w.sum()
    whole = Window.partitionBy(*keys).orderBy("year").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s, n, i = F.col("_s"), F.size("_s"), F.col("_i")

    def at(offset: int) -> Column:
        k = F.pmod(i + offset, 2 * n)
        return F.element_at(s, F.when(k < n, k + 1).otherwise(2 * n - k).cast("int"))

    smooth = sum((F.lit(float(x)) * at(o - radius) for o, x in enumerate(w)), F.lit(0.0))
    return df.withColumn("_s", F.collect_list(F.col(value).cast("double")).over(whole)).withColumn("_i", F.row_number().over(_w(keys)) - 1).withColumn(out, smooth).drop("_s", "_i")


def savgol_weights(window: int, degree: int, derivative: int = 1) -> np.ndarray:
    half = window // 2
    design = np.vander(np.arange(-half, half + 1.0), degree + 1, increasing=True)
    return np.linalg.pinv(design)[derivative] * math.factorial(derivative)


def derivative(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """keys, year, rate: first derivative by local cubics over at most 11 rows, with the end windows' polynomials at the ends."""

    def rate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("year")
        x, y = pdf["year"].to_numpy(float), pdf[value].to_numpy(float)
        n = len(x)
        window = min(11, n if n % 2 else n - 1)
        degree = min(3, window - 1)
        if window < 3:
            out = np.full(n, np.nan) if n < 2 else np.gradient(y, x)
        else:
            delta, half = float(np.diff(x).mean()), window // 2
            out = np.empty(n)
            w = savgol_weights(window, degree)
            for i in range(half, n - half):
                out[i] = w @ y[i - half : i + half + 1]
            grid = np.arange(-half, half + 1.0)
            for lo, rows in ((0, range(half)), (n - window, range(n - half, n))):
                d = np.polyder(np.polyfit(grid, y[lo : lo + window], degree))
                for i in rows:
                    out[i] = np.polyval(d, i - lo - half)
            out /= delta
        return pd.DataFrame({**{k: pdf[k] for k in keys}, "year": pdf["year"], "rate": out})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys, "year").schema) + ", rate double"
    return df.select(*keys, "year", value).groupBy(*keys).applyInPandas(rate, schema)


def trends(df: DataFrame, value: str, keys: list[str], least: int = 2) -> DataFrame:
    """keys, n, mu, sigma, slope, intercept, r of value on year; statistics are null with fewer than least rows."""
    y, x = F.col(value), F.col("year")
    n = F.count(value)
    few = lambda c: F.when(n >= least, c)
    return df.groupBy(*keys).agg(
        n.alias("n"), few(F.avg(y)).alias("mu"), few(F.stddev_samp(y)).alias("sigma"), few(F.regr_slope(y, x)).alias("slope"), few(F.regr_intercept(y, x)).alias("intercept"), few(F.corr(y, x)).alias("r")
    )


def t_tail(t: float, df: float) -> float:
    """Two-sided p of Student's t: the regularised incomplete beta function by its continued fraction."""
    if df <= 0 or t != t:
        return float("nan")
    if math.isinf(t):
        return 0.0
    x, a, b = df / (df + t * t), df / 2, 0.5

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + num * d or 1e-300)
                c = 1 + num / c or 1e-300
                h *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def trend_tests(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """trends with stderr and p of the slope."""
    base = trends(df, value, keys)
    r2 = F.col("r") * F.col("r")
    sxx = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.var_pop("year").alias("_vx"), F.var_pop(value).alias("_vy"))
    out = base.join(sxx, keys).withColumn("stderr", F.when(F.col("n") > 2, F.sqrt(F.greatest(F.lit(0.0), (1 - r2) * F.col("_vy") / F.col("_vx") / (F.col("n") - 2)))))

    @F.pandas_udf("double")
    def p(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else t_tail(float(a), float(b) - 2) for a, b in zip(t, n)])

    return out.withColumn("p", p(F.col("slope") / F.nullif(F.col("stderr"), F.lit(0.0)), F.col("n"))).drop("_vx", "_vy")


def residuals(df: DataFrame, value: str, covariate: str, out: str = "residual") -> DataFrame:
    """Rows where both are known, with what a straight line on the covariate leaves of value."""
    both = df.dropna(subset=[value, covariate])
    line = both.agg(F.regr_slope(value, covariate).alias("_b"), F.regr_intercept(value, covariate).alias("_a"))
    return both.crossJoin(F.broadcast(line)).withColumn(out, F.col(value) - (F.col("_a") + F.col("_b") * F.col(covariate))).drop("_a", "_b")


def pair_correlations(df: DataFrame, value: str, key: str = "word", at: str = "year") -> DataFrame:
    """a, b, r for a < b: correlation of two series over their common years. The series joined are a chosen, short list."""
    x, y = df.select(F.col(key).alias("a"), at, F.col(value).alias("x")), df.select(F.col(key).alias("b"), at, F.col(value).alias("y"))
    return x.join(y, at).where("a < b").groupBy("a", "b").agg(F.corr("x", "y").alias("r")).where(F.col("r").isNotNull())


def correlation_summary(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.avg("r").alias("mean"), F.median("r").alias("median"), F.stddev_pop("r").alias("std"), F.min("r").alias("min"), F.max("r").alias("max"), F.count("r").alias("pairs"))


def dense_years(spark, df: DataFrame, first: int, last: int, step: int = 1) -> DataFrame:
    """Every step-th year with the row of df, if it has one."""
    return spark.range(first, last + 1, step).select(F.col("id").cast("int").alias("year")).join(df, "year", "left")


def end_changes(df: DataFrame, value: str, key: str, n: int) -> DataFrame:
    """The n keys that rose and fell most between the first and last year of the table."""
    ends = df.agg(F.min("year").alias("_lo"), F.max("year").alias("_hi"))
    c = df.crossJoin(F.broadcast(ends)).groupBy(key).agg((F.max(F.when(F.col("year") == F.col("_hi"), F.col(value))) - F.max(F.when(F.col("year") == F.col("_lo"), F.col(value)))).alias("change")).where("change is not null")
    up, down = c.orderBy(F.col("change").desc(), key).limit(n), c.orderBy("change", key).limit(n)
    return up.withColumn("side", F.lit("rise")).unionByName(down.withColumn("side", F.lit("fall")))


def imputed_band(df: DataFrame, deviation: str, z: float = 1.96, out: str = "band") -> DataFrame:
    """z times the deviation; null and zero deviations are replaced by the mean of the others, or 0."""
    own = F.nullif(F.col(deviation), F.lit(0.0))
    return df.withColumn(out, F.lit(z) * F.coalesce(own, F.avg(own).over(Window.partitionBy()), F.lit(0.0)))
