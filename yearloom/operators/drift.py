"""Semantic change over years."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import half_width
from ..functions.vectors import cosine, dot, minus, norm
from .series import residuals
from .vectors import mean_cosine_to_all, mean_dimension, mean_vectors, pca_dimensions, previous_model, principal, project, restrict, similarity, weat, weat_permutations, word_pairs


def local_change(vectors: DataFrame, word: str | None = None, confidence: float | None = None, covariate: DataFrame | None = None) -> DataFrame:
    """year, change, error, shared: 1 less the mean dot product with the model before; with a covariate (year, value) also the residual."""
    v = vectors if word is None else vectors.where(F.col("word") == word)
    s = similarity(_with_previous(v, vectors), "vector", "before", "year")
    out = s.select("year", (1 - F.col("mean")).alias("change"), half_width(F.col("std"), F.col("n"), confidence).alias("error"), F.col("n").alias("shared"))
    return out if covariate is None else residuals(out.join(covariate.select("year", F.col("value").alias("covariate")), "year", "left"), "change", "covariate")


def _with_previous(v: DataFrame, all_models: DataFrame) -> DataFrame:
    years = all_models.select("year").distinct()
    before = years.withColumn("prev", F.lag("year").over(Window.orderBy("year"))).where("prev is not null")
    b = v.select(F.col("year").alias("prev"), "word", F.col("vector").alias("before"))
    return v.join(F.broadcast(before), "year").join(b, ["prev", "word"])


def global_change(vectors: DataFrame, reference: int, confidence: float | None = None) -> DataFrame:
    """year, change, error, shared against the reference year, whose own row is 0, 0 and its vocabulary."""
    r = vectors.where(F.col("year") == reference).select("word", F.col("vector").alias("ref"))
    s = similarity(vectors.join(r, "word"), "vector", "ref", "year")
    here = F.col("year") == reference
    return s.select("year", F.when(here, 0.0).otherwise(1 - F.col("mean")).alias("change"), F.when(here, 0.0).otherwise(half_width(F.col("std"), F.col("n"), confidence)).alias("error"), F.col("n").alias("shared"))


def directional_drift(vectors: DataFrame, word: str | None = None) -> DataFrame:
    """year, magnitude, consistency: length of the change to the next year, and its cosine with the change before.

    A word is followed over the years that have it; without a word, the mean change vector and mean length over
    the words that both models share.
    """
    if word is not None:
        w = Window.orderBy("year")
        v = vectors.where(F.col("word") == word).select("year", "vector", F.lead("vector").over(w).alias("next")).where("next is not null")
        c = v.select("year", minus(F.col("next"), F.col("vector")).alias("d")).withColumn("magnitude", norm(F.col("d")))
    else:
        p = previous_model(vectors).select(F.col("prev").alias("year"), minus(F.col("vector"), F.col("before")).alias("vector"))
        c = mean_vectors(p, "year").withColumnRenamed("vector", "d").join(p.groupBy("year").agg(F.avg(norm(F.col("vector"))).alias("magnitude")), "year")
    before = F.lag("d").over(Window.orderBy("year"))
    c = c.withColumn("before", before)
    return c.select("year", "magnitude", F.when((norm(F.col("d")) > 0) & (norm(F.col("before")) > 0), cosine(F.col("d"), F.col("before"))).alias("consistency"))


def similarity_over_years(vectors: DataFrame, first: list[str], second: list[str]) -> DataFrame:
    """year, mean cosine of all pairs that the model has; years without a pair drop out."""
    return word_pairs(vectors, first, second).groupBy("year").agg(F.avg("cos").alias("mean_cos"), F.count("*").alias("pairs"))


def relatedness(vectors: DataFrame, words: list[str], excluded: list[str] = ()) -> DataFrame:
    """year, mean over the words present of their mean cosine to all others."""
    return mean_cosine_to_all(vectors, words, excluded).groupBy("year").agg(F.avg("mean_cos").alias("relatedness"), F.count("*").alias("words"))


def weat_over_years(vectors: DataFrame, t1: list[str], t2: list[str], a1: list[str], a2: list[str], permutations: int = 0, seed: int = 0, combined: dict[str, list[str]] | None = None) -> DataFrame:
    """weat by year, with p and std of permutations, and means of the listed associations under the names given."""
    out = weat(vectors, t1, t2, a1, a2)
    if permutations:
        out = out.join(weat_permutations(vectors, t1, t2, a1, a2, permutations, seed), "year", "left")
    for name, parts in (combined or {}).items():
        out = out.withColumn(name, sum((F.col(p) for p in parts), F.lit(0.0)) / len(parts))
    return out


def projections(vectors: DataFrame, pairs: DataFrame, words: list[str] | None = None, method: str = "mean", baseline: DataFrame | None = None, baseline_words: list[str] | None = None, agg: str = "median") -> DataFrame:
    """year, word, projection on each year's dimension, less a baseline: given (year, baseline; missing is 0), or of given words, not both."""
    if baseline is not None and baseline_words:
        raise ValueError("give a baseline or words for one")
    d = mean_dimension(vectors, pairs) if method == "mean" else pca_dimensions(vectors, pairs)
    v = vectors if words is None else vectors.where(F.col("word").isin([*words, *(baseline_words or [])]))
    p = project(v, d)
    if baseline_words:
        baseline = baseline_of(p.where(F.col("word").isin(baseline_words)), agg)
    if words is not None:
        p = p.where(F.col("word").isin(words))
    if baseline is None:
        return p
    return p.join(baseline.select("year", "baseline"), "year", "left").select("year", "word", (F.col("projection") - F.coalesce("baseline", F.lit(0.0))).alias("projection"))


def baseline_of(p: DataFrame, agg: str = "median") -> DataFrame:
    if agg not in ("median", "mean"):
        raise ValueError("median or mean")
    return p.groupBy("year").agg((F.median("projection") if agg == "median" else F.avg("projection")).alias("baseline"))


def neutral_words(p: DataFrame, pairs: DataFrame, mean: float, trend: float, sigma: float, least: int, exclude: str | None = None) -> DataFrame:
    """word, mu, beta, sigma, n of words outside the pairs (and a pattern, case ignored) whose projections are small, flat and steady."""
    anchors = pairs.select(F.col("token1").alias("word")).union(pairs.select("token2")).distinct()
    c = p.join(F.broadcast(anchors), "word", "left_anti")
    if exclude:
        c = c.where(~F.col("word").rlike("(?i)" + exclude))
    n = F.count("projection")
    s = c.groupBy("word").agg(n.alias("n"), F.when(n >= 5, F.avg("projection")).alias("mu"), F.when(n >= 5, F.regr_slope("projection", "year")).alias("beta"), F.when(n >= 5, F.stddev_samp("projection")).alias("sigma"))
    return s.where((F.col("n") >= least) & (F.abs("mu") < mean) & (F.abs("beta") < trend) & (F.col("sigma") < sigma))


def correlation_test(p: DataFrame, permutations: int = 200, seed: int = 0) -> DataFrame:
    """observed, null_mean, null_std, p of the mean correlation between words, against years shuffled within each word.

    The words are a chosen, short list; every permutation is a task's group.
    """
    runs = p.select("year", "word", "projection", F.explode(F.sequence(F.lit(0), F.lit(permutations))).alias("run"))

    def one(pdf):
        import pandas as pd

        m = pdf.pivot_table(index="year", columns="word", values="projection").sort_index()
        x, run = m.to_numpy(), int(pdf["run"].iloc[0])
        if run:
            rng = np.random.default_rng([seed, run])
            x = np.stack([rng.permutation(x[:, j]) for j in range(x.shape[1])], axis=1)
        r = np.corrcoef(x.T)
        return pd.DataFrame({"run": [run], "r": [float(np.nanmean(r[np.triu_indices(len(r), 1)])) if x.shape[1] > 1 else None]})

    r = runs.groupBy("run").applyInPandas(one, "run int, r double")
    o = r.where("run = 0").select(F.col("r").alias("observed"))
    return r.where("run > 0").crossJoin(F.broadcast(o)).agg(F.first("observed").alias("observed"), F.avg("r").alias("null_mean"), F.stddev_pop("r").alias("null_std"), F.avg((F.abs("r") >= F.abs("observed")).cast("double")).alias("p"))


def reference_dimension(vectors: DataFrame, pairs: DataFrame, reference: int) -> DataFrame:
    """year, word, projection of the reference year's vocabulary, in every year, on the reference year's first principal axis."""
    r = vectors.where(F.col("year") == reference)
    d = pca_dimensions(r, pairs).select("dimension")
    v = restrict(vectors, r).crossJoin(F.broadcast(d))
    return v.select("year", "word", (dot(F.col("vector"), F.col("dimension")) / (norm(F.col("vector")) * norm(F.col("dimension")) + 1e-10)).alias("projection"))


def yearly_stats(p: DataFrame) -> DataFrame:
    return p.groupBy("year").agg(F.avg("projection").alias("mean"), F.stddev_pop("projection").alias("std"), F.count("projection").alias("n"))


def words_by_year(p: DataFrame, years: list[int], value: str = "projection") -> DataFrame:
    """One row a word, one column a year."""
    return p.groupBy("word").pivot("year", years).agg(F.first(value))


def trajectory(vectors: DataFrame, word: str, components: int = 2) -> DataFrame:
    """year, pc1, pc2[, ...] and the distance from first to last year: a word's path in its principal plane, pc1 rising with the years."""

    def path(pdf):
        import pandas as pd

        pdf = pdf.sort_values("year")
        x = np.stack([np.asarray(v, float) for v in pdf["vector"]])
        axes, _ = principal(x)
        k = min(components, len(axes))
        y = (x - x.mean(axis=0)) @ axes[:k].T
        if len(x) > 1 and np.corrcoef(y[:, 0], pdf["year"])[0, 1] < 0:
            y[:, 0] = -y[:, 0]
        out = {"year": pdf["year"].to_numpy()} | {f"pc{i + 1}": y[:, i] if i < k else np.zeros(len(x)) for i in range(components)}
        return pd.DataFrame(out | {"distance": float(np.linalg.norm(y[-1] - y[0]))})

    schema = "year int, " + ", ".join(f"pc{i + 1} double" for i in range(components)) + ", distance double"
    return vectors.where(F.col("word") == word).groupBy("word").applyInPandas(path, schema)
