"""Word vectors of many models in one table (year, word, vector[, count]): comparison, alignment, association, dimensions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import SPECIAL
from ..functions.vectors import cosine, dot, minus, norm, normalized
from ..sources.scratch import write_table


def normalize(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("vector", normalized(F.col("vector")))


def all_normal(vectors: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    return vectors.groupBy("year").agg(F.bool_and(F.abs(norm(F.col("vector")) - 1) <= tolerance).alias("normal"))


def restrict(vectors: DataFrame, words: DataFrame) -> DataFrame:
    return vectors.join(words.select("word").distinct(), "word", "left_semi")


def shared_words(vectors: DataFrame, special: bool = False) -> DataFrame:
    """Words that all models have; without special tokens unless asked for."""
    years = vectors.agg(F.countDistinct("year").alias("years"))
    own = vectors if special else vectors.where(~F.col("word").isin(*SPECIAL))
    return own.groupBy("word").agg(F.countDistinct("year").alias("n")).join(F.broadcast(years), F.col("n") == F.col("years")).select("word")


def mean_vectors(vectors: DataFrame, *keys: str) -> DataFrame:
    """Element-wise mean by keys, each partition's own first."""
    return vectors.groupBy(*keys).agg(Summarizer.mean(array_to_vector("vector")).alias("vector")).withColumn("vector", vector_to_array("vector"))


def previous_model(vectors: DataFrame) -> DataFrame:
    """Each word of a model with its vector in the model before, by the sorted years of all models; words that either lacks drop out."""
    years = vectors.select("year").distinct()
    before = years.withColumn("prev", F.lag("year").over(Window.orderBy("year"))).where("prev is not null")
    a = vectors.join(F.broadcast(before), "year")
    b = vectors.select(F.col("year").alias("prev"), "word", F.col("vector").alias("before"))
    return a.join(b, ["prev", "word"])


def similarity(pairs: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """Mean, population deviation and number of the dot products by keys."""
    d = dot(F.col(a), F.col(b))
    return pairs.select(*keys, d.alias("d")).groupBy(*keys).agg(F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"), F.count("*").alias("n"))


def word_pairs(vectors: DataFrame, first: list[str], second: list[str]) -> DataFrame:
    """year, a, b, cos for all pairs of two lists of words; a word isn't paired with itself. Lists are short: they are broadcast."""
    x = vectors.where(F.col("word").isin(first)).select("year", F.col("word").alias("a"), F.col("vector").alias("va"))
    y = vectors.where(F.col("word").isin(second)).select("year", F.col("word").alias("b"), F.col("vector").alias("vb"))
    return x.join(y, "year").where("a <> b").select("year", "a", "b", cosine(F.col("va"), F.col("vb")).alias("cos"))


def neighbours(vectors: DataFrame, word: str, k: int) -> DataFrame:
    """The k nearest words of word in each year."""
    own = vectors.where(F.col("word") == word).select("year", F.col("vector").alias("own"))
    c = vectors.where(F.col("word") != word).join(F.broadcast(own), "year").select("year", "word", cosine(F.col("vector"), F.col("own")).alias("cos"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("year").orderBy(F.col("cos").desc(), "word"))).where(F.col("rank") <= k)


def mean_cosine_to_all(vectors: DataFrame, words: list[str], excluded: list[str] = ()) -> DataFrame:
    """year, word, mean cosine to all other words but the excluded.

    The sum of the cosines is the product with the sum of unit vectors: linear in the vocabulary.
    """
    unit = vectors.select("year", "word", normalized(F.col("vector")).alias("vector"))
    pool = unit.where(~F.col("word").isin(list(excluded))) if excluded else unit
    sums = pool.groupBy("year").agg(Summarizer.sum(array_to_vector("vector")).alias("s"), F.count("*").alias("n")).withColumn("s", vector_to_array("s"))
    own = unit.where(F.col("word").isin(words)).join(F.broadcast(sums), "year")
    inside = F.lit(1) if not excluded else F.when(F.col("word").isin(list(excluded)), 0).otherwise(1)
    return own.select("year", "word", ((dot(F.col("vector"), F.col("s")) - inside * dot(F.col("vector"), F.col("vector"))) / F.nullif(F.col("n") - inside, F.lit(0))).alias("mean_cos"))


# association tests


def associations(vectors: DataFrame, targets: list[str], attributes: list[str]) -> DataFrame:
    """year, word, mean cosine of each target that a model has to the attributes that it has; 0 without any."""
    t = vectors.where(F.col("word").isin(targets)).select("year", "word", "vector")
    a = vectors.where(F.col("word").isin(attributes)).select("year", F.col("vector").alias("va"))
    c = t.join(F.broadcast(a), "year", "left").select("year", "word", cosine(F.col("vector"), F.col("va")).alias("c"))
    return c.groupBy("year", "word").agg(F.coalesce(F.avg("c"), F.lit(0.0)).alias("assoc"))


def association_differences(vectors: DataFrame, t1: list[str], t2: list[str], a1: list[str], a2: list[str]) -> DataFrame:
    """year, word, side (1, 2), x1, x2 (mean cosines to either attribute set), s = x1 - x2."""
    targets = [*t1, *t2]
    x = associations(vectors, targets, a1).withColumnRenamed("assoc", "x1").join(associations(vectors, targets, a2).withColumnRenamed("assoc", "x2"), ["year", "word"])
    return x.select("year", "word", F.when(F.col("word").isin(t1), 1).otherwise(2).alias("side"), "x1", "x2", (F.col("x1") - F.col("x2")).alias("s"))


def weat(vectors: DataFrame, t1: list[str], t2: list[str], a1: list[str], a2: list[str]) -> DataFrame:
    """year, effect, statistic, t1_a1, t1_a2, t2_a1, t2_a2; effect is null where all s are equal."""
    s = association_differences(vectors, t1, t2, a1, a2)
    of = lambda side, c: F.avg(F.when(F.col("side") == side, F.col(c)))
    total = lambda side: F.sum(F.when(F.col("side") == side, F.col("s")))
    sd = F.nullif(F.stddev_samp("s"), F.lit(0.0))
    return s.groupBy("year").agg(
        ((of(1, "s") - of(2, "s")) / sd).alias("effect"), (total(1) - total(2)).alias("statistic"), of(1, "x1").alias("t1_a1"), of(1, "x2").alias("t1_a2"), of(2, "x1").alias("t2_a1"), of(2, "x2").alias("t2_a2")
    )


def weat_permutations(vectors: DataFrame, t1: list[str], t2: list[str], a1: list[str], a2: list[str], permutations: int = 1000, seed: int = 0) -> DataFrame:
    """year, p, std of the statistic under random halves of the targets; s is computed once, order by a hash of word, number and seed."""
    s = association_differences(vectors, t1, t2, a1, a2)
    sizes = s.groupBy("year").agg(F.count_if(F.col("side") == 1).alias("k"), F.sum(F.when(F.col("side") == 1, F.col("s")).otherwise(-F.col("s"))).alias("observed"))
    runs = s.select("year", "word", "s", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("run"))
    place = F.row_number().over(Window.partitionBy("year", "run").orderBy(F.xxhash64("word", "run", F.lit(seed)), "word"))
    stat = runs.withColumn("place", place).join(F.broadcast(sizes), "year").groupBy("year", "run").agg(F.sum(F.when(F.col("place") <= F.col("k"), F.col("s")).otherwise(-F.col("s"))).alias("stat"), F.first("observed").alias("observed"))
    return stat.groupBy("year").agg(F.avg((F.col("stat") > F.col("observed") + 1e-12).cast("double")).alias("p"), F.stddev_samp("stat").alias("std"))


def weat_pooled(vectors: DataFrame, t1: list[str], t2: list[str], a1: list[str], a2: list[str]) -> DataFrame:
    """The older test: all single cosines are pooled, their deviation is the sample one."""
    pools = []
    for side, t in ((1, t1), (2, t2)):
        for at, a in ((1, a1), (2, a2)):
            pools.append(word_pairs(vectors, t, a).select("year", F.lit(side).alias("side"), F.lit(at).alias("at"), "cos"))
    c = pools[0]
    for p in pools[1:]:
        c = c.unionByName(p)
    of = lambda side, at: F.avg(F.when((F.col("side") == side) & (F.col("at") == at), F.col("cos")))
    return c.groupBy("year").agg((((of(1, 1) - of(1, 2)) - (of(2, 1) - of(2, 2))) / F.nullif(F.stddev_samp("cos"), F.lit(0.0))).alias("effect"))


# semantic dimensions


def contrasts(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """year, token1, token2, diff = second - first for the pairs that a model has in full."""
    a = vectors.select("year", F.col("word").alias("token1"), F.col("vector").alias("v1"))
    b = vectors.select("year", F.col("word").alias("token2"), F.col("vector").alias("v2"))
    p = F.broadcast(pairs.select("token1", "token2"))
    return a.join(p, "token1").join(b, ["year", "token2"]).select("year", "token1", "token2", minus(F.col("v2"), F.col("v1")).alias("diff"))


def mean_dimension(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """year, dimension: the unit vector of the mean difference."""
    d = mean_vectors(contrasts(vectors, pairs).select("year", F.col("diff").alias("vector")), "year")
    return d.select("year", normalized(F.col("vector")).alias("dimension"))


def loadings(vectors: DataFrame, pairs: DataFrame, dimension: DataFrame) -> DataFrame:
    c = contrasts(vectors, pairs).join(F.broadcast(dimension), "year")
    return c.select("year", "token1", "token2", cosine(F.col("diff"), F.col("dimension")).alias("loading"))


def project(vectors: DataFrame, dimension: DataFrame) -> DataFrame:
    """year, word, projection: cosine with the dimension of the year."""
    return vectors.join(F.broadcast(dimension), "year").select("year", "word", (dot(F.col("vector"), F.col("dimension")) / (norm(F.col("vector")) * norm(F.col("dimension")) + 1e-10)).alias("projection"))


def mean_dimension_summary(load: DataFrame) -> DataFrame:
    """Mean, deviation, extremes of the loadings, and how consistent they are by the coefficient of variation."""
    cv = F.col("std") / F.abs(F.col("mean"))
    s = load.groupBy("year").agg(F.avg("loading").alias("mean"), F.stddev_pop("loading").alias("std"), F.min("loading").alias("min"), F.max("loading").alias("max"), F.count("*").alias("pairs"))
    return s.withColumn("cv", cv).withColumn("consistency", F.when(cv < 0.15, "very high").when(cv < 0.25, "high").when(cv < 0.4, "moderate").otherwise("low"))


def principal(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Principal axes of centred rows and their shares of the variance."""
    z = rows - rows.mean(axis=0)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    total = float((s * s).sum()) or 1.0
    return vt, s * s / total


def pca_dimensions(vectors: DataFrame, pairs: DataFrame, positive: list[str] | None = None, components: int = 3) -> DataFrame:
    """year, dimension, explained (shares of the first components); the side of most positive words (second of the pairs by default) is positive.

    A dimension is defined by a short list of pairs, so each year's differences are one small group.
    """
    c = contrasts(vectors, pairs)
    words = [r[0] for r in pairs.select("token2").distinct().collect()] if positive is None else positive
    poles = vectors.where(F.col("word").isin(words)).groupBy("year").agg(F.collect_list("vector").alias("poles"))

    def fit(pdf):
        import pandas as pd

        axes, shares = principal(np.stack(pdf["diff"].to_numpy()))
        axis = axes[0]
        poles = pdf["poles"].iloc[0]
        if poles is not None and len(poles) and np.mean(np.stack([np.asarray(p, float) for p in poles]) @ axis) < 0:
            axis = -axis
        return pd.DataFrame({"year": [pdf["year"].iloc[0]], "dimension": [axis.tolist()], "explained": [shares[:components].tolist()]})

    return c.join(poles, "year", "left").select("year", "diff", "poles").groupBy("year").applyInPandas(fit, "year int, dimension array<double>, explained array<double>")


def variance_summary(explained: DataFrame) -> DataFrame:
    """year, component, share, cumulative, and how many components reach 80, 90 and 95 %."""
    e = explained.select("year", F.posexplode("explained").alias("i", "share")).withColumn("component", F.col("i") + 1)
    e = e.withColumn("cumulative", F.sum("share").over(Window.partitionBy("year").orderBy("component")))
    whole = Window.partitionBy("year")
    for p in (80, 90, 95):
        e = e.withColumn(f"for_{p}", F.min(F.when(F.col("cumulative") >= p / 100 - 1e-12, F.col("component"))).over(whole))
    return e.drop("i")


def compare_dimensions(a: DataFrame, b: DataFrame) -> DataFrame:
    """year, degrees, agreement of two dimensions; direction doesn't count."""
    c = F.least(F.lit(1.0), F.abs(cosine(F.col("dimension"), F.col("other"))))
    deg = F.degrees(F.acos(c))
    return a.select("year", "dimension").join(b.select("year", F.col("dimension").alias("other")), "year").select("year", deg.alias("degrees"), F.when(deg < 10, "strong").when(deg < 30, "moderate").otherwise("weak").alias("agreement"))


# stability


def _vocabulary(vectors: DataFrame, shared: bool) -> DataFrame:
    """The words that all models have, without special tokens; else all words, each over the models that have it."""
    return restrict(vectors, shared_words(vectors)) if shared else vectors


def local_stability(vectors: DataFrame, shared: bool = True) -> DataFrame:
    """word, local; a word that no two consecutive models have drops out."""
    v = _vocabulary(vectors, shared)
    return previous_model(v).groupBy("word").agg(F.avg(dot(F.col("vector"), F.col("before"))).alias("local"))


def global_stability(vectors: DataFrame, shared: bool = True) -> DataFrame:
    v = _vocabulary(vectors, shared)
    m = mean_vectors(v, "word").withColumnRenamed("vector", "mean")
    return v.join(m, "word").groupBy("word").agg((1 / (1 + F.var_pop(norm(minus(F.col("vector"), F.col("mean")))))).alias("global"))


def frequency_stability(vectors: DataFrame, shared: bool = True) -> DataFrame:
    v = _vocabulary(vectors, shared)
    s = v.groupBy("word").agg(F.count("count").alias("n"), F.avg("count").alias("m"), F.stddev_pop("count").alias("d"))
    return s.select("word", F.when((F.col("n") < 2) | (F.col("m") == 0), 0.0).otherwise(1 / (1 + F.col("d") / F.col("m"))).alias("frequency"), F.log1p("m").alias("log_count"))


def _unit_range(df: DataFrame, *columns: str) -> DataFrame:
    """columns moved to 0 to 1 by their extremes, found in one pass; a constant one becomes 1."""
    b = df.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    out = df.crossJoin(F.broadcast(b))
    one = lambda c: F.when(F.col(f"_hi_{c}") == F.col(f"_lo_{c}"), 1.0).otherwise((F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}")))
    return out.withColumns({c: one(c) for c in columns}).drop(*b.columns)


def stability_weights(vectors: DataFrame, method: str = "combined", alpha: float | None = 0.3, shared: bool = True) -> DataFrame:
    """word, weight of the words that all models have, or (shared=False) of all that have the measures: a measure of stability within 0 to 1, and the share alpha of the same of the mean log count.

    The measures, one row a word, are written once: their extremes and what follows read the files.
    """
    f = frequency_stability(vectors, shared)
    s = {"local": local_stability, "global": global_stability, "frequency": frequency_stability}
    if method == "combined":
        m = _unit_range(write_table(f.join(local_stability(vectors, shared), "word").join(global_stability(vectors, shared), "word"), "measures"), "local", "global", "frequency")
        m = m.withColumn("stability", (F.col("local") + F.col("global") + F.col("frequency")) / 3)
    elif method in s:
        m = write_table(f.select("word", "log_count").join(s[method](vectors, shared).select("word", F.col(method).alias("stability")), "word"), "measures")
    else:
        raise ValueError(f"unknown method {method!r}")
    if alpha is None:
        return _unit_range(m, "stability").select("word", F.col("stability").alias("weight"))
    m = _unit_range(m, "stability", "log_count")
    return m.select("word", ((1 - alpha) * F.col("stability") + alpha * F.col("log_count")).alias("weight"))


# alignment


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        if not b.num_rows:
            continue
        years = b.column("year").to_numpy()
        w = b.column("w").to_numpy(zero_copy_only=False)
        dim = len(b.column("x")[0])
        x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        y = b.column("y").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        for year in np.unique(years).tolist():
            own = years == year
            g = (y[own] * (w[own] ** 2)[:, None]).T @ x[own]
            sums[year] = sums.get(year, 0) + g
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([g.reshape(-1).tolist() for g in sums.values()], pa.list_(pa.float64()))], names=["year", "gram"])


def rotations(vectors: DataFrame, anchor: int, weights: DataFrame | None = None, vocabulary: str = "pairwise") -> DataFrame:
    """year, rotation: the orthogonal matrix (row by row) that turns each model towards the anchor year.

    vocabulary: pairwise takes the words that a model shares with the anchor, global those that all models share.
    With weights (word, weight) only weighted words count. Each task sums its part of the d x d product; only
    these sums are shuffled, and each year's decomposition is one small group.
    """
    v = restrict(vectors, shared_words(vectors, True)) if vocabulary == "global" else vectors
    a = v.where(F.col("year") == anchor).select("word", F.col("vector").cast("array<double>").alias("x"))
    p = v.select("year", "word", F.col("vector").cast("array<double>").alias("y")).join(a, "word")
    p = p.withColumn("w", F.lit(1.0)) if weights is None else p.join(weights.select("word", F.col("weight").cast("double").alias("w")), "word")
    parts = p.select("year", "x", "y", "w").mapInArrow(_gram, "year int, gram array<double>")

    def solve(pdf):
        import pandas as pd

        g = np.sum(np.stack(pdf["gram"].to_numpy()), axis=0)
        d = math.isqrt(len(g))
        u, _, vt = np.linalg.svd(g.reshape(d, d))
        return pd.DataFrame({"year": [pdf["year"].iloc[0]], "rotation": [(u @ vt).reshape(-1).tolist()]})

    return parts.groupBy("year").applyInPandas(solve, "year int, rotation array<double>")


def turned(vectors: DataFrame, rotation: DataFrame) -> DataFrame:
    """vectors times the rotation of their year, in Arrow batches."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            i = b.schema.get_field_index("vector")
            dim = len(b.column(i)[0])
            x = b.column(i).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            years = b.column("year").to_numpy()
            out = np.empty_like(x)
            for year in np.unique(years).tolist():
                own = np.flatnonzero(years == year)
                r = np.array(b.column("rotation")[int(own[0])].as_py()).reshape(dim, dim)
                out[own] = x[own] @ r
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), pa.array(out.reshape(-1)))
            yield b.set_column(i, "vector", flat).select([c for c in b.schema.names if c != "rotation"])

    keyed = vectors.withColumn("vector", F.col("vector").cast("array<double>"))
    schema = keyed.schema
    # years times the square of the dimension: as large as it may be, so no broadcast is asked for
    return keyed.join(rotation, "year").select(*keyed.columns, "rotation").mapInArrow(turn, schema)


def align(vectors: DataFrame, anchor: int, weights: DataFrame | None = None, vocabulary: str = "pairwise") -> DataFrame:
    """Normalised vectors of all years, turned towards the anchor year; specials take part in turning only."""
    unit = normalize(vectors)
    return turned(unit, rotations(unit, anchor, weights, vocabulary))


def rotation_check(rotation: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """year, distance of the rotation from none, aligned: whether it is within the tolerance."""

    def one(pdf):
        import pandas as pd

        r = np.array(pdf["rotation"].iloc[0])
        d = math.isqrt(len(r))
        far = float(np.linalg.norm(r.reshape(d, d) - np.eye(d)))
        return pd.DataFrame({"year": [pdf["year"].iloc[0]], "distance": [far], "aligned": [far <= tolerance], "state": ["aligned" if far < 1e-4 else "nearly aligned" if far < 1e-2 else "not aligned"]})

    return rotation.groupBy("year").applyInPandas(one, "year int, distance double, aligned boolean, state string")
