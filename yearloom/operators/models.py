"""Training, evaluating and choosing embedding models."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, dot, normalized
from ..schemas import VECTORS
from ..sources.scratch import write_table


def grid(spark: SparkSession, years: list[int], **parameters: list) -> DataFrame:
    """All combinations of years and parameters."""
    out = spark.createDataFrame([(y,) for y in years], "year int")
    for name, values in parameters.items():
        out = out.crossJoin(F.broadcast(spark.createDataFrame([(v,) for v in values], [name])))
    return out


def untrained(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return tasks.join(done.select(*keys).distinct(), keys, "left_anti")


def validity(vectors: DataFrame, size: int | None = None) -> DataFrame:
    """model_id, words, valid: whether a model has words, all with finite vectors of one length (of size, where it is given), none twice."""
    n = F.size("vector")
    good = F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & (n > 0)
    one = (F.min(n) == F.max(n)) & (F.lit(True) if size is None else F.min(n) == size)
    return vectors.groupBy("model_id").agg(F.count("*").alias("words"), (F.min(F.coalesce(good, F.lit(False))) & one & (F.count_distinct("word") == F.count("*"))).alias("valid"))


def to_train(tasks: DataFrame, vectors: DataFrame, size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Tasks whose model is missing or not valid, and vectors without the models that aren't: those are trained again."""
    valid = write_table(validity(vectors, size).where("valid").select("model_id"), "valid")
    return untrained(tasks, valid, ["model_id"]), vectors.join(F.broadcast(valid), "model_id", "left_semi")


def skip_gram(corpus: DataFrame, year: int, vector_size: int = 100, window: int = 5, min_count: int = 5, epochs: int = 1, seed: int = 0, partitions: int = 1, model_id: str | None = None) -> DataFrame:
    """Vectors of one year's corpus (year, tokens, weight) by distributed skip-gram with hierarchical softmax."""
    from pyspark.ml.feature import Word2Vec

    own = corpus.where(F.col("year") == year).select(F.explode(F.array_repeat("tokens", F.col("weight").cast("int"))).alias("tokens"))
    model = Word2Vec(vectorSize=vector_size, windowSize=window, minCount=min_count, maxIter=epochs, seed=seed, numPartitions=partitions, inputCol="tokens", outputCol="v").fit(own)
    from pyspark.ml.functions import vector_to_array

    counts = own.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("count"))
    v = model.getVectors().select("word", vector_to_array("vector", "float32").alias("vector")).join(counts, "word")
    return v.select(F.lit(model_id or f"w2v_y{year}").alias("model_id"), F.lit(year).alias("year"), "word", "vector", "count").to(VECTORS)


def cbow(corpus: DataFrame, vector_size: int = 50, window: int = 5, min_count: int = 2, epochs: int = 5, negatives: int = 5, rate: float = 0.05, seed: int = 0) -> DataFrame:
    """Vectors of every year by continuous bag of words with negative sampling: train_grid with one setting."""
    tasks = corpus.select("year").distinct().withColumns({"model_id": F.format_string("cbow_y%d", "year"), **{k: F.lit(v) for k, v in (("vector_size", vector_size), ("window", window), ("min_count", min_count), ("epochs", epochs))}})
    return train_grid(corpus, tasks, negatives, rate, seed)


def model_name(year: Column, weight_by: Column, vector_size: Column, window: Column, min_count: Column, sg: Column, epochs: Column) -> Column:
    return F.format_string("w2v_y%d_wb%s_vs%03d_w%03d_mc%03d_sg%d_e%03d", year, weight_by, vector_size, window, min_count, sg, epochs)


def train_grid(corpus: DataFrame, tasks: DataFrame, negatives: int = 5, rate: float = 0.05, seed: int = 0, vocabulary: int | None = None) -> DataFrame:
    """A model for each task (model_id, year, vector_size, window, min_count, epochs), one group a task, in numpy.

    Tasks are a list of settings and are broadcast; those already done are left out with untrained beforehand. A
    year's corpus goes to the group in Arrow batches; it holds the vocabulary's two matrices (of all words that
    are frequent enough, or the vocabulary most frequent, if that is given) and the sentences as word numbers. For a corpus beyond one task's memory, use skip_gram.
    """

    def train(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sentences, counts, first = [], {}, None
        for f in frames:
            first = f.iloc[0] if first is None else first
            for t, w in zip(f["tokens"], f["weight"]):
                sentences.append((list(t), int(w)))
                for x in t:
                    counts[x] = counts.get(x, 0) + int(w)
        year, size, window, epochs = int(first["year"]), int(first["vector_size"]), int(first["window"]), int(first["epochs"])
        words = sorted((t for t, c in counts.items() if c >= int(first["min_count"])), key=lambda t: (-counts[t], t))[:vocabulary]
        at = {t: i for i, t in enumerate(words)}
        coded = [c for s, w in sentences for c in [np.array([at[t] for t in s if t in at])] * w if len(c) > 1]
        rng = np.random.default_rng([seed, zlib.crc32(str(first["model_id"]).encode())])
        u = (rng.random((len(words), size)) - 0.5) / size
        v = np.zeros((len(words), size))
        noise = np.array([counts[t] for t in words], float) ** 0.75
        noise = np.cumsum(noise / noise.sum()) if len(words) else noise
        for e in range(epochs):
            step = rate * (1 - e / epochs)
            for k in rng.permutation(len(coded)):
                s = coded[k]
                n = len(s)
                near = np.abs(np.arange(n)[:, None] - np.arange(n)[None]) <= rng.integers(1, window + 1, n)[:, None]
                np.fill_diagonal(near, False)
                mix = near / np.maximum(near.sum(axis=1, keepdims=True), 1)
                h = mix @ u[s]
                others = np.minimum(np.searchsorted(noise, rng.random((n, negatives))), len(words) - 1)
                target = np.concatenate([s[:, None], others], axis=1)
                want = np.zeros(target.shape)
                want[:, 0] = 1
                p = 1 / (1 + np.exp(-np.clip(np.einsum("nd,nkd->nk", h, v[target]), -30, 30)))
                g = step * (want - p)
                back = mix.T @ np.einsum("nk,nkd->nd", g, v[target])
                np.add.at(v, target, g[:, :, None] * h[:, None, :])
                np.add.at(u, s, back)
        yield pd.DataFrame({"model_id": [first["model_id"]] * len(words), "year": np.full(len(words), year, np.int32), "word": words, "vector": list(u.astype(np.float32)), "count": np.array([counts[t] for t in words], dtype=np.int64)})

    own = corpus.select("year", "tokens", "weight").join(F.broadcast(tasks.select("model_id", "year", "vector_size", "window", "min_count", "epochs")), "year")
    return own.groupBy("model_id").applyInPandas(train, VECTORS)


def similarity_scores(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """model_id, similarity_score (Spearman, ties averaged), pairs found, for word pairs (word1, word2, score)."""
    v = vectors.select("model_id", "word", "vector")
    p = F.broadcast(pairs)
    a = v.select("model_id", F.col("word").alias("word1"), F.col("vector").alias("va")).join(p, "word1")
    c = a.join(v.select("model_id", F.col("word").alias("word2"), F.col("vector").alias("vb")), ["model_id", "word2"]).select("model_id", "score", cosine(F.col("va"), F.col("vb")).alias("cos"))

    def tied(x: str):
        return F.rank().over(Window.partitionBy("model_id").orderBy(x)) + (F.count("*").over(Window.partitionBy("model_id", x)) - 1) / 2

    r = c.select("model_id", tied("score").alias("a"), tied("cos").alias("b"))
    return r.groupBy("model_id").agg(F.corr("a", "b").alias("similarity_score"), F.count("*").alias("pairs"))


def _nearest_words(words: pd.DataFrame, goals: pd.DataFrame) -> pd.DataFrame:
    """Of a block of one model's words the nearest to each goal but a, b and c: one matrix product; of ties the last by name."""
    if not len(words) or not len(goals):
        return pd.DataFrame({"model_id": [], "q": [], "s": [], "word": []})
    words = words.sort_values("word", ascending=False)
    names = words["word"].tolist()
    place = {w: i for i, w in enumerate(names)}
    s = np.stack(goals["goal"].to_numpy()) @ np.stack(words["v"].to_numpy()).T
    for k in "abc":
        at = [(i, place[w]) for i, w in enumerate(goals[k]) if w in place]
        if at:
            s[tuple(np.array(at).T)] = -np.inf
    best = s.argmax(axis=1)
    return pd.DataFrame({"model_id": goals["model_id"], "q": goals["q"], "s": s[np.arange(len(s)), best], "word": [names[i] for i in best]})


def analogy_scores(vectors: DataFrame, analogies: DataFrame, block: int = 5_000) -> DataFrame:
    """model_id, analogy_score, questions: how often the word nearest to b - a + c (the three apart) is d, of questions a model knows in full.

    A model's words are spread over blocks of about block words, each with the model's questions: no task holds a whole
    vocabulary, and of each block one word a question is left.
    """
    unit = vectors.select("model_id", "word", normalized(F.col("vector")).alias("v"))
    q = analogies.groupBy("a", "b", "c", "d").agg(F.count("*").alias("n")).withColumn("q", F.xxhash64("a", "b", "c", "d"))
    x = unit.select("model_id", F.col("word").alias("a"), F.col("v").alias("va")).join(q, "a")
    for k in "bcd":
        x = x.join(unit.select("model_id", F.col("word").alias(k), F.col("v").alias(f"v{k}")), ["model_id", k])
    x = write_table(x.select("model_id", "q", "n", "a", "b", "c", "d", F.zip_with(F.zip_with("vb", "va", lambda s, t: s - t), "vc", lambda s, t: s + t).alias("goal")), "questions")
    sizes = write_table(unit.groupBy("model_id").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "sizes")
    words = unit.join(sizes.withColumnRenamed("blocks", "parts"), "model_id").withColumn("block", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    goals = x.join(sizes, "model_id").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
    hits = words.groupBy("model_id", "block").cogroup(goals.groupBy("model_id", "block")).applyInPandas(_nearest_words, "model_id string, q long, s double, word string")
    best = hits.where("s > double('-infinity')").groupBy("model_id", "q").agg(F.max(F.struct("s", "word")).alias("hit")).join(x.select("model_id", "q", "n", "d"), ["model_id", "q"])
    return best.groupBy("model_id").agg((F.sum((F.col("hit.word") == F.col("d")).cast("long") * F.col("n")) / F.sum("n")).alias("analogy_score"), F.sum("n").alias("questions"))


def evaluate(vectors: DataFrame, pairs: DataFrame, analogies: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Both scores of each model that done (model) doesn't list."""
    if done is not None:
        vectors = vectors.join(done.select(F.col("model").alias("model_id")).distinct(), "model_id", "left_anti")
    s = similarity_scores(vectors, pairs).drop("pairs").join(analogy_scores(vectors, analogies).drop("questions"), "model_id", "full")
    return vectors.select("model_id", "year").distinct().join(s, "model_id", "left").withColumnRenamed("model_id", "model")
