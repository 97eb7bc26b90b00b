"""Examples with known results, and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from yearloom.functions import scalars as S
from yearloom.functions import tokens as K
from yearloom.operators import counts as C
from yearloom.operators import drift as D
from yearloom.operators import models as M
from yearloom.operators import regression as R
from yearloom.operators import series as T
from yearloom.operators import vectors as E
from yearloom.plans import adapters as A
from yearloom.plans import pipelines as P
from yearloom.queries import QUERIES
from yearloom.sources import files as FI
from yearloom.sources import metadata as ME
from yearloom.sources import tables as TB

from .conftest import SF


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("x")).first()[0]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("hello\t2000,100,50\t2001,150,60", ("hello", [(2000, 100, 50), (2001, 150, 60)])),
        ("hello", None), ("", None), ("x\tbad\t2001,1", None), ("x\tbad\t2001,1,1", ("x", [(2001, 1, 1)])),
    ],
)
def test_parse_line(spark, line, want):
    got = one(spark, line, K.parse_line)
    assert (got and (got.ngram, [tuple(f) for f in got.freqs])) == want


@pytest.mark.parametrize(
    ("text", "pairs", "tagged", "want"),
    [
        ("lower class working class", ["lower class", "working class"], True, "lower-class working-class"),
        ("the_DET working_VERB class_NOUN", ["working class"], True, "the_DET working-class_VERB"),
        ("a b c d", ["a b", "b c", "c d"], True, "a-b c-d"),
        ("one", ["one two"], True, "one"),
        ("The Working Class family", ["working class"], False, "The Working-Class family"),
    ],
)
def test_join_pairs(spark, text, pairs, tagged, want):
    assert one(spark, text, lambda v: F.array_join(K.join_pairs(F.split(v, " "), pairs, tagged, not tagged), " ")) == want


@pytest.mark.parametrize(
    ("ngram", "cfg", "want"),
    [
        ("The_DET Quick_ADJ fox2_NOUN", P.FilterConfig(stop_words=frozenset({"the"}), min_context_tokens=1), "<UNK> quick <UNK>"),
        ("The_DET Quick_ADJ fox2_NOUN", P.FilterConfig(stop_words=frozenset({"the"})), None),
        ("a  b", P.FilterConfig(lower=None, alpha_only=False, filter_short=False), "a b"),
        ("cat dog", P.FilterConfig(whitelist=frozenset({"cat"}), always_include=frozenset({"dog"})), "cat dog"),
        ("cat 12", P.FilterConfig(whitelist=frozenset({"12"}), min_context_tokens=1), "<UNK> 12"),
        ("É É", P.FilterConfig(alpha_only=False, filter_short=False), "É É"),
        ("   ", P.FilterConfig(min_context_tokens=0), None),
    ],
)
def test_filter_ngrams(spark, ngram, cfg, want):
    got = P.filter_ngrams(spark.createDataFrame([(2000, ngram, 5, 2)], "year int, ngram string, occurrences long, documents long"), cfg).collect()
    assert [r.ngram for r in got] == ([] if want is None else [want])


@pytest.mark.parametrize(("token", "word"), [("__NOUN", "_"), ("cat_VERB", "cat"), ("_NOUN", "_NOUN"), ("_NOUN_", "_NOUN_"), ("a_b_NUM", "a_b"), ("x_.", "x"), ("Paris_PROPN", "Paris"), ("up_PRT", "up_PRT")])
def test_tags(spark, token, word):
    assert one(spark, token, K.word_part) == word


@pytest.mark.parametrize(("text", "want"), [("__NOUN", True), ("cat_VERB", True), ("_NOUN_", False)])
def test_tagged(spark, text, want):
    assert one(spark, text, lambda v: K.ngram_kind(v, "tagged")) is want


@pytest.mark.parametrize(
    ("text", "want"),
    [("The cat sat . On the mat !", ["The cat sat", "On the mat"]), ("Hello world. This is a test!", ["Hello world.", "This is a test!"]), ("Yes.", []), ("", []), (None, []), ("a b c.", ["a b c."])],
)
def test_sentences(spark, text, want):
    docs = spark.createDataFrame([(1, text, 1990, None)], "doc_id long, text string, year int, genre string")
    got = P.ingest_sentences(docs)
    assert sorted(r.sentence for r in got.collect()) == sorted(want)


@pytest.mark.parametrize(("n", "want"), [(1, 1), (3, 1), (24, 2), (124, 3), (624, 4)])
def test_log_weight(spark, n, want):
    assert one(spark, n, S.log_weight, "long") == want


@pytest.mark.parametrize(("mode", "text", "want"), [("reject", "a <UNK> b", None), ("strip", "a <UNK> b", ["a", "b"]), ("retain", "a <UNK> b", ["a", "<UNK>", "b"]), ("strip", "a <UNK>", None)])
def test_unk_modes(spark, mode, text, want):
    assert one(spark, text, lambda v: S.unk_mode(F.split(v, " "), mode)) == want


def test_unknown_modes_fail():
    with pytest.raises(ValueError):
        S.unk_mode(F.lit(1), "other")
    with pytest.raises(ValueError):
        FI.location("x", 9, "20200217", "eng")
    with pytest.raises(ValueError):
        ME.dialect("what is this")


@pytest.mark.parametrize(("year", "size", "want"), [(2003, 1, 2003), (2003, 5, 2000), (1998, 5, 1995)])
def test_year_bin(spark, year, size, want):
    assert one(spark, year, lambda v: S.year_bin(v, size), "int") == want


@pytest.mark.parametrize(("name", "genre", "year"), [("mag_1815_552651.txt", "mag", 1815), ("README.txt", None, None)])
def test_document_names(spark, name, genre, year):
    assert one(spark, name, FI.doc_genre) == genre and one(spark, name, FI.doc_year) == year


def test_archive_year(spark):
    assert one(spark, "text_1810s_kso.zip", FI.archive_year) == 1810
    with pytest.raises(Exception, match="no year"):
        one(spark, "other.zip", FI.archive_year)


@pytest.mark.parametrize(("text", "want"), [("@@552651\nSome", 552651), ("##703\nSome", 703), (" @@5", 5), ("none", None), (None, None)])
def test_text_id(spark, text, want):
    assert one(spark, text, FI.text_id) == want


def test_bins_and_pivot_keep_sums(spark):
    n = spark.createDataFrame([(2001, "cat", 10, 2), (2003, "cat", 5, 1), (2006, "cat", 1, 1)], "year int, ngram string, occurrences long, documents long")
    assert sorted(map(tuple, C.bin_years(n, 5).select("year", "occurrences", "documents").collect())) == [(2000, 15, 3), (2005, 1, 1)]
    w = C.widen(n)
    assert sorted(map(tuple, C.pivot_years(w).select(*n.columns).collect())) == sorted(map(tuple, n.collect()))
    assert w.select(C.total(F.col("freqs"))).first()[0] == 16
    with pytest.raises(ValueError):
        TB.year_scan(n, 10000)
    with pytest.raises(TypeError):
        TB.range_scan(n, "ngram", b"a")


def test_numbered_covers_partitions(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x")).repartition(7)
    got = TB.numbered(df, "x").collect()
    assert sorted(r.n for r in got) == list(range(1000)) and all(r.n == r.x for r in got)
    assert TB.numbered(df.where("x < 0"), "x").count() == 0


def test_long_whitelist_gives_the_same_as_literals(spark):
    n = spark.createDataFrame([(2000, "the cat sat", 3, 1), (2001, "the cat sat", 1, 1), (2000, "The CAT", 2, 2), (2000, "dog cat cat", 1, 1)], "year int, ngram string, occurrences long, documents long")
    words = ["cat", "the", "dog"]
    a = P.filter_ngrams(n, P.FilterConfig(whitelist=frozenset(words)))
    b = P.filter_ngrams(n, P.FilterConfig(), spark.createDataFrame([(w,) for w in words], "token string"))
    key = lambda df: sorted(map(tuple, df.select("year", "ngram", "occurrences", "documents").collect()))
    assert key(a) == key(b) != []


def test_gaussian_against_numpy(spark):
    y = np.array([3.0, 1, 4, 1, 5, 9, 2])
    df = spark.createDataFrame([("a", 2000 + i, float(v)) for i, v in enumerate(y)], "word string, year int, v double")
    got = [r.smooth for r in T.gaussian(df, "v", 1.0, ["word"]).orderBy("year").collect()]
    w = np.exp(-0.5 * np.arange(-4, 5) ** 2.0)
    w /= w.sum()
    padded = np.concatenate([y[:4][::-1], y, y[-4:][::-1]])
    assert np.allclose(got, [padded[i : i + 9] @ w for i in range(len(y))])


def test_derivative_of_a_cubic(spark):
    df = spark.createDataFrame([("a", x, float(x**3 - 2 * x)) for x in range(12)], "word string, year int, v double")
    got = {r.year: r.rate for r in T.derivative(df, "v", ["word"]).collect()}
    assert all(math.isclose(got[x], 3 * x * x - 2, abs_tol=1e-6) for x in range(12))


@pytest.mark.parametrize(("t", "df", "p"), [(0, 5, 1.0), (2.570582, 5, 0.05), (12.7062, 1, 0.05), (1.959964, 1e7, 0.05), (3.169273, 10, 0.01)])
def test_student_tail(t, df, p):
    assert math.isclose(T.t_tail(t, df), p, rel_tol=1e-4)


def vectors(spark, years=(2000, 2001, 2002), words=12, dim=6, turn=False, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((words, dim))
    rows, turns = [], {}
    for y in years:
        q = np.linalg.qr(rng.standard_normal((dim, dim)))[0] if turn and y != years[0] else np.eye(dim)
        turns[y] = q
        x = base @ q if turn else rng.standard_normal((words, dim))
        rows += [(f"m{y}", y, f"w{i}", x[i].tolist(), int(i + 1)) for i in range(words)]
    return spark.createDataFrame(rows, "model_id string, year int, word string, vector array<double>, count long"), turns


def test_alignment_undoes_rotations(spark):
    v, _ = vectors(spark, turn=True)
    for how in ("pairwise", "global"):
        a = E.align(v, 2000, vocabulary=how)
        by = {}
        for r in a.collect():
            by.setdefault(r.word, []).append(np.array(r.vector))
        assert all(np.allclose(x, xs[0], atol=1e-8) for xs in by.values() for x in xs)
    rot = {r.year: np.array(r.rotation).reshape(6, 6) for r in E.rotations(E.normalize(v), 2000).collect()}
    assert all(np.allclose(r @ r.T, np.eye(6), atol=1e-9) for r in rot.values())


def test_pca_dimension_against_numpy(spark):
    v, _ = vectors(spark, years=(2000,))
    pairs = [("w0", "w1"), ("w2", "w3"), ("w4", "w5"), ("w6", "missing")]
    got = E.pca_dimensions(v, spark.createDataFrame(pairs, "token1 string, token2 string")).first()
    x = {r.word: np.array(r.vector) for r in v.collect()}
    d = np.stack([x[b] - x[a] for a, b in pairs[:3]])
    _, s, vt = np.linalg.svd(d - d.mean(axis=0))
    assert math.isclose(abs(np.dot(got.dimension, vt[0])), 1, abs_tol=1e-9)
    assert np.allclose(got.explained, (s**2 / (s**2).sum())[:3], atol=1e-9)
    assert np.mean([x[b] @ np.array(got.dimension) for _, b in pairs[:3]]) >= 0


def test_permutations_are_repeatable(spark):
    v, _ = vectors(spark)
    args = (["w0", "w1"], ["w2", "w3"], ["w4", "w5"], ["w6", "w7"])
    a, b = (sorted(map(tuple, E.weat_permutations(x, *args, 50, 1).collect())) for x in (v, v.repartition(9)))
    assert a == b


def test_weat_without_variation_is_null(spark):
    rows = [("m", 2000, w, [1.0, 0.0], 1) for w in "abcdefgh"]
    v = spark.createDataFrame(rows, "model_id string, year int, word string, vector array<double>, count long")
    assert E.weat(v, ["a", "b"], ["c", "d"], ["e", "f"], ["g", "h"]).first().effect is None


def test_drift_of_a_fixed_model_is_nothing(spark):
    v, _ = vectors(spark, years=(2000,))
    u = E.normalize(v)
    both = u.union(u.withColumn("year", F.lit(2004)))
    r = D.local_change(both).first()
    assert r.year == 2004 and abs(r.change) < 1e-12 and r.shared == 12


def test_cbow_query_trains_every_year(spark):
    years = {r.year for r in A.ngram_counts(spark, SF).select("year").distinct().collect()}
    assert len(years) > 2 and {r.year for r in QUERIES["e1_e2_cbow"](spark, SF).select("year").distinct().collect()} == years


def test_regression_against_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((80, 2))
    g = rng.integers(0, 8, 80)
    y = 1 + x @ [2, -1] + rng.standard_normal(8)[g] * 2 + rng.standard_normal(80) * 0.3
    df = spark.createDataFrame([(float(a), float(b), int(k), float(v)) for (a, b), k, v in zip(x, g, y)], "a double, b double, g int, y double")
    design = np.column_stack([np.ones(80), x])
    want = np.linalg.lstsq(design, y, rcond=None)[0]
    assert np.allclose([r.coef for r in R.ols(df, "y", ["a", "b"]).collect()], want)
    assert np.allclose([r.coef for r in R.mixed(df, "y", ["a", "b"], "g").collect()][1:], [2, -1], atol=0.15)
    with pytest.raises(ValueError):
        C.complete_rows(df, "nothing")


def test_xlsx_metadata(spark):
    import io
    import zipfile

    sheet = "".join(
        f'<row r="{i}">' + "".join(f'<c r="{c}{i}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in zip("ABCDEF", row)) + "</row>"
        for i, row in enumerate([("id", "words", "genre", "year", "title", "author"), (7, 120, "FIC", 1950, "T", "A"), ("x", 1, "NF", "n", "", "")], 1)
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{sheet}</sheetData></worksheet>')
    assert list(map(tuple, ME.parse_xlsx(spark, out.getvalue()).collect())) == [(7, 1950, "fic", "T", "A", 120)]


def test_entry_imports_without_the_corpus_operators(tmp_path):
    import shutil
    import subprocess
    import sys

    from .conftest import ROOT

    shutil.copytree(ROOT / "yearloom", tmp_path / "yearloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship_whitelist' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q if k[2:3].isdigit()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})


@pytest.mark.parametrize("lookup", [500_000, 0])
def test_sentences_with_long_lists_as_tables(spark, lookup):
    rows = [("fic", 1900, "The cats was Running", 3, 2), ("fic", 1900, "the Cats was running", 1, 1), ("fic", 1900, "a dog", 1, 1), ("new", 1901, "dog dog dog", 2, 1), ("new", 1901, "", 2, 1), ("new", 1901, "x y z", 2, 1)]
    df = spark.createDataFrame(rows, "genre string, year int, sentence string, occurrences long, documents long")
    words, lemmas = ["cats", "was", "dog", "running"], {"cats": "cat", "was": "be", "running": "run", "other": "o"}
    cfg = P.FilterConfig(always_include=frozenset({"a"}))
    plain = P.filter_sentences(df, P.FilterConfig(always_include=frozenset({"a"}), whitelist=frozenset(words), lemmas=lemmas))
    tables = P.filter_sentences(df, cfg, spark.createDataFrame([(w,) for w in words * 2], "token string"), spark.createDataFrame(sorted(lemmas.items()), "token string, lemma string"), lookup)
    want = {("fic", 1900, "<UNK> cat be run", 4, 3), ("fic", 1900, "a dog", 1, 1), ("new", 1901, "dog dog dog", 2, 1)}
    assert {tuple(r) for r in plain.collect()} == {tuple(r) for r in tables.collect()} == want
    assert tables.count() == len(want)


@pytest.mark.parametrize("lookup", [500_000, 0])
def test_corpus_filter_takes_lists_of_any_length(spark, lookup):
    rows = [("g", 1900, f"word{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i // 100 % 10]} common thing{'abcdefghij'[i // 1000]}", 1 + i % 3, 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "genre string, year int, sentence string, occurrences long, documents long")
    got = P.filter_corpus(df, P.FilterConfig(ascii_alpha_only=False), 2500, lookup=lookup).collect()
    assert sum(r.occurrences for r in got) == sum(r[3] for r in rows) and all("common" in r.sentence for r in got)
    few = P.filter_corpus(df, P.FilterConfig(ascii_alpha_only=False), 1, lookup=lookup)
    assert few.isEmpty()


@pytest.mark.parametrize("lookup", [500_000, 0])
def test_ngrams_with_lemma_tables(spark, lookup):
    n = spark.createDataFrame([(2000, "Cats_NOUN run_VERB", 5, 1), (2000, "cat running", 2, 1)], "year int, ngram string, occurrences long, documents long")
    lemmas = spark.createDataFrame([("cats", "cat"), ("running", "run")], "token string, lemma string")
    got = P.filter_ngrams(n, P.FilterConfig(), lemmas=lemmas, lookup=lookup).collect()
    assert [tuple(r) for r in got] == [(2000, "cat run", 7, 2)]


def test_invalid_models_are_trained_again(spark):
    v = spark.createDataFrame([("a", "x", [1.0, 2.0]), ("a", "y", [1.0, 3.0]), ("b", "x", [1.0]), ("b", "y", [1.0, 2.0]), ("c", "x", [float("nan"), 1.0]), ("d", "x", None), ("e", "x", [1.0, 1.0]), ("e", "x", [1.0, 1.0])], "model_id string, word string, vector array<double>")
    tasks = spark.createDataFrame([(m,) for m in "abcdef"], "model_id string")
    todo, kept = M.to_train(tasks, v)
    assert {r[0] for r in todo.collect()} == set("bcdef") and {r.model_id for r in kept.collect()} == {"a"}


def test_analogies_in_blocks(spark):
    rng = np.random.default_rng(0)
    rows = [(m, f"w{i}", rng.standard_normal(8).tolist()) for m in ("a", "b") for i in range(60)]
    rows += [("a", w, [float(x) for x in v]) for w, v in (("king", (1, 1, 0, 0, 0, 0, 0, 5)), ("man", (1, 0, 0, 0, 0, 0, 0, 5)), ("woman", (0, 0, 1, 0, 0, 0, 0, 5)), ("queen", (0, 1, 1, 0, 0, 0, 0, 5)))]
    df = spark.createDataFrame(rows, "model_id string, word string, vector array<double>")
    q = [("man", "king", "woman", "queen"), ("man", "king", "woman", "w1")] + [tuple(f"w{k}" for k in rng.choice(60, 4, replace=False)) for _ in range(20)] + [("w1", "w2", "w3", "absent")]
    got = {r.model_id: (r.analogy_score, r.questions) for r in M.analogy_scores(df, spark.createDataFrame(q, "a string, b string, c string, d string"), block=7).collect()}
    for m in ("a", "b"):
        own = {w: np.array(v) / np.linalg.norm(v) for x, w, v in rows if x == m}
        known = [t for t in q if all(w in own for w in t)]
        right = sum(max((w for w in own if w not in t[:3]), key=lambda w: own[w] @ (own[t[1]] - own[t[0]] + own[t[2]])) == t[3] for t in known)
        assert got[m] == (right / len(known), len(known))


def test_a_cluster_needs_a_shared_folder():
    from yearloom.sources import scratch

    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "local-cluster[2,1,512]"

    with pytest.raises(ValueError):
        scratch.shared_dir(Session)
