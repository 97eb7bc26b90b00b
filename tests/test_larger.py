"""What only larger tables show."""

import duckdb
import pytest

from yearloom.plans import adapters as A
from yearloom.plans import pipelines as P
from yearloom.queries import QUERIES, SQL

from .conftest import SF


def _no_list_to_the_driver(monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    def refused(self, *a):
        raise AssertionError("tokens are sent to the driver")

    for name in ("toPandas", "collect", "toArrow"):
        monkeypatch.setattr(DataFrame, name, refused)


def _sentences(spark):
    rows = [("unknown", 1900, f"Word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} the was it's {i}", 1 + i, 1) for i in range(900)]
    return spark.createDataFrame([*rows, ("unknown", 1901, None, 1, 1)], "genre string, year int, sentence string, occurrences long, documents long")


CONFIG = P.FilterConfig(stop_words=frozenset({"the"}), always_include=frozenset({"it's"}), lemmas={"was": "be"})


def test_tasks_read_the_tokens_of_a_sentence_filter(spark, monkeypatch):
    df = _sentences(spark)
    with monkeypatch.context() as m:
        _no_list_to_the_driver(m)
        out = P.filter_sentences(df, CONFIG)
    got = {r.sentence: r.occurrences for r in out.collect()}
    assert len(got) == 676 and got["wordaa <UNK> be it's <UNK>"] == 1 + 677
    one_by_one = P.filter_sentences(df, CONFIG, lookup=0)
    assert {r.sentence: r.occurrences for r in one_by_one.collect()} == got
    assert "SortMergeJoin" not in one_by_one._jdf.queryExecution().toString()


def test_tasks_read_the_tokens_of_a_corpus_filter(spark, monkeypatch):
    df = _sentences(spark)
    with monkeypatch.context() as m:
        _no_list_to_the_driver(m)
        out = P.filter_corpus(df, CONFIG, 20)
    # "it's" is added to the 20 most frequent
    got = {(r.sentence, r.occurrences) for r in out.collect()}
    assert got == {(r.sentence, r.occurrences) for r in P.filter_corpus(df, CONFIG, 20, lookup=0).collect()} and len(got) > 10


@pytest.mark.parametrize("name", ["e11_local_stability", "e12_global_stability", "e13_e14_frequency_stability", "e15_stability_weights"])
def test_stability_of_a_word_that_some_models_lack(spark, tmp_path, name):
    spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 46").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"select {', '.join(df.columns)} from ({SQL[name]})").fetchall()
    assert len(want) == 5
    for a, b in zip(sorted(tuple(r) for r in df.orderBy("word").collect()), sorted(want)):
        assert a == pytest.approx(b, abs=2e-6)


def test_archives_of_odd_texts(spark, tmp_path):
    rows = [(1, "## head\nbody"), (2, " "), (3, ""), (4, None), (5, "@@12\n@@13\nx"), (6, "plain ## text\n@@7"), (7, "\n@@ a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(SQL["s17_s18_zip_reader"]).fetchall()
    assert sorted(tuple(r) for r in QUERIES["s17_s18_zip_reader"](spark, str(tmp_path)).collect()) == sorted(want)


def test_statistics_count_once_for_all_years(spark, tmp_path, monkeypatch):
    log, real = str(tmp_path / "log"), A.ngram_counts

    def noted(batches):
        for b in batches:
            with open(log, "a") as f:
                f.write(f"{b.num_rows}\n")
            yield b

    def counts(s, d):
        df = real(s, d)
        return df.mapInArrow(noted, df.schema)

    monkeypatch.setattr(A, "ngram_counts", counts)
    got = QUERIES["s31_k14_a11_t12_corpus_stats"](spark, SF).collect()
    monkeypatch.undo()
    assert len(got) > 1 and sum(int(x) for x in open(log)) == real(spark, SF).count() == sum(r.unique_ngrams for r in got)
