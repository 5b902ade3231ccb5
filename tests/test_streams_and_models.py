import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexispark.catalog import ORACLES, QUERIES
from lexispark.plans.checkpoints import scratch_path
from lexispark.sources import files
from lexispark.streaming import articles

SF = "/root/testdata/sf0.001"


def test_stream_keeps_first_of_every_url_and_filters(spark):
    source, out, mark = (scratch_path(spark, n) for n in ("in", "out", "mark"))
    t = dt.datetime(2024, 1, 1)
    body = "x" * 600
    rows = [("u1", body, t), ("u1", body, t + dt.timedelta(hours=1)), ("u2", body + "<div>", t), ("u3", "short", t)]
    spark.createDataFrame(rows, articles.SCHEMA).write.parquet(source)
    stream = articles.novel_articles(articles.good_articles(articles.from_files(spark, source)))
    articles.run_to_parquet(stream, out, mark)
    assert [r.url for r in spark.read.parquet(out).collect()] == ["u1"]
    # A second run goes on from the checkpoint: the url is known, a new one is let in.
    spark.createDataFrame([("u1", body, t), ("u4", body, t)], articles.SCHEMA).write.mode("append").parquet(source)
    articles.run_to_parquet(articles.novel_articles(articles.good_articles(articles.from_files(spark, source))), out, mark)
    assert sorted(r.url for r in spark.read.parquet(out).collect()) == ["u1", "u4"]


def test_urls_are_known_after_restarts_and_ten_days(spark):
    source, out, mark = (scratch_path(spark, n) for n in ("feed", "kept", "mark"))
    body, t = "x" * 600, dt.datetime(2024, 5, 1)
    days = lambda n: t + dt.timedelta(days=n)
    runs = [
        [("u1", body, days(0)), ("u2", body, days(1))],
        [("u1", body, days(10)), ("u3", body, days(10))],
        [("u2", body, days(30)), ("u1", body, days(-20)), ("old", body, days(-20)), (None, body, days(30))],
    ]
    for rows in runs:
        spark.createDataFrame(rows, articles.SCHEMA).write.mode("append").parquet(source)
        stream = articles.novel_articles(articles.good_articles(articles.from_files(spark, source)))
        articles.run_to_parquet(stream, out, mark)
    kept = [(r.url, r.date) for r in spark.read.parquet(out).collect()]
    assert sorted(kept, key=str) == sorted(
        [("u1", days(0)), ("u2", days(1)), ("u3", days(10)), ("old", days(-20)), (None, days(30))], key=str
    )


def test_blank_line_files(spark):
    path = scratch_path(spark, "blank")
    spark.createDataFrame([("one\ntwo\n\n\n\nthree\n",)], "v string").coalesce(1).write.text(path)
    assert sorted(r.text for r in files.read_blank_line_documents(spark, path).collect()) == ["one\ntwo", "three"]
    assert sorted(r.paragraph for r in files.read_paragraph_files(spark, path).collect()) == ["one", "three", "two"]


def test_category_split_at_first_tab(spark):
    path = scratch_path(spark, "tabs")
    spark.createDataFrame([("cat\ta\tb",)], "v string").write.text(path)
    assert tuple(files.read_category_lines(spark, path).first()) == ("cat", "a\tb")


MODELS = sorted(set(QUERIES) - set(ORACLES))


@pytest.mark.parametrize("name", MODELS)
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() > 0 or name == "segment_ambiguity"
    assert len(set(df.columns)) == len(df.columns)


def test_language_classifier_beats_the_majority(spark):
    scored = QUERIES["classify_language"](spark, SF).cache()
    right = scored.filter("target = prediction").count() / scored.count()
    largest = scored.groupBy("lang").count().agg(F.max("count")).first()[0] / scored.count()
    assert right > largest


def test_saved_preprocessor_gives_the_same_vectors(spark):
    assert QUERIES["preprocessor_roundtrip"](spark, SF).filter("same = 0").count() == 0


def test_topic_shares_sum_to_one(spark):
    sums = QUERIES["topic_model"](spark, SF).groupBy("doc_id").agg(F.sum("share").alias("s"))
    # A document without a known term has no shares.
    assert sums.filter((F.abs(F.col("s") - 1) > 1e-6) & (F.col("s") > 0)).count() == 0
    assert sums.filter("s > 0").count() > 0.9 * sums.count()


def test_word_vectors_are_learnt_on_every_core(spark):
    from lexispark.operators import ml

    rows = spark.createDataFrame([(f"w{i % 9} w{i % 5} w{i % 7}", "ab"[i % 2]) for i in range(300)], "text string, lang string")
    parts = {s.getNumPartitions() for s in ml.mlp_classifier(rows, "text", "lang").getStages() if hasattr(s, "getNumPartitions")}
    assert parts == {spark.sparkContext.defaultParallelism} != {1}
    found = ml.word_embeddings(rows.selectExpr("split(text, ' ') AS tokens"), "tokens").collect()
    assert {r.word for r in found} == {f"w{i}" for i in range(9)} and all(len(r.vector) == 32 for r in found)


def test_topic_likelihood_is_the_library_bound(spark, monkeypatch):
    """The library's own bound, which takes exponentials of the whole topic matrix per document, is not called."""
    from pyspark.ml.clustering import LDAModel

    from lexispark.operators import ml

    rows = [(i, " ".join(f"term{(i * j + j * j) % (7 + i % 3 * 20)}" for j in range(i % 40))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    models, fit, bound = [], ml.LDA.fit, LDAModel.logLikelihood
    monkeypatch.setattr(ml.LDA, "fit", lambda self, data: models.append((fit(self, data), data)) or models[-1][0])
    monkeypatch.setattr(LDAModel, "logLikelihood", lambda *_: pytest.fail("called"))
    _, _, got = ml.topic_model(df, "doc_id", "text", topics=3)
    model, data = models[0]
    assert got == pytest.approx(bound(model, data), rel=1e-4)
