"""Scores by batch: stopped, resumed, replaced, with several models."""

import pytest
from pyspark.sql import functions as F

from glossmill.plans.features import keyword_model, topic_scores
from glossmill.plans.scoring import drop_leftovers, score_batches, scored

SCHEMA = "url string, body string, month int"


@pytest.fixture
def articles(spark):
    return spark.createDataFrame([(f"u{i}", "border " * (i % 2), i % 4 or None) for i in range(40)], SCHEMA)


def scores(df):
    return topic_scores(df, keyword_model(["border"])).select("url", "immigration_score")


def said(spark, out, model="m"):
    return sorted((r.url, r.immigration_score, r.batch) for r in scored(spark, out, model).collect())


def test_a_stopped_run_goes_on(spark, articles, tmp_path):
    """Whether it was stopped between batches, in a batch, or after a batch was written but before it counted."""
    out, whole = str(tmp_path / "out"), str(tmp_path / "whole")
    assert scored(spark, out, "m") is None
    assert score_batches(articles, "month", whole, "m", scores) == 4
    assert score_batches(articles, "month", out, "m", scores, most=1) == 1

    def killed(df):
        scores(df).write.parquet(f"{out}/scores/left-by-a-killed-run")
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError, match="killed"):
        score_batches(articles, "month", out, "m", killed)
    assert len(said(spark, out)) == 10
    assert score_batches(articles, "month", out, "m", scores) == 3
    assert said(spark, out) == said(spark, whole) and len(said(spark, out)) == 40
    assert score_batches(articles, "month", out, "m", scores) == 0
    assert drop_leftovers(spark, out) == 1 and said(spark, out) == said(spark, whole)


def test_changed_batches_are_replaced(spark, articles, tmp_path):
    out = str(tmp_path / "out")
    score_batches(articles, "month", out, "m", scores)
    more = articles.union(spark.createDataFrame([("new", "border", 2)], SCHEMA))
    assert score_batches(more, "month", out, "m", scores) == 1
    got = said(spark, out)
    assert len(got) == 41 and ("new", 1.0, "2") in got and len({u for u, *_ in got}) == 41


def test_models_stand_side_by_side(spark, articles, tmp_path):
    out = str(tmp_path / "out")
    score_batches(articles, "month", out, "m", scores)
    score_batches(articles, "month", out, "other", lambda df: df.select("url", F.lit(0.5).alias("immigration_score")))
    assert {s for _, s, _ in said(spark, out, "other")} == {0.5} and {s for _, s, _ in said(spark, out)} == {0.0, 1.0}
