"""The features of articles, and the tables made of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import model_input, word_count
from ..operators.lexicon import Lexicon, counts_of, dehumanisation, outrage
from ..operators.lexicons import DEHUMANISATION, OUTRAGE
from ..operators.markers import with_markers
from ..operators.sentences import DEMO_VALENCE, rule_scorer, sentiment
from ..operators.tables import stance_label


def usable(articles: DataFrame, threshold: float = 0.0, score: str = "immigration_score", least_words: int = 50) -> DataFrame:
    """Rows with a body of enough words and, where the column is there and a threshold is set, a score."""
    rows = articles.where(F.col("body").isNotNull() & (word_count(F.col("body")) >= least_words))
    return rows.where(F.col(score) >= threshold) if threshold and score in articles.columns else rows


def article_features(articles: DataFrame, scorer: Callable[[list[str]], list[float]] | None = None, dehum: Lexicon = DEHUMANISATION, outraged: Lexicon = OUTRAGE) -> DataFrame:
    """``articles`` without bodies, with all feature columns: one projection, no shuffle.

    Terms of both lexicons, markers and sentences are each counted in one pass over a text; lexicons are lists or tables of terms.
    """
    rows = sentiment(articles, scorer or rule_scorer(DEMO_VALENCE))
    rows = rows.withColumn("_lowered", F.lower(F.coalesce("body", F.lit(""))))
    rows, count = counts_of(rows.withColumn("word_count", word_count(F.col("_lowered"))), F.col("_lowered"), {"dehum": dehum, "outrage": outraged})
    words = F.col("word_count")
    rows = rows.withColumns({**dehumanisation(count("dehum"), words), **outrage(count("outrage"), words)})
    return with_markers(rows, F.col("body")).drop("_lowered", "_found", "body")


def _scored(inputs: str, fields: str, model: Callable[[], Callable[[list[str]], list]], batch_size: int):  # noqa: ANN202
    @F.pandas_udf(fields)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = model()  # loaded once by each worker
        for batch in batches:
            texts = list(batch)
            rows = [r for i in range(0, len(texts), batch_size) for r in score(texts[i : i + batch_size])]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in fields.split(", ")])

    return run(F.col(inputs))


def topic_scores(articles: DataFrame, model: Callable[[], Callable[[list[str]], list[tuple[float]]]], batch_size: int = 16, score: str = "immigration_score") -> DataFrame:
    """A topic score to four places for each article, by a model that is given from outside."""
    title = F.col("title") if "title" in articles.columns else None
    rows = articles.withColumn("_in", model_input(title, F.col("body")))
    return rows.withColumn(score, F.round(_scored("_in", "score double", model, batch_size)["score"], 4)).drop("_in")


def stance_scores(articles: DataFrame, model: Callable[[], Callable[[list[str]], list[tuple[float, float]]]], batch_size: int = 16, head: int = 3000) -> DataFrame:
    """``pro_score, anti_score, stance_label`` and url; labels by unrounded scores."""
    rows = articles.select("url", F.substring("body", 1, head).alias("_in"))
    rows = rows.select("url", _scored("_in", "pro double, anti double", model, batch_size).alias("_s"))
    return rows.select(F.round("_s.pro", 4).alias("pro_score"), F.round("_s.anti", 4).alias("anti_score"), stance_label(F.col("_s.pro"), F.col("_s.anti")).alias("stance_label"), "url")


def keyword_model(keywords: list[str]) -> Callable[[], Callable[[list[str]], list[tuple[float]]]]:
    """A stand-in for a topic model: the share of keywords that a text has."""
    return lambda: lambda texts: [(sum(k in (t or "").lower() for k in keywords) / max(1, len(keywords)),) for t in texts]
