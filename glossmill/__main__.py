"""Command line: ``python -m glossmill clean|features|score|correlate ...``; each command reads tables and writes tables."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import align, inference
from .operators.cleaning import clean, cleaning_report
from .plans.features import article_features, stance_scores, topic_scores, usable
from .plans.scoring import score_batches, scored
from .shared import remove
from .sources.files import read_csv, write_csv


def _read(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, None) if path.rstrip("/").endswith((".csv", ".csv.gz")) else spark.read.parquet(path)


def _write(df: DataFrame, path: str) -> None:
    write_csv(df, path) if path.rstrip("/").endswith(".csv") else df.write.mode("overwrite").parquet(path)


def _clean(spark: SparkSession, a: argparse.Namespace) -> None:
    done = clean(_read(spark, a.articles))
    r = cleaning_report(done).first()
    print(f"words {r.words_before} -> {r.words_after}, {r.words_removed} removed ({r.removed_pct} %)")
    if not a.dry_run:
        _write(done.drop("words_before"), a.out)


def _features(spark: SparkSession, a: argparse.Namespace) -> None:
    _write(article_features(usable(_read(spark, a.articles), 0.0 if a.no_filter else a.threshold)), a.out)


def _score(spark: SparkSession, a: argparse.Namespace) -> None:
    """Without ``--resume`` scores begin anew."""
    module, _, name = a.model.partition(":")
    model = getattr(importlib.import_module(module), name)
    made = {"topic": lambda df: topic_scores(df, model).select("url", "immigration_score"), "stance": lambda df: stance_scores(df, model)}[a.kind]
    if not a.resume:
        remove(spark, a.out)
    n = score_batches(_read(spark, a.articles), a.by, a.out, a.model, made)
    found = scored(spark, a.out, a.model)
    print(f"{n} batches scored, {0 if found is None else found.count()} rows in all")


def _correlate(spark: SparkSession, a: argparse.Namespace) -> None:
    features, series = a.feature, _read(spark, a.series)
    joined = align.fiscal_year if a.fiscal else align.rolling_year
    rows = joined(_read(spark, a.articles), series, features).withColumn(a.outcome, F.col(a.outcome).cast("double"))
    _write(inference.spearman(rows, features, a.outcome), f"{a.out}/spearman")
    _write(inference.anova(rows, features, a.outcome), f"{a.out}/anova")
    _write(align.descriptives(rows, features), f"{a.out}/descriptives")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="glossmill", description="Tables end in .csv or are Parquet folders.")
    commands = top.add_subparsers(required=True)

    def command(name: str, run, **more: str) -> argparse.ArgumentParser:  # noqa: ANN001
        one = commands.add_parser(name, **more)
        one.add_argument("articles")
        one.add_argument("out")
        one.set_defaults(run=run)
        return one

    command("clean", _clean, help="take boilerplate out").add_argument("--dry-run", action="store_true", help="only say what would go")
    one = command("features", _features, help="features of articles")
    one.add_argument("--threshold", type=float, default=0.7, help="least topic score")
    one.add_argument("--no-filter", action="store_true", help="take all articles")
    one = command("score", _score, help="topic or stance scores by batch")
    one.add_argument("kind", choices=["topic", "stance"])
    one.add_argument("--model", required=True, help="module:function that makes the model")
    one.add_argument("--by", default="outlet", help="column whose values are batches")
    one.add_argument("--resume", action="store_true", help="keep batches that are there")
    one = command("correlate", _correlate, help="features against a series")
    one.add_argument("series")
    one.add_argument("--feature", action="append", required=True)
    one.add_argument("--outcome", "--hatecrime-col", default="net_migration", help="column of the series")
    one.add_argument("--fiscal", action="store_true", help="fiscal years instead of twelve months")
    return top


def main(words: list[str] | None = None) -> int:
    a = parser().parse_args(words)
    spark = SparkSession.builder.appName("glossmill").getOrCreate()
    a.run(spark, a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
