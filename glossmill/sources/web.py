"""Sitemaps and pages as tables. Fetching is given from outside."""

from __future__ import annotations

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import page_text

CONFIG = "outlet string, domain string, sitemap_templates array<string>, date_source string, crawl_delay int"
_PLACEHOLDERS = r"\{(year|month(:02d)?|day(:02d)?)\}"


def outlet_config(spark: SparkSession, text: str) -> DataFrame:
    """A row for each outlet of a YAML mapping; anything else is an error."""
    found = yaml.safe_load(text)
    if not found or not isinstance(found, dict):
        raise ValueError("the configuration is not a mapping of outlets")
    rows = [(k, v.get("domain"), list(v.get("sitemap_templates") or []), v.get("date_source"), int(v.get("crawl_delay") or 0)) for k, v in found.items()]
    return spark.createDataFrame(rows, CONFIG)


def sitemap_urls(templates: DataFrame) -> DataFrame:
    """``outlet, template, year, month`` to URLs: one for the month, or one for each of its days where the template has a day.

    An unknown placeholder is an error.
    """
    t, y, m = F.col("template"), F.col("year"), F.col("month")
    first = F.make_date(y, m, F.lit(1))
    daily = F.contains(t, F.lit("{day"))
    days = F.when(daily, F.sequence(first, F.last_day(first))).otherwise(F.array(first))
    rows = templates.withColumn("_d", F.explode(days))
    url = t
    for name, made in (("year", F.col("year")), ("month", F.month("_d")), ("day", F.dayofmonth("_d"))):
        url = F.replace(url, F.lit(f"{{{name}:02d}}"), F.lpad(made.cast("string"), 2, "0"))
        url = F.replace(url, F.lit(f"{{{name}}}"), made.cast("string"))
    unknown = F.regexp_extract(F.regexp_replace(t, _PLACEHOLDERS, ""), r"\{([^}]*)\}", 1)
    return rows.select("outlet", "year", "month", F.when(unknown == "", url).otherwise(F.raise_error(F.concat(F.lit("unknown placeholder: "), unknown))).alias("url"))


def sitemap_entries(spark: SparkSession, path: str) -> DataFrame:
    """``url, sitemap_date`` of sitemap files; malformed ones have no entries."""
    rows = spark.read.format("xml").option("rowTag", "url").option("mode", "PERMISSIVE").schema("loc string, lastmod string, _corrupt_record string").load(path)
    return rows.where("loc is not null and _corrupt_record is null").select(F.trim("loc").alias("url"), F.substring(F.trim(F.coalesce("lastmod", F.lit(""))), 1, 10).alias("sitemap_date"))


def extract_pages(pages: DataFrame, html: str = "html", url: str | None = None) -> DataFrame:
    """``pages`` with ``body`` and ``date``: main text and best date of each page (see ``blocks``), parsed in Arrow batches."""

    @F.pandas_udf("body string, date string")
    def parsed(texts: pd.Series, urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([page_text(t, u) for t, u in zip(texts, urls)], columns=["body", "date"])

    found = parsed(F.col(html), F.col(url) if url else F.lit(None).cast("string"))
    return pages.withColumn("_page", found).withColumn("body", F.col("_page.body")).withColumn("date", F.col("_page.date")).drop("_page")


def paragraphs(html: Column) -> Column:
    """Text of the paragraphs by patterns only; no entities, for pages of simple form."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", "")
    found = F.regexp_extract_all(bare, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))
    return F.array_join(F.transform(found, lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"<[^>]*>", " "), r"[ \t\n\r]+", " "))), "\n")


def compare_queries(texts: DataFrame, first: list[str], second: list[str], body: str = "body") -> DataFrame:
    """How many texts two keyword lists find, their difference in per cent of the first, and a verdict by bands of 5 and 15."""
    from ..functions.text import contains_any

    n = texts.agg(F.count_if(contains_any(F.col(body), first)).alias("n_first"), F.count_if(contains_any(F.col(body), second)).alias("n_second"))
    d = F.abs(F.try_divide(100.0 * (F.col("n_second") - F.col("n_first")), F.col("n_first")))
    return n.select("n_first", "n_second", F.round(d, 4).alias("diff_pct"), F.when(d < 5, "minor").when(d < 15, "moderate").otherwise("large").alias("verdict"))
