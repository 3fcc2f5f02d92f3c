"""A paged interface as a Spark data source: months dealt to lanes, a clock for each lane, and an abort that keeps what was read.

Requests are made by a client given from outside, named ``module:Class``. It is made in the task with the source's options and
answers ``get(year, month, page)`` with a status and a text. Each answer, good or bad, is a row, so that the table of answers is
also the ledger of what was tried.
"""

from __future__ import annotations

import importlib
import json
import re
import time
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..shared import exists, remove

ANSWERS = "year int, month int, page int, status int, pages int, json string"
RESULTS = "response struct<pages:int,results:array<struct<webTitle:string,webUrl:string,webPublicationDate:string,sectionId:string,fields:struct<wordcount:string,bodyText:string>>>>"
ROWS = pa.schema([("year", pa.int32()), ("month", pa.int32()), ("page", pa.int32()), ("status", pa.int32()), ("pages", pa.int32()), ("json", pa.string())])
OK, BLOCKED = 200, 403
#: Bytes from which a row group of recorded pages ends.
ROW_GROUP = 1 << 20

Month = tuple[int, int]


class BlockedError(RuntimeError):
    """The interface refuses further requests; what was read until then is in the ledger."""


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"[a-z][a-z0-9+.-]*:/", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class Lane(InputPartition):
    """Months that one task asks for, one after the other, each from a page on."""

    def __init__(self, months: list[tuple[int, int, int]]) -> None:
        self.months = months


class Pace:
    """At least ``gap`` seconds between two requests of a lane."""

    def __init__(self, gap: float) -> None:
        self.gap, self.last = gap, None

    def wait(self) -> None:
        now = time.monotonic()
        if self.last is not None and now < self.last + self.gap:
            time.sleep(self.last + self.gap - now)
        self.last = time.monotonic()


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)

    def partitions(self) -> list[Lane]:
        months = [tuple(map(int, m.split("-"))) for m in self.options["months"].split(",") if m]
        lanes = max(1, min(int(self.options.get("lanes", "1")), len(months)))
        return [Lane(months[i::lanes]) for i in range(lanes)]

    def read(self, lane: Lane) -> Iterator[pa.RecordBatch]:
        """A batch for each answer: tuples would be held until there are as many as a batch of Spark's has rows, whatever their size."""
        for answer in self.answers(lane):
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(answer, ROWS)], schema=ROWS)

    def answers(self, lane: Lane) -> Iterator[tuple]:
        module, _, name = self.options["client"].partition(":")
        client = getattr(importlib.import_module(module), name)(self.options)
        pace, pause = Pace(float(self.options.get("pace", "0.1"))), float(self.options.get("pause", "0.5"))
        marker = self.options.get("marker")
        for nth, (year, month, page) in enumerate(lane.months):
            if nth:
                time.sleep(pause)
            last = page
            while page <= last:
                if marker and self._is_marked(marker):
                    return
                pace.wait()
                status, text = client.get(year, month, page)
                if status != OK:
                    yield year, month, page, status, None, None
                    if status == BLOCKED:
                        if marker:
                            self._mark(marker)
                        return
                    break
                last = int(json.loads(text)["response"].get("pages") or 0)
                yield year, month, page, status, last, text
                page += 1

    @staticmethod
    def _is_marked(path: str) -> bool:
        store, at = _store(path)
        return store.get_file_info(at).type != fs.FileType.NotFound

    @staticmethod
    def _mark(path: str) -> None:
        store, at = _store(path)
        with store.open_output_stream(at) as out:
            out.write(b"blocked")


class PagedSource(DataSource):
    """Options: ``client``; ``months`` as ``year-month-page,...``; ``lanes`` (1); seconds of ``pace`` between requests of a lane (0.1) and of
    ``pause`` between its months (0.5); ``marker``, a shared file that a block makes and that stops all lanes. The client gets all options."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return ANSWERS

    def reader(self, schema: object) -> PagedReader:
        return PagedReader(self.options)


def read_pages(spark: SparkSession, client: str, months: list[tuple[int, int, int]], lanes: int = 4, **options: object) -> DataFrame:
    """Answers for ``months`` (year, month, first page to ask for): a task for each lane, which is at most one request at a time."""
    spark.dataSource.register(PagedSource)
    said = {"client": client, "months": ",".join(f"{y}-{m}-{p}" for y, m, p in months), "lanes": lanes} | options
    return spark.read.format("paged").options(**{k: str(v) for k, v in said.items()}).load()


def open_months(answers: DataFrame | None, months: list[Month]) -> list[tuple[int, int, int]]:
    """Months that aren't complete, with the first page that is missing; a month without an answer begins at page 1."""
    known: dict[Month, tuple[int, int]] = {}
    if answers is not None:
        good = answers.where(F.col("status") == OK).groupBy("year", "month").agg(F.max("page").alias("page"), F.max_by("pages", "page").alias("pages"))
        known = {(r.year, r.month): (r.page, r.pages) for r in good.collect()}  # a row for each month of the calendar
    return [(*m, known[m][0] + 1 if m in known else 1) for m in months if m not in known or known[m][0] < known[m][1]]


def crawl(spark: SparkSession, out: str, client: str, months: list[Month], lanes: int = 4, **options: object) -> DataFrame:
    """Asks for all pages of ``months`` that ``out`` doesn't have, adds the answers to it, and returns all good ones.

    If the interface blocks, all lanes stop before their next request, what they have read is written, and then ``BlockedError``
    is raised. A later call goes on with the pages that are missing. Any other bad answer ends its month, which the next call takes up
    again. Answers are written by one committed job, so a call that is lost leaves none of its own.
    """
    marker = f"{out}/_blocked"
    remove(spark, marker)
    spark.range(0).select(*(F.lit(None).cast(k).alias(c) for c, k in (x.split(" ") for x in ANSWERS.split(", ")))).write.mode("append").parquet(f"{out}/answers")
    have = spark.read.schema(ANSWERS).parquet(f"{out}/answers")
    todo = open_months(have, months)
    if todo:
        read_pages(spark, client, todo, lanes, marker=marker, **options).write.mode("append").parquet(f"{out}/answers")
    if exists(spark, marker):
        raise BlockedError(f"the interface blocks; {out} has all answers until then")
    return spark.read.schema(ANSWERS).parquet(f"{out}/answers").where(F.col("status") == OK)


def ledger(answers: DataFrame) -> DataFrame:
    """For each month: pages it has, pages read, the last bad status, and whether it is complete."""
    bad = F.max_by(F.when(F.col("status") != OK, F.col("status")), F.when(F.col("status") != OK, F.col("page")))
    found = answers.groupBy("year", "month").agg(F.max("pages").alias("pages"), F.count_distinct(F.when(F.col("status") == OK, F.col("page"))).alias("n_read"), bad.alias("bad_status"))
    return found.withColumn("complete", F.coalesce(F.col("n_read") >= F.col("pages"), F.lit(False)))


def articles_of(answers: DataFrame, least_words: int = 200) -> DataFrame:
    """Articles of good answers that have a body and ``least_words`` words or more by the interface's own count."""
    rows = answers.select("year", "month", F.explode(F.from_json("json", RESULTS)["response"]["results"]).alias("r"))
    words = F.coalesce(F.col("r.fields.wordcount").try_cast("int"), F.lit(0))
    kept = rows.where((words >= least_words) & (F.length("r.fields.bodyText") > 0))
    return kept.select("year", "month", F.col("r.webPublicationDate").alias("date"), F.col("r.webTitle").alias("title"), F.col("r.webUrl").alias("url"), F.col("r.sectionId").alias("section"), words.alias("wordcount"), F.col("r.fields.bodyText").alias("body"))


class Recorded:
    """A client over answers that ``record`` has kept. Of a month's file, only the row group with the page is read."""

    def __init__(self, options: dict[str, str]) -> None:
        from pyarrow import dataset

        self.store, self.root = _store(options["recorded"])
        self.dataset, self.month, self.found = dataset, None, None

    def get(self, year: int, month: int, page: int) -> tuple[int, str | None]:
        if self.month != (year, month):
            at = f"{self.root}/year={year}/month={month}"
            some = self.store.get_file_info(at).type != fs.FileType.NotFound
            self.month, self.found = (year, month), self.dataset.dataset(at, filesystem=self.store, format="parquet") if some else None
        if self.found is None:
            return 404, None
        found = self.found.to_table(["json"], filter=self.dataset.field("page") == page)
        return (OK, found.column("json")[0].as_py()) if found.num_rows else (404, None)


def record(articles: DataFrame, out: str, page: Column) -> None:
    """Answers as the interface gives them, made from ``articles`` (year, month, date, title, url, section, body), a folder for each month.

    ``page`` numbers an article's page within its month from 1; a page's articles meet in one row, so it has to be small. A month's pages lie
    in order in small row groups, so that one can be read without the others.
    """
    fields = F.struct(F.regexp_count("body", F.lit(r"(?U)\S+")).cast("string").alias("wordcount"), F.col("body").alias("bodyText"))
    item = F.struct(F.col("title").alias("webTitle"), F.col("url").alias("webUrl"), F.col("date").alias("webPublicationDate"), F.col("section").alias("sectionId"), fields.alias("fields"))
    pages = articles.withColumn("page", page).groupBy("year", "month", "page").agg(F.collect_list(item).alias("results"))
    last = pages.groupBy("year", "month").agg(F.max("page").alias("pages"))
    said = pages.join(last, ["year", "month"]).select("year", "month", "page", F.to_json(F.struct(F.struct("pages", "results").alias("response"))).alias("json"))
    rows = said.repartition("year", "month").sortWithinPartitions("year", "month", "page")
    rows.write.option("parquet.block.size", ROW_GROUP).option("parquet.page.size.row.check.min", 1).option("parquet.block.size.row.check.min", 1).partitionBy("year", "month").parquet(out)
