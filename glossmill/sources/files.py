"""Article tables as files: CSV, object stores, XLSX sheets and the annual series."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CORPUS = "outlet string, year int, month int, date string, url string, wordcount int, body string"
#: Months of quarter labels, and the year the series changed its method.
MONTHS = {"Mar": 3, "Jun": 6, "Sep": 9, "Dec": 12}
METHOD_CHANGE = 2020
COVID_YEAR = "2019/20"


def read_csv(spark: SparkSession, paths: str | list[str], schema: str | None = CORPUS, pattern: str | None = None) -> DataFrame:
    """Rows of CSV files with a header, any number, in any file system; quoted line ends, quotes and backslashes stay; only an empty field is null.

    ``file_name`` is where a row is from. ``pattern`` picks files of a folder.
    """
    reader = spark.read.options(header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE")
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(paths).withColumn("file_name", F.col("_metadata.file_name"))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(header=True, quote='"', escape='"').csv(path)


def write_months(df: DataFrame, path: str) -> None:
    """A folder for each outlet, year and month; only months that are in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("outlet", "year", "month").parquet(path)


def missing_months(months: DataFrame, written: DataFrame) -> DataFrame:
    """Months of the plan that the store doesn't have; only partition values are read."""
    return months.join(written.select("outlet", "year", "month").distinct(), ["outlet", "year", "month"], "left_anti")


def quarterly_series(rows: DataFrame, section: str = "Net migration") -> DataFrame:
    """Quarters of a sheet with ``row, flow, period, value``: the first unbroken block of the section, periods like ``YE Sep 16``.

    A sheet has a few hundred rows, so one task walks it.
    """
    here = F.trim("flow") == section
    order = Window.orderBy("row")
    first = F.min(F.when(here, F.col("row"))).over(Window.partitionBy())
    rows = rows.withColumn("_first", first).where(F.col("row") >= F.col("_first"))
    rows = rows.withColumn("_broken", F.sum(F.when(here, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("_broken = 0")
    period = F.trim("period")
    part = lambda i: F.regexp_extract(period, r"^YE\s+(Mar|Jun|Sep|Dec)\s+(\d{2})", i)
    month = F.element_at(F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv]), part(1))
    year = (F.lit(2000) + part(2).try_cast("int")).cast("int")
    found = rows.select(period.alias("ons_period"), year.alias("quarter_end_year"), month.cast("int").alias("quarter_end_month"), F.col("value").cast("string").try_cast("double").cast("long").alias("net_migration"))
    return found.where("quarter_end_month is not null").withColumn("methodology", F.when(F.col("quarter_end_year") >= METHOD_CHANGE, "LTIM").otherwise("IPS"))


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def sheet_rows(data: bytes, sheet: str = "1") -> list[tuple[int, str | None, str | None, str | None]]:
    """The first three cells of each row of a named XLSX sheet."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)] if "xl/sharedStrings.xml" in names else []
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        of = {s.get("name"): s.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iterfind("m:sheets/m:sheet", _NS)}
        if sheet not in of:
            raise ValueError(f"no sheet named {sheet}")
        out = []
        for row in ElementTree.fromstring(z.read("xl/" + links[of[sheet]].removeprefix("/xl/"))).iterfind("m:sheetData/m:row", _NS):
            cells: dict[str, str | None] = {}
            for c in row.findall("m:c", _NS):
                value = c.find("m:v", _NS)
                text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")) if c.get("t") == "inlineStr" else None if value is None else shared[int(value.text)] if c.get("t") == "s" else value.text
                cells[re.sub(r"\d", "", c.get("r"))] = text
            out.append((int(row.get("r")), cells.get("A"), cells.get("B"), cells.get("C")))
        return out


def read_sheet(spark: SparkSession, path: str, sheet: str = "1") -> DataFrame:
    """``row, flow, period, value`` of a small workbook, read by Spark and parsed in a task."""
    def parse(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                yield pd.DataFrame(sheet_rows(bytes(content), sheet), columns=["row", "flow", "period", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "row int, flow string, period string, value string")


def annual_series(rows: DataFrame, value: str = "Race_Hate_Crime_Excl_Met", exclude: str = COVID_YEAR) -> DataFrame:
    """Years like ``2021/22`` with their first year and the chosen column; the excluded year and blanks go."""
    label = F.trim(F.col("Year_Ending_March").cast("string"))
    start = F.regexp_extract(label, r"(\d{4})/(\d{2})", 1).try_cast("int")
    n = F.col(value).cast("string").try_cast("double")
    return rows.where(~F.contains(label, F.lit(exclude)) & start.isNotNull() & n.isNotNull()).select(label.alias("fy_label"), start.alias("fy_start_year"), n.cast("long").alias("race_hate_crimes"))
