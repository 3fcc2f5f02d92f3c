"""The paged source: lanes, pace, blocks and going on."""

import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from glossmill.sources import paged

CLIENT = "tests.paged_client:Scripted"


def asked(folder):
    """(month, page, time) of each request, in time order."""
    found = [f.split("-") for f in os.listdir(folder) if f.count("-") == 3]
    return sorted(((int(m), int(p), int(t) / 1e9) for _, m, p, t in found), key=lambda r: r[2])


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "asked").mkdir()
    return str(tmp_path / "asked")


def test_pages_are_parsed(spark, folder, tmp_path):
    answers = paged.crawl(spark, str(tmp_path / "out"), CLIENT, [(2016, 3), (2016, 4), (2016, 12)], lanes=2, pace=0, pause=0, folder=folder, pages=4)
    found = paged.articles_of(answers).orderBy("url").collect()
    assert [(r.url, r.month, r.section, r.wordcount) for r in found] == [(f"u2016-{m}-{p}", m, "s", 198 + p) for m in (3, 4) for p in (3, 4)]
    said = {r.month: (r.pages, r.n_read, r.bad_status, r.complete) for r in paged.ledger(spark.read.parquet(str(tmp_path / "out" / "answers"))).collect()}
    assert said == {3: (4, 4, None, True), 4: (4, 4, None, True), 12: (None, 0, 500, False)}
    # nothing is asked twice but the month that had a bad answer
    before = len(asked(folder))
    paged.crawl(spark, str(tmp_path / "out"), CLIENT, [(2016, 3), (2016, 4), (2016, 12)], lanes=2, pace=0, pause=0, folder=folder, pages=4)
    assert [(m, p) for m, p, _ in asked(folder)[before:]] == [(12, 1)]


def test_requests_of_a_lane_are_spaced(spark, folder):
    paged.read_pages(spark, CLIENT, [(2016, 1, 1), (2016, 2, 1)], lanes=1, pace=0.2, pause=0.5, folder=folder, pages=3).collect()
    times = asked(folder)
    gaps = [(a[0] == b[0], b[2] - a[2]) for a, b in zip(times, times[1:])]
    assert len(times) == 6 and all(gap >= (0.19 if same else 0.49) for same, gap in gaps)


def test_lanes_divide_the_months(spark, folder):
    frame = paged.read_pages(spark, CLIENT, [(2016, m, 1) for m in range(1, 8)], lanes=3, pace=0, pause=0, folder=folder, pages=1)
    assert frame.rdd.getNumPartitions() == 3 and frame.count() == 7


def test_a_block_stops_all_lanes_and_a_later_call_goes_on(spark, folder, tmp_path):
    out, months = str(tmp_path / "out"), [(2016, m) for m in range(1, 7)]
    options = {"lanes": 2, "pace": 0.05, "pause": 0.05, "folder": folder, "pages": 5, "block": "2016-1-3"}
    open(os.path.join(folder, "blocking"), "w").close()
    with pytest.raises(paged.BlockedError):
        paged.crawl(spark, out, CLIENT, months, **options)
    first = asked(folder)
    blocked = next(t for m, p, t in first if (m, p) == (1, 3))
    # the other lane makes at most the request that it is at
    assert sum(t > blocked for *_, t in first) <= 1
    kept = spark.read.parquet(f"{out}/answers")
    assert {(r.month, r.page) for r in kept.collect()} == {(m, p) for m, p, _ in first}
    os.remove(os.path.join(folder, "blocking"))
    answers = paged.crawl(spark, out, CLIENT, months, **options)
    assert sorted((r.month, r.page) for r in answers.collect()) == [(m, p) for m in range(1, 7) for p in range(1, 6)]
    again = asked(folder)[len(first) :]
    assert not {(m, p) for m, p, _ in again} & {(m, p) for m, p, _ in first if (m, p) != (1, 3)}


def test_answers_are_handed_on_one_by_one_and_read_without_their_month(spark, tmp_path):
    """What a task holds is a page, not all pages of its months."""
    rows = spark.range(12).selectExpr("2016 as year", "3 as month", "'d' as date", "'t' as title", "cast(id as string) as url", "'s' as section", "repeat('word ', 9) as body", "id")
    paged.record(rows, str(tmp_path / "recorded"), (F.col("id") / 2).cast("int") + 1)
    (file,) = (tmp_path / "recorded" / "year=2016" / "month=3").glob("*.parquet")
    assert [pq.ParquetFile(file).metadata.num_rows] == [6]
    reader = paged.PagedReader({"client": "glossmill.sources.paged:Recorded", "months": "2016-3-2", "recorded": str(tmp_path / "recorded"), "pace": "0"})
    batches = list(reader.read(reader.partitions()[0]))
    assert [(b.num_rows, *b.to_pylist()[0].values())[:6] for b in batches] == [(1, 2016, 3, n, 200, 6) for n in range(2, 7)]
