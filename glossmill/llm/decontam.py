"""Benchmark decontamination by winnowed fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bitfilter
from . import words as W
from .scratch import partitions, written
from .skew import heavy_keys, spread_join


def _context(h: np.ndarray, offsets: np.ndarray, doc: np.ndarray, at: np.ndarray, before: int, after: int) -> list[np.ndarray]:
    """Word hashes around positions, document ends as empty slices."""
    lo = np.maximum(at - before, offsets[doc])
    hi = np.minimum(at + after, offsets[doc + 1])
    return [h[a:b] for a, b in zip(lo, hi)]


def _fingerprints(h: np.ndarray, offsets: np.ndarray, window: int, k: int, shorter: list[int], whole: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, positions, hashes): length 0 for winnowed k-grams, which are the least of some window, else whole n-grams of an item's n < window words."""
    _, at, fp = W.least(h, offsets, window, k)
    fresh = np.ones(len(at), bool)
    fresh[1:] = at[1:] != at[:-1]
    yield 0, at[fresh], fp[fresh]
    counts = np.diff(offsets)
    for n in shorter:
        at = offsets[:-1][counts == n] if whole else W.gram_starts(offsets, n)
        yield n, at, (W.grams(h, n)[at] if len(at) else np.empty(0, np.uint64)) ^ np.uint64(n)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """Words of ``docs`` inside passages of ``window`` words that also stand in ``benchmark``.

    Returns ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` and ``spans``
    (array of start, end in words, disjoint), ``items`` (their ids as sorted strings), ``sig``
    (xxhash64 of the text, which with the doc_id names a row up to repeats).

    Both sides keep the least k-gram hash of every window, so a shared passage of ``window``
    words or more shares a kept hash at the same place in it. Fingerprints are joined, and each
    hit is extended word by word to both sides as far as a window that contains it can reach; it
    counts from ``window`` words. An item of fewer words, but not none, is one window, found by
    the hash of all its words. Words are compared by 64-bit hashes.

    Documents pass through once and no text is shuffled: fingerprints that a fixed-size bit
    filter of the benchmark's lets through are joined. Items that have the same words around a fingerprint are one row of
    the index, with a list of their ids; a fingerprint that documents are full of ("yes" as an item) is dealt over as many tasks as
    it fills. A null text has no words; a null doc_id stays null; each row is judged by itself,
    repeated rows too; an item with a null item_id can't be named and is left out; an empty benchmark
    leaves all clean; further columns are ignored.
    """
    spark = docs.sparkSession
    reach = window - k
    item = F.col("item_id").cast("string").alias("item_id")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.small(batches):
            words = W.split(batch.column("text"), W.ALNUM, lower=True)
            h, doc = W.hashes(words), words.doc_of()
            for n, at, fp in _fingerprints(h, words.offsets, window, k, list(range(1, window)), whole=True):
                ctx = _context(h, words.offsets, doc[at], at, 0 if n else reach, n or k + reach)
                yield pa.RecordBatch.from_pydict({
                    "item_id": batch.column("item_id").take(pa.array(doc[at])),
                    "n": pa.array(np.full(len(at), n), pa.int32()),
                    "fp": pa.array(W.signed(fp), pa.int64()),
                    "item_left": pa.array(np.minimum(at - words.offsets[doc[at]], 0 if n else reach), pa.int32()),
                    "item_words": pa.array([W.signed(c) for c in ctx], pa.list_(pa.int64())),
                })

    bench = benchmark.where("item_id is not null").select(item, F.col("text").cast("string").alias("text")).mapInArrow(index, "item_id string, n int, fp long, item_left int, item_words array<long>")
    bench = written(bench.groupBy("fp", F.col("n").alias("item_n"), "item_left", "item_words").agg(F.collect_set("item_id").alias("item_ids")))
    shorter = sorted(r.item_n for r in bench.where("item_n > 0").select("item_n").distinct().collect())  # at most window - 1 lengths
    held = spark.sparkContext.broadcast(bitfilter.build(bench, F.col("fp")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in W.small(batches):
            words = W.split(batch.column("text"), W.ALNUM, lower=True)
            h, doc = W.hashes(words), words.doc_of()
            found: list[list] = [[] for _ in range(batch.num_rows)]
            for n, at, fp in _fingerprints(h, words.offsets, window, k, shorter, whole=False):
                ok = bitfilter.passes(bits, fp)
                at, fp = at[ok], fp[ok]
                of, first = doc[at], words.offsets[doc[at]]
                ctx = _context(h, words.offsets, of, at, 0 if n else reach, n or k + reach)
                left = np.minimum(at - first, 0 if n else reach)
                for d, p, f, lft, c in zip(of.tolist(), (at - first).tolist(), W.signed(fp).tolist(), left.tolist(), ctx):
                    found[d].append({"n": n, "fp": f, "pos": p, "left": lft, "words": W.signed(c).tolist()})
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "sig": batch.column("sig"),
                "n_words": pa.array(words.counts, pa.int64()),
                "found": pa.array(found, pa.list_(pa.struct([("n", pa.int32()), ("fp", pa.int64()), ("pos", pa.int32()), ("left", pa.int32()), ("words", pa.list_(pa.int64()))]))),
            })

    scanned = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("sig", F.xxhash64("text")).mapInArrow(scan, "doc_id long, sig long, n_words long, found array<struct<n:int,fp:long,pos:int,left:int,words:array<long>>>")
    scanned = written(scanned.withColumn("row", F.monotonically_increasing_id()))
    hits = scanned.select("row", F.explode("found").alias("f")).select("row", "f.*")
    n = partitions(spark)
    hits = spread_join(hits, bench, "fp", heavy_keys(hits, "fp", hits.count(), n)).where("n = item_n")

    # the k-gram, or the whole short item, starts in the context after the words on its left
    size = F.when(F.col("n") > 0, F.col("n")).otherwise(F.lit(k))

    def same(i, j):  # noqa: ANN001, ANN202
        return F.get("words", F.col("left") + i) == F.get("item_words", F.col("item_left") + j)

    steps = F.sequence(F.lit(1), F.lit(max(reach, 1)))
    run = lambda far: F.aggregate(steps, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, i: F.struct((s["n"] + F.when(s["go"] & far(i), 1).otherwise(0)).alias("n"), (s["go"] & far(i)).alias("go")))["n"]
    on_left = lambda i: (i <= F.col("left")) & (i <= F.col("item_left")) & F.coalesce(same(-i, -i), F.lit(False))
    on_right = lambda i: F.coalesce(same(size + i - 1, size + i - 1), F.lit(False))
    core = F.slice("words", F.col("left") + 1, size) == F.slice("item_words", F.col("item_left") + 1, size)
    hits = hits.where(core).withColumn("l", F.when(F.col("n") > 0, 0).otherwise(run(on_left))).withColumn("r", F.when(F.col("n") > 0, 0).otherwise(run(on_right)))
    hits = hits.where((F.col("n") > 0) | (F.col("l") + F.col("r") + k >= window))
    spans = hits.select("row", "item_ids", (F.col("pos") - F.col("l")).alias("start"), (F.col("pos") + size + F.col("r")).alias("end"))
    order = Window.partitionBy("row").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.select("row", "start", "end").distinct().withColumn("fresh", F.coalesce((F.col("start") > reached).cast("int"), F.lit(1)))
    islands = islands.withColumn("island", F.sum("fresh").over(order)).groupBy("row", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    islands = islands.groupBy("row").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    by_doc = islands.join(spans.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("items")), "row")
    none = F.array().cast("array<string>")
    items = F.coalesce("items", none)
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return scanned.drop("found").join(by_doc, "row", "left").select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"), items.alias("items"), "sig",
    )
