"""Scores written batch by batch, so that a run that was stopped goes on where it was and every row is scored once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import exists, remove

MANIFEST = "model string, batch string, attempt string, n long, digest long, seq long"


def _manifest(spark: SparkSession, out: str) -> DataFrame:
    if not exists(spark, f"{out}/manifest"):
        return spark.createDataFrame([], MANIFEST)
    rows = spark.read.schema(MANIFEST).parquet(f"{out}/manifest")
    last = Window.partitionBy("model", "batch").orderBy(F.col("seq").desc())  # a row for each time that a batch was written
    return rows.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth")


def score_batches(articles: DataFrame, by: str, out: str, model: str, score: Callable[[DataFrame], DataFrame], key: str = "url", most: int | None = None) -> int:
    """Scores those batches of ``articles`` that ``out`` doesn't have from this model as they are now; returns how many.

    A batch is the rows with one value of ``by``, which should be what the table is partitioned by, so that a batch reads its own
    files only. One scan of keys tells each batch's size and a digest of its keys. A batch is written under a name of
    its own, then a row of the manifest says that it counts, in place of an earlier one of that model and batch; what a
    killed run has left without such a row is never read. Batches whose size and digest are in the manifest are passed over;
    others are scored anew and replace what was there; those that the table no longer has stay. ``most`` ends the call after so many.
    """
    spark = articles.sparkSession
    label = F.coalesce(F.col(by).cast("string"), F.lit(""))
    known = {r.batch: r for r in _manifest(spark, out).where(F.col("model") == model).collect()}
    now = articles.groupBy(label.alias("batch")).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(key)).alias("digest")).orderBy("batch").collect()
    todo = [r for r in now if r.batch not in known or (known[r.batch].n, known[r.batch].digest) != (r.n, r.digest)][:most]
    for r in todo:
        attempt = uuid.uuid4().hex
        rows = articles.where(F.col(by).isNull() | (F.col(by).cast("string") == "") if r.batch == "" else F.col(by) == F.lit(r.batch).cast(articles.schema[by].dataType))
        score(rows).write.parquet(f"{out}/scores/{attempt}")
        seq = known[r.batch].seq + 1 if r.batch in known else 0
        spark.createDataFrame([(model, r.batch, attempt, r.n, r.digest, seq)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{out}/manifest")
        if r.batch in known:
            remove(spark, f"{out}/scores/{known[r.batch].attempt}")
    return len(todo)


def scored(spark: SparkSession, out: str, model: str) -> DataFrame | None:
    """All scores of a model that count, with ``model`` and ``batch``; None where there are none yet."""
    rows = _manifest(spark, out).where(F.col("model") == model).orderBy("batch").collect()
    found = None
    for r in rows:
        one = spark.read.parquet(f"{out}/scores/{r.attempt}").withColumns({"model": F.lit(r.model), "batch": F.lit(r.batch)})
        found = one if found is None else found.unionByName(one, allowMissingColumns=True)
    return found


def drop_leftovers(spark: SparkSession, out: str) -> int:
    """Removes what killed runs have left in ``out``; call it when no run is on. Returns how many folders went."""
    counted = {r.attempt for r in _manifest(spark, out).select("attempt").collect()}
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/scores")
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    left = [s.getPath() for s in (store.listStatus(at) if store.exists(at) else []) if s.getPath().getName() not in counted]
    for path in left:
        store.delete(path, True)
    return len(left)
