"""Articles as they arrive: new files are cleaned, scored and written once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.cleaning import clean
from ..plans.features import article_features, usable
from .ledger import first_seen

#: Where a row of a file stream stands: by file and block, then by its number, which only Parquet tells (else by its hash).
_PLACE = {"_time": "file_modification_time", "_path": "file_path", "_block": "file_block_start"}


def process_new(spark: SparkSession, source: str, out: str, ledger: str, checkpoint: str, schema: str, transform: Callable[[DataFrame], DataFrame] | None = None, files_at_once: int = 200, file_format: str = "parquet", order: list[str] | None = None, expire_hours: float | None = None) -> StreamingQuery:
    """Processes files that earlier calls have not seen, then stops.

    Of each URL the first row is tried (by ``order``, or else by time and path of its file and place in it), once over all
    calls. Which URLs were seen is state of the stream (see ``ledger.first_seen``): a batch looks up its own. Every URL tried goes to
    the table ``ledger`` with its batch, kept or not, for readers; the stream never reads it. A batch that is run again, after a
    loss of the driver, replaces what it wrote before, so each row is written once.
    """
    transform = transform or (lambda df: article_features(usable(clean(df))))
    incoming = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).format(file_format).load(source)
    number = F.col("_metadata.row_index") if file_format == "parquet" else F.xxhash64(*incoming.columns)
    placed = incoming.select("*", *(F.col(f"_metadata.{c}").alias(n) for n, c in _PLACE.items()), number.alias("_row"))
    fresh = first_seen(placed, "url", order or [*_PLACE, "_row"], expire_hours).drop(*_PLACE, "_row")

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        try:
            by_batch = lambda rows: rows.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch")
            by_batch(transform(df)).parquet(out)
            by_batch(df.select("url")).parquet(ledger)
        finally:
            df.unpersist()

    return fresh.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(stream: DataFrame, key: str = "url", time: str | None = None, late: str = "7 days") -> DataFrame:
    """The first row of each key of a stream; with a time column, state is dropped after ``late``."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if time else stream.dropDuplicates([key])


def windowed_counts(events: DataFrame, time: str, key: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows and values by time window and key with a watermark; an addition to what the surveyed tools have."""
    return events.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("begins"), key, "n", "total")
