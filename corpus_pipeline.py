"""Documents through toxicity, near duplicates, repeated passages, benchmark leaks and mixing.

Every stage decides by row, a row being named by its doc_id and the xxhash64 of its text: rows that share a doc_id, or
have none, never share a fate for that. Stages take empty tables, null and empty texts and columns of any other name, and
all but the last return the columns that they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossmill.llm.decontam import decontaminate
from glossmill.llm.jaccard import similar_components
from glossmill.llm.mixing import mix
from glossmill.llm.scratch import drop, scope, scratch_dir, settled
from glossmill.llm.substring import dedup_substrings
from glossmill.llm.toxicity import score_toxicity


def _named(docs: DataFrame) -> DataFrame:
    """The rows as structs, beside the doc_id and the xxhash64 of the text that name them."""
    return docs.select(docs["doc_id"].cast("long").alias("id"), F.xxhash64(docs["text"].cast("string")).alias("sig"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier predicts to be toxic go; a null or empty text is scored as any other."""
    scored = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=True)
    return scored.where("predicted = 0").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts, the one with the smallest doc_id stays.

    Texts without words and rows without a doc_id are linked with nothing and stay. Rows that share a doc_id are
    judged apart; of those among them that are linked, the one with the least xxhash64 stays, once.
    """
    first = lambda: similar_components(docs, tied=False).where("is_first and n_shingles > 0 and doc_id is not null").select(F.col("doc_id").alias("id"), "sig").distinct()
    keep = settled(spark, first)  # names only; the tables that told them go
    wordless = F.col("row.doc_id").isNull() | ~F.coalesce(F.col("row.text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = _named(docs)
    once = F.row_number().over(Window.partitionBy("id", "sig").orderBy(F.xxhash64("row")))
    kept = rows.where(~wordless).join(keep, ["id", "sig"], "left_semi").withColumn("nth", once).where("nth = 1")
    return rows.where(wordless).select("row.*").union(kept.select("row.*"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that a document of smaller doc_id has too go; a row left with no word at all goes with them.

    n_chars, where there is such a column, is counted anew in rows that lost words.
    """
    cut = dedup_substrings(docs, carry=True).where("n_words = 0 or n_removed < n_words")
    chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None
    new = {"text": F.col("kept_text"), "n_chars": chars}
    return cut.select(*(new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a window of a benchmark item go; others of the same or no doc_id stay."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaked = settled(spark, lambda: decontaminate(docs, bench).where("contaminated").select("doc_id", "sig").distinct())
    rows = _named(docs)
    return rows.join(leaked, rows["id"].eqNullSafe(leaked["doc_id"]) & (rows["sig"] == leaked["sig"]), "left_anti").select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of the mix, with the number of copies to take of each; those with none go.

    Rows that repeat doc_id, text and source are matched with their numbers of copies one to one. The columns that are
    added (size, source_size, target, n_copies, taken) replace ones of their name.
    """
    added = ["size", "source_size", "target", "n_copies", "taken"]
    nth = lambda *order: F.row_number().over(Window.partitionBy("id", "sig", "source").orderBy(*order))
    mixed = mix(docs).where("n_copies > 0").select(F.col("doc_id").alias("id"), "sig", "source", *added)
    mixed = mixed.withColumn("nth", nth(F.col("n_copies").desc())).alias("m")
    rows = _named(docs).withColumn("source", F.col("row.source").cast("string"))
    rows = rows.withColumn("nth", nth(F.xxhash64("row"))).alias("r")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"m.{c}")) for c in ("id", "sig", "source", "nth")]
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in added]
    return rows.join(mixed, same[0] & same[1] & same[2] & same[3]).select(*kept, *(f"m.{c}" for c in added))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("benchmark_leaks", benchmark_leaks), ("mixing", mixing)]
#: SQL can't express the classifier; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES:
        path = scratch_dir(spark)
        with scope(spark):  # removes the tables that this stage's operators wrote, and no others
            stage(spark, docs, sf_dir).write.parquet(path)
        drop(spark, *before)
        docs, before = spark.read.parquet(path), [path]
    return docs
