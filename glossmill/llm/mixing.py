"""Mixing sources to target weights by entropy balancing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

#: Weights of the sources in code point order, null last, repeating.
WEIGHTS = (5, 2, 1)
#: Most copies of a document, and of a source's words.
MOST = 3
#: Parts that documents of one source and size are ranked in, so that no class meets in one task.
PARTS = 64
ROUNDS, CLOSE = 60, 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size`` with ``target``: shares of the whole by weight, at most ``most`` times a source's size.

    What a source can't take is shared among the others by weight, until none is above. Sources
    in order of size / weight fill up one after another, so the level comes from running sums:
    with the first j full, the rest get (total - caps of those) / (their weights) per weight.
    """
    spark = sources.sparkSession
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double"))
    rows = rows.withColumn("cap", (F.col("source_size") * most).cast("double"))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("level", F.try_divide(left, F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))).withColumn("place", F.row_number().over(filling))
    short = F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("place"))
    rows = rows.withColumn("open", F.min(short).over(every))  # the first source that the level doesn't fill
    final = F.min(F.when(F.col("place") == F.col("open"), F.col("level"))).over(every)
    target = F.when(F.coalesce(F.col("place") < F.col("open"), F.lit(True)), F.col("cap")).otherwise(F.col("weight") * final)
    return rows.select("source", "source_size", target.alias("target"))


def rates(classes: DataFrame, goals: DataFrame, most: int = MOST) -> DataFrame:
    """``source, size, n`` with the tilted rate of each class of documents.

    Among rates between 0 and ``most`` whose words meet the source's target, these have the least
    relative entropy to one copy each: their odds are tilted exponentially by size,
    ``rate = most / (1 + (most - 1) * exp(-x * size / mean))``. ``x`` minimises the convex dual; each
    Newton iteration is one grouped sum over the classes, kept inside a shrinking bracket. Rates are
    rounded to 9 places, so the order of a sum can't show.
    """
    spark = classes.sparkSession
    at = written(goals.select("source", "source_size", "target", F.lit(0.0).alias("x"), F.lit(-1e4).alias("low"), F.lit(1e4).alias("high"), (F.col("target") >= most * F.col("source_size") * (1 - 1e-12)).alias("done")))
    known = classes.join(classes.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.greatest(F.sum("n"), F.lit(1))).alias("mean")).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    known = written(known.withColumn("z", F.coalesce(F.try_divide("size", "mean"), F.lit(0.0))).drop("mean"))

    def rate(x: Column) -> Column:
        return F.lit(float(most)) / (1 + (most - 1) * F.exp(F.least(F.lit(700.0), -x * F.col("z"))))

    pair = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    for _ in range(ROUNDS):
        r = rate(F.col("x"))
        sums = known.alias("k").join(at.where("not done").alias("a"), pair("k", "a")).select("a.source", (F.col("n") * F.col("size") * r).alias("words"), (F.col("n") * F.col("size") * F.col("z") * r * (1 - r / most)).alias("slope"))
        sums = sums.groupBy("source").agg(F.sum("words").alias("words"), F.sum("slope").alias("slope"))
        gap = F.col("words") - F.col("target")
        low, high = F.when(gap < 0, F.col("x")).otherwise(F.col("low")), F.when(gap > 0, F.col("x")).otherwise(F.col("high"))
        stepped = at.alias("a").join(sums.alias("g"), pair("a", "g"), "left").select("a.*", "words", "slope", low.alias("l"), high.alias("h"), F.try_divide(gap, "slope").alias("move"))
        newton = F.col("x") - F.col("move")
        x = F.when((newton > F.col("l")) & (newton < F.col("h")), newton).otherwise((F.col("l") + F.col("h")) / 2)
        done = F.col("done") | F.col("words").isNull() | (F.abs(F.col("words") - F.col("target")) <= CLOSE * F.col("target"))
        at = written(stepped.select("source", "source_size", "target", F.when(done, F.col("x")).otherwise(x).alias("x"), F.when(done, F.col("low")).otherwise(F.col("l")).alias("low"), F.when(done, F.col("high")).otherwise(F.col("h")).alias("high"), done.alias("done")))
        if at.where("not done").isEmpty():
            break
    full = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    return known.alias("k").join(at.alias("a"), pair("k", "a")).select("k.source", "size", "n", "source_size", "target", F.when(full, F.lit(float(most))).otherwise(F.round(rate(F.col("x")), 9)).alias("rate"))


def copies(classes: DataFrame, most: int = MOST) -> DataFrame:
    """Whole copies of each class, ``taken_n``, from its rate.

    Rates are summed up over the classes of a source, largest documents first, and each class
    gets the whole steps of that sum; then what is still missing from the target, or too much,
    is put right by the smallest documents that have room.
    """
    same = Window.partitionBy("source").orderBy(F.col("size").desc())
    upto = F.sum(F.col("n") * F.col("rate")).over(same.rowsBetween(Window.unboundedPreceding, 0))
    rows = classes.withColumn("upto", F.round(upto, 6)).withColumn("before", F.coalesce(F.lag("upto").over(same), F.lit(0.0)))
    rows = rows.withColumn("first", F.floor(F.col("upto") + 0.5) - F.floor(F.col("before") + 0.5))
    rows = rows.withColumn("first", F.least(F.greatest("first", F.lit(0)), F.col("n") * most))
    whole = Window.partitionBy("source")
    rows = rows.withColumn("gap", F.round(F.col("target") - F.sum(F.col("first") * F.col("size")).over(whole)).cast("long"))
    room = F.when(F.col("gap") > 0, F.col("n") * most - F.col("first")).otherwise(F.col("first"))
    rows = rows.withColumn("room", F.when(F.col("size") > 0, room).otherwise(F.lit(0)))
    small = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.col("room") * F.col("size")).over(small), F.lit(0))
    more = F.least(F.col("room"), F.greatest(F.lit(0), F.coalesce(F.floor(F.try_divide(F.abs("gap") - used, "size")), F.lit(0))))
    return rows.withColumn("taken_n", (F.col("first") + F.signum("gap") * more).cast("long")).select("source", "size", "n", "source_size", "target", "rate", "taken_n")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, parts: int = PARTS) -> DataFrame:
    """How often each document goes into a mix whose sources have their target share of the words.

    Returns ``doc_id, source, size, source_size, target, rate, n_copies, taken, sig``; ``taken`` is
    size times copies, 0 to ``most`` of them; ``sig`` is the xxhash64 of the text. Same input, same result.

    Documents of one source and size are a class with one rate; the classes, no more than the
    lengths that occur, are all that the iterations read. A class's copies are dealt to its
    documents by rank: by sums over ``parts`` hashed parts of it, then within each, so a source
    or class that holds most rows is never sorted in one task.

    Rates are bounded by ``most``, as every document may be taken that often at most; without the bound they
    would be plain exponentials of the size. The few rows for each source (not for each document) are ranked in
    one task, and the distinct sizes of a source in one.

    A null source is a source of its own, the last; a null or empty text has size 0 and takes 0
    words; a null doc_id is ranked as any other; repeated rows count each, and copies that differ among them go to any; an empty table gives
    an empty result; further columns are ignored.
    """
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), F.xxhash64(F.col("text").cast("string")).alias("sig")))
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.col("sig"), F.lit(17)), F.lit(parts)).cast("int")
    rows = rows.withColumn("part", part)
    in_parts = written(rows.groupBy("source", "size", "part").agg(F.count("*").alias("m")))
    classes = written(in_parts.groupBy("source", "size").agg(F.sum("m").alias("n")))
    goals = targets(classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most)
    dealt = written(copies(rates(classes, goals, most), most))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = rows.alias("r").join(in_parts.withColumn("before", before).alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.size") == F.col("p.size")) & (F.col("r.part") == F.col("p.part")))
    place = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy(F.xxhash64("doc_id", "sig"), "doc_id", "sig"))
    ranked = ranked.select("r.*", "before").withColumn("place", F.col("before") + place)
    joined = ranked.alias("r").join(dealt.alias("d"), F.col("r.source").eqNullSafe(F.col("d.source")) & (F.col("r.size") == F.col("d.size")))
    n = (F.floor(F.col("taken_n") / F.col("n")) + F.when(F.col("place") <= F.col("taken_n") % F.col("n"), 1).otherwise(0)).cast("long")
    return joined.select("r.doc_id", "r.source", "r.size", "d.source_size", "d.target", "d.rate", n.alias("n_copies"), (n * F.col("r.size")).alias("taken"), "r.sig")
