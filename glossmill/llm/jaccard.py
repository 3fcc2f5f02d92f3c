"""Exact n-gram Jaccard join of documents, by skipping within and between sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bitfilter
from . import words as W
from .cells import cell_counts
from .components import components
from .scratch import partitions, written
from .skew import heavy_keys, spread_join

#: Cells that the documents of shingles are counted in, 2**21; any number gives the same links.
CELL_BITS = 21
#: Pairs that a task remembers to have handed on, before it starts afresh.
REMEMBERED = 1_000_000
#: Members of an index list that a task takes as left sides; longer lists are compared in several tasks.
LEFT_AT_ONCE = 20_000
#: Rows of an index list that a task holds to leave out those that can be linked with none of the others; longer lists stay as they are.
JUDGED = 1_000_000
#: Rounds in which sets try one partner only, before all that is left is compared.
ROUNDS = 3


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, ascending; the whole sequence where there are fewer words."""
    words = W.split(texts, lower=True)
    h, at = W.hashes(words), words.offsets.tolist()
    g = W.grams(h, size)
    out = []
    for a, b in zip(at, at[1:]):
        if b - a >= size:
            out.append(np.unique(g[a : b - size + 1]))
        else:
            out.append(W.grams(h[a:b], b - a) ^ np.uint64(b - a) if b > a else np.empty(0, np.uint64))
    return out


def _pairable(token: np.ndarray, n: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which rows, sorted by token and size, have another row of their token that they can be linked with (``_possible``).

    From a row's size and place follows the largest size it can be linked with; two rows can be linked if neither is above the other's.
    So of the rows that are not above a row's own, the one that reaches farthest decides, or the second where the row itself is among them.
    """
    first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(token)))) << 32
    upto = np.maximum(np.minimum(5 * n // 4, 9 * (n - pos) // 4 - n), 0)
    place, reach = group + n, group + upto
    end = np.searchsorted(place, reach, "right")
    farthest = np.maximum.accumulate(reach)
    before = np.append(-1, farthest[:-1])
    before[first] = group[first] - 1
    second = np.maximum.accumulate(np.minimum(reach, before))
    at = np.maximum(end - 1, 0)
    return (end > 0) & (np.where(n <= upto, second[at], farthest[at]) >= place)


def _met(batches: Iterator[pa.RecordBatch], most: int = JUDGED) -> Iterator[pa.RecordBatch]:
    """Rows (token, sid, n, pos; sorted by token and n) that can be linked with another row of their token.

    A batch's last list waits for what follows; one of more than ``most`` rows is handed on as it is.
    """

    def judged(rows: pa.RecordBatch) -> pa.RecordBatch:
        token, n, pos = (rows.column(c).to_numpy().astype(np.int64) for c in ("token", "n", "pos"))
        return rows.filter(pa.array(_pairable(token, n, pos)))

    held: list[pa.RecordBatch] = []
    size, whole = 0, False
    for batch in batches:
        if not batch.num_rows:
            continue
        token = batch.column("token").to_numpy()
        if held and token[0] != held[0].column("token")[0].as_py():
            if not whole:
                yield judged(pa.concat_batches(held))
            held, size, whole = [], 0, False
        ends = int(np.searchsorted(token, token[0], "right")) if held else 0
        if ends < len(token):
            if held and not whole:
                yield judged(pa.concat_batches([*held, batch.slice(0, ends)]))
            elif held:
                yield batch.slice(0, ends)
            last = int(np.searchsorted(token, token[-1]))
            if ends < last:
                yield judged(batch.slice(ends, last - ends))
            held, size, whole = [batch.slice(last)], len(token) - last, False
        elif whole:
            yield batch
        else:
            held.append(batch)
            size += len(token)
        if size > most and not whole:
            yield from held
            held, whole = held[:1], True
    if held and not whole:
        yield judged(pa.concat_batches(held))


def _cell(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _profiles(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, sig, n, hi, lo, prefix`` of each row: its set's size, a 128-bit hash of the set, and the fifth of it that index lists hold.

    The order of shingles has common ones last, by a table of counts of fixed size over all documents.
    """
    counted = cell_counts(docs, lambda texts: _cell(np.concatenate([np.empty(0, np.uint64), *shingle_sets(texts, size)])), CELL_BITS, partitions(docs.sparkSession))
    held = docs.sparkSession.sparkContext.broadcast(counted)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = held.value
        for batch in W.small(batches):
            sets = shingle_sets(batch.column("text"), size)
            prefix, hi, lo = [], [], []
            for s in sets:
                s = s[np.argsort(cells[_cell(s)], kind="stable")]
                prefix.append(W.signed(s[: len(s) - (4 * len(s) + 4) // 5 + 1] if len(s) else s))
                m = W.mix(s)
                hi.append(int(m.sum().view(np.int64)) if len(s) else 0)
                lo.append(int(W.mix(m + np.uint64(1)).sum().view(np.int64)) if len(s) else 0)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "sig": batch.column("sig"), "n": pa.array([len(s) for s in sets], pa.int32()),
                "hi": pa.array(hi, pa.int64()), "lo": pa.array(lo, pa.int64()), "prefix": pa.array(prefix, pa.list_(pa.int64())),
            })

    return written(docs.mapInArrow(profile, "doc_id long, sig long, n int, hi long, lo long, prefix array<long>"))


def _let_through(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """``rows`` but those whose hashed key is surely none of ``wanted``, by a filter of fixed size."""
    bits = rows.sparkSession.sparkContext.broadcast(bitfilter.build(wanted, wanted_key))

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bitfilter.passes(bits.value, batch.column("h").to_numpy().view(np.uint64)))).drop_columns(["h"])

    return rows.withColumn("h", key).mapInArrow(through, rows.schema)


def _linked(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Those of ``pairs`` (a, b), a written table, that are links, told from whole sets in integers.

    Only texts that the pairs ask for are shuffled. A set with a large share of the pairs has its text copied to several tasks before pairs meet
    texts; then pairs are dealt out one by one.
    """
    texts = _let_through(texts, F.xxhash64("sid"), pairs.select(F.explode(F.array("a", "b")).alias("sid")), F.xxhash64("sid"))
    a, b = (texts.select(F.col("sid").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
    n = partitions(pairs.sparkSession)
    total = pairs.count()
    rows = spread_join(pairs, a, "a", heavy_keys(pairs, "a", total, n))
    rows = spread_join(rows, b, "b", heavy_keys(pairs, "b", total, n)).select("a", "b", "text_a", "text_b").repartition(n, "a", "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.small(W.small(batches, "text_a"), "text_b"):
            linked = []
            for x, y in zip(shingle_sets(batch.column("text_a"), size), shingle_sets(batch.column("text_b"), size)):
                same = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(same > 0 and 100 * same >= 80 * (len(x) + len(y) - same))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return written(rows.mapInArrow(check, "a long, b long"))


def _possible(x: str, y: str) -> Column:
    """Whether sets ``x`` and ``y`` can be linked that share a token at their places of the order."""
    n = lambda s: F.col(f"{s}.n")
    rest = F.least(n(x) - F.col(f"{x}.pos"), n(y) - F.col(f"{y}.pos"))
    return (5 * F.least(n(x), n(y)) >= 4 * F.greatest(n(x), n(y))) & (9 * rest >= 4 * (n(x) + n(y)))


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of a list that lead to another component and can be linked; rows come sorted by token, part, size and place.

    Members of the list's largest component are not taken as left sides, so what is already one
    component is skipped as a whole. Sets of one size are a block, sorted by place: from the sizes follows
    up to which place a member can be linked, and the rest of the block is skipped by position.
    Rows come with ``left``: whether this task takes them as left sides. Pairs that the task has
    just handed on are not handed on again.
    """

    told: set[int] = set()

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if len(told) > REMEMBERED:
            told.clear()
        left = rows.column("left").to_numpy()
        ids, n, pos, comp = (rows.column(c).to_numpy().astype(np.int64) for c in ("sid", "n", "pos", "comp"))
        names, counts = np.unique(comp, return_counts=True)
        if len(names) < 2:
            return
        main = names[counts.argmax()]
        size, first = np.unique(n, return_index=True)  # blocks
        place = (n << 32) + pos
        for i in np.flatnonzero((comp != main) & left):
            block = slice(np.searchsorted(size, -(-4 * int(n[i]) // 5)), np.searchsorted(size, min(5 * int(n[i]) // 4, 9 * int(n[i] - pos[i]) // 4 - int(n[i])), "right"))
            begin, upto = first[block], size[block] - (4 * (n[i] + size[block]) + 8) // 9
            end = np.searchsorted(place, (size[block] << 32) + upto, "right")
            some = np.maximum(end - begin, 0)
            at = np.arange(int(some.sum())) + np.repeat(begin - np.cumsum(some) + some, some)
            at = at[(comp[at] != comp[i]) & ((comp[at] == main) | (ids[at] > ids[i]))]
            if len(at):
                other = ids[at]
                keys = W.mix(W.mix(np.minimum(other, ids[i]).astype(np.uint64)) + np.maximum(other, ids[i]).astype(np.uint64)).tolist()
                new = np.array([k not in told for k in keys])
                told.update(keys)
                if new.any():
                    yield pa.RecordBatch.from_pydict({"a": pa.array(np.full(int(new.sum()), ids[i]), pa.int64()), "b": pa.array(other[new], pa.int64())})

    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        token, part = table.column("token").to_numpy(), table.column("part").to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(token) != 0) | (np.diff(part) != 0)) + 1).tolist(), len(token)]
        for a, b in zip(cuts, cuts[1:]):
            if held and (held[0].column("token")[0].as_py(), held[0].column("part")[0].as_py()) != (token[a], part[a]):
                yield from pairs(pa.concat_tables(held))
                held = []
            held.append(table.slice(a, b - a))
    if held:
        yield from pairs(pa.concat_tables(held))


def _parts(rows: DataFrame, left_at_once: int) -> DataFrame:
    """``rows`` with ``part, left``: a list of many left sides stands in several parts, each of which has all members and its share of the left sides."""
    # rows of the list's first component may turn out to be left sides, so all count
    long = rows.groupBy("token").count().where(F.col("count") > left_at_once).select("token", F.ceil(F.col("count") / left_at_once).cast("int").alias("k"))
    rows = rows.join(long, "token", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return rows.withColumn("left", F.pmod(F.xxhash64("sid"), F.col("k")) == F.col("part")).drop("k")


def _labelled(lists: DataFrame, comps: DataFrame) -> DataFrame:
    """``lists`` with the component of each set; lists that touch one component only are done and left out."""
    rows = lists.join(comps.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    open_ = rows.groupBy("token").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least < most").select("token")
    return written(rows.join(open_, "token", "left_semi"))  # read four times in a round


def _best_partners(rows: DataFrame) -> DataFrame:
    """``a, b``: for each set, of the members of another component that stand earliest in its lists, the earliest."""
    rows = rows.select("token", "comp", F.struct("pos", "n", "sid", "comp").alias("x"))
    first = rows.groupBy("token").agg(F.min("x").alias("p"))
    rows = rows.join(first, "token")
    second = rows.where("comp <> p.comp").groupBy("token").agg(F.min("x").alias("q"))
    rows = rows.join(second, "token").select("x", F.when(F.col("p.comp") != F.col("comp"), F.col("p")).otherwise(F.col("q")).alias("p")).where(_possible("x", "p"))
    return rows.groupBy(F.col("x.sid").alias("a")).agg(F.min(F.struct("p.pos", "p.sid")).alias("p")).select("a", F.col("p.sid").alias("b"))


def similar_components(docs: DataFrame, size: int = 5, tied: bool = True, left_at_once: int = LEFT_AT_ONCE) -> DataFrame:
    """``doc_id, sig, n_shingles, component_id, is_first``: documents connected by Jaccard >= 0.8 links.

    Words are lower-cased (A-Z) runs without ASCII white space; a document's set are its distinct
    ``size``-word shingles, or its whole word sequence if it is shorter. Documents with
    100 * |intersection| >= 80 * |union| are linked; ``component_id`` is the smallest doc_id
    reachable. Every link counts, none is cut off. ``sig`` is the xxhash64 of the text; ``is_first``
    marks the rows with the least (doc_id, sig) of a component, and those linked with nothing.

    - Equal sets are one set.
    - Index lists are built for the first fifth of each set in one order, common shingles last; a set stays in a
      list that has another one it can be linked with by sizes and places. They are sorted by size and place; in each block of one size all places beyond a bound are skipped (``_cross``). A list of
      more than ``left_at_once`` sets is compared in several tasks.
    - A set first tries the member of its lists that stands earliest in the order, the one with
      the least of its own before what they share. If they are linked, it takes that set's answers over by
      joining its component, and only pairs that lead to other components
      are looked at for it. What is left after these rounds is compared in full.

    Candidates are checked on whole sets; their texts are read once through a fixed-size filter. A null or
    empty text has an empty set, linked with nothing, as is a row with null doc_id (its component_id is null).
    Rows that share a doc_id count as one document with several sets if ``tied``, else each row stands for
    itself. Further columns are ignored.
    """
    n = partitions(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("sig", F.xxhash64("text"))
    profiles = _profiles(docs, size)
    linkable = profiles.where("n > 0 and doc_id is not null")
    classes = linkable.groupBy("hi", "lo", "n").agg(F.min(F.struct("doc_id", "sig", "prefix")).alias("r"))
    classes = written(classes.select("hi", "lo", "n", "r.doc_id", "r.sig", "r.prefix").withColumn("sid", F.monotonically_increasing_id()))  # ids hold as they are written
    lists = classes.select("sid", "n", F.posexplode("prefix").alias("pos", "token")).select("token", "sid", "n", "pos")
    lists = written(lists.repartition(n, "token").sortWithinPartitions("token", "n").mapInArrow(_met, "token long, sid long, n int, pos int"))

    asked = written(classes.join(lists.select("sid").distinct(), "sid", "left_semi").select("sid", "doc_id", "sig"))
    texts = _let_through(docs.where("doc_id is not null"), F.xxhash64("doc_id", "sig"), asked, F.xxhash64("doc_id", "sig"))
    texts = written(texts.dropDuplicates(["doc_id", "sig"]).join(asked, ["doc_id", "sig"]).select("sid", "text"))

    # rows that share a doc_id tie their sets together
    of_doc = linkable.join(classes.select("hi", "lo", "n", "sid"), ["hi", "lo", "n"]).groupBy("doc_id").agg(F.min("sid").alias("a"), F.collect_set("sid").alias("s"))
    ties = of_doc.where(F.size("s") > 1).select("a", F.explode("s").alias("b")).where("a <> b")
    links = written(ties if tied else ties.where("false"))
    comps, tested = components(links), None
    for full in [False] * ROUNDS + [True]:
        rows = _labelled(lists, comps)
        if full:
            rows = _parts(rows, left_at_once).repartition(n, "token", "part").sortWithinPartitions("token", "part", "n", "pos")
            rows = rows.select("token", "part", "left", "sid", "n", "pos", "comp").mapInArrow(_cross, "a long, b long")
        else:
            rows = _best_partners(rows)
        pairs = rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = written(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            continue
        links = links.union(_linked(pairs, texts, size))
        tested = pairs if tested is None else tested.union(pairs)
        comps = written(components(links))

    named = classes.select("hi", "lo", "n", "doc_id", "sig", "sid").join(comps.select(F.col("node").alias("sid"), "comp"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    first = named.groupBy("comp").agg(F.min(F.struct("doc_id", "sig")).alias("first"))
    named = named.join(first, "comp").select("hi", "lo", "n", "first", F.lit(True).alias("known"))
    known = F.expr("n > 0 and doc_id is not null")
    rows = profiles.select("doc_id", "sig", "n", F.when(known, F.col("hi")).otherwise(F.xxhash64("doc_id", "sig")).alias("hi"), "lo", known.alias("known")).join(named, ["hi", "lo", "n", "known"], "left")
    is_first = F.coalesce((F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.sig") == F.col("sig")), F.lit(True))
    return rows.select("doc_id", "sig", F.col("n").cast("long").alias("n_shingles"), F.coalesce("first.doc_id", "doc_id").alias("component_id"), is_first.alias("is_first"))
