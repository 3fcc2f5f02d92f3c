"""Merkle manifest of a dataset: Pregel-style supersteps over RDDs of tree nodes.

Rows are leaves, in a tree for each group; the roots of these are the leaves of one more tree, whose root stands for the
dataset. Going up, a superstep sends each node's digest to its parent; a parent that has all its children hashes them and
takes part in the next one. Going down, a superstep sends the path above a node (the siblings up to the root) to
its children, each with its own siblings put before it; leaves fold their digests along it and compare with the root.

What a superstep shuffles is an eighth of what the one below it did. The lowest nodes keep the rows of their leaves, so a
path is sent once for eight rows, and no text leaves the task that reads it. Each superstep is one shuffle between two
tables in the shared folder: a lost executor costs what it was at, and a task has one Python worker at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import partitions, written

#: Children of a node.
ARITY = 8
_SIZE = 32

Key = tuple[str | None, int]  # group of nodes, place in its level


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 length, ``:``, and the value."""
    said = value.cast("string")
    return F.when(said.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said))


def leaf_digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*(encoded(v) for v in values)), 256))


def _dealt(key: Key) -> int:
    return zlib.crc32(repr(key).encode())


def _hashed(digests: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


def numbered(rows: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """``rows`` with ``place``, the number in its group by ``order``, and ``size``, the rows of the group.

    Rows are sorted in ranges, so a large group is dealt over many tasks; what is summed over the ranges is a count for
    each range and each group in it. Rows that agree in ``order`` are told apart by where they are read.
    """
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    by = [group, *order, "_row"]
    dealt = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id())
    dealt = written(dealt.drop("_row").withColumn("_at", F.monotonically_increasing_id()))  # a number for each row that grows inside a range
    runs = dealt.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    up = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col(group).alias("_group"), F.col("_part").alias("_in"), "_first", F.coalesce(F.sum("_n").over(up), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(group)).alias("size"))
    found = dealt.join(runs, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_in")))
    return found.withColumn("place", F.col("_before") + F.col("_at") - F.col("_first")).drop("_group", "_in", "_first", "_before", "_part", "_at")


LEVEL = "grp string, place long, size long, digests binary, rows array<struct<doc_id:long,offered:binary>>"
MESSAGE = "grp string, place long, passed binary, path binary"


def _table(rdd: RDD, schema: str) -> DataFrame:
    return SparkSession.active().createDataFrame(rdd, schema, verifySchema=False)


def _parts(data: bytes) -> list[bytes]:
    return [data[i : i + _SIZE] for i in range(0, len(data), _SIZE)]


def _complete(node: tuple[Key, Iterator[tuple]]) -> tuple:
    (group, place), children = node
    children = sorted(children, key=lambda c: c[0])
    size = children[0][2]
    if [c[0] for c in children] != list(range(min(ARITY, size - ARITY * place))):
        raise ValueError(f"node {place} of {group!r} lacks children")
    return group, place, size, b"".join(c[1] for c in children), [c[3] for c in children]


def climb(leaves: DataFrame, n: int) -> list[DataFrame]:
    """The levels above ``leaves`` (grp, place, size, digest, doc_id, offered): a row for each node, with its children's digests and rows.

    ``size`` is how many nodes the level of the children has in the group.
    """

    def first(r: Row) -> tuple[Key, tuple]:
        return (r.grp, r.place // ARITY), (r.place % ARITY, bytes(r.digest), r.size, (r.doc_id, r.offered and bytes(r.offered)))

    def further(r: Row) -> tuple[Key, tuple]:
        return (r.grp, r.place // ARITY), (r.place % ARITY, _hashed(_parts(r.digests)), -(-r.size // ARITY), None)

    levels: list[DataFrame] = []
    below, send = leaves.where("size > 1"), first
    while not below.isEmpty():
        up = below.rdd.map(send).groupByKey(max(1, n // ARITY ** len(levels)), _dealt)
        levels.append(written(_table(up.map(_complete), LEVEL)))
        below, send = levels[-1].where(F.col("size") > ARITY), further
    return levels


def roots(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``grp, digest, height, doc_id, offered`` of the root of each group; the last two where it is a leaf."""
    found = leaves.where("size = 1").select("grp", "digest", F.lit(0).alias("height"), "doc_id", "offered")
    for k, level in enumerate(levels, 1):
        top = level.where(F.col("size") <= ARITY)
        found = found.unionByName(top.select("grp", F.unhex(F.sha2(F.lower(F.hex("digests")).cast("binary"), 256)).alias("digest"), F.lit(k).alias("height"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("offered")))
    return found


def _step(place: int, digests: list[bytes]) -> bytes:
    """A node's place among its siblings, their number, and their digests."""
    return bytes([place, len(digests) - 1]) + b"".join(digests[:place] + digests[place + 1 :])


def descend(levels: list[DataFrame], starts: DataFrame, leaf: Callable[[tuple, bytes, bytes, bytes], tuple], schema: str, n: int) -> DataFrame:
    """What ``leaf`` makes of each row, its digest, what its root was sent, and the path above it.

    ``starts``: ``grp, height`` (of its root, 1 or more), ``passed`` (handed on as it is), ``path`` (above the root).
    """

    def keyed(r: Row) -> tuple[Key, tuple]:
        known = (_parts(r.digests), [tuple(x) if x else None for x in r.rows]) if r.digests is not None else None
        return (r.grp, r.place), (known, None if known else (bytes(r.passed), bytes(r.path)))

    def met(node: tuple[Key, Iterator[tuple]]) -> Iterator[tuple[Key, list, bytes, bytes, int]]:
        (group, place), both = node
        known = sent = None
        for a, b in both:
            known, sent = a or known, b or sent
        if known is None or sent is None:
            raise ValueError(f"node {place} of {group!r} was not met")
        for i in range(len(known[0])):
            yield (group, place * ARITY + i), known, sent[0], _step(i, known[0]) + sent[1], i

    down = None
    for k in range(len(levels), 0, -1):
        at = starts.where(F.col("height") == k).select("grp", F.lit(0).cast("long").alias("place"), "passed", "path")
        at = at if down is None else at.unionByName(down)
        both = levels[k - 1].select("grp", "place", "digests", "rows").unionByName(at, allowMissingColumns=True)
        found = both.rdd.map(keyed).groupByKey(max(1, n // ARITY ** (k - 1)), _dealt).flatMap(met)
        if k > 1:
            down = written(_table(found.map(lambda m: (*m[0], m[2], m[3])), MESSAGE))
    return _table(found.map(lambda m: leaf(m[1][1][m[4]], m[1][0][m[4]], m[2], m[3])), schema)


def fold(digest: bytes, path: bytes) -> tuple[bytes, bytes]:
    """The root that a leaf and its path give, and all siblings of the path end to end."""
    at, siblings = 0, []
    while at < len(path):
        place, count = path[at], path[at + 1]
        others = path[at + 2 : at + 2 + count * _SIZE]
        siblings.append(others)
        digest = hashlib.sha256((others[: place * _SIZE] + digest + others[place * _SIZE :]).hex().encode()).digest()
        at += 2 + count * _SIZE
    return digest, b"".join(siblings)


SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, proof binary"


def _told(row: tuple, digest: bytes, passed: bytes, path: bytes) -> tuple:
    """``passed``: the group's root, then the dataset's."""
    (doc, offered), subroot, root = row, passed[:_SIZE], passed[_SIZE:]
    folded, siblings = fold(digest if offered is None else bytes(offered), path)
    return (doc, digest.hex(), subroot.hex(), root.hex(), hashlib.sha256(siblings.hex().encode()).hexdigest(), folded.hex(), folded == root, path)


def manifest(leaves: DataFrame, with_proof: bool = True) -> DataFrame:
    """Leaf, roots and proof of each row, and whether the digest that is offered for it leads to the root.

    ``leaves``: ``doc_id`` (long), ``grp`` (string), ``leaf`` and ``offered`` (binary; null: the leaf itself). Leaves stand by
    doc_id in the tree of their group, nulls first, ties by leaf; groups by UTF-8 bytes, null first. Every eight neighbours of a level
    (the last run may be shorter) become one node, until one is left; a lone leaf is its own root, and with one group the
    dataset's root is that group's. Digests are hashed as lower-case hexadecimal text.

    Returns ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` and, if asked, ``proof``: for each
    level from the leaf up the node's place, the number of siblings, and these. Equal rows are leaves of their own.
    An empty table has no rows and no root.
    """
    n = partitions(leaves.sparkSession)
    rows = numbered(written(leaves.select("doc_id", "grp", F.col("leaf").alias("digest"), "offered")), "grp", ["doc_id", "digest"], n)
    rows = written(rows)
    levels = climb(rows, n)
    # the roots of groups are the leaves of one more tree; what comes down to them goes on to their leaves
    tops = numbered(written(roots(rows, levels)).withColumnRenamed("grp", "name").withColumn("grp", F.lit("")), "grp", ["name"], n)
    tops = written(tops.withColumn("doc_id", F.col("place")))
    names = tops.select("place", F.col("name").alias("grp"), "height", F.col("digest").alias("subroot"))
    above = climb(tops, n)
    root = roots(tops, above)
    if above:
        begin = root.select("grp", "height", F.col("digest").alias("passed"), F.lit(b"").alias("path"))
        sent = descend(above, begin, lambda row, digest, passed, path: (row[0], passed, path), "place long, root binary, path binary", n)
    else:
        sent = root.select(F.lit(0).cast("long").alias("place"), F.col("digest").alias("root"), F.lit(b"").alias("path"))
    starts = written(names.join(sent, "place").select("grp", "height", F.concat("subroot", "root").alias("passed"), "path"))
    lone = rows.where("size = 1").alias("l").join(starts.where("height = 0").alias("s"), F.col("l.grp").eqNullSafe(F.col("s.grp")))
    alone = _table(lone.select("doc_id", "offered", "digest", "passed", "path").rdd.map(lambda r: _told((r.doc_id, r.offered), bytes(r.digest), bytes(r.passed), bytes(r.path))), SCHEMA)
    found = descend(levels, starts.where("height > 0"), _told, SCHEMA, n).union(alone) if levels else alone
    return found if with_proof else found.drop("proof")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def document_leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Leaves of ``docs`` (doc_id, source, lang, n_chars, text) by lang; where ``tampered`` holds, what is offered has A-Z of the text in lower case."""
    digest = lambda text: leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    text = F.col("text").cast("string")
    offered = F.when(F.coalesce(tampered, F.lit(False)), digest(F.translate(text, UPPER, LOWER))) if tampered is not None else F.lit(None).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("grp"), digest(text).alias("leaf"), offered.alias("offered"))
