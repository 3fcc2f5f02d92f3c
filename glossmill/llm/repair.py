"""Conversation structure repair: weighted finite-state composition, searched for the cheapest edits.

Three machines are composed. The *input acceptor* is the row of faults and role initials of a conversation. The *edit
transducer* keeps, re-roles, deletes or inserts, each with a cost and a label. The *grammar acceptor* takes the role
initials ``(s?(ua)+)?``. States of the composition are pairs of a place in the input and a grammar state; they are made
only when a path reaches them, in topological order, and each holds the least (cost, labels) that leads to it.

A weight is a cost and the labels so far, compared in that order. Of two different paths with the same ends and the same
cost, neither label string is the beginning of the other (they delete, keep and re-role equally often, so one would have
more insertions, at a higher cost), so that what is least stays least when labels are put behind or before it. Hence the
search of a conversation may be cut anywhere: each piece gives the least weight from each grammar state to each other,
and pieces are put together by the same sums and minima.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import partitions

#: The grammar acceptor: state -> role initial -> state. 0 is where it starts; 0 and 3 are where it may end.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
#: Rows of a conversation that are searched at once.
PIECE = 1024

Weight = tuple[int, str]


def symbol(initial: str, fault: str) -> str:
    """A row as one character: its initial (``-`` for any that no grammar arc has), then upper case if truncated; ``.`` if it has to go."""
    if fault in ("blank", "duplicate"):
        return "."
    known = initial if initial in ("s", "u", "a") else "-"
    return {"-": "+"}.get(known, known.upper()) if fault == "truncated" else known


def _arcs(row: str) -> list[tuple[str, int, str | None]]:
    """What the edit transducer makes of a row: label, cost, and the initial it hands to the grammar (None: nothing)."""
    if row == ".":
        return [("D", DELETE, None)]
    more = CUT_OFF if row in "SUA+" else 0
    initial = row.lower()
    out: list[tuple[str, int, str | None]] = [("D", DELETE, None), *(("R", REROLE + more, to) for to in ROLES)]
    return out + ([("K", KEEP + more, initial)] if initial in "sua" else [])


def _relax(into: dict[int, Weight], state: int, weight: Weight) -> bool:
    if state in into and into[state] <= weight:
        return False
    into[state] = weight
    return True


def _inserted(front: dict[int, Weight]) -> dict[int, Weight]:
    """``front`` and what insertions reach from it. A path that comes back to a state only grows, so this ends."""
    todo = list(front)
    while todo:
        at = todo.pop()
        cost, labels = front[at]
        for initial in ROLES:
            to = GRAMMAR[at].get(initial)
            if to is not None and _relax(front, to, (cost + INSERT, labels + "I")):
                todo.append(to)
    return front


def search(rows: str, start: int) -> dict[int, Weight]:
    """The least weight from a grammar state to each other over the rows, by topological order of their places."""
    front = _inserted({start: (0, "")})
    for row in rows:
        ahead: dict[int, Weight] = {}
        for at, (cost, labels) in front.items():
            for label, more, initial in _arcs(row):
                to = at if initial is None else GRAMMAR[at].get(initial)
                if to is not None:
                    _relax(ahead, to, (cost + more, labels + label))
        front = _inserted(ahead)
    return front


@lru_cache(50_000)
def _from_start(rows: str) -> Weight:
    found = search(rows, 0)
    return min(found[q] for q in FINAL if q in found)


@lru_cache(4_096)
def _matrix(rows: str) -> tuple[list[int], list[str | None]]:
    costs, labels = [-1] * 16, [None] * 16
    for a in range(4):
        for b, (cost, said) in search(rows, a).items():
            costs[4 * a + b], labels[4 * a + b] = cost, said
    return costs, labels


def _joined(front: dict[int, Weight], costs: list[int], labels: list[str | None]) -> dict[int, Weight]:
    ahead: dict[int, Weight] = {}
    for a, (cost, said) in front.items():
        for b in range(4):
            if costs[4 * a + b] >= 0:
                _relax(ahead, b, (cost + costs[4 * a + b], said + labels[4 * a + b]))
    return ahead


COUNTS = ("blank", "duplicate", "truncated", "illegal")
#: Pairs of role initials that may stand side by side.
LEGAL = {"su", "ua", "au"}


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, m, digest``: the rows with the faults that crc32(``conv_id:turn``) mod 20 puts in, nulls being one space.

    ``m`` is how often a row stands there (0: dropped); ``digest`` tells role and text.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")), F.lit(20))
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(said("role"))
    out = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("m"))
    return out.withColumn("digest", F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)))


_SEGMENT = (
    "conv_id long, seg long, n long, blank long, duplicate long, truncated long, illegal long, head string, tail string, "
    "low long, high long, turns long, costs array<int>, labels array<string>"
)
_AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_RESULT = _AUDIT + ", repaired_sha256 string"


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in ddl.split(", "))])


def _audits(rows: DataFrame, n: int, piece: int) -> DataFrame:
    """Counts and edits of each conversation from rows without their texts."""
    faulty = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    slim = rows.select("conv_id", "turn", "role", "digest", "m", faulty.alias("is_blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("is_cut"))
    slim = slim.groupBy("conv_id", "turn", "role", "digest", "is_blank", "is_cut").agg(F.sum("m").alias("m"))
    again = slim.where("m > 0 and not is_blank").groupBy("conv_id", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("k")).where("k > 1")
    a, b = slim.alias("a"), again.alias("b")
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.digest") == F.col("b.digest"))
    later = F.coalesce(~F.col("first.turn").eqNullSafe(F.col("a.turn")), F.lit(False)) & F.col("first").isNotNull()
    told = a.join(b, same, "left").select("a.conv_id", "a.turn", "a.role", "a.digest", "a.is_blank", "a.is_cut", "a.m", later.alias("is_later"))
    order = ["conv_id", "turn", "role", "digest"]
    dealt = told.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long"))
    cut, audit = _schema(_SEGMENT), _schema(_AUDIT)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of conversations in order; those that lie inside a part are whole and need only be searched from the start."""
        now: dict | None = None
        seg, runs, out = 0, 0, []

        def fresh(conv: int | None, whole: bool) -> dict:
            return {"conv": conv, "n": 0, "rows": [], "head": None, "tail": None, "low": None, "high": None, "turns": 0, "whole": whole, **dict.fromkeys(COUNTS, 0)}

        def ended(piece: dict, whole: bool) -> tuple:
            shape = "".join(piece["rows"])
            if whole:
                cost, said = _from_start(shape)
                costs, labels = [cost], [said]
            else:
                costs, labels = _matrix(shape)
            return (piece["conv"], seg, piece["n"], *(piece[c] for c in COUNTS), piece["head"], piece["tail"], piece["low"], piece["high"], piece["turns"], costs, labels)

        for batch in batches:
            for conv, turn, role, blank, is_cut, m, later, part in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "is_blank", "is_cut", "m", "is_later", "part"))):
                if now is None or conv != now["conv"]:
                    if now is not None:
                        out.append(ended(now, now["whole"]))
                    seg, runs = (part << 32 if now is None else seg + 1), runs + 1
                    now = fresh(conv, runs > 1)
                initial = role[:1] or " "
                for copy in range(m):
                    if now["n"] == piece:
                        out.append(ended(now, False))
                        seg, now = seg + 1, fresh(conv, False)
                    fault = "blank" if blank else "duplicate" if later or copy else "truncated" if is_cut else ""
                    if fault:
                        now[fault] += 1
                    now["rows"].append(symbol(initial, fault))
                    if now["tail"] is not None and now["tail"] + initial not in LEGAL:
                        now["illegal"] += 1
                    now["head"], now["tail"] = now["head"] or initial, initial
                    if turn is not None and turn != now["high"]:
                        now["low"], now["high"], now["turns"] = turn if now["low"] is None else now["low"], turn, now["turns"] + 1
                    now["n"] += 1
            if len(out) > 5_000:
                yield _arrow(out, cut)
                out = []
        if now is not None:
            out.append(ended(now, False))
        yield _arrow(out, cut)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Puts pieces of one conversation together; they come in order."""
        now: dict | None = None
        out: list[tuple] = []

        def ended() -> tuple:
            cost, said = min(now["front"][q] for q in FINAL if q in now["front"])
            gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["turns"]
            return (now["conv"], gaps, *(now[c] for c in COUNTS), cost, said)

        for batch in batches:
            for conv, _, n, *counts, head, tail, low, high, turns, costs, labels in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                if now is None or conv != now["conv"]:
                    if now is not None:
                        out.append(ended())
                    now = {"conv": conv, "tail": None, "low": None, "high": None, "turns": 0, "front": {0: (0, "")}, **dict.fromkeys(COUNTS, 0)}
                for c, k in zip(COUNTS, counts):
                    now[c] += k
                if n:
                    now["illegal"] += now["tail"] is not None and now["tail"] + head not in LEGAL
                    now["tail"] = tail
                if low is not None:
                    now["turns"] += turns - (low == now["high"])
                    now["low"], now["high"] = low if now["low"] is None else now["low"], high
                now["front"] = {0: (costs[0], labels[0])} if len(costs) == 1 else _joined(now["front"], costs, labels)
            if len(out) > 5_000:
                yield _arrow(out, audit)
                out = []
        if now is not None:
            out.append(ended())
        yield _arrow(out, audit)

    pieces = dealt.mapInArrow(segments, _SEGMENT)
    return pieces.repartition(n, "conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(whole, _AUDIT)


def repair(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """What is wrong with each conversation, its cheapest edits and the digest of what they make of it.

    ``rows`` has conv_id, turn, role, text and ``m``, how often a row stands there (see ``damaged``; a row with ``m`` 0 only
    says that there is such a conversation). Returns ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256``.

    Rows are taken by turn, nulls first; rows that share a turn by role, then by the digest of role and text. Equal rows are
    counted before they are shuffled. A null conv_id is a conversation of its own. An empty role has the initial of a space,
    which the grammar never has. A conversation without rows has zeros, no edits and the digest of nothing; an empty table
    has no conversations. Further columns are ignored.

    Edits are found from roles and faults alone, over ranges of rows, so a long conversation is cut into pieces that many
    tasks search. Then the texts of a conversation pass one task, which holds its edits (a byte a row) and a batch of
    rows: a digest of all of it can't be had in parts.
    """
    n = partitions(rows.sparkSession)
    audits = _audits(rows, n, piece)
    text = rows.where("m > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", "text", "m")
    none = lambda kind: F.lit(None).cast(kind)
    numbers = ["gaps", *COUNTS, "cost"]
    told = audits.select("conv_id", F.lit(0).alias("kind"), none("long").alias("turn"), none("string").alias("role"), none("binary").alias("digest"), F.col("audit").alias("text"), none("long").alias("m"), *numbers)
    both = told.unionByName(text, allowMissingColumns=True).repartition(n, "conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    result = _schema(_RESULT)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, edits, at, made, hashed = None, "", 0, 0, None
        out: list[tuple] = []

        def put(role: str, text: str) -> None:
            nonlocal made
            hashed.update(f"{chr(10) if made else ''}{role}:{text}".encode())
            made += 1

        def role_here(length: int) -> str:
            """The grammar leaves one choice for each place of a result of this length."""
            return ROLES["ua"[(made - length % 2) % 2]]

        def inserts() -> None:
            nonlocal at
            while at < len(edits) and edits[at] == "I":
                put(role_here(length), "")
                at += 1

        def ended() -> tuple:
            inserts()
            return (*head, edits, hashed.hexdigest())

        length = 0
        for batch in batches:
            for conv, kind, role, text, m, *told in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text", "m", *numbers))):
                if not kind:
                    if head is not None:
                        out.append(ended())
                    head, edits, at, made, hashed = (conv, *told), text, 0, 0, hashlib.sha256()
                    length = len(edits) - edits.count("D")
                    continue
                for _ in range(m):
                    inserts()
                    if edits[at] != "D":
                        put(role if edits[at] == "K" else role_here(length), text)
                    at += 1
            if len(out) > 5_000:
                yield _arrow(out, result)
                out = []
        if head is not None:
            out.append(ended())
        yield _arrow(out, result)

    return both.mapInArrow(digests, _RESULT)
