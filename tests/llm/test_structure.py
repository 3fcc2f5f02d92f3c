"""Conversation repair, the dataset manifest and document fingerprints."""

import random

import pytest
from pyspark.sql import functions as F

from glossmill.llm import queries as Q
from . import brute

CONV = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def rows_of(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def test_repair(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(Q.op11_repair(spark, sf), *CONV) == brute.repair(rows)


@pytest.mark.parametrize("piece", [1024, 3])
def test_repair_of_odd_rows(spark, piece):
    """Nulls in any column, repeated rows, ties, unknown and empty roles, long texts, one long conversation; pieces of any length."""
    from glossmill.llm.repair import damaged, repair

    dice = random.Random(7)
    texts = ["Yes.", "no", "", " \t\n", None, "Why?", "x" * 50_000 + "!", "é. \n", "so"]
    roles = ["user", "assistant", "system", None, "", "tool", "sage", "Assistant"]
    rows = [(dice.choice([0, 1, 2, 3, None]), dice.choice([None, *range(12)]), dice.choice(roles), dice.choice(texts)) for _ in range(300)]
    rows += [(9, t, dice.choice(roles[:2]), dice.choice(texts)) for t in range(400)] + rows[:40]
    frame = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, m int, digest string")
    assert rows_of(repair(damaged(frame), piece), *CONV) == brute.repair(rows)
    assert repair(damaged(frame.where("false")), piece).count() == 0


def test_repair_of_a_conversation_that_is_gone(spark):
    from glossmill.llm.repair import damaged, repair
    import hashlib
    import zlib

    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert rows_of(repair(damaged(frame)), *CONV) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_search_against_all_edits():
    """Every conversation shape of up to four rows against all strings of edits."""
    from itertools import product

    from glossmill.llm.repair import _arcs, _from_start, _joined, _matrix, symbol

    assert symbol("u", "") == "u" and symbol("u", "truncated") == "U" and symbol("x", "truncated") == "+" and symbol("a", "blank") == "."
    import re

    def every(rows):
        best = None
        todo = [(0, "", "", 0)]
        while todo:
            cost, audit, made, i = todo.pop()
            if i == len(rows) and re.fullmatch("(s?(ua)+)?", made):
                best = min(best or (99, ""), (cost, audit))
            if audit[-2:] != "II":
                todo += [(cost + 5, audit + "I", made + r, i) for r in "ua" if cost < 15]
            if i < len(rows):
                todo += [(cost + more, audit + label, made + (to or ""), i + 1) for label, more, to in _arcs(rows[i])]
        return best

    for k in range(4):
        for rows in product("suaUA-.", repeat=k):
            said = "".join(rows)
            assert _from_start(said) == every(said), said
            cut = _joined(_joined({0: (0, "")}, *_matrix(said[:1])), *_matrix(said[1:]))
            assert min(cut[q] for q in (0, 3) if q in cut) == _from_start(said)


MANIFEST = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def test_manifest(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert rows_of(Q.op12_manifest(spark, sf), *MANIFEST) == brute.manifest(rows)


@pytest.mark.parametrize("langs", [1, 70])
def test_manifest_of_odd_rows(spark, langs):
    """Nulls in any column, repeated rows, ties, lone leaves, one group and many; what is tampered with is found."""
    from glossmill.llm.merkle import document_leaves, fold, manifest

    dice = random.Random(langs)
    names = [None, "en", "EN", "é", "", *(f"l{i}" for i in range(70))][:langs]
    rows = [(dice.choice([None, *range(200)]), dice.choice([None, "s"]), dice.choice(names), dice.choice([None, 3]), dice.choice([None, "", "abc", "Aé", "X" * 50_000])) for _ in range(150)]
    rows += rows[:30] + [(-5, "s", "only one", 1, "T")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, place int")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = manifest(document_leaves(frame, tampered))
    assert rows_of(found, *MANIFEST) == brute.manifest(rows)
    for r in found.limit(20).collect():
        assert fold(bytes.fromhex(r.leaf), bytes(r.proof))[0].hex() == r.root
    assert manifest(document_leaves(frame.where("false"), tampered)).count() == 0
    lone = manifest(document_leaves(frame.where("lang = 'only one'"))).first()
    assert lone.leaf == lone.subroot == lone.root == lone.folded_root and lone.verified and not lone.proof


def printed(df):
    root = F.left(F.col("fingerprint"), F.lit(64)), F.left(F.col("edited_fingerprint"), F.lit(64))
    return rows_of(df.select("doc_id", "n_chars", "edited_sha256", root[0].alias("a"), root[1].alias("b"), "near_edited", "near_next"), "doc_id", "n_chars", "edited_sha256", "a", "b", "near_edited", "near_next")


def test_fingerprints(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = Q.op13_fingerprints(spark, sf)
    assert "Python" not in found._jdf.queryExecution().toString()
    assert printed(found) == brute.fingerprints(docs)
    # two thirds of a text are more like it than the next text is
    near = [(r.near_edited, r.near_next) for r in found.where("n_chars > 100").collect()]
    assert sum(a > b for a, b in near) > 0.97 * len(near)


def test_fingerprints_of_odd_rows(spark):
    """Nulls, empty and very long texts, white space of all kinds, few rows, one row and none, columns of other names."""
    from glossmill.llm.fingerprint import document_fingerprints, with_next

    texts = [None, "", " ", "a", "a b\n\n c,d e. f\r\n", "\n\n\n", "é 😀 ß.", "w " * 30_000, "x" * 200_000 + " y.", "\t.\v!\f?", "a|b | c", " \u00a0 \u2003 z"]
    rows = [(None if i == 3 else 2**63 - 1 if i == 5 else i * 7 % 40, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, key string, range int")
    for k in (0, 1, 2, len(rows)):
        few = spark.createDataFrame([(*r, "k", 1) for r in rows[:k]], frame.schema)
        assert printed(document_fingerprints(few)) == brute.fingerprints(rows[:k])
    # rows that share a doc_id, or have none, each get a next row, and every row is the next of one
    same = spark.createDataFrame([(dice, f"t{i // 2}") for i, dice in enumerate([None, 1, 1, 2] * 50)], "doc_id long, text string")
    found = with_next(same, 4).select("text", "next_text").collect()
    assert sorted(r.text for r in found) == sorted(r.next_text for r in found) == sorted(r.text for r in same.collect())


def test_edits_are_located(spark):
    from glossmill.llm.fingerprint import edited_places, fingerprint, likeness

    lines = [f"Line {i} of the text, with words {i * i}." for i in range(40)]
    other = lines[:11] + ["Something else."] + lines[12:30] + lines[31:]
    row = spark.createDataFrame([("\n".join(lines), "\n".join(other))], "a string, b string").select(fingerprint(F.col("a")).alias("a"), fingerprint(F.col("b")).alias("b"))
    found = row.select(edited_places(F.col("a"), F.col("b")).alias("here"), edited_places(F.col("b"), F.col("a")).alias("there"), edited_places(F.col("a"), F.col("a")).alias("none"), likeness(F.col("a"), F.col("b")).alias("near"), likeness(F.col("a"), F.col("a")).alias("same")).first()
    assert found.here == [12, 31] and found.there == [12] and found.none == [] and 0.9 < found.near < 1 and found.same == 1
