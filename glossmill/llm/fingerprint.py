"""Fingerprints of texts: a Merkle tree over pieces, paragraphs and sections, by built-in functions alone.

A paragraph is a line. A section is a run of paragraphs that ends with a blank one, or with one whose own digest says so, so
that where a section ends depends on its last paragraph only and an insertion moves no other border. The leaves are pieces of a
paragraph: words up to a punctuation mark, eight at most. Pieces keep all white space, so equal roots mean equal texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import partitions

#: Words of a piece at most.
WORDS = 8
#: White space inside a line, and a word.
_S, _W = r"[\x20\x09\x0B-\x0D]", r"[^\x20\x09-\x0D]"
_MARKS = r".!?,;:|"
#: A piece: up to ``WORDS`` words, of which only the last may end with a mark, with the white space around them. The
#: parts give nothing back, so it takes one pass.
PIECE = rf"{_S}*+(?:{_W}*+(?<=[^{_MARKS}\x20\x09-\x0D]){_S}++){{0,{WORDS - 1}}}(?:{_W}++{_S}*+)?"
#: Hexadecimal digits that are kept of a piece and of a paragraph; sections and the root keep all 64.
PIECE_HEX, PARAGRAPH_HEX = 12, 16
#: First digits of a paragraph's digest that end a section: one in four.
_ENDS = "[0-3]"
#: About how many keys, those with the least hashes, the borders of ranges come from.
SAMPLE = 20_000
#: Ranges of rows for each partition.
RANGES = 3


def _sha(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def _let(value: Column, said: Callable[[Column], Column]) -> Column:
    """``said(value)``, with ``value`` computed once."""
    return F.transform(F.array(value), said)[0]


def pieces(line: Column) -> Column:
    """The pieces of a line, in order; together they are the line."""
    return F.filter(F.regexp_extract_all(line, F.lit(PIECE), F.lit(0)), lambda p: p != "")


def fingerprint(text: Column) -> Column:
    """The tree of a text as a string: ``root:section(paragraph=pieces,...)...``, all digests in lower-case hexadecimal.

    A digest stands for its children's, end to end: a paragraph for its pieces, a section for its paragraphs, the root for
    its sections. Null is taken as an empty text, which has one paragraph without pieces.
    """
    lines = F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")

    def paragraph(line: Column) -> Column:
        return _let(F.transform(pieces(line), _sha), lambda leaves: F.struct(
            _sha(F.array_join(leaves, "")).alias("digest"),
            F.array_join(F.transform(leaves, lambda d: F.left(d, F.lit(PIECE_HEX))), "").alias("pieces"),
            (F.size(leaves) == 0).alias("blank"),
        ))

    def end(p: Column) -> Column:
        return F.when(p["blank"] | p["digest"].rlike(f"^{_ENDS}"), F.lit(";")).otherwise(F.lit(","))

    def sections(tree: Column) -> Column:
        """Arrays are joined and split again, which takes one pass; adding to arrays would take one for each paragraph."""
        cut = lambda said: F.split(F.regexp_replace(F.array_join(F.transform(tree, said), ""), "[,;]$", ""), ";")
        digests = cut(lambda p: F.concat(p["digest"], end(p)))
        shown = cut(lambda p: F.concat(F.left(p["digest"], F.lit(PARAGRAPH_HEX)), F.lit("="), p["pieces"], end(p)))
        return F.zip_with(digests, shown, lambda d, s: F.struct(_sha(F.replace(d, F.lit(","), F.lit(""))).alias("digest"), s.alias("shown")))

    def said(found: Column) -> Column:
        root = _sha(F.array_join(F.transform(found, lambda s: s["digest"]), ""))
        return F.concat(root, F.lit(":"), F.array_join(F.transform(found, lambda s: F.concat(s["digest"], F.lit("("), s["shown"], F.lit(")"))), ""))

    return _let(_let(F.transform(lines, paragraph), sections), said)


def piece_digests(fp: Column) -> Column:
    """The distinct digests of a fingerprint's pieces."""
    runs = F.regexp_extract_all(fp, F.lit("=([0-9a-f]*+)"), F.lit(1))
    return F.array_distinct(F.regexp_extract_all(F.array_join(runs, ""), F.lit(f"[0-9a-f]{{{PIECE_HEX}}}"), F.lit(0)))


def likeness(a: Column, b: Column, of: tuple[Column, Column] | None = None) -> Column:
    """0 to 1: 1 with equal roots, else twice the common distinct pieces over the distinct pieces of both (0 without any)."""
    x, y = of or (piece_digests(a), piece_digests(b))
    root = lambda fp: F.substring(fp, 1, 64)
    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(x, y)), F.size(x) + F.size(y)), F.lit(0.0)))


def edited_places(a: Column, b: Column) -> Column:
    """Numbers, from 1, of the paragraphs of ``a`` that ``b`` hasn't. Sections that both have are passed over whole."""
    parts = lambda fp: F.regexp_extract_all(fp, F.lit(r"[:)]([0-9a-f]++)\("), F.lit(1))
    held = lambda fp: F.regexp_extract_all(fp, F.lit(r"\(([^)]*)\)"), F.lit(1))
    names = lambda fp: F.regexp_extract_all(fp, F.lit("[(,]([0-9a-f]++)="), F.lit(1))
    differing = F.array_except(parts(a), parts(b))
    said = F.zip_with(parts(a), held(a), lambda d, s: F.transform(F.split(s, ","), lambda p: F.struct(F.array_contains(differing, d).alias("look"), F.substring_index(p, "=", 1).alias("name"))))
    theirs = names(b)
    every = F.transform(F.flatten(said), lambda p, i: F.when(p["look"] & ~F.array_contains(theirs, p["name"]), i + 1))
    return F.filter(every, lambda i: i.isNotNull())


def _cuts(keys: DataFrame, n: int) -> tuple[list, object]:
    """Keys of rows at which ``n`` ranges begin, descending, and the greatest key; from about ``SAMPLE`` keys, those with the least hashes."""
    size, top = keys.agg(F.count("*"), F.max("key")).first()
    share = min(1.0, SAMPLE / max(1, size))
    some = keys.where(F.pmod(F.xxhash64("key"), F.lit(1 << 40)) < int(share * (1 << 40))).distinct().collect()
    some = sorted((tuple(r.key) for r in some), reverse=True)
    return sorted({some[i * len(some) // n] for i in range(1, n)} if some else set(), reverse=True), top


def _bucket(cuts: list, key: Column) -> Column:
    """How many of the descending cuts are not below ``key``: first by blocks of them, then inside one."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) or 1
    lits = lambda rows: F.array(*[F.struct(*(F.lit(int(v)).cast("long").alias(c) for c, v in zip(("known", "id", "sig"), r))) for r in rows])
    upto = lambda some: F.size(F.filter(some, lambda c: c >= key))
    block = upto(lits(cuts[step - 1 :: step]))
    return (block * step + upto(F.slice(lits(cuts), block * step + 1, F.lit(step)))).cast("int")


def with_next(docs: DataFrame, n: int | None = None) -> DataFrame:
    """``doc_id, text, fp, next_text, next_fp``: each row with the row that follows it by descending doc_id, the first one following the last.

    Null doc_ids come last; rows that share one stand by descending xxhash64 of their texts. Rows are dealt once, in ranges
    that begin with rows of the table; the row at which a range begins is also sent to the range before, which needs it as its
    last row's next. Rows alike in doc_id and text stay in one range.
    """
    n = n or partitions(docs.sparkSession)
    ranges = n * RANGES
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.col("doc_id").cast("long")
    key = F.struct(doc.isNotNull().cast("long").alias("known"), F.coalesce(doc, F.lit(0)).alias("id"), F.xxhash64(text).alias("sig"))
    cuts, top = _cuts(docs.select(key.alias("key")), ranges)
    if top is not None:
        cuts = [c for c in cuts if c < tuple(top)]
    rows = docs.select(doc.alias("doc_id"), text.alias("text"), key.alias("key"))
    own = _bucket(cuts, F.col("key"))
    first = F.array(*[F.struct(*(F.lit(int(v)).cast("long").alias(c) for c, v in zip(("known", "id", "sig"), r))) for r in (cuts if top is None else [tuple(top), *cuts])])
    begins = F.array_contains(first, F.col("key")) if top is not None else F.lit(False)
    before = F.when(begins, F.pmod(F.col("own") - 1, F.lit(len(cuts) + 1)))
    ghost = F.struct(before.alias("range"), F.lit(True).alias("ghost"))
    mine = F.struct(F.col("own").alias("range"), F.lit(False).alias("ghost"))
    dealt = rows.withColumn("own", own).withColumn("to", F.explode(F.when(begins, F.array(mine, ghost)).otherwise(F.array(mine)))).select("doc_id", "text", "key", "to.*")
    dealt = dealt.repartition(n, "range").withColumn("fp", fingerprint(F.col("text")))
    order = Window.partitionBy("range").orderBy(F.col("ghost"), F.col("key").desc())
    follows = F.lead(F.struct("text", "fp")).over(order)
    return dealt.withColumn("next", follows).where("not ghost").select("doc_id", "text", "fp", F.col("next.text").alias("next_text"), F.col("next.fp").alias("next_fp"))


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how like they and the next document's are.

    In the edited text the last third (rounded down) of the code points is replaced by the first as many of the next document
    by descending doc_id, or by all of it where it is shorter; see ``with_next`` for ties and nulls. Returns ``doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. Null texts are empty; an empty table has no
    rows; further columns are ignored.
    """
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.left("text", (F.col("n_chars") - third).cast("int")), F.left("next_text", third))
    rows = rows.withColumn("edited", edited).withColumn("edited_fp", fingerprint(F.col("edited")))
    rows = rows.withColumns({"_own": piece_digests(F.col("fp")), "_edited": piece_digests(F.col("edited_fp")), "_next": piece_digests(F.col("next_fp"))})
    near = lambda other, pieces: F.round(likeness(F.col("fp"), F.col(other), (F.col("_own"), F.col(pieces))), 6)
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.col("fp").alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"), near("edited_fp", "_edited").alias("near_edited"), near("next_fp", "_next").alias("near_next"))
