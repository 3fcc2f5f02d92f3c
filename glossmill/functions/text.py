"""Column functions over text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_count(body: Column) -> Column:
    """Runs of characters that are not Unicode white space; a null text has none."""
    return F.coalesce(F.regexp_count(body, F.lit(r"(?U)\S+")), F.lit(0)).cast("long")


def word_tokens(lowered: Column) -> Column:
    """Maximal runs of letters, digits and underscores."""
    return F.regexp_extract_all(lowered, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def phrase_count(lowered: Column, phrase: str) -> Column:
    """Occurrences of a literal, left to right, without overlap and without word borders."""
    gone = F.replace(lowered, F.lit(phrase), F.lit(""))
    return ((F.length(lowered) - F.length(gone)) / len(phrase)).cast("long")


def density(n: Column, words: Column) -> Column:
    """``n`` per thousand words to four places, 0 for a text of no words."""
    return F.round(F.coalesce(F.try_divide(n, words / F.lit(1000.0)), F.lit(0.0)), 4)


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` to four places, null where ``b`` is 0."""
    return F.round(F.try_divide(a, b), 4)


def contains_any(text: Column, keywords: list[str]) -> Column:
    """Whether the lower-cased text has one of the keywords anywhere, inside words too."""
    lowered = F.lower(text)
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(k.lower())) for k in keywords], F.lit(False)), F.lit(False))


def or_query(keywords: Column) -> Column:
    """``a, b`` becomes ``a OR b``."""
    return F.array_join(F.transform(F.split(keywords, ","), lambda k: F.trim(k)), " OR ")


def model_input(title: Column | None, body: Column, most: int = 512) -> Column:
    """Title, a full stop and the head of the body; what is missing in a row reads ``nan``, a missing title column is an empty title."""
    said = F.lit("") if title is None else F.coalesce(title, F.lit("nan"))
    return F.concat(said, F.lit(". "), F.substring(F.coalesce(body, F.lit("nan")), 1, most))


def stars(p: Column) -> Column:
    """Marks of significance; none above 0.05 or without a p-value."""
    return F.when(p <= 0.001, "***").when(p <= 0.01, "**").when(p <= 0.05, "*").otherwise("")


def labelled(code: Column, labels: dict[str, str]) -> Column:
    """Readable names of codes, the code itself where there is none."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), code), code) if labels else code
