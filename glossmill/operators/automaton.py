"""Counts of the terms of a lexicon, all in one pass over a text by an automaton of all terms."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .lexicons import Term

#: Terms that a table may have; the automaton lies in the memory of each worker.
MOST_TERMS = 1_000_000


def terms_of(lexicon: DataFrame, most: int = MOST_TERMS) -> list[Term]:
    """The terms of a table (``lexicon, term, tier, category``), each once, in a fixed order; empty ones are left out, too many are an error."""
    rows = lexicon.where("term <> ''").select("lexicon", "term", "tier", "category").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the lexicon has more than {most} terms")
    return sorted((Term(*r) for r in rows), key=lambda t: (t.lexicon or "", t.tier or 0, t.category or "", t.term))


def lexicon_frame(spark: SparkSession, terms: Iterable[Term]) -> DataFrame:
    return spark.createDataFrame([(t.lexicon, t.term, t.tier, t.category) for t in terms], "lexicon string, term string, tier int, category string")


@lru_cache(16)
def _automaton(entries: tuple[tuple[str, int], ...]):  # noqa: ANN202
    """Of each term: its number, length, whether it is one word, and the groups that it counts for."""
    import ahocorasick

    groups: dict[str, list[int]] = {}
    for term, group in entries:
        groups.setdefault(term, []).append(group)
    made = ahocorasick.Automaton()
    for i, (term, of) in enumerate(groups.items()):
        made.add_word(term, (i, len(term), " " not in term, of))
    made.make_automaton()
    return made


def _inside(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")


def count_terms(text: str, automaton: object, n_groups: int) -> list[int]:
    """Hits by group. A single word counts where no letter, digit or underscore is next to it, a phrase left to right without overlap with itself."""
    found, ends = [0] * n_groups, {}
    for end, (number, length, single, groups) in automaton.iter(text):
        start = end - length + 1
        if single:
            if _inside(text, start - 1) or _inside(text, end + 1):
                continue
        elif ends.get(number, -1) >= start:
            continue
        else:
            ends[number] = end
        for g in groups:
            found[g] += 1
    return found


def group_counts(lowered: Column, terms: Sequence[Term], key: str | None = None) -> dict[Hashable, Column]:
    """A column of hits for each group of terms: by an attribute (``tier``, ``category``), or by lexicon, tier and category."""
    name = (lambda t: getattr(t, key)) if key else (lambda t: (t.lexicon, t.tier, t.category))
    groups = list(dict.fromkeys(map(name, terms)))
    entries = tuple((t.term, groups.index(name(t))) for t in terms)
    n = len(groups)

    @F.pandas_udf(ArrayType(LongType()))
    def counted(texts: pd.Series) -> pd.Series:
        if not entries:
            return pd.Series([[0] * n] * len(texts))
        made = _automaton(entries)
        return pd.Series([count_terms(t or "", made, n) for t in texts])

    found = counted(lowered)
    return {g: found[i] for i, g in enumerate(groups)}
