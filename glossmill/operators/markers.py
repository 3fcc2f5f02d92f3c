"""Modality and pronoun markers, counted in one pass over the tokens of a text."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.text import ratio
from .lexicons import AMBIGUOUS, CERTAINTY, HEDGING, INGROUP, NOT_EPISTEMIC, OUTGROUP, TITLES

_CONTRACTION = r"(?i)(\p{L})(n't|'ll|'re|'ve|'s|'d|'m)(?!\p{L})"
_TOKEN = r"n't|'\p{L}+|\p{L}+|[.!?\n]|[^\s\p{L}.!?]+"
#: What is counted of a text.
_FIELDS = ["words", "certainty", "hedging", "sure", "unsure", "ours", "theirs"]
COUNTED = StructType([StructField(f, LongType()) for f in _FIELDS])


@lru_cache(1)
def _patterns() -> tuple[regex.Pattern, regex.Pattern]:
    return regex.compile(_CONTRACTION), regex.compile(_TOKEN)


def tokens(text: str) -> list[str]:
    """Words with contractions split off, sentence ends, and other runs; an approximation of a parser's tokens."""
    split, token = _patterns()
    return token.findall(split.sub(r"\1 \2", text) if "'" in text else text)  # all contractions have one


def _counts_for() -> dict[str, tuple[int, ...]]:
    """Word -> what it adds to ``COUNTED`` from the second on."""
    out: dict[str, list[int]] = {}

    def add(words: list[str], *fields: str) -> None:
        for w in words:
            row = out.setdefault(w, [0] * (len(_FIELDS) - 1))
            for f in fields:
                row[_FIELDS.index(f) - 1] += 1

    add(CERTAINTY, "certainty")
    add([w for w in CERTAINTY if w not in NOT_EPISTEMIC], "sure")
    add(HEDGING, "hedging", "unsure")
    add(INGROUP, "ours")
    add(OUTGROUP, "theirs")
    for w in AMBIGUOUS:
        add([w], "hedging", *(["unsure"] if w == "may" else []))
    return {w: tuple(r) for w, r in out.items()}


ADDS, _AMBIGUOUS, _TITLES = _counts_for(), frozenset(AMBIGUOUS), frozenset(TITLES)


def count_markers(text: str) -> tuple[int, ...]:
    """The fields of ``COUNTED``. One walk over the tokens holds the token before and all counters.

    An ambiguous word is a modal at the start of a sentence, in lower case, or not after a title.
    """
    words, sums, before = 0, [0] * (len(_FIELDS) - 1), None
    for token in tokens(text):
        if token[0].isalpha() and token != "n't":
            words += 1
            low = token.lower()
            adds = ADDS.get(low)
            if adds and not (low in _AMBIGUOUS and before not in (None, ".", "!", "?", "\n") and token[0].isupper() and before.lower() in _TITLES):
                for i, k in enumerate(adds):
                    sums[i] += k
        before = token
    return words, *sums


@F.pandas_udf(COUNTED)
def _counted(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([count_markers(t or "") for t in texts], columns=_FIELDS)


def with_markers(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with the modal and pronoun columns of a text. Ratios without a hit are null, rates without a word 0; a null text is empty."""
    return df.withColumn("_counted", _counted(text)).withColumns(marker_columns(F.col("_counted"))).drop("_counted")


def marker_columns(found: Column) -> dict[str, Column]:
    words, certainty, hedging, sure, unsure, ours, theirs = (found[f] for f in _FIELDS)
    rate = lambda x: F.round(F.coalesce(F.try_divide(x * F.lit(1000.0), words), F.lit(0.0)), 4)
    return {
        "modal_certainty_count": certainty, "modal_hedging_count": hedging, "modal_word_count": words,
        "modal_certainty_per1k": rate(certainty), "modal_hedging_per1k": rate(hedging),
        "modal_certainty_ratio": ratio(certainty, certainty + hedging), "modal_epistemic_ratio": ratio(sure, sure + unsure),
        "modal_balance": rate(certainty - hedging), "modal_epi_balance": rate(sure - unsure),
        "pron_ingroup_count": ours, "pron_outgroup_count": theirs, "pron_ingroup_per1k": rate(ours), "pron_outgroup_per1k": rate(theirs),
        "pron_inclusion_index": rate(ours - theirs), "pron_ingroup_ratio": ratio(ours, ours + theirs),
    }
