"""Lexicon densities, counted inside each row: no join, no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import density, word_count, word_tokens
from .automaton import group_counts, terms_of
from .lexicons import Term

Lexicon = Sequence[Term] | DataFrame


def _terms(lexicon: Lexicon) -> list[Term]:
    return terms_of(lexicon) if isinstance(lexicon, DataFrame) else list(lexicon)


def lexicon_counts(docs: DataFrame, lexicon: Lexicon, body: str = "body", by: str = "category") -> DataFrame:
    """``docs`` with ``n_words`` and a column ``n_<value>`` for each tier or category of the lexicon, a list or a table of terms.

    A null body has no hits.
    """
    rows = docs.withColumn("_lowered", F.lower(F.coalesce(F.col(body), F.lit(""))))
    counted = {f"n_{g}": c for g, c in group_counts(F.col("_lowered"), _terms(lexicon), by).items()}
    return rows.withColumns({"n_words": word_count(F.col("_lowered")), **counted}).drop("_lowered")


Counts = Callable[..., Column]


def counts_of(docs: DataFrame, lowered: Column, lexicons: dict[str, Lexicon]) -> tuple[DataFrame, Callable[[str], Counts]]:
    """``docs`` with the hits of all terms of all lexicons in one pass, and a function that sums those of a name by tier and category."""
    named = [Term(name, t.term, t.tier, t.category) for name, lexicon in lexicons.items() for t in _terms(lexicon)]
    found = group_counts(lowered, named)
    rows = docs.withColumn("_found", F.array(*found.values()) if found else F.array().cast("array<bigint>"))
    place = {g: F.col("_found")[i] for i, g in enumerate(found)}

    def of(name: str) -> Counts:
        def total(tier: int | None = None, category: str | None = None) -> Column:
            some = [c for (lexicon, t, k), c in place.items() if lexicon == name and tier in (None, t) and category in (None, k)]
            return sum(some, F.lit(0).cast("long"))

        return total

    return rows, of


def dehumanisation(count: Counts, words: Column) -> dict[str, Column]:
    """Totals by tier and densities by tier and category; all 0 for a text of no words."""
    tier = {k: F.when(words > 0, count(tier=k)).otherwise(F.lit(0).cast("long")) for k in (1, 2)}
    cat = lambda c: density(count(category=c), words)
    total = tier[1] + tier[2]
    return {
        "dehum_total": total, "dehum_tier1": tier[1], "dehum_tier2": tier[2],
        "dehum_density": density(total, words), "dehum_tier1_density": density(tier[1], words), "dehum_tier2_density": density(tier[2], words),
        "dehum_mass_metaphor_density": cat("mass_metaphor"), "dehum_criminalisation_density": cat("criminalisation"),
        "dehum_burden_density": cat("burden_framing"), "dehum_threat_density": cat("threat_framing"),
    }


def outrage(count: Counts, words: Column) -> dict[str, Column]:
    total = F.when(words > 0, count()).otherwise(F.lit(0).cast("long"))
    cat = lambda c: density(count(category=c), words)
    return {
        "outrage_total": total, "outrage_density": density(total, words), "outrage_condemnation_density": cat("moral_condemnation"),
        "outrage_shame_density": cat("institutional_shame"), "outrage_intensifier_density": cat("outrage_intensifier"), "outrage_tabloid_density": cat("tabloid_outrage"),
    }


def term_totals(docs: DataFrame, terms: DataFrame, body: str = "body", by: list[str] | None = None) -> DataFrame:
    """Hits of each single-word term over all texts: tokens are counted before they meet the small term table."""
    by = by or []
    tokens = docs.select(*by, F.explode(word_tokens(F.lower(F.col(body)))).alias("term")).groupBy(*by, "term").agg(F.count("*").alias("hits"))
    return tokens.join(terms, "term")
