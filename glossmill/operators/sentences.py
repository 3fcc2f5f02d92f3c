"""Sentences and their sentiment."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_count

_STRIP = r"(?U)^\s+|\s+\z"


def sentences(text: Column, least_words: int = 10) -> Column:
    """Pieces between a sentence end followed by white space, or line ends, of ``least_words`` words or more."""
    pieces = F.transform(F.split(text, r"(?U)(?<=[.!?])\s+|\n+"), lambda s: F.regexp_replace(s, _STRIP, ""))
    return F.coalesce(F.filter(pieces, lambda s: word_count(s) >= least_words), F.array().cast("array<string>"))


# Constants of the published rule set (Hutto and Gilbert 2014).
BOOST, CAPS, NEGATED, NEVER_SO, NORMAL = 0.293, 0.733, -0.74, 1.25, 15.0
FADES = (1.0, 0.95, 0.9)
EXCLAIM, EXCLAIM_MOST, ASK, ASK_MOST = 0.292, 4, 0.18, 0.96
NEGATIONS = [
    "not", "no", "never", "none", "nobody", "nothing", "neither", "nor", "nowhere", "without", "cannot", "can't", "don't", "won't", "isn't", "wasn't", "aren't", "weren't",
    "doesn't", "didn't", "couldn't", "shouldn't", "wouldn't", "hasn't", "haven't", "hadn't", "rarely", "seldom", "despite",
]
BOOSTERS = ["very", "really", "extremely", "absolutely", "completely", "deeply", "highly", "hugely", "incredibly", "particularly", "so", "totally", "utterly"]
DAMPENERS = ["barely", "hardly", "scarcely", "slightly", "somewhat", "marginally", "partly", "occasionally", "almost", "kinda", "sorta", "kind of", "sort of"]

#: A small word list of our own for demonstrations; the published one is given as a table.
DEMO_VALENCE = {"good": 1.9, "great": 3.1, "happy": 2.7, "love": 3.2, "safe": 1.9, "welcome": 2.0, "hope": 1.9, "bad": -2.5, "terrible": -2.1, "hate": -2.7, "fear": -2.2, "crisis": -3.1, "threat": -2.4, "idiot": -2.3, "sad": -2.1}
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def scale_table(rows: DataFrame, most: int = 1_000_000) -> dict[str, float]:
    """``term, weight`` of a table (valences, or boosters above and dampeners below 0) by lower-case term; too many rows are an error."""
    found = rows.where("term is not null and weight is not null").select(F.lower("term").alias("term"), F.col("weight").cast("double")).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"the table has more than {most} terms")
    return dict(sorted(tuple(r) for r in found))


@dataclass(frozen=True)
class SentimentRules:
    """What words weigh, what strengthens or weakens them, and what turns them round."""

    valence: dict[str, float]
    boosters: dict[str, float] = field(default_factory=lambda: {**dict.fromkeys(BOOSTERS, BOOST), **dict.fromkeys(DAMPENERS, -BOOST)})
    negations: frozenset[str] = frozenset(NEGATIONS)

    def words(self, sentence: str) -> list[str]:
        """Words without the marks around them; what would be two characters or fewer stays, as it may be a face."""
        bare = ((w, w.strip(_MARKS)) for w in sentence.split())
        return [w if len(b) <= 2 else b for w, b in bare]

    def _turned(self, low: list[str], i: int, far: int) -> float:
        """By what the word ``far`` places back turns the valence of word ``i``."""
        before, between = low[i - far], low[i - far + 1 : i]
        if far > 1 and before == "never" and any(w in ("so", "this") for w in between):
            return NEVER_SO
        if far > 1 and before == "without" and "doubt" in between:
            return 1.0
        return NEGATED if before in self.negations or "n't" in before else 1.0

    def _at(self, words: list[str], low: list[str], i: int, mixed: bool) -> float:
        known, word = self.valence, low[i]
        if word not in known or word in self.boosters or low[i : i + 2] == ["kind", "of"]:
            return 0.0
        v = 0.0 if word == "no" and i + 1 < len(low) and low[i + 1] in known else known[word]
        if "no" in low[max(0, i - 2) : i] or i > 2 and low[i - 3] == "no" and low[i - 1] in ("or", "nor"):
            v = known[word] * NEGATED
        if mixed and words[i].isupper():
            v += CAPS if v > 0 else -CAPS
        for far, fade in enumerate(FADES, 1):
            if far > i or low[i - far] in known:
                continue
            step = self.boosters.get(low[i - far], 0.0)
            if step:
                step = -step if v < 0 else step
                if mixed and words[i - far].isupper():
                    step += CAPS if v > 0 else -CAPS
                v += step * fade
            v *= self._turned(low, i, far)
            if far == len(FADES):  # phrases count as they are, whatever the sign
                v += sum(self.boosters.get(" ".join(low[a:b]), 0.0) for a, b in ((i - 3, i), (i - 3, i - 1), (i - 2, i)))
        if i > 0 and low[i - 1] == "least" and "least" not in known and not (i > 1 and low[i - 2] in ("at", "very")):
            v *= NEGATED
        return v

    def compound(self, sentence: str) -> float:
        words = self.words(sentence)
        low = [w.lower() for w in words]
        hits = [i for i, w in enumerate(low) if w in self.valence]
        if not hits:
            return 0.0
        shouted = sum(w.isupper() for w in words)
        turn = low.index("but") if "but" in low else None
        side = lambda i: 1.0 if turn is None or i == turn else 0.5 if i < turn else 1.5
        total = sum(self._at(words, low, i, 0 < shouted < len(words)) * side(i) for i in hits)
        asks = sentence.count("?")
        emphasis = min(sentence.count("!"), EXCLAIM_MOST) * EXCLAIM + (0.0 if asks < 2 else asks * ASK if asks <= 3 else ASK_MOST)
        total += math.copysign(emphasis, total) if total else 0.0
        return round(max(-1.0, min(1.0, total / math.sqrt(total * total + NORMAL))), 4)


def rule_scorer(rules: SentimentRules | dict[str, float]) -> Callable[[list[str]], list[float]]:
    """Compound scores of sentences by the published rules over tables of words (see ``scale_table``)."""
    rules = rules if isinstance(rules, SentimentRules) else SentimentRules(rules)
    return lambda some: [rules.compound(s) for s in some]


def sentiment(docs: DataFrame, scorer: Callable[[list[str]], list[float]], body: str = "body", positive: float = 0.05) -> DataFrame:
    """``docs`` with the means and shares of sentence scores; null and 0 sentences where there are none.

    ``scorer`` gets the sentences of a batch at once; scores come back as an array, and the rest is built-in. Scores have four digits, so
    they are summed as whole numbers.
    """

    @F.pandas_udf("array<double>")
    def scored(batch: pd.Series) -> pd.Series:
        sizes = [len(s) for s in batch]
        flat = iter(scorer([x for s in batch for x in s]))
        return pd.Series([list(islice(flat, n)) for n in sizes], dtype=object)

    c = F.col("_scores")
    n = F.size(c)
    total = F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    pos, neg = F.size(F.filter(c, lambda s: s >= positive)), F.size(F.filter(c, lambda s: s <= -positive))
    share = lambda x: F.round(F.try_divide(x, n), 4)
    return docs.withColumn("_scores", scored(sentences(F.col(body)))).withColumns({
        "sentiment_compound": F.round(F.try_divide(F.round(total * 10_000), n * 10_000), 4), "sentiment_pos_ratio": share(pos), "sentiment_neg_ratio": share(neg),
        "sentiment_neu_ratio": share(n - pos - neg), "sentiment_n_sentences": n,
    }).drop("_scores")
