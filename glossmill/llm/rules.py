"""Quality rules as one projection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent short words of four languages.
STOP_WORDS = (
    "the of and to in is that it for with as was on are by this be at or from "
    "der die das und ist nicht ein eine zu den mit von auf für im sich des dem "
    "le la les de des un une et est que qui pas dans pour sur au par en "
    "el los las del y no una con por se su para como lo"
).split()
SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\x0b\x0c\r"

#: (feature, least, most); null: no bound. A document is kept if every feature is inside.
THRESHOLDS: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 20, None),
    ("mean_word_chars", 2.0, 14.0),
    ("symbol_ratio", None, 0.25),
    ("upper_ratio", None, 0.5),
    ("stop_ratio", 0.01, None),
    ("dup_line_ratio", None, 0.5),
    ("short_line_ratio", None, 0.9),
)


def _let(value: Column, use) -> Column:  # noqa: ANN001
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _strip(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def repeated_words(words: Column, size: int = 8) -> Column:
    """Words inside windows of ``size`` words that occur twice or more in the array, the first included.

    Each word is hashed once, and windows by the hashes of their words; where no hash repeats, nothing more is done. Otherwise (hash, place)
    pairs are sorted, neighbours with equal hashes give the places, and one fold over the sorted
    places adds up what they cover, so the work is n log n for any length.
    """

    def windows(hashed: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashed) - size), lambda i: F.xxhash64(*(F.get(hashed, i + j) for j in range(size))))

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(p: Column) -> Column:
            last = F.size(p) - 1
            twice = F.filter(p, lambda x, i: ((i > 0) & (F.get(p, F.greatest(i - 1, F.lit(0)))["h"] == x["h"])) | ((i < last) & (F.get(p, F.least(i + 1, last))["h"] == x["h"])))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        start = F.struct(F.lit(-size).alias("last"), F.lit(0).cast("long").alias("n"))
        fold = lambda at: F.aggregate(at, start, lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(size), i - s["last"])).alias("n")))["n"]
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(fold(_let(pairs, places)))

    return F.when(F.size(words) < size + 1, F.lit(0).cast("long")).otherwise(_let(_let(F.transform(words, lambda w: F.xxhash64(w)), windows), covered))


def compiled(table: tuple, features: dict[str, Column]) -> Column:
    """The conjunction of a threshold table over feature columns; a null feature is outside no bound."""
    bounds = [c for name, least, most in table for c in ((features[name] >= least) if least is not None else None, (features[name] <= most) if most is not None else None) if c is not None]
    return reduce(lambda a, b: a & b, (F.coalesce(c, F.lit(True)) for c in bounds), F.lit(True))


def quality_rules(docs: DataFrame, thresholds: tuple = THRESHOLDS) -> DataFrame:
    """Counts, ratios and verdict of every whole text, by built-in functions in one projection.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept`` and the ratios of the threshold table. A document fails the base rules with under 20
    words, or if over 30 % of its words stand in repeated 8-word windows; otherwise it is kept
    if every feature is inside its thresholds.

    A null or empty text has no words and fails. A null doc_id stays null; repeated rows give
    repeated rows; further columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda line: F.length(_strip(line, _SPACE)) > 0)
    rows = rows.select("doc_id", "text", words.alias("words"), lines.alias("lines"))
    stop = [w for w in dict.fromkeys(STOP_WORDS)]
    n = lambda c: c.cast("long")
    counts = rows.select(
        "doc_id",
        n(F.size("words")).alias("n_words"),
        n(F.length(_strip(F.col("text"), _SPACE))).alias("word_chars"),
        n(F.length("text") - F.length(_strip(F.col("text"), SYMBOLS))).alias("n_symbols"),
        n(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        n(F.size("lines")).alias("n_lines"),
        n(F.size(F.filter("words", lambda w: F.rtrim(F.lower(w), F.lit(".,")).isin(stop)))).alias("n_stop"),
        n(F.length("text") - F.length(_strip(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).alias("n_upper"),
        n(F.size(F.filter("lines", lambda line: F.length(line) < 20))).alias("n_short_lines"),
    )
    c = F.col
    features = {
        "n_words": c("n_words"),
        "mean_word_chars": F.try_divide("word_chars", "n_words"),
        "symbol_ratio": F.try_divide("n_symbols", "n_words"),
        "upper_ratio": F.try_divide("n_upper", "word_chars"),
        "stop_ratio": F.try_divide("n_stop", "n_words"),
        "dup_line_ratio": F.try_divide("n_dup_lines", "n_lines"),
        "short_line_ratio": F.try_divide("n_short_lines", "n_lines"),
    }
    failed = (c("n_words") < 20) | (100 * c("n_repeat_words") > 30 * c("n_words"))
    ratios = [v.alias(k) for k, v in features.items() if k != "n_words"]
    return counts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & compiled(thresholds, features)).alias("kept"), *ratios)
