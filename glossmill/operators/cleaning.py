"""Removal of boilerplate by ordered rules for each outlet, all in built-in functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_count
from .tables import CLEANING_HINTS, hinted_outlet


@dataclass(frozen=True)
class Rule:
    """A replacement; flags: i ignores case, s lets the dot match line ends, m matches at lines.

    ``needs`` are pieces that stand in every text the pattern is found in, so that other texts are passed over without a search. Where case is ignored
    they are in small letters and without i, k and s, which other letters than their capitals match (dotless i, Kelvin sign, long s).
    """

    outlet: str
    pattern: str
    replacement: str = ""
    flags: str = ""
    needs: tuple[str, ...] = ()

    @property
    def java(self) -> str:
        """``.`` and ``$`` know only the line feed; case and classes follow Unicode."""
        return f"(?dU{'iu' * ('i' in self.flags)}{'s' * ('s' in self.flags)}{'m' * ('m' in self.flags)}){self.pattern}"


#: Named steps that a replacement can't say; a rule's pattern names them.
HEADLINE_BLOCK, NEXT_BLOCK = "@headline block", "@next block"

# What to remove, by outlet, in order.
_KEYWORD = "(?:newsletter|inbox|email briefing|email with|weekly email|weekly roundup|morning mail|morning briefing|long read weekly|daily email|delivered to|subscribe now)"
RULES = [
    Rule("express", "’", "'", needs=("’",)),
    Rule("express", HEADLINE_BLOCK),
    Rule("express", r"\nDON'T MISS:.*", "", "i", needs=("\ndon't m",)),
    Rule("express", r"^DON'T MISS:.*", "", "i", needs=("don't m",)),
    Rule("express", r"\nJUST IN:.*", "", "i", needs=("\nju", "n:",)),
    Rule("express", r"^JUST IN:.*", "", "i", needs=("ju", "n:",)),
    Rule("express", r"\nRead more:.*", "", "i", needs=("\nread more:",)),
    Rule("express", r"^Read more:.*", "", "i", needs=("read more:",)),
    Rule("independent", r"\n- Bookmark", needs=("\n- Bookmark",)),
    Rule("independent", r"^- Bookmark", needs=("- Bookmark",)),
    Rule("independent", r"\n- CommentsGo to comments", needs=("\n- CommentsGo to comments",)),
    Rule("independent", r"^- CommentsGo to comments", needs=("- CommentsGo to comments",)),
    Rule("independent", r"\nJoin our commenting forum\n.*?see their replies\nComments\s*$", "", "s", needs=("\nJoin our commenting forum",)),
    Rule("independent", r"\nJoin our commenting forum.*$", "", "s", needs=("\nJoin our commenting forum",)),
    Rule("guardian", "’", "'", needs=("’",)),
    Rule("guardian", r"(?:\n|\s+)Do you have an opinion on the issues raised.*$", "", "s", needs=("Do you have an opinion on the issues raised",)),
    Rule("guardian", r"(?:\n|\s+)Have an opinion on anything you(?:'ve| have) read.*$", "", "s", needs=("Have an opinion on anything you",)),
    Rule("guardian", r"(?:\n|\s+)(?:•\s*)?Join the debate\s*[–\-].*$", "", "s", needs=("Join the debate",)),
    Rule("guardian", rf"(?:\n|\s+)Sign up[^.!?]{{0,200}}{_KEYWORD}[^.!?]*[.!?]", "", "i", needs=("gn up",)),
    Rule("guardian", rf"(?:\n|\s+)Sign up[^.!?\n]{{0,80}}(?:here|now|today)[.!]\s*(?:[A-Z][^.!?]{{0,150}}{_KEYWORD}[^.!?]*[.!?])?", "", "i", needs=("gn up",)),
    Rule("star", "’", "'", needs=("’",)),
    Rule("star", r"\nTo (?:get more|stay up to date)[^\n]*sign up[^\n]*\.?", "", "i", needs=("\nto ", "gn up",)),
    Rule("star", r"\nFor the latest breaking news[^\n]*sign up[^\n]*\.?", "", "i", needs=("\nfor the late", "gn up",)),
    Rule("star", r"\nWant all the biggest[^\n]*[Ss]ign up[^\n]*\.?", "", "i", needs=("\nwant all the b", "gn up",)),
    Rule("star", r",?\s*sign up for our (?:free )?(?:Daily Star \w+ )?newsletters?\b[^\n]*\.?", "", "i", needs=("gn up for our ",)),
    Rule("star", r",?\s*sign up to one of our (?:free )?newsletters here\s*\.?", "", "i", needs=("gn up to one of our ",)),
    Rule("star", NEXT_BLOCK, needs=("\nread next",)),
    Rule("star", r"\nREAD NEXT(?::|\.{3}|…)?\s*$", "", "im", needs=("\nread next",)),
    Rule("star", r"\nREAD MORE:\s*", "\n", "i", needs=("\nread more:",)),
    Rule("star", r"^READ MORE:\s*", "", "i", needs=("read more:",)),
    Rule("star", r"\nDON'T MISS:.*", "", "i", needs=("\ndon't m",)),
    Rule("star", r"^DON'T MISS:.*", "", "i", needs=("don't m",)),
    Rule("mirror", "’", "'", needs=("’",)),
    Rule("mirror", r",?\s*[Ss]ign up for all the best[^\n]*from the Mirror[^\n]*\.", needs=("ign up for all the best", "from the Mirror",)),
    Rule("mirror", r"\nNEWSLETTER:[^\n]*", "", "i", needs=("\nnew", "letter:",)),
    Rule("mirror", r"\nREAD MORE: Join our[^\n]*WhatsApp[^\n]*", "", "i", needs=("\nread more: jo", "app",)),
    Rule("mirror", r"\nJoin our[^\n]*WhatsApp[^\n]*", "", "i", needs=("\njo", "n our", "app",)),
    Rule("mirror", r"\nGet [^\n]*straight to your WhatsApp[^\n]*", "", "i", needs=("\nget ", "ght to your what",)),
    Rule("mirror", r"\n[^\n]*the Mirror has launched its very own[^\n]*WhatsApp[^\n]*", "", "i", needs=(" launched ", "app",)),
    Rule("mirror", r"\nWe'll send you the latest[^\n]*WhatsApp[^\n]*", "", "i", needs=("\nwe'll ", "end you the late",)),
    Rule("mirror", r"\nAll you have to do to join[^\n]*", "", "i", needs=("\nall you have to do to jo",)),
    Rule("mirror", r"(?:\n\*?\s*)?Join The Mirror.s WhatsApp Community[^\n]*", "", "i", needs=("n the m", "app commun",)),
    Rule("mirror", r"\nPARTY GAMES:[^\n]*", "", "i", needs=("\nparty game",)),
    Rule("mirror", r"\nRead more:.*\n", "\n", "i", needs=("\nread more:",)),
    Rule("mirror", r"\nREAD MORE:\s*", "\n", "i", needs=("\nread more:",)),
    Rule("mirror", r"^READ MORE:\s*", "", "i", needs=("read more:",)),
]

#: The first of these that stands in the outlet's name names its rules.
ROUTES = ("express", "independent", "guardian", "star", "mirror")


def headline_block(body: Column, most: int = 10, long_line: int = 100) -> Column:
    """Without headers of headline blocks and the lines below them.

    A fold over the lines: after a header, up to ``most`` lines go, until a blank one or one that
    is as long as prose and ends like it. A first line is no header, nor is a last one.
    """
    lines = F.split(body, "\n", -1)
    header = lambda line: line.rlike(r"(?iu)^DON'T MISS(?::|\.{3}|…)?[ \t]*$")
    bare = lambda line: F.regexp_replace(line, r"(?U)\s+\z", "")
    prose = lambda line: (bare(line) == "") | ((F.length(bare(line)) >= long_line) & bare(line).rlike(r"[.\"”]\z"))
    last = F.size(lines) - 1
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("left"))

    def step(s: Column, x: Column) -> Column:
        line, i = x["line"], x["i"]
        opens = header(line) & (i > 0) & (i < last)
        takes = (s["left"] > 0) & ~prose(line)
        kept = F.when(opens & (s["left"] == 0), s["kept"]).when(takes, s["kept"]).otherwise(F.concat(s["kept"], F.array(line)))
        left = F.when(opens & (s["left"] == 0), F.lit(most)).when(takes, s["left"] - 1).otherwise(F.lit(0))
        return F.struct(kept.alias("kept"), left.alias("left"))

    numbered = F.transform(lines, lambda line, i: F.struct(line.alias("line"), i.alias("i")))
    cut = F.array_join(F.aggregate(numbered, start, step)["kept"], "\n")
    return F.when(body.rlike(r"(?iu)\nDON'T MISS"), cut).otherwise(body)


def next_block(body: Column) -> Column:
    """Without the block below a READ NEXT header: up to a blank line followed by two letters, or to the end if no blank line comes.

    Where a blank line is followed by anything else the block ends at it.
    """
    pattern = r"(?diu)\nREAD NEXT(?::|\.{3}|…)?[^\S\n]*\n+(?:[^\n]++\n?+)++"
    return F.regexp_replace(body, pattern, "\n")


_STEPS = {HEADLINE_BLOCK: headline_block, NEXT_BLOCK: next_block}


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it stands in there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _with_lowered(body: Column) -> Column:
    return F.struct(body.alias("body"), F.lower(body).alias("lowered"))


def _replaced(text: Column, rule: Rule) -> Column:
    """What a rule makes of a text, which comes with its small letters; only a text that has the pieces the rule needs is searched and lowered anew."""

    def step(t: Column) -> Column:
        said = t["lowered"] if "i" in rule.flags or rule.pattern == NEXT_BLOCK else t["body"]
        done = _STEPS[rule.pattern](t["body"]) if rule.pattern in _STEPS else F.regexp_replace(t["body"], rule.java, rule.replacement)
        return F.when(reduce(lambda x, y: x & y, [F.contains(said, F.lit(n)) for n in rule.needs], F.lit(True)), _named(done, _with_lowered)).otherwise(t)

    return _named(text, step)


def apply_rules(body: Column, rules: list[Rule]) -> Column:
    """Rules one after another, then white space off both ends."""
    done = F.regexp_replace(reduce(_replaced, rules, _with_lowered(body))["body"], r"(?U)^\s+", "")
    # the search for white space at the end tries every run of it
    return _named(done, lambda b: F.when(F.substring(b, -1, 1).rlike(r"(?U)\s"), F.regexp_replace(b, r"(?U)\s+\z", "")).otherwise(b))


def route(outlet: Column, routes: tuple[str, ...] = ROUTES) -> Column:
    return F.coalesce(*[F.when(F.contains(F.lower(outlet), F.lit(r)), F.lit(r)) for r in routes])


def clean(articles: DataFrame, rules: list[Rule] = RULES, body: str = "body", outlet: str = "outlet", file_name: str = "file_name") -> DataFrame:
    """``articles`` with the body cleaned by the rules of each row's outlet and counted anew.

    The outlet is the row's own or, where there is none, what the name of its file hints at (if there is such a column). A null body
    stays null with 0 words; the body of an unknown outlet, or of none, stays as it is. ``words_before``
    is the count that came with the row, 0 where it is no number.
    """
    names = list(dict.fromkeys(r.outlet for r in rules))
    found = ([F.col(outlet)] if outlet in articles.columns else []) + ([hinted_outlet(F.col(file_name), CLEANING_HINTS)] if file_name in articles.columns else [])
    to = route(F.coalesce(*found) if found else F.lit(None).cast("string"), tuple(n for n in ROUTES if n in names) + tuple(n for n in names if n not in ROUTES))
    cleaned = F.col(body)
    for name in names:
        cleaned = F.when(to == name, apply_rules(F.col(body), [r for r in rules if r.outlet == name])).otherwise(cleaned)
    before = F.coalesce(F.col("wordcount").cast("string").try_cast("double").cast("long"), F.lit(0).cast("long")) if "wordcount" in articles.columns else word_count(F.col(body))
    return articles.withColumn("words_before", before).withColumn(body, cleaned).withColumn("wordcount", word_count(F.col(body)))


def cleaning_report(cleaned: DataFrame) -> DataFrame:
    """Words before and after, and the share removed in per cent; null where there were none."""
    sums = cleaned.agg(F.sum("words_before").alias("words_before"), F.sum("wordcount").alias("words_after"))
    removed = F.col("words_before") - F.col("words_after")
    return sums.select("words_before", "words_after", removed.alias("words_removed"), F.round(F.try_divide(100 * removed, "words_before"), 4).alias("removed_pct"))
