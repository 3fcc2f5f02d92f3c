"""Hand-written cases, one for each behaviour."""

import io
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from glossmill.functions import pvalues, text
from glossmill.operators import align, inference, order, tables
from glossmill.operators.automaton import terms_of
from glossmill.operators.cleaning import RULES, clean, cleaning_report
from glossmill.operators.lexicon import lexicon_counts
from glossmill.operators.lexicons import DEHUMANISATION, OUTRAGE
from glossmill.operators.markers import with_markers
from glossmill.operators.sentences import DEMO_VALENCE, SentimentRules, rule_scorer, scale_table, sentiment
from glossmill.plans.features import article_features, usable
from glossmill.sources import files, web
from glossmill.streaming.incremental import process_new


def bodies(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "url long, body string")


def test_lexicon_sizes():
    assert len({t.term for t in DEHUMANISATION}) == 100 and len({t.term for t in OUTRAGE}) == 82


@pytest.mark.parametrize("body, lexicon, total", [("gang gangs gangster", DEHUMANISATION, 2), ("bogus asylum", DEHUMANISATION, 2), ("open the floodgates", DEHUMANISATION, 2), ("illegal immigrants", DEHUMANISATION, 2), ("Criminal activity", OUTRAGE, 1), ("", OUTRAGE, 0), (None, OUTRAGE, 0)])
def test_lexicon_hits(spark, body, lexicon, total):
    row = lexicon_counts(bodies(spark, body), lexicon, by="lexicon").first()
    assert row[f"n_{lexicon[0].lexicon}"] == total


def test_features_of_articles(spark):
    rows = article_features(bodies(spark, "Flood " + "word " * 49, "", "We will stay and they must go. " * 3)).orderBy("url").collect()
    assert rows[0].dehum_density == 20.0 and rows[0].dehum_tier1 == 1 and rows[0].word_count == 50
    assert rows[1].word_count == 0 and rows[1].dehum_density == 0 and rows[1].modal_epistemic_ratio is None and rows[1].sentiment_compound is None
    assert (rows[2].modal_certainty_count, rows[2].pron_ingroup_count, rows[2].pron_outgroup_count) == (6, 3, 3)
    for r in rows:
        assert r.dehum_tier1 + r.dehum_tier2 == r.dehum_total
    assert usable(bodies(spark, "a " * 49, "a " * 50, None)).count() == 1


@pytest.mark.parametrize("body, hedging", [("Then Theresa May spoke", 0), ("it may rain and would stop", 2), ("May it rain", 1), ("Mr Smith. May we go", 1), ("he won't, could", 1)])
def test_modal_use(spark, body, hedging):
    assert with_markers(bodies(spark, body), F.col("body")).first().modal_hedging_count == hedging


def test_markers(spark):
    row = with_markers(bodies(spark, "we will and they must"), F.col("body")).first()
    assert (row.modal_certainty_count, row.modal_word_count, row.pron_inclusion_index, row.pron_ingroup_ratio) == (2, 5, 0.0, 0.5)
    assert row.modal_epistemic_ratio == 1.0


def test_sentiment(spark):
    score = rule_scorer(DEMO_VALENCE)
    good, very, negated, plain = score(["this is good", "this is very good", "this is not good", "nothing here at all"])
    assert very > good > 0 > negated and plain == 0
    assert score(["this is good!!!"])[0] > good and score(["bad but good"])[0] > 0
    rows = sentiment(bodies(spark, "one two three four five six seven eight nine.", "This is a very good day for all of us here.\nThis is a terrible day for all of us here now."), score).orderBy("url").collect()
    assert rows[0].sentiment_n_sentences == 0 and rows[0].sentiment_compound is None
    assert rows[1].sentiment_n_sentences == 2 and rows[1].sentiment_pos_ratio == rows[1].sentiment_neg_ratio == 0.5 and rows[1].sentiment_neu_ratio == 0


#: Worked cases that were published with the rules: sentence, compound.
PUBLISHED = [
    ("VADER is smart, handsome, and funny.", 0.8316), ("VADER is smart, handsome, and funny!", 0.8439), ("VADER is very smart, handsome, and funny.", 0.8545),
    ("VADER is VERY SMART, handsome, and FUNNY.", 0.9227), ("VADER is VERY SMART, handsome, and FUNNY!!!", 0.9342), ("VADER is not smart, handsome, nor funny.", -0.7424),
    ("The book was good.", 0.4404), ("At least it isn't a horrible book.", 0.431), ("The book was only kind of good.", 0.3832), ("Today SUX!", -0.5461),
    ("The plot was good, but the characters are uncompelling and the dialog is not great.", -0.7042),
]


@pytest.mark.parametrize("sentence, compound", PUBLISHED)
def test_published_sentiment(spark, sentence, compound):
    words = {"smart": 1.7, "handsome": 2.2, "funny": 1.9, "good": 1.9, "horrible": -2.5, "uncompelling": -0.9, "great": 3.1, "sux": -1.5}
    table = spark.createDataFrame([(k.title(), v) for k, v in words.items()] + [(None, 1.0)], "term string, weight double")
    assert rule_scorer(SentimentRules(scale_table(table)))([sentence]) == [compound]


def test_a_table_of_words_is_bounded(spark):
    table = spark.createDataFrame([(f"w{i}", 1.0) for i in range(30)], "term string, weight double")
    with pytest.raises(ValueError, match="more than 20"):
        scale_table(table, 20)
    terms = spark.createDataFrame([("l", f"w{i}", 1, "c") for i in range(30)], "lexicon string, term string, tier int, category string")
    with pytest.raises(ValueError, match="more than 20"):
        terms_of(terms, 20)


@pytest.mark.parametrize("body, found", [
    ("open door, open doors and open door", 3), ("aaaa", 2), ("a flood; floods flood_ flood2 floodé FLOOD", 2), ("", 0), (None, 0), ("no terms", 0),
])
def test_terms_in_one_pass(spark, body, found):
    """Phrases left to right without overlap with themselves, anywhere; words only by themselves; from a table."""
    table = spark.createDataFrame([("x", t, 1, "c") for t in ("open door", "aa", "a a", "flood", "")], "lexicon string, term string, tier int, category string")
    assert lexicon_counts(bodies(spark, body), table).first().n_c == (0 if body == "aaaa" else found)


CLEANED = [
    ("Daily Express", "a\nREAD MORE: x\nb", "a\nb"), ("Daily Mirror", "a\nREAD MORE: x\nb", "a\nb"), ("Daily Mirror", "a\nREAD MORE: x\nREAD MORE: y\nb", "a\ny\nb"), ("Daily Star", "a\nREAD MORE: x", "a\nx"),
    ("Daily Express", "p\nDON’T MISS\nHead one\nHead two\n\nq", "p\n\nq"), ("Daily Express", "p\nDon't miss: x\nJUST IN: y\nq", "p\nq"), ("Daily Express", "p\nDON'T MISS:\nHead [INSIGHT]\n" + "w" * 99 + ".", "p\n" + "w" * 99 + "."),
    ("The Independent", "a\n- Bookmark\n- CommentsGo to comments\nb\nJoin our commenting forum\nx\nsee their replies\nComments", "a\nb"), ("The Guardian", "a. Do you have an opinion on the issues raised\nhere", "a."),
    ("The Guardian", "a. Sign up to our newsletter today.\nb", "a.\nb"), ("The Guardian", "They sign up to net zero.", "They sign up to net zero."), ("Daily Star", "a\nREAD NEXT:\nh one\nh two\n\nProse", "a\n\nProse"), ("Daily Star", "a\nREAD NEXT\nh one\nh two", "a"),
    ("Daily Mirror", "a\nJoin our new WhatsApp group\nPARTY GAMES: x\nb", "a\nb"), ("Other", " a\nREAD MORE: x ", " a\nREAD MORE: x "), ("Daily Express", None, None), ("Daily Express", "\n b É \xa0", "b É"),
]


@pytest.mark.parametrize("outlet, body, expected", CLEANED)
def test_cleaning(spark, outlet, body, expected):
    row = clean(spark.createDataFrame([(outlet, body, "7")], "outlet string, body string, wordcount string")).first()
    assert row.body == expected and row.words_before == 7 and row.wordcount == len((expected or "").split())


def test_rules_pass_over_only_texts_they_are_not_found_in(spark):
    """Boilerplate in all cases, and with letters that count as i, s and k where case is ignored: results are those of searching every text."""
    from dataclasses import replace

    from glossmill.operators.cleaning import HEADLINE_BLOCK, ROUTES, apply_rules
    from glossmill.queries import BOILERPLATE

    rules = [r for r in RULES if r.pattern != HEADLINE_BLOCK]
    assert all(r.needs for r in rules)
    odd = lambda t: t.replace("i", "ı").replace("S", "ſ").replace("I", "İ").replace("k", "\u212a")
    told = [f(t) for t in [*BOILERPLATE, *(t.strip() for t in BOILERPLATE)] for f in (str, str.upper, str.lower, odd, lambda t: odd(t.upper()))]
    rows = [(a + "A body’s text. \u2003" + b,) for a, b in zip(told, [*told[7:], *told[:7]])] + [(None,), ("",), (" \n",)]
    frame = spark.createDataFrame(rows, "said string")
    for outlet in ROUTES:
        own = [r for r in rules if r.outlet == outlet]
        quick, every = (apply_rules(frame.said, [replace(r, **kw) for r in own]) for kw in ({}, {"needs": ()}))
        assert frame.where(~quick.eqNullSafe(every)).select("said", quick.alias("quick"), every.alias("every")).collect() == []


def test_cleaning_by_the_name_of_a_file(spark):
    """A row without an outlet is cleaned as its file's name says; its own outlet comes first, known or not."""
    said = "a\nREAD MORE: x\nb"
    rows = [(None, "/x/2019/express_2019.csv", said), ("Other", "express.csv", said), ("Daily Star", "express.csv", said), (None, "mirror.csv", said), (None, None, said), (None, "star_guardian.csv", said)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, outlet string, file_name string, body string")
    assert [r.body for r in clean(frame).orderBy("i").collect()] == ["a\nb", said, "a\nx\nb", said, said, "a\nx\nb"]
    assert [r.body for r in clean(frame.drop("outlet")).orderBy("i").collect()][:2] == ["a\nb", "a\nb"]
    assert clean(frame.drop("outlet", "file_name")).first().body == said


def test_trend_robustness_of_short_and_flat_groups(spark):
    """Nothing to correlate: null figures, no stars; five pairs have no correlation of their four changes; a q of 0.05 survives."""
    rows = [("flat", i, 1.0, float(i)) for i in range(8)] + [("five", i, float(i * i), float(i)) for i in range(5)] + [("four", i, float(i), float(i)) for i in range(4)]
    found = {r.g: r for r in inference.trend_robust(spark.createDataFrame(rows, "g string, i int, x double, y double"), "x", "y", "g", ["i"]).collect()}
    assert set(found) == {"flat", "five"}
    flat, five = found["flat"], found["five"]
    assert (flat.rho_raw, flat.p_raw, flat.sig_raw, flat.q_raw_fdr, flat.raw_survives_fdr) == (None, None, "", None, False)
    assert five.rho_raw == 1 and five.sig_raw == "***" and five.rho_first_diff is None and five.sig_first_diff == "" and five.raw_survives_fdr
    edge = spark.createDataFrame([(0.05, "a")], "p double, g string")
    assert inference.benjamini_hochberg(edge, "p", ["g"]).first().q == 0.05


def test_cleaning_shrinks_and_reports(spark):
    rng = random.Random(1)
    parts = ["READ MORE: x y", "READ NEXT:", "word one two", "", "DON'T MISS", "Sign up here. The newsletter.", "Join our WhatsApp", "It is. " * 20]
    rows = [(o, "\n".join(rng.choice(parts) for _ in range(12))) for o in ("express", "star", "guardian", "mirror", "independent") for _ in range(20)]
    cleaned = clean(spark.createDataFrame(rows, "outlet string, body string"))
    assert cleaned.where("wordcount > words_before").count() == 0
    report = cleaning_report(cleaned).first()
    assert report.words_before - report.words_after == report.words_removed > 0
    assert cleaning_report(cleaned.where("false")).first().removed_pct is None
    assert len(RULES) > 40


def test_p_values(spark):
    rows = spark.createDataFrame([(2.0, 1), (2.0, 2), (2.0, 3), (2.228138852, 10), (2.01410339, 45), (0.0, 7), (None, 5)], "t double, df int")
    got = [r[0] for r in rows.select(pvalues.student_t(F.col("t"), F.col("df"))).collect()]
    jvm = spark._jvm.org.apache.commons.math3.distribution.TDistribution
    for r, p in zip(rows.collect(), got):
        assert p is None if r.t is None else p == pytest.approx(2 * (1 - jvm(float(r.df)).cumulativeProbability(r.t)), abs=1e-12)
    assert [r[0] for r in spark.createDataFrame([(3.0, 20)], "f double, df int").select(pvalues.f_two(F.col("f"), F.col("df"))).collect()][0] == pytest.approx(1 - spark._jvm.org.apache.commons.math3.distribution.FDistribution(2.0, 20.0).cumulativeProbability(3.0), abs=1e-12)


def test_stars(spark):
    rows = spark.createDataFrame([(0.001,), (0.0011,), (0.01,), (0.05,), (0.051,), (None,)], "p double")
    assert [r[0] for r in rows.select(text.stars(F.col("p"))).collect()] == ["***", "**", "**", "*", "", ""]


def test_windows_and_years(spark):
    days = ["2015-09-28", "2015-09-29", "2016-09-28", "2016-09-29", "2021-03-31", "2021-04-01T10:00:00Z", "2022-03-31", "not a date", None]
    rows = spark.createDataFrame([("a", d, float(i)) for i, d in enumerate(days)], "outlet string, date string, x double")
    ends = spark.createDataFrame([(2016, 9, 5)], "quarter_end_year int, quarter_end_month int, net_migration int")
    for f in (align.rolling_year, align.rolling_year_by_range):
        assert [(r.n_articles, r.x) for r in f(rows, ends, ["x"], least=1).collect()] == [(2, 1.5)]
        assert f(rows, ends, ["x"], least=3).count() == 0
    years = spark.createDataFrame([(2021, "2021/22")], "fy_start_year int, fy_label string")
    assert [(r.n_articles, r.x) for r in align.fiscal_year(rows, years, ["x"], least=1).collect()] == [(2, 5.5)]


def test_rolling_year_equals_the_range_join(spark):
    from glossmill import queries as Q

    sf = "/root/testdata/sf0.01"
    a, b = (f(Q.dated(spark, sf), Q.series(spark, sf), Q.FEATURES) for f in (align.rolling_year, align.rolling_year_by_range))
    key = lambda r: (r.outlet, r.quarter_end_year, r.quarter_end_month)
    left, right = sorted(a.collect(), key=key), sorted(b.collect(), key=key)
    assert len(left) == len(right) > 100
    for x, y in zip(left, right):
        assert key(x) == key(y) and x.n_articles == y.n_articles and x.price == pytest.approx(y.price, rel=1e-9)


def test_rank_statistics(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in (1, 1, 2, 4)], "g string, x double")
    assert sorted(r[0] for r in order.with_rank(rows, "x", ["g"], "r").select("r").collect()) == [1.5, 1.5, 3, 4]
    flat = spark.createDataFrame([("a", 1.0, float(i)) for i in range(6)] + [("b", float(i), float(i * i)) for i in range(6)] + [("c", 1.0, 2.0)] * 4, "outlet string, x double, y double")
    got = {r.outlet: r for r in inference.rank_correlation(flat, "x", "y", ["outlet"]).collect()}
    assert got["a"].rho is None and got["a"].p is None and got["b"].rho == 1 and got["b"].p == 0 and "c" not in got


def ranks(values):
    """Places from 1, equal values sharing their mean."""
    return [sum(v < x for v in values) + (values.count(x) + 1) / 2 for x in values]


def _skewed(spark):
    """Groups of four sizes, one with most of the rows, one full of one value, a null group, null values and extremes."""
    dice = random.Random(11)
    rows = [("big", dice.choice([0.0, dice.gauss(0, 9), float(dice.randint(0, 50))]), float(dice.randint(0, 9))) for _ in range(6000)]
    rows += [("flat", 1.0, float(i)) for i in range(700)] + [("one", 5.0, 1.0), (None, 2.0, 1.0), (None, 4.0, 2.0), (None, 9.0, 0.0)]
    rows += [("some", dice.choice([None, -1e300, 1e300, 0.25, 0.5]), dice.choice([None, 1.0, 2.0])) for _ in range(60)]
    return rows, spark.createDataFrame(rows, "g string, x double, y double")


def test_quantiles_of_groups_of_any_size(spark):
    import numpy as np

    rows, frame = _skewed(spark)
    parts = [0.0, 0.25, 1 / 3, 0.5, 0.9, 1.0]
    found = order.quantiles(frame, "x", ["g"], parts)
    said = {r.g: r.q for r in found.collect()}
    for g in {r[0] for r in rows}:
        values = [x for k, x, _ in rows if k == g and x is not None]
        assert said[g] == pytest.approx(list(np.quantile(values, parts)), rel=1e-12), g
    exact = {r.g: r.q for r in frame.groupBy("g").agg(F.percentile("x", F.array(*map(F.lit, parts))).alias("q")).collect()}
    assert said == exact
    assert order.quantiles(frame.where("false"), "x", ["g"], [0.5]).count() == 0


def test_ranks_of_groups_of_any_size(spark):
    rows, frame = _skewed(spark)
    found = order.with_rank(frame, "x", ["g"], "rank")
    want = []
    for g in {r[0] for r in rows}:
        values = [x for k, x, _ in rows if k == g and x is not None]
        want += [(g, x, r) for x, r in zip(values, ranks(values))]
    assert sorted(map(str, want)) == sorted(str((r.g, r.x, r["rank"])) for r in found.collect())
    plan = found._jdf.queryExecution().toString()
    assert "rank(" not in plan  # no window over a group orders its rows


def test_rank_correlation_of_groups_of_any_size(spark):
    import numpy as np
    rows, frame = _skewed(spark)
    found = {r.g: r for r in inference.rank_correlation(frame, "x", "y", ["g"], 3).collect()}
    for g in ("big", "some", None):
        pairs = [(x, y) for k, x, y in rows if k == g and x is not None and y is not None]
        a, b = (np.array(ranks([p[i] for p in pairs])) for i in (0, 1))
        assert found[g].n == len(pairs) and found[g].rho == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-10)
    assert found["flat"].rho is None and "one" not in found


def test_q_values(spark):
    rows = spark.createDataFrame([(p, i) for i, p in enumerate((0.01, 0.04, 0.03, 0.5, 0.02))], "p double, i int")
    assert [r.q for r in inference.benjamini_hochberg(rows, "p", ["i"]).orderBy("i").collect()] == [0.05, 0.05, 0.05, 0.5, 0.05]
    some = spark.createDataFrame([(0.01, 0), (None, 1), (0.04, 2)], "p double, i int")
    assert [r.q for r in inference.benjamini_hochberg(some, "p", ["i"]).orderBy("i").collect()] == [0.02, None, 0.04]
    assert [r.q for r in inference.benjamini_hochberg(some, "p", ["i"], nan_policy="last").orderBy("i").collect()] == [0.03, 1.0, 0.06]


def test_tertiles_and_anova(spark):
    rows = spark.createDataFrame([("a", float(i), float(i * i)) for i in range(1, 10)] + [("flat", 1.0, 2.0)] * 9, "outlet string, net double, x double")
    got = inference.anova(rows, ["x"], "net").collect()
    assert [r.outlet for r in got] == ["a"] and got[0].n == 9 and got[0].mean_low == pytest.approx(14 / 3, abs=1e-4) and 0 < got[0].partial_eta_sq < 1


def test_regression_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x1, x2 = rng.normal(size=30), (np.arange(30) > 14).astype(float)
    y = 2 + 3 * x1 - x2 + rng.normal(size=30)
    rows = spark.createDataFrame([("a", float(a), float(b), float(c)) for a, b, c in zip(x1, x2, y)] + [("flat", float(a), 1.0, float(c)) for a, c in zip(x1, y)], "outlet string, net_migration double, methodology_dummy double, y double")
    beta = np.linalg.lstsq(np.column_stack([np.ones(30), x1, x2]), y, rcond=None)[0]
    got = {(r.outlet, r.term): r for r in inference.coefficients(rows, ["y"]).collect()}
    for name, b in zip(("const", "net_migration", "methodology_dummy"), beta):
        assert got["a", name].beta == pytest.approx(b, abs=1e-5) and got["a", name].ci_low < b < got["a", name].ci_high
        assert got["flat", name].beta is None
    fit = {r.outlet: r for r in inference.regression(rows, ["y"]).collect()}
    assert fit["a"].x1_sig == "***" and fit["a"].x1_survives and fit["flat"].r_squared is None


def test_trends(spark):
    line = spark.createDataFrame([("a", i, 2.0 * i + 1) for i in range(9)], "g string, i int, y double")
    assert {r.y_detrended for r in inference.detrended(line, "y", ["g"], ["i"]).collect()} <= {0.0, -0.0}
    assert [r.y_diff for r in inference.differenced(line, ["y"], ["g"], ["i"]).collect()] == [2.0] * 8
    rng, walk, rows = random.Random(4), 0.0, []
    for i in range(200):
        walk += rng.gauss(0, 1)
        rows += [("walk", i, walk), ("noise", i, rng.gauss(0, 1)), ("short", i, 1.0)][: 3 if i < 5 else 2]
    got = {r.g: r.adf_p for r in inference.adf(spark.createDataFrame(rows, "g string, i int, y double"), "y", "g", ["i"]).collect()}
    assert got["noise"] < 0.01 < got["walk"] and got["short"] is None


def plain_adf(y):
    """By least squares of each number of lags, with the whole series at hand."""
    import math

    import numpy as np

    n = len(y)
    dy = np.diff(y)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    if n < 8 or most < 0 or np.ptp(y) == 0:
        return None

    def fit(lags: int, start: int) -> tuple[float, float]:
        x = np.column_stack([np.ones(len(dy) - start), y[start:-1], *[dy[start - k : len(dy) - k] for k in range(1, lags + 1)]])
        t = dy[start:]
        beta, *_ = np.linalg.lstsq(x, t, rcond=None)
        sse, m, k = float(((t - x @ beta) ** 2).sum()), *x.shape
        if m <= k or sse <= 0:
            return math.inf, math.nan
        se = math.sqrt(sse / (m - k) * np.linalg.pinv(x.T @ x)[1, 1])
        return m * (math.log(2 * math.pi * sse / m) + 1) + 2 * k, float(beta[1] / se) if se else math.nan

    lags = min(range(most + 1), key=lambda k: fit(k, most)[0])
    tau = fit(lags, lags)[1]
    if math.isnan(tau):
        return None
    if tau > 2.74:
        return 1.0
    if tau < -18.83:
        return 0.0
    small = 2.1659 + 1.4412 * tau + 0.038269 * tau**2
    large = 1.7339 + 0.93202 * tau - 0.12745 * tau**2 - 0.010368 * tau**3
    return 0.5 * math.erfc(-(small if tau <= -1.61 else large) / math.sqrt(2))


@pytest.mark.parametrize("size", [8, 9, 30, 120, 700])
def test_unit_roots_by_moments(spark, size):
    """As least squares over whole series; numbers, walks and trends of several scales; what can't be told is null."""
    import numpy as np

    rng = np.random.default_rng(size)
    noise, walk = rng.normal(size=size), rng.normal(size=size).cumsum()
    series = {"noise": noise, "walk": 1e6 + walk, "trend": np.arange(size) * 3.0 + noise, "small": 1e-6 * (walk + 5), None: 0.5 * walk + noise, "flat": np.ones(size), "short": noise[:7]}
    rows = [(g, i, float(v)) for g, y in series.items() for i, v in enumerate(y)]
    random.Random(1).shuffle(rows)
    found = {r.g: r for r in inference.adf(spark.createDataFrame(rows, "g string, i int, y double"), "y", "g", ["i"]).collect()}
    assert set(found) == set(series)
    for g, y in series.items():
        want = plain_adf((y - y.mean()) / (y.std() or 1))  # its squares are too coarse far from 0
        assert found[g].n == len(y) and (found[g].adf_p is None if want is None else found[g].adf_p == pytest.approx(want, abs=2e-5)), g


def test_critical_values(spark):
    """Published critical values of a constant and one series, for many values."""
    for level, tau in ((0.01, -3.43), (0.05, -2.86), (0.10, -2.57)):
        assert inference._mackinnon(tau) == pytest.approx(level, abs=1e-3)


def test_outlets_and_dates(spark):
    rows = spark.createDataFrame([("The Guardian",), (" daily mirror ",), (None,)], "outlet string")
    assert [r.outlet for r in tables.canonical_outlet(rows, "express").collect()] == ["guardian", "mirror", "express"]
    with pytest.raises(Exception, match="unknown outlet"):
        tables.canonical_outlet(spark.createDataFrame([("Daily Star",)], "outlet string")).collect()
    names = spark.createDataFrame([("x/Express_2019.csv",), ("other.csv",)], "f string")
    assert [r[0] for r in names.select(tables.outlet_of_file(F.col("f"))).collect()] == ["express", "other"]
    days = spark.createDataFrame([("2016-04-01",), ("2016-03-09",), (None,), ("x",)], "d string")
    assert [r[0] for r in days.select(tables.in_month(F.col("d"), F.lit(2016), F.lit(3))).collect()] == [False, True, False, False]
    assert [r[0] for r in bodies(spark, "borderline", "none", None).select(text.contains_any(F.col("body"), ["border"])).collect()] == [True, False, False]


def test_tables(spark):
    with pytest.raises(ValueError, match="missing"):
        tables.require_columns(bodies(spark, "a"), ["no"])
    assert not tables.require_columns(bodies(spark, "a"), ["no"], "skip")
    scores = spark.createDataFrame([(0.54, 0.46), (0.56, 0.44), (0.44, 0.56)], "p double, a double")
    assert [r[0] for r in scores.select(tables.stance_label(F.col("p"), F.col("a"))).collect()] == ["neutral", "pro", "anti"]
    judged = spark.createDataFrame([(1, 1)] * 3 + [(0, 1)] + [(1, 0)] * 2 + [(None, 1)], "h int, m int")
    row = tables.binary_agreement(judged, "h", "m").first()
    assert (row.precision, row.recall, row.f1) == (0.75, 0.6, 0.6667)
    assert tables.binary_agreement(judged.where("false"), "h", "m").first().f1 == 0
    quota = spark.createDataFrame([(i, "a" if i < 700 else "b" if i < 990 else "c") for i in range(1000)], "url long, label string")
    drawn = tables.quota_sample(quota, "label", most=1000)
    assert drawn.count() == 1000
    assert tables.quota_sample(quota, "label").count() == 200
    assert sorted(tables.quota_sample(quota, "label").collect()) == sorted(tables.quota_sample(quota.repartition(7), "label").collect())
    null = spark.createDataFrame([(None, 1), (1, 2)], "url long, x int")
    assert tables.attach(null, spark.createDataFrame([(None, 5)], "url long, y int")).where("y = 5").count() == 1
    assert tables.first_rows(spark.createDataFrame([("k", 2, "b"), ("k", 1, "a")], "k string, i int, v string"), "k", "i").first().v == "a"


def test_csv_round_trip(spark, tmp_path):
    rows = [("a", 2016, 3, "2016-03-01", "u1", 3, 'line\none, "quoted" \\ end'), ("a", 2016, 3, None, "u2", 0, "NA")]
    files.write_csv(spark.createDataFrame(rows, files.CORPUS), str(tmp_path / "c"))
    back = files.read_csv(spark, str(tmp_path / "c")).orderBy("url").collect()
    assert [(r.date, r.body) for r in back] == [("2016-03-01", 'line\none, "quoted" \\ end'), (None, "NA")]
    both = spark.createDataFrame(rows, files.CORPUS)
    files.write_months(both, str(tmp_path / "m"))
    plan = spark.createDataFrame([("a", 2016, 3), ("a", 2016, 4)], "outlet string, year int, month int")
    assert [r.month for r in files.missing_months(plan, spark.read.parquet(str(tmp_path / "m"))).collect()] == [4]


def test_series(spark, tmp_path):
    sheet = [("Immigration", "YE Jun 20", 1), ("Net migration", "YE Dec 19", 250), ("Net migration", "YE Jun 20 (p)", 100), ("Net migration", "total", 3), ("", "", None), ("Net migration", "YE Sep 20", 9)]
    rows = spark.createDataFrame([(i, f, p, str(v)) for i, (f, p, v) in enumerate(sheet)], "row int, flow string, period string, value string")
    assert [tuple(r) for r in files.quarterly_series(rows).orderBy("quarter_end_year").collect()] == [("YE Dec 19", 2019, 12, 250, "IPS"), ("YE Jun 20 (p)", 2020, 6, 100, "LTIM")]
    cells = "".join(f'<row r="{i}"><c r="A{i}" t="inlineStr"><is><t>{f}</t></is></c><c r="B{i}" t="s"><v>{i - 1}</v></c><c r="C{i}"><v>{v}</v></c></row>' for i, (f, _, v) in enumerate(sheet[:3], 1))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{p}</t></si>" for _, p, _ in sheet[:3]) + "</sst>")
        z.writestr("xl/worksheets/s.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>")
    (tmp_path / "s.xlsx").write_bytes(data.getvalue())
    assert files.quarterly_series(files.read_sheet(spark, str(tmp_path / "s.xlsx"))).count() == 2
    years = spark.createDataFrame([("2018/19", "5"), ("2019/20", "6"), (" 2020/21", ""), ("n/a", "7"), ("2021/22", "8")], "Year_Ending_March string, Race_Hate_Crime_Excl_Met string")
    assert [tuple(r) for r in files.annual_series(years).collect()] == [("2018/19", 2018, 5), ("2021/22", 2021, 8)]


def test_sitemaps(spark, tmp_path):
    config = web.outlet_config(spark, "A:\n  domain: a\n  sitemap_templates: ['https://a/{year}-{month:02d}-{day:02d}.xml']\n  crawl_delay: 2\n")
    wanted = config.select("outlet", F.explode("sitemap_templates").alias("template")).withColumns({"year": F.lit(2016), "month": F.lit(2)})
    urls = [r.url for r in web.sitemap_urls(wanted).collect()]
    assert len(urls) == 29 and "https://a/2016-02-29.xml" in urls
    for bad in ("", "[1]"):
        with pytest.raises(ValueError):
            web.outlet_config(spark, bad)
    with pytest.raises(Exception, match="unknown placeholder"):
        web.sitemap_urls(wanted.withColumn("template", F.lit("{week}"))).collect()
    (tmp_path / "a.xml").write_text('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://a/1 </loc><lastmod>2016-02-03T10:00:00Z</lastmod></url><url><loc>https://a/2</loc></url></urlset>')
    (tmp_path / "b.xml").write_text("<urlset><url><loc>https://")
    assert sorted(tuple(r) for r in web.sitemap_entries(spark, str(tmp_path)).collect()) == [("https://a/1", "2016-02-03"), ("https://a/2", "")]


def test_pages(spark):
    html = "<html><head><meta property='article:published_time' content='2016-03-04T01:02:03'><script>x</script></head><body><nav>menu</nav><article><h1>Head</h1><p>One &amp; two</p><!-- c --><table><tr><td>cell</td></tr></table></article><p>out</p></body></html>"
    rows = web.extract_pages(spark.createDataFrame([(1, html), (2, None), (3, "<p>bare</p>")], "page_id int, html string")).orderBy("page_id").collect()
    assert [(r.body, r.date) for r in rows] == [("Head\nOne & two", "2016-03-04"), (None, None), ("bare", None)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [("express", f"u{i}", "w " * 60 + f"a word {i} and we will go\nREAD MORE: x") for i in range(30)]
    schema = "outlet string, url string, body string"
    at = {k: str(tmp_path / k) for k in ("in", "out", "ledger", "check")}
    frame = spark.createDataFrame(rows, schema)
    frame.where("url < 'u2'").write.parquet(at["in"])
    run = lambda: process_new(spark, at["in"], at["out"], at["ledger"], at["check"], schema).awaitTermination()
    run()
    frame.write.mode("append").parquet(at["in"])  # old rows come again in a new file
    run()
    run()
    got = spark.read.parquet(at["out"]).drop("batch")
    whole = article_features(usable(clean(frame))).select(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))
    assert spark.read.parquet(at["ledger"]).count() == 30


def _started(spark, at, transform, schema="url string, n long, body string", **options):
    return process_new(spark, at["in"], at["out"], at["ledger"], at["check"], schema, transform=transform, **options)


def test_first_rows_of_a_stream_and_what_a_batch_reads(spark, tmp_path):
    """The first row of a url is kept, over batches and in one; a batch asks the state for its own keys only, and never reads the ledger."""
    import shutil

    at = {k: str(tmp_path / k) for k in ("in", "out", "ledger", "check")}
    schema = "url string, n long, body string"
    spark.createDataFrame([(f"u{i % 500}", i, "b") for i in range(1500)], schema).write.parquet(at["in"])
    _started(spark, at, lambda df: df, order=["n"]).awaitTermination()
    shutil.rmtree(at["ledger"])
    spark.createDataFrame([("u7", -1, "late"), (None, 2, "b"), (None, 1, "a"), ("new", 3, "c")], schema).write.mode("append").parquet(at["in"])
    query = _started(spark, at, lambda df: df, order=["n"])
    query.awaitTermination()
    got = {(r.url, r.n) for r in spark.read.parquet(at["out"]).collect()}
    assert got == {(f"u{i}", i) for i in range(500)} | {(None, 1), ("new", 3)}
    state = [p["stateOperators"][0] for p in query.recentProgress if p["numInputRows"]][0]
    assert state["numRowsTotal"] == 502 and state["customMetrics"]["rocksdbGetCount"] <= 6
    assert {r.url for r in spark.read.parquet(at["ledger"]).collect()} == {None, "new"}


def test_a_stream_that_fails_goes_on(spark, tmp_path):
    """A batch that fails after it has written is run again, and what it wrote is there once."""
    at = {k: str(tmp_path / k) for k in ("in", "out", "ledger", "check")}
    schema = "url string, n long, body string"
    spark.createDataFrame([(f"u{i % 40}", i, "b") for i in range(100)], schema).write.parquet(at["in"])

    def failing(df):
        df.withColumn("batch", F.lit(0).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(at["out"])
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        _started(spark, at, failing, order=["n"]).awaitTermination()
    for _ in range(2):
        _started(spark, at, lambda df: df, order=["n"]).awaitTermination()
    assert sorted((r.url, r.n) for r in spark.read.parquet(at["out"]).collect()) == sorted((f"u{i}", i) for i in range(40))
    assert spark.read.parquet(at["ledger"]).count() == 40


def test_model_input_or_query_and_labels(spark):
    rows = spark.createDataFrame([("t", "b"), (None, "b"), ("t", None)], "title string, body string")
    assert [r[0] for r in rows.select(text.model_input(F.col("title"), F.col("body"))).collect()] == ["t. b", "nan. b", "t. nan"]
    assert [r[0] for r in rows.select(text.model_input(None, F.col("body"))).collect()] == [". b", ". b", ". nan"]
    assert spark.range(1).select(text.or_query(F.lit("a, b,c"))).first()[0] == "a OR b OR c"
    assert [r[0] for r in rows.select(text.labelled(F.col("body"), {"b": "Body"})).collect()] == ["Body", "Body", None]


def test_dates_and_outlets_of_both_kinds_of_source(spark):
    days = spark.createDataFrame([("2016-04-01", "2016-03-09"), ("2016-04-01", ""), (None, None)], "d string, s string")
    assert all(r[0] for r in days.select(tables.in_month(F.col("d"), F.lit(2016), F.lit(3), F.col("s"))).collect())
    assert [r[0] for r in days.select(tables.article_day(F.col("d"), F.col("s"))).collect()] == ["2016-03-09", "2016-04-01", None]
    names = spark.createDataFrame([("/x/Star_2020.csv",), ("a/express_star.csv",)], "f string")
    assert [r[0] for r in names.select(tables.outlet_of_file(F.col("f"))).collect()] == ["star_2020", "express"]
    assert [r[0] for r in names.select(tables.outlet_of_file(F.col("f"), tables.CLEANING_HINTS)).collect()] == ["star", "express"]


def test_subcategory_family_edges(spark):
    """Nulls leave a correlation, rows without an outcome leave the series, short groups go."""
    import numpy as np

    from glossmill.operators.inference import subcategory_family

    def ranks(v):
        return [sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v]

    rng = np.random.default_rng(3)
    x, y = rng.normal(size=12), rng.normal(size=12)
    rows = [("a", i, None if i == 4 else float(x[i]), float(y[i])) for i in range(12)] + [("a", 12, 1.0, None)] + [("b", i, 1.0, 2.0) for i in range(3)]
    df = spark.createDataFrame(rows, "outlet string, q int, f double, net double")
    [got] = subcategory_family(df, ["f"], "net", "outlet", ["q"]).collect()
    t = np.arange(12)
    keep = t != 4
    line = lambda v, at: v - np.polyval(np.polyfit(at, v, 1), at)
    raw = np.corrcoef(ranks(x[keep]), ranks(y[keep]))[0, 1]
    flat = np.corrcoef(ranks(line(x[keep], t[keep])), ranks(line(y, t)[keep]))[0, 1]
    assert (got["outlet"], got["n"], got["rho_raw"], got["rho_detrended"]) == ("a", 12, round(raw, 4), round(flat, 4))
    assert got["q_raw_fdr"] == got["p_raw"]


def test_stance_sample_takes_first_bodies(spark):
    from glossmill.operators.tables import stance_sample

    scored = spark.createDataFrame([("u1", "x", "first", 1), ("u1", "x", "second", 2), ("u2", "y", None, 1)], "url string, outlet string, body string, n int")
    stance = spark.createDataFrame([("u1", 0.9, 0.1, "pro"), ("u2", 0.2, 0.2, "neutral"), ("u3", 0.1, 0.8, "anti")], "url string, pro_score double, anti_score double, stance_label string")
    got = {r["url"]: (r["outlet"], r["body"], r["human_label"]) for r in stance_sample(scored, stance, order="n").collect()}
    assert got == {"u1": ("x", "first", ""), "u2": ("y", None, "")}


def test_dual_series_panels(spark):
    from glossmill.operators.align import dual_series

    df = spark.createDataFrame([("mirror", 2019, 12, 1.5, 2000), ("guardian", 2020, 3, 2.5, None), ("other", 2020, 3, 1.0, 1)], "outlet string, quarter_end_year int, quarter_end_month int, f double, net long")
    got = sorted((r["panel"], r["title"], str(r["date"]), r["net_thousands"], r["before_break"]) for r in dual_series(df, "f", "net").collect())
    assert got == [(1, "The Guardian", "2020-03-01", None, False), (4, "Daily Mirror", "2019-12-01", 2.0, True)]


def test_ranks_of_values_whose_last_digits_change(spark):
    """Means over tasks come with other last digits whenever they are computed; each pair still has its ranks, also where no exchange is reused."""

    def shaken(batches):
        for batch in batches:
            batch["x"] += [b / 1e9 for b in os.urandom(len(batch))]
            yield batch

    rows = spark.range(40).selectExpr("id % 2 as g", "cast(id as double) as x", "cast(id as double) as y").mapInPandas(shaken, "g long, x double, y double")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        found = inference.rank_correlation(rows, "x", "y", ["g"]).orderBy("g").collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert [tuple(r)[:3] for r in found] == [(0, 20, 1.0), (1, 20, 1.0)]


def test_q_of_half_a_place_is_rounded_as_in_sql(spark):
    """0.000093 * 5 / 2 is 0.0002325, which as a double is a little less; SQL rounds the product with 10^6, which is 232.5."""
    rows = spark.createDataFrame([(1, 0.000001), (2, 0.000093), (3, 0.9), (4, 0.9), (5, 0.9)], "k int, p double")
    assert [r.q for r in inference.benjamini_hochberg(rows, "p", ["k"]).orderBy("k").collect()] == [0.000005, 0.000233, 0.9, 0.9, 0.9]


def test_first_rows_take_rows_as_they_are():
    """A key's rows aren't made a frame; nulls of the order come first, a seen key gives nothing."""
    from types import SimpleNamespace

    from pyspark.sql import Row

    from glossmill.streaming.ledger import _FirstRows

    known = []
    made = _FirstRows(["url", "a", "b"], ["a", "b"], None)
    made.init(SimpleNamespace(getValueState=lambda *_: SimpleNamespace(exists=lambda: bool(known), update=known.append)))
    rows = [Row("u", 2, "x"), Row("u", None, "z"), Row("u", None, None), Row("u", 1, "a")]
    assert list(made.handleInputRows(("u",), iter(rows), None)) == [Row("u", None, None)] and known == [(True,)]
    assert list(made.handleInputRows(("u",), iter(rows), None)) == []


def test_texts_without_an_apostrophe_are_not_searched_for_contractions(monkeypatch):
    from glossmill.operators import markers

    split, token = markers._patterns()
    asked = []

    class Split:
        def sub(self, to, text):
            asked.append(text)
            return split.sub(to, text)

    monkeypatch.setattr(markers, "_patterns", lambda: (Split(), token))
    assert markers.tokens("We will. THEY") == ["We", "will", ".", "THEY"] and markers.tokens("don't") == ["do", "n't"]
    assert asked == ["don't"]
