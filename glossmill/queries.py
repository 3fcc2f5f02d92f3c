"""Catalogue of queries over the driver's tables, and the SQL they are held against.

The tables stand in for articles: ``documents`` for bodies by outlet (``source``), ``orders`` for dated
features by outlet (``o_orderpriority``), quarterly sums of ``lineitem`` for the outcome series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.text import contains_any, stars, word_count, word_tokens
from .operators import align, inference, tables
from .operators.cleaning import HEADLINE_BLOCK, ROUTES, RULES, Rule, apply_rules, clean, cleaning_report
from .operators.automaton import lexicon_frame
from .operators.lexicon import counts_of, dehumanisation, lexicon_counts, outrage, term_totals
from .operators.lexicons import DEHUMANISATION, OUTRAGE, PROBE
from .operators.markers import with_markers
from .operators.sentences import DEMO_VALENCE, SentimentRules, rule_scorer, scale_table, sentences, sentiment
from .plans.features import article_features, keyword_model, stance_scores, topic_scores, usable
from .plans.scoring import score_batches, scored
from .shared import shared_folder, spread, stored
from .sources import paged, web
from .streaming.incremental import process_new


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("url"), F.col("source").alias("outlet"), F.col("text").alias("body"), "lang")


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderpriority").alias("outlet"), F.col("o_orderdate").alias("date"), F.col("o_totalprice").alias("price"), (F.col("o_orderkey") % 97).cast("double").alias("rest"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice") / 7).alias("sparse"))


FEATURES = ["price", "rest", "sparse"]


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship = F.col("l_shipdate")
    sums = table(spark, sf_dir, "lineitem").groupBy(F.year(ship).alias("quarter_end_year"), (F.quarter(ship) * 3).alias("quarter_end_month")).agg(F.sum("l_quantity").cast("long").alias("net_migration"))
    return sums.withColumn("methodology", F.when(F.col("quarter_end_year") >= 1998, "LTIM").otherwise("IPS"))


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once, as what follows reads it many times, and sums of other tasks' order have other last digits."""
    return stored(align.rolling_year(dated(spark, sf_dir), series(spark, sf_dir), FEATURES))


def lexicon_density_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lexicon_counts(spread(articles(spark, sf_dir)), PROBE)
    hits = F.col("n_function_word") + F.col("n_insult") + F.col("n_phrase")
    rows = rows.withColumn("density", F.round(F.coalesce(F.try_divide(hits, F.col("n_words") / 1000.0), F.lit(0.0)), 4))
    return rows.groupBy(F.col("outlet").alias("source")).agg(F.count("*").alias("n_docs"), F.sum(hits).alias("hits"), F.sum("n_words").alias("n_words"), F.round(F.avg("density"), 4).alias("density"))


def lexicon_wide_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon_counts(articles(spark, sf_dir), PROBE, by="tier").select(F.col("url").alias("doc_id"), "n_words", "n_1", "n_2")


def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lexicon_counts(articles(spark, sf_dir), [t for t in PROBE if t.category == "phrase"])
    return rows.groupBy("lang").agg(F.sum("n_phrase").alias("hits"))


def term_totals_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = spark.createDataFrame([(t.term, t.tier) for t in PROBE if " " not in t.term], "term string, tier int")
    return term_totals(articles(spark, sf_dir), terms, by=["lang"]).select("lang", "term", "tier", "hits")


def sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select(F.col("url").alias("doc_id"), F.size(sentences(F.col("body"))).cast("long").alias("n_sentences"), word_count(F.col("body")).alias("n_words"))


def _with_words_put(text: Column, put: dict[str, str]) -> Column:
    """Whole words replaced by others. The word comes first in the pattern, so that what is around it is only looked at where it stands."""
    for word, other in put.items():
        text = F.regexp_replace(text, rf"{word}(?<![\p{{L}}]{word})(?![\p{{L}}])", other)
    return text


#: Common words and the markers that are put in their place; names after titles among them.
PUT_MARKERS = {
    "the": "will", "of": "we", "and": "they", "to": "might", "in": "may", "is": "must", "that": "Mr May", "on": "often", "le": "Would",
    "de": "prime May", "que": "ourselves", "die": "Theresa. May", "und": "theirs", "der": "don't", "el": "always we'll",
}
MARKERS = [
    "modal_certainty_count", "modal_hedging_count", "modal_word_count", "modal_certainty_per1k", "modal_hedging_per1k", "modal_certainty_ratio", "modal_epistemic_ratio",
    "modal_balance", "modal_epi_balance", "pron_ingroup_count", "pron_outgroup_count", "pron_ingroup_per1k", "pron_outgroup_per1k", "pron_inclusion_index", "pron_ingroup_ratio",
]


def modal_pronoun_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over texts whose common words are put in the place of markers, so that there is something to count."""
    return with_markers(spread(articles(spark, sf_dir)), _with_words_put(F.col("body"), PUT_MARKERS)).select(F.col("url").alias("doc_id"), *[c for c in MARKERS])


#: Common words and what is put in their place, so that sentences have something to weigh.
PUT_FEELINGS = {
    "the": "good", "of": "very", "and": "not", "to": "BAD", "in": "but", "that": "hardly", "le": "great", "de": "never so", "la": "SO", "que": "no", "die": "terrible!",
    "und": "without doubt", "der": "least", "el": "kind of", "los": "hope", "es": "isn't",
}


def sentence_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published rules over tables of words, on texts that have such words put in."""
    weights = spark.createDataFrame(list(DEMO_VALENCE.items()), "term string, weight double")
    said = _with_words_put(F.col("body"), PUT_FEELINGS)
    rows = sentiment(spread(articles(spark, sf_dir)).select("url", said.alias("body")), rule_scorer(SentimentRules(scale_table(weights))))
    return rows.select(F.col("url").alias("doc_id"), "sentiment_compound", "sentiment_pos_ratio", "sentiment_neg_ratio", "sentiment_neu_ratio", "sentiment_n_sentences")


def article_feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return article_features(usable(spread(articles(spark, sf_dir))), dehum=[t for t in PROBE])


def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).where(contains_any(F.col("body"), ["idiot", "licensed", "threat"])).groupBy(F.col("outlet").alias("source")).agg(F.count("*").alias("n"))


def keyword_query_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.compare_queries(articles(spark, sf_dir), ["idiot", "licensed"], ["idiot", "licensed", "threat"])


#: Rules for the synthetic texts; sources by their first digit stand in for outlets.
OWN_RULES = [Rule("src1", r"\nlicensed under[^\n]*", "", "i"), Rule("src1", r"[*#$%&]{3}"), Rule("src2", r"!!"), Rule("src2", r"^the ", "", "i")]


def clean_rules_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean(articles(spark, sf_dir), OWN_RULES)
    return rows.groupBy(F.col("outlet").alias("source")).agg(F.sum("words_before").alias("words_before"), F.sum("wordcount").alias("words_after"), F.sum(F.length("body")).alias("chars"))


#: A rule for each outlet that a file may name.
FILE_RULES = [
    Rule("express", r"\nREAD MORE:.*"), Rule("independent", r"\n- Bookmark"), Rule("guardian", "\u2019", "'"), Rule("star", r"READ MORE: ?", "", "i"), Rule("mirror", r"[a-z]+"),
]
FILE_NAMES = ["2019/Daily_EXPRESS_2019.csv", "independent.csv", "guardian_2020.csv", "the_star.csv", "other.csv"]


def clean_by_file_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third text has an outlet, all have a file, whose name says the outlet of the others, if any."""
    key = F.col("url")
    named = articles(spark, sf_dir).withColumns({"outlet": F.when(key % 3 == 0, F.lit("Guardian")), "file_name": _put(FILE_NAMES, key), "body": F.concat(F.coalesce("body", F.lit("")), F.lit("\n- Bookmark\nREAD MORE: more to read\nThe reader’s end"))})
    rows = clean(named, FILE_RULES)
    return rows.select(key.alias("doc_id"), "words_before", "wordcount", F.md5(F.col("body").cast("binary")).alias("body_md5"))


def clean_word_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning_report(clean(articles(spark, sf_dir), OWN_RULES))


def page_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = web.paragraphs(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(text).cast("long").alias("chars"), F.md5(text.cast("binary")).alias("digest"))


def page_text_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.extract_pages(spread(table(spark, sf_dir, "pages")), url="url").select("page_id", "body", "date")


def paged_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as recorded answers of a paged interface (ten years of months, about 200 to a page), asked for page by page."""
    docs, at = table(spark, sf_dir, "documents"), shared_folder(spark)
    made = docs.select((F.lit(2010) + F.pmod("doc_id", F.lit(10))).cast("int").alias("year"), (F.pmod("doc_id", F.lit(12)) + 1).cast("int").alias("month"), F.col("doc_id"), F.col("source").alias("section"), F.coalesce("text", F.lit("")).alias("body"))
    made = made.withColumns({"date": F.format_string("%d-%02d-01T00:00:00Z", "year", "month"), "title": F.concat(F.lit("Document "), "doc_id"), "url": F.concat(F.lit("https://example.org/"), "doc_id")})
    paged.record(made, f"{at}/recorded", F.floor(F.col("doc_id") / (60 * 200)).cast("int") + 1)
    months = [(y, m) for y in range(2010, 2020) for m in range(1, 13) if (y - m) % 2]
    answers = paged.crawl(spark, f"{at}/read", "glossmill.sources.paged:Recorded", months, lanes=8, pace=0, pause=0, recorded=f"{at}/recorded")
    return paged.articles_of(answers).select("year", "month", "date", "url", "title", "section", "wordcount", F.length("body").alias("n_chars"), F.md5(F.col("body").cast("binary")).alias("body_md5"))


def url_host_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host")).agg(F.count("*").alias("n"))


def dedup_first_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.first_rows(table(spark, sf_dir, "documents").select("text", "doc_id", "source"), "text", "doc_id").select("doc_id", "source")


def stream_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream of files: of each text, the row with the least doc_id, with the batch that brought it."""
    at = shared_folder(spark)
    hashed = lambda df: df.select("doc_id", "lang", "source", F.col("url").alias("text_md5"))
    made = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("url"))
    made.write.parquet(f"{at}/in")
    process_new(spark, f"{at}/in", f"{at}/out", f"{at}/ledger", f"{at}/checkpoint", made.schema.simpleString()[7:-1].replace(":", " "), hashed, files_at_once=100_000, order=["doc_id"]).awaitTermination()
    return spark.read.parquet(f"{at}/out").drop("batch")


def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = table(spark, sf_dir, "documents").select("doc_id", "source")
    labels = table(spark, sf_dir, "labels")
    return tables.resume(queue, labels.where("toxic = 1"), labels.where("quality = 0"), key="doc_id")


def left_join_match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.match_rate(tables.attach(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id"), "toxic")


def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = tables.union_all(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "conversations").select("conv_id", "role", "text"))
    return both.groupBy("lang", "role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def outlet_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.element_at(F.array(*map(F.lit, ("The Guardian", " daily mirror ", "EXPRESS", "The Independent"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return tables.canonical_outlet(table(spark, sf_dir, "orders").select(names.alias("outlet"))).groupBy("outlet").agg(F.count("*").alias("n"))


def rolling_12m_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir).select("outlet", "quarter_end_year", "quarter_end_month", "net_migration", "n_articles", *[F.round(f, 5).alias(f) for f in FEATURES])


def fiscal_year_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir).groupBy(F.col("quarter_end_year").alias("fy_start_year")).agg(F.sum("net_migration").alias("race_hate_crimes"))
    return align.fiscal_year(dated(spark, sf_dir), s, FEATURES).select("outlet", "fy_start_year", "race_hate_crimes", "n_articles", *[F.round(f, 5).alias(f) for f in FEATURES])


def describe_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.descriptives(dated(spark, sf_dir), FEATURES)


def annual_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.annual_means(dated(spark, sf_dir).withColumn("year", F.year("date")), FEATURES)


PARTS = ["l_quantity", "l_discount", "l_tax"]


def composition_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.composition(table(spark, sf_dir, "lineitem"), PARTS, "l_returnflag")


def largest_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.largest_part(composition_share(spark, sf_dir), "l_returnflag")


def pivot_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.pivoted(composition_share(spark, sf_dir), PARTS, "l_returnflag")


def stacked_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.stacked(composition_share(spark, sf_dir), PARTS, "l_returnflag").select("l_returnflag", "subcategory", "begins", F.col("label").isNotNull().alias("labelled"))


def spearman_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.spearman(_aligned(spark, sf_dir), FEATURES, "net_migration")


def top_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.top_by_size(spearman_by_group(spark, sf_dir).select("outlet", "feature", "rho"), "rho", 10, "outlet", "feature")


def anova_tertiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.anova(_aligned(spark, sf_dir), FEATURES, "net_migration").withColumn("MSE", F.round("MSE", 2))


def _with_dummy(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = inference.methodology_flag(F.col("methodology"), F.col("quarter_end_year"))
    return _aligned(spark, sf_dir).withColumn("methodology_dummy", flag).withColumn("net_migration", F.col("net_migration") / 100000.0)


def ols_covariate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.regression(_with_dummy(spark, sf_dir), FEATURES).select("outlet", "feature", "n", "r_squared", "adj_r_squared", F.round("F", 3).alias("F"), "df_resid", F.round("x1_beta", 4).alias("x1_beta"), "x1_p", "x1_sig", "x1_survives")


def ols_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.coefficients(_with_dummy(spark, sf_dir), FEATURES)


def detrended_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["quarter_end_year", "quarter_end_month"]
    rows = inference.detrended(inference.detrended(_aligned(spark, sf_dir), "price", ["outlet"], order), "net_migration", ["outlet"], order)
    found = inference.rank_correlation(rows, "price_detrended", "net_migration_detrended", ["outlet"])
    return found.select("outlet", "n", F.round("rho", 4).alias("rho"), F.round("p", 6).alias("p"))


def first_diff_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inference.differenced(_aligned(spark, sf_dir), ["price", "net_migration"], ["outlet"], ["quarter_end_year", "quarter_end_month"])
    found = inference.rank_correlation(rows, "price_diff", "net_migration_diff", ["outlet"])
    return found.select("outlet", "n", F.round("rho", 4).alias("rho"), F.round("p", 6).alias("p"))


def bh_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.benjamini_hochberg(spearman_by_group(spark, sf_dir).select("outlet", "feature", "p_value"), "p_value", ["outlet", "feature"])


def significance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = spearman_by_group(spark, sf_dir).select("feature", stars(F.col("p_value")).alias("sig"))
    return marked.groupBy("feature").agg(F.count("*").alias("n_tests"), F.count_if(F.col("sig") != "").alias("n_significant"))


def adf_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.adf(_aligned(spark, sf_dir), "price", "outlet", ["quarter_end_year", "quarter_end_month"])


def trend_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = inference.trend_robust(_aligned(spark, sf_dir), "price", "net_migration", "outlet", ["quarter_end_year", "quarter_end_month"])
    return found.drop("adf_p_value", "adf_p_outcome")  # see adf_by_group


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.contains(F.lower("text"), F.lit("idiot")).cast("int").alias("rule"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id")


def confusion_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.binary_agreement(_judged(spark, sf_dir), "toxic", "rule")


def confusion_multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _judged(spark, sf_dir).select(F.concat("toxic", "quality").alias("human"), F.concat("rule", "quality").alias("machine"))
    return tables.class_agreement(rows, "human", "machine")


def _proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("url"), F.col("source").alias("outlet"), F.col("text").alias("body"), ((F.col("doc_id") * 37) % 101 / 100.0).alias("pro_score"), ((F.col("doc_id") * 53) % 89 / 88.0).alias("anti_score"))
    return rows.withColumn("stance_label", tables.stance_label(F.col("pro_score"), F.col("anti_score")))


def stance_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _proxy(spark, sf_dir).select(F.col("url").alias("doc_id"), "stance_label")


def stratified_sample_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.quota_sample(_proxy(spark, sf_dir), "stance_label", most=200, floor=10).groupBy().agg(F.count("*").alias("n"))


def balanced_sample_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = tables.balanced_sample(_proxy(spark, sf_dir).select("url", "pro_score"), "pro_score", 0.5)
    return drawn.groupBy((F.col("pro_score") >= 0.5).alias("above")).agg(F.count("*").alias("n"))


def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.score_counts(_proxy(spark, sf_dir), "pro_score")


def sitemap_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).distinct()
    templates = spark.createDataFrame([("a", "https://a/{year}{month:02d}.xml"), ("b", "https://b/{year}-{month:02d}-{day:02d}.xml")], "outlet string, template string")
    return web.sitemap_urls(months.crossJoin(F.broadcast(templates))).select("outlet", "url")


def topic_and_stance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With stand-ins for models: shares of keywords."""
    rows = topic_scores(articles(spark, sf_dir), keyword_model(["the", "idiot"]))
    stance = stance_scores(articles(spark, sf_dir), lambda: lambda texts: [((t or "").count("the") % 10 / 10, (t or "").count("of") % 10 / 10) for t in texts])
    return tables.attach(rows.select("url", "immigration_score"), stance)


def scores_by_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic scores of all documents by a stand-in model, a batch for each language; the run is stopped after two batches and goes on."""
    out, words = shared_folder(spark), ["idiot", "licensed", "threat", "than", "mment"]
    score = lambda rows: topic_scores(rows, keyword_model(words), score="topic_score").select("url", "topic_score")
    for most in (2, None):
        score_batches(articles(spark, sf_dir), "lang", out, "keywords", score, most=most)
    return scored(spark, out, "keywords").select(F.col("url").alias("doc_id"), "topic_score", "model", "batch")


def window_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of ``documents`` by source and their share of the language's."""
    n = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.try_divide("n", F.sum("n").over(Window.partitionBy("lang"))), 6))


def _put(items: list[str], key: Column) -> Column:
    """The item that a number falls on."""
    return F.element_at(F.array(*map(F.lit, items)), (F.pmod(key, F.lit(len(items))) + 1).cast("int"))


def _with_terms(spark: SparkSession, sf_dir: str, terms: list) -> DataFrame:
    """Texts with three terms of the lexicon put in each, their tokens and words."""
    names, key = [t.term for t in terms], F.col("doc_id")
    put = F.concat_ws(" ", F.coalesce("text", F.lit("")), _put(names, key), _put(names, key * 7 + 3), _put(names, key * 11 + 5))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lower(put).alias("lowered"))
    return rows.withColumns({"tokens": word_tokens(F.col("lowered")), "n_words": word_count(F.col("lowered"))})


def dehumanisation_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published lexicon, all tiers and categories, over texts with its terms put in."""
    rows, count = counts_of(_with_terms(spark, sf_dir, DEHUMANISATION), F.col("lowered"), {"dehum": lexicon_frame(spark, DEHUMANISATION)})
    found = dehumanisation(count("dehum"), F.col("n_words"))
    return rows.select("doc_id", *[c.alias(k) for k, c in found.items()])


def outrage_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published lexicon, all categories, over texts with its terms put in."""
    rows, count = counts_of(_with_terms(spark, sf_dir, OUTRAGE), F.col("lowered"), {"outrage": lexicon_frame(spark, OUTRAGE)})
    found = outrage(count("outrage"), F.col("n_words"))
    return rows.select("doc_id", *[c.alias(k) for k, c in found.items()])


#: Boilerplate that the published rules take out, and lines close to it.
BOILERPLATE = [
    "\nDON'T MISS: a b", "\nJUST IN: c", "\nRead more: d\nthe end", "\n- Bookmark", "\n- CommentsGo to comments", "\nJoin our commenting forum\nx\nsee their replies\nComments ",
    "\nDo you have an opinion on the issues raised here? Write.", " Have an opinion on anything you've read today?", "\n• Join the debate – by mail", " Sign up to our weekly email for more. It stays.",
    "\nSign up here. Get the daily email now! Stays.", "\nTo get more stories, sign up today.", "\nFor the latest breaking news sign up to it", ", sign up for our free Daily Star Hot newsletter now",
    "\nWant all the biggest news? Sign up. ", ", sign up to one of our newsletters here .", "\nREAD NEXT:\n\nOne line\nTwo lines\n\nGoes on", "\nREAD NEXT...", "\nREAD MORE:  x\nthe end",
    "\nSign up for all the best news from the Mirror here.", "\nNEWSLETTER: y", "\nREAD MORE: Join our huge WhatsApp group", "\nJoin our WhatsApp now", "\nGet news straight to your WhatsApp",
    "\nNow the Mirror has launched its very own WhatsApp", "\nWe'll send you the latest on WhatsApp", "\nAll you have to do to join is", "\n* Join The Mirror’s WhatsApp Community here", "\nPARTY GAMES: z", "\nNot a rule: w",
]


def published_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All published rules of the five outlets but the fold over headline blocks, over texts with boilerplate put in."""
    key = F.col("doc_id")
    said = F.concat(_put(BOILERPLATE, key * 5 + 2), F.coalesce("text", F.lit("")), _put(BOILERPLATE, key), F.lit("\nThe body goes on."), _put(BOILERPLATE, key * 7 + 3))
    rules = [r for r in RULES if r.pattern != HEADLINE_BLOCK]
    cleaned = {o: apply_rules(F.col("said"), [r for r in rules if r.outlet == o]) for o in ROUTES}
    return table(spark, sf_dir, "documents").select("doc_id", said.alias("said")).select("doc_id", *[F.md5(c.cast("binary")).alias(o) for o, c in cleaned.items()])


def subcategory_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.subcategory_family(_aligned(spark, sf_dir), FEATURES, "net_migration", "outlet", ["quarter_end_year", "quarter_end_month"])


def stance_validation_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles drawn by label; as a hash draws them, labels are counted, and bodies held against those of their articles."""
    rows = _proxy(spark, sf_dir)
    drawn = tables.stance_sample(rows.select("url", "outlet", "body"), rows.select("url", "pro_score", "anti_score", "stance_label"))
    again = drawn.join(rows.select("url", F.md5("body").alias("digest")), "url")
    same = F.count_if(F.md5("body").eqNullSafe(F.col("digest")))
    return again.groupBy("stance_label").agg(F.count("*").alias("n"), F.countDistinct("url").alias("n_urls"), same.alias("n_same"))


def dual_axis_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = {"2-HIGH": "High", "1-URGENT": "Urgent", "5-LOW": "Low"}
    return align.dual_series(_aligned(spark, sf_dir).withColumn("rest", F.round("rest", 5)), "rest", "net_migration", shown=shown, broke="1996-06-01")


QUERIES = {
    f.__name__: f
    for f in (
        lexicon_density_by_source, lexicon_wide_features, phrase_hits, term_totals_by_language, sentence_stats, modal_pronoun_markers, sentence_sentiment, article_feature_table,
        keyword_filter, keyword_query_difference, clean_rules_apply, clean_by_file_name, clean_word_delta, page_paragraphs, page_text_extract, paged_articles, url_host_counts,
        dedup_first_text, stream_first_rows, resume_anti_join, left_join_match_rate, union_by_name, outlet_names, rolling_12m_mean, fiscal_year_mean, describe_by_group, annual_means,
        composition_share, largest_share, pivot_shares, stacked_shares, spearman_by_group, top_abs, anova_tertiles, ols_covariate, ols_coefficients,
        detrended_spearman, first_diff_spearman, bh_fdr, significance_counts, adf_by_group, trend_robustness, confusion_binary, confusion_multiclass,
        stance_label, stratified_sample_sizes, balanced_sample_sizes, score_distribution, sitemap_expand, topic_and_stance, scores_by_batch, window_share,
        dehumanisation_features, outrage_features, published_rules, subcategory_spearman, stance_validation_sample, dual_axis_series,
    )
}
