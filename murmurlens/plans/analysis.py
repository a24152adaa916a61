"""The enriched table and the full set of statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from murmurlens.config import VIETNAMESE, TextConfig
from murmurlens.functions.scoring import lexicon_hits, score_of_hits, toxic_level, toxic_word_count
from murmurlens.functions.tokens import Tokenizer, terms, word_count
from murmurlens.operators import stats, terms as term_stats
from murmurlens.session import materialise


def score_comments(df: DataFrame, config: TextConfig = VIETNAMESE, tokenizer: Tokenizer | None = None) -> DataFrame:
    """Add lengths, toxic words, score and level; the text is tokenised once."""
    make = tokenizer or (lambda text: terms(text, config))
    tokens = df.withColumn("__tokens", make(F.col("text")))
    hits = tokens.withColumns({
        "__hits": lexicon_hits(F.col("__tokens"), config),
        "n_toxic_words": toxic_word_count(F.col("__tokens"), config),
        "n_chars": F.char_length("text"),
        "n_words": word_count(F.col("text")),
    })
    scored = hits.withColumn("toxic_score", score_of_hits(F.col("__hits")))
    return scored.withColumn("toxic_level", toxic_level(F.col("toxic_score"))).drop("__tokens", "__hits")


def basic_statistics(df: DataFrame, config: TextConfig = VIETNAMESE, counts: DataFrame | None = None) -> dict[str, DataFrame]:
    counts = term_stats.word_counts(df, config) if counts is None else counts
    out = {
        "label_distribution": stats.label_distribution(df),
        "source_comparison": stats.source_label_crosstab(df),
        "top_toxic_words": term_stats.top_toxic_words(counts, 20),
        "length_by_label": stats.length_by_label(df),
    }
    if "published_at" in df.columns:
        out["toxic_by_hour"] = stats.toxic_by_hour(df)
    return out


def advanced_statistics(df: DataFrame, config: TextConfig = VIETNAMESE, counts: DataFrame | None = None) -> dict[str, DataFrame]:
    """Everything on one enriched table, written once and read column by column."""
    counts = term_stats.word_counts(df, config) if counts is None else counts
    scored = materialise(score_comments(df, config).drop("text"), "scored")
    grams = materialise(term_stats.ngram_counts(df, config=config), "ngrams")
    return {
        "scored": scored,
        "ngrams": term_stats.top_ngrams(grams, 20),
        "distinct_ngrams": term_stats.distinct_ngrams(grams),
        "levels": stats.level_distribution(scored),
        "score_by_label": stats.score_by_label(scored),
        "label_by_level": stats.label_level_crosstab(scored),
        "correlation": stats.length_score_correlation(scored),
        "trend": stats.length_score_trend(scored),
        "metrics_by_label": stats.metrics_by_label(scored),
        "topics": term_stats.keywords_per_label(counts, 15),
        "cloud_terms": term_stats.keywords_per_label(counts, 150),
    }


def analyse(df: DataFrame, config: TextConfig = VIETNAMESE) -> dict[str, DataFrame]:
    """Basic and advanced statistics over one shared word-count table."""
    counts = materialise(term_stats.word_counts(df, config), "word-counts")
    return {**basic_statistics(df, config, counts), **advanced_statistics(df, config, counts)}
