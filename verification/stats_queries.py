"""Statistics, reports."""

from pyspark.sql import functions as F

from murmurlens.operators import stats as S, terms as W
from murmurlens.plans.analysis import score_comments
from murmurlens.plans.report import summary_report
from verification.registry import (
    COMMENTS, FIXTURE, LABELLED, SCORED, SCORED_ALL, comments, labelled_comments, query, sql, sql_terms, table,
)

TOXIC = "label IN ('OFFENSIVE', 'HATE')"
_DOMAIN = "(VALUES ('CLEAN'), ('OFFENSIVE'), ('HATE')) v(label)"
WORDS = f"{LABELLED}, words AS (SELECT label, unnest({sql_terms('text')}) AS word FROM labelled)"
GRAMS = f"""{LABELLED}, tk AS (SELECT label, {sql_terms('text')} AS t FROM labelled WHERE {TOXIC}),
grams AS (SELECT 2 AS n, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS ngram FROM tk
  UNION ALL SELECT 3, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) FROM tk),
counted AS (SELECT n, ngram, count(*) AS count FROM grams GROUP BY ALL)"""


def scored(spark, sf):
    return score_comments(labelled_comments(spark, sf), FIXTURE)


def word_counts(spark, sf):
    return W.word_counts(labelled_comments(spark, sf), FIXTURE)


def gram_counts(spark, sf):
    return W.ngram_counts(labelled_comments(spark, sf), config=FIXTURE)


@query("label_distribution", sql(COMMENTS, f"""
SELECT v.label, count(c.seq) AS count, round(count(c.seq) * 100.0::DOUBLE / (SELECT count(*) FROM comments), 2) AS pct
FROM {_DOMAIN} LEFT JOIN comments c ON c.label = v.label GROUP BY v.label"""))
def label_distribution(spark, sf):
    return S.label_distribution(comments(spark, sf))


@query("corpus_label_shares", sql(LABELLED, f"""
SELECT v.label, count(c.seq) AS count, round(count(c.seq) * 100.0::DOUBLE / (SELECT count(*) FROM labelled WHERE lang = 'en'), 2) AS pct
FROM {_DOMAIN} LEFT JOIN labelled c ON c.label = v.label AND c.lang = 'en' GROUP BY v.label"""))
def corpus_label_shares(spark, sf):
    rows = labelled_comments(spark, sf).withColumn("source", F.when(F.col("lang") == "en", "vihsd").otherwise(F.col("source")))
    return S.corpus_label_shares(rows)


@query("rows_per_source", "SELECT source, count(*) AS count FROM documents GROUP BY source")
def rows_per_source(spark, sf):
    return S.row_counts(table(spark, sf, "documents"), "source")


@query("rows_per_community", "SELECT lang, source, count(*) AS count FROM documents GROUP BY ALL")
def rows_per_community(spark, sf):
    return S.row_counts(table(spark, sf, "documents"), "lang", "source")


@query("toxic_by_source", sql(LABELLED, f"""
SELECT source, count(*) AS total, count(*) FILTER ({TOXIC}) AS toxic,
  round(count(*) FILTER ({TOXIC}) * 100.0::DOUBLE / count(*), 2) AS toxic_rate_pct FROM labelled GROUP BY source"""))
def toxic_by_source(spark, sf):
    return S.toxic_by_source(labelled_comments(spark, sf))


def _cells(digits):
    return ", ".join(f"round(count(*) FILTER (label = '{v}') * 1.0::DOUBLE / count(*) * 100, {digits}) AS {v}"
                     for v in ("CLEAN", "OFFENSIVE", "HATE"))


@query("source_label_crosstab", sql(LABELLED, f"""
SELECT source, {_cells(2)} FROM labelled GROUP BY source UNION ALL SELECT 'All', {_cells(2)} FROM labelled"""))
def source_label_crosstab(spark, sf):
    return S.source_label_crosstab(labelled_comments(spark, sf))


@query("source_label_shares", sql(LABELLED, f"SELECT source, {_cells(6)} FROM labelled GROUP BY source"))
def source_label_shares(spark, sf):
    return S.source_label_shares(labelled_comments(spark, sf))


@query("toxic_by_hour", sql(LABELLED, f"""
SELECT hour(published_at) AS hour, count(*) AS total, count(*) FILTER ({TOXIC}) AS toxic,
  round(count(*) FILTER ({TOXIC}) * 100.0::DOUBLE / count(*), 2) AS toxic_rate_pct
FROM labelled WHERE published_at IS NOT NULL GROUP BY 1"""))
def toxic_by_hour(spark, sf):
    return S.toxic_by_hour(labelled_comments(spark, sf, time=True), F.hour("published_at"))


@query("length_by_label", sql(LABELLED, """
SELECT label, round(avg(length(text)), 1) AS mean, round(median(length(text)), 1) AS median,
  min(length(text)) AS shortest, max(length(text)) AS longest FROM labelled GROUP BY label"""))
def length_by_label(spark, sf):
    return S.length_by_label(labelled_comments(spark, sf))


@query("top_toxic_words", sql(WORDS, f"SELECT word, count(*) AS count FROM words WHERE {TOXIC} GROUP BY word ORDER BY count DESC, word LIMIT 20"))
def top_toxic_words(spark, sf):
    return W.top_toxic_words(word_counts(spark, sf))


@query("word_counts", sql(WORDS, "SELECT label, word, count(*) AS count FROM words GROUP BY ALL"))
def all_word_counts(spark, sf):
    return word_counts(spark, sf)


_TOP_PER = ("SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {g} ORDER BY count DESC, {t}) AS INTEGER) AS rank FROM {f}) WHERE rank <= {k}")


@query("top_ngrams", sql(GRAMS, _TOP_PER.format(g="n", t="ngram", f="counted", k=20)))
def top_ngrams(spark, sf):
    return W.top_ngrams(gram_counts(spark, sf))


@query("top_ngrams_all_labels", sql(GRAMS.replace(f" WHERE {TOXIC}", ""), _TOP_PER.format(g="n", t="ngram", f="counted", k=20)))
def top_ngrams_all_labels(spark, sf):
    return W.top_ngrams(W.ngram_counts(labelled_comments(spark, sf), toxic_only=False, config=FIXTURE))


@query("distinct_ngrams", sql(GRAMS, "SELECT n, count(*) AS distinct_ngrams FROM counted GROUP BY n"))
def distinct_ngrams(spark, sf):
    return W.distinct_ngrams(gram_counts(spark, sf))


_LABEL_WORDS = f"{WORDS}, counted AS (SELECT label, word, count(*) AS count FROM words GROUP BY ALL)"


@query("keywords_per_label", sql(_LABEL_WORDS, _TOP_PER.format(g="label", t="word", f="counted", k=15)))
def keywords_per_label(spark, sf):
    return W.keywords_per_label(word_counts(spark, sf))


@query("cloud_terms", sql(_LABEL_WORDS, _TOP_PER.format(g="label", t="word", f="counted", k=150)))
def cloud_terms(spark, sf):
    return W.keywords_per_label(word_counts(spark, sf), 150)


@query("display_bigrams", sql(GRAMS, "SELECT ngram, count FROM counted WHERE n = 2 ORDER BY count DESC, ngram LIMIT 15"))
def display_bigrams(spark, sf):
    return W.display_cut(gram_counts(spark, sf).filter("n = 2").drop("n"), "ngram")


_LEVELS = "(VALUES ('KHÔNG TOXIC'), ('TOXIC NHẸ'), ('TOXIC TRUNG BÌNH'), ('TOXIC NẶNG'), ('CỰC KỲ TOXIC')) v(toxic_level)"


@query("level_distribution", sql(SCORED, f"""
SELECT v.toxic_level, count(s.seq) AS count, round(count(s.seq) * 100.0::DOUBLE / (SELECT count(*) FROM scored), 2) AS pct
FROM {_LEVELS} LEFT JOIN scored s ON s.toxic_level = v.toxic_level GROUP BY v.toxic_level"""))
def level_distribution(spark, sf):
    return S.level_distribution(scored(spark, sf))


@query("score_by_label", sql(SCORED, "SELECT label, round(avg(toxic_score), 6) AS mean_score FROM scored GROUP BY label"))
def score_by_label(spark, sf):
    return S.score_by_label(scored(spark, sf))


@query("label_level_crosstab", sql(SCORED, "SELECT label, " + ", ".join(
    f"round(count(*) FILTER (toxic_level = '{v}') * 1.0::DOUBLE / count(*) * 100, 6) AS \"{v}\""
    for v in ("KHÔNG TOXIC", "TOXIC NHẸ", "TOXIC TRUNG BÌNH", "TOXIC NẶNG", "CỰC KỲ TOXIC")) + " FROM scored GROUP BY label"))
def label_level_crosstab(spark, sf):
    return S.label_level_crosstab(scored(spark, sf))


_CORR = "CASE WHEN isnan({c}) THEN NULL ELSE {c} END".format(c="corr(n_chars, toxic_score)")


@query("length_score_correlation", sql(SCORED, f"""
SELECT r AS correlation, CASE WHEN abs(r) < 0.3 THEN 'weak' WHEN abs(r) < 0.7 THEN 'medium' WHEN r IS NOT NULL THEN 'strong' END AS strength
FROM (SELECT round({_CORR}, 6) AS r FROM scored)"""))
def length_score_correlation(spark, sf):
    return S.length_score_correlation(scored(spark, sf))


@query("correlation_bands", sql(SCORED_ALL, """
SELECT seq, CASE WHEN abs(toxic_score / 100) < 0.3 THEN 'weak' WHEN abs(toxic_score / 100) < 0.7 THEN 'medium' ELSE 'strong' END AS strength FROM scored"""))
def correlation_bands(spark, sf):
    from murmurlens.functions.scoring import correlation_band

    return score_comments(comments(spark, sf), FIXTURE).select("seq", correlation_band(F.col("toxic_score") / 100).alias("strength"))


@query("metrics_by_label", sql(SCORED, """
SELECT label, round(avg(n_chars), 2) AS chars_mean, round(median(n_chars), 2) AS chars_median,
  round(avg(n_words), 2) AS words_mean, round(median(n_words), 2) AS words_median,
  round(avg(n_toxic_words), 2) AS toxic_words_mean, sum(n_toxic_words)::BIGINT AS toxic_words_sum FROM scored GROUP BY label"""))
def metrics_by_label(spark, sf):
    return S.metrics_by_label(scored(spark, sf))


_TRIMMED = f"{SCORED}, trimmed AS (SELECT * FROM scored WHERE n_chars <= (SELECT quantile_cont(n_chars, 0.95) FROM scored))"


@query("without_long_outliers", sql(_TRIMMED, "SELECT seq, n_chars, toxic_score FROM trimmed"))
def without_long_outliers(spark, sf):
    return S.without_long_outliers(scored(spark, sf)).select("seq", "n_chars", "toxic_score")


@query("length_score_trend", sql(_TRIMMED, f"""
SELECT count(*) AS n, round(regr_slope(toxic_score, n_chars), 6) AS slope,
  round(regr_intercept(toxic_score, n_chars), 6) AS intercept, round({_CORR}, 6) AS correlation FROM trimmed"""))
def length_score_trend(spark, sf):
    return S.length_score_trend(scored(spark, sf))


@query("toxic_totals", sql(LABELLED, f"SELECT count(*) FILTER ({TOXIC}) AS toxic, count(*) FILTER (label = 'CLEAN') AS clean FROM labelled"))
def toxic_totals(spark, sf):
    return S.toxic_totals(labelled_comments(spark, sf))


@query("queue_status", sql(COMMENTS, """
SELECT 'pending' AS queue, CAST(NULL AS VARCHAR) AS label, count(*) AS count FROM comments WHERE label IS NULL
UNION ALL SELECT 'review', NULL, count(*) FROM comments WHERE lang = 'en'
UNION ALL SELECT 'review', coalesce(label, '<blank>'), count(*) FROM comments WHERE lang = 'en' GROUP BY 2
UNION ALL SELECT 'store', NULL, count(*) FROM comments WHERE label IS NOT NULL
UNION ALL SELECT 'store', label, count(*) FROM comments WHERE label IS NOT NULL GROUP BY 2"""))
def queue_status(spark, sf):
    rows = comments(spark, sf)
    return S.queue_status(rows.filter("label IS NULL"), rows.filter("lang = 'en'"), rows.filter("label IS NOT NULL"))


@query("label_outcomes", sql(COMMENTS, """
SELECT coalesce(label, 'LABEL_ERROR') AS label, count(*) AS count,
  round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM comments), 2) AS pct FROM comments GROUP BY 1"""))
def label_outcomes(spark, sf):
    rows = comments(spark, sf).withColumn("label", F.coalesce("label", F.lit("LABEL_ERROR")))
    return S.outcome_summary(rows)


@query("summary_report", sql(LABELLED, f"""
SELECT (SELECT count(*) FROM labelled) AS total_rows,
  (SELECT count(*) FROM labelled WHERE label = 'HATE') AS hate_count,
  (SELECT round(count(*) FILTER (label = 'CLEAN') * 100.0::DOUBLE / count(*), 2) FROM labelled) AS clean_pct,
  (SELECT count(*) FROM labelled WHERE source = 'src3') AS src3_total,
  (SELECT string_agg(source || ':' || toxic, ',' ORDER BY source) FROM (
     SELECT source, count(*) FILTER ({TOXIC}) AS toxic FROM labelled GROUP BY source)) AS toxic_by_source"""))
def summary(spark, sf):
    report = summary_report(labelled_comments(spark, sf))
    parsed = report.select(F.from_json("report", (
        "total_rows bigint, label_distribution map<string, struct<count:bigint, pct:double>>, "
        "source_distribution map<string, bigint>, toxic_by_source array<struct<source:string, total:bigint, "
        "toxic:bigint, toxic_rate_pct:double>>")).alias("r"))
    return parsed.select(
        "r.total_rows", F.col("r.label_distribution")["HATE"]["count"].alias("hate_count"),
        F.col("r.label_distribution")["CLEAN"]["pct"].alias("clean_pct"),
        F.col("r.source_distribution")["src3"].alias("src3_total"),
        F.array_join(F.transform("r.toxic_by_source", lambda s: F.concat(s["source"], F.lit(":"), s["toxic"].cast("string"))), ",").alias("toxic_by_source"))
