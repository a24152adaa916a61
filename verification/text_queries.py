"""Scalar text functions, each over whole texts."""

from pyspark.sql import functions as F

from murmurlens.functions import cleaning as N, keys as K, scoring as S, similarity as M, tokens as T
from murmurlens.plans.analysis import score_comments
from verification.near_sql import sql_scores
from verification.registry import (
    COMMENTS, FIXTURE, SCORED_ALL, comments, labelled_comments, query, quoted, sql, sql_pairs, sql_strip, sql_terms, table,
)

# ---- SQL for the cleaning chain --------------------------------------------
_EDGE = r"[^\p{L}\p{N}_]"
_WIDE = (r"[\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
_EMOJI = (r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}"
          r"\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]+")


def sub(x, pattern, to=" "):
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


def sql_expand(x):
    """No look-around here, so neighbours share an edge: replace twice."""
    out = f"lower({x})"
    for key, value in FIXTURE.abbreviations.items():
        for _ in range(2):
            out = sub(out, f"(^|{_EDGE}){key}({_EDGE}|$)", rf"\1{value}\2")
    return out


def sql_links(x):
    for pattern in (r"(?i)https?://\S+|www\.\S+", r"\S+@\S+\.\S+", r"(\+84|0)\p{Nd}{9,10}"):
        x = sub(x, pattern)
    return x


def sql_spaces(x):
    return f"trim({sub(x, r'\s+')}, ' ')"


def sql_collapse(source, name):
    """Runs as gaps and islands over single characters: four or more become two."""
    return f"""{name}_chars AS (SELECT seq, unnest(string_split(t, '')) AS ch,
    unnest(range(0, len(string_split(t, '')))) AS i FROM {source} WHERE t <> ''),
{name}_mark AS (SELECT *, i - row_number() OVER (PARTITION BY seq, ch ORDER BY i) AS island FROM {name}_chars),
{name}_pos AS (SELECT *, row_number() OVER (PARTITION BY seq, ch, island ORDER BY i) AS p,
    count(*) OVER (PARTITION BY seq, ch, island) AS n FROM {name}_mark),
{name} AS (SELECT s.seq, coalesce(string_agg(c.ch, '' ORDER BY c.i), '') AS t FROM {source} s
    LEFT JOIN {name}_pos c ON c.seq = s.seq AND (c.n < 4 OR c.p <= 2 OR c.ch = chr(10)) GROUP BY s.seq)"""


#: ``cleaned(seq, t)`` for the documents table.
CLEANED = f"""step1 AS MATERIALIZED (SELECT doc_id AS seq,
   {sub(sql_links(sql_expand(sub('text', _WIDE))), _EMOJI)} AS t FROM documents),
{sql_collapse('step1', 'step2')},
cleaned AS MATERIALIZED (SELECT seq, {sql_spaces(sub('t', r'[^\p{L}\p{N}_\s.,!?\-]'))} AS t FROM step2)"""


def docs(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), "text", "source")


def text_query(name, fn, expression, source="documents", key="doc_id", col="text"):
    @query(name, f"SELECT {key} AS seq, {expression} AS text FROM {source}")
    def run(spark, sf):
        return table(spark, sf, source).select(F.col(key).alias("seq"), fn(F.col(col)).alias("text"))

    return run


text_query("expanded_abbreviations", lambda c: N.expand_abbreviations(c, FIXTURE), sql_expand("text"))
text_query("without_urls", N.drop_urls, sub("html", r"(?i)https?://\S+|www\.\S+"), "pages", "page_id", "html")
text_query("without_emails", N.drop_emails, sub("text", r"\S+@\S+\.\S+"))
text_query("without_phones", N.drop_phones, sub("text", r"(\+84|0)\p{Nd}{9,10}"))
text_query("without_emoji", lambda c: N.drop_emoji(F.translate(c, "xqzk", "😀中🚀✂")), sub("translate(text, 'xqzk', '😀中🚀✂')", _EMOJI))
text_query("without_special", N.drop_special, sub("text", r"[^\p{L}\p{N}_\s.,!?\-]"))
text_query("collapsed_spaces", N.collapse_spaces, sql_spaces("text"))
text_query("composed_text", lambda c: N.nfc(F.replace(c, F.lit("\u00e9"), F.lit("e\u0301"))),
           "nfc_normalize(replace(text, 'é', 'e' || chr(769)))")
text_query("comparison_form", N.comparison_form, sql_spaces(sub(f"lower({sub('text', _WIDE)})", r"[^\p{L}\p{N}_\s]")))


@query("collapsed_repeats", sql(f"src AS (SELECT doc_id AS seq, text AS t FROM documents), {sql_collapse('src', 'out')}",
                                "SELECT seq, t AS text FROM out"))
def collapsed_repeats(spark, sf):
    return docs(spark, sf).select("seq", N.collapse_repeats(F.col("text")).alias("text"))


@query("clean_text", sql(CLEANED, "SELECT seq, t AS text FROM cleaned"))
def clean_text(spark, sf):
    return docs(spark, sf).select("seq", N.clean_text(F.col("text"), config=FIXTURE).alias("text"))


NORMAL = sql_spaces(sub(f"lower({sub('text', _WIDE)})", r"[^\p{L}\p{N}_\s]"))


@query("block_keys", f"""
SELECT doc_id AS seq, array_to_string(string_split(t, ' ')[1:2], ' ') AS prefix, length(t) // 20 AS bucket
FROM (SELECT doc_id, {NORMAL} AS t FROM documents)""")
def block_keys(spark, sf):
    normal = docs(spark, sf).select("seq", N.comparison_form(F.col("text")).alias("t"))
    return normal.select("seq", M.block_prefix(F.col("t")).alias("prefix"), M.length_bucket(F.col("t")).alias("bucket"))


@query("terms", sql(COMMENTS, f"SELECT seq, array_to_string({sql_terms('text')}, ' ') AS terms, len({sql_terms('text')}) AS n FROM comments"))
def terms(spark, sf):
    tokens = docs(spark, sf).select("seq", T.terms(F.col("text"), FIXTURE).alias("t"))
    return tokens.select("seq", F.array_join("t", " ").alias("terms"), F.size("t").alias("n"))


@query("ngrams", f"""
WITH t AS (SELECT doc_id AS seq, {sql_terms('text')} AS t FROM documents)
SELECT seq, 2 AS n, array_to_string(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]), '/') AS grams FROM t
UNION ALL SELECT seq, 3, array_to_string(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]), '/') FROM t""")
def ngrams(spark, sf):
    tokens = docs(spark, sf).select("seq", T.terms(F.col("text"), FIXTURE).alias("t"))
    gram = lambda n: F.struct(F.lit(n).alias("n"), F.array_join(T.ngrams(F.col("t"), n), "/").alias("grams"))
    return tokens.select("seq", F.inline(F.array(gram(2), gram(3))))


@query("lexicon_scores", sql(SCORED_ALL, "SELECT seq, len(w) AS hits, toxic_score, toxic_level FROM scored"))
def lexicon_scores(spark, sf):
    tokens = docs(spark, sf).select("seq", T.terms(F.col("text"), FIXTURE).alias("t"))
    hits = tokens.select("seq", S.lexicon_hits(F.col("t"), FIXTURE).alias("w"))
    scores = hits.select("seq", F.size("w").alias("hits"), S.score_of_hits(F.col("w")).alias("toxic_score"))
    return scores.withColumn("toxic_level", S.toxic_level(F.col("toxic_score")))


@query("toxic_word_counts", sql(SCORED_ALL, "SELECT seq, n_toxic_words, n_chars, n_words FROM scored"))
def toxic_word_counts(spark, sf):
    return score_comments(docs(spark, sf), FIXTURE).select("seq", "n_toxic_words", "n_chars", "n_words")


@query("text_lengths", """SELECT doc_id AS seq, length(text) AS chars,
  len(list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '')) AS words FROM documents""")
def text_lengths(spark, sf):
    return docs(spark, sf).select("seq", T.char_count(F.col("text")).alias("chars"), T.word_count(F.col("text")).alias("words"))


@query("record_keys", f"""
SELECT doc_id AS seq, CASE WHEN doc_id % 3 = 0 THEN source || '|comment|' || doc_id
  ELSE source || '|text|' || CASE doc_id % 3 WHEN 1 THEN 'v' || doc_id ELSE lang END || '|' || {sql_strip('text')} END AS record_key
FROM documents""")
def record_keys(spark, sf):
    r = F.col("doc_id") % 3
    ids = F.col("doc_id").cast("string")
    df = table(spark, sf, "documents").select(
        F.col("doc_id").alias("seq"), "source", "text", F.when(r == 0, ids).when(r == 1, "  ").alias("comment_id"),
        F.when(r == 1, F.concat(F.lit("v"), ids)).alias("video_id"), F.col("lang").alias("post_id"))
    return df.select("seq", K.record_key(df).alias("record_key"))


@query("label_spelling", """
SELECT seq, upper(trim(coalesce(v, ''))) AS label FROM (
  SELECT doc_id AS seq, CASE WHEN doc_id % 4 <> 0 THEN '  ' || lang || ' ' END AS v FROM documents)""")
def label_spelling(spark, sf):
    raw = F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("  "), "lang", F.lit(" ")))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), K.normalize_label(raw).alias("label"))


@query("corpus_label_names", """
SELECT doc_id AS seq, CASE doc_id % 9 WHEN 0 THEN 'CLEAN' WHEN 1 THEN 'OFFENSIVE' WHEN 2 THEN 'HATE' WHEN 3 THEN 'HATE'
  WHEN 4 THEN 'CLEAN' WHEN 5 THEN 'OFFENSIVE' WHEN 6 THEN 'CLEAN' WHEN 7 THEN NULL ELSE '3' END AS label FROM labels""")
def corpus_label_names(spark, sf):
    raw = F.array(*[F.lit(v) for v in ("0", "1", "2", "hate ", "Normal", "SPAM", "non-hate", None, "3")])
    return table(spark, sf, "labels").select(
        F.col("doc_id").alias("seq"), K.corpus_label(F.get(raw, (F.col("doc_id") % 9).cast("int"))).alias("label"))


@query("hours", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE hour(ts) END AS hour FROM events""")
def hours(spark, sf):
    r = F.col("event_id") % 4
    raw = (F.when(r == 0, "no time").when(r == 1, F.date_format("ts", "yyyy-MM-dd"))
           .when(r == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")))
    return table(spark, sf, "events").select("event_id", K.hour_of_day(raw).alias("hour"))


@query("epoch_times", """
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL
  ELSE strftime(make_timestamp((epoch(ts)::BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') END AS iso
FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)""")
def epoch_times(spark, sf):
    shift = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.date_trunc("second", "ts").cast("timestamp_ntz"))
    return table(spark, sf, "events").select(
        "event_id", K.epoch_to_iso(F.when(F.col("event_id") % 5 == 0, 0).otherwise(shift)).alias("iso"))


@query("post_ids", """
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN CAST(page_id AS VARCHAR)
  ELSE coalesce(nullif(regexp_extract(url, '[?&]page=(\\d+)(&|#|$)', 1), ''), regexp_extract(url, '/[a-z]{2}/(\\d+)', 1)) END AS post_id
FROM pages""")
def post_ids(spark, sf):
    target = F.url_encode(F.concat(F.lit("https://x.example/groups/9/posts/"), F.col("page_id").cast("string")))
    link = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://l.example/l.php?h=1&u="), target)).otherwise(F.col("url"))
    return table(spark, sf, "pages").select(
        "page_id", K.post_id_of_url(link, (*K.POST_PATHS, r"/[a-z]{2}/(\d+)"), (*K.POST_QUERY_KEYS, "page")).alias("post_id"))


# Neighbours in a block: one pair per row, however large the block.
def _neighbours(spark, sf):
    from pyspark.sql import Window

    from murmurlens.operators.neardup import profile

    rows = profile(docs(spark, sf).withColumn("seq", F.col("seq")))
    order = Window.partitionBy("block").orderBy("bucket", "id")
    before = rows.select("id", "tokens", F.lag("id").over(order).alias("other"), F.lag("tokens").over(order).alias("prev"))
    return before.filter(F.col("other").isNotNull()).select(
        "id", "other", F.split("prev", " ").alias("a"), F.split("tokens", " ").alias("b"))


_PAIRS = f"""n AS (SELECT doc_id AS id, {NORMAL} AS t FROM documents),
p AS (SELECT id, array_to_string(string_split(t, ' ')[1:2], ' ') AS prefix, length(t) // 20 AS bucket,
   list_sort(list_distinct(string_split(t, ' '))) AS tokens FROM n WHERE t <> ''),
q AS (SELECT id, tokens AS b, lag(id) OVER w AS other, lag(tokens) OVER w AS a FROM p
   WINDOW w AS (PARTITION BY prefix ORDER BY bucket, id)),
z AS (SELECT id, other, len(array_to_string(list_sort(list_intersect(a, b)), ' ')) AS s,
   length(array_to_string(list_filter(a, lambda v: NOT list_contains(b, v)), ' ')) AS x,
   length(array_to_string(list_filter(b, lambda v: NOT list_contains(a, v)), ' ')) AS y FROM q WHERE other IS NOT NULL)"""


@query("similarity_bounds", sql(_PAIRS, """
SELECT id, other, round(lower_bound, 6) AS lower_bound,
  round(CASE WHEN x = 0 OR y = 0 THEN lower_bound
   ELSE greatest(lower_bound, 100 - 100.0 * abs(x - y) / (2 * s + 2 + x + y)) END, 6) AS upper_bound
FROM (SELECT *, CASE WHEN x = 0 OR y = 0 THEN 100.0::DOUBLE
   ELSE greatest(100 - 100.0::DOUBLE * (1 + x) / (2 * s + 1 + x), 100 - 100.0::DOUBLE * (1 + y) / (2 * s + 1 + y)) END AS lower_bound FROM z)"""))
def similarity_bounds(spark, sf):
    bounded = M.with_bounds(_neighbours(spark, sf), "a", "b")
    return bounded.select("id", "other", F.round("lower", 6).alias("lower_bound"), F.round("upper", 6).alias("upper_bound"))


@query("similarity_scores", sql(_PAIRS + ",\nboth_sides AS (SELECT other AS a, id AS b, a AS ta, q.b AS tb FROM q WHERE other IS NOT NULL)," + sql_scores("both_sides"),
           "SELECT b AS id, a AS other, round(score, 6) AS score FROM scored"))
def similarity_scores(spark, sf):
    return M.score_pairs(_neighbours(spark, sf), "a", "b").select("id", "other", F.round("score", 6).alias("score"))
