"""Deduplication, windows, limits."""

from pyspark.sql import functions as F

from murmurlens.functions import cleaning as N, keys as K
from murmurlens.operators import dedup as D, neardup as ND, terms as W
from murmurlens.operators.selection import smallest
from murmurlens.plans.cleaning import clean_comments, cleaning_audit
from verification.near_sql import sql_kept
from verification.registry import (
    COMMENTS, FIXTURE, LABELLED, SCORED_ALL, comments, labelled_comments, query, sql, table,
)
from verification.text_queries import CLEANED, NORMAL, docs


@query("exact_duplicates_removed", sql(CLEANED, """
SELECT min(c.seq) AS seq, c.t AS text, d.source FROM cleaned c JOIN documents d ON d.doc_id = c.seq
WHERE length(c.t) >= 5 GROUP BY c.t, d.source"""))
def exact_duplicates_removed(spark, sf):
    return clean_comments(docs(spark, sf), similarity_threshold=0, config=FIXTURE).select("seq", "text", "source")


@query("first_per_text", "SELECT min(doc_id) AS seq, text FROM documents GROUP BY text")
def first_per_text(spark, sf):
    return D.drop_exact_duplicates(docs(spark, sf)).select("seq", "text")


@query("last_per_text_and_source", sql(LABELLED, """
SELECT seq, text, source, label FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY seq DESC) AS r FROM labelled) WHERE r = 1"""))
def last_per_text_and_source(spark, sf):
    return D.keep_last(labelled_comments(spark, sf), ["text"]).select("seq", "text", "source", "label")


@query("last_per_record_key", sql(COMMENTS, """
SELECT max(seq) AS seq, source || '|text||' || trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS record_key FROM comments GROUP BY 2"""))
def last_per_record_key(spark, sf):
    keyed = K.with_record_key(comments(spark, sf).drop("comment_id"))
    return D.keep_last(keyed, ["record_key"]).select("seq", "record_key")


@query("platform_dedup", """
SELECT min(doc_id) AS seq, count(*) > 0 AS kept FROM documents
GROUP BY CASE WHEN doc_id % 2 = 0 THEN doc_id // 4 END, CASE WHEN doc_id % 2 = 1 THEN lang END, CASE WHEN doc_id % 2 = 1 THEN text END""")
def platform_dedup(spark, sf):
    seq = F.col("doc_id")
    rows = table(spark, sf, "documents").select(
        seq.alias("seq"), "text", F.col("lang").alias("video_id"),
        F.when(seq % 2 == 0, F.floor(seq / 4).cast("string")).otherwise(" ").alias("comment_id"))
    return D.drop_platform_duplicates(rows, ["video_id", "text"]).select("seq", F.lit(True).alias("kept"))


@query("synthetic_ids", """
SELECT min_seq AS seq, 'facebook_' || lang || '_' || source || '_' || row_number() OVER (PARTITION BY lang, source ORDER BY min_seq) AS comment_id
FROM (SELECT lang, source, text, min(doc_id) AS min_seq FROM documents GROUP BY ALL)""")
def synthetic_ids(spark, sf):
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").alias("seq"), "text", F.col("lang").alias("facebook_group_id"), F.col("source").alias("post_id"))
    return D.synthetic_ids(rows).select("seq", "comment_id")


@query("near_duplicate_candidates", f"""
WITH n AS (SELECT doc_id AS id, {NORMAL} AS t FROM documents),
p AS (SELECT id, array_to_string(string_split(t, ' ')[1:2], ' ') AS prefix, length(t) // 20 AS bucket FROM n WHERE t <> '')
SELECT a.prefix, count(*) AS n_pairs FROM p a JOIN p b ON a.prefix = b.prefix AND a.id < b.id AND abs(a.bucket - b.bucket) <= 1
GROUP BY a.prefix""")
def near_duplicate_candidates(spark, sf):
    return ND.candidate_counts(docs(spark, sf)).select("prefix", "n_pairs")


def _rows(block):
    return f"rows_of AS (SELECT doc_id AS id, {block} AS block, {NORMAL} AS t FROM documents),"


@query("near_duplicates_removed", f"""
WITH RECURSIVE {_rows("NULL")} {sql_kept("rows_of", 95)}
SELECT seq, source, text FROM kept JOIN documents ON doc_id = seq""")
def near_duplicates_removed(spark, sf):
    return ND.drop_near_duplicates(docs(spark, sf), 95).select("seq", "source", "text")


@query("near_duplicates_removed_per_source", f"""
WITH RECURSIVE {_rows("source")} {sql_kept("rows_of", 90)}
SELECT seq, source, text FROM kept JOIN documents ON doc_id = seq""")
def near_duplicates_removed_per_source(spark, sf):
    return ND.drop_near_duplicates(docs(spark, sf), 90, ["source"]).select("seq", "source", "text")


@query("near_duplicates_of_one_opening", f"""
WITH RECURSIVE said AS (SELECT conv_id * 1000 + turn AS id, 'Breaking news: ' || coalesce(text, '') AS text FROM conversations),
rows_of AS (SELECT id, NULL AS block, {NORMAL} AS t FROM said), {sql_kept("rows_of", 70)}
SELECT seq FROM kept""")
def near_duplicates_of_one_opening(spark, sf):
    """All messages behind the same two words, so that all are one block and its large windows go by fine lists."""
    said = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.concat(F.lit("Breaking news: "), F.coalesce("text", F.lit(""))).alias("text"))
    return ND.drop_near_duplicates(said, 70, frontier=16).select("seq")


# With threshold 100 a pair matches exactly when one token set holds the other,
# which SQL can say; the greedy choice is a walk in row order per block.
@query("contained_duplicates_removed", f"""
WITH RECURSIVE n AS (SELECT doc_id AS id, {NORMAL} AS t FROM documents),
p AS MATERIALIZED (SELECT id, array_to_string(string_split(t, ' ')[1:2], ' ') AS prefix, length(t) // 20 AS bucket,
   list_distinct(string_split(t, ' ')) AS tok FROM n WHERE t <> ''),
e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.prefix = b.prefix AND a.id < b.id
   AND abs(a.bucket - b.bucket) <= 1 AND (list_has_all(a.tok, b.tok) OR list_has_all(b.tok, a.tok))),
r AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS k FROM p),
near AS MATERIALIZED (SELECT r.k, r.id, coalesce(list(e.a) FILTER (e.a IS NOT NULL), []) AS before
   FROM r LEFT JOIN e ON e.b = r.id GROUP BY r.k, r.id),
walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS kept
   UNION ALL SELECT w.k + 1, CASE WHEN list_has_any(w.kept, near.before) THEN w.kept ELSE list_append(w.kept, near.id) END
   FROM walk w JOIN near ON near.k = w.k + 1)
SELECT unnest(kept) AS seq FROM (SELECT kept FROM walk ORDER BY k DESC LIMIT 1)""")
def contained_duplicates_removed(spark, sf):
    return ND.drop_near_duplicates(docs(spark, sf), 100).select("seq")


_CLEAN_ROWS = f"""
unique_rows AS MATERIALIZED (SELECT min(c.seq) AS id, c.t AS text, d.source AS block FROM cleaned c JOIN documents d ON d.doc_id = c.seq
  WHERE length(c.t) >= 5 GROUP BY c.t, d.source),"""


@query("cleaned_and_deduplicated", f"""
WITH RECURSIVE {CLEANED}, {_CLEAN_ROWS} rows_of AS (SELECT id, block, {NORMAL} AS t FROM unique_rows), {sql_kept("rows_of", 95)}
SELECT seq, block AS source, text FROM kept JOIN unique_rows ON id = seq""")
def cleaned_and_deduplicated(spark, sf):
    return clean_comments(docs(spark, sf), config=FIXTURE).select("seq", "source", "text")


@query("cleaning_audit", sql(CLEANED, """,
x AS (SELECT c.t, d.source, d.lang = 'es' AS missing FROM cleaned c JOIN documents d ON d.doc_id = c.seq),
m AS (SELECT count(*) AS n, count(*) FILTER (missing) AS nulls, count(*) FILTER (NOT missing AND length(t) < 200) AS short,
   count(DISTINCT t) FILTER (NOT missing AND length(t) >= 200) AS kept FROM x)
SELECT unnest(['null_text', 'too_short', 'exact_duplicate', 'near_duplicate', 'kept']) AS outcome,
  unnest([nulls, short, n - nulls - short - kept, 0, kept])::BIGINT AS n FROM m""").replace("\n,\n", ",\n"))
def audit(spark, sf):
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").alias("seq"), "source", F.when(F.col("lang") != "es", F.col("text")).alias("text"))
    return cleaning_audit(rows, min_length=200, duplicate_subset=["text"], config=FIXTURE)


@query("cleaning_audit_with_near_duplicates", f"""
WITH RECURSIVE {CLEANED}, {_CLEAN_ROWS} rows_of AS (SELECT id, NULL AS block, {NORMAL} AS t FROM unique_rows), {sql_kept("rows_of", 95)},
m AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM cleaned WHERE length(t) < 5) AS short,
  (SELECT count(*) FROM unique_rows) AS uniq, (SELECT count(*) FROM kept) AS kept)
SELECT unnest(['null_text', 'too_short', 'exact_duplicate', 'near_duplicate', 'kept']) AS outcome,
  unnest([0, short, n - short - uniq, uniq - kept, kept])::BIGINT AS n FROM m""")
def audit_near(spark, sf):
    return cleaning_audit(docs(spark, sf), 95, similarity_group=[], config=FIXTURE)


@query("pending_without_labelled", sql(COMMENTS, """
SELECT seq, source || '|comment|' || comment_id AS record_key FROM comments WHERE label IS NULL"""))
def pending_without_labelled(spark, sf):
    keyed = K.with_record_key(comments(spark, sf))
    return D.anti_join_keys(keyed, keyed.filter(F.col("label").isNotNull())).select("seq", "record_key")


@query("lexicon_join", sql(SCORED_ALL, "SELECT seq, len(w) AS hits, list_sum(w)::BIGINT AS weight FROM scored WHERE len(w) > 0"))
def lexicon_join(spark, sf):
    lexicon = spark.createDataFrame(list(FIXTURE.lexicon.items()), "term string, weight int")
    return W.lexicon_lookup(docs(spark, sf), lexicon, FIXTURE)


@query("lexicon_join_salted", sql(SCORED_ALL, "SELECT seq, len(w) AS hits, list_sum(w)::BIGINT AS weight FROM scored WHERE len(w) > 0"))
def lexicon_join_salted(spark, sf):
    """The way of a lexicon too large to broadcast."""
    lexicon = spark.createDataFrame(list(FIXTURE.lexicon.items()), "term string, weight int")
    return W.lexicon_lookup(docs(spark, sf), lexicon, FIXTURE, broadcast_entries=0)


# ---- limits, caps, numbering, samples --------------------------------------
@query("first_rows", "SELECT doc_id AS seq, source FROM documents ORDER BY doc_id LIMIT 37")
def first_rows(spark, sf):
    return D.first_rows(docs(spark, sf), 37).select("seq", "source")


@query("capped_per_conversation", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r <= 3")
def capped_per_conversation(spark, sf):
    return D.cap_per_group(table(spark, sf, "conversations"), ["conv_id"], 3, ["turn"]).select("conv_id", "turn", "role")


@query("capped_per_event_type_in_shards", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) WHERE r <= 1500")
def capped_per_event_type_in_shards(spark, sf):
    return D.cap_per_group(table(spark, sf, "events"), ["event_type"], 1500, ["event_id"]).select("event_type", "event_id")


@query("batches_per_source", """
SELECT seq, source, (n - 1) // 25 AS batch_id, CAST((n - 1) % 25 AS INTEGER) AS pos FROM (
  SELECT doc_id AS seq, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)""")
def batches_per_source(spark, sf):
    return D.number_batches(docs(spark, sf).select("seq", "source"), 25, ["source"]).select("seq", "source", "batch_id", "pos")


@query("batches", """
SELECT event_id, (n - 1) // 25 AS batch_id, CAST((n - 1) % 25 AS INTEGER) AS pos FROM (
  SELECT event_id, row_number() OVER (ORDER BY event_id) AS n FROM events)""")
def batches(spark, sf):
    rows = table(spark, sf, "events").select("event_id")
    numbered = D.number_within(rows, [], "event_id", "n")
    return numbered.select("event_id", F.floor((F.col("n") - 1) / 25).alias("batch_id"),
                           F.pmod(F.col("n") - 1, F.lit(25)).cast("int").alias("pos"))


@query("seeded_sample", "SELECT doc_id AS seq, source FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 50")
def seeded_sample(spark, sf):
    return D.stable_sample(docs(spark, sf), 50).select("seq", "source")


@query("seeded_sample_of_a_third", "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY md5('7|' || (l_orderkey * 10 + l_linenumber)), 1, 2 LIMIT 20000")
def seeded_sample_of_a_third(spark, sf):
    """More rows than one task should put in order."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return D.stable_sample(rows, 20_000, 7).select("l_orderkey", "l_linenumber")


@query("first_rows_by_time", "SELECT event_id FROM events ORDER BY ts, event_id LIMIT 2500")
def first_rows_by_time(spark, sf):
    """By a time that events share, then by their id."""
    rows = table(spark, sf, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return smallest(rows, 2500, [F.col("t"), F.col("event_id")]).select("event_id")


@query("numbers_of_null_and_hashed_order", """
SELECT event_id, n <= 3000 AS early FROM (
  SELECT event_id, row_number() OVER (ORDER BY o NULLS FIRST) AS n FROM (
    SELECT event_id, CASE WHEN event_id <> 7 THEN ('0x' || left(md5(event_id::VARCHAR), 15))::BIGINT END AS o FROM events))""")
def numbers_of_null_and_hashed_order(spark, sf):
    """Numbering by sparse values, one of them null."""
    hashed = F.conv(F.left(F.md5(F.col("event_id").cast("string")), F.lit(15)), 16, 10).cast("long")
    rows = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") != 7, hashed).alias("o"))
    return D.number_within(rows, [], "o", "n").select("event_id", (F.col("n") <= 3000).alias("early"))


@query("first_rows_beyond_top_k", "SELECT event_id FROM events ORDER BY event_id LIMIT 10001")
def first_rows_beyond_top_k(spark, sf):
    return D.first_rows(table(spark, sf, "events").select("event_id"), 10_001, "event_id")


@query("first_rows_as_top_k", "SELECT event_id FROM events ORDER BY event_id LIMIT 10000")
def first_rows_as_top_k(spark, sf):
    return D.first_rows(table(spark, sf, "events").select("event_id"), 10_000, "event_id")
