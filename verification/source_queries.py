"""Sources, sinks, row predicates."""

from pyspark.sql import functions as F

from murmurlens.config import LABELS
from murmurlens.functions import predicates as P
from murmurlens.functions.cleaning import strip
from murmurlens.operators import dedup
from murmurlens.operators.review import review_columns
from murmurlens.plans import ingest
from murmurlens.session import staging_path
from murmurlens.sources import comments as C, corpus, split_csv, store, threads
from verification.registry import (
    COMMENTS, FIXTURE, LABELLED, comments, labelled_comments, query, quoted, sql, sql_strip, table,
)


@query("platform_scan", f"""
SELECT doc_id AS seq, {sql_strip('text')} AS text,
       CASE WHEN doc_id % 5 = 0 THEN 'youtube' ELSE source END AS source,
       CAST(NULL AS VARCHAR) AS label, 'collected' AS split, CAST(NULL AS VARCHAR) AS published_at
FROM documents WHERE length({sql_strip('text')}) > 0""")
def platform_scan(spark, sf):
    raw = table(spark, sf, "documents").select(
        F.col("doc_id").alias("seq"), "text",
        F.when(F.col("doc_id") % 10 == 0, "").when(F.col("doc_id") % 5 == 0, F.lit(None)).otherwise(F.col("source")).alias("source"),
    )
    return C.normalise_platform(raw, "youtube").select("seq", "text", "source", "label", "split", "published_at")


@query("csv_source", f"""
SELECT CAST(doc_id AS VARCHAR) AS comment_id, {sql_strip('text')} AS text, source, 'collected' AS split
FROM documents WHERE length({sql_strip('text')}) > 0""")
def csv_source(spark, sf):
    path = staging_path(spark, "csv")
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("comment_id"), "text", "source")
    C.csv_options(docs.write).csv(path)
    return C.scan_platform(spark, path, "youtube").select("comment_id", "text", "source", "split")


_SAID = """'say "yes, ' || text"""


@query("csv_read_in_ranges", f"""
SELECT CAST(doc_id AS VARCHAR) AS comment_id, {sql_strip(_SAID)} AS text, source, 'collected' AS split FROM documents""")
def csv_read_in_ranges(spark, sf):
    """Files with quotes, commas and line breaks in their fields, each read by as many tasks as it has ranges."""
    path = staging_path(spark, "csv")
    said = F.concat(F.lit('say "yes, '), F.col("text"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("comment_id"), said.alias("text"), "source")
    C.csv_options(docs.write).csv(path)
    return C.normalise_platform(split_csv.read_split_csv(spark, path), "youtube").select("comment_id", "text", "source", "split")


@query("source_union", """
SELECT doc_id AS seq, text, lang, source, CAST(NULL AS VARCHAR) AS role FROM documents
UNION ALL BY NAME
SELECT conv_id * 1000 + turn AS seq, text, CAST(NULL AS VARCHAR) AS lang, 'chat' AS source, role FROM conversations""")
def source_union(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), "text", "lang", "source")
    chats = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "text", F.lit("chat").alias("source"), "role")
    return C.union_sources([docs, chats])


@query("unlabelled_pending", sql(COMMENTS, f"SELECT seq, source FROM comments WHERE label IS NULL OR label NOT IN ({quoted(LABELS)})"))
def unlabelled_pending(spark, sf):
    return C.gather({"collected": comments(spark, sf)})[1].select("seq", "source")


@query("labelled_corpus", f"""
SELECT doc_id AS seq, {sql_strip('d.text')} AS text,
       CASE l.toxic + l.quality WHEN 0 THEN 'CLEAN' WHEN 1 THEN 'OFFENSIVE' ELSE 'HATE' END AS label,
       'vihsd' AS source, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'dev' ELSE 'test' END AS split
FROM documents d JOIN labels l USING (doc_id)
WHERE length({sql_strip('d.text')}) > 0
  AND NOT (doc_id % 3 = 2 AND l.toxic + l.quality = 1 AND doc_id % 2 = 0)""")
def labelled_corpus(spark, sf):
    raw = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
        F.col("doc_id").alias("seq"), "text", (F.col("toxic") + F.col("quality")).alias("code"))
    part = lambda r: raw.filter(F.col("seq") % 3 == r)
    named = F.element_at(F.array(F.lit(" none"), F.lit("Spam"), F.lit("hate ")), F.col("code") + 1)
    odd = F.when((F.col("code") == 1) & (F.col("seq") % 2 == 0), "3").otherwise(F.col("code").cast("string"))
    return corpus.load_corpus({
        "train": part(0).select("seq", F.col("text").alias("free_text"), F.col("code").alias("label_id")),
        "dev": part(1).select("seq", F.col("text").alias("sentence"), named.alias("Label")),
        "test": part(2).select("seq", F.col("text").alias("comment"), odd.alias("class")),
    })


@query("comment_pages", """
SELECT CASE WHEN pos % 2 = 0 THEN 'i' || pos ELSE 't' || pos END AS comment_id,
       CAST(doc_id AS VARCHAR) AS video_id, pos, line AS text, source AS author, length(line) AS like_count,
       CAST('' AS VARCHAR) AS published_at, 'youtube' AS source
FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
             unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents)""")
def comment_pages(spark, sf):
    lines = F.split("text", "\n")

    def item(line, pos):
        top_id = F.when(pos % 2 == 1, F.concat(F.lit("t"), pos.cast("string")))
        body = F.struct(line.alias("textDisplay"), F.col("source").alias("authorDisplayName"),
                        F.length(line).alias("likeCount"))
        top = F.struct(top_id.alias("id"), body.alias("snippet"))
        return F.struct(F.concat(F.lit("i"), pos.cast("string")).alias("id"),
                        F.struct(top.alias("topLevelComment")).alias("snippet"))

    pages = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("video_id"),
        F.to_json(F.struct(F.transform(lines, item).alias("items"))).alias("json"))
    return threads.flatten_comment_pages(pages)


_TREE_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                  unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents),
     c AS (SELECT doc_id, i, unnest(string_split(line, '. ')) AS part,
                  unnest(range(0, len(string_split(line, '. ')))) AS j FROM l WHERE line <> '' AND i % 7 <> 3),
     w AS (SELECT doc_id, i, j, unnest(string_split(part, ', ')) AS bit,
                  unnest(range(0, len(string_split(part, ', ')))) AS k FROM c WHERE part <> ''),
     seg AS (
       SELECT doc_id, 0 AS depth, chr((96 + length(i::VARCHAR))::INTEGER) || i AS path, line AS text, i % 7 AS m FROM l WHERE line <> '' AND i % 7 <> 3
       UNION ALL SELECT doc_id, 1, chr((96 + length(i::VARCHAR))::INTEGER) || i || chr((96 + length(j::VARCHAR))::INTEGER) || j, part, 0 FROM c WHERE part <> ''
       UNION ALL SELECT doc_id, 2, chr((96 + length(i::VARCHAR))::INTEGER) || i || chr((96 + length(j::VARCHAR))::INTEGER) || j
                        || chr((96 + length(k::VARCHAR))::INTEGER) || k, bit, 0 FROM w WHERE bit <> '')
SELECT CAST(doc_id AS VARCHAR) AS post_id, path, depth, text FROM seg"""


def _trees(spark, sf):
    """Lines as comments, sentences as replies, clauses as replies to those."""

    def node(body, author, replies):
        data = F.struct(body.alias("body"), author.alias("author"), replies.alias("replies"))
        return F.struct(F.lit("t1").alias("kind"), data.alias("data"))

    def listing(children):
        return F.struct(F.struct(children.alias("children")).alias("data"))

    leaf = lambda b: node(b, F.lit("ann"), F.lit(""))
    sentence = lambda s: node(s, F.lit("bob"), listing(F.transform(F.split(s, ", "), leaf)))
    line = lambda t, i: node(t, F.when(i % 7 == 3, "AutoModerator").otherwise("cy"),
                             listing(F.transform(F.split(t, r"\. "), sentence)))
    top = F.to_json(listing(F.transform(F.split("text", "\n"), line)))
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("post_id"), F.concat(F.lit("[{},"), top, F.lit("]")).alias("json"))


@query("reply_trees", _TREE_SQL)
def reply_trees(spark, sf):
    return threads.flatten_reply_trees(_trees(spark, sf)).select("post_id", "path", "depth", "text")


@query("threads_ingest", f"""
WITH t AS ({_TREE_SQL}), c AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY path) AS k FROM t),
d AS (SELECT *, row_number() OVER (PARTITION BY post_id, text ORDER BY path) AS r FROM c WHERE k <= 20)
SELECT post_id, path, d.text, left(documents.text, 80) AS post_title
FROM d JOIN documents ON CAST(doc_id AS VARCHAR) = post_id WHERE r = 1 AND length(d.text) >= 5""")
def threads_ingest(spark, sf):
    posts = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("post_id"), F.left("text", F.lit(80)).alias("post_title"))
    found = ingest.ingest_threads(_trees(spark, sf), posts, 20, accept=None)
    return found.select("post_id", "path", "text", "post_title")

def _listings(spark, sf):
    child = F.struct(
        F.when(F.col("page_id") % 5 == 0, "t5").otherwise("t3").alias("kind"),
        F.struct(F.col("page_id").cast("string").alias("id"), F.col("html").alias("title"),
                 (F.col("page_id") % 3).alias("num_comments")).alias("data"))
    return table(spark, sf, "pages").select(
        F.to_json(F.struct(F.struct(F.array(child).alias("children")).alias("data"))).alias("json"))


@query("post_listing", """
SELECT CAST(page_id AS VARCHAR) AS post_id, left(html, 80) AS post_title FROM pages
WHERE page_id % 5 <> 0 AND page_id % 3 <> 0""")
def post_listing(spark, sf):
    return threads.flatten_post_listing(_listings(spark, sf))


@query("titled_comments", """
SELECT c.conv_id, c.turn, CAST(c.conv_id AS VARCHAR) AS post_id, left(p.html, 80) AS post_title
FROM conversations c JOIN pages p ON p.page_id = c.conv_id WHERE p.page_id % 5 <> 0 AND p.page_id % 3 <> 0""")
def titled_comments(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.col("conv_id").cast("string").alias("post_id"))
    return threads.attach_titles(rows, threads.flatten_post_listing(_listings(spark, sf))).select(
        "conv_id", "turn", "post_id", "post_title")


@query("append_latest", """
SELECT seq, age, source, text FROM (
  SELECT *, row_number() OVER (PARTITION BY source, text ORDER BY age DESC, seq DESC) AS r FROM (
    SELECT doc_id AS seq, 0 AS age, source, text FROM documents
    UNION ALL SELECT doc_id, 1, source, text FROM documents WHERE lang = 'en'))
WHERE r = 1""")
def append_latest(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), "source", "text", "lang")
    old = docs.withColumn("age", F.lit(0))
    new = docs.filter("lang = 'en'").withColumn("age", F.lit(1))
    return dedup.append_latest(old, new, ["source", "text"]).select("seq", "age", "source", "text")


@query("result_rows", sql(LABELLED, "SELECT text, label, source FROM labelled"))
def result_rows(spark, sf):
    path = staging_path(spark, "results")
    C.write_results(labelled_comments(spark, sf), path)
    return spark.read.parquet(path)


@query("stored_labels", sql(LABELLED, """SELECT source || '|comment|' || comment_id AS record_key,
  CASE WHEN lang = 'en' THEN 'HATE' ELSE label END AS label FROM labelled"""))
def stored_labels(spark, sf):
    """Two versions of the store; the later label wins."""
    labels = store.LabelStore(spark, staging_path(spark, "store"))
    rows = store.backfill_store(labelled_comments(spark, sf))
    labels.append(rows, 1)
    labels.append(rows.filter("lang = 'en'").withColumn("label", F.lit("HATE")), 2)
    return labels.read().select("record_key", "label")


@query("compacted_store", sql(LABELLED, "SELECT source || '|comment|' || comment_id AS record_key, label FROM labelled"))
def compacted_store(spark, sf):
    labels = store.LabelStore(spark, staging_path(spark, "store"))
    rows = store.backfill_store(labelled_comments(spark, sf))
    labels.append(rows.filter("lang = 'en'").withColumn("label", F.lit("CLEAN")), 1)
    labels.append(rows, 2)
    return labels.compact_to(staging_path(spark, "compacted")).read().select("record_key", "label")


# ---- predicates ------------------------------------------------------------
@query("stripped_texts", f"SELECT doc_id AS seq, {sql_strip('text')} AS text FROM documents WHERE length({sql_strip('text')}) > 0")
def stripped_texts(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), strip(F.col("text")).alias("text"))
    return docs.filter(F.char_length("text") > 0)


@query("valid_labels", sql(COMMENTS, f"SELECT seq, label FROM comments WHERE label IN ({quoted(LABELS)})"))
def valid_labels(spark, sf):
    return comments(spark, sf).filter(P.has_valid_label(F.col("label"))).select("seq", "label")


@query("unlabelled_rows", sql(COMMENTS, "SELECT seq FROM comments WHERE label IS NULL"))
def unlabelled_rows(spark, sf):
    return comments(spark, sf).filter(P.is_unlabelled(F.col("label"))).select("seq")


@query("selected_sources", "SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src2', 'src5')")
def selected_sources(spark, sf):
    names, _ = C.split_known(["src1", "src2", "src5", "nowhere"], [f"src{i}" for i in range(20)])
    return C.select_sources(table(spark, sf, "documents"), names).select("doc_id", "source")


@query("other_sources", "SELECT doc_id, nullif(source, 'src5') AS source FROM documents WHERE source <> 'src3'")
def other_sources(spark, sf):
    """Without one source; rows that have none stay."""
    rows = table(spark, sf, "documents").withColumn("source", F.nullif("source", F.lit("src5")))
    return C.exclude_source(rows, "src3").select("doc_id", "source")


@query("long_enough", "SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL AND length(text) >= 5")
def long_enough(spark, sf):
    return table(spark, sf, "documents").filter(F.col("text").isNotNull() & (F.char_length("text") >= 5)).select(
        "doc_id", F.char_length("text").alias("n"))


@query("non_null_texts", "SELECT doc_id, CASE WHEN lang <> 'fr' THEN text END AS text FROM documents WHERE lang <> 'fr'")
def non_null_texts(spark, sf):
    masked = table(spark, sf, "documents").select("doc_id", F.when(F.col("lang") != "fr", F.col("text")).alias("text"))
    return masked.filter(F.col("text").isNotNull())


_UI = " AND ".join(f"NOT contains(lower(t), {quoted([p.lower()])})" for p in FIXTURE.ui_phrases)


@query("valid_comments", f"""
SELECT doc_id, i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t,
    unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents)
WHERE length({sql_strip('t')}) >= 5 AND NOT regexp_matches(replace(t, ' ', ''), '^[0-9]+$') AND {_UI}""")
def valid_comments(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t"))
    return lines.filter(P.is_valid_comment(F.col("t"), FIXTURE)).select("doc_id", "i")


@query("posts_ingest", f"""
WITH v AS (SELECT doc_id AS seq, lang AS g, source AS p, {sql_strip('text')} AS t FROM documents),
u AS (SELECT g, p, t, min(seq) AS seq FROM v WHERE length(t) >= 5 AND NOT regexp_matches(replace(t, ' ', ''), '^[0-9]+$') AND {_UI} GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY g, p ORDER BY seq) AS k FROM u),
f AS (SELECT *, row_number() OVER (PARTITION BY p, t ORDER BY seq DESC) AS r FROM n WHERE k <= 30)
SELECT 'facebook_' || g || '_' || p || '_' || k AS comment_id, p AS post_id, seq, 'collected' AS split FROM f WHERE r = 1""")
def posts_ingest(spark, sf):
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").alias("seq"), "text", F.col("lang").alias("facebook_group_id"), F.col("source").alias("post_id"))
    return ingest.ingest_posts(rows, max_comments=30, config=FIXTURE).select("comment_id", "post_id", "seq", "split")


@query("live_comments", "SELECT conv_id, turn, role FROM conversations WHERE text NOT IN ('[deleted]', '[removed]', '') AND role <> 'system'")
def live_comments(spark, sf):
    chats = table(spark, sf, "conversations")
    author = F.when(F.col("role") == "system", "AutoModerator").otherwise(F.col("role"))
    return chats.filter(P.is_live_comment(F.col("text"), author)).select("conv_id", "turn", "role")


@query("vietnamese_like", f"""
WITH t AS (SELECT doc_id, i, lower({sql_strip('line')}) AS t FROM (
       SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
              unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents)),
 x AS (SELECT *, regexp_extract_all(t, '([a-zA-ZÀ-ỹĐđ]+)', 1) AS w, regexp_matches(t, '[{FIXTURE.letters}]') AS d FROM t),
 y AS (SELECT *, len(w) AS n, len(list_filter(w, lambda v: v IN ({quoted(FIXTURE.hint_words)}))) AS h FROM x)
SELECT doc_id, i FROM y WHERE n > 0 AND ((d AND (h >= 1 OR n <= 4)) OR h >= 2 OR (h >= 1 AND h * 1.0 / n >= 0.25))""")
def vietnamese_like(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t"))
    return lines.filter(P.looks_vietnamese(F.col("t"), FIXTURE)).select("doc_id", "i")


@query("review_projection", sql(COMMENTS, """SELECT source || '|comment|' || comment_id AS record_key, label, text, comment_id,
  source, seq, lang FROM comments"""))
def review_projection(spark, sf):
    from murmurlens.functions.keys import with_record_key

    return review_columns(with_record_key(comments(spark, sf)))


@query("toxic_flag", sql(COMMENTS, "SELECT seq, coalesce(label IN ('OFFENSIVE', 'HATE'), false) AS is_toxic FROM comments"))
def toxic_flag(spark, sf):
    return comments(spark, sf).select("seq", P.is_toxic(F.col("label")).alias("is_toxic"))


@query("quota_errors", """
SELECT doc_id, coalesce(contains(m, 'quota exceeded') OR contains(m, 'too many requests')
   OR contains(m, 'resource_exhausted') OR contains(m, 'exceeded your current quota')
   OR contains(m, 'generate_content_free_tier_requests'), false) AS is_quota
FROM (SELECT doc_id, lower(text || CASE doc_id % 4 WHEN 0 THEN ' 429 RESOURCE_EXHAUSTED' WHEN 1 THEN ' Quota Exceeded'
   WHEN 2 THEN ' Too many Requests.' ELSE '' END) AS m FROM documents)""")
def quota_errors(spark, sf):
    tail = F.element_at(F.array(*map(F.lit, (" 429 RESOURCE_EXHAUSTED", " Quota Exceeded", " Too many Requests.", ""))),
                        (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf, "documents").select(
        "doc_id", P.is_quota_error(F.concat("text", tail)).alias("is_quota"))
