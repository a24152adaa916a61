"""One query per operator, over its whole table; SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import chat_threads, code_compression, decontamination, fingerprints, merkle_manifest, quality, sampled_pieces, secret_scan, simhash, substring_dedup, token_counts, toxicity, trie_bpe

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Where a public vocabulary lies on this machine; executors have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


@query("op1_substring_dedup", r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x09-\x0D ]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, len(w) AS n, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM s),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM g),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM r WHERE k > 1),
y AS (SELECT doc_id, list(i) AS gone FROM x GROUP BY doc_id),
z AS (SELECT d.doc_id, w, coalesce(gone, []::BIGINT[]) AS gone FROM d LEFT JOIN y ON d.doc_id = y.doc_id)
SELECT doc_id, len(w) AS n_words, len(gone) AS n_removed,
       sha256(array_to_string(list_filter(w, lambda v, i: NOT list_contains(gone, i)), ' ')) AS kept_sha256 FROM z
""")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op2_decontamination", r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x09-\x0D ]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x09-\x0D ]+'), lambda w: w <> '') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
bw AS (SELECT item_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS t FROM b),
m AS (SELECT doc_id, item_id, n, i - t AS shift, t FROM dw JOIN bw USING (word)),
c AS (SELECT doc_id, item_id, n, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY t RANGE BETWEEN 12 PRECEDING AND CURRENT ROW) AS k FROM m),
f AS (SELECT DISTINCT doc_id, item_id FROM c WHERE k >= ceil(0.8 * least(n, 13))),
g AS (SELECT doc_id, count(*) AS n_items, list_sort(list(item_id)) AS item_ids FROM f GROUP BY doc_id)
SELECT documents.doc_id, g.doc_id IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(item_ids, []::BIGINT[]) AS item_ids
FROM documents LEFT JOIN g ON documents.doc_id = g.doc_id
""")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return decontamination.contaminated_documents(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op3_token_counts")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf, "documents"), tokenizer("byte_bpe_50k.json"))


@query("op4_fingerprints")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.fingerprints_of_versions(table(spark, sf, "documents"))


@query("op5_toxicity")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf, "labels")))


@query("op6_simhash")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicate_components(table(spark, sf, "documents"))
    return found.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


_LINE = "trim(regexp_replace(lower(x), '[^\\p{L}\\p{N}]+', ' ', 'g'))"


@query("op7_chat_threads", r"""
SELECT conv_id, turn, role, regexp_replace(regexp_replace(coalesce(text, ''), '^\s+', ''), '\s+$', '') AS text,
       0::BIGINT AS n_quoted, NULL::BIGINT AS reply_to, turn AS root, 0::BIGINT AS depth
FROM conversations
""")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return chat_threads.threaded_messages(table(spark, sf, "conversations"))


@query("requoted_threads", rf"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text,
             lag(coalesce(text, '')) OVER w AS one, lag(coalesce(text, ''), 2) OVER w AS two FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
l AS (SELECT *, len(list_filter(string_split(one, chr(10)), lambda x: length({_LINE}) >= 8)) > 0 AS says_one,
             len(list_filter(string_split(two, chr(10)), lambda x: length({_LINE}) >= 8)) > 0 AS says_two FROM c)
SELECT conv_id, turn, role, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS text,
       coalesce(len(string_split(one, chr(10))) + 1, 0) + coalesce(len(string_split(two, chr(10))), 0) AS n_quoted,
       CASE WHEN says_one THEN turn - 1 WHEN says_two THEN turn - 2 END AS reply_to
FROM l
""")
def requoted_threads(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations written as mail, each message over the two before it, and read back."""
    turns = Window.partitionBy("conv_id").orderBy("turn")
    text = F.coalesce("text", F.lit(""))
    said = table(spark, sf, "conversations").select("conv_id", "turn", "role", text.alias("text"), F.lag(text).over(turns).alias("one"), F.lag(text, 2).over(turns).alias("two"))

    def quoted(value: str, mark: str) -> Column:
        return F.concat(F.lit(mark), F.regexp_replace(value, "\n", "\n" + mark))

    mail = F.concat_ws("\n", F.when(F.col("one").isNotNull(), F.lit("Somebody wrote:")), quoted("two", "> > "), quoted("one", "> "), F.lit(""), "text")
    found = chat_threads.threaded_messages(said.select("conv_id", "turn", "role", mail.alias("text")))
    return found.select("conv_id", "turn", "role", "text", "n_quoted", "reply_to")


@query("op8_quality")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf, "labels")))


@query("op9_secrets")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = secret_scan.scan_secrets(docs, secret_scan.fit_markov(docs))

    def spelt(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select(
        "doc_id", *(of(k).alias(f"n_{k}") for k in ("assign", "access", "hex", "markov")),
        F.sha2(spelt(base).cast("binary"), 256).alias("base_sha256"), spelt(F.col("spans")).alias("spans"))


@query("op10_sampled_pieces")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return sampled_pieces.sample_rows(table(spark, sf, "documents"), tokenizer("piece_bpe_32k.model"))


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Full Lloyd rounds, one after the other."""
    steps = [f"""
v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, j, q[j * (len(q) // {parts}) + 1:(j + 1) * (len(q) // {parts})] AS x FROM v, range({parts}) r(j)),
c0 AS MATERIALIZED (SELECT j, row_number() OVER (PARTITION BY j ORDER BY vec_id) - 1 AS k, x AS c FROM p QUALIFY k < {entries})"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT vec_id, label, j, x, k, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
  FROM p JOIN c{r} USING (j) QUALIFY row_number() OVER (PARTITION BY vec_id, j ORDER BY d, k) = 1)""")
        if r < rounds:
            steps.append(f"""
u{r} AS (SELECT j, k, unnest(x) AS y, generate_subscripts(x, 1) AS t FROM a{r}),
m{r} AS (SELECT j, k, t, floor(sum(y) / count(*))::BIGINT AS y FROM u{r} GROUP BY ALL),
n{r} AS (SELECT j, k, list(y ORDER BY t) AS c FROM m{r} GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT j, k, coalesce(n{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN n{r} USING (j, k))""")
    return f"""
WITH {",".join(steps)},
e AS (SELECT vec_id, label, array_to_string(list(printf('%02x', k) ORDER BY j), '') AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY ALL),
s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY j, k)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM e, s
"""


@query("op11_vector_codes", _codes_sql())
def op11(spark: SparkSession, sf: str) -> DataFrame:
    found = code_compression.compress(table(spark, sf, "embeddings"))
    rows = code_compression.label_errors(found.rows)
    books = F.lit(found.codebooks.sha256() if found.codebooks else None).cast("string")
    return rows.select(F.col("id").alias("vec_id"), F.lower(F.hex("codes")).alias("code"), "error", "label_error", books.alias("codebooks_sha256"))


def _manifest_sql(tiers: int = 7) -> str:
    """The tree level by level, for up to 8 ** tiers rows of a language and as many languages."""

    def levels(tree: str, leaves: str, members: str, group: str) -> str:
        # h: nodes by level; r: runs by level; f: what a member's altered leaf folds to, and its siblings so far
        steps = [f"{tree}h0 AS ({leaves}), {tree}f0 AS ({members})"]
        for k in range(tiers):
            run = f"{group}, i // 8 AS i, n"
            one = f"{tree}f{k}.i % 8 + 1"
            steps.append(f"""
{tree}r{k} AS (SELECT {run}, list(h ORDER BY i) AS hs FROM {tree}h{k} GROUP BY ALL),
{tree}h{k + 1} AS (SELECT {group}, i, CASE WHEN n = 1 THEN 1 ELSE (n + 7) // 8 END AS n,
  CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {tree}r{k}),
{tree}f{k + 1} AS (SELECT doc_id, leaf, {tree}f{k}.lang, {tree}f{k}.g, {tree}f{k}.i // 8 AS i, CASE WHEN n = 1 THEN x ELSE sha256(array_to_string(hs[:{one} - 1] || [x] || hs[{one} + 1:], '')) END AS x,
  CASE WHEN n = 1 THEN s ELSE s || array_to_string(hs[:{one} - 1] || hs[{one} + 1:], '') END AS s
  FROM {tree}f{k} JOIN {tree}r{k} ON {tree}f{k}.{group} IS NOT DISTINCT FROM {tree}r{k}.{group} AND {tree}f{k}.i // 8 = {tree}r{k}.i)""")
        return ",".join(steps)

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(strlen(({f})::VARCHAR) || ':' || ({f}), '-')" for f in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    lower = "CASE WHEN crc(doc_id::VARCHAR) % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"
    crc_step = "list_reduce(range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384), {})"
    crc = f"""xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda z: ascii(z)::BIGINT),
      lambda c, b: xor(c >> 8, {crc_step.format("xor(c, b) & 255")}), 4294967295), 4294967295)"""
    return f"""
WITH d AS (SELECT doc_id, lang, {leaf("text")} AS leaf, {leaf(lower.replace("crc(doc_id::VARCHAR)", crc))} AS x,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents),
{levels("a", "SELECT lang, i, n, leaf AS h FROM d", "SELECT doc_id, leaf, lang, 0 AS g, i, x, '' AS s FROM d", "lang")},
t AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n, 0 AS g FROM ah{tiers}),
{levels("b", "SELECT g, i, n, h FROM t", f"SELECT doc_id, leaf, af{tiers}.lang, t.g, t.i, x, s FROM af{tiers} JOIN t ON af{tiers}.lang IS NOT DISTINCT FROM t.lang", "g")}
SELECT doc_id, leaf, ah{tiers}.h AS subroot, bh{tiers}.h AS root, sha256(s) AS proof_sha256, x AS folded_root, x = bh{tiers}.h AS verified
FROM bf{tiers} JOIN ah{tiers} ON bf{tiers}.lang IS NOT DISTINCT FROM ah{tiers}.lang, bh{tiers}
"""


@query("op12_merkle_manifest", _manifest_sql())
def op12(spark: SparkSession, sf: str) -> DataFrame:
    """Every third document or so is checked with its text's capitals lost."""
    docs = table(spark, sf, "documents")
    lost = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = merkle_manifest.manifest(docs, altered={"text": F.when(lost, lower).otherwise(F.col("text"))})
    return merkle_manifest.verified(found).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query("op13_trie_bpe")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return trie_bpe.round_trip(table(spark, sf, "documents"), tokenizer("byte_bpe_50k.json"))
