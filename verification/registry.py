"""Registered queries with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from murmurlens.config import VIETNAMESE
from murmurlens.functions.cleaning import STRIP_CHARS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# The test tables hold English, French, German and Spanish prose, so scoring
# uses insults that occur there; stop words and letters stay the defaults.
FIXTURE = replace(
    VIETNAMESE,
    lexicon={
        "clown": 2, "loser": 2, "pathetic": 3, "stupid": 3, "trash": 4, "idiot": 5, "moron": 5,
        "disgusting": 5, "worthless": 6, "scum": 8, "of trash": 7, "and clown": 3,
    },
    abbreviations={**VIETNAMESE.abbreviations, "und": "sowie auch", "que": "lo cual", "of": "out from"},
)

LABEL_CASE = (
    "CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.toxic = 0 THEN 'CLEAN' "
    "WHEN l.quality = 1 THEN 'OFFENSIVE' ELSE 'HATE' END"
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def comments(spark: SparkSession, sf: str, time: bool = False) -> DataFrame:
    """``documents`` with labels, and with event times where a query needs them."""
    d, l = table(spark, sf, "documents").alias("d"), table(spark, sf, "labels").alias("l")
    df = d.join(l, F.col("d.doc_id") == F.col("l.doc_id"), "left")
    columns = [
        F.col("d.doc_id").alias("seq"), F.col("d.doc_id").cast("string").alias("comment_id"),
        "d.text", "d.lang", "d.source", F.expr(LABEL_CASE).alias("label"),
    ]
    if time:
        e = table(spark, sf, "events").alias("e")
        df = df.join(e, F.col("e.event_id") == F.col("d.doc_id"), "left")
        columns.append(F.col("e.ts").alias("published_at"))
    return df.select(*columns)


def labelled_comments(spark: SparkSession, sf: str, time: bool = False) -> DataFrame:
    return comments(spark, sf, time).filter(F.col("label").isNotNull())


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# ---- SQL building blocks ---------------------------------------------------
COMMENTS = f"""comments AS (
  SELECT d.doc_id AS seq, CAST(d.doc_id AS VARCHAR) AS comment_id, d.text, d.lang, d.source,
         {LABEL_CASE} AS label, e.ts AS published_at
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
  LEFT JOIN events e ON e.event_id = d.doc_id)"""
LABELLED = f"{COMMENTS}, labelled AS (SELECT * FROM comments WHERE label IS NOT NULL)"


def sql_strip(x: str) -> str:
    return f"trim({x}, '{STRIP_CHARS}')"


def sql_terms(x: str) -> str:
    return (
        f"list_filter(string_split_regex(lower({x}), '\\s+'), lambda t: length(t) >= 2 "
        f"AND regexp_matches(t, '[a-z{FIXTURE.letters}]') AND t NOT IN ({quoted(FIXTURE.stop_words)}))"
    )


def sql_pairs(tokens: str) -> str:
    return (
        f"list_transform(range(1, len({tokens})), lambda i: {tokens}[i] || ' ' || {tokens}[i + 1])"
    )


def sql_map(weights) -> str:
    keys = quoted(weights)
    return f"MAP {{{', '.join(f'{quoted([k])}: {v}' for k, v in weights.items())}}}", keys


_WORD_MAP, _WORD_KEYS = sql_map(FIXTURE.lexicon_words)
_ALL_MAP, _ALL_KEYS = sql_map(FIXTURE.lexicon)

# per row: terms, hit weights, lengths, score and level
SCORED = f"""{LABELLED},
toks AS (SELECT *, {sql_terms('text')} AS tokens FROM labelled),
cand AS (SELECT *, list_concat(tokens, {sql_pairs('tokens')}) AS terms FROM toks),
hits AS (SELECT *, list_transform(list_filter(terms, lambda t: t IN ({_ALL_KEYS})),
           lambda t: {_ALL_MAP}[t]) AS w FROM cand),
raw AS (SELECT *, CASE WHEN len(w) = 0 THEN 0.0
     ELSE round(least(100.0, list_sum(w) * 10.0::DOUBLE / len(w) + len(w) * 5.0::DOUBLE), 2) END AS toxic_score
  FROM hits),
scored AS (SELECT seq, source, text, label, published_at, tokens, w, toxic_score::DOUBLE AS toxic_score,
   CASE WHEN toxic_score = 0 THEN 'KHÔNG TOXIC' WHEN toxic_score < 20 THEN 'TOXIC NHẸ'
        WHEN toxic_score < 50 THEN 'TOXIC TRUNG BÌNH' WHEN toxic_score < 80 THEN 'TOXIC NẶNG'
        ELSE 'CỰC KỲ TOXIC' END AS toxic_level,
   length(text) AS n_chars,
   len(list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '')) AS n_words,
   len(list_filter(tokens, lambda t: t IN ({_WORD_KEYS}))) AS n_toxic_words
 FROM raw)"""
#: The same over all documents, labelled or not.
SCORED_ALL = SCORED.replace("AS tokens FROM labelled)", "AS tokens FROM comments)")


def sql(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"
