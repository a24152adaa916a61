"""Inputs on which an operator once did less than its whole job."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from murmurlens.llm import fingerprints as P, secret_scan as X, substring_dedup as W  # noqa: E402


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


# ---- 4: fingerprints --------------------------------------------------------------
def near_equal_pairs():
    """Texts and slightly changed ones: longer across 128 and 1,024 characters, and one word put in early."""
    rng = random.Random(21)

    def sentence(n):
        words = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(2, 9))) for _ in range(n)]
        return " ".join(words)[:n]

    pairs = []
    for n, more in ((120, 12), (1010, 20)):
        pairs += [(f"longer at {n}", t, t + " " + sentence(more)) for t in (sentence(n) for _ in range(40))]
    pairs += [("early word", t, t[:20] + " inserted " + t[20:]) for t in (sentence(rng.randrange(1200, 3000)) for _ in range(40))]
    pairs += [("without spaces", t, "#" + t[:7] + "x" + t[7:]) for t in ("".join(rng.choice("天地人日月山水火木金土") for _ in range(600)) for _ in range(20))]
    return pairs


def test_near_equal_texts_share_digests_at_any_length(spark):
    pairs = near_equal_pairs()
    df = spark.createDataFrame(pairs, "kind string, a string, b string")
    a, b = P.content_digests(F.col("a")), P.content_digests(F.col("b"))
    df = df.select("kind", (F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).alias("likeness"))
    got = {r.kind: r for r in df.groupBy("kind").agg(F.min("likeness").alias("least"), F.median("likeness").alias("mid")).collect()}
    assert got["longer at 1010"].least > 0.8 and got["early word"].least > 0.8 and got["without spaces"].least > 0.7
    assert got["longer at 120"].mid > 0.6


def test_content_digests_depend_on_the_text_alone(spark):
    rows = [(0, ""), (1, "a"), (2, "a\x01"), (3, "a\x01\x03"), (4, "a\x03"), (5, "a\x01\x02"), (6, " \n "), (7, "a"), (8, None)]
    got = {r.doc_id: r.d for r in documents(spark, rows).select("doc_id", P.content_digests(F.coalesce("text", F.lit(""))).alias("d")).collect()}
    assert got[0] == got[8] == [] and got[1] == got[7] and got[6]
    assert len({tuple(got[i]) for i in range(7)}) == 7


def test_op4_takes_the_likeness_of_content_digests(spark):
    from murmurlens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    order = docs.orderBy("doc_id").select("doc_id", "text", P.content_digests(F.col("text")).alias("d")).collect()
    want = {}
    for k, r in enumerate(order):
        a, b = set(r.d), set(order[(k + 1) % len(order)].d)
        want[r.doc_id] = len(a & b) / len(a | b)
    got = QUERIES["op4_fingerprints"](spark, sf).collect()
    assert len(got) == len(want) and all(r.near_next == pytest.approx(want[r.doc_id]) for r in got)


def test_op4_shuffles_the_texts_once(spark):
    docs = documents(spark, [(i, f"text {i} of many words, and again {i}") for i in range(60)] + [(None, "no id"), (5, "text 5 of many words, and again 5")])
    df = P.fingerprints_of_versions(docs)
    assert len(df.collect()) == 62
    plan = df._jdf.queryExecution().executedPlan().toString()
    # one reading of the texts is the other's exchange
    assert "ReusedExchange" in plan


# ---- 1: substring dedup -------------------------------------------------------
def texts_of_equal_hash_starts(n):
    """Different texts of 21 to 40 words, some of which agree in the first 24 bits of Spark's hash."""
    rng = random.Random(31)
    texts = [" ".join(f"w{rng.getrandbits(40):x}" for _ in range(rng.randrange(21, 41))) for _ in range(n)]
    by_start = {}
    for t in texts:
        by_start.setdefault(xxhash.xxh64_intdigest(t.encode(), seed=42) >> 40, []).append(t)
    return texts, [ts for ts in by_start.values() if len(ts) > 1]


def test_many_texts_under_a_null_id_stay_apart(spark):
    texts, colliding = texts_of_equal_hash_starts(12000)
    assert colliding
    # a colliding text of which an id before it has a copy takes its partner along, if they share a key
    copied, partner = colliding[0][:2]
    rows = [(None, t) for t in texts] + [(1, copied)]
    got = W.remove_repeats(documents(spark, rows)).collect()
    want = sorted([(-1, len(t.split()), *((len(t.split()), "") if t == copied else (0, t))) for t in texts] + [(1, len(copied.split()), 0, copied)])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == want
    assert any(r.kept == partner for r in got)


# ---- 9: secret scans ------------------------------------------------------------------------
def test_markov_models_count_all_documents(spark):
    # a style that only documents without id use, and more documents than a sample had
    rows = [(i, "alpha beta gamma") for i in range(2500)] + [(None, "zqxj9kvw7 " * 3)]
    docs = documents(spark, rows)
    model = X.fit_markov(docs)
    words = ["alpha", "beta", "gamma"] * 2500 + ["zqxj9kvw7"] * 3
    want = X.MarkovPair.fit(X.transitions(X.random_strings(0)), X.transitions(words), 20, 0.9)
    # edges between slices count once more; inner transitions are the same
    inner = slice(2, None)
    assert np.allclose(model.ratio[inner, inner], want.ratio[inner, inner], atol=0.01)


def test_letters_alone_and_parts_beside_patterns_are_scored(spark):
    rng = random.Random(12)
    ordinary = [(i, " ".join("".join(rng.choice(["ma", "to", "re", "li", "con", "ter"]) for _ in range(rng.randrange(1, 9))) for _ in range(60))) for i in range(60)]
    letters, left, digits, right = "qXZbRvkLwJKtPfNcYVmGxsDW", "qX7bR2kLw9Z", "0123456789abcdef01234567", "P4vNZY8WJ1sD"
    rows = ordinary + [(100, f"take {letters} home"), (101, f"take {left}{digits}{right} home"), (102, f"{'conter' * 4}/{digits}")]
    docs = documents(spark, rows)
    model = X.fit_markov(docs)
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in X.scan_secrets(docs, model).collect()}
    assert got[100] == [(5, 29, "markov")]
    assert got[101] == [(5, 16, "markov"), (16, 40, "hex"), (40, 52, "markov")]
    assert got[102] == [(25, 49, "hex")] and not any(got[i] for i, _ in ordinary)
    masked = {r.doc_id: r.text for r in X.mask_secrets(docs, model).where("doc_id in (100, 101)").collect()}
    assert masked[100] == "take [SECRET] home" and left not in masked[101] and right not in masked[101]
