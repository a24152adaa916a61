"""What the classifiers may learn from, and their scores against plain loops."""

import math
import random
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from murmurlens.llm import common, quality as Q, toxicity as Z

SCHEMA = "doc_id long, text string, id string, label int, place int, __id string, __label int"


def corpus(seed=11, n=300):
    rng = random.Random(seed)
    good, bad = ["stone", "river", "walk", "morning", "bread", "quiet"], ["idiot", "scum", "trash", "loser"]
    rows, labels = [], []
    for i in range(n):
        mean = rng.random() < 0.4
        text = " ".join(rng.choice(good + (bad if mean else [])) for _ in range(rng.randrange(5, 40)))
        rows.append((i, text + (" | $$ ##" * 5 if mean else "."), "x", 5, 1, "y", 2))
        labels.append((i, int(not mean), int(mean)))
    return rows, labels


def tables(spark, rows, labels):
    return spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").repartition(2)


@pytest.mark.parametrize("fit, score, folds, fold", [(Z.fit_toxicity, Z.score_toxicity, 5, 0), (Q.fit_quality, Q.score_quality, 4, 2)])
def test_held_out_labels_change_nothing(spark, fit, score, folds, fold):
    rows, labels = corpus()
    flipped = [(i, 1 - q, 1 - t) if zlib.crc32(str(i).encode()) % folds == fold else (i, q, t) for i, q, t in labels]
    assert flipped != labels
    docs, own = tables(spark, rows, labels)
    _, other = tables(spark, rows, flipped)
    got = [{r.doc_id: r.score for r in score(docs, fit(docs, x)).collect()} for x in (own, other)]
    assert got[0] == got[1] and len(set(got[0].values())) > 1


def test_sample_is_bounded_though_ids_repeat(spark):
    rows, labels = corpus(12, 60)
    rows += [(*rows[k][:1], f"copy {n}", *rows[k][2:]) for k in range(60) for n in range(20)]
    docs, own = tables(spark, rows, labels)
    found = common.labelled_sample(docs, own, "toxic", 40, 5, 0)
    assert found.columns == ["text", "label"] and 0 < found.count() <= 40
    assert {r.label for r in found.collect()} == {0, 1}
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, common.labelled_sample(docs.repartition(7), own, "toxic", 40, 5, 0).collect()))


def test_trees_as_plain_walks(spark):
    rows, labels = corpus(13)
    docs, own = tables(spark, rows, labels)
    forest = Q.fit_quality(docs, own)
    texts = [r[1] for r in rows[:60]] + ["", "x", "ÀÉ " * 40]
    for x, got in zip(Q.statistics(texts), forest.scores(Q.statistics(texts))):
        margin = forest.base
        for feature, threshold, value in zip(forest.feature, forest.threshold, forest.value):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if x[feature[node]] > threshold[node] else 1)
            margin += value[node - len(feature)]
        assert got == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-9)


def test_text_scores_as_plain_loops(spark):
    rows, labels = corpus(14)
    docs, own = tables(spark, rows, labels)
    model = Z.fit_toxicity(docs, own)

    def bucket(gram):
        h = 0
        for c in gram:
            h = ((h * 0x100000001B3) ^ ord(c)) & ((1 << 64) - 1)
        return ((h * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)) >> 47

    def logit(word):
        marked = f"\x02{word}\x02"
        grams = [marked[a:a + n] for n in Z.SIZES for a in range(len(marked) - n + 1)]
        return sum(float(model.bucket[bucket(g)]) for g in grams) / max(len(grams), 1)

    texts = [r[1] for r in rows[:40]] + ["", "idiott STONE", "日本 é"]
    for text, got in zip(texts, Z.Scorer(model).scores(texts)):
        bag = Counter(text.lower().split())
        total = sum(math.sqrt(n) * logit(w) for w, n in bag.items()) / (sum(math.sqrt(n) for n in bag.values()) + Z.PRIOR)
        assert got == pytest.approx(1 / (1 + math.exp(-(total + model.bias))), abs=1e-5)


def test_rows_kept_and_replaced_go_through_whole(spark):
    rows = [(i, t, "x", None, i, None, 7) for i, t in enumerate(["good", "bad", None, "", "good " * 700_000])]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    kept = common.kept_rows(docs, lambda: lambda texts: pa.array([not (t or "").startswith("bad") for t in texts]))
    assert kept.schema == docs.schema and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4]
    upper = common.replaced_texts(docs, lambda: lambda texts: pa.array([t and t.upper() for t in texts], pa.string()))
    assert upper.schema == docs.schema
    assert {r.doc_id: r.text for r in upper.where("doc_id < 4").collect()} == {0: "GOOD", 1: "BAD", 2: None, 3: ""}
    assert upper.select(F.length("text").alias("n")).where("n > 100").first().n == 5 * 700_000
    empty = spark.createDataFrame([], SCHEMA)
    assert common.kept_rows(empty, lambda: lambda texts: None).collect() == []
