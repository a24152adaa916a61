"""Exact deduplication, labelling, review and streaming."""

import json

import pytest
from pyspark.sql import functions as F

from murmurlens.functions.keys import with_record_key
from murmurlens.operators import selection, dedup as D, labelling as L, review as R, stats, terms
from murmurlens.plans import labelling as P
from murmurlens.plans.analysis import analyse
from murmurlens.plans.cleaning import clean_comments, cleaning_audit
from murmurlens.sources import comments as C
from murmurlens.sources.store import LabelStore
from murmurlens.streaming import ingest


def frame(spark, rows, schema="seq long, text string, source string, comment_id string"):
    return spark.createDataFrame(rows, schema).repartition(3)


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_clean_comments(spark):
    df = frame(spark, [(0, "Xin chào bạn!!", "a", None), (1, "xin  chào bạn!!", "a", None), (2, "xin chào bạn!!", "b", None),
                       (3, None, "a", None), (4, "ok", "a", None), (5, "xin chào bạn nhé", "a", None)])
    assert values(clean_comments(df, similarity_threshold=0), "seq") == [(0,), (2,), (5,)]
    assert values(clean_comments(df), "seq", "text") == [(0, "xin chào bạn!!"), (2, "xin chào bạn!!")]
    assert dict(values(cleaning_audit(df, 95), "outcome", "n")) == {
        "null_text": 1, "too_short": 1, "exact_duplicate": 1, "near_duplicate": 1, "kept": 2}


def test_keep_first_and_last(spark):
    df = frame(spark, [(i, f"t{i % 3}", "s", None) for i in range(30)])
    assert values(D.keep_first(df, ["text"]), "seq") == [(0,), (1,), (2,)]
    assert values(D.keep_last(df, ["text"]), "seq") == [(27,), (28,), (29,)]


def test_platform_fallback_key_is_per_row(spark):
    df = spark.createDataFrame([(0, "i", "v", "a"), (1, "i", "v", "b"), (2, "", "v", "a"), (3, None, "v", "a"), (4, " ", "v", "b")],
                               "seq long, comment_id string, video_id string, text string")
    assert values(D.drop_platform_duplicates(df, ["video_id", "text"]), "seq") == [(0,), (2,), (4,)]


def test_numbering_equals_row_number(spark):
    rows = [(i * i % 1009 + 2000 * (i % 2), "t", "ab"[i % 2] if i % 5 else None, None) for i in range(200)]
    rows = list({r[0]: r for r in rows}.values())
    got = values(D.number_within(frame(spark, rows), ["source"]), "seq", "number")
    expected = []
    for source in ("a", "b", None):
        expected += [(s, i) for i, s in enumerate(sorted(r[0] for r in rows if r[2] == source), 1)]
    assert got == sorted(expected)
    total = values(D.number_within(frame(spark, rows), []), "seq", "number")
    assert total == [(s, i) for i, s in enumerate(sorted(r[0] for r in rows), 1)]


def test_limits(spark, monkeypatch):
    df = frame(spark, [(i, "t", "s", None) for i in range(50)])
    assert D.first_rows(df, 0).count() == 50
    assert values(D.first_rows(df, 3), "seq") == [(0,), (1,), (2,)]
    monkeypatch.setattr(selection, "FEW", 2)
    monkeypatch.setattr(D, "_GROUP_LIMIT", 2)
    assert values(D.first_rows(df, 3), "seq") == [(0,), (1,), (2,)]
    assert values(D.cap_per_group(df, ["source"], 4), "seq") == [(0,), (1,), (2,), (3,)]
    one, two = D.stable_sample(df, 10), D.stable_sample(df.repartition(7), 10)
    assert values(one, "seq") == values(two, "seq") and one.count() == 10


def test_synthetic_ids(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, "c")], "seq long, text string").selectExpr(
        "*", "'g' AS facebook_group_id", "'p' AS post_id")
    assert values(D.synthetic_ids(df), "seq", "comment_id") == [
        (0, "facebook_g_p_1"), (1, "facebook_g_p_2"), (3, "facebook_g_p_3")]


REPLIES = [
    ('```json\n[{"id": 0, "label": "clean"}, {"id": 2, "label": "HATE"}]\n```', ["CLEAN", "LABEL_ERROR", "HATE"]),
    ('[{"id": 0, "label": "NICE"}, {"id": 1, "label": "hate"}, {"id": 2, "label": "CLEAN"}]', ["LABEL_ERROR", "HATE", "CLEAN"]),
    ('[{"id": 0}, {"id": 1, "label": "HATE"}]', ["LABEL_ERROR"] * 3),
    ("sorry, no", ["LABEL_ERROR"] * 3),
    (None, ["LABEL_ERROR"] * 3),
    ('[{"id": 0, "label": "HATE"}, {"id": 0, "label": "CLEAN"}]', ["CLEAN", "LABEL_ERROR", "LABEL_ERROR"]),
    ('[broken', ["LABEL_ERROR"] * 3),
    ('[{"id": "zero", "label": "HATE"}]', ["LABEL_ERROR"] * 3),
]


def test_reply_parsing(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(REPLIES)], "i int, reply string").repartition(2)
    got = df.select("i", L.reply_labels(F.col("reply"), F.lit(3)).alias("l")).orderBy("i").collect()
    assert [r["l"] for r in got] == [want for _, want in REPLIES]
    none = df.limit(1).select(L.reply_labels(F.col("reply"), F.lit(0)).alias("l")).first()
    assert none["l"] == []


def test_labeller_errors_stay_in_their_batch(spark):
    def labeller(texts):
        if "bad" in texts:
            raise RuntimeError("503\nservice busy")
        return json.dumps([{"id": i, "label": "HATE" if "x" in t else "CLEAN"} for i, t in enumerate(texts)])

    df = spark.createDataFrame([(0, "ax"), (1, "b"), (2, "bad"), (3, "x"), (4, "c")], "seq long, text string").coalesce(1)
    got = L.apply_labeller(df, labeller, "Service", size=2).orderBy("seq").collect()
    assert [r["label"] for r in got] == ["HATE", "CLEAN", "LABEL_ERROR", "LABEL_ERROR", "CLEAN"]
    assert got[2]["label_error"] == "503 service busy" and got[2]["labeled_by"] == "Service_ERROR"
    assert got[0]["label_error"] == "" and got[0]["labeled_by"] == "Service"


def pending_rows(spark, n=12):
    return with_record_key(frame(spark, [(i, "địt mẹ" if i % 3 == 0 else f"hay {i}", "youtube", str(i % 10)) for i in range(n)]))


def test_cycle_moves_success_and_keeps_errors(spark):
    pending = pending_rows(spark)

    def label(df):
        found = F.when(F.col("seq") % 4 == 0, "LABEL_ERROR").otherwise("CLEAN")
        return L.with_provenance(df.withColumn("label", found), "S")

    store = pending.filter("seq = 3").withColumn("label", F.lit("HATE"))
    cycle = P.label_cycle(pending, store, label)
    # keys 0 and 1 occur twice: rows 10 and 11 stand for them
    labels = dict(values(cycle.store, "record_key", "label"))
    assert labels == {f"youtube|comment|{i}": "CLEAN" for i in (0, 1, 2, 3, 5, 6, 7, 9)}
    left = {r["record_key"] for r in cycle.pending.collect()}
    assert left == {f"youtube|comment|{i}" for i in (4, 8)} and not left & set(labels)


def test_committed_cycles_cap_and_resume(spark, tmp_path):
    pending, labels = pending_rows(spark), LabelStore(spark, str(tmp_path / "store"))
    step = ingest.lexicon_step()
    first = P.run_cycle(pending, labels, step, 1, max_rows=4)
    assert labels.read().count() == 4 and {r["record_key"] for r in first.collect()}.isdisjoint(
        {r["record_key"] for r in labels.read().collect()})
    rest = P.run_cycle(pending, labels, step, 2)
    assert rest.count() == 0 and labels.read().count() == 10


def test_no_calls_after_a_quota_error(spark):
    def labeller(texts):
        if "bad" in texts:
            raise RuntimeError("429 quota exceeded")
        return json.dumps([{"id": i, "label": "CLEAN"} for i in range(len(texts))])

    df = spark.createDataFrame([(0, "a"), (1, "bad"), (2, "c"), (3, "d")], "seq long, text string").coalesce(1)
    got = L.apply_labeller(df, labeller, "Service", size=1).orderBy("seq").collect()
    assert [r["label_error"] for r in got] == ["", "429 quota exceeded", L.NOT_CALLED, L.NOT_CALLED]


def test_replayed_version_counts_once_and_a_crash_changes_nothing(spark, tmp_path):
    pending, labels = pending_rows(spark), LabelStore(spark, str(tmp_path / "store"))
    step = ingest.lexicon_step()
    P.run_cycle(pending, labels, step, 1, max_rows=4)
    before = values(labels.read(), "record_key", "label")
    P.run_cycle(pending, labels, step, 1, max_rows=4)
    assert values(labels.read(), "record_key", "label") == before and len(labels.versions()) == 1

    def failing(df):
        return step(df).withColumn("label", F.when(F.col("seq") > 6, F.raise_error(F.lit("gone"))).otherwise(F.col("label")))

    with pytest.raises(Exception, match="gone"):
        P.run_cycle(pending, labels, failing, 2)
    assert values(labels.read(), "record_key", "label") == before
    P.run_cycle(pending, labels, step, 2)
    labels.append(pending.filter("seq < 2").withColumn("label", F.lit("HATE")), 2, "review")
    assert labels.read().count() == 10 and [v.writer for v in labels.versions()] == ["cycle", "cycle", "review"]


def test_null_source_leaves_pending(spark, tmp_path):
    pending = pending_rows(spark, 3).withColumn("source", F.lit(None).cast("string"))
    assert P.run_cycle(pending, LabelStore(spark, str(tmp_path / "store")), ingest.lexicon_step(), 1).count() == 0


def test_null_orders_are_numbered_and_limits_agree(spark, monkeypatch):
    rows = spark.createDataFrame([(i, None if i % 2 else i) for i in range(40)], "k long, seq long")
    assert sorted(r["n"] for r in D.number_within(rows, [], column="n").collect()) == list(range(1, 41))
    small = values(D.first_rows(rows, 25), "k")
    monkeypatch.setattr(selection, "FEW", 0)
    assert values(D.first_rows(rows, 25), "k") == small and len(small) == 25


def test_review_round_trip(spark, tmp_path):
    pending = pending_rows(spark, 8)
    review = R.export_review(pending, 4, "youtube")
    assert review.columns[:4] == ["record_key", "label", "text", "comment_id"]
    R.write_review(review, str(tmp_path / "review"))
    with pytest.raises(Exception, match="(?i)exists"):
        R.write_review(review, str(tmp_path / "review"))
    edited = C.read_csv(spark, str(tmp_path / "review"))
    filled = edited.withColumn("label", F.when(F.col("seq") == 0, " hate").when(F.col("seq") == 1, "clean").otherwise(""))
    store = spark.createDataFrame([("youtube|comment|0", "CLEAN", "t", "youtube")], "record_key string, label string, text string, source string").withColumn("seq", F.lit(99))
    out = R.import_review(filled, store, pending, platform="youtube")
    assert dict(values(out.store, "record_key", "label")) == {"youtube|comment|0": "HATE", "youtube|comment|1": "CLEAN"}
    assert out.pending.count() == 6 and out.review.count() == 2
    again = R.import_review(filled, out.store, out.pending, platform="youtube")
    assert values(again.store, "record_key", "label") == values(out.store, "record_key", "label")
    bare = spark.createDataFrame([("CLEAN ", "tay", "777")], "label string, text string, comment_id string")
    assert ("reddit|comment|777", "CLEAN") in values(R.import_review(bare, store, pending).store, "record_key", "label")
    with pytest.raises(ValueError, match="CLEAN, OFFENSIVE, HATE"):
        R.import_review(filled.withColumn("label", F.lit("NICE")), store, pending)
    with pytest.raises(ValueError, match="no label"):
        R.import_review(filled.withColumn("label", F.lit(" ")), store, pending)


def test_stream_equals_batch(spark, tmp_path):
    source, step = tmp_path / "in", ingest.lexicon_step()
    schema = "seq long, text string, source string, comment_id string"
    parts = [[(i, "địt mẹ nó" if i % 3 else "video rất hay", "youtube", str(i % 6)) for i in range(k, k + 5)] for k in (0, 5)]
    labels = LabelStore(spark, str(tmp_path / "store"))
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        ingest.start_ingest(stream, labels, str(tmp_path / "checkpoint"), step).awaitTermination()
    # comments 0 to 3 arrive again in the second part and keep their labels
    everything = spark.createDataFrame(parts[0] + parts[1][:1], schema)
    batch = step(ingest.prepare(ingest.keyed_rows(everything)))
    assert values(labels.read(), "record_key", "label", "text") == values(batch, "record_key", "label", "text")


def test_analysis_bundle(spark):
    rows = [(0, "video hay quá cảm ơn bạn", "CLEAN"), (1, "địt con mẹ thằng đó ngu vl", "OFFENSIVE"),
            (2, "dân tộc này toàn loại rác rưởi súc vật", "HATE"), (3, "đồ ngu ngốc khùng điên", "OFFENSIVE"),
            (4, "bài viết rất hay và bổ ích", "CLEAN")]
    df = spark.createDataFrame(rows, "seq long, text string, label string").selectExpr("*", "'s' AS source")
    out = analyse(df)
    assert values(out["score_by_label"], "label", "mean_score") == [("CLEAN", 0.0), ("HATE", 75.0), ("OFFENSIVE", 64.5)]
    assert out["top_toxic_words"].first()["word"] == "ngu"
    assert out["source_comparison"].filter("source = 'All'").first()["CLEAN"] == 40.0
    assert stats.source_label_shares(df).count() == 0
    tokenizer = lambda text: F.array(text)
    assert terms.word_counts(df, tokenizer=tokenizer).count() == 5
    constant = spark.createDataFrame([(1, 2.0), (1, 3.0)], "n_chars int, toxic_score double")
    assert stats.length_score_correlation(constant).first()["correlation"] is None


def test_one_quota_for_all_tasks(spark):
    def labeller(texts):
        if any(t == "t50" for t in texts):
            raise RuntimeError("Quota exceeded")
        return "[" + ",".join(f'{{"id": {i}, "label": "CLEAN"}}' for i in range(len(texts))) + "]"

    rows = spark.range(0, 300, 1, 6).select(F.col("id").alias("seq"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    got = {r["seq"]: r["label_error"] for r in L.apply_labeller_in_order(rows, labeller, "Service", 10, first=2).collect()}
    # waves of batches 0-1, 2-5 and, not sent, the rest
    assert {i for i, e in got.items() if e == ""} >= set(range(50))
    assert {i for i, e in got.items() if e == "Quota exceeded"} == set(range(50, 60))
    assert {i for i, e in got.items() if e == "quota_exhausted_not_called"} == set(range(60, 300)) and len(got) == 300


def test_terms_that_cannot_hit_are_not_joined_to_a_large_lexicon(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "good trash of trash " + " ".join(f"w{i}" for i in range(500))), (2, "nothing here")], "seq long, text string")
    lexicon = spark.createDataFrame([("trash", 4), ("good trash", 7), ("trash", 1)], "term string, weight int")
    found = terms.lexicon_lookup(rows, lexicon, broadcast_entries=0)
    assert [tuple(r) for r in found.collect()] == [(1, 5, 17)]
    known = terms._hash_table(lexicon, F.col("term"))
    passing = rows.select(F.explode(F.split("text", " ")).alias("t")).filter(known(F.col("t"))).distinct().collect()
    assert ("trash",) in [tuple(r) for r in passing] and len(passing) < 20
