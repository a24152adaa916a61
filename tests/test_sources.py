"""Files, JSON documents and the label store."""

import json

import pytest
from pyspark.sql import functions as F

from murmurlens.config import CORPUS_SOURCE
from murmurlens.functions.predicates import looks_vietnamese
from murmurlens.operators.stats import label_distribution
from murmurlens.plans.cleaning import clean_comments
from murmurlens.plans.report import summary_report
from murmurlens.sources import comments as C, corpus, store, threads


def test_platform_csv_edges(spark, tmp_path):
    path = tmp_path / "youtube_comments.csv"
    path.write_text('comment_id,text,source\n1,"line one\nline two",\n2,"said ""hi""",reddit\n3,"   ",x\n4,"a, b",youtube\n',
                    encoding="utf-8-sig")
    rows = {r["comment_id"]: r for r in C.scan_platform(spark, str(path), "youtube").collect()}
    assert rows["1"]["text"] == "line one\nline two" and rows["1"]["source"] == "youtube"
    assert rows["2"]["text"] == 'said "hi"' and rows["2"]["source"] == "reddit"
    assert "3" not in rows and rows["4"]["text"] == "a, b"
    assert rows["4"]["split"] == "collected" and rows["4"]["label"] is None


def test_missing_text_column_is_an_error(spark):
    with pytest.raises(ValueError, match="no text column"):
        C.normalise_platform(spark.createDataFrame([(1,)], "a int"), "reddit")


def test_gather_unions_and_filters(spark):
    a = spark.createDataFrame([("x", "CLEAN"), ("y", None)], "text string, label string")
    b = spark.createDataFrame([("z", "odd", 3)], "text string, label string, score long")
    everything, pending = C.gather({"youtube": a, "reddit": b})
    assert everything.count() == 3 and {r["text"] for r in pending.collect()} == {"y", "z"}
    with pytest.raises(ValueError, match="unknown"):
        C.gather({"youtube": a}, ["tiktok"])
    assert C.split_known(["reddit", "tiktok"]) == (["reddit"], ["tiktok"])


def test_rows_of_several_files_get_unique_order(spark, tmp_path):
    text = "đây là một bình luận khá dài để so sánh"
    for name in ("youtube", "reddit"):
        (tmp_path / f"{name}.csv").write_text(f"text\n{text}\n{text} nhé\n{name} khác hẳn\n", encoding="utf-8")
    frames = {n: C.scan_platform(spark, str(tmp_path / f"{n}.csv"), n) for n in ("youtube", "reddit")}
    everything, pending = C.gather(frames)
    assert everything.select("seq").distinct().count() == 6 == pending.count()
    kept = clean_comments(everything, similarity_group=("source",))
    assert sorted((r["source"], r["text"][:4]) for r in kept.collect()) == [
        ("reddit", "redd"), ("reddit", "đây "), ("youtube", "yout"), ("youtube", "đây ")]
    assert clean_comments(everything, duplicate_subset=("text",), similarity_group=()).count() == 3


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16", "latin-1"])
def test_corpus_files(spark, tmp_path, encoding):
    text = "café" if encoding == "latin-1" else "cà phê ngon"
    (tmp_path / "._train.csv").write_text(f"free_text,label_id\n{text},0\nngu,1\n", encoding=encoding)
    (tmp_path / "dev.csv").write_text("comment,Label\nxin,hate\n ,CLEAN\nbad,7\n", encoding="utf-8")
    rows = {(r["text"], r["label"], r["split"]) for r in corpus.read_corpus(spark, str(tmp_path)).collect()}
    assert rows == {(text, "CLEAN", "train"), ("ngu", "OFFENSIVE", "train"), ("xin", "HATE", "dev")}


def test_plain_name_beats_dotted(spark, tmp_path):
    (tmp_path / "._train.csv").write_text("text,label\na,0\n")
    (tmp_path / "Train.csv").write_text("text,label\nb,0\n")
    assert [r["text"] for r in corpus.read_corpus(spark, str(tmp_path)).collect()] == ["b"]


def test_corpus_needs_columns():
    with pytest.raises(ValueError):
        corpus.detect_columns(["a", "label"])
    assert corpus.detect_columns(["label", "text", "free_text", "label_id"]) == ("free_text", "label_id")


def test_comment_pages(spark):
    page = {"items": [
        {"id": "outer1", "snippet": {"topLevelComment": {"id": "c1", "snippet": {
            "textDisplay": "hay", "authorDisplayName": "An", "likeCount": 4, "publishedAt": "2024-01-01T00:00:00Z"}}}},
        {"id": "outer2", "snippet": {"topLevelComment": {"snippet": {"textDisplay": "dở"}}}},
    ]}
    df = spark.createDataFrame([("v1", json.dumps(page))], "video_id string, json string")
    rows = threads.flatten_comment_pages(df).orderBy("pos").collect()
    assert [(r["comment_id"], r["text"], r["author"], r["like_count"]) for r in rows] == [
        ("c1", "hay", "An", 4), ("outer2", "dở", "", 0)]


def comment(cid, body, replies="", author="an", kind="t1"):
    tree = {"data": {"children": replies}} if replies else ""
    return {"kind": kind, "data": {"id": cid, "body": body, "author": author, "score": 2, "created_utc": 1700000000, "replies": tree}}


def test_reply_tree_is_pre_order_and_skips_subtrees(spark):
    tree = [
        comment("a", "A", [comment("a1", "A1", [comment("a11", "A11")]), comment("a2", "A2")]),
        comment("b", "[deleted]", [comment("b1", "B1")]),
        comment("c", "C", [comment("c1", "C1", author="AutoModerator"), comment("m", "M", kind="more")]),
    ] + [comment(f"n{i}", f"N{i}") for i in range(12)]
    df = spark.createDataFrame([
        ("p1", json.dumps([{}, {"data": {"children": tree}}])), ("p2", json.dumps({"error": 1})), ("p3", "not json"),
    ], "post_id string, json string")
    rows = threads.flatten_reply_trees(df).orderBy("post_id", "path").collect()
    assert [r["comment_id"] for r in rows] == ["a", "a1", "a11", "a2", "c"] + [f"n{i}" for i in range(12)]
    assert rows[0]["published_at"] == "2023-11-14T22:13:20+00:00" and rows[2]["depth"] == 2
    assert threads.flatten_reply_trees(df, accept=lambda t: t.startswith("A")).count() == 4
    assert threads.flatten_reply_trees(df, accept=looks_vietnamese).count() == 0
    assert [r["post_id"] for r in threads.unreadable_json(df).collect()] == ["p3"]


def test_reply_trees_have_no_depth_limit(spark):
    def chain(levels):
        tree = []
        for k in reversed(range(levels)):
            tree = [comment(f"c{k}", f"text {k}", tree)]
        return json.dumps([{}, {"data": {"children": tree}}])

    df = spark.createDataFrame([("deep", chain(110)), ("flat", chain(1)), ("beyond", chain(900))], "post_id string, json string")
    counts = {r["post_id"]: r["count"] for r in threads.flatten_reply_trees(df).groupBy("post_id").count().collect()}
    rejected = {r["post_id"] for r in threads.unreadable_json(df).collect()}
    assert counts["flat"] == 1 and rejected <= {"deep", "beyond"}
    for name, levels in (("deep", 110), ("beyond", 900)):
        assert (name in rejected) != (counts.get(name) == levels)


def test_post_listing(spark):
    listing = {"data": {"children": [
        {"kind": "t3", "data": {"id": "p1", "title": "x" * 90, "num_comments": 2}},
        {"kind": "t3", "data": {"id": "p2", "title": "none", "num_comments": 0}},
        {"kind": "t5", "data": {"id": "p3", "title": "other", "num_comments": 9}},
    ]}}
    df = spark.createDataFrame([(json.dumps(listing),)], "json string")
    assert [(r["post_id"], r["post_title"]) for r in threads.flatten_post_listing(df).collect()] == [("p1", "x" * 80)]


def test_store_versions_replay_and_compaction(spark, tmp_path):
    labels = store.LabelStore(spark, str(tmp_path / "store"))
    assert labels.read().count() == 0
    rows = lambda *r: spark.createDataFrame(list(r), "seq long, record_key string, label string")
    labels.append(rows((1, "a", "CLEAN"), (2, "b", "LABEL_ERROR"), (3, "c", "HATE")), 1)
    labels.append(rows((1, "a", "HATE"), (4, "d", "CLEAN")), 2)
    labels.append(rows((1, "a", "OFFENSIVE"), (4, "d", "CLEAN")), 2)
    expected = {("a", "OFFENSIVE"), ("c", "HATE"), ("d", "CLEAN")}
    assert {(r["record_key"], r["label"]) for r in labels.read().collect()} == expected
    packed = labels.compact_to(str(tmp_path / "packed"))
    assert {(r["record_key"], r["label"]) for r in packed.log().collect()} == expected


def test_results_and_report(spark, tmp_path):
    df = spark.createDataFrame([("a\nb", "CLEAN", "vihsd", 1), (' "q" ', "HATE", "reddit", 2), ("c", "HATE", "reddit", 3)],
                               "text string, label string, source string, extra int")
    C.write_results(df, str(tmp_path / "out"), fmt="csv")
    back = C.read_csv(spark, str(tmp_path / "out"))
    assert back.columns == ["text", "label", "source"]
    assert {r["text"] for r in back.collect()} == {"a\nb", ' "q" ', "c"}
    report = json.loads(summary_report(df).first()["report"])
    assert report["total_rows"] == 3
    assert report["label_distribution"]["HATE"] == {"count": 2, "pct": 66.67}
    assert report["label_distribution"]["OFFENSIVE"] == {"count": 0, "pct": 0.0}
    assert report["source_distribution"] == {CORPUS_SOURCE: 1, "reddit": 2}
    assert report["toxic_by_source"][0] == {"source": "reddit", "total": 2, "toxic": 2, "toxic_rate_pct": 100.0}


def test_distribution_of_empty_input(spark):
    rows = label_distribution(spark.createDataFrame([], "label string")).collect()
    assert [(r["label"], r["count"], r["pct"]) for r in rows] == [("CLEAN", 0, 0.0), ("OFFENSIVE", 0, 0.0), ("HATE", 0, 0.0)]


def test_store_reads_the_folders_of_the_keys_asked_for(spark, tmp_path):
    from pathlib import Path

    path = str(tmp_path / "store")
    labels = store.LabelStore(spark, path)
    rows = spark.range(400).selectExpr("id as seq", "'s' as source", "concat('k', id) as record_key", "'CLEAN' as label", "concat('text ', id) as text")
    for version in range(3):
        labels.append(rows.where(f"seq % 3 = {version}"), version)
    asked = spark.createDataFrame([("s", "k7"), ("s", "k8"), ("s", "new")], "source string, record_key string")
    found = labels.keys_of(asked)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    buckets = {r.b for r in asked.select(labels._bucket_of(F.col("record_key")).alias("b")).collect()}
    # what is not asked for cannot be read any more, and the answer is the same
    files = list(Path(path, "rows").rglob("part-*"))
    others = [f for f in files if int(f.parent.name.split("=")[1]) not in buckets]
    assert len(others) > 0.8 * len(files)
    for f in others:
        f.write_bytes(b"")
    got = {r.record_key for r in labels.keys_of(asked).collect()}
    assert {"k7", "k8"} <= got and len(got) < 40
    from murmurlens.operators.dedup import anti_join_keys
    assert [r.record_key for r in anti_join_keys(asked, labels.keys_of(asked)).collect()] == ["new"]


def test_reply_trees_are_parsed_once(spark, monkeypatch):
    plans = []
    kept = threads.materialise
    monkeypatch.setattr(threads, "materialise", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df, name))
    leaf = '{"kind": "t1", "data": {"id": "b", "body": "yes", "author": 7, "score": "many", "created_utc": 0, "replies": ""}}'
    tree = '[{}, {"data": {"children": [{"kind": "t1", "data": {"id": "a", "body": "so", "replies": {"data": {"children": [%s]}}}}, {"kind": 1}, 5]}}]' % leaf
    rows = threads.flatten_reply_trees(spark.createDataFrame([("p", tree), ("q", None), ("r", "no json")], "post_id string, json string")).collect()
    assert [(r.comment_id, r.depth, r.author, r.score, r.text) for r in sorted(rows, key=lambda r: r.path)] == [("a", 0, "", 0, "so"), ("b", 1, "7", 0, "yes")]
    assert plans[0].lower().count("parsejson") == 1
