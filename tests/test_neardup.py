"""Near-duplicate removal against a plain sequential pass."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmurlens.functions.similarity import score_pairs, token_set
from murmurlens.operators import neardup as ND


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def indel_ratio(a, b):
    total = len(a) + len(b)
    return 100 - 100 * (total - 2 * lcs(a, b)) / total if total else 100.0


def token_set_score(a, b):
    """The published definition: best of three ratios over joined token sets."""
    ta, tb = set(a.split()), set(b.split())
    if not ta or not tb:
        return 0.0
    both, only_a, only_b = sorted(ta & tb), sorted(ta - tb), sorted(tb - ta)
    if both and (not only_a or not only_b):
        return 100.0
    shared = " ".join(both)
    left, right = " ".join(both + only_a), " ".join(both + only_b)
    best = indel_ratio(" ".join(only_a), " ".join(only_b))
    best = 100 - 100 * (len(" ".join(only_a)) + len(" ".join(only_b))
                        - 2 * lcs(" ".join(only_a), " ".join(only_b))) / (len(left) + len(right))
    if both:
        best = max(best, indel_ratio(shared, left), indel_ratio(shared, right))
    return best


def normal(text):
    return re.sub(r"[\W]+", " ", text.lower()).strip()


def sequential(rows, threshold, grouped=False):
    kept = []
    for seq, text, source in rows:
        n = normal(text)
        if not n:
            continue
        key = (source if grouped else "", " ".join(n.split()[:2]))
        bucket = len(n) // 20
        if any(k == key and abs(b - bucket) <= 1 and token_set_score(n, t) >= threshold for _, k, b, t in kept):
            continue
        kept.append((seq, key, bucket, n))
    return {k[0] for k in kept}


def near_texts(rng, n, openers, vocabulary):
    """Texts in few blocks: copies, edits, supersets, unrelated ones."""
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            words = rng.choice(texts).split()
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                i = rng.randrange(2, len(words) + 1)
                action = rng.random()
                if action < 0.35 or i >= len(words):
                    words.insert(i, rng.choice(vocabulary))
                elif action < 0.6:
                    w = words[i]
                    p = rng.randrange(len(w) + 1)
                    words[i] = w[:p] + rng.choice("abxyz") + w[p:]
                elif action < 0.75 and len(words) > 3:
                    del words[i]
                elif action < 0.85 and i + 1 < len(words):
                    words[i : i + 2] = [words[i] + words[i + 1]]
                else:
                    words.append(words[i])
            texts.append(" ".join(words))
        else:
            body = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 25))]
            texts.append(" ".join(rng.choice(openers).split() + body))
    return texts


@pytest.mark.parametrize("seed, threshold, frontier, openers", [
    (1, 95, 256, ["hi all", "see this", "ok"]),
    (2, 90, 3, ["hi all"]),
    (3, 80, 2, ["hi all", "see this"]),
    (4, 100, 3, ["hi all"]),
    (5, 95, 5, ["hi all"]),
    (6, 60, 4, ["hi all"]),
])
def test_equals_sequential_pass(spark, seed, threshold, frontier, openers):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(60)]
    texts = near_texts(rng, 200, openers, vocabulary)
    rows = [(i, t, rng.choice(["a", "b"])) for i, t in enumerate(texts)] + [(900, "?!", "a"), (901, "", "a")]
    df = spark.createDataFrame(rows, "seq bigint, text string, source string").repartition(4)
    group = ["source"] if seed % 2 else []
    got = {r["seq"] for r in ND.drop_near_duplicates(df, threshold, group, frontier=frontier).select("seq").collect()}
    assert got == sequential(rows, threshold, bool(group))


def test_flood_of_near_copies_is_settled_by_leaders(spark):
    rows = [(i, f"buy now at shop number{i % 7} " + "very cheap watches and more things to buy " * 2 + f"code{i}", "a")
            for i in range(300)]
    df = spark.createDataFrame(rows, "seq bigint, text string, source string")
    got = {r["seq"] for r in ND.drop_near_duplicates(df, 90, frontier=4).select("seq").collect()}
    assert got == sequential(rows, 90)


def test_chain_keeps_both_ends(spark):
    rows = [(0, "one two aaa bbb ccc", "s"), (1, "one two aaa bbb ccc ddd eee", "s"), (2, "one two ddd eee", "s")]
    df = spark.createDataFrame(rows, "seq bigint, text string, source string")
    assert [r["seq"] for r in ND.drop_near_duplicates(df, 95).orderBy("seq").collect()] == [0, 2]


def test_zero_threshold_switches_off(spark):
    df = spark.createDataFrame([(0, "a b", "s"), (1, "a b", "s")], "seq bigint, text string, source string")
    assert ND.drop_near_duplicates(df, 0).count() == 2


def test_scores_match_definition(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 7))) for _ in range(40)]
    pairs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 9))), " ".join(rng.choices(vocabulary, k=rng.randrange(0, 9))))
             for i in range(300)]
    pairs.append((300, "fuzzy was a bear but not a dog", "fuzzy was a bear but not a cat"))
    df = spark.createDataFrame(pairs, "i int, a string, b string").select(
        "i", token_set(F.col("a")).alias("a"), token_set(F.col("b")).alias("b"))
    got = {r["i"]: r["score"] for r in score_pairs(df, "a", "b").collect()}
    for i, a, b in pairs:
        assert got[i] == pytest.approx(token_set_score(a, b), abs=1e-9)
    assert got[300] == pytest.approx(92.31, abs=0.01)


def test_result_is_idempotent_and_a_subset(spark):
    rng = random.Random(11)
    vocabulary = ["w" + str(i) for i in range(30)]
    rows = [(i, t, "s") for i, t in enumerate(near_texts(rng, 120, ["hi all"], vocabulary))]
    df = spark.createDataFrame(rows, "seq bigint, text string, source string")
    once = ND.drop_near_duplicates(df, 90, frontier=8)
    twice = ND.drop_near_duplicates(once, 90, frontier=8)
    first = {r["seq"] for r in once.collect()}
    assert first <= {r[0] for r in rows}
    assert first == {r["seq"] for r in twice.collect()}


def test_sketches_leave_few_pairs_of_a_hot_opening_to_compare(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randrange(3, 9))) for _ in range(800)]
    texts = ["breaking news " + " ".join(rng.choices(vocabulary, k=10)) for _ in range(900)]
    texts += [t[:-1] + "x" for t in texts[:60]] + [t + " ok" for t in texts[60:90]]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "seq bigint, text string, source string")
    compared, edges = [], ND._edges
    monkeypatch.setattr(ND, "_edges", lambda pairs, nodes, threshold: compared.append(pairs.count()) or edges(pairs, nodes, threshold))
    got = {r["seq"] for r in ND.drop_near_duplicates(df, 90, frontier=64).select("seq").collect()}
    assert len(got) < len(texts) - 80
    buckets = [len(normal(t)) // 20 for t in texts]
    in_reach = sum(abs(a - b) <= 1 for i, a in enumerate(buckets) for b in buckets[:i])
    assert sum(compared) < 0.02 * in_reach


def test_bitmaps_bound_what_two_texts_differ_in():
    rng = random.Random(5)
    for _ in range(300):
        a = "".join(rng.choice("abcdé ") for _ in range(rng.randrange(1, 60)))
        b = list(a)
        for _ in range(rng.randrange(0, 9)):
            b.insert(rng.randrange(len(b) + 1), rng.choice("abcdé")) if rng.random() < 0.5 or not b else b.pop(rng.randrange(len(b)))
        b = "".join(b)
        longs = [ND._bitmaps(x, np.array([hash(w) % 4096 for w in x.split()], dtype=np.int64)) for x in (a, b)]
        differing = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(longs[0][:4], longs[1][:4]))
        assert differing <= len(a) + len(b) - 2 * lcs(a, b)
        missing = sum(((x & ~y) & (1 << 64) - 1).bit_count() for x, y in zip(longs[0][4:], longs[1][4:]))
        assert missing <= len(set(a.split()) - set(b.split()))


def test_tiles_of_a_loose_threshold_equal_the_scores(monkeypatch):
    """With a low threshold rare tokens and trigrams choose nothing; pairs meet by tiles, by arrays or one by one."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghijé") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    texts = sorted({" ".join(sorted(set(t.split()))) for t in near_texts(rng, 60, ["hi all"], vocabulary)})
    for threshold, few in ((70, 1), (70, 1000), (95, 1), (50, 24)):
        monkeypatch.setattr(ND, "_FEW", few)
        tile = ND.Tile(np.arange(len(texts)), texts, threshold)
        for i, t in enumerate(texts[:-1]):
            found, unsure = tile.similar_to(t, np.arange(i + 1, len(texts)))
            assert set(found) == {j for j in range(i + 1, len(texts)) if token_set_score(t, texts[j]) >= threshold} and not len(unsure)


def chained_texts():
    """One opening over many buckets: texts that grow by a word, so that each is contained in the next, and unlike ones."""
    rng = random.Random(12)
    texts, grown = [], "same start"
    for i in range(60):
        grown += f" w{i}" if i % 3 else f" longerword{i}"
        texts.append(grown)
    texts += ["same start " + " ".join(f"x{rng.randrange(400)}" for _ in range(rng.randrange(2, 60))) for _ in range(60)]
    texts += [t + " more" for t in texts[:20]] + ["other start " + t for t in texts[:30]]
    rng.shuffle(texts)
    return [(i, t, f"s{i % 2}") for i, t in enumerate(texts)]


@pytest.mark.parametrize("threshold, cell, tile", [(100, 1, 4096), (90, 3000, 4096), (100, 3000, 8)])
def test_cells_of_any_size_equal_the_sequential_pass(spark, monkeypatch, threshold, cell, tile):
    monkeypatch.setattr(ND, "_CELL_CHARS", cell)
    monkeypatch.setattr(ND, "_TILE", tile)
    rows = chained_texts()
    df = spark.createDataFrame(rows, "seq long, text string, source string")
    kept = ND.drop_near_duplicates(df, threshold, frontier=4096 if tile > 8 else 60).collect()
    assert {r.seq for r in kept} == sequential(rows, threshold)


def test_a_text_is_shipped_once_to_its_cell(spark):
    rows = [(i, "one opening " + " ".join(f"w{i}x{k}" for k in range(3 + i % 40)), "s") for i in range(200)]
    nodes = ND._nodes(spark.createDataFrame(rows, "seq long, text string, source string"), "text", "seq", ())
    sent = []

    def counted(left, right, meetings, by_cells=ND._by_cells):
        sent.append(by_cells(left, right, meetings))
        return sent[-1]

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ND, "_by_cells", counted)
        ND._pairs(nodes, nodes, 95, False).collect()
    assert sent[0].count() == nodes.count() == 200


def test_only_texts_of_undecided_pairs_are_fetched(spark, monkeypatch):
    rng = random.Random(5)
    long = ["same", "start"] + ["".join(rng.choice("abcdefghij") for _ in range(12)) for _ in range(200)]
    near = [w[:-1] + "z" if i > 150 else w for i, w in enumerate(long)]
    rows = [(0, " ".join(long), "s"), (1, " ".join(near), "s")]
    rows += [(i, f"same start {i} " + "word " * i, "s") for i in range(2, 40)]
    staged = {}

    def noted(df, name, materialise=ND.materialise):
        staged[name] = materialise(df, name)
        return staged[name]

    monkeypatch.setattr(ND, "materialise", noted)
    df = spark.createDataFrame(rows, "seq long, text string, source string")
    assert {r.seq for r in ND.drop_near_duplicates(df, 95).collect()} == sequential(rows, 95)
    assert sorted(r.id for r in staged["texts"].collect()) == [0, 1]


def unlike(n, words, seed, length=(3, 9)):
    """Texts of one opening whose letters are alike and whose words are not."""
    rng = random.Random(seed)
    return ["one opening " + " ".join("".join(rng.choice("aabcdeeefghiil") for _ in range(rng.randrange(*length))) for _ in range(words)) for _ in range(n)]


def test_unlike_long_texts_are_not_left_to_score_pair_by_pair(spark):
    texts = unlike(40, 420, 21)
    texts.append(texts[0][:-1] + "z")
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    nodes = ND._nodes(spark.createDataFrame(rows, "seq long, text string, source string"), "text", "seq", ())
    assert min(len(r.tokens) for r in nodes.collect()) > ND._LONG
    assert {(r.a, r.b) for r in ND._pairs(nodes, nodes, 95, False).collect()} == {(0, 40)}


@pytest.mark.parametrize("threshold, few, batch", [(70, 0, 1 << 15), (70, 0, 64), (50, 2, 256), (90, 0, 64), (95, 10**6, 64)])
def test_pairs_of_many_texts_together_equal_the_scores(monkeypatch, threshold, few, batch):
    """Bit rows near the diagonal only, pairs that end early, batches of any size: the same pairs."""
    monkeypatch.setattr(ND, "_FEW", few)
    monkeypatch.setattr(ND, "_BATCH", batch)
    rng = random.Random(threshold + few)
    vocabulary = ["".join(rng.choice("abcdefghijé") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    texts = near_texts(rng, 40, ["hi all"], vocabulary) + unlike(25, 30, 4)
    texts += [t[:90] + "é" + t[91:] for t in texts[-10:]]
    texts = sorted({" ".join(sorted(set(t.split()))) for t in texts}, key=lambda t: rng.random())
    ids = np.arange(len(texts)) * 3
    found = ND._Found(ids, texts, threshold, False)
    found.meet(np.arange(len(texts)), np.arange(len(texts)))
    table = found.table().to_pylist()
    assert all(r["sure"] for r in table)
    expected = {(3 * i, 3 * j) for j in range(len(texts)) for i in range(j) if token_set_score(texts[i], texts[j]) >= threshold}
    assert {(r["a"], r["b"]) for r in table} == expected and len(table) == len(expected)


def test_a_bucket_with_much_work_is_cut_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(ND, "_CELL_WORK", 2e5)
    dealt = []

    def counted(left, right, meetings, by_tiles=ND._by_tiles):
        dealt.append(by_tiles(left, right, meetings))
        return dealt[-1]

    monkeypatch.setattr(ND, "_by_tiles", counted)
    texts = unlike(60, 12, 3, (5, 6))
    texts += [t + " x" for t in texts[:15]]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "seq long, text string, source string")
    assert {r.seq for r in ND.drop_near_duplicates(df, 70).collect()} == sequential(rows, 70)
    assert dealt[0].select("bl", "br", "tl", "tr").distinct().count() >= 9


def test_tokens_are_put_in_order_without_a_lambda(spark):
    df = spark.createDataFrame([("b a é b 😀 ￿ a  ab",), ("",), (None,)], "t string").select(token_set(F.col("t")).alias("s"))
    assert [r.s for r in df.collect()] == [["a", "ab", "b", "é", "￿", "😀"], [], None]
    assert "array_sort" not in df._jdf.queryExecution().optimizedPlan().toString()
