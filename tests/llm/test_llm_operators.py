"""Each operator against a brute-force version, and its defined results at the edges."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from murmurlens.llm import (  # noqa: E402
    chat_threads as C, decontamination as D, fingerprints as P, quality as Q, sampled_pieces as S,
    secret_scan as X, simhash as H, substring_dedup as W, token_counts as T, toxicity as Z,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __note string, name long"
LABELS = "doc_id long, quality int, toxic int"


def documents(spark, rows):
    """Rows of (doc_id, text) with the other columns of the table and two more."""
    return spark.createDataFrame([(i, t, None, "s", None, "x", 1) for i, t in rows], SCHEMA).repartition(3)


def words(rng, n, kinds=40):
    return [f"w{rng.randrange(kinds)}" for _ in range(n)]


def mixed_rows(seed=1):
    """Random texts that share passages, with nulls, empty, repeated and one very long text."""
    rng = random.Random(seed)
    passage = words(rng, 60, 400)
    rows = []
    for i in range(40):
        body = words(rng, rng.randrange(0, 60))
        if i % 3 == 0:
            cut = rng.randrange(0, 30)
            body = body[:10] + passage[cut:cut + rng.randrange(15, 45)] + body[10:]
        if i % 7 == 0:
            body += ["run"] * rng.randrange(1, 50)
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(body)))
    rows += [(41, None), (42, ""), (43, " \n\t "), (44, rows[6][1]), (45, rows[6][1]), (3, rows[3][1]), (46, "é ☃ " * 3 + "x" * 5000)]
    rows += [(47, " ".join(words(rng, 4000))), (None, rows[9][1]), (None, None)]
    return rows


# ---- 1: substring dedup -------------------------------------------------------
def removed_by_force(rows, window):
    order = sorted({(math.inf if i is None else i, t or "") for i, t in rows})
    split = {k: k[1].encode().split() for k in order}
    first = {}
    for key in order:
        for s in range(len(split[key]) - window + 1):
            first.setdefault(tuple(split[key][s:s + window]), (key[0], s))
    out = {}
    for key in order:
        gone = set()
        for s in range(len(split[key]) - window + 1):
            if first[tuple(split[key][s:s + window])] < (key[0], s):
                gone.update(range(s, s + window))
        kept = b" ".join(w for i, w in enumerate(split[key]) if i not in gone)
        out[key] = (len(split[key]), len(gone), kept.decode())
    return out


@pytest.mark.parametrize("window", [4, 20])
def test_repeats_are_removed_as_by_force(spark, window):
    rows = mixed_rows()
    want = removed_by_force(rows, window)
    got = W.remove_repeats(documents(spark, rows), window).collect()
    expected = sorted((i if i is not None else -1, *want[(math.inf if i is None else i, t or "")]) for i, t in rows)
    assert sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in got) == expected


def test_symbols_of_equal_windows_agree():
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(9)]
    passage = [rng.choice(base) for _ in range(90)]
    texts = [[rng.choice(base) for _ in range(rng.randrange(0, 30))] + passage[rng.randrange(0, 40):][:rng.randrange(0, 60)] + [base[0]] * rng.randrange(0, 30) for _ in range(60)]
    flat = np.array([w for t in texts for w in t], dtype=np.uint64)
    sizes = [len(t) for t in texts]
    starts, doc = np.r_[0, np.cumsum(sizes)], np.repeat(np.arange(len(sizes)), sizes)
    name, first, last = W.usable_symbols(flat, doc, starts, 20)
    held = {}
    for n, a, b in zip(name.tolist(), first.tolist(), last.tolist()):
        for s in range(a, b + 1):
            held.setdefault(s, []).append((n, a - s))
    groups = {}
    for s in range(len(flat) - 19):
        if doc[s] == doc[s + 19]:
            groups.setdefault(tuple(flat[s:s + 20].tolist()), []).append(sorted(n for n, _ in held.get(s, [])))
    assert any(len(g) > 1 and g[0] for g in groups.values())
    assert all(g == groups[k][0] for k, gs in groups.items() for g in gs)


# ---- 2: decontamination ---------------------------------------------------------
def test_masks_find_every_window_with_two_differences():
    for pair in itertools.combinations(range(D.WINDOW), 2):
        assert any(not {s + p for p in m} & set(pair) for m in D.MASKS for s in range(D.WINDOW - m[-1]))


def test_contamination_as_by_force(spark):
    rng = random.Random(2)
    items = [(i, " ".join(words(rng, n, 60))) for i, n in enumerate((30, 13, 12, 9, 5, 40))] + [(6, None), (7, ""), (8, "w1 w2 w3"), (9, "seldom"), (10, " ".join(words(rng, 10, 60)))]
    rows = [(i, " ".join(words(rng, 30, 60))) for i in range(20)]
    for i in range(20, 60):
        item = items[i % 6][1].upper().split()
        cut = item[: rng.randrange(8, 41)]
        for p in rng.sample(range(len(cut)), min(len(cut), rng.randrange(0, 5))):
            cut[p] = "other"
        rows.append((i, " ".join(words(rng, 7, 60) + cut + words(rng, 5, 60))))
    rows += [(60, None), (61, ""), (20, rows[20][1]), (None, items[0][1]), (62, "x w1 W2 w3 y"), (63, "seldom"), (64, "w1 w2 w4"), (65, items[2][1].split()[0] + " z " + items[2][1])]
    eight = "ten words that nobody else would ever have said".split()[1:]
    items.append((11, " ".join(eight)))
    rows += [(66, "before " + " ".join(eight)), (67, " ".join(eight[:3] + ["other"] + eight[4:])), (68, " ".join(eight[:3] + ["other", "word"] + eight[5:]))]

    def by_force(text):
        t, found = (text or "").lower().split(), set()
        for i, body in items:
            b = (body or "").lower().split()
            width = min(D.WINDOW, len(b))
            for shift in range(-len(b), len(t)):
                same = [0 <= shift + k < len(t) and t[shift + k] == w for k, w in enumerate(b)]
                if b and any(sum(same[s:s + width]) >= -(-4 * width // 5) for s in range(len(b) - width + 1)):
                    found.add(i)
        return sorted(found)

    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.contaminated_documents(documents(spark, rows), bench).collect()
    assert sorted((str(r.doc_id), list(r.item_ids)) for r in got) == sorted((str(i), by_force(t)) for i, t in rows)
    assert all(r.contaminated == (r.n_items > 0) for r in got)
    assert {r.doc_id: 11 in r.item_ids for r in got if r.doc_id in (66, 67, 68)} == {66: True, 67: True, 68: False}
    kept = D.drop_contaminated(documents(spark, rows), bench)
    assert kept.columns == documents(spark, rows).columns and kept.count() == sum(not by_force(t) for _, t in rows)


# ---- 3: token counts ------------------------------------------------------------
def test_counts_of_all_prefixes_are_those_of_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    counter, library = T.prefix_counter(path), Tokenizer.from_file(path)
    rng = random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", "\t", "'re", "'", ".", "!!", "é", "日本", "12", " ", "<|endoftext|>", "<|end", "\x1c", "x" * 9, "🙂", "½"]
    for _ in range(250):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        want = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert counter.prefix_counts(text).tolist() == want and counter.count(text) == want[-1]
        assert counter.longest_prefix(text, 5) == max(i for i, n in enumerate(want) if n <= 5)


def test_token_counts_at_the_edges(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "hello world"), (3, "word " * 3000)]
    got = sorted(map(tuple, T.token_counts(documents(spark, rows), public_tokenizers.path("byte_bpe_50k.json")).collect()), key=str)
    assert [r[1:4] for r in got if r[0] in (1, 2)] == [(0, 0, False)] * 3
    assert [r[1:] for r in got if r[0] is None] == [(11, 2, False, 11)]
    assert [r[1:4] for r in got if r[0] == 3] == [(15000, 3001, True)]


# ---- 4: fingerprints --------------------------------------------------------------
_GAP = r"[ \t\n\x0b\f\r\p{P}\p{Z}]"


def cuts(value, *before):
    h = 42
    for x in (*before, value):
        h = h if x is None else xxhash.xxh64_intdigest(x.encode(), seed=h)
    return h - (1 << 64) if h >> 63 else h


def pieces_by_force(text):
    """Paragraphs: cut at line ends, after one word in so many, and in long words after one pair of characters in so many."""
    done, open_part = set(), ""
    for w in regex.findall(rf"(?:(?!{_GAP}).)+(?:(?!\n){_GAP})*\n*|{_GAP}+", text, regex.S):
        chars = list(w) if len(w) > P.LONG_WORD else [w]
        for k, c in enumerate(chars):
            open_part += c
            whole = k == len(chars) - 1 and (cuts(w) % P.WORDS == 0 or w.endswith("\n"))
            if whole or len(chars) > 1 and cuts(c, chars[k - 1] if k else None) % P.PAIRS == 0:
                done.add(open_part)
                open_part = ""
    return done | ({open_part} if open_part else set())


def test_fingerprints_recover_the_differences(spark):
    rng = random.Random(4)
    rows = [(3 * i, "\n".join(" ".join(words(rng, rng.randrange(1, 30), 900)) for _ in range(rng.randrange(1, 30)))) for i in range(25)]
    rows += [(200, None), (201, ""), (202, "a"), (203, "é☃本" * 40), (204, rows[3][1]), (6, rows[2][1]), (None, "last of all")]
    order = sorted({(math.inf if i is None else i, t or "") for i, t in rows})

    def jaccard(a, b):
        a, b = pieces_by_force(a), pieces_by_force(b)
        return len(a & b) / len(a | b) if a | b else 1.0

    want = {}
    for k, (i, text) in enumerate(order):
        following, quarter = order[(k + 1) % len(order)][1], len(text) // 4
        edited = text[:len(text) - quarter] + following[:quarter]
        want[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), jaccard(text, edited), jaccard(text, following))
    got = P.fingerprints_of_versions(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        n, sha, near_edited, near_next = want[math.inf if r.doc_id is None else r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert r.near_edited == pytest.approx(near_edited) and r.near_next == pytest.approx(near_next)
    by_id = {r.doc_id: r.fingerprint for r in got}
    assert by_id[204] == by_id[9] and by_id[200] == by_id[201] and by_id[0] != by_id[3]


# ---- 5 and 8: classifiers -----------------------------------------------------------
def labelled_rows(kind, n=400):
    rng = random.Random(7)
    rows, labels = [], []
    ordinary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(150)]
    for i in range(n):
        bad = rng.random() < 0.3
        body = [rng.choice(ordinary) for _ in range(rng.randrange(10, 60))]
        if bad and kind == "toxic":
            for p in range(0, len(body), 8):
                body[p] = rng.choice(["worthless", "wortless", "pathetic", "pathettic"])
        if bad and kind == "quality":
            body = [w.upper() + "!!" for w in body]
        rows.append((i, " ".join(body)))
        labels.append((i, int(not bad), int(bad)))
    return rows, labels


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_classifiers_hold_out_a_fold_and_are_right_on_it(spark, kind):
    rows, labels = labelled_rows(kind)
    truth = {i: (t if kind == "toxic" else q) for i, q, t in labels}
    docs, table = documents(spark, rows + [(None, None), (9999, "")]), spark.createDataFrame(labels, LABELS)
    if kind == "toxic":
        got, folds, fold, least = Z.score_toxicity(docs, Z.fit_toxicity(docs, table)).collect(), 5, 0, 0.5
    else:
        got, folds, fold, least = Q.score_quality(docs, Q.fit_quality(docs, table)).collect(), 4, 2, 0.7
    assert len(got) == len(rows) + 2
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= least) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % folds == fold) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def ordinary_word(rows):
    return rows[0][1].split()[1]


def test_misspelt_words_share_their_ngrams(spark):
    rows, labels = labelled_rows("toxic")
    docs = documents(spark, rows)
    model = Z.fit_toxicity(docs, spark.createDataFrame(labels, LABELS))
    bad, odd, plain = model.word_logits(["worthless", "worthlesss", ordinary_word(rows)])
    assert bad > plain and odd > plain


def test_classifiers_without_labels_or_documents(spark):
    docs, none = documents(spark, [(1, "some text"), (2, None)]), spark.createDataFrame([], LABELS)
    one_class = spark.createDataFrame([(1, 1, 0)], LABELS)
    assert [r.score for r in Z.score_toxicity(docs, Z.fit_toxicity(docs, none)).collect()] == [0.5, 0.5]
    assert [r.score for r in Q.score_quality(docs, Q.fit_quality(docs, none)).collect()] == [0.5, 0.5]
    assert all(r.predicted == 1 for r in Q.score_quality(docs, Q.fit_quality(docs, one_class)).collect())
    empty = documents(spark, [(1, "x")]).where("false")
    assert Q.score_quality(empty, Q.fit_quality(empty, one_class)).count() == 0
    kept = Q.keep_quality(docs, Q.fit_quality(docs, one_class))
    assert kept.columns == docs.columns and kept.count() == 2


# ---- 6: SimHash -----------------------------------------------------------------------
def fingerprint_by_force(text):
    split = (text or "").encode().lower().split()
    if not split:
        return 0
    shingles = [b" ".join(split[i:i + 4]) for i in range(max(1, len(split) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_by_force(keys, linked):
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(keys, 2):
        if linked(a, b):
            parent[find(a)] = find(b)
    return {k: find(k) for k in keys}


def near(a, b):
    return (a ^ b).bit_count() <= 4


def test_covering_masks_catch_every_pair():
    rng, masks = random.Random(6), [m & (1 << 64) - 1 for m in H.covering_masks()]
    for _ in range(2000):
        flips = sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 5)))
        assert any(not m & flips for m in masks)


@pytest.mark.parametrize("small", [1, 32])
def test_links_of_crowded_buckets(spark, small, monkeypatch):
    monkeypatch.setattr(H, "SMALL", small)
    rng, fps = random.Random(8), set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(50):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 6))))
    fps |= {rng.getrandbits(64) for _ in range(30)}
    want = classes_by_force(fps, near)
    df = spark.createDataFrame([(H._signed(x),) for x in fps], "fp bigint")
    roots = {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in H.components(spark, H.links(spark, df)).collect()}
    groups = {}
    for f in fps:
        groups.setdefault(roots.get(f, f), set()).add(f)
    expected = {}
    for f in fps:
        expected.setdefault(want[f], set()).add(f)
    assert set(map(frozenset, groups.values())) == set(map(frozenset, expected.values()))


def test_near_duplicates_as_by_force(spark):
    rows = mixed_rows(9)
    rng = random.Random(9)
    for i in range(100, 130):
        body = rows[47][1].split()
        for p in rng.sample(range(len(body)), rng.randrange(0, 60)):
            body[p] = "edit"
        rows.append((i, " ".join(body)))
    fps = {(i, t or ""): fingerprint_by_force(t) for i, t in rows}
    classes = classes_by_force(set(fps.values()), near)
    least = {}
    for (i, _), f in fps.items():
        if i is not None:
            least[classes[f]] = min(i, least.get(classes[f], i))
    got = H.near_duplicate_components(documents(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.fp & (1 << 64) - 1, r.component_id) for r in got) == sorted(
        (str(i), fps[i, t or ""], least[classes[fps[i, t or ""]]]) for i, t in rows)
    docs = documents(spark, rows)
    kept = H.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))


# ---- 7: chat formatting ------------------------------------------------------------------
def test_quotations_link_and_leave(spark):
    chat = [
        (1, 0, "ann", "Shall we meet on Monday?\nOr rather on Tuesday?"),
        (1, 1, "bob", "Ann wrote:\n> Shall we meet on Monday?\n\nMonday is fine with me."),
        (1, 2, "cay", "> Or rather on TUESDAY\nTuesday is better."),
        (1, 3, "ann", ">> Shall we meet on Monday?\n> Monday is fine with me.\nSo Monday it is."),
        (1, 4, "dan", "> never said by anybody\nWhat?"),
        (1, 5, "eve", "> > Monday is fine with me.\n> ok\nHm."),
        (2, 0, "ann", "Shall we meet on Monday?"), (2, 1, None, None), (2, None, "x", "> Shall we meet on Monday?\nearly"),
        (None, 3, "y", "alone, with nobody to quote"), (None, 4, "z", "> alone with nobody to quote"), (None, 4, "z", "> alone with nobody to quote"),
    ]
    df = spark.createDataFrame(chat, "conv_id long, turn long, role string, text string").repartition(2)
    got = {(r.conv_id, r.turn, r.role): r for r in C.threaded_messages(df).collect()}
    assert C.threaded_messages(df).count() == len(chat)
    links = {k: (r.reply_to, r.root, r.depth) for k, r in got.items()}
    assert links[1, 1, "bob"] == (0, 0, 1) and links[1, 2, "cay"] == (0, 0, 1) and links[1, 3, "ann"] == (1, 0, 2)
    assert links[1, 4, "dan"] == (None, 4, 0) and links[1, 5, "eve"] == (1, 0, 2)
    assert links[2, 0, "ann"] == (None, 0, 0) and links[2, None, "x"] == (None, None, 0) and links[None, 4, "z"] == (3, 3, 1)
    assert got[1, 1, "bob"].text == "Monday is fine with me." and got[2, 1, None].text == "" and got[None, 4, "z"].text == ""


def test_long_chains_of_replies_and_hot_lines(spark):
    chain = [(5, i, "a", (f"> message number {i - 1} of the chain\n" if i else "") + f"message number {i} of the chain") for i in range(70)]
    hot = [(6, i, "a", "the same line each time" if i % 2 == 0 else "> the same line each time\nyes") for i in range(9000, 9400)]
    df = spark.createDataFrame(chain + hot, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in C.threaded_messages(df).collect()}
    assert all(got[5, i].depth == i and got[5, i].root == 0 for i in range(70))
    assert all(got[6, i].reply_to == (i - 1 if i % 2 else None) for i in range(9000, 9400))
    assert C.threaded_messages(df.where("false")).count() == 0


# ---- 9: secret scans ------------------------------------------------------------------------
def spans_by_force(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((*m.span(), "assign"))
    out += [(*m.span(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(*m.span(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[0], X.KINDS.index(s[2])))


def test_pattern_spans_are_those_of_the_patterns():
    rng = random.Random(10)
    parts = ["password", "Token", "api_key", "APIKEY", " ", "  ", ":", "=", '"', "'", "abc123", "secret", "AKIA", "ABCDEFGHIJ012345", "deadbeef" * 3, "é☃", "ſecret", ".", "-", "x"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert X.pattern_spans(text) == spans_by_force(text)


def test_markov_spans_and_masking(spark):
    rng = random.Random(11)
    ordinary = [(i, " ".join("".join(rng.choice(["ma", "to", "re", "li", "con", "ter"]) for _ in range(rng.randrange(1, 9))) for _ in range(60))) for i in range(60)]
    secret = "qX7bR2kLw9ZtP4vNcY8mJ1sD"
    rows = ordinary + [(100, f"take {secret} home"), (101, None), (102, ""), (103, 'token = "abcdef123" and ' + "conterconterconterconter2"), (None, f"{secret}")]
    docs = documents(spark, rows)
    model = X.fit_markov(docs)
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in X.scan_secrets(docs, model).collect()}
    assert got[100] == [(5, 5 + len(secret), "markov")] and got[None] == [(0, len(secret), "markov")]
    assert got[101] == got[102] == [] and got[103] == [(0, 18, "assign")]
    assert not any(got[i] for i, _ in ordinary)
    masked = {r.doc_id: r.text for r in X.mask_secrets(docs, model).collect()}
    assert masked[100] == "take [SECRET] home" and masked[101] is None and masked[102] == "" and masked[103].startswith("[SECRET]\" and")
    assert X.mask_secrets(docs, model).columns == docs.columns
    empty = docs.where("false")
    assert X.scan_secrets(empty, X.fit_markov(empty)).count() == 0


# ---- 10: sampled pieces ----------------------------------------------------------------------
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def all_paths(text):
    """All segmentations with their probabilities, by plain enumeration."""
    import sentencepiece

    v = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    marked, out = "▁" + text.replace(" ", "▁"), []

    def go(at, ids, weight):
        if at == len(marked):
            out.append((tuple(ids), weight))
            return
        for end in range(at + 1, len(marked) + 1):
            k = v.piece_to_id(marked[at:end])
            if not v.is_unknown(k):
                go(end, [*ids, k], weight * (min(max(0.0, -v.get_score(k)), v.get_piece_size() - 1) + 1) ** -0.5)

    go(0, [], 1.0)
    total = sum(w for _, w in out)
    return {p: w / total for p, w in out}


def test_samples_follow_the_distribution_without_replacement():
    made, n, k = S.Sampler(MODEL, 0.5, 3, 1), 6000, 3
    exact, first, weights = all_paths("ab cd"), {}, {}
    for row in made.sample(list(range(n)), ["ab cd"] * n):
        ids = [tuple(e.tolist()) for e, _, _ in row]
        assert len(set(ids)) == min(k, len(exact))
        first[ids[0]] = first.get(ids[0], 0) + 1
        for p, (_, log_p, inclusion) in zip(ids, row):
            assert log_p == pytest.approx(math.log(exact[p])) and inclusion <= 0
            weights[p] = weights.get(p, 0) + exact[p] / math.exp(inclusion)
    for p, q in exact.items():
        assert first.get(p, 0) / n == pytest.approx(q, abs=4 * math.sqrt(q * (1 - q) / n) + 1e-3)
    assert sum(weights.values()) / n == pytest.approx(1, abs=0.03)  # inclusion scores make unbiased sums


def test_texts_with_few_segmentations_give_all():
    made = S.Sampler(MODEL, 0.5, 50, 1)
    exact = all_paths("ab c")
    (row,) = made.sample([5], ["ab c"])
    assert {tuple(e.tolist()) for e, _, _ in row} == set(exact) and all(q == 0 for _, _, q in row)


def test_sampled_pieces_round_trip_and_edges(spark):
    texts = ["", None, "a", " two  spaces ", "line\nbreak\ttab\0nul", "日本語 ☃ 🙂 ſ", "It's 3.5%, isn't it?!", "x" * 3000, " ".join(words(random.Random(1), 800))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, "a"), (None, "no key")]
    got = S.sampled_pieces(documents(spark, rows), MODEL).collect()
    assert len(got) == len(rows)
    known = {**dict(rows[:9]), None: "no key"}
    for r in got:
        assert all(S.decode(list(s.pieces), MODEL) == (known[r.doc_id] or "") for s in r.samples)
        assert len({tuple(s.pieces) for s in r.samples}) == len(r.samples) == (1 if r.doc_id in (0, 1, 5) else 2)  # those have one segmentation only
        if not known[r.doc_id]:
            assert [tuple(s) for s in r.samples] == [([], 0.0, 0.0)]
    twice = [r.samples for r in got if r.doc_id == 2]
    assert twice[0] == twice[1]
    alone = S.sampled_pieces(documents(spark, [(8, texts[8])]), MODEL).collect()[0].samples
    assert alone == next(r.samples for r in got if r.doc_id == 8)
    opened = S.sampled_pieces(documents(spark, rows), MODEL).select("doc_id", F.explode("samples.pieces").alias("pieces"))
    assert S.decoded_texts(opened, MODEL).where(F.col("doc_id") == 3).first().text == texts[3]


# ---- all ----------------------------------------------------------------------------------------
def test_empty_tables(spark):
    none = documents(spark, [(1, "x")]).where("false")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert W.remove_repeats(none).count() == 0
    assert D.contaminated_documents(none, bench).count() == 0
    assert D.contaminated_documents(documents(spark, [(1, "a text"), (2, None)]), bench).where("contaminated").count() == 0
    assert T.token_counts(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert P.fingerprints_of_versions(none).count() == 0
    assert H.near_duplicate_components(none).count() == 0
    assert S.sampled_pieces(none, MODEL).count() == 0


def test_sketches_on_arrays_equal_those_of_columns(spark):
    rng = np.random.default_rng(4)
    shared = rng.integers(-(1 << 62), 1 << 62, 300)
    sides = [(shared[:n].tolist(), shared[m:n + 40].tolist()) for n, m in ((0, 0), (1, 0), (5, 2), (60, 3), (250, 200), (0, 30))]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(sides)], "i int, a array<bigint>, b array<bigint>").coalesce(1)
    left, right = P.sketch(F.col("a")), P.sketch(F.col("b"))
    wanted = rows.select("i", P.spelt(left).alias("s"), F.size(P.difference(F.col("a"), F.col("b"), left, right)).alias("n")).orderBy("i").collect()
    a, b = (P._Sets(pa.array(x, pa.list_(pa.int64()))) for x in zip(*sides))
    assert a.spelt() == [r.s for r in wanted]
    assert P._differing(a, b).tolist() == [r.n for r in wanted] == [len(set(x) ^ set(y)) for x, y in sides]
