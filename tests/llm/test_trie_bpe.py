"""Trie encoding against the library, and its defined results at the edges."""

import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from murmurlens.llm import trie_bpe as B  # noqa: E402

MODEL = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(MODEL)


@pytest.fixture(scope="module")
def own():
    return B.TrieEncoder(MODEL)


def odd_texts(seed=3):
    rng = random.Random(seed)
    texts = ["", " ", "a", "a<|endoftext|>b <|endoftext|>", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "<|endoftext", "x" * 3000]
    texts += ["".join(rng.choice("abcXYZ019+/") for _ in range(5000)), " " * 700 + "z" + "\n" * 50, "é☃😀中文字 " * 30, "\x00\x1c \x85 àb", "don't we'll I'M it's' 're"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 700), rng.randrange(0x4E00, 0x4F00), 32, 10])) for _ in range(rng.randrange(200))) for _ in range(150)]
    return texts + ["".join(rng.choice("theraindwmo ' ") for _ in range(rng.randrange(300))) for _ in range(150)]


def ids_of(raw):
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


def test_ids_and_texts_as_the_library(own, library):
    texts = odd_texts()
    for text, raw in zip(texts, own.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids_of(raw) == want
        assert own.decode(want) == library.decode(want, skip_special_tokens=False) == text


def test_decoding_ids_that_no_text_gives(own, library):
    rng = random.Random(8)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(12))]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_prefix_has_its_encoding(own, library):
    # a node's last tokens, read upwards, are the encoding of the prefix it stands for
    for word in ("internationalization", " unbelievableness", "aaaaaaaaaaaaa", "xqzjvwkbt"):
        own._path = [0]
        own._walk(word.encode(), 0)
        for end, node in enumerate(own._path):
            ids = []
            while node:
                ids.append(own._last[node])
                node = own._before[node]
            assert ids[::-1] == library.encode(word[:end], add_special_tokens=False).ids


def test_shared_prefixes_are_nodes_once(own):
    made = B.TrieEncoder(MODEL)
    made.learn({"stone", "stones", "stoned", "stony"})
    assert len(made._last) == 1 + len("stone") + len("s") + len("d") + len("y")


def test_tables_start_anew_when_full(library, monkeypatch):
    monkeypatch.setattr(B, "KEPT_NODES", 300)
    monkeypatch.setattr(B, "KEPT_WORDS", 60)
    monkeypatch.setattr(B, "KEPT_PAIRS", 20)
    monkeypatch.setattr(B, "LONG", 6)
    made, texts = B.TrieEncoder(MODEL), odd_texts(4)
    for at in range(0, len(texts), 7):
        for text, raw in zip(texts[at:at + 7], made.encode(texts[at:at + 7])):
            assert ids_of(raw) == library.encode(text, add_special_tokens=False).ids


def test_rows_of_a_table(spark, library):
    texts = odd_texts(5)[:60]
    rows = [(i, t, "n", 3) for i, t in enumerate(texts)] + [(7, texts[7], None, 1), (None, "null id", None, 1), (99, None, None, None), (98, "long " * 200_000, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, __text long").repartition(4)
    got = B.round_trip(docs, MODEL).collect()

    def want(i, t):
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        return (-1 if i is None else i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), True)

    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == sorted(want(i, t) for i, t, *_ in rows)
    ids = B.encoded(docs, MODEL)
    texts_back = B.decoded(ids, MODEL).where("doc_id is not null").groupBy("doc_id").agg(F.max("text").alias("t")).collect()
    assert {r.doc_id: r.t for r in texts_back} == {i: t or "" for i, t, *_ in rows if i is not None}
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert B.round_trip(nothing, MODEL).collect() == [] and B.encoded(nothing, MODEL).collect() == []
    assert B.decoded(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), MODEL).collect()[0].text is None
