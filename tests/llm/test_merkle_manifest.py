"""Manifests against a plain recursive tree, witnesses leaf by leaf, and the edges."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from murmurlens.llm import merkle_manifest as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, place long, block string, `group` string"


def h(digests):
    return sha256("".join(digests).encode()).hexdigest()


def tree(nodes, fan):
    """The root of a list of digests, and for each the other members of its runs."""
    found = [[] for _ in nodes]
    members = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, up_members = [], []
        for a in range(0, len(nodes), fan):
            run = nodes[a:a + fan]
            for k, below in enumerate(members[a:a + fan]):
                for leaf in below:
                    found[leaf].append((k, run[:k] + run[k + 1:]))
            up.append(h(run))
            up_members.append([x for m in members[a:a + fan] for x in m])
        nodes, members = up, up_members
    return nodes[0], found


def fold(leaf, steps):
    for k, others in steps:
        leaf = h(others[:k] + [leaf] + others[k:])
    return leaf


def leaf_of(row):
    return sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row).encode()).hexdigest()


@pytest.mark.parametrize("fan", [2, 3, 8])
def test_witnesses_of_a_stream(fan):
    for n in (1, 2, 3, 7, 8, 9, 17, 63, 64, 65, 200):
        leaves = [sha256(str(i).encode()).digest() for i in range(n)]
        stream = M.Appender(fan)
        for leaf in leaves:
            stream.append(leaf)
        root, steps = stream.close(), tree([x.hex() for x in leaves], fan)
        assert root.hex() == steps[0]
        for i, leaf in enumerate(leaves):
            assert bytes(stream.siblings[i]).hex() == "".join("".join(o) for _, o in steps[1][i])
            assert M.folded(leaf, bytes(stream.shapes[i]), bytes(stream.siblings[i])) == root
            assert M.folded(leaves[i - 1], bytes(stream.shapes[i]), bytes(stream.siblings[i])) != root or n == 1


def test_partial_witnesses_grow_as_siblings_complete():
    stream = M.Appender(2)
    lengths = []
    for i in range(8):
        stream.append(bytes([i]) * 32)
        lengths.append(len(stream.shapes[0]) // 2)
    assert lengths == [0, 1, 1, 2, 2, 2, 2, 3]


def rows_with_edges():
    rng = random.Random(4)
    rows = [(i, rng.choice(["s", None]), lang, rng.choice([None, 5]), "Some Text é " * rng.randrange(3)) for lang, ids in (("en", range(0, 75)), ("de", range(75, 92)), (None, [100, 101]), ("é", [110])) for i in ids]
    rows += [(120, None, "z", None, None), (121, "s", "z", 1, ""), (121, "s", "z", 1, ""), (121, "s", "z", 1, "Other"), (None, None, "z", None, "NULL ID"), (122, "s", "z", 9, "LONG " * 40_000)]
    return rows


@pytest.mark.parametrize("fan, levels", [(8, 3), (2, 2), (3, 1)])
def test_manifest_as_by_recursion(spark, fan, levels):
    rows = rows_with_edges()
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(5)
    lost = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = M.verified(M.manifest(docs, altered={"text": F.when(lost, lower).otherwise(F.col("text"))}, fan=fan, levels=levels)).collect()
    assert len(got) == len(rows)
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    # rows of one id are told apart by their leaves, whose order among themselves is the operator's own
    order = {}
    for lang in langs:
        mine = [r for r in rows if r[2] == lang]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        if lang == "z":
            ties = {leaf_of(r): r for r in mine if r[0] == 121}
            found = [g for g in got if g.doc_id == 121]
            assert sorted(g.leaf for g in found) == sorted(leaf_of(r) for r in mine if r[0] == 121)
            options = [[a, b, c] for a in ties for b in ties for c in ties if sorted([a, b, c]) == sorted(g.leaf for g in found)]
            known = {g.subroot for g in found}.pop()
            for option in options:
                leaves = [leaf_of(r) for r in mine]
                at = [i for i, r in enumerate(mine) if r[0] == 121]
                for i, leaf in zip(at, option):
                    leaves[i] = leaf
                if tree(leaves, fan)[0] == known:
                    break
        else:
            leaves = [leaf_of(r) for r in mine]
        order[lang] = (mine, leaves)
    subroots = [tree(order[lang][1], fan)[0] for lang in langs]
    root, above = tree(subroots, fan)
    want = []
    for k, lang in enumerate(langs):
        mine, leaves = order[lang]
        steps = tree(leaves, fan)[1]
        text_of = {leaf_of(r): r for r in mine}
        for leaf, own in zip(leaves, steps):
            r = text_of[leaf]
            path = own + above[k]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            text = r[4] if r[4] is None or not hit else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
            end = fold(leaf_of((*r[:4], text)), path)
            want.append((r[0] if r[0] is not None else -1, leaf, subroots[k], root, h(x for _, o in path for x in o), end, end == root))
    columns = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted((g.doc_id if g.doc_id is not None else -1, *(g[c] for c in columns)) for g in got) == sorted(want)
    assert {w[-1] for w in want} == {True, False}


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert M.verified(M.manifest(docs)).collect() == []


def test_fields_do_not_run_into_each_other(spark):
    rows = [(1, "a", "b"), (2, "a1:b", ""), (3, None, "-"), (4, "-", None), (5, "", None)]
    got = spark.createDataFrame(rows, "k int, a string, b string").select(M.leaf_hash([F.col("a"), F.col("b")]).alias("x")).collect()
    assert len({r.x for r in got}) == len(rows)
