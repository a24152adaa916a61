"""Codes against plain full rounds in Python, and the defined results at the edges."""

import hashlib
import math
import random

import numpy as np
import pytest

from murmurlens.llm import code_compression as K

SCHEMA = "vec_id long, embedding array<double>, label int, id string, vector int, codes string"


def by_force(rows, n_entries=16, rounds=6):
    """Rows of (id, vector, label): final codes, errors by position, and all entries."""
    kept = [(i, [max(-K.CUT, min(K.CUT, math.floor(x * 4096))) for x in v], la) for i, v, la in rows]
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, rows[r][1]))
    size = len(kept[0][1]) // 8
    cut = [[v[j * size:(j + 1) * size] for j in range(8)] for _, v, _ in kept]
    books = [[cut[r][j] for r in order[:n_entries]] for j in range(8)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        found = [[nearest(p[j], books[j]) for j in range(8)] for p in cut]
        for j in range(8):
            for k in range(len(books[j])):
                mine = [p[j] for p, f in zip(cut, found) if f[j][1] == k]
                if mine:
                    books[j][k] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [[nearest(p[j], books[j]) for j in range(8)] for p in cut]
    codes = [bytes(f[1] for f in row) for row in found]
    return codes, [min(sum(f[0] for f in row), K.MOST) for row in found], books


def table(spark, rows):
    return spark.createDataFrame([(i, v, la, "x", 1, "y") for i, v, la in rows], SCHEMA).repartition(4)


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def check(spark, rows, **options):
    codes, errors, books = by_force(rows, **options)
    got = K.compress(table(spark, rows), **options)
    found = K.label_errors(got.rows).collect()
    totals = {}
    for (_, _, la), e in zip(rows, errors):
        totals[la] = totals.get(la, 0) + e
    want = [(i, bytes(c), e, la, min(totals[la], K.MOST)) for (i, _, la), c, e in zip(rows, codes, errors)]
    assert sorted((key((r.id, bytes(r.codes), r.error, r.label, r.label_error)) for r in found)) == sorted(map(key, want))
    assert [[list(e) for e in b] for b in got.codebooks.entries] == books
    text = ",".join(str(x) for b in books for e in b for x in e)
    assert got.codebooks.sha256() == hashlib.sha256(text.encode()).hexdigest()
    return got


def random_rows(seed, n, size, spread=1.0, coarse=None):
    rng = random.Random(seed)

    def value():
        x = rng.gauss(0, spread)
        return x if coarse is None else round(x * coarse) / coarse

    return [(i, [value() for _ in range(size)], rng.choice([None, 1, 1, 2])) for i in range(n)]


def test_as_full_rounds(spark):
    got = check(spark, random_rows(1, 120, 16))
    full = 120 * 8 * 16
    assert got.work[0] == full and all(w <= full for w in got.work) and len(got.work) == 6


def test_ties_and_repeated_rows(spark):
    rows = random_rows(2, 60, 8, coarse=2)
    check(spark, rows + rows[:20] + [(None, rows[3][1], None), (5, rows[9][1], 2), (5, rows[5][1], 7)])


def test_few_rows_and_other_numbers(spark):
    check(spark, random_rows(3, 5, 8))
    check(spark, random_rows(4, 40, 24), n_entries=3, rounds=2)


def test_values_beyond_64_bits(spark):
    rows = random_rows(5, 30, 8, spread=1e4) + [(100, [1e6] * 8, 1), (101, [-1e30, 1e300] + [0.5] * 6, None), (102, [3e9] * 8, 2)]
    check(spark, rows)


def test_rows_that_are_dropped_or_teach_nothing(spark):
    rows = random_rows(6, 40, 8)
    bad = [(200, None, 1), (201, [1.0] * 7 + [None], 1), (202, [math.nan] + [1.0] * 7, 1), (203, [math.inf] * 8, 1), (204, [-math.inf] * 8, 1)]
    other = [(-5, [1.0] * 7, 9), (300, [], 1), (301, [0.5] * 16, None)]
    found = K.label_errors(K.compress(table(spark, rows + bad + other)).rows).collect()
    codes, errors, _ = by_force(rows)
    want = [(i, bytes(c), e) for (i, _, _), c, e in zip(rows, codes, errors)] + [(i, None, None) for i, _, _ in other]
    assert sorted((r.id, None if r.codes is None else bytes(r.codes), r.error) for r in found) == sorted(want)
    assert next(r for r in found if r.id == -5).label_error is None


def test_nothing_to_learn_from(spark):
    assert K.compress(table(spark, [])).rows.collect() == []
    assert K.compress(table(spark, [(1, None, 1)])).rows.collect() == []
    only = K.compress(table(spark, [(1, [1.0] * 3, 1)]))
    assert [(r.id, r.codes) for r in only.rows.collect()] == [(1, None)] and only.codebooks is None


def test_active_entries_give_what_a_full_scan_gives():
    rng = np.random.default_rng(7)
    vectors = rng.integers(-6, 7, (500, 16))
    books = K.Codebooks.start(vectors[:16])
    codes, near, full = K.assign(vectors, books)
    saved = False
    for _ in range(12):
        books = books.means([int(x) for x in K.part_sums(vectors, codes, 16)])
        want = K.assign(vectors, K.Codebooks(books.entries, np.ones((8, 16), dtype=bool)))
        codes, near, work = K.assign(vectors, books, codes, near)
        assert (codes == want[0]).all() and (near == want[1]).all()
        saved |= work < full / 2
    assert saved


def test_codes_stand_for_vectors_nearby(spark):
    rows = random_rows(9, 80, 16)
    got = K.compress(table(spark, rows))
    for r in got.rows.collect():
        own = [math.floor(x * 4096) for x in rows[r.id][1]]
        assert sum((a - b) ** 2 for a, b in zip(own, K.decompressed(bytes(r.codes), got.codebooks))) == r.error
    with pytest.raises(ValueError):
        K.compress(table(spark, rows), n_entries=300)
