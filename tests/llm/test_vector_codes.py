"""Vector codes against a plain full search, and their edge cases."""

import hashlib
import math
import random

import numpy as np
import pytest

from devicelens.llm import vector_codes as C

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts, entries, rounds, length):
    """Codes by plain whole numbers: every part against every entry."""
    kept = sorted((i, [math.floor(256 * x) for x in v] + [0] * (length - len(v)), label) for i, v, label in rows
                  if v is not None and all(x is not None and math.isfinite(x) for x in v))
    width = length // parts
    cut = lambda v, j: v[j * width : (j + 1) * width]
    books = [[cut(v, j) for _, v, _ in kept[:entries]] for j in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min((apart(cut(v, j), e), n) for n, e in enumerate(books[j])) for j in range(parts)] for _, v, _ in kept]
    for _ in range(rounds):
        found = assign()
        for j in range(parts):
            for n in range(len(books[j])):
                mine = [cut(v, j) for (_, v, _), f in zip(kept, found) if f[j][1] == n]
                if mine:
                    books[j][n] = [sum(x) // len(mine) for x in zip(*mine)]
    found = assign()
    errors = {}
    for (_, _, label), f in zip(kept, found):
        errors[label] = errors.get(label, 0) + sum(d for d, _ in f)
    codes = [(i, "".join(f"{n:02x}" for _, n in f), sum(d for d, _ in f), errors[label]) for (i, _, label), f in zip(kept, found)]
    return codes, hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()


def run(frame, **options):
    coded, books = C.compress(frame, **options)
    rows = C.with_label_error(coded).collect()
    return sorted((r.vec_id, r.code, r.error, r.label_error) for r in rows), C.codebooks_digest(books)


@pytest.mark.parametrize("pivots", [1, 3])
def test_equals_a_full_search(spark, pivots):
    rng = random.Random(7)
    rows = [(i, [rng.choice([rng.gauss(0, 0.3), 0.25, -0.5]) for _ in range(12)], rng.choice([None, 1, 2])) for i in rng.sample(range(500), 90)]
    rows += [(600, None, 1), (601, [0.1] * 11 + [None], 1), (602, [float("nan")] * 12, 2), (603, [float("inf")] * 12, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert run(frame, parts=4, entries=8, pivots=pivots) == brute(rows, 4, 8, 2, 12)


def test_ties_copies_and_few_rows(spark):
    rows = [(i, [0.5, -0.5, 0.25, 0.0], None) for i in range(1, 5)] + [(9, [0.5, 0.5, -1.0, 2.0], 3)]
    assert run(spark.createDataFrame(rows, SCHEMA), parts=2, entries=64) == brute(rows, 2, 64, 2, 4)
    same = rows + rows  # repeated rows are coded each
    assert len(run(spark.createDataFrame(same, SCHEMA), parts=2, entries=64)[0]) == 10


def test_edges(spark):
    rows = [(1, [0.5, 0.25, 1.0], 1), (2, [0.5], 1), (3, [], None), (None, [0.1, 0.2, 0.3], 2)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' AS code", "'clash' AS error", "'clash' AS parts", "'clash' AS ints")
    coded, books = C.compress(frame, parts=2, entries=4)
    got = {r.vec_id: r for r in coded.collect()}
    assert set(got) == {1, 2, 3, None} and books.shape == (2, 4, 2)
    assert all(r.error == 0 for r in got.values())  # as many entries as rows
    empty = [(1, [], 1), (2, [], 1)]
    assert [(r.code, r.error) for r in C.compress(spark.createDataFrame(empty, SCHEMA), parts=2)[0].collect()] == [("0000", 0)] * 2
    none = spark.createDataFrame(rows, SCHEMA).where("false")
    coded, books = C.compress(none)
    assert C.with_label_error(coded).count() == 0 and books.size == 0
    with pytest.raises(ValueError, match="64-bit"):
        C.compress(spark.createDataFrame([(1, [1e30, 0.0], 1)], SCHEMA), parts=2)


def test_bounds_prune_and_stay_exact():
    rng = np.random.default_rng(3)
    x = rng.integers(-200, 200, (400, 4))
    entries = rng.integers(-200, 200, (64, 4))
    pivots = C.choose_pivots(entries, 4)
    assert len({tuple(p) for p in pivots.tolist()}) == 4
    to_pivots = np.sqrt(C._squared(x[:, None], pivots)).astype(np.float32).astype(float)
    code, best, evaluated = C.nearest(x, entries, to_pivots, np.sqrt(C._squared(pivots[:, None], entries)))
    every = C._squared(x[:, None], entries)
    assert (code == every.argmin(1)).all() and (best == every.min(1)).all()
    assert evaluated < 0.4 * every.size
