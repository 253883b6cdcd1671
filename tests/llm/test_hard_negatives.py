"""Hard negatives against a full search, and their edge cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from devicelens.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, positives=5, negatives=3, least=50, most=95):
    kept = {i: ([math.floor(256 * x) for x in v], label) for i, v, label in rows
            if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a, (v, label) in kept.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other == label) for i, (w, other) in kept.items() if i != a)
        for ps, p in [(-s, i) for s, i, alike in scored if alike][:positives]:
            hard = [(-s, i) for s, i, alike in scored if not alike and least * ps <= -100 * s <= most * ps]
            out += [(a, p, n + 1, i, ps, s) for n, (s, i) in enumerate(hard[:negatives])]
    return sorted(out)


def mined(frame, every, **options):
    return sorted(tuple(r) for r in H.mine(frame, F.col("vec_id") % every == 0, **options).collect())


@pytest.mark.parametrize("values", [1 << 20, 512])
def test_equals_a_full_search(spark, monkeypatch, values):
    monkeypatch.setattr(H, "SHARD_VALUES", values)  # also many shards and blocks
    monkeypatch.setattr(H, "BLOCK_VALUES", values)
    rng = random.Random(values)
    centres = [[rng.gauss(0, 1) for _ in range(9)] for _ in range(4)]
    rows = []
    for i in range(220):
        c = rng.choice(centres)
        rows.append((i, [x + rng.gauss(0, 0.2) for x in c] if rng.random() < 0.8 else [round(x) / 2 for x in c], rng.choice([0, 1, 2, None])))
    rows += [(1000, None, 1), (1001, [None] * 9, 1), (1010, [float("nan")] * 9, 2), (None, [1.0] * 9, 1)]
    want = brute(rows, 10)
    assert want and mined(spark.createDataFrame(rows, SCHEMA), 10) == want


def test_other_windows_and_numbers(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)], i % 3) for i in range(80)]
    options = dict(positives=2, negatives=4, least=10, most=60)
    assert mined(spark.createDataFrame(rows, SCHEMA), 4, **options) == brute(rows, 4, **options)


def test_edges(spark):
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.7], 2), (3, [0.75, 0.0], 2), (5, [0.5, 0.5], None), (7, [], 3)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' AS rank", "'clash' AS ints", "'clash' AS shard", "'clash' AS anchor_id")
    want = [(0, 1, 1, 3, 81920, 49152), (0, 1, 2, 2, 81920, 45824)]
    assert mined(frame, 50) == want
    assert mined(frame.unionByName(frame), 50) == want  # rows that share an id count as one
    assert mined(frame.where("vec_id > 0"), 50) == []
    assert mined(frame.where("false"), 50) == []
    with pytest.raises(ValueError, match="64-bit"):
        mined(spark.createDataFrame([(0, [1e30], 1)], SCHEMA), 50)


def test_cells_come_in_order_of_their_bounds():
    rng = np.random.default_rng(1)
    first, second = rng.normal(size=7), rng.normal(size=5)
    cells = list(H.best_cells(first, second))
    assert len({(i, j) for _, i, j in cells}) == 35
    assert [b for b, _, _ in cells] == sorted((first[:, None] + second).ravel().tolist(), reverse=True)


def test_bounds_stop_the_search():
    rng = np.random.default_rng(4)
    x = (np.repeat(rng.normal(size=(8, 8)) * 400, 40, 0) + rng.normal(size=(320, 8)) * 4).round().astype(np.int64)
    books = H.fit_halves(x)
    labels = np.arange(320) // 40
    import pyarrow as pa

    table = pa.table({"vec_id": np.arange(320), "label": labels, "ints": pa.array(x.tolist())})
    shard = H.Shard(H._shard_of(books, 8)((pa.scalar(0),), table).to_pylist()[0], books, 8)
    scored = []
    plain = shard.scores
    shard.scores = lambda lo, hi, q: scored.append(hi - lo) or plain(lo, hi, q)
    block = H.Block(table.slice(0, 1), 8)
    found = block.positives(iter([shard]), 5)[0]
    assert [i for _, i in found] == sorted(range(1, 40), key=lambda i: (-(x[i] @ x[0]), i))[:5]
    assert sum(scored) <= 40  # of 320 rows
