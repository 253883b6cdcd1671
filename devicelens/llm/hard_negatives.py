"""Operator 13: hard-negative mining with an inverted multi-index.

Vectors become whole numbers; a score is an inner product. Two codebooks, one
for each half of the components, form cells: a row lies in the cell of its two
nearest half entries. The codebooks are fitted on at most ``SAMPLE`` rows (those
of smallest id hash); every row is indexed. Rows are dealt by a hash of their id
into shards of a bounded number of components, each stored as one row sorted by
cell and label, with the largest distance of its rows from each half entry.

For an anchor, an entry's inner product plus the anchor's length times that
radius bounds the half scores of the entry's rows. A heap visits the cells by
the sum of the two half bounds, best first (the multi-sequence order), and
scores whole cells exactly. An anchor's best positives are final once the last
of them scores above the next cell's bound; a window of negative scores is
certified once its last wanted row does, or once the bound falls below the
window. What earlier shards of a task found goes on counting, and the tasks'
short lists are merged at the end, so results equal a full search.

Anchors are a stated set of queries: they go through the shards in blocks of a
bounded number of components, one broadcast at a time.

Edge cases: rows with a NULL id, label or vector, or with NULL or non-finite
components, take no part; shorter vectors count as filled up with zeros; rows
that share an id count as one (least label, then least vector); an anchor
without positives, or whose window holds nothing, gives no row; an empty table
gives an empty result; components too large for 64-bit scores are refused; extra
columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from devicelens.llm.common import bound_arrow_batches, materialize, sample_hash
from devicelens.llm.vectors import extent, matrix, padded, sound, whole

SCALE = 256
HALF_ENTRIES = 8  # of each codebook; cells are its square
SAMPLE, FIT_ROUNDS = 4096, 6
SHARD_VALUES = 1 << 20  # components in a shard, about
BLOCK_VALUES = 1 << 20  # components in a block of anchors, about
INDEX = "shard int, ids binary, labels binary, cells binary, vectors binary, radii binary"


def fit_halves(sample: np.ndarray, entries: int = HALF_ENTRIES, rounds: int = FIT_ROUNDS) -> list[np.ndarray]:
    """A codebook of each half of the components, by k-means."""
    half, books = sample.shape[1] // 2, []
    for x in (sample[:, :half].astype(float), sample[:, half:].astype(float)):
        book = x[np.linspace(0, len(x) - 1, min(entries, len(x))).astype(int)].copy()
        for _ in range(rounds):
            of = nearest_entry(x, book)
            for e in np.unique(of):
                book[e] = x[of == e].mean(0)
        books.append(book)
    return books


def nearest_entry(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book**2).sum(1) - 2 * x @ book.T).argmin(1)


def best_cells(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(bound, i, j) of all pairs of half entries, greatest sum of half bounds first."""
    a, b = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
    u, v = first.tolist(), second.tolist()
    heap, seen = [(-u[a[0]] - v[b[0]], 0, 0)], {(0, 0)}
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, a[i], b[j]
        for step in ((i + 1, j), (i, j + 1)):
            if step[0] < len(a) and step[1] < len(b) and step not in seen:
                seen.add(step)
                heapq.heappush(heap, (-u[a[step[0]]] - v[b[step[1]]], *step))


class Shard:
    """One stored row of the index."""

    def __init__(self, row: dict, books: list[np.ndarray], length: int):
        self.books, self.width = books, len(books[1])
        self.ids, self.labels = (np.frombuffer(row[k], np.int64) for k in ("ids", "labels"))
        self.cells, self.radii = np.frombuffer(row["cells"], np.int64), np.frombuffer(row["radii"], float)
        self.rows = np.frombuffer(row["vectors"], np.int32).reshape(-1, length)
        # Products below 2**53 are exact as floats; larger ones are made of whole numbers.
        small = length * int(np.abs(self.rows).max(initial=0)) < 2**22
        self.rows = self.rows.astype(float if small else np.int64)
        self.by_label: dict[tuple[int, int], tuple[int, int]] = {}
        of = np.repeat(np.arange(len(self.cells) - 1), np.diff(self.cells))
        starts = np.flatnonzero(np.r_[True, (np.diff(of) != 0) | (np.diff(self.labels) != 0)])
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(of)]):
            self.by_label[int(of[lo]), int(self.labels[lo])] = (lo, hi)

    def half_bounds(self, anchors: np.ndarray) -> list[np.ndarray]:
        """Upper bounds of the half scores, by anchor and entry."""
        half, out, at = self.books[0].shape[1], [], 0
        for book, q in zip(self.books, (anchors[:, :half].astype(float), anchors[:, half:].astype(float))):
            radius, at = self.radii[at : at + len(book)], at + len(book)
            bound = q @ book.T + np.sqrt((q**2).sum(1))[:, None] * radius
            out.append(bound + 1e-9 * (1 + np.abs(bound)) + 0.01)  # scores are whole, bounds are rounded
        return out

    def scores(self, lo: int, hi: int, anchor: np.ndarray) -> np.ndarray:
        """Inner products (whole numbers) with an anchor of the rows' type."""
        return self.rows[lo:hi] @ anchor


def _shard_of(books: list[np.ndarray], length: int):
    """Builds one index row of a shard's rows."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        x, half = matrix(table.column("ints"), length), books[0].shape[1]
        ids, labels = (table.column(k).to_numpy().astype(np.int64) for k in ("vec_id", "label"))
        cell, radii = np.zeros(len(x), np.int64), []
        for book, part in zip(books, (x[:, :half].astype(float), x[:, half:].astype(float))):
            of = nearest_entry(part, book)
            far, radius = np.sqrt(((part - book[of]) ** 2).sum(1)), np.zeros(len(book))
            np.maximum.at(radius, of, far)
            cell = cell * len(book) + of
            radii.append(radius)
        order = np.lexsort((ids, labels, cell))
        cells = np.searchsorted(cell[order], np.arange(len(books[0]) * len(books[1]) + 1))
        blobs = {"ids": ids[order], "labels": labels[order], "cells": cells.astype(np.int64), "vectors": x[order].astype(np.int32),
                 "radii": np.concatenate(radii)}
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32())} | {k: pa.array([v.tobytes()], pa.binary()) for k, v in blobs.items()})

    return build


def _shards(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], length: int) -> Iterator[Shard]:
    for batch in batches:
        for i in range(len(batch)):
            yield Shard(batch.slice(i, 1).to_pylist()[0], books, length)


def _merge(best: list[tuple[int, int]], scores: np.ndarray, ids: np.ndarray, most: int) -> list[tuple[int, int]]:
    """The first ``most`` of ``(-score, id)`` in ``best`` and the new rows."""
    if len(scores) > most:
        first = np.lexsort((ids, -scores))[:most]
        scores, ids = scores[first], ids[first]
    return sorted(best + [(-int(s), i) for s, i in zip(scores.tolist(), ids.tolist())])[:most]


class Block:
    """Anchors that meet all shards together."""

    def __init__(self, table: pa.Table, length: int):
        self.ids, self.labels = (table.column(k).to_numpy().astype(np.int64) for k in ("vec_id", "label"))
        self.vectors = matrix(table.column("ints"), length)

    def positives(self, shards: Iterator[Shard], most: int) -> list[list[tuple[int, int]]]:
        """The best other rows of each anchor's label."""
        best: list[list[tuple[int, int]]] = [[] for _ in self.ids]
        for shard in shards:
            first, second = shard.half_bounds(self.vectors)
            anchors = self.vectors.astype(shard.rows.dtype)
            for a, (own, label) in enumerate(zip(self.ids.tolist(), self.labels.tolist())):
                for bound, i, j in best_cells(first[a], second[a]):
                    if len(best[a]) == most and -best[a][-1][0] > bound:
                        break
                    lo, hi = shard.by_label.get((i * shard.width + j, label), (0, 0))
                    if lo == hi:
                        continue
                    scores, ids = shard.scores(lo, hi, anchors[a]), shard.ids[lo:hi]
                    wanted = ids != own
                    if len(best[a]) == most:
                        wanted &= scores >= -best[a][-1][0]
                    if wanted.any():
                        best[a] = _merge(best[a], scores[wanted], ids[wanted], most)
        return best

    def negatives(self, shards: Iterator[Shard], windows: list[list[tuple[int, int]]], most: int) -> list[list[list[tuple[int, int]]]]:
        """The best rows of other labels in each anchor's windows ``(least, greatest score)``."""
        best = [[[] for _ in of] for of in windows]
        for shard in shards:
            first, second = shard.half_bounds(self.vectors)
            anchors = self.vectors.astype(shard.rows.dtype)
            for a, label in enumerate(self.labels.tolist()):
                # What a row has to score to enter a window's list, while the window is open.
                need = [max(least, -found[-1][0]) if len(found) == most else least
                        for (least, _), found in zip(windows[a], best[a])]
                open_ = [w for w, (least, greatest) in enumerate(windows[a]) if least <= greatest]
                if not open_:
                    continue
                for bound, i, j in best_cells(first[a], second[a]):
                    open_ = [w for w in open_ if need[w] <= bound]
                    if not open_:
                        break
                    cell = i * shard.width + j
                    lo, hi = shard.cells[cell], shard.cells[cell + 1]
                    if lo == hi:
                        continue
                    scores = shard.scores(lo, hi, anchors[a])
                    # Few rows lie in any open window: they alone are looked at window by window.
                    near = np.flatnonzero((scores >= min(need[w] for w in open_)) & (scores <= max(windows[a][w][1] for w in open_)))
                    near = near[shard.labels[lo + near] != label]
                    if not len(near):
                        continue
                    scores, ids = scores[near], shard.ids[lo + near]
                    for w in open_:
                        inside = (scores >= need[w]) & (scores <= windows[a][w][1])
                        if inside.any():
                            found = best[a][w] = _merge(best[a][w], scores[inside], ids[inside], most)
                            if len(found) == most:
                                need[w] = max(need[w], -found[-1][0])
        return best


def _rows(columns: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns.values()], list(columns))


def build_index(rows: DataFrame, length: int, count: int) -> tuple[DataFrame, list[np.ndarray]]:
    """(index of all rows ``vec_id, label, ints``, the two codebooks)."""
    sample = rows.orderBy(sample_hash("vec_id"), "vec_id").limit(SAMPLE).select("ints").toArrow()
    books = fit_halves(matrix(sample.column("ints"), length))
    shards = max(1, -(-count * length // SHARD_VALUES))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit("shard")), F.lit(shards)).cast("int"))
    return materialize(dealt.groupBy("shard").applyInArrow(_shard_of(books, length), INDEX), "index"), books


def mine(vectors: DataFrame, anchor: Column, *, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95,
         scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows for which ``anchor`` (over the columns ``vec_id`` and
    ``label``) holds. A negative's score lies between ``least`` and ``most``
    percent of the positive's.
    """
    spark = vectors.sparkSession
    bound_arrow_batches(spark)
    named = vectors.where(sound(F.col(embedding))).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), whole(F.col(embedding), scale).alias("ints"))
    one = (named.where("vec_id IS NOT NULL AND label IS NOT NULL").groupBy("vec_id")
           .agg(F.min(F.struct("label", "ints")).alias("r")).select("vec_id", "r.label", "r.ints"))
    one = materialize(one, "vectors")
    count, longest, _ = extent(one, "ints", 62)
    length = max(2, longest + longest % 2)
    rows = one.select("vec_id", "label", padded(F.col("ints"), length).alias("ints"))
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not count:
        return empty
    index, books = build_index(rows, length, count)
    asked = rows.where(anchor)
    blocks = max(1, -(-asked.count() * length // BLOCK_VALUES))
    found = []
    for number in range(blocks):
        table = asked.where(F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)) == number).toArrow()  # a bounded block
        if not table.num_rows:
            continue
        block = spark.sparkContext.broadcast(Block(table, length))

        def best(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            lists = block.value.positives(_shards(batches, books, length), positives)
            every = [(a, p, -s) for a, of in zip(block.value.ids.tolist(), lists) for s, p in of]
            yield _rows(dict(zip(("anchor_id", "positive_id", "positive_score"), zip(*every) if every else ((), (), ()))))

        by = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
        pairs = materialize(index.mapInArrow(best, "anchor_id long, positive_id long, positive_score long")
                            .withColumn("place", F.row_number().over(by)).where(F.col("place") <= positives).drop("place"), "positives")
        of: dict[int, list[tuple[int, int]]] = {}
        for r in pairs.collect():  # a few per anchor of the block
            of.setdefault(r["anchor_id"], []).append((r["positive_id"], r["positive_score"]))
        wanted = spark.sparkContext.broadcast([of.get(a, []) for a in block.value.ids.tolist()])

        def within(batches: Iterator[pa.RecordBatch], block=block, wanted=wanted) -> Iterator[pa.RecordBatch]:
            windows = [[(-(-least * s // 100), most * s // 100) for _, s in pairs] for pairs in wanted.value]
            lists = block.value.negatives(_shards(batches, books, length), windows, negatives)
            every = [(a, p, n, ps, -s) for a, pairs, found in zip(block.value.ids.tolist(), wanted.value, lists)
                     for (p, ps), rows in zip(pairs, found) for s, n in rows]
            names = ("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score")
            yield _rows(dict(zip(names, zip(*every) if every else ((),) * 5)))

        by = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
        mined = index.mapInArrow(within, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
        found.append(materialize(mined.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= negatives).select(*empty.columns), "negatives"))
    result = found[0] if found else empty
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of all embeddings whose id is divisible by 50, labels shifted where it is divisible by 7."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 50 == 0)


ORACLE_SQL = f"""
WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * {SCALE}) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS alike,
    list_sum(list_transform(list_zip(a.v, r.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM kept a JOIN kept r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
positive AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
