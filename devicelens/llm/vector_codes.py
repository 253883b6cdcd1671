"""Operator 12: vector code compression by part codebooks, assigned with LAESA pivots.

Vectors become whole numbers and are cut into equal parts; each part position
has a codebook. Some entries of the first codebooks, far from each other, are
fixed pivots. The distances of every part to them are computed once and stored
with the vector. In each round only the distances between pivots and the
current entries are new: by the triangle inequality ``|d(x, p) - d(p, e)|``
bounds ``d(x, e)`` from below. A part visits the entries in the order of that
bound, evaluates them exactly (in whole numbers) and stops at the first one
whose bound exceeds the best distance found.

A round is one pass over the stored table, whose tasks return one sum and count
per entry (a fixed size); the new entries are made of those on the driver.
Nothing else leaves the executors.

Edge cases: vectors that are NULL or hold NULL or non-finite components are
dropped; shorter vectors, and lengths that the parts don't divide, are filled up
with zeros; vectors without components have parts without components and no
error; repeated rows are coded each; rows with a NULL id come last in the order
of ids, equal ids are ordered by their vectors; fewer rows than entries make
smaller codebooks; an empty table gives an empty result; components too large
for 64-bit errors are refused; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from devicelens.llm.common import bound_arrow_batches, materialize
from devicelens.llm.vectors import blobs, extent, matrix, padded, sound, unblob, whole

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
PIVOTS = 4
ROWS_AT_ONCE = 2048
SALT = 16  # rows of one label are dealt over so many keys


def _squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    return ((x - entries) ** 2).sum(-1)


def choose_pivots(entries: np.ndarray, number: int) -> np.ndarray:
    """Entries of one codebook, each as far as possible from those chosen before."""
    chosen, far = [0], _squared(entries, entries[0])
    while len(chosen) < min(number, len(entries)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _squared(entries, entries[chosen[-1]]))
    return entries[chosen]


def nearest(x: np.ndarray, entries: np.ndarray, to_pivots: np.ndarray, pivot_entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest entry, squared distance, evaluations) of each part; ties go to the lower index.

    ``to_pivots`` holds the parts' distances to the pivots, ``pivot_entry`` the pivots' to the entries.
    """
    bound = np.zeros((len(x), len(entries)))
    for p in range(len(pivot_entry)):
        np.maximum(bound, np.abs(to_pivots[:, p, None] - pivot_entry[p]), out=bound)
    # Stored distances are rounded to 24 bits: nothing is pruned within that error.
    bound -= 4e-7 * (1 + float(pivot_entry.max(initial=0)) + float(to_pivots.max(initial=0)))
    order = np.argsort(bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, 1)
    code, best = order[:, 0].copy(), _squared(x, entries[order[:, 0]])
    open_rows, evaluated = np.arange(len(x)), len(x)
    for turn in range(1, len(entries)):
        open_rows = open_rows[bound[open_rows, turn] <= np.sqrt(best[open_rows])]
        if not len(open_rows):
            break
        tried = order[open_rows, turn]
        distance = _squared(x[open_rows], entries[tried])
        better = (distance < best[open_rows]) | ((distance == best[open_rows]) & (tried < code[open_rows]))
        code[open_rows[better]], best[open_rows[better]] = tried[better], distance[better]
        evaluated += len(open_rows)
    return code, best, evaluated


def _assigned(batches: Iterator[pa.RecordBatch], books: np.ndarray, pivots: np.ndarray):
    """(batch, parts, codes, squared distances) for some rows of the stored table at a time."""
    parts, _, width = books.shape
    pivot_entry = np.sqrt(_squared(pivots[:, :, None], books[:, None, :]))
    for batch in batches:
        for lo in range(0, len(batch), ROWS_AT_ONCE):
            some = batch.slice(lo, ROWS_AT_ONCE)
            x = unblob(some.column("parts"), np.int32, parts, width).astype(np.int64)
            to_pivots = unblob(some.column("to_pivots"), np.float32, parts, pivots.shape[1]).astype(np.float64)
            found = [nearest(x[:, j], books[j], to_pivots[:, j], pivot_entry[j])[:2] for j in range(parts)]
            yield some, x, np.stack([c for c, _ in found], 1), np.stack([d for _, d in found], 1)


def _stored(rows: DataFrame, length: int, parts: int, pivots: np.ndarray) -> DataFrame:
    """``vec_id, label, parts, to_pivots``: the parts and their distances to the pivots, computed once."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), ROWS_AT_ONCE):
                some = batch.slice(lo, ROWS_AT_ONCE)
                x = matrix(some.column("ints"), length).reshape(len(some), parts, length // parts)
                to_pivots = np.sqrt(_squared(x[:, :, None], pivots)).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [some.column("vec_id"), some.column("label"), blobs(x.astype(np.int32)), blobs(to_pivots)],
                    ["vec_id", "label", "parts", "to_pivots"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    chosen = rows.select("vec_id", "label", padded(F.col("ints"), length).alias("ints"))
    return materialize(chosen.mapInArrow(
        measure, f"vec_id {kinds['vec_id']}, label {kinds['label']}, parts binary, to_pivots binary"), "parts")


def _sums(table: DataFrame, books: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(component sums, parts) of every entry, added up over all rows."""
    parts, entries, width = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)  # the last place counts
        for _, x, codes, _ in _assigned(batches, books, pivots):
            ones = np.concatenate([x, np.ones((*x.shape[:2], 1), np.int64)], 2)
            np.add.at(total, (np.arange(parts)[None, :], codes), ones)
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(total.ravel()[place], pa.int64())], ["place", "value"])

    total = np.zeros((parts, entries, width + 1), np.int64)
    for r in table.mapInArrow(add, "place long, value long").groupBy("place").agg(F.sum("value").alias("value")).collect():
        total.flat[r["place"]] = r["value"]  # one number per component of an entry
    return total[..., :width], total[..., width]


def compress(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
             pivots: int = PIVOTS, vec_id: str = "vec_id", embedding: str = "embedding",
             label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(``vec_id, label, code, error`` of every kept row, codebooks by part, entry and component)."""
    bound_arrow_batches(vectors.sparkSession)
    rows = vectors.where(sound(F.col(embedding))).select(
        F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), whole(F.col(embedding), scale).alias("ints"))
    _, longest, _ = extent(rows, "ints", 62)
    length = -(-longest // parts) * parts
    # The first entries: a bounded number of rows.
    first = rows.select("vec_id", padded(F.col("ints"), length).alias("ints")).orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries)
    start = np.array([r["ints"] for r in first.collect()], np.int64)
    if not len(start):
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    books = start.reshape(len(start), parts, length // parts).transpose(1, 0, 2).copy()
    fixed = np.stack([choose_pivots(book, pivots) for book in books])
    table = _stored(rows, length, parts, fixed)
    for _ in range(rounds):
        sums, counts = _sums(table, books, fixed)
        used = counts > 0
        books[used] = sums[used] // counts[used][:, None]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, _, codes, distances in _assigned(batches, books, fixed):
            yield pa.RecordBatch.from_arrays(
                [some.column("vec_id"), some.column("label"), pa.array([c.astype(np.uint8).tobytes().hex() for c in codes], pa.string()),
                 pa.array(distances.sum(1), pa.int64())], ["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return table.mapInArrow(code, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """``label_error``: the error added up over rows of the same label, NULL labels together.

    A label may hold most of all rows, so labels are joined with a salt.
    """
    totals = (coded.groupBy("label").agg(F.sum("error").alias("label_error"))
              .select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("for")))
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALT)).cast("int"))
    return (salted.join(totals.hint("merge"), F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("for")))
            .drop("of", "for", "salt"))


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all embeddings."""
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return with_label_error(materialize(coded, "codes")).select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    steps, parts, entries = [], PARTS, ENTRIES
    for turn in range(ROUNDS + 1):
        steps.append(f"""
assigned{turn} AS (
  SELECT row, j, e, d FROM (
    SELECT x.row, x.j, b.e, list_sum(list_transform(list_zip(x.p, b.p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM cut x JOIN book{turn} b USING (j)) AS every
  QUALIFY row_number() OVER (PARTITION BY row, j ORDER BY d, e) = 1)""")
        if turn < ROUNDS:
            steps.append(f"""
mean{turn} AS (
  SELECT j, e, list(v ORDER BY i) AS p FROM (
    SELECT j, e, i, (s - ((s % n) + n) % n) // n AS v FROM (
      SELECT a.j, a.e, i, sum(x.p[i])::BIGINT AS s, count(*) AS n
      FROM assigned{turn} a JOIN cut x USING (row, j), unnest(range(1, len(x.p) + 1)) AS u(i) GROUP BY ALL) AS sums) AS floors GROUP BY j, e),
book{turn + 1} AS (
  SELECT b.j, b.e, coalesce(m.p, b.p) AS p FROM book{turn} b LEFT JOIN mean{turn} m USING (j, e))""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * {SCALE}) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
cut AS (
  SELECT row, j, v[j * (len(v) // {parts}) + 1 : (j + 1) * (len(v) // {parts})] AS p FROM kept, unnest(range({parts})) AS u(j)),
book0 AS (SELECT j, row - 1 AS e, p FROM cut WHERE row <= {entries}),{",".join(steps)},
coded AS (
  SELECT row, string_agg(lower(printf('%02x', e::INT)), '' ORDER BY j) AS code, sum(d)::BIGINT AS error FROM assigned{ROUNDS} GROUP BY row),
digest AS (
  SELECT sha256(string_agg(array_to_string(p, ','), ',' ORDER BY j, e)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (row), digest
"""


ORACLE_SQL = _oracle()
