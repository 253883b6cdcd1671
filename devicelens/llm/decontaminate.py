"""Operator 3: benchmark decontamination with a distributed positional inverted index.

1. The training documents are indexed: postings ``(term, row, position)``,
   terms being 64-bit word hashes. Only postings that can matter are stored:
   fixed-size bitmaps of the benchmark's adjacent word pairs (one per window
   length) keep a position only if it lies in a long enough run of such pairs.
   A bitmap may let extra positions through but never drops one.
2. Every window of the benchmark looks up its rarest term (by postings
   counts). Each posting found fixes a diagonal: where the item would lie in
   the document.
3. On each diagonal the other terms' lists, shifted by their offsets, are
   intersected with it; runs of at least a window's length are exact phrases.

A term found in a third of all documents only lengthens its own posting list,
whose join with the small seed table is split by rows, not by terms.
``proximity_matches`` asks less: all terms of a window near its rarest one.

Edge cases: a NULL or empty text has no words and no hits; an item without
words matches nothing, one shorter than a window is one window; repeated
documents are reported once per row, repeated items once per id, an item
without id marks hits but is not listed; empty tables give empty (or
uncontaminated) results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from devicelens.llm.common import WordHasher, alnum_words, materialize, mix64, text_slices, with_row_id

WINDOW = 10
# Slots of each bitmap: fixed, whatever the size of the benchmark.
BITMAP_SLOTS = 1 << 22
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _pairs(words: np.ndarray) -> np.ndarray:
    """Bitmap slots of adjacent word pairs."""
    return (mix64(words[:-1] * _GOLDEN + words[1:]) % np.uint64(BITMAP_SLOTS)).astype(np.int64)


def _slots(words: np.ndarray) -> np.ndarray:
    return (words % np.uint64(BITMAP_SLOTS)).astype(np.int64)


def benchmark_terms(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item, item_id, n, item_pos, term`` for every word of every item (materialised)."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(alnum_words())
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(2)):
                words, bounds = hasher(data, offsets)
                n = np.diff(bounds)
                rows = pa.array(np.repeat(np.arange(lo, hi), n))
                place = np.arange(len(words)) - np.repeat(bounds[:-1], n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.repeat(n, n)),
                     pa.array(place), pa.array(words.view(np.int64))], ["item", "item_id", "n", "item_pos", "term"])

    items = with_row_id(benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("text")),
                        "item").select("item", "item_id", "text")
    return materialize(items.mapInArrow(terms, "item long, item_id string, n long, item_pos long, term long"), "items")


def _bitmaps(items: DataFrame, window: int, pairs: bool) -> dict[int, np.ndarray]:
    """Bitmap by window length; at most ``window`` of ``BITMAP_SLOTS`` slots each."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, first, second = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            one, two = first.view(np.uint64), second.view(np.uint64)
            slot = _slots(one)
            for i in np.flatnonzero((size > 1) & pairs):
                slot[i] = _pairs(np.array([one[i], two[i]]))[0]
            yield pa.RecordBatch.from_arrays([pa.array(size), pa.array(slot)], ["size", "slot"])

    size = F.least(F.col("n"), F.lit(window))
    following = F.lead("term").over(Window.partitionBy("item").orderBy("item_pos"))
    first = items.select(size.alias("size"), "term", following.alias("following"))
    if pairs:
        first = first.where("size = 1 OR following IS NOT NULL")
    found = (first.select("size", "term", F.coalesce("following", F.lit(0)).alias("following"))
             .mapInArrow(slots, "size long, slot long").distinct().toPandas())
    maps = {}
    for length, group in found.groupby("size"):
        maps[int(length) if pairs else 1] = table = maps.get(1 if not pairs else int(length), np.zeros(BITMAP_SLOTS, bool))
        table[group["slot"].to_numpy()] = True
    return maps


def _kept(words: np.ndarray, bounds: np.ndarray, maps: dict[int, np.ndarray]) -> np.ndarray:
    """Words that may lie in an occurrence of a window."""
    keep = np.zeros(len(words), bool)
    if not len(words):
        return keep
    if len(words) > 1:
        pair = _pairs(words)
        inside = np.ones(len(pair), bool)
        cuts = bounds[1:-1]
        inside[cuts[(cuts > 0) & (cuts < len(words))] - 1] = False
    for length, table in maps.items():
        if length == 1:
            keep |= table[_slots(words)]
        elif len(words) > 1:
            hit = np.concatenate(([0], (table[pair] & inside).astype(np.int8), [0]))
            step = np.diff(hit)
            begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
            long = end - begin >= length - 1
            mark = np.zeros(len(words) + 2, np.int64)
            np.add.at(mark, begin[long], 1)
            np.add.at(mark, end[long] + 1, -1)
            keep |= np.cumsum(mark)[: len(words)] > 0
    return keep


def build_index(docs: DataFrame, maps: dict[int, np.ndarray], *, doc_id: str = "doc_id",
                text: str = "text") -> DataFrame:
    """One materialised row per document: ``row_id, doc_id, n_words, positions, terms``."""
    shared = docs.sparkSession.sparkContext.broadcast(maps)  # bounded by the fixed slots

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(alnum_words())
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(2)):
                words, bounds = hasher(data, offsets)
                keep = np.flatnonzero(_kept(words, bounds, shared.value))
                starts = np.searchsorted(keep, bounds)
                place = keep - np.repeat(bounds[:-1], np.diff(starts))
                lists = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(v, pa.int64()))
                         for v in (place, words[keep].view(np.int64))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo),
                     pa.array(np.diff(bounds), pa.int64()), *lists],
                    ["row_id", "doc_id", "n_words", "positions", "terms"])

    chosen = with_row_id(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    kind = docs.schema[doc_id].dataType.simpleString()
    return materialize(chosen.select("row_id", "doc_id", "text").mapInArrow(
        index, f"row_id long, doc_id {kind}, n_words long, positions array<long>, terms array<long>"), "index")


def postings(index: DataFrame) -> DataFrame:
    """The inverted index as rows ``(term, row_id, pos)``."""
    zipped = F.explode(F.arrays_zip(F.col("positions").alias("pos"), F.col("terms").alias("term")))
    return index.select("row_id", zipped.alias("p")).select("p.term", "row_id", "p.pos")


def rarest_terms(items: DataFrame, lists: DataFrame, window: int) -> DataFrame:
    """Windows that can occur, with their rarest term: ``item, n, start, size, term, item_pos``."""
    counts = lists.groupBy("term").agg(F.count(F.lit(1)).alias("found"))
    known = items.join(counts, "term", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    size = F.least(F.col("n"), F.lit(window))
    ahead = Window.partitionBy("item").orderBy("item_pos").rowsBetween(0, window - 1)
    rarest = F.min(F.struct("found", "item_pos", "term")).over(ahead)
    return (known.select("item", "n", F.col("item_pos").alias("start"), size.alias("size"), rarest.alias("r"))
            .where("start <= n - size AND r.found > 0")
            .select("item", "n", "start", "size", "r.term", "r.item_pos"))


def phrase_matches(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, doc_id: str = "doc_id",
                   item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(index, runs): all maximal runs of words equal to an item's, a window or longer.

    Runs hold ``row_id, item, item_id, pos, length``: the document's words
    ``pos .. pos + length - 1`` equal consecutive words of the item.
    """
    items = benchmark_terms(benchmark, item_id, text)
    index = build_index(docs, _bitmaps(items, window, pairs=True), doc_id=doc_id, text=text)
    lists = postings(index)
    seeds = materialize(rarest_terms(items, lists, window).select("term", "item", "item_pos").distinct(), "seeds")
    diagonals = (lists.join(seeds, "term")
                 .select("row_id", "item", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct())
    expected = (diagonals.join(items, "item")
                .select("row_id", "item", "item_id", "n", "shift", "item_pos", "term",
                        (F.col("shift") + F.col("item_pos")).alias("pos")))
    equal = expected.join(lists, ["row_id", "pos", "term"])
    line = Window.partitionBy("row_id", "item", "shift").orderBy("item_pos")
    runs = (equal.withColumn("run", F.col("item_pos") - F.row_number().over(line))
            .groupBy("row_id", "item", "shift", "run")
            .agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("length"), F.first("n").alias("n"),
                 F.first("item_id").alias("item_id"))
            .where(F.col("length") >= F.least(F.col("n"), F.lit(window)))
            .select("row_id", "item", "item_id", "pos", "length"))
    return index, runs


def proximity_matches(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, reach: int = 20,
                      doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Windows all of whose terms lie within ``reach`` words of their rarest term.

    Returns ``row_id, doc_id, item_id, start, pos``: window ``start`` of the
    item around document word ``pos``, in any order.
    """
    items = benchmark_terms(benchmark, item_id, text)
    index = build_index(docs, _bitmaps(items, window, pairs=False), doc_id=doc_id, text=text)
    lists = postings(index)
    windows = rarest_terms(items, lists, window)
    asked = (windows.alias("w").join(items.alias("i"), (F.col("w.item") == F.col("i.item"))
                                     & F.expr("i.item_pos BETWEEN w.start AND w.start + w.size - 1"))
             .select("w.item", "i.item_id", "w.start", F.col("w.term").alias("seed"), "i.term").distinct())
    wanted = asked.groupBy("item", "start").agg(F.count(F.lit(1)).alias("wanted"))
    seeds = lists.join(asked.select("item", "item_id", "start", F.col("seed").alias("term")).distinct(), "term")
    near = (seeds.withColumnRenamed("term", "seed").join(asked.drop("item_id"), ["item", "start", "seed"])
            .join(lists.withColumnRenamed("pos", "other"), ["row_id", "term"])
            .where(F.abs(F.col("other") - F.col("pos")) <= reach)
            .groupBy("row_id", "item", "item_id", "start", "pos").agg(F.count_distinct("term").alias("got")))
    return (near.join(wanted, ["item", "start"]).where("got = wanted")
            .join(index.select("row_id", "doc_id"), "row_id").select("row_id", "doc_id", "item_id", "start", "pos"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, doc_id: str = "doc_id",
                  item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``row_id, doc_id, n_words, n_hit, items, contaminated`` per document (one row per input row)."""
    index, runs = phrase_matches(docs, benchmark, window=window, doc_id=doc_id, item_id=item_id, text=text)
    runs = materialize(runs, "runs")
    hit = (runs.select("row_id", F.explode(F.expr("sequence(pos, pos + length - 1)")).alias("pos")).distinct()
           .groupBy("row_id").agg(F.count(F.lit(1)).alias("n_hit")))
    named = runs.groupBy("row_id").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    return (index.select("row_id", "doc_id", "n_words").join(hit.join(named, "row_id"), "row_id", "left")
            .select("row_id", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                    F.col("n_hit").isNotNull().alias("contaminated")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside occurrences of 10-word benchmark windows."""
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                          spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS phrase
  FROM b, unnest(range(1, greatest(len(w) - least(len(w), 10), 0) + 2)) AS u(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT doc_id, size, s, array_to_string(w[s : s + size - 1], ' ') AS phrase
  FROM d, sizes, unnest(range(1, greatest(len(w) - size + 2, 1))) AS u(s)),
m AS (SELECT dw.doc_id, dw.s, dw.size, bw.item_id FROM dw JOIN bw USING (size, phrase)),
hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, unnest(range(s, s + size)) AS u(p) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
    string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
  FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""
