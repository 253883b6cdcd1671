"""Helpers shared by the corpus operators: materialising, Arrow text access, word hashing."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Text bytes handled at once by vectorised steps; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder ``spark.checkpoint.dir``.

    Only where it is unset on a local master (tests) is a scratch folder made;
    on a cluster an unset folder is an error, because a machine-local folder
    would not be seen by the other machines.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="corpus-ckpt-")
    atexit.register(shutil.rmtree, folder, True)
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    Cuts lineage (a lost executor costs no recomputation of what lies before)
    and keeps column pruning, which an RDD checkpoint would not.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Add a unique row number; materialise before relying on it twice."""
    return df.withColumn(name, F.monotonically_increasing_id())


def crc32_remainder(doc_id: str, modulus: int):
    """crc32 of the id's text modulo ``modulus`` (NULL id: of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def text_slices(column, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over an Arrow string column.

    NULL counts as empty. Slices hold at most ``limit`` bytes unless one text
    is longer by itself; texts are never cut.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    arr = pc.fill_null(column, "").cast(pa.large_binary())
    buffers = arr.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(arr):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def ascii_lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


class WordHasher:
    """64-bit hashes of all words of many texts at once.

    ``is_word`` marks the bytes that belong to words; A-Z is lower-cased
    first. A word's hash is the sum of its bytes times one random 64-bit
    coefficient per position, mixed with its length.
    """

    def __init__(self, is_word: np.ndarray):
        self.is_word, self.lower = is_word, ascii_lower_table()
        self.coef = mix64(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words in order, first word of each text and the end)."""
        mask = self.is_word[data]
        start = mask.copy()
        start[1:] &= ~mask[:-1]
        heads = offsets[:-1][np.diff(offsets) > 0]
        start[heads] = mask[heads]
        begin = np.flatnonzero(start)
        bounds = np.searchsorted(begin, offsets)
        if not len(begin):
            return np.zeros(0, np.uint64), bounds
        first = np.flatnonzero(start[mask])  # of each word, among word bytes only
        letters = self.lower[data[mask]].astype(np.uint64)
        lengths = np.diff(np.append(first, len(letters)))
        longest = int(lengths.max())
        if longest > len(self.coef):
            self.coef = mix64(np.arange(1, 2 * longest + 1, dtype=np.uint64) * _GOLDEN)
        place = np.arange(len(letters)) - np.repeat(first, lengths)
        letters += np.uint64(1)
        letters *= self.coef[place]
        return mix64(np.add.reduceat(letters, first) ^ lengths.astype(np.uint64) * _GOLDEN), bounds


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive word hashes (all as one if fewer)."""
    size = min(n, len(words))
    if not size:
        return words
    out = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        out = mix64(out * _GOLDEN + words[i : len(words) - size + 1 + i])
    return out


def space_words() -> np.ndarray:
    """Bytes of words ``[^\\x20\\x09-\\x0D]+``."""
    table = np.ones(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def alnum_words() -> np.ndarray:
    """Bytes of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing."""
    table = np.zeros(256, bool)
    for lo, hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
        table[lo:hi] = True
    return table


def bound_arrow_batches(spark: SparkSession, size: int = 64 << 20) -> None:
    """Let Arrow batches hold at most ``size`` bytes where the session sets no limit of its own.

    The default bounds only their rows, and 10,000 long texts don't fit.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("bB")) >= 2**31 - 1:
        spark.conf.set(key, str(size))


def uint64_sets(column) -> list[np.ndarray]:
    """The 64-bit values in each row of an Arrow binary column."""
    arr = column.cast(pa.large_binary())
    buffers = arr.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return [np.frombuffer(data[lo:hi].tobytes(), np.uint64) for lo, hi in zip(offsets[:-1], offsets[1:])]


def sample_hash(doc_id: str):
    """A number below 2**31 by which samples are ordered."""
    return F.pmod(F.xxhash64(doc_id), F.lit(1 << 31))


def sampled_ids(pairs: DataFrame, wanted: int, of: str) -> DataFrame:
    """At most ``wanted`` distinct ids of each class ``of``: those with the smallest hashes.

    ``pairs`` holds ``of`` and ``doc_id``, in any number of rows. A class's
    distinct ids are estimated first; only rows whose hash can be among the
    first are then shuffled and ranked (about twice as many ids as wanted), so
    neither a large class nor an id with very many rows meets in one task.
    """
    sizes = pairs.groupBy(of).agg(F.approx_count_distinct("doc_id").alias("n")).collect()  # one row a class
    reach = [(r[of], min(1.0, (2 * wanted + 100) / max(1, r["n"]))) for r in sizes]
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in reach for x in pair]), F.col(of)) if reach else F.lit(0.0)
    near = pairs.where(sample_hash("doc_id") < limit * float(1 << 31)).select(of, "doc_id").distinct()
    first = Window.partitionBy(of).orderBy(sample_hash("doc_id"), "doc_id")
    return materialize(near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= wanted).select(of, "doc_id"), "chosen")


def sampled_texts(rows: DataFrame, chosen: DataFrame, of: str, most_bytes: int) -> DataFrame:
    """``doc_id, of, text`` of the chosen ids: one text each, that of least hash where an id has several.

    Texts of a class are taken in the order of their ids' hashes until they hold ``most_bytes`` bytes.
    """
    keys = [c for c in chosen.columns if c in rows.columns]
    one = rows.join(F.broadcast(chosen), keys).groupBy(of, "doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    before = Window.partitionBy(of).orderBy(sample_hash("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.sum(F.octet_length("text").cast("long")).over(before), F.lit(0))
    return materialize(one.withColumn("held", held).where(F.col("held") < most_bytes).select("doc_id", of, "text"), "sample")


# Bytes of the sampled texts of one class; the text that reaches it is the last one.
SAMPLE_BYTES = 64 << 20


def labelled_sample(docs: DataFrame, per_class: int, *, labels: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text",
                    label: str = "label", most_bytes: int = SAMPLE_BYTES) -> tuple[DataFrame, dict[int, int]]:
    """(sample, labelled ids per class): ``doc_id, label, text`` of at most ``per_class`` ids and ``most_bytes`` of each class.

    Labels 0 and 1 come from ``labels`` or from ``docs`` itself; the ids with
    the smallest hashes are taken, each with one text. Only ids meet the labels;
    the texts are then picked by the sample, whose size is bounded. Rows with a
    NULL id, text or label are not used; an id with both labels is in both classes.
    """
    rows = docs.where(F.col(text).isNotNull() & F.col(doc_id).isNotNull())
    as_label = F.col(label).cast("int").alias("label")
    if labels is None:
        rows = rows.select(F.col(doc_id).alias("doc_id"), as_label, F.col(text).alias("text"))
        pairs = rows.select("doc_id", "label").distinct()
    else:
        of = labels.select(F.col(doc_id).alias("doc_id"), as_label).distinct()
        rows = rows.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
        pairs = rows.select("doc_id").distinct().join(of, "doc_id")
    pairs = pairs.where(F.col("label").isin(0, 1))
    sizes = {r["label"]: r["n"] for r in pairs.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sampled_texts(rows, sampled_ids(pairs, per_class, "label"), "label", most_bytes), sizes
