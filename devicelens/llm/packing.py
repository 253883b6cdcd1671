"""Operator 1: harmonic packing of tokenised documents.

A piece of ``s`` tokens belongs to class ``k = capacity // s``: exactly ``k``
such pieces fit into one sequence, so a bin of class ``k`` is simply ``k``
pieces of that class in a row. No bin needs to look at another one: pieces are
dealt to many shards, every (class, shard) fills its own bins, and a small
table of counts tells each shard at which bin of its class it starts.

Documents may be cut freely, so a document is cut into full sequences plus a
remainder, and the remainder into pieces that lie just below a reciprocal
``capacity / k`` (within ``1 / tolerance`` of it). A full bin therefore wastes
at most about ``1 / tolerance`` of its capacity. Each class leaves at most one
bin unfilled; these leftovers (fewer than ``k`` pieces a class, however large
the corpus) are packed best-fit together.

Edge cases: a NULL or empty text is one piece holding only the end id; a text
of any length is tokenised whole; repeated rows are packed once each; an empty
table gives an empty result; extra columns are ignored, and NULL ids are kept.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from devicelens.llm.common import materialize, shuffle_partitions

CAPACITY, TOLERANCE, END_ID = 2048, 64, 1
# Words whose ids a task keeps; beyond it the memory starts afresh.
KEPT_WORDS = 400_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, k int"


def cut(tokens: int, capacity: int = CAPACITY, tolerance: int = TOLERANCE) -> list[int]:
    """Piece lengths of a document: full sequences, then near-reciprocal pieces."""
    pieces = [capacity] * (tokens // capacity)
    rest = tokens % capacity
    while rest:
        k = capacity // rest
        largest = capacity // k
        size = rest if (largest - rest) * tolerance <= largest else capacity // (k + 1)
        pieces.append(size)
        rest -= size
    return pieces


class TokenBytes:
    """Little-endian 32-bit ids of texts, as one bytes object per text.

    The pre-tokeniser never joins the two sides of a single space between
    non-space characters, so a text is looked up space by space; a part not
    seen before is encoded by itself. Texts with other white space next to a
    space, and parts with special strings or letters beyond Latin, go through
    the reference library whole.
    """

    OTHER_SPACE = re.compile(r"[^\S \n]")

    def __init__(self, json_path: str, ranks_path: str, pattern: str, special: dict[str, int]):
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.exact, self.special = Tokenizer.from_file(json_path), tuple(special)
        self.after_space, self.at_start = _Parts(self, " "), _Parts(self, "")

    def encode(self, text: str) -> bytes:
        plain = text.isascii() or max(text) < "ɐ"
        if plain and not any(s in text for s in self.special):
            return array("I", self.fast.encode_ordinary(text)).tobytes()
        return array("I", self.exact.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        odd = "  " in text or " \n" in text or "\n " in text or text[0].isspace() or text[-1].isspace()
        if odd or self.OTHER_SPACE.search(text):
            return self.encode(text)
        first, *others = text.split(" ")
        return self.at_start[first] + b"".join(map(self.after_space.__getitem__, others))


class _Parts(dict):
    def __init__(self, tokens: TokenBytes, lead: str):
        super().__init__()
        self.tokens, self.lead = tokens, lead

    def __missing__(self, part: str) -> bytes:
        ids = self.tokens.encode(self.lead + part)
        if len(part) <= 64:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[part] = ids
        return ids


def public_vocabulary(name: str) -> dict:
    """Paths of a byte-level vocabulary (json and ranks) from the public files."""
    import public_tokenizers

    return {"json_path": public_tokenizers.path(f"{name}.json"),
            "ranks_path": public_tokenizers.path(f"{name}.tiktoken"),
            "pattern": public_tokenizers.PATTERN, "special": {"<|endoftext|>": 50256}}


def tokenized_pieces(docs: DataFrame, vocabulary: dict, *, capacity: int, tolerance: int, end_id: int,
                     doc_id: str, text: str) -> DataFrame:
    """One row per piece: where it lies in its document, its checksum and class."""
    tail = array("I", [end_id]).tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = TokenBytes(**vocabulary)
        for batch in batches:
            out: list[tuple] = []
            for row_id, row_text in zip(batch.column(0), batch.column(1)):
                ids = memoryview(tokens(row_text.as_py() or "") + tail)
                total, start, row_id = len(ids) // 4, 0, row_id.as_py()
                for size in cut(total, capacity, tolerance):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + size)])
                    out.append((row_id, start, size, crc, total, capacity // size))
                    start += size
            columns = list(zip(*out)) or [()] * 6
            kinds = [pa.int64()] * 5 + [pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                             ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "k"])

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(pieces, PIECES)


def _best_fit(capacity: int):
    def fit(frame):
        frame = frame.sort_values(["length", "piece"], ascending=[False, True], ignore_index=True)
        room: list[int] = []
        bins, offsets = [], []
        for size in frame["length"]:
            fitting = [(left, i) for i, left in enumerate(room) if left >= size]
            left, i = min(fitting) if fitting else (capacity, len(room))
            if not fitting:
                room.append(capacity)
            bins.append(i)
            offsets.append(capacity - left)
            room[i] -= size
        frame["sequence_id"] = frame["first_tail"] + bins
        frame["offset"] = offsets
        return frame[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "k"]]

    return fit


def pack(docs: DataFrame, vocabulary: dict, *, capacity: int = CAPACITY, tolerance: int = TOLERANCE,
         end_id: int = END_ID, shards: int | None = None, doc_id: str = "doc_id",
         text: str = "text") -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` tokens.

    Returns one row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, k``. ``shards`` (default: the shuffle partitions) is
    how many workers fill the bins of one class.
    """
    shards = shards or shuffle_partitions(docs.sparkSession)
    pieces = materialize(
        tokenized_pieces(docs, vocabulary, capacity=capacity, tolerance=tolerance, end_id=end_id,
                         doc_id=doc_id, text=text)
        .withColumn("piece", F.monotonically_increasing_id())
        .withColumn("shard", F.pmod(F.xxhash64("piece"), F.lit(shards)).cast("int")), "pieces")

    # Bounded tables: at most one row per (class, shard), and one per class.
    counts = pieces.groupBy("k", "shard").agg(F.count(F.lit(1)).alias("n"))
    of_class = Window.partitionBy("k")
    counts = counts.select(
        "k", "shard", F.sum("n").over(of_class).alias("class_n"),
        (F.sum("n").over(of_class.orderBy("shard")) - F.col("n")).alias("before"))
    classes = counts.groupBy("k").agg(F.expr("max(class_n) div k").alias("bins"))
    in_order = Window.orderBy("k")
    classes = classes.select("k", "bins", (F.sum("bins").over(in_order) - F.col("bins")).alias("first_bin"),
                             F.sum("bins").over(in_order.rowsBetween(Window.unboundedPreceding,
                                                                     Window.unboundedFollowing)).alias("first_tail"))
    placed = (pieces
              .withColumn("place", F.row_number().over(Window.partitionBy("k", "shard").orderBy("piece")) - 1)
              .join(counts.select("k", "shard", "before").join(classes, "k"), ["k", "shard"])
              .withColumn("place", F.col("place") + F.col("before"))
              .withColumn("bin", F.expr("place div k")))
    placed = materialize(placed, "placed")

    in_bin = Window.partitionBy("sequence_id").orderBy("place")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "k"]
    full = (placed.where("bin < bins").withColumn("sequence_id", F.col("first_bin") + F.col("bin"))
            .withColumn("offset", F.sum("length").over(in_bin) - F.col("length")).select(*columns))
    left = (placed.where("bin >= bins").withColumn("tail", F.lit(0)).groupBy("tail")
            .applyInPandas(_best_fit(capacity), f"{PIECES.rpartition(',')[0]}, sequence_id long, offset long, k int"))
    return full.unionByName(left)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 2048 ids of the byte-level vocabulary."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_vocabulary("byte_bpe_50k"))
