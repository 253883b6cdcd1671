"""Operator 4: quality classifier on supervised subword embeddings.

A text's features are its words, its character n-grams of 2 to 4 characters
and, for word pairs up to three words apart, a mark where both words are equal
(an addition of ours that finds repeated text); all are hashed into a fixed
number of slots. Every slot has a learned vector; a text is the
average of its features' vectors, and a softmax layer over it gives the
label's probability. Vectors and layer are learned together by stochastic
gradient descent (numpy), one text at a time, the step scaled by the length of
the text's feature vector.

The model is fitted on at most ``per_class`` labelled texts of each class
(those with the smallest hashed ids, one text an id, up to ``most_bytes``) and its intercept moved from the sample's
class shares to those of all labelled rows. As averaging is linear, scoring
needs one learned number per slot: the slot's vector times the layer.

Edge cases: a NULL or empty text has no features and gets the intercept's
score; a text of any length is scored whole; with fewer than two classes to
learn from every score is that class's share; conflicting labels of one id
are all used; repeated rows are scored once each; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from devicelens.llm.common import SAMPLE_BYTES, WordHasher, crc32_remainder, labelled_sample, space_words, text_slices

SLOTS_LOG2 = 18
SIZES = (2, 3, 4)
REPEATS = (1, 2, 3)  # distances at which equal words are marked; also the marks' slots
DIMENSIONS = 8
# Bound of the labelled sample: texts of each class.
PER_CLASS = 1500
EPOCHS = 5


class Features:
    """Slots of the features of many texts at once."""

    def __init__(self, slots_log2: int = SLOTS_LOG2, sizes: tuple[int, ...] = SIZES):
        self.shift, self.sizes = np.uint64(64 - slots_log2), sizes
        self.hasher = WordHasher(space_words())
        self.hasher.lower = np.arange(256, dtype=np.uint8)  # case is a feature

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of words and, after them, of the repetition marks; first of each text and the end."""
        hashes, bounds = self.hasher(data, offsets)
        number, place = [], np.arange(len(hashes))
        slots = [(hashes >> self.shift).astype(np.int64)]
        ends = np.repeat(bounds[1:], np.diff(bounds))
        for apart in REPEATS:
            same = np.flatnonzero((hashes[:-apart] == hashes[apart:]) & (place[:-apart] + apart < ends[:-apart]))
            slots.append(np.full(len(same), apart))
            number.append(same)
        if sum(map(len, number)):
            at = np.concatenate([place, *number])
            order = np.argsort(at, kind="stable")
            return np.concatenate(slots)[order], np.searchsorted(at[order], bounds)
        return slots[0], bounds

    @staticmethod
    def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code points of UTF-8 texts, and the offsets counted in them."""
        first = (data & 0xC0) != 0x80
        place = np.concatenate(([0], np.cumsum(first)))
        at = np.flatnonzero(first)
        lead = data[at].astype(np.uint64)
        code = np.where(lead < 0x80, lead, np.where(lead < 0xE0, lead & np.uint64(0x1F), np.where(lead < 0xF0, lead & np.uint64(0x0F), lead & np.uint64(7))))
        size = np.diff(np.append(at, len(data)))
        for back in range(1, 4):
            more = np.flatnonzero(size > back)
            code[more] = (code[more] << np.uint64(6)) | (data[at[more] + back] & 0x3F)
        return code, place[offsets]

    def strings(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each size the slot of the n-gram at each character, and where it is whole.

        ``data`` and ``offsets`` are of characters, see :meth:`characters`.
        """
        code = data.astype(np.uint64)
        for size in range(2, max(self.sizes) + 1):
            code = (code[:-1] << np.uint64(21)) ^ (code[:-1] >> np.uint64(43)) ^ data[size - 1 :] if len(code) > 1 else code[:0]
            if size in self.sizes:
                slot = ((code * np.uint64(0x9E3779B97F4A7C15) + np.uint64(size << 60))
                        >> self.shift).astype(np.int64)
                whole = np.ones(len(slot), bool)
                for back in range(1, size):
                    at = offsets[1:] - back
                    whole[at[(at >= 0) & (at < len(slot))]] = False
                yield slot, whole

    def of_text(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(distinct slots, their shares) of one text."""
        data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
        slots = np.concatenate([self.words(data, offsets)[0], *[s[w] for s, w in self.strings(*self.characters(data, offsets))]])
        slots, n = np.unique(slots, return_counts=True)
        return slots, n / max(1, n.sum())


@dataclass
class SubwordClassifier:
    weight: np.ndarray  # per slot
    intercept: float

    @classmethod
    def fit(cls, examples: list[tuple[np.ndarray, np.ndarray]], labels: list[int], share: float, *, epochs: int = EPOCHS,
            dimensions: int = DIMENSIONS, rate: float = 0.5, seed: int = 7) -> SubwordClassifier:
        """``examples``: distinct slots and their shares of each text; ``share``: of label 1 among all labelled ids."""
        rng = np.random.default_rng(seed)
        prior = float(np.clip(share, 1e-3, 1 - 1e-3))
        if len(set(labels)) < 2:
            return cls(np.zeros(1 << SLOTS_LOG2, np.float32), float(np.log(prior / (1 - prior))))
        vectors = rng.uniform(-1, 1, (1 << SLOTS_LOG2, dimensions)) / dimensions
        layer, bias = np.zeros((dimensions, 2)), np.zeros(2)
        layer[:] = rng.normal(0, 0.5, layer.shape)
        steps, step = epochs * len(examples), 0
        for _ in range(epochs):
            for i in rng.permutation(len(examples)):
                slots, amount = examples[i]
                speed = rate * (1 - step / steps)
                step += 1
                hidden = amount @ vectors[slots]
                logits = hidden @ layer + bias
                error = np.exp(logits - logits.max())
                error /= error.sum()
                error[labels[i]] -= 1
                if len(slots):
                    vectors[slots] -= np.outer(amount, speed * (layer @ error) / (amount @ amount))
                layer -= speed * 0.1 * np.outer(hidden, error)
                bias -= speed * 0.1 * error
        seen = np.mean(labels)
        shift = np.log(prior / (1 - prior)) - np.log(seen / (1 - seen))
        return cls((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0] + shift))

    def scores(self, data: np.ndarray, offsets: np.ndarray, features: Features) -> np.ndarray:
        characters, ends = features.characters(data, offsets)
        total = np.zeros(len(characters) + 1)
        number = np.zeros(len(offsets) - 1)
        length = np.diff(ends)
        for slot, whole in features.strings(characters, ends):
            part = self.weight[slot]
            part[~whole] = 0
            total[1 : len(part) + 1] += part
        for size in features.sizes:
            number += np.maximum(length - size + 1, 0)
        summed = np.cumsum(total)
        logit = summed[ends[1:]] - summed[ends[:-1]]
        slots, bounds = features.words(data, offsets)
        summed = np.concatenate(([0.0], np.cumsum(self.weight[slots], dtype=np.float64)))
        logit += summed[bounds[1:]] - summed[bounds[:-1]]
        number += np.diff(bounds)
        return 1 / (1 + np.exp(-np.clip(logit / np.maximum(number, 1) + self.intercept, -500, 500)))


def fit_classifier(docs: DataFrame, labels: DataFrame | None = None, *, per_class: int = PER_CLASS,
                   doc_id: str = "doc_id", text: str = "text", label: str = "label", most_bytes: int = SAMPLE_BYTES) -> SubwordClassifier:
    """From at most ``per_class`` ids and ``most_bytes`` of each class with a 0/1 label of their own or in ``labels`` (rows with a NULL are not used)."""
    sample, sizes = labelled_sample(docs, per_class, labels=labels, doc_id=doc_id, text=text, label=label, most_bytes=most_bytes)
    if not sizes:
        return SubwordClassifier(np.zeros(1 << SLOTS_LOG2, np.float32), 0.0)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            for i in range(len(batch)):
                found, share = features.of_text(batch.column(2)[i].as_py().encode())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([found.astype(np.int32).tobytes()], pa.binary()),
                     pa.array([share.tobytes()], pa.binary())], ["label", "place", "slots", "share"])

    # A text comes to the driver as at most 2 ** SLOTS_LOG2 slots, and the sample's bytes bound them all.
    rows = sample.select("label", F.xxhash64("doc_id").alias("place"), "text").mapInArrow(slots, "label int, place long, slots binary, share binary")
    got = rows.orderBy("label", "place", "slots").collect()
    examples = [(np.frombuffer(r["slots"], np.int32), np.frombuffer(r["share"])) for r in got]
    return SubwordClassifier.fit(examples, [r["label"] for r in got], sizes.get(1, 0) / sum(sizes.values()))


def score_texts(docs: DataFrame, model: SubwordClassifier, *, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` without the text, with ``score`` and ``predicted``."""
    rest = [c for c in docs.columns if c not in (text, "score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # a fixed number of slots

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, model = Features(), SubwordClassifier(**shared.value)
        for batch in batches:
            out = [np.zeros(0)]
            for _, _, data, offsets in text_slices(batch.column(len(rest)), 1 << 20):
                out.append(model.scores(data, offsets, features))
            columns = [batch.column(i) for i in range(len(rest))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(out))], [*rest, "score"])

    schema = docs.select(*rest).schema.add("score", "double")
    return (docs.select(*rest, F.col(text).alias("__text")).mapInArrow(score, schema)
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; a fifth of the ids is held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", (crc32_remainder("doc_id", 5) == 0).alias("held_out"), "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = fit_classifier(docs.where(~F.col("held_out")), labels)
    return score_texts(docs, model)
