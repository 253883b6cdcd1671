"""Operator 8: toxicity by a weighted lexicon and Aho-Corasick matching.

Texts are folded first: lower case, letters of other scripts that look like
Latin ones, and digits or signs written for letters, become the letter meant;
other punctuation becomes a space. One automaton then finds all lexicon
entries (whole words and word beginnings) and exception phrases in a single
pass. An entry inside an exception phrase doesn't count. A text's score is a
logistic function of the sum of its entries' weights, normalised by the
logarithm of its number of words.

The lexicon is learned from labelled texts: an entry's weight is its log odds
of standing in toxic texts, kept where clearly positive. Exceptions are word
pairs around an entry that occur in non-toxic texts only. Both are counted by
Spark on at most ``per_class`` labelled texts of each class (smallest hashed
ids); they bound the lexicon, too. ``base`` entries with
weights and ``exceptions`` can be given as well.

Edge cases: a NULL or empty text has weight 0 and gets the score of that; a
text of any length is scored whole; without labels the given base lexicon and
a neutral curve are used; repeated rows are scored once each; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from devicelens.llm.common import crc32_remainder, labelled_sample

PER_CLASS, LEAST_TEXTS, LEAST_WEIGHT = 3000, 4, 1.5
PREFIX = 5  # letters of a word beginning
# Letters that look like Latin ones (Cyrillic, Greek), and what they stand for.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһкмтвнαερουικντ", "aeopcyxijsdhkmtbhaepoyiknt"))
# Digits and signs written for letters.
SUBSTITUTES = dict(zip("0134578@$", "oieastbas"))
FOREIGN = re.compile("[Ͱ-ϿЀ-ԯ！-～]")


def _byte_table() -> bytes:
    table = bytearray(range(256))
    for b in range(128):
        c = chr(b)
        table[b] = ord(SUBSTITUTES.get(c, c if c.isalnum() else " "))
    return bytes(table)


class Folder:
    """Texts as Latin letters and spaces, one space at both ends."""

    def __init__(self):
        self.letters = {ord(a): b for a, b in HOMOGLYPHS.items()} | {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
        self.table = _byte_table()

    def __call__(self, text: str) -> str:
        text = text.lower()
        if FOREIGN.search(text):
            text = text.translate(self.letters).lower()
        return f" {text.encode().translate(self.table).decode()} "


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)  # " word " or " beginning"
    exceptions: list[str] = field(default_factory=list)  # " word word "
    intercept: float = -2.0
    slope: float = 1.0

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight, entry))
        for phrase in self.exceptions:
            if phrase not in self.weights:
                found.add_word(phrase, (len(phrase), 0.0, phrase))
        found.make_automaton()
        return found

    def probability(self, value):
        return 1 / (1 + np.exp(-np.clip(self.slope * value + self.intercept, -500, 500)))


def weigh(folded: str, automaton, exceptions: bool) -> tuple[float, int]:
    """(normalised weight, matches) of a folded text."""
    matches = list(automaton.iter(folded)) if len(automaton) else []
    if not matches:
        return 0.0, 0
    spans = [(end - size + 1, end) for end, (size, w, _) in matches if not w] if exceptions else []
    best: dict[int, float] = {}  # by start of the word: its whole word or beginning, whichever weighs more
    i, reach = 0, -1
    spans.sort()
    for start, end, weight in sorted((e - s + 1, e, w) for e, (s, w, _) in matches if w):
        while i < len(spans) and spans[i][0] <= start:
            reach = max(reach, spans[i][1])
            i += 1
        if end > reach:
            best[start] = max(best.get(start, 0.0), weight)
    words = folded.count(" ") + 1
    return sum(best.values()) / math.log2(2 + words), len(best)


def _entries(folded: str) -> set[str]:
    words = folded.split()
    return {f" {w} " for w in words} | {f" {w[:PREFIX]}" for w in words if len(w) > PREFIX}


def fit_lexicon(docs: DataFrame, labels: DataFrame | None = None, *, per_class: int = PER_CLASS,
                base: dict[str, float] | None = None, exceptions: list[str] | None = None,
                doc_id: str = "doc_id", text: str = "text", label: str = "label") -> Lexicon:
    """From rows with text and a 0/1 label of their own or in ``labels`` (rows with a NULL are not used)."""
    sample, shares = labelled_sample(docs, per_class, labels=labels, doc_id=doc_id, text=text, label=label)
    sample = sample.select("label", "text")
    folder = Folder()
    given = Lexicon({f" {folder(w).strip()} ": v for w, v in (base or {}).items()},
                    [f" {folder(p).strip()} " for p in exceptions or []])
    if len(shares) < 2:
        return given

    def occurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder()
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = sorted(_entries(folder(text)))
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(found), pa.int32()), pa.array(found, pa.string())],
                                                 ["label", "entry"])

    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = (F.sum(F.when(F.col("label") == y, 1).otherwise(0)) for y in (1, 0))
    odds = F.log((F.col("toxic") + 0.5) / (sizes[1] + 1)) - F.log((F.col("clean") + 0.5) / (sizes[0] + 1))
    learned = (sample.mapInArrow(occurring, "label int, entry string").groupBy("entry")
               .agg(toxic.alias("toxic"), clean.alias("clean")).where(f"toxic >= {LEAST_TEXTS}")
               .withColumn("weight", odds).where(f"weight >= {LEAST_WEIGHT}"))  # bounded by the sample's texts
    weights = {r["entry"]: float(r["weight"]) for r in learned.collect()} | given.weights

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder()
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = folder(text).split()
                found = sorted({f" {a} {b} " for a, b in zip(words, words[1:]) if f" {a} " in weights or f" {b} " in weights})
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(found), pa.int32()), pa.array(found, pa.string())],
                                                 ["label", "entry"])

    benign = (sample.mapInArrow(pairs, "label int, entry string").groupBy("entry")
              .agg(toxic.alias("toxic"), clean.alias("clean")).where(f"toxic = 0 AND clean >= {LEAST_TEXTS}"))  # bounded by the sample's texts
    lexicon = Lexicon(weights, given.exceptions + sorted(r["entry"] for r in benign.collect()))

    values = score_texts(sample, lexicon, raw=True).select("label", "score").toPandas()  # one number per sampled text
    x, y = values["score"].to_numpy(), values["label"].to_numpy(float)
    # The sample holds classes alike; each row weighs as many rows as it stands for.
    weight = np.where(y == 1, shares[1] / sizes[1], shares[0] / sizes[0])
    a, b = -2.0, 1.0
    for _ in range(50):  # Newton steps of a logistic curve with a small penalty
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = weight * p * (1 - p)
        g0, g1 = (weight * (p - y)).sum() + 1e-3 * a, (weight * (p - y) * x).sum() + 1e-3 * b
        h00, h01, h11 = w.sum() + 1e-3, (w * x).sum(), (w * x * x).sum() + 1e-3
        det = h00 * h11 - h01 * h01
        if det < 1e-12:
            break
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        step = min(1.0, 5 / max(abs(da), abs(db), 1e-9))
        a, b = a - step * da, b - step * db
    lexicon.intercept, lexicon.slope = float(a), float(b)
    return lexicon


def score_texts(docs: DataFrame, lexicon: Lexicon, *, text: str = "text", threshold: float = 0.3,
                raw: bool = False) -> DataFrame:
    """``docs`` without the text, with ``score, n_matches, predicted`` (raw: the weight as score)."""
    rest = [c for c in docs.columns if c not in (text, "score", "n_matches", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(vars(lexicon))  # bounded by the sample

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, folder = Lexicon(**shared.value), Folder()
        automaton = lexicon.automaton()
        for batch in batches:
            value, number = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for i, t in enumerate(batch.column(len(rest))):
                value[i], number[i] = weigh(folder(t.as_py() or ""), automaton, bool(lexicon.exceptions))
            columns = [batch.column(i) for i in range(len(rest))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(value if raw else lexicon.probability(value)), pa.array(number)],
                [*rest, "score", "n_matches"])

    schema = docs.select(*rest).schema.add("score", "double").add("n_matches", "long")
    scored = docs.select(*rest, F.col(text).alias("__text")).mapInArrow(score, schema)
    return scored.select(*rest, "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_matches")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; a quarter of the ids is held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", (crc32_remainder("doc_id", 4) == 2).alias("held_out"), "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    lexicon = fit_lexicon(docs.where(~F.col("held_out")), labels)
    return score_texts(docs, lexicon)
