"""Operator 5: language identification by partial matching (PPM).

For every language, byte contexts of up to ``order`` bytes are counted on
labelled texts and then frozen. A byte costs ``-log2`` of its probability in
the longest context the language has seen, escapes (method C, without
exclusions) paying for each context in which the byte was not seen, down to a
uniform byte. A text's language is the one with the shortest total code.

All languages share one tree of the byte strings seen in any of them, so a
position's node is found for all languages at once; a node holds one code
length per language, worked out beforehand. A position whose full string is
not in the tree pays the context's escape and goes one order down.

The trees are fitted on at most ``per_language`` labelled texts of each
language (those with the smallest hashed ids); every text is scored whole.

Edge cases: a NULL text, or one without any letter, is ``und`` with score 0,
as is every text when there is nothing to learn from; texts start in a
context of line ends; ties go to the first language in text order; repeated
rows are scored once each; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from devicelens.llm.common import SAMPLE_BYTES, crc32_remainder, sampled_ids, sampled_texts, text_slices

ORDER = 3
# Bound of the labelled sample: texts of each language.
PER_LANGUAGE = 1500
UNDETERMINED = "und"
# A text is foreign to the models where the best language's code is longer than the text
# itself by more than SPARE_BITS in all (a short text alone proves little), provided
# that language was learned from LEAST_BYTES or more.
MOST_BITS, SPARE_BITS, LEAST_BYTES = 8.0, 128.0, 250_000
START = 10  # the byte that stands before a text


def padded(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with ``order`` start bytes before each text, their offsets, which are text)."""
    n = len(offsets) - 1
    shifted = offsets + order * np.arange(n + 1)
    out = np.full(int(shifted[-1]), START, np.uint8)
    real = np.ones(len(out), bool)
    real[(shifted[:-1, None] + np.arange(order)).ravel()] = False
    out[real] = data
    return out, shifted, real


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """The last ``size`` bytes up to each position as one number (from position size-1 on)."""
    code = np.zeros(len(data) - size + 1, np.uint64)
    for i in range(size):
        code = (code << np.uint64(8)) | data[i : len(data) - size + 1 + i]
    return code


@dataclass
class ContextTrees:
    """Frozen statistics of all languages over one tree. Node 0 is none, node 1 the root."""

    languages: list[str]
    symbol: np.ndarray  # byte -> column of child (0: never seen)
    child: np.ndarray  # (context nodes, symbols) -> node
    cost: np.ndarray  # (nodes, languages): bits of the node's last byte after its others
    escape: np.ndarray  # (context nodes, languages): bits of leaving the context
    order: int
    learned: np.ndarray  # bytes seen of each language

    @classmethod
    def fit(cls, languages: list[str], lang: np.ndarray, code: np.ndarray, count: np.ndarray, order: int) -> ContextTrees:
        """From counts of byte strings of ``order + 1`` bytes per language."""
        width = len(languages)
        levels = []  # of strings of 1 .. order + 1 bytes: (codes, counts per language)
        codes = np.unique(code)
        for size in range(order + 1, 0, -1):
            mask = np.uint64((1 << (8 * size)) - 1)
            # A string's beginning is a context of its own, even if no text's byte ends it.
            codes = np.unique(np.concatenate((codes & mask, codes >> np.uint64(8)))) if size <= order else codes
            table = np.zeros((len(codes), width))
            np.add.at(table, (np.searchsorted(codes, code & mask), lang), count)
            levels.insert(0, (codes, table))
        symbols = levels[0][0].astype(np.int64)
        symbol = np.zeros(256, np.int64)
        symbol[symbols] = np.arange(1, len(symbols) + 1)
        first = np.cumsum([2] + [len(c) for c, _ in levels])  # first node of each level
        contexts = int(first[order])
        child = np.zeros((contexts, len(symbols) + 1), np.int32)
        cost = np.zeros((int(first[-1]), width))
        escape = np.zeros((contexts, width))
        lower_codes, lower_cost = np.zeros(1, np.uint64), np.full((1, width), 8.0)
        for size, (codes, table) in enumerate(levels, 1):
            above = codes >> np.uint64(8)
            parent = np.ones(len(codes), np.int64) if size == 1 else first[size - 2] + np.searchsorted(levels[size - 2][0], above)
            nodes = first[size - 1] + np.arange(len(codes))
            child[parent, symbol[(codes & np.uint64(255)).astype(np.int64)]] = nodes
            total, kinds = np.zeros((contexts, width)), np.zeros((contexts, width))
            np.add.at(total, parent, table)
            np.add.at(kinds, parent, table > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                leave = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                stay = -np.log2(table / (total + kinds)[parent])
            here = np.unique(parent)
            escape[here] = leave[here]
            if size > 1:
                lower = lower_cost[np.searchsorted(lower_codes, codes & np.uint64((1 << (8 * (size - 1))) - 1))]
            else:
                lower = np.broadcast_to(lower_cost, table.shape)
            own = np.where(table > 0, stay, leave[parent] + lower)
            cost[nodes] = own
            lower_codes, lower_cost = codes, own
        return cls(languages, symbol, child, cost.astype(np.float32), escape.astype(np.float32), order,
                   np.bincount(lang, count, width))

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code lengths (texts, languages)."""
        text, starts, real = padded(data, offsets, self.order)
        symbols = self.symbol[text]
        nodes = [np.ones(len(text), np.int32)]  # by size of the string ending at a position
        for _ in range(self.order + 1):
            node = np.zeros(len(text), np.int32)
            before = nodes[-1][:-1]
            before = np.where(before < len(self.child), before, 0)
            node[1:] = self.child[before, symbols[1:]]
            if len(nodes) == 1:
                node[:1] = self.child[1, symbols[:1]]
            nodes.append(node)
        cost = self.cost[nodes[-1]]
        left = np.flatnonzero((nodes[-1] == 0) & real)
        for size in range(self.order, -1, -1):
            if not len(left):
                break
            cost[left] += self.escape[nodes[size][left - 1]]
            found = nodes[size][left] > 0 if size else np.ones(len(left), bool)
            cost[left[found]] += self.cost[nodes[size][left[found]]] if size else 8.0
            left = left[~found]
        cost[~real] = 0
        total = np.add.reduceat(cost, starts[:-1], axis=0, dtype=np.float64)
        return total


def fit_trees(docs: DataFrame, *, order: int = ORDER, per_language: int = PER_LANGUAGE, doc_id: str = "doc_id",
              lang: str = "lang", text: str = "text", most_bytes: int = SAMPLE_BYTES) -> ContextTrees:
    """Trees from at most ``per_language`` ids and ``most_bytes`` of each language (NULL language, id or text: not used)."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sample = sampled_texts(rows, sampled_ids(rows.select("lang", "doc_id"), per_language, "lang"), "lang", most_bytes)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                names = np.array(batch.column(0).slice(lo, hi - lo).to_pylist())
                out, starts, real = padded(data, offsets, order)
                code = np.concatenate((np.zeros(order, np.uint64), grams(out, order + 1))) if len(out) > order else np.zeros(len(out), np.uint64)
                for name in np.unique(names):
                    of = np.repeat(names == name, np.diff(starts)) & real
                    codes, n = np.unique(code[of], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes.view(np.int64)),
                                                      pa.array(n, pa.int64())], ["lang", "code", "n"])

    table = (sample.select("lang", "text")
             .mapInArrow(counts, "lang string, code long, n long")
             .groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas())
    languages = sorted(table["lang"].unique())
    place = table["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(np.int64)
    return ContextTrees.fit(languages, place, table["code"].to_numpy(np.int64).view(np.uint64), table["n"].to_numpy(float), order)


def identify(docs: DataFrame, trees: ContextTrees, *, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the best language's share under equal priors."""
    names = {"lang_pred", "score"}
    rest = [c for c in docs.columns if c not in names]
    model = docs.sparkSession.sparkContext.broadcast(vars(trees))  # plain arrays, bounded by the sample
    schema = docs.select(*rest).schema.add("lang_pred", "string").add("score", "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = ContextTrees(**model.value)
        for batch in batches:
            has_letter, texts = batch.column(len(rest)), batch.column(len(rest) + 1)
            best, share = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for lo, hi, data, offsets in text_slices(texts, 1 << 20):
                bits = trees.bits(data, offsets)
                best[lo:hi] = bits.argmin(1)
                gap = bits - bits.min(1, keepdims=True)
                share[lo:hi] = 1 / np.exp2(-np.minimum(gap, 1000.0)).sum(1)
            known = has_letter.to_numpy(zero_copy_only=False)
            pred = pa.array([trees.languages[b] if ok else UNDETERMINED for b, ok in zip(best, known)], pa.string())
            columns = [batch.column(i) for i in range(len(rest))]
            yield pa.RecordBatch.from_arrays([*columns, pred, pa.array(np.where(known, share, 0.0))],
                                             [*rest, "lang_pred", "score"])

    if not trees.languages:
        return docs.select(*rest, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return docs.select(*rest, letter.alias("__letter"), F.when(letter, F.col(text)).alias("__text")).mapInArrow(score, schema)


def understood(text: Column, trees: ContextTrees, spark: SparkSession) -> Column:
    """Whether ``text`` has a letter and isn't foreign to the models; with nothing learned the letter decides.

    Only the text passes through Arrow, so the rows may have any other columns.
    """
    letter = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    if not trees.languages:
        return letter
    model = spark.sparkContext.broadcast(vars(trees))  # plain arrays, bounded by the sample

    def familiar(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trees = ContextTrees(**model.value)
        for column in columns:
            known = np.zeros(len(column), bool)
            for lo, hi, data, offsets in text_slices(column, 1 << 20):
                bits = trees.bits(data, offsets)
                within = bits.min(1) <= MOST_BITS * np.diff(offsets) + SPARE_BITS
                known[lo:hi] = within | (trees.learned[bits.argmin(1)] < LEAST_BYTES)
            yield pa.array(known)

    return letter & F.arrow_udf(familiar, "boolean")(F.when(letter, text))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document; a quarter of the ids is held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", crc32_remainder("doc_id", 4) == 2)
    trees = fit_trees(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), trees).drop("text")
