"""Operator 10: token counts by heap-and-linked-list byte-pair merging.

A text's symbols (one per known character, one per UTF-8 byte of an unknown
one) form a linked list; a heap holds the adjacent pairs that the vocabulary
joins, lowest rank first and leftmost among equals. Popping a pair removes one
symbol and offers its two new neighbours, so the token count is the number of
initial symbols minus the number of merges. No identifier is looked up.

No entry of the vocabulary has a space mark after another character, so merges
never cross the start of a run of spaces: words are merged on their own and a
task remembers the counts of short ones. Long words take O(n log n).

Edge cases: a NULL or empty text has 0 tokens; any length is counted whole;
repeated rows are counted once each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIMIT = 4096
SPACE = "▁"  # the vocabulary's mark for a space
KEPT_WORDS = 400_000


class MergeCounter:
    """Token counts under a piece vocabulary with byte fallback."""

    UNIT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [i for i in range(model.vocab_size())
                  if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in pieces}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.rank):
            raise ValueError("an entry has a space mark after another character: words can't be merged alone")
        if model.normalize("ﬁ  A　") != f"{SPACE}ﬁ{SPACE}{SPACE}A　":
            raise ValueError("the vocabulary normalises texts in another way than by marking spaces")
        self.words = _Counts(self)

    def merged(self, unit: str) -> int:
        """Tokens of one unit of symbols."""
        rank, text = self.rank, list(unit)
        n = len(text)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(text[i] + text[i + 1])) is not None]
        heapify(heap)
        merges = 0
        unknown = sum(len(c.encode()) - 1 for c in text if c not in rank)
        while heap:
            _, i, size = heappop(heap)
            j = after[i] if text[i] else n
            if j >= n or len(text[i]) + len(text[j]) != size:
                continue  # one of the two has been merged since
            merges += 1
            text[i] += text[j]
            text[j] = ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(text[i] + text[k])) is not None:
                    heappush(heap, (r, i, len(text[i]) + len(text[k])))
            h = before[i]
            if h >= 0 and (r := rank.get(text[h] + text[i])) is not None:
                heappush(heap, (r, h, len(text[h]) + len(text[i])))
        return n + unknown - merges

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        if text[0] != " " and "  " not in text and SPACE not in text:
            return sum(map(self.words.__getitem__, text.split(" ")))
        marked = SPACE + text.replace(" ", SPACE)
        return sum(self.words[u[1:]] if u[0] == SPACE else self.merged(u) for u in self.UNIT.findall(marked))


class _Counts(dict):
    """Counts of units without their first space mark."""

    def __init__(self, counter: MergeCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, word: str) -> int:
        n = self.counter.merged(SPACE + word)
        if len(word) <= 64:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = n
        return n


def count_tokens(docs: DataFrame, model_path: str, *, limit: int = LIMIT, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every document."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = MergeCounter(model_path)
        for batch in batches:
            n = pa.array([counter(t.as_py() or "") for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], ["doc_id", "n_bytes", "n_tokens"])

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                         F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
                         F.col(text).alias("text"))
    return (chosen.mapInArrow(counts, "doc_id long, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document under the public piece vocabulary."""
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                        public_tokenizers.path("piece_bpe_32k.model"))
