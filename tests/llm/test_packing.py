import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from devicelens.llm import packing
from devicelens.llm.common import with_row_id

EXACT = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
TOKENS = packing.TokenBytes(**packing.public_vocabulary("byte_bpe_50k"))


def ids(text):
    return np.array(EXACT.encode(text or "", add_special_tokens=False).ids + [packing.END_ID], np.uint32)


@given(st.integers(0, 50_000))
def test_cut_covers_and_fits_its_class(n):
    sizes = packing.cut(n)
    assert sum(sizes) == n
    for s in sizes:
        k = packing.CAPACITY // s
        assert k * s <= packing.CAPACITY and packing.CAPACITY - k * s <= max(packing.CAPACITY / packing.TOLERANCE + k, 45)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abZ é'ſß中١²  \n\t\r\x1c  .,!<|>endoftext0")), max_size=40))
def test_token_bytes_equal_the_library(text):
    for t in (text, f"{text}<|endoftext|> {text}"):
        got = np.frombuffer(TOKENS(t), np.uint32).tolist()
        assert got == EXACT.encode(t, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def packed(spark, make):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(0, 900))))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "long " * 30_000), (103, "a<|endoftext|>b"), (104, "same"), (104, "same"), (None, "no id")]
    return rows, packing.pack(make(rows), packing.public_vocabulary("byte_bpe_50k"), shards=3).toPandas()


def test_every_token_lies_in_one_piece(packed):
    rows, got = packed
    texts = dict(rows)
    for doc, pieces in got.dropna(subset="doc_id").sort_values(["doc_id", "start"]).groupby("doc_id"):
        expected, copies = ids(texts[int(doc)]), sum(i == doc for i, _ in rows)
        assert pieces["length"].sum() == copies * len(expected)
        for p in pieces.itertuples():
            part = expected[p.start : p.start + p.length]
            assert zlib.crc32(part.tobytes()) == p.ids_crc32 and p.doc_tokens == len(expected)
    assert got["doc_id"].isna().sum() == 1


def test_sequences_are_gapless_and_full(packed):
    _, got = packed
    got = got.sort_values(["sequence_id", "offset"])
    ends = got.groupby("sequence_id")["length"].cumsum()
    assert ((ends - got["length"]) == got["offset"]).all() and ends.max() <= packing.CAPACITY
    sizes = got.groupby("sequence_id")["length"].sum()
    assert sorted(sizes.index) == list(range(len(sizes)))
    assert sum(packing.CAPACITY - s for s in sizes if s & (s - 1)) < 0.03 * sizes.sum()


def test_empty_table(spark, make):
    assert packing.pack(make([]), packing.public_vocabulary("byte_bpe_50k")).count() == 0


def test_row_ids_are_unique(spark):
    assert with_row_id(spark.range(50)).select("row_id").distinct().count() == 50
