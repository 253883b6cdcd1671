import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from devicelens.llm import token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
COUNTER = token_counts.MergeCounter(PATH)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcthe  ▁\n\t\x00é中ﬁ𝒳<s>/unk.0")), max_size=60))
def test_counts_equal_the_library(text):
    assert COUNTER(text) == len(LIBRARY.encode(text))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_counts_equal_the_library_on_any_text(text):
    assert COUNTER(text) == len(LIBRARY.encode(text))


def test_edge_rows(make):
    long = "abc" * 20_000
    rows = [(1, None), (2, ""), (3, "hello world"), (3, "hello world"), (None, "x"), (4, long), (5, "the cat " * 4000)]
    got = token_counts.count_tokens(make(rows), PATH).toPandas()
    for r in got.dropna(subset="doc_id").itertuples():
        text = dict(rows)[int(r.doc_id)] or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(LIBRARY.encode(text)))
        assert r.over_limit == (r.n_tokens > 4096)
    assert len(got) == 7 and token_counts.count_tokens(make([]), PATH).count() == 0
