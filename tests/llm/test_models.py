"""Language identification, quality and toxicity: against plain versions, and by held-out accuracy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from devicelens.llm import language_id, quality, toxicity
from devicelens.llm.common import crc32_remainder


def plain_bits(texts, order, text):
    """Code length of one text under one language, by dictionaries."""
    counts = {}
    for t in texts:
        b = bytes([language_id.START]) * order + t.encode()
        for i in range(order, len(b)):
            for size in range(order + 1):
                counts.setdefault(b[i - size : i], {}).setdefault(b[i], 0)
                counts[b[i - size : i]][b[i]] += 1
    b, bits = bytes([language_id.START]) * order + text.encode(), 0.0
    for i in range(order, len(b)):
        for size in range(order, -1, -1):
            seen = counts.get(b[i - size : i])
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if b[i] in seen:
                bits -= math.log2(seen[b[i]] / total)
                break
            bits -= math.log2(len(seen) / total)
        else:
            bits += 8
    return bits


SAMPLES = {"aa": ["abab abba", "bab a", "abba abab ab"], "zz": ["zézé zoz", "ozo zé", "z"]}


@pytest.fixture(scope="module")
def trees(make):
    rows = [(i, t, lang) for i, (lang, t) in enumerate((x, t) for x, ts in SAMPLES.items() for t in ts)]
    return language_id.fit_trees(make([*rows, (90, None, "aa"), (91, "no label", None), (92, "", "aa")]))


def test_code_lengths_equal_plain_ppm(trees):
    rng = random.Random(1)
    texts = ["", "ab", "zéz", "q", "中", "abzé"] + ["".join(rng.choice("abzéo q中") for _ in range(rng.randrange(30))) for _ in range(40)]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0] + [len(r) for r in raw])
    got = trees.bits(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for row, text in zip(got, texts):
        for value, lang in zip(row, trees.languages):
            assert value == pytest.approx(plain_bits([*SAMPLES[lang], *([""] if lang == "aa" else [])], 3, text), abs=1e-3)


def test_language_edge_rows(make, trees):
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "abab"), (4, "abab"), (5, "zéz " * 50_000), (None, "ozo")]
    got = language_id.identify(make(rows).select("doc_id", "text", "score"), trees).collect()
    assert sorted((str(r.doc_id), r.lang_pred) for r in got) == sorted(
        [("1", "und"), ("2", "und"), ("3", "und"), ("4", "aa"), ("4", "aa"), ("5", "zz"), ("None", "zz")])
    assert all(0 <= r.score <= 1 for r in got)
    assert language_id.identify(make([]).select("doc_id", "text"), trees).count() == 0
    none = language_id.fit_trees(make([(1, "x", None)]))
    assert language_id.identify(make([(1, "x")]).select("doc_id", "text"), none).first().lang_pred == "und"


def area(score, y):
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    return (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_language_held_out(spark):
    got = language_id.query(spark, "/root/testdata/sf0.01").toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    held = got[got["held_out"]].merge(truth, on="doc_id")
    assert len(got) == 1000 and (held["lang"] == held["lang_pred"]).mean() > 0.98


@pytest.mark.parametrize("module, label, sf, least", [(quality, "quality", "sf0.01", 0.97), (toxicity, "toxic", "sf0.1", 0.94)])
def test_labels_held_out(spark, module, label, sf, least):
    got = module.query(spark, f"/root/testdata/{sf}").toPandas()
    truth = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet").select("doc_id", F.col(label).alias("y")).toPandas()
    held = got[got["held_out"]].merge(truth, on="doc_id")
    assert len(got) >= 1000 and got["score"].between(0, 1).all()
    assert ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()
    assert area(held["score"].to_numpy(), held["y"].to_numpy()) > least


def test_held_out_rows_teach_nothing(spark, make):
    docs = make([(i, f"word{i} text") for i in range(200)]).withColumn("held", crc32_remainder("doc_id", 4) == 2)
    import zlib

    assert {r.doc_id for r in docs.where("held").collect()} == {i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2}


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


EDGE = [(1, None), (2, ""), (3, "plain words"), (3, "plain words"), (None, "idiot"), (4, "good " * 50_000 + "idiot")]


def test_quality_edge_rows(spark, make):
    rows = [(i, "spam! spam! spam! buy!", 0) if i % 2 else (i, "a calm and plain sentence", 1) for i in range(40)]
    model = quality.fit_classifier(labelled(spark, [*rows, (50, None, 1), (51, "x", None)]))
    got = quality.score_texts(make([*EDGE, (9, "spam! buy!")]).select("doc_id", "text", "score"), model).collect()
    scores = {r.doc_id: r.score for r in got}
    assert len(got) == 7 and scores[1] == scores[2] and scores[9] < 0.5 < scores[3]
    assert quality.score_texts(make([]).select("doc_id", "text"), model).count() == 0
    one = quality.fit_classifier(labelled(spark, [(1, "x", 1)]))
    assert quality.score_texts(make([(1, "y")]).select("doc_id", "text"), one).first().score > 0.9
    assert quality.fit_classifier(labelled(spark, [])).intercept == 0.0


def test_quality_scores_equal_the_average(spark):
    rng = np.random.default_rng(0)
    model = quality.SubwordClassifier(rng.normal(size=1 << quality.SLOTS_LOG2).astype(np.float32), 0.25)
    features, texts = quality.Features(), [b"", b"a", b"ab cd", "é é é x".encode(), b"yes yes no yes"]
    offsets = np.cumsum([0] + [len(t) for t in texts])
    got = model.scores(np.frombuffer(b"".join(texts), np.uint8), offsets, features)
    for value, text in zip(got, texts):
        slots, share = features.of_text(text)
        assert value == pytest.approx(1 / (1 + math.exp(-(model.weight[slots] @ share + 0.25))), abs=1e-6)


def test_toxicity_folds_and_excepts(spark, make):
    clean = "the moron particle was found by the team in may"
    rows = [(i, f"you are an idiot and a moron number {i}", 1) if i % 4 == 0 else (i, f"{clean if i % 16 == 1 else 'a fine day and you are an'} {i}", 0)
            for i in range(80)]
    lexicon = toxicity.fit_lexicon(labelled(spark, rows), exceptions=["idiot light"])
    assert " idiot " in lexicon.weights and " moron particle " in lexicon.exceptions
    texts = ["an idiot", "an ID10T", "an іdіоt", "AN ＩＤＩＯＴ!", "the moron particle", "the idiot light", "idiotically", "fine"]
    got = toxicity.score_texts(make(list(enumerate(texts))).select("doc_id", "text"), lexicon).collect()
    assert [r.predicted for r in sorted(got, key=lambda r: r.doc_id)][:6] == [1, 1, 1, 1, 0, 0]


def test_toxicity_edge_rows(spark, make):
    lexicon = toxicity.fit_lexicon(labelled(spark, []), base={"idiot": 4.0})
    got = toxicity.score_texts(make(EDGE).select("doc_id", "text", "score"), lexicon).collect()
    assert sorted((str(r.doc_id), r.n_matches) for r in got) == sorted([("1", 0), ("2", 0), ("3", 0), ("3", 0), ("None", 1), ("4", 1)])
    assert toxicity.score_texts(make([]).select("doc_id", "text"), lexicon).count() == 0


def test_all_matches_are_found():
    lexicon = toxicity.Lexicon({" idiot ": 1.0, " idiot": 0.5, " scum ": 2.0}, [" scum bag "])
    found = toxicity.weigh(toxicity.Folder()("idiot idiot, idiots scum scum bag"), lexicon.automaton(), True)
    assert found[1] == 4 and found[0] == pytest.approx((1 + 1 + 0.5 + 2) / math.log2(2 + 9))


def test_samples_are_bounded_by_distinct_ids(spark):
    from devicelens.llm.common import labelled_sample

    others = [(i, f"text {i}", i % 2) for i in range(1, 601)]
    for hot in range(1000, 1012):  # ids of small and of large hashes
        rows = others + [(hot, f"copy {i % 3}", 1) for i in range(900)] + [(None, "no id", 1), (hot, None, 0)]
        sample, sizes = labelled_sample(labelled(spark, rows), 10)
        got = sample.collect()
        assert sizes == {0: 300, 1: 301} and len(got) == 20 == len({(r.doc_id, r.label) for r in got})
    only = [(7, f"copy {i}", 1) for i in range(500)]
    assert [r.doc_id for r in labelled_sample(labelled(spark, only), 10)[0].collect()] == [7]
    long = [(i, "x" * 1000, 0) for i in range(50)]
    assert labelled_sample(labelled(spark, long), 40, most_bytes=4500)[0].count() == 5  # the fifth text reaches the bound
    by_table = labelled_sample(spark.createDataFrame(only, "doc_id long, text string, n int"), 10,
                               labels=spark.createDataFrame([(7, 0), (7, 1), (8, 1), (None, 1)], "doc_id long, label int"))
    assert sorted((r.doc_id, r.label) for r in by_table[0].collect()) == [(7, 0), (7, 1)] and by_table[1] == {0: 1, 1: 1}


def test_a_language_of_one_hot_id_is_learned(make):
    rows = [(3, "abab abba bab", "aa")] * 700 + [(i, "zézé ozo", "zz") for i in range(10, 400)] + [(None, "qq", "yy")]
    trees = language_id.fit_trees(make(rows), per_language=5)
    assert trees.languages == ["aa", "zz"]
    got = language_id.identify(make([(1, "bab abba"), (2, "ozo zé")]).select("doc_id", "text"), trees).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {1: "aa", 2: "zz"}


def test_character_ngrams_are_of_characters():
    texts = ["", "a", "añb", "日本語の文", "x𝕏y𝕏", "ñ", "ab ab", "日本"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])
    characters, ends = quality.Features.characters(data, offsets)
    assert characters.tolist() == [ord(c) for t in texts for c in t] and np.diff(ends).tolist() == [len(t) for t in texts]
    features, joined = quality.Features(), "".join(texts)
    of = {}
    for size, (slot, whole) in zip(features.sizes, features.strings(characters, ends)):
        grams = [joined[i : i + size] for i in range(len(joined) - size + 1)]
        inside = [any(lo <= i and i + size <= hi for lo, hi in zip(ends[:-1], ends[1:])) for i in range(len(grams))]
        assert whole.tolist() == inside
        for g, s in zip(grams, slot.tolist()):
            assert of.setdefault(g, s) == s
    assert len(set(of.values())) == len(of)
