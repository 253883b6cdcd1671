import collections
import hashlib
import random
import re

import pytest

from devicelens.llm import fingerprints


def words(text):
    return collections.Counter(x for x in re.split(r"[\W_]+", (text or "").lower()) if x)


def similarity(a, b):
    keys = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys)


def rows():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    out = [(rng.randrange(10**12) if i % 2 else i, " ".join(rng.choices(vocabulary, k=rng.randrange(40, 400)))) for i in range(60)]
    return [*out, (70, None), (71, ""), (72, "-- !!"), (73, "é中𝒳 b"), (74, "long word " * 20_000), (75, out[3][1])]


def test_edited_texts_and_likeness(make):
    data = rows()
    order = sorted(data, reverse=True)
    got = {r.doc_id: r for r in fingerprints.fingerprints(make(data), ranges=7).collect()}
    assert len(got) == len(data)
    errors = []
    for i, (doc, text) in enumerate(order):
        text, following, r = text or "", order[(i + 1) % len(order)][1] or "", got[doc]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = words(text), words(edited), words(following)
        for value, other in ((r.near_edited, b), (r.near_next, c)):
            if a and other:
                errors.append(value - similarity(a, other))
            else:
                assert value == float(not a and not other)
    assert abs(sum(errors) / len(errors)) < 0.03 and max(map(abs, errors)) < 0.45
    assert got[75].fingerprint == got[data[3][0]].fingerprint != "" and got[70].fingerprint == got[72].fingerprint == ""


def test_repeated_and_null_ids(make):
    data = [(1, "a b c"), (1, "a b c"), (1, "d e"), (None, "f g"), (None, "f g"), (2, "h i")]
    for ranges in (1, 3):
        got = fingerprints.fingerprints(make(data), ranges=ranges).collect()
        assert sorted((str(r.doc_id), r.n_chars) for r in got) == sorted((str(i), len(t)) for i, t in data)


def test_one_row_and_no_row(make):
    one = fingerprints.fingerprints(make([(5, "ab cd")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"ab ab").hexdigest() and one.near_next == 1.0
    assert fingerprints.fingerprints(make([])).count() == 0


def test_collision_rate_equals_generalised_jaccard(spark):
    a, b = "x x x x y y z " * 3, "x x y y y z z q " * 2
    frame = spark.createDataFrame([(1, a), (2, b)], "id long, text string")
    got = {r.id: r.signature for r in fingerprints.signatures(frame, ["id"], samples=400).collect()}
    rate = sum(x == y for x, y in zip(got[1], got[2])) / 400
    assert rate == pytest.approx(similarity(words(a), words(b)), abs=0.08)


def test_no_python_in_the_plan(spark, sf):
    plan = fingerprints.query(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas", plan)
