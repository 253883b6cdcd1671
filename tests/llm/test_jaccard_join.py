import random

import pytest

from devicelens.llm import components as components_module
from devicelens.llm import jaccard_join
from devicelens.llm.common import materialize
from devicelens.llm.components import components


def shingles(text, n):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, num, den):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, len(sets[i]), least.get(find(i))) for i, (doc, _) in enumerate(rows)), key=str)


def documents(seed, size):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    out = []
    while len(out) < size:
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 8, 20, 60, 150]))]
        if rng.random() < 0.4:
            base += passage
        out.append(" ".join(base))
        chain = list(base)
        for _ in range(rng.choice([0, 0, 1, 3, 12])):
            source = chain if rng.random() < 0.5 else list(base)
            for _ in range(rng.randrange(0, 4)):
                source[rng.randrange(len(source))] = rng.choice(vocabulary)
            chain = source
            out.append(" ".join(source).upper() if rng.random() < 0.2 else "\n".join(source))
    return out


@pytest.mark.parametrize("n, num, den, seed", [(4, 85, 100, 1), (5, 80, 100, 2)])
def test_equals_brute_force(make, n, num, den, seed):
    rows = list(enumerate(documents(seed, 160)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "w1 w2"), (904, "W1\tw2"), (905, rows[0][1]), (905, rows[0][1]), (None, rows[3][1]),
             (906, " ".join(f"x{i}" for i in range(30_000))), (907, " ".join(f"x{i}" for i in range(29_000)))]
    got = jaccard_join.join_components(make(rows), n=n, num=num, den=den).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, n, num, den)


def test_many_near_copies_and_a_hot_passage(make):
    rng = random.Random(4)
    base, hot = [f"b{i}" for i in range(120)], " ".join(f"h{i}" for i in range(60))
    rows = []
    for i in range(300):
        own = list(base)
        for _ in range(2):
            own[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, hot + " " + " ".join(f"u{i}_{j}" for j in range(rng.choice([2, 5, 40])))) for i in range(150)]
    got = jaccard_join.join_components(make(rows), n=4, num=85, den=100).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 4, 85, 100)


def test_empty_table(make):
    assert jaccard_join.join_components(make([])).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def test_a_rare_passage_in_a_third_of_unlike_documents(make):
    rng = random.Random(8)
    passage = " ".join(f"rare{i}" for i in range(40))
    rows = []
    for i in range(240):
        own = [f"c{rng.randrange(300)}" for _ in range(rng.choice([12, 60, 160, 162]))]
        at = rng.randrange(len(own))
        text = " ".join(own[:at] + ([passage] if i % 3 == 0 else []) + own[at:])
        rows.append((i, text))
        if i % 10 == 0:
            rows += [(1000 + i, text + " tail"), (2000 + i, text.replace(" c1", " d1", 3))]
    for n, num, den in ((5, 80, 100), (4, 85, 100), (3, 50, 100)):
        got = jaccard_join.join_components(make(rows), n=n, num=num, den=den).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, n, num, den)


def test_tokens_of_the_same_sets_are_one_row(spark):
    held = [(t, r, at, s) for t, r, at, s in [(1, 1, 0, True), (1, 2, 3, True), (2, 1, 1, True), (2, 2, 4, True), (3, 1, 2, True), (3, 2, 5, False),
                                              (4, 1, 3, True), (4, 3, 0, True)]]
    got = jaccard_join._collapsed(spark.createDataFrame(held, "token long, rep long, at int, short boolean")).collect()
    assert sorted((r.token, r.times) for r in got) == [(1, 2), (3, 1), (4, 1)]


@pytest.fixture
def written(monkeypatch):
    """(name, number of exchanges planned) of each table that is written."""
    out = []

    def recorded(df, name="step"):
        out.append((name, df._jdf.queryExecution().executedPlan().toString().count("Exchange")))
        return materialize(df, name)

    for module in (jaccard_join, components_module):
        monkeypatch.setattr(module, "materialize", recorded)
    return out


def test_no_query_of_the_join_plans_a_step_again_in_each_branch(make, written):
    # The driver holds all stages of a query at once, whatever the tables' size.
    rows = list(enumerate(documents(1, 60)))
    got = jaccard_join.join_components(make(rows), n=5, num=80, den=100).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 5, 80, 100)
    assert max(exchanges for _, exchanges in written) <= 20, written


def test_links_that_are_stars_already_take_no_round(spark, written):
    got = dict(components(spark.createDataFrame([(9, 1), (8, 1), (2, 7)], "a long, b long")).collect())
    assert got == {1: 1, 8: 1, 9: 1, 2: 2, 7: 2} and [name for name, _ in written] == ["links"]
    assert dict(components(spark.createDataFrame([], "a long, b long")).collect()) == {}
