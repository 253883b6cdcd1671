import random
import re

from devicelens.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, items, window=10):
    out = []
    for doc, text in docs:
        w, hit, names = WORD.findall(lower(text)), set(), set()
        for item, t in items:
            b = WORD.findall(lower(t))
            size = min(window, len(b))
            for s in range(len(b) - size + 1 if size else 0):
                for p in range(len(w) - size + 1):
                    if w[p : p + size] == b[s : s + size]:
                        hit |= set(range(p, p + size))
                        names.add(item)
        out.append((doc, len(w), len(hit), tuple(sorted(str(n) for n in names if n is not None)), bool(hit)))
    return sorted(out, key=str)


def example():
    rng = random.Random(5)
    word = lambda: rng.choice("the of and zu été ab c1 x9 lo mi".split())
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 2, 9, 10, 11, 30])))) for i in range(14)]
    items += [(3, "Same ID, other text: one two three four five six seven eight"), (None, "nameless item here"), (20, None), (2, items[2][1])]
    docs = []
    for i in range(40):
        parts = [word() for _ in range(rng.randrange(0, 60))]
        if i % 3 == 0:
            parts += rng.choice(items)[1].upper().split() if rng.choice(items)[1] else []
        docs.append((i, ", ".join(parts)))
    docs += [(50, None), (51, ""), (52, "--- !!!"), (53, docs[0][1]), (53, docs[0][1]), (None, items[6][1]), (54, "Nameless item\nhere " + "filler " * 20_000)]
    return docs, [(i, t or None) for i, t in items]


def test_equals_brute_force(spark, make):
    docs, items = example()
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, row_id string")
    got = decontaminate.decontaminate(make(docs), bench).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got), key=str)
    assert got == brute(docs, items)


def test_proximity_equals_brute_force(spark, make):
    docs, items = example()
    items = [(i, t) for i, t in items[:14] if t]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.start) for r in decontaminate.proximity_matches(make(docs), bench, window=4, reach=6).collect()}
    total = {}
    for _, t in docs:
        for w in WORD.findall(lower(t)):
            total[w] = total.get(w, 0) + 1
    for doc, text in docs:
        w = WORD.findall(lower(text))
        if len(w) > 1000:
            continue
        for item, t in items:
            b = WORD.findall(lower(t))
            size = min(4, len(b))
            for s in range(len(b) - size + 1):
                terms = set(b[s : s + size])
                least = min(total.get(x, 0) for x in terms)
                seeds = [x for x in terms if total.get(x, 0) == least]
                near = [all(any(abs(q - p) <= 6 for q in range(len(w)) if w[q] == x) for x in terms) for seed in seeds
                        for p in range(len(w)) if w[p] == seed]
                if (doc, str(item), s) in got:
                    assert any(near)
                elif len(seeds) == 1:
                    assert not any(near)


def test_empty_tables(spark, make):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = decontaminate.decontaminate(make([(1, "a b"), (2, None)]), none).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in rows) == [(1, 2, 0, False), (2, 0, 0, False)]
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.decontaminate(make([]), bench).count() == 0
