import random

from devicelens.llm import line_dedup


def brute(rows, least):
    sites, keeper = {}, {}
    for i, t, s in rows:
        for x in (t or "").split("\n"):
            k = x.strip(" ")
            if k:
                sites.setdefault(k, set()).update([s] if s is not None else [])
                if i is not None:
                    keeper[k] = min(keeper.get(k, i), i)
    out = []
    for i, t, s in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        lines = t.split("\n")
        kept = [x for x in lines if not x.strip(" ") or len(sites[x.strip(" ")]) < least or keeper.get(x.strip(" ")) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def rows():
    rng = random.Random(2)
    common = [f"common line {i}" for i in range(8)]
    out = [(i, "\n".join(rng.choice([*common, f"own {i}", "", "  ", f" {common[0]} "]) for _ in range(rng.randrange(1, 9))), f"s{rng.randrange(9)}")
           for i in range(80)]
    return [*out, (90, None, "s1"), (91, "", "s1"), (92, "common line 1\n" * 5000, "s2"), (93, "common line 2", None), (5, out[5][1], "s5"), (5, out[5][1], "s5"),
            (5, "common line 3\nnot in the others", "s5"), (None, "common line 4\nwithout an id", "s6"), (None, "common line 5", "s7")]


def test_equals_brute_force(make):
    data = rows()
    for least in (3, 7, 9):
        got = line_dedup.remove_spread_lines(make([(i, t, None, s) for i, t, s in data]), min_sites=least).collect()
        assert sorted(((r.doc_id, r.text, r["__lines"], r["__removed"]) for r in got), key=str) == brute(data, least)


def test_other_columns_stay_and_empty_table(make):
    docs = make([(1, "a\nb", "en", "s")])
    assert line_dedup.remove_spread_lines(docs).drop("__lines", "__removed").collect() == docs.collect()
    assert line_dedup.remove_spread_lines(make([])).count() == 0


def test_no_python_in_the_plan(spark, sf):
    assert "Python" not in line_dedup.query(spark, sf)._jdf.queryExecution().executedPlan().toString()
