"""The rule table against a plain version, and its edge cases."""

import random
import re
from collections import Counter

from devicelens.llm import quality_rules as Q

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def brute(text):
    words = [w for w in BLANK.split(text or "") if w]
    lines = [line for line in (text or "").split("\n") if BLANK.sub("", line)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, g in enumerate(windows) if often[g] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in Q.SYMBOLS for c in text or ""), len(lines) - len(set(lines)), len(covered))


def rows(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_measures_equal_a_plain_version(make):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "b", "c#", "dé", "E", "|", "the"]) + rng.choice(["", "", "\n", "\t", "\x0b"])
                      for _ in range(rng.choice([0, 1, 2, 3, 4, 9, 60]))) for _ in range(150)]
    texts += ["a a a a", "a b c a b c", "a b c d a b c", "x y\nx y\n\n \nx y ", "\n\n", "𝕏 ñ #|<>", "a\xa0b c d"]
    got = rows(Q.apply_rules(make(list(enumerate(texts)))))
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(text), text
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.broken) and not (r.kept and r.base_failed)


def test_each_rule_breaks_alone(make):
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)} the" for i in range(60)]
    clean = " ".join(words)
    cases = {
        "word_length": " ".join(w + "x" * 40 for w in words),
        "symbols": " ".join(w + "#" for w in words),
        "stop_words": clean.replace(" the", " thx"),
        "words_without_letter": clean + " 1 2 3 4 5 6 7 8 9" * 5,
        "capitals": " ".join(w.split()[0].upper() + " the" for w in words),
        "repeated_lines": "\n".join([*words, *["same line"] * 70]),
        "bullet_lines": "\n".join("- " + w for w in words),
        "cut_lines": "\n".join(w + " ..." * (i % 2) for i, w in enumerate(words)),
        "few_words": "the only line",
        "repeated_words": clean + " " + clean,
    }
    names = [*cases]
    got = rows(Q.apply_rules(make([(i, cases[name]) for i, name in enumerate(names)] + [(99, clean)])))
    assert got[99].kept and got[99].broken == []
    for i, name in enumerate(names):
        assert name in got[i].broken and not got[i].kept, name
        assert got[i].base_failed == bool({"few_words", "repeated_words"} & set(got[i].broken))


def test_edges(spark, make):
    long = " ".join(f"w{i % 99_991} the" for i in range(200_000))
    got = Q.apply_rules(make([(1, None), (2, ""), (None, "one two"), (3, "same row"), (3, "same row"), (4, long)])).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == 6 and len(by[3]) == 2
    for i in (1, 2):
        assert (by[i][0].n_words, by[i][0].n_symbols, by[i][0].kept, by[i][0].base_failed) == (0, 0, False, True)
    assert (by[4][0].n_words, by[4][0].word_chars, *brute(long)[3:]) == (400_000, brute(long)[1], by[4][0].n_dup_lines, by[4][0].n_repeat_words)
    assert Q.apply_rules(make([]).where("false")).count() == 0


def test_other_tables_of_rules(make):
    only = (Q.Rule("short", "n_words", "one", 300, None),)
    got = rows(Q.apply_rules(make([(1, "a b"), (2, "a b c")]), base=only, rules=()))
    assert (got[1].broken, got[1].base_failed, got[2].kept) == (["short"], True, True)


def test_runs_without_python(make):
    plan = Q.apply_rules(make([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
