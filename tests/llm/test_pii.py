import re

import pytest

from devicelens.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "iban":
        return int("".join(str(int(c, 36)) for c in m[4:] + m[:4])) % 97 == 1
    return True


def brute(text):
    return [(k, m.start(), m.end()) for k in pii.KINDS for m in re.finditer(BASE[k], text or "") if valid(k, m[0])]


def texts():
    import random

    rng = random.Random(11)
    parts = ["4111 1111 1111 1111", "4111-1111-1111-1111", "5500000000000004", "1.2.3.4", "256.1.1.1", "0010.1.1.1", "1.2.3.4.5.6.7.8", "a@b.c",
             "a..b@c.d", "a@b..c", "x%y@z-.w", "a@b.c%d@e.f", "é@x.y", "+49 (30) 1234-567", "+1", "++12 3456789", "GB82WEST12345698765432", " ", "-", ".",
             "@", "+", "1", "22", "4", "中", "𝒳", "\n", "\t", "a", "Z9", "DE89370400440532013000", "- 4111", "--"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    return [*out, None, "", "no data", "1 2 " * 30_000, "9" * 60_000, "a@b" + ".c" * 30_000, "x" * 100_000 + "@a.b", "1." * 40_000, "+1" + "-" * 50_000 + "2"]


def test_equals_brute_force(make):
    rows = list(enumerate(texts()))
    got = pii.detect(make([*rows, (None, "a@b.c"), (0, rows[0][1])])).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        text = "a@b.c" if r.doc_id is None else rows[r.doc_id][1]
        assert [(s.kind, s.start, s.end) for s in r.spans] == brute(text), text and text[:80]
        assert all(text[s.start : s.end] == s.match or s.kind in ("email", "card") for s in r.spans)


def test_context_raises_the_score(make):
    got = {r.doc_id: r.spans[0].score for r in pii.detect(make([(1, "see 4111111111111111"), (2, "my credit card 4111111111111111")])).collect()}
    assert got[2] == pytest.approx(got[1] + pii.CONTEXT_BONUS)


def test_context_reaches_the_query(spark, tmp_path):
    texts = [(1, "see 4111111111111111 or 1.2.3.4"), (2, "my credit card 4111111111111111"), (3, None), (4, "x" * 39 + " 1.2.3.4 host"),
             (5, "host " + "x" * 36 + " 1.2.3.4"), (6, "ship 1.2.3.4")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.scores for r in pii.query(spark, str(tmp_path)).collect()}
    assert got == {1: "60,80", 2: "95", 3: "", 4: "75", 5: "60", 6: "60"}


def test_no_python_in_the_plan(spark, sf):
    plan = pii.query(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def cover(text, spans):
    """Spans replaced one character at a time: a covered run gives its first span's label."""
    out, at = [], 0
    for start, last, kind in sorted((s, -e, k) for k, s, e in spans):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, -last)
    return "".join(out) + text[at:]


def test_redacted_text(make):
    rows = [*((i, t) for i, t in enumerate(texts()) if len(t or "") < 1000), (3, "same id a@b.c"), (None, "𝒳 a@b.c 𝒳 1.2.3.4!"), (7, None)]
    got = sorted(((r.doc_id, r.n_spans, r.text) for r in pii.redact(make(rows)).collect()), key=repr)
    assert got == sorted(((i, len(brute(t)), t and cover(t, brute(t))) for i, t in rows), key=repr)
    assert (None, 2, "𝒳 [email] 𝒳 [ip]!") in got and (7, 0, None) in got


def test_redacts_by_score(make):
    got = pii.redact(make([(1, "host 1.2.3.4 and plain words then nothing to see here 5.6.7.8")]), least_score=0.7).first()
    assert got.text.startswith("host [ip] and") and got.text.endswith("5.6.7.8") and got.kinds == ["ip"]


def test_empty_table(make):
    assert pii.detect(make([])).count() == 0
