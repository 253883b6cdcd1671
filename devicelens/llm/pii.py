"""Operator 7: personal data by patterns, checksums and context (DataFrame functions only).

Regular expressions propose spans, checks confirm them (octets of an address,
Luhn for cards, mod-97 for account numbers, digit counts for phones), and
context words nearby raise a span's score. The query returns every span's score
in hundredths (``scores``, in the order of ``spans``).

The patterns equal the documented ones but loop over single characters only,
so a run of any length needs no stack: separators or dots that can't be part
of a match are first replaced by another character of the same length, which
leaves every position as it was. Positions come from the lengths of the
matches and of the text between them, in code points.

Kinds, in order: email, ip, card, phone, iban. The first four are the base
kinds of the contract; failing matches are dropped without retries.

Edge cases: a NULL or empty text has no spans; a text of any length is
searched whole; repeated rows are reported once each; NULL ids stay; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban")

# Dots that don't stand between two characters of a domain label; "%" is a
# local-part character like the dot, but none of a domain.
LOOSE_DOT = r"(?<![A-Za-z0-9-])\.|\.(?![A-Za-z0-9-])"
# Separators that don't stand between two digits.
LOOSE_SEPARATOR = r"(?<![0-9])[ -]|[ -](?![0-9])"
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9][0-9 -]*[0-9]",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}",
}
# Score of a confirmed span, and the words that add CONTEXT_BONUS within CONTEXT_CHARS before or after it.
SCORES = {"email": 0.85, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8}
CONTEXT = {
    "email": "mail|e-mail|contact|write|address",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|master|credit|debit|payment|cvv",
    "phone": "phone|tel|call|mobile|fax|whatsapp",
    "iban": "iban|bank|account|transfer|swift|bic",
}
CONTEXT_CHARS, CONTEXT_BONUS = 40, 0.15


def _octets(match: Column) -> Column:
    octet = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return match.rlike(rf"^{octet}\.{octet}\.{octet}\.{octet}$")


def _luhn(match: Column) -> Column:
    digits = F.reverse(F.regexp_replace(match, "[ -]", ""))
    size = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), F.lit(0), add)
    return F.when(size.between(13, 19), total % 10 == 0).otherwise(F.lit(False))


def _mod97(match: Column) -> Column:
    moved = F.concat(F.substring(match, F.lit(5), F.length(match)), F.substring(match, 1, 4))

    def fold(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(fold(r, c))) == 1


CONFIRMED = {
    "email": lambda m: F.lit(True),
    "ip": _octets,
    "card": _luhn,
    "phone": lambda m: F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15),
    "iban": _mod97,
}
SPAN = "array<struct<start:int,end:int,match:string>>"


def _spans(kind: str, found: Column, gaps: Column) -> Column:
    """Confirmed spans from the matches and the text around them."""

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["found"])
        span = F.array(F.struct(start.alias("start"), end.alias("end"), x["found"].alias("match")))
        return F.struct(F.when(CONFIRMED[kind](x["found"]), F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
                        end.alias("at"))

    zipped = F.arrays_zip(found.alias("found"), F.slice(gaps, F.lit(1), F.size(found)).alias("gap"))
    return F.aggregate(zipped, F.struct(F.array().cast(SPAN).alias("spans"), F.lit(0).alias("at")), step, lambda s: s["spans"])


def detect(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, spans``: array of ``(kind, start, end, match, score)`` by kind, then start; end is exclusive."""
    whole = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    # Each kind's text, empty where it can't match at all.
    seen = whole.select(
        "doc_id", "t",
        F.when(F.contains("t", F.lit("@")), F.regexp_replace("t", LOOSE_DOT, "%")).otherwise("").alias("t_email"),
        F.when(F.col("t").rlike("[0-9][0-9 -]*[0-9]"), F.regexp_replace("t", LOOSE_SEPARATOR, "#")).otherwise("").alias("t_card"),
        F.when(F.col("t").rlike(r"[0-9]\.[0-9]"), F.col("t")).otherwise("").alias("t_ip"),
        F.when(F.contains("t", F.lit("+")), F.col("t")).otherwise("").alias("t_phone"),
        F.when(F.col("t").rlike("[A-Z]{2}[0-9]{2}[A-Z0-9]{11}"), F.col("t")).otherwise("").alias("t_iban"))
    matched = seen.select("doc_id", "t", *[c for k in KINDS for c in (
        F.regexp_extract_all(f"t_{k}", F.lit(PATTERNS[k]), F.lit(0)).alias(f"found_{k}"), F.col(f"t_{k}"))])
    matched = matched.select("doc_id", "t", *[c for k in KINDS for c in (
        F.col(f"found_{k}"),
        F.when(F.size(f"found_{k}") > 0, F.split(f"t_{k}", PATTERNS[k], -1)).otherwise(F.array().cast("array<string>")).alias(f"gaps_{k}"))])
    spans = matched.select("doc_id", "t", *[
        F.when(F.size(f"found_{k}") > 0, _spans(k, F.col(f"found_{k}"), F.col(f"gaps_{k}")))
        .otherwise(F.array().cast(SPAN)).alias(k) for k in KINDS])

    def scored(kind: str):
        def one(s: Column) -> Column:
            before = F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0))
            around = F.lower(F.concat_ws(" ", F.substring(F.col("t"), before + 1, s["start"] - before),
                                         F.substring(F.col("t"), s["end"] + 1, F.lit(CONTEXT_CHARS))))
            score = F.lit(SCORES[kind]) + F.when(around.rlike(rf"(^|[^a-z])({CONTEXT[kind]})"), CONTEXT_BONUS).otherwise(0.0)
            return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                            s["match"].alias("match"), score.alias("score"))
        return one

    return spans.select("doc_id", F.concat(*[F.transform(F.col(k), scored(k)) for k in KINDS]).alias("spans"))


def redact(docs: DataFrame, *, least_score: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_spans, kinds, text``: every document, its spans of that score replaced by ``[kind]``.

    Overlapping spans are replaced together, by the kind that starts first
    (then the longer one). A NULL text stays NULL; repeated rows are redacted
    each; characters outside spans stay as they are.
    """
    # The text travels with its id, so rows that share an id keep their own.
    found = detect(docs.select(F.struct(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).alias("row"), F.col(text).alias("t")),
                   doc_id="row", text="t")
    kept = F.filter("spans", lambda s: s["score"] >= least_score)
    rows = found.select(F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.text").alias("t"), kept.alias("kept"))
    ordered = F.array_sort(F.transform("kept", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("last"), s["kind"].alias("kind"))))

    def step(state: Column, s: Column) -> Column:
        end = -s["last"]
        pieces = F.array(F.substring(F.col("t"), state["at"] + 1, s["start"] - state["at"]), F.concat(F.lit("["), s["kind"], F.lit("]")))
        return F.struct(F.when(s["start"] >= state["at"], F.concat(state["out"], pieces)).otherwise(state["out"]).alias("out"),
                        F.greatest(state["at"], end).alias("at"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))
    clean = F.aggregate(ordered, start, step, lambda s: F.concat(F.concat_ws("", s["out"]), F.substring(F.col("t"), s["at"] + 1, F.length("t"))))
    return rows.select("doc_id", F.size("kept").cast("long").alias("n_spans"),
                       F.array_distinct(F.transform("kept", lambda s: s["kind"])).alias("kinds"),
                       F.when(F.size("kept") == 0, F.col("t")).otherwise(clean).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, as counts, digests, positions and scores of the spans."""
    found = detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(F.concat_ws(",", F.transform(of(*BASE_KINDS), line)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("spans", line)).alias("spans"),
        F.concat_ws(",", F.transform("spans", lambda s: F.round(s["score"] * 100).cast("int").cast("string"))).alias("scores"))


_BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}",
}
_VALID = {
    "email": "true",
    "ip": "list_bool_and(list_transform(string_split(m, '.'), lambda p: CAST(p AS HUGEINT) <= 255))",
    "card": """length(regexp_replace(m, '[ -]', '', 'g')) BETWEEN 13 AND 19 AND list_sum(list_transform(
      range(1, length(regexp_replace(m, '[ -]', '', 'g')) + 1), lambda i: CASE WHEN i % 2 = 1
        THEN CAST(substring(reverse(regexp_replace(m, '[ -]', '', 'g')), i, 1) AS INT)
        ELSE (CAST(substring(reverse(regexp_replace(m, '[ -]', '', 'g')), i, 1) AS INT) * 2) // 10
           + (CAST(substring(reverse(regexp_replace(m, '[ -]', '', 'g')), i, 1) AS INT) * 2) % 10 END)) % 10 = 0""",
    "phone": "length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 9 AND 15",
    "iban": """list_reduce(list_prepend(0, list_transform(string_split(substring(m, 5) || substring(m, 1, 4), ''),
      lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN CAST(c AS INT) ELSE ascii(c) - 55 END)),
      lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1""",
}


def _oracle() -> str:
    parts = []
    for number, kind in enumerate(KINDS):
        least, more = round(100 * SCORES[kind]), round(100 * CONTEXT_BONUS)
        parts.append(f"""
  SELECT doc_id, {number} AS k, '{kind}' AS kind, s, s + length(m) AS e,
    {least} + CASE WHEN regexp_matches(lower(substring(text, greatest(s - {CONTEXT_CHARS}, 0) + 1, s - greatest(s - {CONTEXT_CHARS}, 0))
      || ' ' || substring(text, s + length(m) + 1, {CONTEXT_CHARS})), '(^|[^a-z])({CONTEXT[kind]})') THEN {more} ELSE 0 END AS score FROM (
    SELECT doc_id, text, found[i] AS m, CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g)))
      + coalesce(list_sum(list_transform(found[1 : i - 1], lambda g: length(g))), 0) AS BIGINT) AS s
    FROM (SELECT doc_id, text, regexp_extract_all(text, '{_BASE[kind]}') AS found,
        string_split_regex(text, '{_BASE[kind]}') AS gaps FROM d) AS x,
      unnest(range(1, len(found) + 1)) AS u(i)) AS y WHERE {_VALID[kind]}""")
    base = "k < 4"
    line = "kind || ':' || s || ':' || e"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE_KINDS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({' UNION ALL '.join(parts)})
SELECT d.doc_id, {counts},
  sha256(coalesce(string_agg({line}, ',' ORDER BY k, s) FILTER (WHERE {base}), '')) AS base_sha256,
  coalesce(string_agg({line}, ',' ORDER BY k, s), '') AS spans,
  coalesce(string_agg(CAST(score AS VARCHAR), ',' ORDER BY k, s), '') AS scores
FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id
"""


ORACLE_SQL = _oracle()
