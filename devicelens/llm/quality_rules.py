"""Operator 11: a threshold table of text quality, compiled into one projection (DataFrame functions only).

Every rule bounds the ratio of two integer measures of a text in percent;
``compile_rules`` turns the table into one column with the names of the rules
that a text breaks. Comparisons are integer products, so no rounding decides.
Words are ``[^\\x20\\x09-\\x0D]+``, lines are split at ``\\n``; only lines with a
word count.

Repeated 3-word windows are found inside a row: the windows' 64-bit hashes are
sorted with their positions, equal neighbours mark repeated windows, and the
distances between the marked positions give the words they cover. That is
n log n for any text; nothing is exploded or shuffled. Two different windows of
a text count as one where their hashes agree (a chance below 1e-7 for a text of
a million words).

Edge cases: a NULL text counts as empty, has no words and is not kept; a text of
any length is read whole; repeated rows and NULL ids give a row each; a ratio
with a zero denominator breaks no rule; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
WINDOW = 3
ELLIPSES = ("...", "…")
BULLETS = ("-", "*", "•")
# Frequent function words of the languages served.
STOP_WORDS = tuple(sorted(set(
    "the be to of and that have with in is it for on as by at this an are was or not from "
    "le la les de des du et un une en que qui dans pour par sur est au ce pas "
    "der die das und zu den mit von ist im dem nicht ein eine auf als auch "
    "el los las y por con para del se es al su no lo".split())))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\f\r"


class Rule(NamedTuple):
    """``least <= 100 * part / whole <= most``; a bound of None is not checked."""

    name: str
    part: str
    whole: str
    least: int | None
    most: int | None


# The base rules of the contract, then the method's own.
BASE_RULES = (
    Rule("few_words", "n_words", "one", 5_000, None),
    Rule("repeated_words", "n_repeat_words", "n_words", None, 50),
)
RULES = (
    Rule("word_length", "word_chars", "n_words", 200, 1_500),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("stop_words", "n_stop_words", "n_words", 2, None),
    Rule("words_without_letter", "n_letterless", "n_words", None, 20),
    Rule("capitals", "n_capitals", "word_chars", None, 40),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 50),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 90),
    Rule("cut_lines", "n_cut_lines", "n_lines", None, 30),
)


def _breaks(rule: Rule) -> Column:
    part, whole = F.col(rule.part) * 100, F.col(rule.whole)
    low = F.lit(False) if rule.least is None else part < whole * rule.least
    high = F.lit(False) if rule.most is None else part > whole * rule.most
    return low | high


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """The names of the broken rules, in the table's order."""
    return F.array_compact(F.array(*[F.when(_breaks(r), F.lit(r.name)) for r in rules]))


def _size(array: Column) -> Column:
    return F.size(array).cast("long")


def measures(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the integer measures that the rules compare."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    split = rows.select(
        "doc_id", "t", F.array_remove(F.split("t", r"[\x20\x09-\x0D]+"), "").alias("words"),
        F.filter(F.split("t", "\n"), lambda line: F.translate(line, BLANKS, "") != "").alias("lines"))
    # A word's position, behind the hash of the window that starts there.
    hashed = split.select("*", F.transform(
        F.slice("words", 1, F.greatest(F.size("words") - (WINDOW - 1), F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("at"))).alias("windows"))
    ordered = hashed.select("*", F.when(F.size(F.array_distinct("windows.h")) < F.size("windows"), F.sort_array("windows"))
                            .otherwise(F.array().cast("array<struct<h:bigint,at:int>>")).alias("sorted")).drop("windows")
    repeated = ordered.select("*", F.sort_array(F.transform(F.filter(
        F.transform("sorted", lambda x, i: F.struct(
            x["at"].alias("at"),
            (F.get("sorted", i - 1)["h"].eqNullSafe(x["h"]) | F.get("sorted", i + 1)["h"].eqNullSafe(x["h"])).alias("twice"))),
        lambda x: x["twice"]), lambda x: x["at"])).alias("starts")).drop("sorted")
    covered = F.aggregate(
        F.transform("starts", lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", i + 1) - at, F.lit(WINDOW)))),
        F.lit(0), lambda total, x: total + x)
    counted = lambda keep: _size(F.filter("words", keep))
    lines = lambda keep: _size(F.filter("lines", keep))
    return repeated.select(
        "doc_id", _size(F.col("words")).alias("n_words"),
        F.char_length(F.translate("t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        counted(lambda w: F.translate(w, UPPER, LOWER).isin(*STOP_WORDS)).alias("n_stop_words"),
        counted(lambda w: ~w.rlike(r"\p{L}")).alias("n_letterless"),
        F.char_length(F.regexp_replace("t", r"\P{Lu}+", "")).cast("long").alias("n_capitals"),
        _size(F.col("lines")).alias("n_lines"),
        lines(lambda x: F.ltrim(x).substr(1, 1).isin(*BULLETS)).alias("n_bullet_lines"),
        lines(lambda x: F.endswith(F.rtrim(x), F.lit(ELLIPSES[0])) | F.endswith(F.rtrim(x), F.lit(ELLIPSES[1]))).alias("n_cut_lines"),
        F.lit(1).cast("long").alias("one"))


def apply_rules(docs: DataFrame, *, base: tuple[Rule, ...] = BASE_RULES, rules: tuple[Rule, ...] = RULES,
                doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, the measures, ``broken`` (names of broken rules), ``base_failed`` and ``kept``."""
    judged = measures(docs, doc_id=doc_id, text=text).select("*", compile_rules((*base, *rules)).alias("broken"))
    failed = F.exists("broken", lambda name: name.isin(*[r.name for r in base]))
    return judged.drop("one").select("*", failed.alias("base_failed"), (F.size("broken") == 0).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measures and verdict of every document."""
    found = apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                        F.array_join("broken", ",").alias("broken"))


def _oracle() -> str:
    def breaks(r: Rule) -> str:
        tests = [f"100 * {r.part} < {r.least} * {r.whole}"] * (r.least is not None) + [f"100 * {r.part} > {r.most} * {r.whole}"] * (r.most is not None)
        return "(" + " OR ".join(tests) + ")"

    names = ", ".join(f"CASE WHEN {breaks(r)} THEN '{r.name}' END" for r in (*BASE_RULES, *RULES))
    failed = " OR ".join(breaks(r) for r in BASE_RULES)
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    blank = r"[\x20\x09-\x0D]"
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (
  SELECT row, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM d, unnest(range(1, len(w) - 1)) AS u(i)),
twice AS (SELECT row, i FROM windows QUALIFY count(*) OVER (PARTITION BY row, g) > 1),
covered AS (SELECT row, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY row),
m AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '{blank}+', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
    len(list_filter(w, lambda x: translate(x, '{UPPER}', '{LOWER}') IN ({stop}))) AS n_stop_words,
    len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{{L}}'))) AS n_letterless,
    length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) AS n_capitals, len(lines) AS n_lines,
    len(list_filter(lines, lambda l: left(ltrim(l, ' '), 1) IN ('-', '*', '{BULLETS[2]}'))) AS n_bullet_lines,
    len(list_filter(lines, lambda l: suffix(rtrim(l, ' '), '...') OR suffix(rtrim(l, ' '), '{ELLIPSES[1]}'))) AS n_cut_lines, 1 AS one
  FROM d LEFT JOIN covered USING (row)),
j AS (SELECT *, list_filter([{names}], lambda x: x IS NOT NULL) AS broken FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({failed}) AS base_failed, len(broken) = 0 AS kept,
  array_to_string(broken, ',') AS broken FROM j
"""


ORACLE_SQL = _oracle()
