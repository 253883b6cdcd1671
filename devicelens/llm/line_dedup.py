"""Operator 6: removal of lines that spread over many sites.

Each line's spread is the number of distinct sites (``source``) it stands on.
HyperLogLog sketches of the sites, merged by aggregation on the line's hash,
estimate it for all lines; lines whose estimate lies near the threshold get an
exact distinct count, the others are decided by the sketch alone. A line on at
least ``min_sites`` sites is boilerplate: it stays in the document with the
smallest id that holds it and is removed everywhere else.

A line found in a third of all documents is one sketch per task before the
shuffle; its exact count and its removals are plain aggregations and joins on
(line, site) and on the document.

Lines are the text between line ends, compared without surrounding blanks;
blank lines are never removed. Edge cases: a NULL text stays NULL and has no
lines; a text of any length is handled whole; a NULL site counts as no site;
the rows of a line's smallest id all keep it; an empty table gives an empty
result; other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from devicelens.llm.common import materialize

MIN_SITES = 10
SKETCH_LOG2 = 12  # relative error 1.6 %
# Estimates within this share of the threshold (15 standard errors) are counted exactly.
NEAR = 0.25


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """Hash of a line without surrounding blanks; NULL for a blank line."""
    return F.when(F.trim(line) != "", F.xxhash64(F.trim(line)))


def spread_lines(docs: DataFrame, *, min_sites: int = MIN_SITES, doc_id: str = "doc_id", site: str = "source",
                 text: str = "text") -> DataFrame:
    """(``line``, ``keeper``) of lines on at least ``min_sites`` sites; keeper is the smallest id that holds it."""
    lines = docs.select(F.col(doc_id).alias("doc_id"), F.col(site).alias("site"),
                        F.explode(F.array_distinct(F.transform(_lines(F.col(text)), _key))).alias("line")).where("line IS NOT NULL")
    sketched = (lines.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(SKETCH_LOG2)).alias("sites"), F.min("doc_id").alias("keeper"))
                .select("line", "keeper", F.hll_sketch_estimate("sites").alias("sites"))
                .where(F.col("sites") >= min_sites * (1 - NEAR)))
    sketched = materialize(sketched, "sketched")
    near = sketched.where(F.col("sites") <= min_sites * (1 + NEAR))
    exact = (lines.join(near.select("line"), "line", "left_semi").groupBy("line").agg(F.count_distinct("site").alias("exact"))
             .where(F.col("exact") >= min_sites).select("line"))
    sure = sketched.where(F.col("sites") > min_sites * (1 + NEAR)).select("line", "keeper")
    return materialize(sure.union(near.join(exact, "line").select("line", "keeper")), "spread")


def remove_spread_lines(docs: DataFrame, *, min_sites: int = MIN_SITES, doc_id: str = "doc_id", site: str = "source",
                        text: str = "text") -> DataFrame:
    """``docs`` with the cleaned text and the columns ``__lines`` and ``__removed`` (numbers of lines)."""
    spread = spread_lines(docs, min_sites=min_sites, doc_id=doc_id, site=site, text=text)
    of_text = F.xxhash64(F.col(text))
    held = docs.select(F.col(doc_id).alias("__id"), of_text.alias("__of"),
                       F.explode(F.array_distinct(F.transform(_lines(F.col(text)), _key))).alias("line"))
    gone = (held.join(spread, "line").where("NOT (__id <=> keeper)").groupBy("__id", "__of")
            .agg(F.collect_set("line").alias("__gone")))
    gone = materialize(gone, "gone")
    # The removals grow with the documents: one plan at every size, never a broadcast. Rows are told apart by
    # id and text, so rows that share an id have an array of their own lines each.
    joined = docs.join(gone.hint("merge"), docs[doc_id].eqNullSafe(gone["__id"]) & (of_text == gone["__of"]), "left").drop("__id", "__of")
    kept = F.filter(_lines(F.col(text)), lambda x: ~F.coalesce(F.array_contains("__gone", _key(x)), F.lit(False)))
    cut = joined.withColumn("__kept", F.when(F.col("__gone").isNotNull(), kept))
    before = F.when(F.col(text).isNull(), 0).otherwise(F.size(_lines(F.col(text))))
    return cut.select(*[F.when(F.col("__kept").isNull(), F.col(text)).otherwise(F.array_join("__kept", "\n")).alias(c) if c == text else F.col(c)
                        for c in docs.columns],
                      before.cast("long").alias("__lines"),
                      F.when(F.col("__kept").isNull(), 0).otherwise(before - F.size("__kept")).cast("long").alias("__removed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that stand on ten sites or more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return remove_spread_lines(docs).select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), "text")


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, source, i, line, trim(line) AS key FROM (
    SELECT doc_id, source, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS line
    FROM (SELECT doc_id, source, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL) AS x) AS y),
spread AS (
  SELECT key, min(doc_id) AS keeper FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT source) >= 10),
kept AS (
  SELECT doc_id, count(*) AS n_lines, count(keeper) FILTER (WHERE doc_id <> keeper) AS n_removed,
    string_agg(line, chr(10) ORDER BY i) FILTER (WHERE keeper IS NULL OR doc_id = keeper) AS text
  FROM l LEFT JOIN spread USING (key) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
