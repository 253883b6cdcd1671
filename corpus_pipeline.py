"""Corpus pipeline: language identification, line dedup, near-duplicate removal,
benchmark decontamination and packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its
predecessor kept; its result is written as Parquet and reread as the next
one's ``docs``. All stages but the last return the columns of ``documents``.
Near copies and contamination are decided row by row, whatever the ids: rows
are numbered once a stage, and the numbers found are taken out. These joins
have a merge hint: what they drop grows with the documents, so they follow one
plan at every size. An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from devicelens.llm import decontaminate, jaccard_join, language_id, line_dedup, packing
from devicelens.llm.common import bound_arrow_batches, materialize, with_row_id


def _fresh(name: str, docs: DataFrame) -> str:
    """``name``, made longer until no column of ``docs`` has it."""
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """(``docs`` with a fixed number of each row, that column's name)."""
    row = _fresh("__row", docs)
    return materialize(with_row_id(docs, row), "rows"), row


def _without(rows: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """The rows whose number is not among ``__gone``, without their numbers."""
    return rows.join(gone.hint("merge"), F.col(row) == F.col("__gone"), "left_anti").drop(row)


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the models of all labelled rows understand; those without any letter go too."""
    trees = language_id.fit_trees(docs)
    bound_arrow_batches(spark)
    return docs.where(language_id.understood(F.col("text"), trees, spark))


def drop_spread_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate; those that held nothing else go."""
    cut = line_dedup.remove_spread_lines(docs)
    left = (F.col("__removed") == 0) | (F.trim(F.translate("text", "\n", " ")) != "")
    changed = F.when(F.col("__removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.where(left).withColumn("n_chars", changed).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least (id, row number) of each component under 5-word shingles and a similarity of 0.8."""
    rows, row = numbered(docs)
    rank = _fresh("__rank", rows)
    # A row's rank stands for its id: ids first in order, NULL ids last, then the row.
    ranked = rows.withColumn(rank, F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id").alias("id"), F.col(row).alias("row")))
    found = jaccard_join.join_components(ranked, n=5, num=80, den=100, doc_id=rank)
    gone = found.where("doc_id.row <> component_id.row").select(F.col("doc_id.row").alias("__gone"))
    return _without(rows, row, gone)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any 10-word window of the benchmark."""
    rows, row = numbered(docs)
    found = decontaminate.decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id=row)
    return _without(rows, row, found.where("contaminated").select(F.col("doc_id").alias("__gone")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 2048 tokens."""
    return packing.pack(docs, packing.public_vocabulary("byte_bpe_50k"))


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", drop_spread_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

# Language models and token ids can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
