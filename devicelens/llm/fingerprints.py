"""Operator 9: fingerprints by consistent weighted sampling (DataFrame functions only).

A text's terms are its lower-cased words, weighted by how often they occur.
For every sample a term draws ``r, c ~ Gamma(2, 1)`` and ``b ~ U(0, 1)`` from
hashes of itself; with ``t = floor(ln w / r + b)`` the sample takes the term of
least ``ln c - r (t - b) - r`` and records ``(term, t)``. Two texts record the
same in a sample with a probability equal to their generalised Jaccard
similarity (sum of least weights over sum of greatest), so the share of equal
samples estimates it.

Documents are dealt once, into ranges of their ids, each range in one
partition in descending order: a document's successor (whose beginning its
edited text takes) is the next row, and the first row of the following range
is added behind each range. Words, weights and samples are then aggregated
inside these partitions, and the texts are shuffled once. Range bounds are approximate quantiles of the ids; no
partition depends on what texts hold.

Edge cases: a NULL or empty text (or one without letters and digits) has an
empty fingerprint; two empty ones are alike (1.0), an empty and another one
are not (0.0); the last document is followed by the first; a single document
follows itself; rows that share an id follow each other by a hash of the text;
NULL ids come last; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from devicelens.llm.common import materialize, shuffle_partitions

SAMPLES = 32
RANGES_PER_PARTITION = 4
NOT_WORDS = r"[^\p{L}\p{N}]+"


def _uniform(bits: Column, shift: int, width: int) -> Column:
    """A number in (0, 1) from ``width`` bits."""
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1)) + 0.5) / float(1 << width)


def sample_key(term: Column, weight: Column, i: int) -> Column:
    """The value by which sample ``i`` chooses, its low 24 bits telling (term, t) apart."""
    one, two = F.xxhash64(term, F.lit(2 * i)), F.xxhash64(term, F.lit(2 * i + 1))
    r = -F.log(_uniform(one, 0, 21) * _uniform(one, 21, 21))
    b = _uniform(one, 42, 22)
    c = -F.log(_uniform(two, 0, 32) * _uniform(two, 32, 32))
    t = F.floor(F.log(weight) / r + b)
    value = F.log(c) - r * (t - b) - r
    place = F.greatest(F.least(value, F.lit(60.0)), F.lit(-60.0)) + 64
    return F.shiftleft(F.floor(place * float(1 << 31)), 24).bitwiseOR(F.xxhash64(term, t).bitwiseAND(F.lit((1 << 24) - 1)))


def _range_of(key: Column, bounds: list) -> Column:
    """Number of the range of a key; ranges descend and ``bounds`` ascends."""

    def tree(lo: int, hi: int) -> Column:  # bounds[:lo] lie below the key, bounds[hi:] don't
        if lo == hi:
            return F.lit(len(bounds) - lo)
        middle = (lo + hi) // 2
        return F.when(key > bounds[middle], tree(middle + 1, hi)).otherwise(tree(lo, middle))

    return tree(0, len(bounds))


def in_descending_ranges(docs: DataFrame, ranges: int, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``part, place, ghost, doc_id, text, next_text`` in order of descending ids.

    Rows with ``ghost`` repeat the first row of the following part.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    steps = [i / ranges for i in range(1, ranges)] or [0.5]
    bounds = rows.select(order.alias("o")).agg(F.percentile_approx("o", steps, 10_000)).first()[0] or []
    bounds = sorted(set(bounds))  # at most one per range
    rows = rows.select(_range_of(order, bounds).alias("part"), order.alias("o"), F.xxhash64("text").alias("tie"), "doc_id", "text")
    # The first row of each part (descending id, then ascending tie); at most one per range.
    firsts = rows.groupBy("part").agg(F.max(F.struct("o", F.bitwise_not("tie").alias("t"))).alias("f")).orderBy("part").collect()
    if not firsts:
        return rows.select("part", F.lit(0).alias("place"), F.lit(False).alias("ghost"), "doc_id", "text", F.col("text").alias("next_text"))
    parts = [r["part"] for r in firsts]
    heads = docs.sparkSession.createDataFrame([(r["part"], r["f"][0], ~r["f"][1], to) for r, to in zip(firsts, [parts[-1], *parts[:-1]])],
                                              "part int, o long, tie long, moved int")
    heads = (rows.join(F.broadcast(heads), ["part", "o", "tie"]).dropDuplicates(["part"])  # at most one row per range
             .select(F.col("moved").alias("part"), "o", "tie", "doc_id", "text"))
    heads = materialize(heads, "heads")
    # Never a NULL part or tie: then no plan over these rows filters them before the exchange, and plans can share it.
    heads = heads.select(F.coalesce("part", F.lit(0)).alias("part"), "o", F.coalesce("tie", F.lit(0)).alias("tie"), "doc_id", "text")
    every = rows.withColumn("ghost", F.lit(False)).unionByName(heads.withColumn("ghost", F.lit(True)))
    line = Window.partitionBy("part").orderBy("ghost", F.desc("o"), "tie")
    return (every.repartition(ranges, "part")
            .select("part", F.row_number().over(line).alias("place"), "ghost", "doc_id", "text", F.lead("text").over(line).alias("next_text")))


def edited_text(text: Column, following: Column) -> Column:
    """The last half of the text replaced by the beginning of the following one."""
    half = F.expr("char_length(text) div 2")
    return F.concat(F.substring(text, F.lit(1), (F.char_length(text) - half).cast("int")),
                    F.substring(F.coalesce(following, F.lit("")), F.lit(1), half.cast("int")))


def signatures(texts: DataFrame, keys: list[str], text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """``keys`` and ``signature`` (array of 32-bit numbers) of every text that has a word."""
    words = texts.select(*keys, F.explode(F.split(F.lower(text), NOT_WORDS)).alias("word")).where("word <> ''")
    terms = words.groupBy(*keys, F.xxhash64("word").alias("term")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    least = terms.groupBy(*keys).agg(*[F.min(sample_key(F.col("term"), F.col("w"), i)).alias(f"s{i}") for i in range(samples)])
    short = [F.xxhash64(f"s{i}").bitwiseAND(F.lit(2**32 - 1)) for i in range(samples)]
    return least.select(*keys, F.array(*short).alias("signature"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; two empty signatures are alike."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return F.when(a.isNull() | b.isNull(), (a.isNull() & b.isNull()).cast("double")).otherwise(same / F.size(a))


def fingerprint_text(signature: Column) -> Column:
    """Eight hex digits per sample; empty for texts without terms."""
    return F.coalesce(F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), ""), F.lit(""))


def fingerprints(docs: DataFrame, *, samples: int = SAMPLES, ranges: int | None = None, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` per row."""
    ranges = ranges or RANGES_PER_PARTITION * shuffle_partitions(docs.sparkSession)
    rows = in_descending_ranges(docs, ranges, doc_id=doc_id, text=text)
    both = rows.withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    # The signatures and the rows' other columns read the same exchange of the texts: neither prunes a column of it.
    version = lambda i, c: F.struct(F.lit(i).alias("version"), F.col(c).alias("text"))
    versions = both.select("part", "place", "doc_id", F.explode(F.when(F.col("ghost"), F.array(version(0, "text")))
                                                                .otherwise(F.array(version(0, "text"), version(1, "edited")))).alias("v"))
    signed = signatures(versions.select("part", "place", "doc_id", "v.version", "v.text"), ["part", "place", "doc_id", "version"], samples=samples)
    of = lambda i: F.max(F.when(F.col("version") == i, F.col("signature")))
    signed = signed.groupBy("part", "place").agg(of(0).alias("own"), of(1).alias("edit"))
    facts = both.select("part", "place", "ghost", "doc_id", F.char_length("text").cast("long").alias("n_chars"),
                        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    joined = facts.join(signed.hint("merge"), ["part", "place"], "left")
    following = F.lead("own").over(Window.partitionBy("part").orderBy("place"))
    return (joined.withColumn("following", following).where("NOT ghost")
            .select("doc_id", "n_chars", "edited_sha256", fingerprint_text(F.col("own")).alias("fingerprint"),
                    fingerprint_text(F.col("edit")).alias("edited_fingerprint"),
                    likeness(F.col("own"), F.col("edit")).alias("near_edited"),
                    likeness(F.col("own"), F.col("following")).alias("near_next")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
