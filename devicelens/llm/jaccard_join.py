"""Operator 2: exact n-gram Jaccard self-join with a token-group matrix.

A document's tokens are the hashes of its distinct word n-grams. Two documents
link when ``den * |intersection| >= num * |union|``. All links that matter for
connectivity between different token sets are found; equal sets are one class
from the start.

1. A fixed-size counting sketch of the n-grams of all documents gives tokens a
   common order, the rarest first, so that a passage that unlike documents
   share stands behind what is their own. Linked sets must share one of their
   first ``n - ceil(t n) + 1`` tokens, and the smaller one holds it among its
   first ``n - ceil(2 t n / (1 + t)) + 1``; sets none of whose first tokens
   occur like that in another set are done. A slot's other n-grams only blur
   the order.
2. Grouping: the remaining sets are grouped by similarity. Sets that share a
   min-hash are compared with one drawn among them, in a few rounds; links
   found this way make groups whose members are connected already, however
   many there are, at a few comparisons a set.
3. Token-group matrix: groups are stored in blocks of bounded size, each with
   the union of its members' tokens. The matrix's first-token rows
   ``(token, block)`` give each set the blocks of *other* groups that could
   hold a partner; the set's overlap with the block's union bounds that with
   any member. Only blocks that reach the needed overlap are opened and their
   members compared. No pair inside a group is ever looked at again. First
   tokens held by the same sets, such as those of one passage, are one row of
   the matrix with their number.
4. Connected components of the links, in rounds written to the shared folder.

A token that very many documents share is late in the order, and a group of
very many near copies is one group after step 2, so neither makes pairs.
Tokens are 64-bit hashes; sets are equal when their 128-bit digests are.

Edge cases: a NULL or empty text, or one without words, has no tokens and
links with nothing; fewer words than n make one token; repeated rows are one
class and all are returned; NULL ids stay; a component's id is its smallest
id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from devicelens.llm.common import (WordHasher, bound_arrow_batches, materialize, shingle_hashes, space_words,
                                   text_slices, uint64_sets)
from devicelens.llm.components import components

SKETCH_SLOTS = 1 << 22
SKETCH_BLOCK = 1 << 16
MIN_HASHES, AGREEING = 8, 5  # of a pair that is compared early
BLOCK_MEMBERS = 16
STAR_ROUNDS = 3  # of comparing sets with heads of their min-hash buckets


def _text_words(column, hasher: WordHasher) -> Iterator[np.ndarray]:
    """The word hashes of each text."""
    for _, _, data, offsets in text_slices(column):
        words, bounds = hasher(data, offsets)
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            yield words[lo:hi]


def _slots(tokens: np.ndarray) -> np.ndarray:
    return (tokens % np.uint64(SKETCH_SLOTS)).astype(np.int64)


def _whole_ngrams(words: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """The n-grams of a slice's texts that don't cross from one text into the next."""
    if len(words) < n:
        return words[:0]
    ends = np.zeros(len(words) + n, bool)
    for back in range(1, n):
        ends[np.maximum(bounds - back, 0)] = True
    ngrams = shingle_hashes(words, n)
    return ngrams[~ends[: len(ngrams)]]


def _sketch(docs: DataFrame, text: str, n: int) -> np.ndarray:
    """Eight times the binary logarithm of the n-gram counts by slot, over all documents; a fixed number of slots."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = WordHasher(space_words()), np.zeros(SKETCH_SLOTS, np.uint32)
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                slots, number = np.unique(_slots(_whole_ngrams(*hasher(data, offsets), n)), return_counts=True)
                total[slots] += number.astype(np.uint32)
        parts = total.reshape(-1, SKETCH_BLOCK)
        if total.any():
            for i, part in enumerate(parts):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())],
                                                 ["block", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(SKETCH_BLOCK, np.int64)
        for c in table.column("counts"):
            total += np.frombuffer(zlib.decompress(c.as_py()), np.uint32)
        total = np.minimum(total, 2**31 - 1).astype(np.uint32)
        return pa.table({"block": table.column("block")[:1], "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    rows = docs.select(F.col(text).alias("text")).mapInArrow(count, "block int, counts binary")
    rows = rows.withColumn("of", F.floor(F.spark_partition_id() / 256))  # at most 256 parts are added at once
    def level(table: pa.Table) -> pa.Table:
        total = np.frombuffer(zlib.decompress(add(table).column("counts")[0].as_py()), np.uint32)
        levels = np.round(8 * np.log2(1.0 + total)).astype(np.uint8)  # at most 248: a byte a slot for the driver
        return pa.table({"block": table.column("block")[:1], "counts": pa.array([zlib.compress(levels.tobytes(), 1)], pa.binary())})

    rows = rows.groupBy("block", "of").applyInArrow(add, "block int, counts binary")
    rows = rows.groupBy("block").applyInArrow(level, "block int, counts binary")
    sketch = np.zeros((SKETCH_SLOTS // SKETCH_BLOCK, SKETCH_BLOCK), np.uint8)
    for r in rows.collect():  # the sketch's fixed size
        sketch[r["block"]] = np.frombuffer(zlib.decompress(r["counts"]), np.uint8)
    return sketch.reshape(-1)


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    raw = xxhash.xxh3_128_digest(tokens.tobytes())
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def _profiles(docs: DataFrame, n: int, num: int, den: int, doc_id: str, text: str) -> DataFrame:
    """Per row: size and digest of its token set, min-hashes and first tokens."""
    sketch = docs.sparkSession.sparkContext.broadcast(_sketch(docs, text, n))
    salts = (np.arange(1, MIN_HASHES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, order = WordHasher(space_words()), sketch.value
        for batch in batches:
            sizes, digests, keys, first = [], [], [], []
            for words in _text_words(batch.column(2), hasher):
                tokens = np.unique(shingle_hashes(words, n))
                size = len(tokens)
                sizes.append(size)
                digests.append(_digest(tokens))
                if size:
                    many = size - -(-num * size // den) + 1
                    first.append(tokens[np.lexsort((tokens, order[_slots(tokens)]))[:many]].view(np.int64))
                    keys.append(np.array([(tokens * salt).min() for salt in salts]).view(np.int64))
                else:
                    first.append(np.zeros(0, np.int64))
                    keys.append(np.zeros(0, np.int64))
            lists = []
            for part in (keys, first):
                ends = np.concatenate(([0], np.cumsum([len(x) for x in part])))
                lists.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*part, np.zeros(0, np.int64)]), pa.int64())))
            hi, lo = ([d[i] for d in digests] for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), *lists],
                ["row_id", "doc_id", "n", "hi", "lo", "keys", "first"])

    kind = docs.schema[doc_id].dataType.simpleString()
    chosen = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return materialize(chosen.mapInArrow(
        profile, f"row_id long, doc_id {kind}, n long, hi long, lo long, keys array<long>, first array<long>"), "profiles")


def _token_sets(docs: DataFrame, wanted: DataFrame, n: int, doc_id: str, text: str) -> DataFrame:
    """``(rep, n, tokens)`` of the wanted classes ``(rep, doc_id, hi, lo)``, read from the texts again."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(space_words())
        for batch in batches:
            rep, hi, lo = (batch.column(i).to_pylist() for i in range(3))
            out = []
            for i, words in enumerate(_text_words(batch.column(3), hasher)):
                tokens = np.unique(shingle_hashes(words, n))
                if _digest(tokens) == (hi[i], lo[i]):  # another row may have the same id
                    out.append((rep[i], len(tokens), tokens.tobytes()))
            reps, sizes, blobs = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())],
                                             ["rep", "n", "tokens"])

    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    # The classes grow with the documents: one plan at every size, never a broadcast.
    found = (texts.join(wanted.hint("merge"), F.col("id").eqNullSafe(F.col("doc_id"))).select("rep", "hi", "lo", "text")
             .mapInArrow(sets, "rep long, n long, tokens binary"))
    return materialize(found.dropDuplicates(["rep"]), "sets")


def _overlap(rows: DataFrame, keep) -> DataFrame:
    """The long columns of ``rows`` and their ``overlap``, where ``keep(overlap, *long columns)`` holds for ``left`` and ``right``."""
    columns = [c for c in rows.columns if c not in ("left", "right")]

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in
                               zip(uint64_sets(batch.column(len(columns))), uint64_sets(batch.column(len(columns) + 1)))], np.int64)
            values = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(columns))]
            kept = pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(number)], [*columns, "overlap"])
            yield kept.filter(pa.array(keep(number, *values), pa.bool_()))

    return rows.select(*columns, "left", "right").mapInArrow(test, ", ".join(f"{c} long" for c in (*columns, "overlap")))


def _linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``(a, b)`` that link, compared token by token."""
    a = sets.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("left"))
    b = sets.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("right"))
    rows = pairs.select("a", "b").join(b, "b").join(a, "a").select("a", "b", "n_a", "n_b", "left", "right")
    return materialize(_overlap(rows, lambda both, a, b, x, y: den * both >= num * (x + y - both)).select("a", "b"), "linked")


def _unions(members: DataFrame) -> DataFrame:
    """Token union of each block ``(group, block)`` of at most some dozens of sets."""

    def unite(table: pa.Table) -> pa.Table:
        every = np.unique(np.concatenate(uint64_sets(table.column("tokens").combine_chunks())))
        return pa.table({"group": table.column("group")[:1], "block": table.column("block")[:1],
                         "right": pa.array([every.tobytes()], pa.binary())})

    return members.groupBy("group", "block").applyInArrow(unite, "group long, block long, right binary")


def similar_classes(docs: DataFrame, *, n: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """``row_id, doc_id, n_shingles, component``: rows in one component are linked directly or through others."""
    bound_arrow_batches(docs.sparkSession)
    rows = _profiles(docs, n, num, den, doc_id, text)
    classes = rows.where("n > 0").groupBy("hi", "lo").agg(F.min("row_id").alias("rep"))
    rep_of = materialize(rows.select("row_id", "doc_id", "n", "hi", "lo").join(classes, ["hi", "lo"], "left")
                         .withColumn("rep", F.coalesce("rep", "row_id")), "classes")
    alone = rep_of.where("row_id = rep AND n > 0").select("rep")

    # First tokens that occur in several classes, in the short prefix of one at least.
    first = (rows.select(F.col("row_id").alias("rep"), F.col("n").cast("int").alias("n"), "first").join(alone, "rep", "left_semi")
             .select("rep", "n", F.posexplode("first").alias("at", "token")).withColumn("short", _in_short_prefix(num, den)))
    shared = first.groupBy("token").agg(F.count(F.lit(1)).alias("in"), F.max("short").alias("short")).where((F.col("in") > 1) & F.col("short"))
    first = materialize(first.join(shared.select("token"), "token"), "first")
    near = first.select("rep").distinct()

    # Groups: sets that agree in most min-hashes with the head of one of their buckets are
    # compared with it. This only finds links early; what it misses is found below.
    keys = materialize(rows.select(F.col("row_id").alias("rep"), "n", "keys").join(near, "rep", "left_semi"), "keys")
    buckets = _buckets(keys)
    sets = links = grouped = tested = None
    for turn in range(STAR_ROUNDS):
        stars = _stars(buckets, links, grouped, turn, num, den)
        if tested is None:
            stars = tested = materialize(stars, "stars")
            fetched = materialize(stars.select(F.col("a").alias("rep")).union(stars.select("b")).distinct(), "fetched")
            sets = _token_sets(docs, _classes(rep_of, fetched), n, doc_id, text)
            buckets = _buckets(materialize(keys.join(fetched, "rep", "left_semi"), "keys"))
        else:
            stars = materialize(stars.join(tested, ["a", "b"], "left_anti"), "stars")
            tested = tested.unionByName(stars)
        found = _linked(stars, sets, num, den)
        links = found if links is None else links.unionByName(found)
        grouped = components(links, rounds=1 if turn + 1 < STAR_ROUNDS else None)
    grouped = materialize(grouped, "grouped")
    sizes = grouped.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    group_of = materialize(
        near.join(grouped.join(sizes, "component"), near["rep"] == F.col("node"), "left")
        .select("rep", F.coalesce("component", "rep").alias("group"),
                F.pmod(F.xxhash64("rep"), F.ceil(F.coalesce("members", F.lit(1)) / BLOCK_MEMBERS)).alias("block")), "groups")

    # Token-group matrix: blocks of other groups that hold first tokens of a set in their short prefixes.
    placed = first.join(group_of, "rep")
    several = (placed.groupBy("token").agg(F.min("group").alias("g0"), F.max("group").alias("g1"), F.max("short").alias("short"))
               .where((F.col("g0") < F.col("g1")) & F.col("short")).select("token"))
    placed = materialize(placed.join(several, "token"), "placed")
    placed = placed.join(materialize(_collapsed(placed), "collapsed"), "token")
    matrix = (placed.where("short").groupBy(F.col("token").alias("held_token"), F.col("group").alias("with_group"), F.col("block").alias("with_block"))
              .agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.expr("n - 1 - at")).alias("behind")))
    held = group_of.groupBy("group", "block").agg(F.count(F.lit(1)).alias("held"))
    needed = F.expr(f"ceil({num}L * (n_a + low) / {num + den})")
    # A set asks blocks with members of its size or smaller. Two sets have no more in common than what
    # they share up to a token and what the shorter rest behind it holds.
    asked = (placed.select("token", "times", "at", F.col("rep").alias("a"), F.col("group").alias("own"), F.col("n").alias("n_a"))
             .join(matrix, (F.col("token") == F.col("held_token")) & (F.col("own") != F.col("with_group"))
                   & (F.col("n_a") + (F.col("own") > F.col("with_group")).cast("int") > F.col("low"))
                   & _sizes_allow(F.col("n_a"), F.col("n_a"), F.col("low"), F.col("high"), num, den)
                   & (1 + F.least(F.expr("n_a - 1 - at"), F.col("behind")) >= needed))
             .groupBy("a", "n_a", F.col("with_group").alias("group"), F.col("with_block").alias("block"))
             .agg(F.sum("times").alias("common"), F.max("at").alias("last"), F.min("behind").alias("behind"), F.min("low").alias("low"))
             .join(held, ["group", "block"])
             .where((F.col("held") > 1) | (F.col("common") + F.least(F.expr("n_a - 1 - last"), F.col("behind")) >= needed))
             .select("a", F.col("n_a").cast("long").alias("n_a"), "group", "block"))
    asked = materialize(asked, "asked")
    open_members = materialize(group_of.join(asked.select("group", "block").distinct(), ["group", "block"], "left_semi"), "members")
    more = asked.select(F.col("a").alias("rep")).union(open_members.select("rep")).distinct().join(fetched, "rep", "left_anti")
    sets = sets.unionByName(_token_sets(docs, _classes(rep_of, more), n, doc_id, text))
    # A block of one member is its own union; larger ones are opened only where the union
    # qualifies, the most promising one of a group first: one link joins the whole group.
    large = open_members.groupBy("group", "block").agg(F.count(F.lit(1)).alias("held")).where("held > 1").select("group", "block")
    unions = _unions(sets.join(open_members.join(large, ["group", "block"], "left_semi"), "rep").select("group", "block", "tokens"))
    bounded = (asked.join(large, ["group", "block"], "left_semi").join(sets.select(F.col("rep").alias("a"), F.col("tokens").alias("left")), "a")
               .join(unions, ["group", "block"]).select("a", "n_a", "group", "block", "left", "right"))
    qualified = materialize(_overlap(bounded, lambda both, a, size, g, b: den * both >= num * size), "qualified")
    best = qualified.groupBy("a", "group").agg(F.max(F.struct("overlap", "block")).alias("best")).select("a", "group", "best.block")
    opened = best.unionByName(asked.join(large, ["group", "block"], "left_anti").select("a", "group", "block"))

    def compared(chosen: DataFrame) -> DataFrame:
        pairs = (chosen.join(sets.select(F.col("rep").alias("a"), F.col("n").alias("n_a")), "a")
                 .join(open_members.withColumnRenamed("rep", "b"), ["group", "block"])
                 .join(sets.select(F.col("rep").alias("b"), F.col("n").alias("n_b")), "b")
                 .where(_sizes_allow(F.col("n_a"), F.col("n_a"), F.col("n_b"), F.col("n_b"), num, den)))
        return _linked(pairs.select("a", "b"), sets, num, den)

    across = compared(opened)
    joined = across.join(group_of.withColumnRenamed("rep", "b"), "b").select("a", "group").distinct()
    rest = qualified.select("a", "group", "block").join(best, ["a", "group", "block"], "left_anti").join(joined, ["a", "group"], "left_anti")
    across = across.unionByName(compared(rest))
    # The groups are the whole closure of the early links, so their stars stand for them.
    merged = components(grouped.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(across))

    labelled = (rep_of.join(merged, rep_of["rep"] == F.col("node"), "left")
                .select("row_id", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component")))
    return materialize(labelled, "components")


def _in_short_prefix(num: int, den: int):
    """Whether place ``at`` of a set of ``n`` is among those of which a linked set, at least as large, holds one.

    The two have at least ``ceil(2 t n / (1 + t))`` tokens in common.
    """
    return F.expr(f"at <= n - ceil({2 * num}L * n / {num + den})")


def _collapsed(held: DataFrame) -> DataFrame:
    """``(token, times)``: the first of all tokens that the same sets hold in the same prefixes, with their number.

    ``held`` has a row ``(token, rep, at, short)`` per token and holder; holders
    are compared by their number and a 128-bit digest.
    """
    lists = held.groupBy("token").agg(
        *[F.bit_xor(F.xxhash64("rep", "short", F.lit(i))).alias(f"h{i}") for i in range(2)],
        F.count(F.lit(1)).alias("holders"), F.min("at").alias("least_at"))
    return (lists.groupBy("h0", "h1", "holders").agg(F.min_by("token", "least_at").alias("token"), F.count(F.lit(1)).alias("times"))
            .select("token", "times"))


def _buckets(keys: DataFrame) -> DataFrame:
    """``keys`` of the sets that share a min-hash: ``rep, n, keys``, the sizes of their buckets in all, and a bit per shared min-hash.

    Written once, so that drawing heads from it reads a table and not the
    joins behind it again for each of its branches.
    """
    each = keys.select("rep", F.posexplode("keys").alias("i", "key"))
    sizes = each.groupBy("i", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    common = each.join(sizes, ["i", "key"]).groupBy("rep").agg(F.sum("size").alias("common"), F.bit_or(F.expr("shiftleft(1, i)")).alias("shared"))
    return materialize(keys.join(common, "rep"), "buckets")


def _stars(buckets: DataFrame, links: DataFrame | None, grouped: DataFrame | None, turn: int, num: int, den: int) -> DataFrame:
    """Pairs ``(a, b)`` of a set and the head of one of its min-hash buckets, not in one group yet.

    Heads are drawn from the sets whose min-hashes are the most common in
    their buckets and which linked with the most earlier heads: those lie in
    the middle of a group of near copies. The draw differs between min-hashes
    and turns.
    """
    if links is None:
        own = buckets.select("*", F.col("rep").alias("own"), F.lit(0).cast("long").alias("degree"))
    else:
        degree = links.groupBy(F.col("a").alias("rep")).agg(F.count_distinct("b").alias("degree"))
        own = (buckets.join(grouped, F.col("rep") == F.col("node"), "left").join(degree, "rep", "left")
               .select(*buckets.columns, F.coalesce("component", "rep").alias("own"), F.coalesce("degree", F.lit(0)).alias("degree")))
        own = materialize(own, "own")
    each = own.select("*", F.posexplode("keys").alias("i", "key")).where("shared & shiftleft(1, i) <> 0")
    luck = 0.85 + F.pmod(F.xxhash64("rep", "i", F.lit(turn)), F.lit(1 << 20)) * (0.15 / (1 << 20))
    drawn = F.struct((-(1 + F.col("degree")) * F.col("common") * luck).alias("order"), "rep", "n", "keys", "own")
    heads = each.groupBy("i", "key").agg(F.min(drawn).alias("head"))
    agree = F.aggregate(F.zip_with("keys", "head.keys", lambda x, y: (x == y).cast("int")), F.lit(0), lambda total, x: total + x)
    return (each.join(heads, ["i", "key"]).where((F.col("own") != F.col("head.own")) & (agree >= AGREEING))
            .where(_sizes_allow(F.col("n"), F.col("n"), F.col("head.n"), F.col("head.n"), num, den))
            .select(F.col("rep").alias("a"), F.col("head.rep").alias("b")).distinct())


def _classes(rep_of: DataFrame, reps: DataFrame) -> DataFrame:
    """What identifies the given classes' texts: ``(rep, doc_id, hi, lo)``."""
    chosen = rep_of.where("row_id = rep").join(reps, "rep", "left_semi").select("rep", "doc_id", "hi", "lo")
    return materialize(chosen, "wanted")


def _sizes_allow(low, high, other_low, other_high, num: int, den: int):
    """Whether sets of sizes in the two ranges can link at all."""
    return (other_high * den >= low * num) & (high * den >= other_low * num)


def join_components(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row; the id is the smallest ``doc_id`` of the component."""
    found = similar_classes(docs, **options)
    least = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "component").select("row_id", "doc_id", "n_shingles", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under 4-word shingles and a similarity of 0.85."""
    found = join_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=4, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 4) - 1], ' ') AS g
  FROM d, unnest(range(1, greatest(len(w) - least(len(w), 4), 0) + 2)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_in AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (
  SELECT x, y FROM both_in JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id
  WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
reach AS (
  SELECT x AS doc_id, y AS other FROM link
  UNION SELECT r.doc_id, l.y FROM reach r JOIN link l ON r.other = l.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, min(other)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach USING (doc_id) GROUP BY d.doc_id, n.n
"""
