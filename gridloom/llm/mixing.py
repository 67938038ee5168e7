"""Mixing sources to target weights.

Each source's words are packed into blocks of ``BLOCK`` words, documents one
after another in an order that depends on hashes only. Output shards have
``SHARD`` slots; each shard draws how many of its slots each source fills (a
multinomial draw by the sources' shares of all slots). A source's slots are
numbered through the shards; slot ``i`` of pass ``e`` holds the block that a
pseudorandom permutation of the source's blocks, keyed by source and pass, puts
at ``i``. Blocks then join slots by index. A pass takes every block once, so
repeats spread evenly. Draws beyond a source's need are dropped from the last
shards, missing ones follow in a make-up shard, and the last slot of a source is
cut short: each source gives exactly the whole part of its target.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and
share ``total`` times all words; a target stops at ``most_repeats`` times its
source's words, and the excess is shared again by weight among the others.

The permutation is the swap-or-not shuffle, a bijection on any range without
rejection. All of it is DataFrame expressions. Sources may be many (web domains):
their order, targets and shares of the slots come from running sums by ranges, the
draw is a join of points with the sources' stretches of the line of slots, and no
list of sources is ever held in one row or task. Positions inside a source come
from two levels of running sums (square-root many buckets), so no source is
gathered into one task either.

A null text has no words and, like an empty one, is never taken. A null source
is a source of its own. Repeated rows are rows of their own; rows alike in id,
source and text are told apart by all their columns, so a rerun gives the same mix.
Very long texts span many blocks. An empty table gives an empty result. Only doc_id,
text and source are read; all other columns, whatever their names, travel in one struct.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.permutation import SEED, permuted
from ..operators.numbering import running
from .shared import WORD, materialize, packed, partitions, row_hash

BLOCK = 256
SHARD = 4096
#: Slots of a stretch in which drawn points look for their source.
STRETCH = 64
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, total: float = 1.0, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """(source, ord, source_size, target) from (source, size); one row a source.

    A source is capped when its cap is at most its weight times the level that the others get for a weight of 1.
    The level rises as caps free words, so it is found by repetition; each step is one sum over the sources.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = running(s, [F.col("source").isNull(), F.col("source")], ord=F.lit(1).cast("long"))
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("ord") % len(weights) + 1).cast("int")).cast("double"))
    s = materialize(s.withColumn("cap", F.col("source_size") * float(most_repeats)), "mix-targets")

    def rest(capped: Column):
        return s.agg(F.sum(F.col("source_size")).alias("words"), F.sum(F.when(capped, F.col("cap"))).alias("cap"), F.sum(F.when(~capped, F.col("w"))).alias("w"), F.count(F.when(capped, 1)).alias("n")).first()

    got, level, known = rest(F.lit(False)), 0.0, -1
    while got.w and got.n != known:
        known, level = got.n, ((got.words or 0) * float(total) - (got.cap or 0.0)) / got.w
        got = rest(F.col("cap") <= F.col("w") * F.lit(level))
    level = level if got.w else float("inf")
    return s.select("source", "ord", "source_size", F.when(F.col("cap") <= F.col("w") * F.lit(level), F.col("cap")).otherwise(F.col("w") * F.lit(level)).alias("target"))


@dataclass
class Mixture:
    """sizes: rid, doc_id, source, text_hash, row_hash, size. sources: a row each. slots: shard, ord, pass, block, take. pieces: rid, doc_id, row_hash, ord, size, block, from, to, at and the source's size and target."""

    sizes: DataFrame
    sources: DataFrame
    slots: DataFrame
    pieces: DataFrame

    def taken(self) -> DataFrame:
        """Words that the mix takes, per row of the input."""
        joined = self.pieces.join(self.slots.drop("shard", "pass").hint("merge"), ["ord", "block"], "left")  # both sides grow with the corpus: never broadcast
        words = F.greatest(F.least(F.col("to"), F.coalesce(F.col("take"), F.lit(0))) - F.col("from"), F.lit(0))
        per_row = joined.groupBy("rid", "doc_id", "size", "source_size", "target").agg(F.coalesce(F.sum(words), F.lit(0)).cast("long").alias("taken"))
        return per_row.select("doc_id", "size", "source_size", "target", "taken")

    def documents(self, docs: DataFrame) -> DataFrame:
        """The mix as documents: a row for each pass that takes words of a row, its text whole or cut to the words taken."""
        joined = self.pieces.where("size > 0").join(self.slots.drop("shard").hint("merge"), ["ord", "block"])
        joined = joined.withColumn("n", F.least(F.col("to"), F.col("take")) - F.col("from")).where("n > 0")
        runs = joined.groupBy("doc_id", "row_hash", "rid", "pass", "size").agg(F.sort_array(F.collect_list(F.struct(F.col("at").cast("int").alias("at"), F.col("n").cast("int").alias("n")))).alias("runs"))
        runs = runs.withColumnRenamed("doc_id", "run_id")
        texts = docs.select("doc_id", row_hash(docs).alias("row_hash"), packed(docs).alias("row"), F.col("text").cast("string").alias("text"))
        texts = texts.groupBy("doc_id", "row_hash").agg(F.first(F.struct("row", "text")).alias("one")).select("doc_id", "row_hash", "one.*")
        both = texts.join(runs, texts["doc_id"].eqNullSafe(runs["run_id"]) & (texts["row_hash"] == runs["row_hash"]))
        words = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))
        cut = F.array_join(F.flatten(F.transform("runs", lambda r: F.slice(words, r["at"] + 1, r["n"]))), " ")
        whole = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["n"]) == F.col("size")
        both = both.select("row", F.when(whole, F.col("text")).otherwise(cut).alias("text"))
        out = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
        return both.select(*[out.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def mix(docs: DataFrame, total: float = 1.0, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = MOST_REPEATS) -> Mixture:
    spark = docs.sparkSession
    sizes = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("text_hash"), row_hash(docs).alias("row_hash"), word_count(F.col("text").cast("string")).alias("size"))
    sizes = materialize(sizes.withColumn("rid", F.monotonically_increasing_id()), "mix-sizes")
    buckets = max(1, math.isqrt(sizes.count()))

    # where each document begins in its source: inside a bucket, then the buckets before it
    hashed = sizes.withColumn("h", F.xxhash64(F.lit(SEED), "doc_id", "text_hash")).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "row_hash", "rid").rowsBetween(Window.unboundedPreceding, 0)
    hashed = hashed.withColumn("end", F.sum("size").over(inside))
    totals = materialize(sizes.groupBy("source", F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "text_hash"), F.lit(buckets)).alias("bucket")).agg(F.sum("size").alias("size")), "mix-buckets")
    targets = source_targets(totals, total, weights, most_repeats)

    # what each source needs: whole passes, then as many slots as hold the rest
    words = F.least(F.floor(F.col("target") + 1e-6).cast("long"), F.col("source_size") * most_repeats)
    s = targets.withColumn("words", words).withColumn("blocks", F.ceil(F.col("source_size") / BLOCK).cast("long")).withColumn("tail", F.col("source_size") - (F.col("blocks") - 1) * BLOCK)
    s = s.withColumn("passes", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(0)).withColumn("rest", F.col("words") - F.col("passes") * F.col("source_size"))
    s = s.withColumn("tail_at", F.when(F.col("blocks") > 0, permuted(F.col("blocks") - 1, F.col("blocks"), F.struct("ord", "passes"), inverse=True)).otherwise(0))
    plain, shifted = F.ceil(F.col("rest") / BLOCK).cast("long"), F.ceil((F.col("rest") + BLOCK - F.col("tail")) / BLOCK).cast("long")
    s = s.withColumn("need", F.col("passes") * F.col("blocks") + F.when(plain <= F.col("tail_at"), plain).otherwise(F.when(F.col("rest") > 0, shifted).otherwise(0)))
    sources = materialize(running(s, [F.col("ord")], below=F.col("need")), "mix-sources")

    # the draw: a uniform number for each slot of a shard falls into one source's part of the line of all slots
    n = sources.agg(F.sum("need")).first()[0] or 0
    slot = spark.range(n, numPartitions=partitions(spark)).select(F.expr(f"id div {SHARD}").alias("shard"), (F.col("id") % SHARD).alias("slot"))
    drawn = slot.select("shard", F.pmod(F.xxhash64(F.lit(SEED + 2), "shard", "slot"), F.lit(max(n, 1))).alias("point")).withColumn("stretch", F.expr(f"point div {STRETCH}"))
    parts = sources.where("need > 0").select("ord", "below", (F.col("below") + F.col("need")).alias("end"))
    parts = parts.withColumn("stretch", F.explode(F.expr(f"sequence(below div {STRETCH}, (end - 1) div {STRETCH})")))
    counts = drawn.join(parts.hint("merge"), "stretch").where("point >= below and point < end").groupBy("shard", "ord").agg(F.count("*").alias("c"))
    counts = materialize(running(counts, [F.col("shard")], ["ord"], first=F.col("c")), "mix-counts")
    got = counts.groupBy("ord").agg(F.sum("c").alias("first"))
    need = sources.select("ord", "need", "blocks", "tail", "words", "source_size")
    kept = counts.join(need, "ord").withColumn("c", F.least(F.col("c"), F.col("need") - F.col("first")))
    more = need.join(got, "ord", "left").na.fill(0, ["first"]).withColumn("c", F.col("need") - F.col("first")).withColumn("shard", F.lit(-1).cast("long"))
    kept = kept.unionByName(more.select(kept.columns)).where("c > 0").repartition(partitions(spark), "ord", "shard")
    # a make-up shard may hold a hot source's many missing slots: they are dealt out anew before the costly permutation
    slots = kept.withColumn("stretch", F.explode(F.expr(f"sequence(0L, (c - 1) div {SHARD})"))).repartition(partitions(spark), "ord", "shard", "stretch")
    slots = slots.withColumn("i", F.explode(F.expr(f"sequence(first + stretch * {SHARD}, first + least(c, (stretch + 1) * {SHARD}) - 1)"))).withColumn("pass", F.expr("i div blocks")).withColumn("i", F.expr("i % blocks"))
    slots = slots.withColumn("block", permuted(F.col("i"), F.col("blocks"), F.struct("ord", "pass")))
    tail_at = permuted(F.col("blocks") - 1, F.col("blocks"), F.struct("ord", "pass"), inverse=True)
    # only the pass that a source's words run out in can be cut; its slots lie behind each other but for the short last block
    cut_pass = (F.col("pass") + 1) * F.col("source_size") > F.col("words")
    before = F.col("pass") * F.col("source_size") + F.col("i") * BLOCK - F.when(cut_pass & (F.col("i") > tail_at), BLOCK - F.col("tail")).otherwise(0)
    length = F.when(F.col("block") == F.col("blocks") - 1, F.col("tail")).otherwise(F.lit(BLOCK).cast("long"))
    take = F.when(cut_pass, F.greatest(F.least(length, F.col("words") - before), F.lit(0))).otherwise(length)
    slots = slots.select("shard", "ord", "pass", "block", take.alias("take"))

    starts = totals.withColumn("start", F.sum("size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    known = sources.select(F.col("source").alias("_s"), "ord", "source_size", "target")
    starts = starts.join(known, F.col("source").eqNullSafe(F.col("_s"))).select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), "start", "ord", "source_size", "target")
    placed = hashed.join(starts, hashed["source"].eqNullSafe(starts["_s"]) & (hashed["bucket"] == starts["_b"]))
    placed = placed.withColumn("off", F.col("start") + F.col("end") - F.col("size"))
    blocks = F.when(F.col("size") > 0, F.expr(f"sequence(off div {BLOCK}, (off + size - 1) div {BLOCK})"))
    own = ["rid", "doc_id", "row_hash", "ord", "size", "source_size", "target"]
    pieces = placed.select(*own, "off", F.explode_outer(blocks).alias("block"))
    low = F.col("block") * BLOCK
    pieces = pieces.select(*own, "block", F.coalesce(F.greatest(F.col("off"), low) - low, F.lit(0)).alias("from"), F.coalesce(F.least(F.col("off") + F.col("size"), low + BLOCK) - low, F.lit(0)).alias("to"), F.coalesce(F.greatest(F.col("off"), low) - F.col("off"), F.lit(0)).alias("at"))
    return Mixture(sizes, sources, slots, pieces)
