"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Everything is DataFrame code. Hot sources: only slim rows (id, source, size, key) are shuffled, by (source, bucket of
the seeded key), so a source with a third of all rows is dealt over BUCKETS groups; sums are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.llm.common import WORD, checkpointed, hex_hash

#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
#: Hexadecimal digits of the seeded key that name a bucket: 16 ** 3 buckets a source.
BUCKET_DIGITS = 3


def n_words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float, epochs: float, weights=WEIGHTS) -> DataFrame:
    """(source, source_size) -> plus weight and target.

    Targets are in proportion to the weights and stop at epochs * source_size. Each round clamps the sources above their
    cap and deals the excess to the others by weight, until none is above. A round is one aggregate over the sources;
    what it hands on is the level (rest / weight of those not clamped), which never falls, so clamped sources stay so.
    Sources are ordered by code point, null last. A source without words gets 0.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = checkpointed(sizes.withColumn("weight", weight).withColumn("cap", F.lit(float(epochs)) * F.col("source_size")))
    total = s.agg(F.sum("source_size")).first()[0] or 0
    budget, rest, free = share * total, None, None
    while True:
        above = F.lit(False) if free is None else F.col("cap") * free < F.col("weight") * rest
        row = s.agg(F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("w"), F.sum(F.when(above, F.col("cap")).otherwise(0.0)).alias("c")).first()
        now = (budget - (row.c or 0.0), row.w or 0.0)
        if now == (rest, free) or not now[1]:
            break
        rest, free = now
    if free is None:
        return s.withColumn("target", F.lit(0.0)).drop("cap")
    return s.withColumn("target", F.when(F.col("cap") * free < F.col("weight") * rest, F.col("cap")).otherwise(F.lit(rest) * F.col("weight") / F.lit(free))).drop("cap")


def mix(docs: DataFrame, share: float = 1.5, epochs: float = 2.0, seed: int = 0, weights=WEIGHTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (the source's), taken (words taken, repeats counted), source.

    Every document of a source is taken floor(target / source_size) whole times. The rest of the target is taken from
    the source's documents in the order of their seeded keys: whole documents, and a first part of the one in which the
    target is reached, so a source's taken words are its target, rounded. The order depends on the seed and doc_id only.
    Null text: size 0. Null source: a source of its own. Empty table: no rows. Repeated rows count each; among rows of
    one doc_id and size, which of them gets the part is left open, as they can't be told apart. Columns named in `keep`
    are carried along, other columns are ignored.
    """
    slim = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), hex_hash(F.lit(f"{seed}"), "doc_id").alias("key"), *keep)
    slim = checkpointed(slim.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS)))
    buckets = checkpointed(slim.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), share, epochs, weights)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.withColumn("ahead", F.coalesce(F.sum("bucket_size").over(before), F.lit(0))).join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "ahead", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = slim.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, (F.coalesce("source", F.lit("")) == F.coalesce("s", F.lit(""))) & F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    part = F.floor(F.col("target") - F.col("whole") * F.col("source_size") + 0.5)
    extra = F.greatest(F.lit(0), F.least(F.col("size"), part - F.col("ahead") - F.col("inside")))
    return rows.withColumn("whole", whole).select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + extra).cast("long").alias("taken"), "source", *keep)
