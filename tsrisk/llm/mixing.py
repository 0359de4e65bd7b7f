"""Mix sources to target weights.

Every row gets a hash-random key. Keys are uniform, so equal key ranges split each source evenly without a
sampling pass; running totals inside a range and over the ranges give each row the number of words that stand
before it in its source's random order. A source's budget is then cut at exactly its last word: whole epochs
first, and what is left from the start of the order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsrisk.llm.common import word_count
from tsrisk.session import stage

SEED = "mix-1"
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3


def random_key(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """60 hash bits of id and text; any change of the seed deals anew."""
    joined = F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """`source, source_size` to `source, source_size, target`.

    Sources in code point order, null last, take the weights in turn. A target
    stops at `epochs` times the source's size; the rest is shared again by
    weight until nothing is above. Only the level of each round, one row, comes
    to the driver; ranks are per range of sources plus an offset.
    """
    order = [F.col("source").isNull(), F.col("source")]
    ranged = stage(sizes.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "mix-sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("offset") - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = stage(
        ranged.join(offsets, "part").select(
            "source", "source_size", weight.alias("weight"), (F.lit(float(epochs)) * F.col("source_size")).alias("most")
        ),
        "mix-weights",
    )
    total = ranked.agg(F.sum("source_size").alias("t")).first().t or 0
    level = 0.0
    while True:
        # Sources that a level fills stay full at every higher level, so each round only looks at the present one.
        full = F.col("most") <= level * F.col("weight")
        sums = ranked.agg(
            F.sum(F.when(full, F.col("most")).otherwise(0.0)).alias("held"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not sums.open:
            break
        higher = (total - sums.held) / sums.open
        if higher <= level:
            break
        level = higher
    return ranked.select(
        "source", "source_size", F.least(F.col("most"), F.lit(level) * F.col("weight")).alias("target")
    )


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    carry: Sequence[str] = (),
) -> DataFrame:
    """`doc_id, size, source_size, target, taken, source` and the columns in `carry`, a row per row of `docs`.

    Reads `doc_id, text, source`; other columns play no part. A null text has
    size 0 and is taken 0 times; a null source is a source of its own, the
    last; rows repeated in full stand next to each other in the order; rows
    that share an id but not a text are dealt apart. An empty table gives an
    empty result. Sources without any word have target 0.
    """
    keep = [c for c in dict.fromkeys(carry) if c not in ("doc_id", "source")]
    sized = docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"),
        random_key(F.col("doc_id"), F.col("text"), seed).alias("key"), *[F.col(c).alias(f"carry_{c}") for c in keep],
    )
    kept = [f"carry_{c}" for c in keep]
    # Repeated rows become one row with a count, so no key range holds more than its share.
    rows = stage(sized.groupBy("source", "key", "doc_id", "size", *kept).agg(F.count(F.lit(1)).alias("n")), "mix-rows")
    targets = stage(
        source_targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, epochs),
        "mix-targets",
    )
    # Square root of the row count: ranges a source has, and rows a range has.
    width = (1 << 60) // max(1, math.isqrt(rows.count()))
    ranges = (F.col("key") / F.lit(width)).cast("long")
    rows = rows.withColumn("range", ranges)
    by_source = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("source", "range").agg(F.sum(F.col("size") * F.col("n")).alias("words")).select(
        "source", "range", F.coalesce(F.sum("words").over(by_source), F.lit(0)).alias("start")
    )
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1
    )
    placed = rows.withColumn("inner", F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0)))
    r, s, t = placed.alias("r"), starts.alias("s"), targets.alias("t")
    joined = r.join(s, F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.range") == F.col("s.range"))).join(
        t, F.col("r.source").eqNullSafe(F.col("t.source"))
    )
    copies = joined.select(
        "r.doc_id", "r.source", "r.size", "t.source_size", "t.target", *[f"r.{c}" for c in kept],
        (F.col("s.start") + F.col("r.inner")).alias("at"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("r.n") - 1)).alias("copy"),
    )
    budget = F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0)
    rest = budget - whole * F.col("source_size") - F.col("at") - F.col("copy") * F.col("size")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return copies.select(
        "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source",
        *[F.col(f"carry_{c}").alias(c) for c in keep],
    )
