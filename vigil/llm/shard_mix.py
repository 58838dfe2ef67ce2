"""Sharding: proportional stratified interleaving.

Every row gets a seeded-shuffle rank within its source; rows of all sources are
then merged by fractional rank ``(rank - 1/2) / rows of the source`` and the merged
order is cut into shards of equal length, so each shard (and each prefix of it)
carries every source in its corpus-wide proportion.

A source may hold a third of all rows, and the merged order holds all of them, so
neither rank comes from one window.  Both are two-level: rows are put into small
hash (or fraction) buckets, bucket sizes are aggregated and prefix-summed, and only
the place inside a bucket comes from a window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm._common import durable, name

#: 16 ** 3 hash buckets in each stratum: three hex digits of the shuffle key.
HASH_DIGITS = 3


def proportional_shards(
    df: DataFrame,
    *,
    shards: int = 40,
    stratum: str = "source",
    key: str = "doc_id",
    seed: str = "mix-1",
    order_buckets: int = 4096,
    shard_col: str = "shard",
    slot_col: str = "slot",
) -> DataFrame:
    """All columns of ``df`` plus ``shard`` (0 to shards-1) and ``slot`` (gapless from 0).

    Shard sizes differ by at most one row.  A null stratum is a stratum of its own;
    a null key hashes as the empty string; rows with equal keys are ordered by their
    whole content, so only rows equal in all columns are interchangeable.  Input
    columns named like the two outputs are replaced.  An empty table gives no rows.
    """
    kept = [c for c in df.columns if c not in (shard_col, slot_col)]
    rows = df.select(
        F.struct(*[name(c) for c in kept]).alias("row"),
        name(stratum).isNull().alias("none"),
        F.coalesce(name(stratum).cast("string"), F.lit("")).alias("s"),
        F.md5(
            F.concat(F.lit(f"{seed}:"), F.coalesce(name(key).cast("string"), F.lit(""))).cast("binary")
        ).alias("h"),
    ).withColumn("b", F.substring("h", 1, HASH_DIGITS))
    groups = ["s", "none", "b"]
    whole = Window.partitionBy("s", "none")
    starts = (
        rows.groupBy(*groups)
        .agg(F.count("*").alias("n"))
        .select(
            *groups,
            (F.sum("n").over(whole.orderBy("b")) - F.col("n")).alias("before"),
            F.sum("n").over(whole).alias("total"),
        )
    )
    tie = F.xxhash64("row")
    ranked = durable(
        rows.join(starts, groups)
        .withColumn(
            "rank", F.col("before") + F.row_number().over(Window.partitionBy(*groups).orderBy("h", tie))
        )
        .select(
            "row",
            "s",
            "none",
            "rank",
            ((2 * F.col("rank") - 1) / (2 * F.col("total"))).alias("fraction"),
            F.expr(f"((2 * rank - 1) * {order_buckets}L) div (2 * total)").alias("g"),
        )
    )
    # At most order_buckets rows, whatever the input: the one window without partitions is bounded.
    everything = Window.partitionBy()
    cuts = (
        ranked.groupBy("g")
        .agg(F.count("*").alias("n"))
        .select(
            "g",
            (F.sum("n").over(everything.orderBy("g")) - F.col("n")).alias("before"),
            F.sum("n").over(everything).alias("total"),
        )
    )
    order = Window.partitionBy("g").orderBy("fraction", "none", "s", "rank")
    placed = ranked.join(F.broadcast(cuts), "g").withColumn(
        "place", F.col("before") + F.row_number().over(order) - 1
    )
    shard = F.expr(f"(place * {shards}L) div total")
    first = F.expr(f"(((place * {shards}L) div total) * total + {shards - 1}L) div {shards}L")
    return placed.select(
        *[F.col("row")[c].alias(c) for c in kept],
        shard.cast("int").alias(shard_col),
        (F.col("place") - first).cast("long").alias(slot_col),
    )
