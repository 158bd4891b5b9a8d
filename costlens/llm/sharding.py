"""Operator 10: sharding by jump consistent hashing, in DataFrame functions only.

A row's key and the number of shards decide its shard; with one more shard a
row either stays or goes to the new one.  The jump sequence of a key does not
depend on the number of shards, so one pass gives the shard for several counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costlens.llm.common import materialize, text_or_empty

# The multiplier of the 64-bit linear congruential generator of
# jump consistent hashing, and the range of its 31-bit draw.
MULTIPLIER = 2862933555777941757
DRAW = 2147483648

_U64 = "18446744073709551616"


def _unsigned(c: Column) -> Column:
    """A signed 64-bit value as an exact decimal in [0, 2^64)."""
    d = c.cast("decimal(20,0)")
    return F.when(c < 0, d + F.lit(_U64).cast("decimal(20,0)")).otherwise(d).cast("decimal(20,0)")


def jump_shards(key: Column, counts: list[int]) -> Column:
    """array<int>: the shard of a 64-bit `key` for each of `counts`.

    One step of the generator: key = key * MULTIPLIER + 1 mod 2^64 (exact in
    decimal(38,0): the product stays below 2^126); the next jump goes to
    floor((b + 1) * 2^31 / ((key >> 33) + 1)).  Each jump moves at least one
    on, so as many steps as there are shards are always enough.
    """
    if not counts or min(counts) < 1:
        raise ValueError("each number of shards must be at least 1")
    most = max(counts)
    mult, mod = F.lit(str(MULTIPLIER)).cast("decimal(19,0)"), F.lit(_U64).cast("decimal(20,0)")
    start = F.struct(
        _unsigned(key).alias("k"),
        F.lit(0).cast("long").alias("j"),
        *[F.lit(0).cast("long").alias(f"b{i}") for i in range(len(counts))],
    )

    def step(s: Column, _: Column) -> Column:
        k = ((s["k"] * mult + F.lit(1).cast("decimal(1,0)")) % mod).cast("decimal(20,0)")
        low = F.lit("8589934592").cast("decimal(10,0)")  # 2^33; the division below is exact
        draw = ((k - k % low) / low).cast("long")
        # below `most` shards the product stays far under 2^53: exact in double, as published
        j = F.floor((s["j"] + 1).cast("double") * (F.lit(float(DRAW)) / (draw + 1).cast("double"))).cast("long")
        done = s["j"] >= most
        nxt = F.struct(
            k.alias("k"),
            j.alias("j"),
            *[F.when(j < n, j).otherwise(s[f"b{i}"]).alias(f"b{i}") for i, n in enumerate(counts)],
        )
        return F.when(done, s).otherwise(nxt)

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(most)),
        start,
        step,
        lambda s: F.array(*[s[f"b{i}"].cast("int") for i in range(len(counts))]),
    )


def shard_documents(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, size, text_crc32, shard, slot, grown_shard (with one more shard) per row of `docs`.

    size: UTF-8 bytes of the text plus 8 for the key; null text: 8 bytes and
    the crc32 of nothing.  A null key hashes like any other value, so such
    rows share a shard.  Repeated rows keep a slot each.  An empty table gives
    an empty result.  Other columns of `docs` are not read.

    Slots: a row's rank among the rows of its shard in its own input
    partition, plus the rows of that shard in earlier partitions.  So no
    shard is ever gathered: the ranked groups are (partition, shard).
    """
    t = text_or_empty(text)
    narrow = docs.select(
        F.col(key).alias("key"),
        (F.octet_length(t).cast("long") + 8).alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        jump_shards(F.xxhash64(F.col(key)), [shards, shards + 1]).alias("s"),
        F.spark_partition_id().alias("part"),
    )
    narrow = materialize(
        narrow.select(
            "key", "size", "text_crc32", F.col("s")[0].alias("shard"), F.col("s")[1].alias("grown_shard"), "part"
        )
    )
    counts = narrow.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = Window.partitionBy("shard", "part").orderBy("key", "size", "text_crc32")
    ranked = narrow.withColumn("rank", F.row_number().over(place).cast("long") - 1)
    return ranked.join(starts, ["shard", "part"]).select(
        F.col("key").alias(key),
        "size",
        "text_crc32",
        "shard",
        (F.col("first") + F.col("rank")).alias("slot"),
        "grown_shard",
    )


def moved_share(sharded: DataFrame) -> DataFrame:
    """Rows, rows that move when one shard is added, and their share."""
    moved = F.sum((F.col("shard") != F.col("grown_shard")).cast("long"))
    return sharded.agg(
        F.count(F.lit(1)).alias("rows"), moved.alias("moved"), F.try_divide(moved, F.count(F.lit(1))).alias("share")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, key: str = "doc_id", files_per_shard: int = 1) -> None:
    """Write `docs` under `path`/shard=N; each shard is spread over `files_per_shard` tasks by input partition."""
    keyed = docs.withColumn("shard", jump_shards(F.xxhash64(F.col(key)), [shards])[0])
    salt = F.spark_partition_id() % files_per_shard
    keyed.repartition(shards * files_per_shard, "shard", salt).write.partitionBy("shard").mode("error").parquet(path)
