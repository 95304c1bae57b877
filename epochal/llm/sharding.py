"""Sharding: proportional stratified interleaving, so that every shard has the mixture of the whole.

Rows are ranked in seeded shuffled order within their source, sorted by fractional rank (rank - offset) / rows of the source,
and cut into runs of equal counts. The offset in [0, 1) is the source's own seeded number: sources of a single row spread out.

Neither ranking puts a source in one task. A source's key space is cut into buckets of bounded size: counts of
(source, bucket) pre-aggregate before their shuffle, their running sums give the first rank of each bucket, and a window
ranks the rows of one bucket only. The same is done for the order by fraction. Texts are never shuffled, only ids, keys, sizes
and checksums.

The order is by hash of (id, checksum, size), so that null or repeated ids of different texts do not meet in one bucket.

Null texts have size 1 and the checksum of the empty text; null sources form a stratum of their own. Repeated rows get slots
of their own, ordered by id, checksum and size; rows equal in these can be swapped without a difference. An empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epochal.llm._spark import cut, parallelism, small, table

#: Rows that one ranking window takes, about; and the most buckets (48-bit keys times buckets fit a long).
BUCKET_ROWS, MAX_BUCKETS = 20_000, 1 << 15


def seeded_key(seed: str, value: Column, digits: int = 12) -> Column:
    """A uniform non-negative long of 4 * digits bits, the same in any engine with md5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(value.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def running_offset(counts: DataFrame, by: list[str], bucket: str, n: str) -> DataFrame:
    """Rows before each bucket. counts has one row per (by, bucket): at most MAX_BUCKETS in a window."""
    w = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("__before", F.coalesce(F.sum(n).over(w), F.lit(0)))


def interleave(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text: str = "text", stratum: str = "source", seed: str = "shard") -> DataFrame:
    """(id, size, text_crc32, stratum, shard, slot) of every row; sizes of shards are at most one row apart."""
    spark, t = docs.sparkSession, F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = cut(
        docs.select(
            F.col(f"`{id_col}`").alias("id"),
            (F.octet_length(t) + 1).cast("long").alias("size"),
            F.crc32(F.encode(t, "UTF-8")).alias("crc"),
            F.coalesce(F.concat(F.lit("="), F.col(f"`{stratum}`").cast("string")), F.lit("null")).alias("stratum"),
        ).withColumn("key", seeded_key(seed, F.concat_ws(":", F.col("id").cast("string"), "crc", "size")))
    )
    total = rows.count()
    buckets = min(MAX_BUCKETS, max(total // BUCKET_ROWS, parallelism(spark), 1))
    rows = rows.withColumn("bucket", F.shiftright(F.col("key") * buckets, 48))
    counts = rows.groupBy("stratum", "bucket").agg(F.count("*").alias("n"))
    first = running_offset(counts, ["stratum"], "bucket", "n").withColumn("rows", F.sum("n").over(Window.partitionBy("stratum")))
    order = ["key", "id", "crc", "size"]
    ranked = rows.join(small(cut(first.drop("n"))), ["stratum", "bucket"]).withColumn(
        "rank", F.col("__before") + F.row_number().over(Window.partitionBy("stratum", "bucket").orderBy(*order))
    )
    fraction = (F.col("rank") - seeded_key(seed, F.col("stratum")) / float(1 << 48)) / F.col("rows")
    placed = cut(ranked.select("id", "size", "crc", "stratum", "rank", fraction.alias("fraction")))
    placed = placed.withColumn("bucket", F.least(F.floor(F.col("fraction") * buckets), F.lit(buckets - 1)))
    before = running_offset(placed.groupBy("bucket").agg(F.count("*").alias("n")), [], "bucket", "n")
    at = placed.join(small(cut(before.drop("n"))), "bucket").withColumn(
        "at", F.col("__before") + F.row_number().over(Window.partitionBy("bucket").orderBy("fraction", "stratum", "rank")) - 1
    )
    shard = F.expr(f"(at * {n_shards}L) div {max(total, 1)}L")
    return at.withColumn("shard", shard).select(
        "id", "size", F.col("crc").alias("text_crc32"), "stratum", F.col("shard").cast("int").alias("shard"),
        (F.col("at") - F.expr(f"(shard * {total}L + {n_shards - 1}L) div {n_shards}L")).alias("slot"),
    )


def op3_stratified_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return interleave(docs, 16).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )

