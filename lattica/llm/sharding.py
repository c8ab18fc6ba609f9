"""Shards by proportional stratified interleaving.

Rows are ranked in a seeded shuffle within their source, sorted over all sources by fractional rank
(rank + 1/2) / rows of the source, and cut into runs of equal length. Every run of that order holds each source in
its share of the whole, to within a row or two, so every shard matches the mixture.

Both ranks are found without a task that sees a whole source: the shuffle's hash (then the fraction) is cut into
buckets, counts of buckets are summed up, and only rows within a bucket are numbered together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import HASH_SPAN, cut, rank_within

def interleave(rows: DataFrame, key: str, stratum: str, shards: int, seed: int = 0, bucket_rows: int = 20_000, most_buckets: int = 4096) -> DataFrame:
    """rows with shard (0 to shards - 1) and slot (gapless from 0 in each shard); sizes differ by one at most.

    rows must be cheap to read twice and hold key and stratum. A null stratum is a stratum of its own; repeated
    rows are kept and numbered one after the other; with fewer rows than shards some shards stay empty. Columns called
    shard or slot are replaced, and so are those of the working names below.
    """
    rows = rows.drop(*({"shard", "slot", "_hash", "_bucket", "_fraction", "_rank", "_all", "_before", "_at", "_s", "_b"} - {key, stratum}))
    # one written copy: every pass below must see the same rows in the same buckets
    keyed = cut(rows.withColumn("_hash", F.xxhash64(F.lit(seed), F.col(key)).bitwiseAND(HASH_SPAN - 1)))
    total = keyed.count()
    buckets = max(1, min(most_buckets, -(-total // bucket_rows)))
    ranked = rank_within(keyed, stratum, [key], total, bucket_rows, most_buckets)
    placed = cut(ranked.withColumn("_fraction", (F.col("_rank") + F.lit(0.5)) / F.col("_all")).drop("_rank", "_all"))
    dealt = placed.withColumn("_bucket", F.least(F.floor(F.col("_fraction") * buckets).cast("int"), F.lit(buckets - 1)))
    # one row a bucket, most_buckets at most, so a single task may sum them up
    earlier = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_bucket").agg(F.count("*").alias("_n")).select("_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    joined = dealt.join(F.broadcast(counts), "_bucket")
    order = Window.partitionBy("_bucket").orderBy("_fraction", F.xxhash64(F.lit(seed), F.col(stratum)), "_hash", key)
    at = (F.col("_before") + F.row_number().over(order) - 1).cast("long")
    # row i goes to shard floor(i * shards / total), whose first row is ceil(shard * total / shards)
    cutting = joined.withColumn("_at", at).withColumn("shard", F.expr(f"int((_at * {shards}L) div {max(1, total)}L)"))
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return cutting.withColumn("slot", F.col("_at") - first).drop("_at", "_bucket", "_before", "_hash", "_fraction")


def shard_documents(docs: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, text_crc32, shard, slot) of every document.

    size: UTF-8 bytes of the text (null: none) plus 16. A null text has the crc32 of an empty one. Copies of a text
    are dealt like any other rows: the law is equal row counts, and a group of copies may hold more rows than a shard.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", "source", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    return interleave(rows, "doc_id", "source", shards, seed)
