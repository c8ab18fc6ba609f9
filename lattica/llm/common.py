"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Hashes that rank rows lie from 0 to this.
HASH_SPAN = 1 << 62
#: The same mapping for bytes.translate.
LOWER_BYTES = bytes(range(65)) + LOWER.encode() + bytes(range(91, 256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_checkpoint(spark: SparkSession) -> None:
    """Make checkpoint() usable: the folder that the cluster names. Without one, only a local session goes on, in its own
    working folder; on a cluster executors would not share it, so that is an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and context.master != "local" and not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(named or "/tmp/lattica-checkpoint")


def narrow(df: DataFrame) -> DataFrame:
    """df, whose rows go to Python in batches of a few megabytes, unless the session says otherwise: at Spark's default of
    64 MB, a batch of long texts is held several times over on both sides."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, "64m") in ("64m", "67108864b", "67108864"):
        conf.set(key, "4m")
    return df


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there: later jobs read one and the same copy."""
    shared_checkpoint(df.sparkSession)
    return narrow(df).checkpoint(eager=True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def text_crc32_mod(key: str, divisor: int) -> Column:
    """crc32 of the key written as text, modulo divisor: the split into learning and held-out rows."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(divisor)


def batches(rows: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about most_bytes at most (a single larger row stays whole)."""
    for batch in rows:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, int(n * most_bytes / max(1, batch.nbytes)))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def strings_as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()).to_pylist()


def arrow_rows(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    """A record batch from one sequence for each field."""
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def blob(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed binary: each as its planes of bytes, so that small numbers in wide types cost little."""
    head = ";".join(f"{a.dtype.str}{len(a)}" for a in arrays).encode()
    planes = (np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head, b"\n", *planes]))


def unblob(data: bytes) -> list[np.ndarray]:
    """The arrays of a blob."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    at = raw.index(b"\n")
    out, here = [], at + 1
    for part in raw[:at].decode().split(";"):
        kind = np.dtype(part[:3])
        n = int(part[3:])
        flat = np.frombuffer(raw, np.uint8, n * kind.itemsize, here)
        out.append(np.ascontiguousarray(flat.reshape(kind.itemsize, -1).T).reshape(-1).view(kind))
        here += n * kind.itemsize
    return out


def runs(x: np.ndarray) -> np.ndarray:
    """The places where a run of equal values starts."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def rank_within(rows: DataFrame, stratum: str, order: list[str], total: int, bucket_rows: int = 20_000, most_buckets: int = 4096) -> DataFrame:
    """rows with _rank (from 0) and _all (rows of the stratum), ranked by _hash, then order, within each stratum.

    rows must be a written copy (see cut) with a column _hash spread evenly over 0 to 2^62 - 1. No task sees a whole
    stratum: the hash is cut into buckets, counts of buckets are summed up, and only a bucket's rows are numbered together.
    """
    buckets = max(1, min(most_buckets, -(-total // bucket_rows)))
    dealt = rows.withColumn("_bucket", F.floor(F.col("_hash") / (HASH_SPAN / buckets)).cast("int"))
    counts = dealt.groupBy(F.col(stratum).alias("_s"), F.col("_bucket").alias("_b")).agg(F.count("*").alias("_n"))
    own = Window.partitionBy("_s")
    before = F.coalesce(F.sum("_n").over(own.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_s", "_b", before.alias("_before"), F.sum("_n").over(own).alias("_all"))
    joined = dealt.join(counts, dealt[stratum].eqNullSafe(counts["_s"]) & (dealt["_bucket"] == counts["_b"]))
    within = Window.partitionBy(stratum, "_bucket").orderBy("_hash", *order)
    return joined.withColumn("_rank", F.col("_before") + F.row_number().over(within) - 1).drop("_s", "_b", "_before", "_bucket")
