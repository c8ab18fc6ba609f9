"""Order-free operators on a stream."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lattica import cols
from lattica import reducers as R
from lattica.streaming.frames import reduce_by_key, stream_frame


def test_running_reducer(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(10).select((F.col("id") % 2).alias("k"), F.col("id").alias("x")).write.parquet(path)
    stream = spark.readStream.schema("k bigint, x bigint").parquet(path)
    frame = stream_frame(stream, "k").filter(cols("x").as_("long"), lambda v: v > 1)
    query = reduce_by_key(frame, cols("x").as_("long"), R.Sum()).writeStream.outputMode("complete").format("memory").queryName("running").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.sql("select key, v from running").collect())) == [(0, 20), (1, 24)]
    with pytest.raises(ValueError, match="stream"):
        stream_frame(spark.range(1), "id")
