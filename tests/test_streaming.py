"""Streamed block means against the batch operator."""

import datetime

from pyspark.sql import functions as F

from neurofold.operators import motion
from neurofold.streaming.blocks import streaming_block_means


def test_blocks_across_midnight_and_batches(spark, tmp_path):
    """Frames on both sides of midnight, a pause of days in a block, one file a batch, an incomplete tail."""
    begin = datetime.datetime(2024, 5, 1, 23, 59, 57, tzinfo=datetime.timezone.utc)
    at = lambda t: begin + datetime.timedelta(seconds=t, days=3 * (t > 8))
    rows = [(z, at(t), t, y, x, (z * 7 + t * t + y * 3 + x) % 11) for t in range(1, 15) for z in (1, 2) for y in (1, 2, 3) for x in (1, 2)]
    schema = "z long, at timestamp, t long, y long, x long, v long"
    frames = spark.createDataFrame(rows, schema)
    for k, part in enumerate([frames.where("t <= 5"), frames.where("t between 6 and 9"), frames.where("t > 9")]):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"p={k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = streaming_block_means(stream, 4).writeStream.format("memory").queryName("block_means").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    key = lambda df, n: sorted(tuple(r) for r in df.select("z", n, "y", "x", F.round("v", 9)).collect())
    expected = key(motion.block_means(frames, 4), "tp")
    assert key(spark.table("block_means"), "block") == expected and len(expected) == 3 * 12
