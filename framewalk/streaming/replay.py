"""Tables as streams, in order of frame, and streams as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewalk.session import new_folder

#: Seconds of event time from one frame to the next; the first one is after 0, at which a watermark begins.
TICK = 60


def in_order(rows: DataFrame, key: str, parts: int = 4) -> tuple[DataFrame, str]:
    """(stream, delay): rows(key, frame, ..) as a stream with event times ts, and the watermark's delay that it needs.

    Stretches of frames are written one after the other, a key's rows of a stretch in one file, so that the files' order is
    that of a key's frames.  A last row, of key -1, comes so much later that all other keys are over.
    """
    spark = rows.sparkSession
    folder = new_folder(spark, "stream")
    n_frames = (rows.agg(F.max("frame")).first()[0] or 0) + 1
    width = -(-n_frames // parts)
    timed = rows.withColumn("ts", F.timestamp_seconds((F.col("frame") + 1) * TICK))
    for k in range(parts):
        timed.where((F.col("frame") >= k * width) & (F.col("frame") < (k + 1) * width)).repartition(key).write.parquet(f"{folder}/{k:04d}")
    numbers = {"tinyint": -1, "smallint": -1, "int": -1, "bigint": -1}
    last = spark.range(1).select(*(F.lit(numbers.get(kind)).cast(kind).alias(name) for name, kind in rows.dtypes))
    far = n_frames + 8 * width
    last.withColumns({"frame": F.lit(far).cast(rows.schema["frame"].dataType), "ts": F.timestamp_seconds(F.lit(far * TICK))}).write.parquet(f"{folder}/{parts:04d}")
    files = max(1, len(spark.read.schema(timed.schema).parquet(f"{folder}/0000").inputFiles()))  # a stretch is about a batch
    return spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/*"), f"{2 * width * TICK} seconds"


def written(stream: DataFrame) -> str:
    """The folder that a stream is written to until its input ends."""
    folder = new_folder(stream.sparkSession, "streamed")
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return f"{folder}/rows"


def to_end(stream: DataFrame) -> DataFrame:
    """What a stream gives out until its input ends."""
    return stream.sparkSession.read.schema(stream.schema).parquet(written(stream))
