"""Uploads as a stream: an extension beside the batch path, over the same expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.functions import fixed


def landing(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """A stream of the accepted files that arrive under path, each content once within
    a day; later copies are dropped, and the state of a day is all that is kept."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    files = files.where(kind.isin(*fixed.UPLOAD_SUFFIXES) & (F.col("length") > 0) & (F.col("length") <= fixed.UPLOAD_BYTES))
    files = files.withColumn("sha256", F.sha2("content", 256)).withWatermark("modificationTime", "1 day")
    return files.dropDuplicatesWithinWatermark(["sha256"])


def events_per_minute(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of an event stream (ts, event_type, value) by minute and kind."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark wants a time with a zone
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 minute"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def run_available(stream: DataFrame, each, checkpoint: str) -> StreamingQuery:
    """Work off what is there, batch by batch, with each(df, batch_id) as the sink; a
    restart goes on from the checkpoint, and a batch that is repeated has its id."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
