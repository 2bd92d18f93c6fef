"""NDJSON lines as a stream: every line is an item, every item a result.

read_stream(), results() and write_stream() keep no state. read_numbered() and write_once() give each item
of an id once, whatever files it comes in and however often the stream is stopped, and keep the
order of lines within a file as a column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import service


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)


def results(lines: DataFrame) -> DataFrame:
    """Results of JSON lines; a line that isn't an item gives STREAM_LINE_ERROR, and errors carry no id."""
    rows = service.items(lines)
    good = service.process(rows.filter(~F.col("bad")).drop("bad"))
    error = F.struct(F.lit("STREAM_LINE_ERROR").alias("code"), F.lit("line is not a JSON item").alias("message"), F.lit(None).cast("map<string,string>").alias("detail"), F.lit(None).cast("int").alias("status"))
    place = [c for c in ("pos",) if c in good.columns]
    bad = rows.filter("bad").select(*place, error.alias("error"), F.lit(False).alias("ok"), *[F.lit(None).cast(good.schema[c].dataType).alias(c) for c in good.columns if c not in ("ok", "error", *place)])
    return good.withColumn("id", F.when(F.col("ok"), F.col("id"))).unionByName(bad)


def write_stream(out: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append results as NDJSON until what is there is read."""
    return out.select(F.to_json(F.struct("*")).alias("value")).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_numbered(spark: SparkSession, path: str, files_per_trigger: int = 100, line_sep: str = "\n") -> DataFrame:
    """value, pos (file and line, from 0) and arrived (the file's time) of every line; a last line without an end counts.

    A file is read whole by one task, as lines of a split one have no numbers: service.MOST_BYTES a file is meant.
    """
    files = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path, wholetext=True)
    files = files.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("arrived"))
    lines = files.select("file", "arrived", F.posexplode(F.split("value", line_sep)).alias("line", "value"))
    return lines.select(F.struct("file", "line").alias("pos"), "arrived", "value").filter(F.col("value").rlike(r"(?U)\S"))


def first_of_ids(lines: DataFrame, within: str = "1 hour") -> DataFrame:
    """Lines of a stream less those whose item's id came before, as far back as the watermark reaches.

    Lines without an id, broken ones among them, are told apart by their places. Ids that come again
    later than within are given again: state is bounded by the ids of that time.
    """
    item = F.get_json_object("value", "$.id")
    key = F.when(item.isNotNull(), F.concat(F.lit("id:"), item)).otherwise(F.concat(F.lit("at:"), F.col("pos.file"), F.lit("#"), F.col("pos.line").cast("string")))
    return lines.withColumn("_key", key).withWatermark("arrived", within).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def write_once(lines: DataFrame, path: str, checkpoint: str, within: str = "1 hour", **trigger) -> StreamingQuery:
    """Append the results of lines of read_numbered(), each id once: a folder for each batch with any, and for the first, written over if it runs again."""

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.drop("arrived").persist()  # state is read once, not for each of the operations
        try:
            # The count updates the state of every partition; batches of repeats, and those that only clear state, end there.
            if kept.count() or not number:
                results(kept).write.mode("overwrite").json(f"{path}/batch={number}")
        finally:
            kept.unpersist()

    trigger = trigger or {"availableNow": True}
    return first_of_ids(lines, within).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
