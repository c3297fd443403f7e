"""Continuous document processing: the same stateless transforms over a stream of files or of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkfolio.operators.convert import convert
from sparkfolio.operators.detect import detect
from sparkfolio.plans.scratch import scratch
from sparkfolio.sources.files import stream_files
from sparkfolio.sources.text import stats


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def detect_and_count(rows: DataFrame, text: str = "text", name: str = "name") -> DataFrame:
    found = detect(rows.withColumn("content", F.encode(text, "UTF-8")), "content", name).drop("content")
    return found.withColumns({k: v for k, v in stats(F.col(text), F.col(name)).items() if k != "title"})


def convert_stream(spark: SparkSession, source: str, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Converts files as they arrive; each micro-batch is written with its id, so a repeated batch replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        convert(batch).select("path", "name", "status", "content_type", "body").write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    query = stream_files(spark, source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).start()


def streamed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection and counts of the documents table, read as a stream to its end and gathered in the shared folder."""
    target = scratch(spark, "stream")
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, _, _ = f"{sf_dir}/documents.parquet".rpartition("/")
    stream = spark.readStream.schema(table.schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{folder}/documents.parquet*")
    named = stream.withColumn("name", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")))
    done = detect_and_count(named).select("doc_id", "mime_type", "character_count", "line_count", "word_count")
    done.writeStream.format("parquet").option("path", f"{target}/rows").option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(done.schema).parquet(f"{target}/rows")
