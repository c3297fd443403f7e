"""Files as rows: path, name, modificationTime, length and content, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.functions.text import file_extension

#: Largest file that is accepted, in bytes (fixed value).
MAX_BYTES = 5 * 1024**3
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("name", F.element_at(F.split("path", "/"), -1))


def read_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """All files under path. `content` is only read where it is selected, and filters on `length` reach the scan."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return _named((reader.option("pathGlobFilter", glob) if glob else reader).load(path))


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    return _named(spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").load(path))


def source_info(files: DataFrame) -> DataFrame:
    """filename, format, size and hash of each file."""
    return files.select(F.col("name").alias("filename"), file_extension(F.col("name")).alias("format"), F.col("length").alias("size"), F.sha2("content", 256).alias("hash"), F.current_timestamp().alias("parsed_at"))


def within_limit(files: DataFrame, limit: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """Files up to the limit, and those beyond."""
    return files.where(F.col("length") <= limit), files.where(F.col("length") > limit)
