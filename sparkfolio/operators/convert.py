"""The conversion service as a batch: files in, one response row out for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.sources.files import MAX_BYTES
from sparkfolio.sources.formats import registrations
from sparkfolio.sources.parse import REFUSED, Parser, parse_files

from .detect import detect, format_info
from .registry import dispatch
from .render import render_document

VERSION = "0.1.0"
HTML, JSON = "text/html; charset=utf-8", "application/json"
#: Response statuses (fixed values).
STATUS = {200: "200 OK", 400: "400 Bad Request", 415: "415 Unsupported Media Type", 500: "500 Internal Server Error", 501: "501 Not Implemented"}
#: Error kinds by what can be done about them (fixed values).
RECOVERABLE = ("Timeout", "MemoryLimit")
INPUT_ERRORS = ("InvalidInput", "Corrupted", "UnsupportedFormat", "ParseError")


def is_recoverable(kind: Column) -> Column:
    return kind.isin(*RECOVERABLE)


def is_input_error(kind: Column) -> Column:
    return kind.isin(*INPUT_ERRORS)


def error_body(status: Column, message: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in STATUS.items() for x in pair))
    return F.to_json(F.struct(F.element_at(names, status).alias("error"), message.alias("message")))


def detection_body(key: Column, confidence: Column, method: Column) -> Column:
    info = format_info(key)
    message = F.concat(F.lit("Format detected as "), info["name"], F.lit(" but no parser is available. Returning format detection information."))
    return F.to_json(F.struct(info.alias("format"), confidence.cast("float").alias("confidence"), method.alias("method"), message.alias("message")))


def convert(files: DataFrame, fallback: bool = True, limit: int = MAX_BYTES, known: DataFrame | None = None, own: dict[str, Parser] | None = None, render: Callable[[Column], Column] = render_document, signatures: bool = True) -> DataFrame:
    """files (name, length, content and more) with status, content_type and body instead of content: a row for each file,
    and none fails the job. A null length is the content's own; a file without content is empty.

    One pass: detection and gates are expressions, one Arrow map parses the rows that have a parser, and the response is
    an expression again. Content of files over the limit goes no further than the scan. own: further parsers by MIME type
    (see sources.parse.parse_files), which win over the registered ones. render: document to body.
    signatures: whether content may show its format by its first bytes. A boolean column `trusted` may say of which files the
    format is known and not guessed: those are parsed without asking the gate."""
    known = registrations(files.sparkSession) if known is None else known
    if own:
        known = known.unionByName(files.sparkSession.createDataFrame([(10_000 + i, getattr(p, "__name__", m), m) for i, (m, p) in enumerate(own.items())], known.schema))
    columns = [c for c in files.columns if c not in ("content", "refusal", "trusted")]
    sized = files if "refusal" in files.columns else files.withColumn("refusal", F.lit(None).cast("string"))
    sized = sized.withColumn("__size", F.coalesce(F.col("length"), F.octet_length("content"), F.lit(0))).withColumn("__large", F.col("__size") > limit)
    sized = sized.withColumn("content", F.when(~F.col("__large"), F.coalesce("content", F.lit(b""))))
    routed = dispatch(detect(sized, signatures=signatures), known, F.col("trusted") if "trusted" in files.columns else None)
    rows = parse_files(routed.withColumn("__wanted", F.col("parser").isNotNull() & ~F.col("__large") & F.col("refusal").isNull()), own=own, wanted="__wanted", keep_content=False)
    failure = F.col("document.error")
    refused = ~F.col("__wanted") | F.coalesce(failure["kind"] == REFUSED, F.lit(False))
    status = (
        F.when(F.col("__large") | F.col("refusal").isNotNull(), 400)
        .when(F.col("format").isNull(), 415)
        .when(refused, 200 if fallback else 501)
        .when(failure.isNotNull(), 500)
        .otherwise(200)
    )
    message = (
        F.when(F.col("refusal").isNotNull(), F.col("refusal"))
        .when(status == 400, F.concat(F.lit("File size "), F.col("__size").cast("string"), F.lit(f" exceeds maximum of {limit}")))
        .when(status == 415, F.lit("Unable to detect file format"))
        .when(status == 501, F.concat(F.lit("No parser available for format: "), format_info(F.col("format"))["name"]))
        .otherwise(F.concat(F.lit("Failed to parse document: "), failure["message"]))
    )
    html = (status == 200) & ~refused
    body = F.when(html, render(F.col("document"))).when(status == 200, detection_body(F.col("format"), F.col("confidence"), F.col("method"))).otherwise(error_body(status, message))
    return rows.select(*columns, status.alias("status"), F.when(html, HTML).otherwise(JSON).alias("content_type"), body.alias("body"))


def tally(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.groupBy(status).agg(F.count("*").alias("n"))


def version(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("sparkfolio", VERSION, spark.version)], "name string, version string, spark string")


def health(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("healthy", VERSION)], "status string, version string")
