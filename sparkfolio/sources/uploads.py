"""Uploads as rows: the bodies of multipart forms, taken apart by expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfolio.functions.text import lossy

#: Refusals (fixed values).
NO_FILE = "No file field found in multipart form"
NO_BOUNDARY = "Invalid `boundary` for `multipart/form-data` request"
CUT = "Failed to read file data: incomplete multipart stream"
_BYTES = "ISO-8859-1"  # a character for each byte


def uploaded_files(requests: DataFrame, field: str = "file") -> DataFrame:
    """requests (content_type, body and more) as files: name, length and content of the first part named `field` instead of
    the body, and refusal, which says why there is none.

    Defined results: a part without a file name has a null name; later parts of the name are ignored; a part that no
    boundary follows is cut off and refused; a null body is empty; a row for each request, so a body has one row's size at
    most (2 GiB)."""
    quoted = lambda key: rf'(?i)content-disposition:[^\r\n]*[;\s]{key}="((?:[^"\\\\]|\\\\.)*)"'
    boundary = F.regexp_extract("content_type", r'(?i)^\s*multipart/form-data\s*;.*?boundary="?([^";\s\\\\]+)', 1)
    body = F.concat(F.lit("\r\n"), F.coalesce(F.decode("body", _BYTES), F.lit("")))
    pieces = F.split(body, F.concat(F.lit(r"\r\n--\Q"), boundary, F.lit(r"\E")), -1)
    # each piece after the first, with whether a boundary follows it
    parts = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda x, i: F.struct(F.substring_index(x, "\r\n\r\n", 1).alias("head"), x.alias("all"), (i < F.size(pieces) - 2).alias("whole")))
    last = F.array_position(F.transform(parts, lambda p: F.startswith(p["all"], F.lit("--"))), F.lit(True))  # the closing boundary
    open_ = F.when(last > 0, F.slice(parts, F.lit(1), F.greatest(last - 1, F.lit(0)).cast("int"))).otherwise(parts)
    named = F.filter(open_, lambda p: F.contains(p["all"], F.lit("\r\n\r\n")) & (F.regexp_extract(p["head"], quoted("name"), 1) == field))
    part = F.get(named, F.lit(0))
    found = requests.withColumn("__boundary", boundary).withColumn("__part", F.when(F.col("__boundary") != "", part))
    of = F.col("__part")
    refusal = F.when(F.coalesce(F.col("__boundary"), F.lit("")) == "", NO_BOUNDARY).when(of.isNull(), NO_FILE).when(~of["whole"], CUT)
    given = F.regexp_extract(of["head"], quoted("filename"), 1)
    has_name = of["head"].rlike(quoted("filename"))
    content = F.encode(F.substr(of["all"], F.length(of["head"]) + 5), _BYTES)
    out = found.withColumn("refusal", refusal).withColumn("name", F.when(F.col("refusal").isNull() & has_name, lossy(F.encode(given, _BYTES)))).withColumn("content", F.when(F.col("refusal").isNull(), content))
    return out.withColumn("length", F.octet_length("content").cast("long")).drop("body", "__boundary", "__part")
