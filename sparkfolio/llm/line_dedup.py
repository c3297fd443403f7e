"""Line dedup by site-relative frequency.

For each host, the pages that contain a line are divided by the host's pages; a line on more than `max_ratio` of them
(and on `min_pages` at least, without which every line of a host under 1 / max_ratio pages would go) is boilerplate there
and goes from every page of that host. A line is compared without trailing blanks; blank lines stay. At most
lines-per-page / max_ratio lines of a host can be boilerplate, which bounds the list that is joined to its pages; the lines
themselves are counted with partial sums, so a hot host or a hot line is a few rows for each task.

The lists are written and measured. Up to BROADCAST bytes they are sent to the pages, which then are only scanned; beyond
that pages are shuffled by host and one of SALTS salts, so that a hot host's pages are spread over as many tasks.

Defined results: null text stays null and counts as a page without lines; a null host is a host of its own; repeated
rows count as pages of their own; texts of any length are read whole; columns other than host and text are passed through
untouched, whatever their names, but for one that is named as `kept`, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise

BLANKS = " \t\r"
#: Bytes of lists that are broadcast at most.
BROADCAST = 16 << 20
SALTS = 64


def _key(line: Column) -> Column:
    return F.xxhash64(F.rtrim(line, F.lit(BLANKS)))


def _blank(line: Column) -> Column:
    return F.rtrim(line, F.lit(BLANKS)) == ""


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = 0.02, min_pages: int = 5) -> DataFrame:
    """One row for each host that has any: host, lines (the 64-bit names of its boilerplate lines)."""
    lines = F.array_distinct(F.transform(F.filter(F.split(text, "\n", -1), lambda x: ~_blank(x)), _key))
    totals = pages.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("pages"))
    counts = pages.where(F.col(text).isNotNull()).select(F.col(host).alias("host"), F.explode(lines).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    joined = counts.join(totals.withColumnRenamed("host", "its"), F.col("host").eqNullSafe(F.col("its")))
    return joined.where(F.col("n") > max_ratio * F.col("pages")).groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = 0.02, min_pages: int = 5, kept: str | None = None) -> DataFrame:
    """pages with its text (or a new column `kept`) without the boilerplate lines of its host."""
    tag = "_".join(["", *pages.columns])  # longer than any name that pages have
    its, lines, salt = f"host{tag}", f"lines{tag}", f"salt{tag}"
    bad = materialise(boilerplate(pages, host, text, max_ratio, min_pages).select(F.col("host").alias(its), F.col("lines").alias(lines)), "boilerplate")
    size = bad.agg(F.sum(F.size(lines) * 8 + F.coalesce(F.octet_length(its), F.lit(0)) + 16)).first()[0] or 0
    same = F.col(host).eqNullSafe(F.col(its))
    if size <= BROADCAST:
        joined = pages.join(F.broadcast(bad), same, "left")
    else:
        salted = bad.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = pages.withColumn(f"own{salt}", F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int")).join(salted, same & (F.col(f"own{salt}") == F.col(salt)), "left").drop(salt, f"own{salt}")
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda x: _blank(x) | ~F.array_contains(lines, _key(x))), "\n")
    value = F.when(F.col(lines).isNull() | F.col(text).isNull(), F.col(text)).otherwise(left)
    return joined.withColumn(kept or text, value).drop(its, lines)
