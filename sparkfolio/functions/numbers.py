"""Number functions as Spark expressions: sizes, percentages, CSS numbers, spreadsheet references and units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KB, MB = 1024, 1024 * 1024


def _one_decimal(x: Column) -> Column:
    return F.bround(x, 1).cast("decimal(30,1)").cast("string")


def format_size(n: Column) -> Column:
    """512 B, 1.2 KB, 3.0 MB; one decimal, ties to even (n / 2^k is exact in binary)."""
    n = n.cast("long")
    return (
        F.when(n < KB, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < MB, F.concat(_one_decimal(n / F.lit(float(KB))), F.lit(" KB")))
        .otherwise(F.concat(_one_decimal(n / F.lit(float(MB))), F.lit(" MB")))
    )


def css_number(x: Column) -> Column:
    """Shortest decimal form without exponent or trailing .0."""
    plain = x.cast("string")
    spread = F.regexp_replace(x.cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    return (
        F.when(F.isnan(x), F.lit("NaN"))
        .when(plain.isin("Infinity", "-Infinity"), F.regexp_replace(plain, "Infinity", "inf"))
        .when((x == F.floor(x)) & (F.abs(x) < 1e15), F.when(plain == "-0.0", F.lit("-0")).otherwise(x.cast("long").cast("string")))
        .when(F.contains(plain, F.lit("E")), spread)
        .otherwise(plain)
    )


def column_index(letters: Column) -> Column:
    """Spreadsheet column to its index from 0; null unless all capitals."""
    value = F.aggregate(F.split(letters, ""), F.lit(0).cast("long"), lambda acc, c: F.when(c == "", acc).otherwise(acc * 26 + F.ascii(c) - 64))
    return F.when(letters.rlike("^[A-Z]+$"), value - 1)


def column_letters(index: Column) -> Column:
    """Index from 0 to spreadsheet letters (up to seven)."""
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(7)),
        F.struct((index.cast("long") + 1).alias("n"), F.lit("").alias("s")),
        lambda acc, _: F.when(acc["n"] > 0, F.struct(F.floor((acc["n"] - 1) / 26).cast("long").alias("n"), F.concat(F.chr((acc["n"] - 1) % 26 + 65), acc["s"]).alias("s"))).otherwise(acc),
    )
    return F.when(index >= 0, steps["s"])


def cell_reference(ref: Column) -> Column:
    """A1 to struct(row, column), both from 0; null unless capitals are followed by digits."""
    good = ref.rlike("^[A-Z]+[0-9]+$")
    row = F.greatest(F.regexp_extract(ref, "([0-9]+)$", 1).cast("long") - 1, F.lit(0).cast("long"))
    return F.when(good, F.struct(row.alias("row"), column_index(F.regexp_extract(ref, "^([A-Z]+)", 1)).alias("column")))


def inches(x: Column) -> Column:
    return x * 72.0


def millimetres(x: Column) -> Column:
    return x * 2.834645669


def emu(x: Column) -> Column:
    return x / 12700.0


def rotation_units(x: Column) -> Column:
    return x / 60000.0


def half_points(x: Column) -> Column:
    return x / 2.0


def centipoints(x: Column) -> Column:
    return x / 100.0


def unix_text(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss")


def unpadded_date(ts: Column) -> Column:
    return F.date_format(ts, "y-M-d H:m:s")


def rect_contains(rect: Column, x: Column, y: Column) -> Column:
    return x.between(rect["x"], rect["x"] + rect["width"]) & y.between(rect["y"], rect["y"] + rect["height"])
