"""Joins and folds between parts of documents: resources, relations, styles and pagination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE_PARAGRAPHS = 50


def first_of_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the least order of each key; partial minima go over the network, not all rows."""
    packed = F.min_by(F.struct(*(c for c in rows.columns if c not in keys)), order).alias("__r")
    return rows.groupBy(*keys).agg(packed).select(*keys, "__r.*").select(rows.columns)


def last_of_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    packed = F.max_by(F.struct(*(c for c in rows.columns if c not in keys)), order).alias("__r")
    return rows.groupBy(*keys).agg(packed).select(*keys, "__r.*").select(rows.columns)


def resolve_images(blocks: DataFrame, images: DataFrame, keys: list[str], order: str = "ordinal") -> DataFrame:
    """blocks (keys and resource_id) with the first image of that id: image_mime, image_data, image_found."""
    first = first_of_each(images.select(*keys, "id", order, "mime_type", "data"), [*keys, "id"], order)
    first = first.select(*keys, F.col("id").alias("resource_id"), F.col("mime_type").alias("image_mime"), F.col("data").alias("image_data"), F.lit(True).alias("image_found"))
    return blocks.join(first, [*keys, "resource_id"], "left").withColumn("image_found", F.coalesce("image_found", F.lit(False)))


def resolve_relations(blocks: DataFrame, relations: DataFrame, keys: list[str]) -> DataFrame:
    """blocks (keys, rel_id) with resource_id: the relation's target (the last of an id), or the id itself."""
    last = last_of_each(relations.select(*keys, "rel_id", "ordinal", "target"), [*keys, "rel_id"], "ordinal").drop("ordinal")
    return blocks.join(last, [*keys, "rel_id"], "left").withColumn("resource_id", F.coalesce("target", "rel_id")).drop("target")


def relations_of_type(relations: DataFrame, kind: str) -> DataFrame:
    return relations.where(F.col("rel_type") == kind)


def overlay_styles(runs: DataFrame, named: DataFrame, style_id: str = "style_id") -> DataFrame:
    """runs (style_id, bold, italic, underline, color, size, font) over named styles: flags are or-ed, underline is the
    run's own, other properties are the run's where it has them."""
    n = named.select(F.col(style_id).alias("__id"), *(F.col(c).alias(f"__{c}") for c in ("bold", "italic", "color", "size", "font")))
    joined = runs.join(n, F.col(style_id) == F.col("__id"), "left")
    flags = {c: F.col(c) | F.coalesce(f"__{c}", F.lit(False)) for c in ("bold", "italic")}
    given = {c: F.coalesce(c, f"__{c}") for c in ("color", "size", "font")}
    return joined.withColumns(flags | given).select(runs.columns)


def page_count(paragraphs: Column) -> Column:
    """Pages of a sequence of paragraphs: every paragraph counts, and a page ends after a non-empty one once 50 have
    been counted since the last end; at least one page."""
    start = F.struct(F.lit(0).alias("count"), F.lit(0).alias("pages"), F.lit(0).alias("held"))

    def step(acc: Column, p: Column) -> Column:
        full = acc["count"] + 1 >= PAGE_PARAGRAPHS
        empty = F.struct((acc["count"] + 1).alias("count"), acc["pages"].alias("pages"), acc["held"].alias("held"))
        ends = F.struct(F.lit(0).alias("count"), (acc["pages"] + 1).alias("pages"), F.lit(0).alias("held"))
        goes_on = F.struct((acc["count"] + 1).alias("count"), acc["pages"].alias("pages"), (acc["held"] + 1).alias("held"))
        return F.when(p == "", empty).when(full, ends).otherwise(goes_on)

    return F.aggregate(paragraphs, start, step, lambda acc: F.greatest(F.lit(1), acc["pages"] + (acc["held"] > 0).cast("int")))


def renumbered(pages: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Pages with page_no from 1 in order, whatever their own numbers."""
    return pages.withColumn("page_no", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def at_most(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The first n rows of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("__n", rank).where(F.col("__n") <= n).drop("__n")


def split_mailbox(text: Column) -> Column:
    """Messages of a mailbox without their envelope lines: array of struct(place, body), place as split."""
    parts = F.transform(F.split(text, "\nFrom ", -1), lambda p, i: F.struct(i.alias("place"), p.alias("part")))
    kept = F.filter(parts, lambda p: ((p["place"] > 0) | F.startswith(p["part"], F.lit("From "))) & (F.locate("\n", p["part"]) > 0))
    return F.transform(kept, lambda p: F.struct(p["place"].alias("place"), F.substring(p["part"], F.locate("\n", p["part"]) + F.lit(1), F.length(p["part"])).alias("body")))
