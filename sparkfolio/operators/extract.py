"""Text extraction: on nested documents without a shuffle, and on rows of blocks, pages and cells by ordered aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.functions.text import word_count


def runs_text(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: r["text"]), "")


def cell_text(cell: Column) -> Column:
    return F.array_join(F.transform(cell["content"], runs_text), " ")


def table_text(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, cell_text), "\t")), "\n")


def block_text(block: Column) -> Column:
    """Text of text and table blocks; null for others."""
    return F.when(block["kind"] == "Text", runs_text(block["runs"])).when(block["kind"] == "Table", table_text(block["rows"]))


def page_text(page: Column) -> Column:
    """Text of the page's own blocks; what is inside containers doesn't count."""
    own = F.filter(page["blocks"], lambda b: F.coalesce(b["depth"], F.lit(0)) == 0)
    return F.array_join(F.filter(F.transform(own, block_text), lambda t: t.isNotNull()), "\n")


def document_text(document: Column) -> Column:
    return F.array_join(F.transform(document["pages"], page_text), "\n\n")


def document_words(document: Column) -> Column:
    return word_count(document_text(document))


def page_at(pages: Column, number: Column) -> Column:
    """The page at a place from 1; null for 0 or beyond."""
    return F.when((number >= 1) & (number <= F.size(pages)), F.get(pages, number - 1))


def counts(document: Column) -> dict[str, Column]:
    return {"page_count": F.size(document["pages"]), "image_count": F.size(document["images"]), "attachment_count": F.size(document["attachments"])}


def ordered_text(rows: DataFrame, keys: list[str], order: str, text: str, separator: str, name: str = "text") -> DataFrame:
    """Rows of one key joined in order, with partial lists combined before the shuffle's result is sorted."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["t"]), separator).alias(name))


def first_by(rows: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min_by(value, order).alias(name))


# the flattened model


def pages_of(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    return documents.select(key, F.posexplode("document.pages").alias("place", "page")).select(key, (F.col("place") + 1).alias("page_no"), F.col("page.number").alias("number"), "page.width", "page.height", "page.label", "page.blocks")


def blocks_of(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    return pages_of(documents, key).select(key, "page_no", F.posexplode("blocks").alias("place", "block")).select(key, "page_no", F.array("place").alias("block_path"), F.col("block.kind").alias("block_type"), "block")


def runs_of(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    text = blocks_of(documents, key).where("block_type = 'Text'")
    return text.select(key, "page_no", "block_path", F.posexplode("block.runs").alias("run_no", "run")).select(key, "page_no", "block_path", "run_no", "run.text", "run.style")


def cells_of(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    rows = blocks_of(documents, key).where("block_type = 'Table'").select(key, "page_no", "block_path", F.posexplode("block.rows").alias("row_no", "row"))
    cells = rows.select(key, "page_no", "block_path", "row_no", F.posexplode("row").alias("col_no", "cell"))
    return cells.select(key, "page_no", "block_path", "row_no", "col_no", cell_text(F.col("cell")).alias("text"), "cell.col_span", "cell.row_span", "cell.background_color")


def images_of(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    return documents.select(key, F.posexplode("document.images").alias("ordinal", "image")).select(key, "ordinal", "image.*")


def attachments_of(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    return documents.select(key, F.posexplode("document.attachments").alias("ordinal", "attachment")).select(key, "ordinal", "attachment.*")
