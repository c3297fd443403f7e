"""Choosing pages of documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def page_range(pages: Column, first: int | None = None, last: int | None = None, only: list[int] | None = None) -> Column:
    """Pages by place from 1: all, from first to last, or only those listed; order is kept."""

    def wanted(_: Column, i: Column) -> Column:
        if only is not None:
            return (i + 1).isin(*only)
        return (i + 1 >= (first or 1)) & (F.lit(last is None) | (i + 1 <= F.lit(last if last is not None else 0)))

    return F.filter(pages, wanted)
