"""Document metadata as struct and map columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkfolio.schemas import VALUE

_KINDS = {"string": "s", "bigint": "i", "double": "f", "boolean": "b", "timestamp": "t"}
_CAST = {"s": "string", "i": "bigint", "f": "double", "b": "boolean", "t": "timestamp"}
_PARTS = ("title", "author", "subject", "keywords", "creator", "producer", "created", "modified", "language")


def value(x: Column, kind: str) -> Column:
    """A typed custom value; kind is string, bigint, double, boolean or timestamp."""
    return F.struct(*((x if k == _KINDS[kind] else F.lit(None)).cast(t).alias(k) for k, t in _CAST.items())).cast(VALUE)


def no_custom() -> Column:
    return F.create_map().cast(f"map<string,{VALUE}>")


def add_custom(custom: Column, key: Column, new: Column) -> Column:
    """custom with key set to new; an earlier value of the key goes."""
    kept = F.map_filter(custom, lambda k, _: k != key)
    return F.map_concat(kept, F.create_map(key, new))


def get_custom(custom: Column, key: Column) -> Column:
    return F.try_element_at(custom, key)


def metadata(custom: Column | None = None, **parts: Column) -> Column:
    """A metadata struct; parts not given are null, keywords empty."""
    unknown = set(parts) - set(_PARTS)
    if unknown:
        raise ValueError(f"unknown metadata: {sorted(unknown)}")
    kinds = dict.fromkeys(_PARTS, "string") | {"keywords": "array<string>", "created": "timestamp", "modified": "timestamp"}
    empty = {"keywords": F.array()}
    return F.struct(*(parts.get(p, empty.get(p, F.lit(None))).cast(kinds[p]).alias(p) for p in _PARTS), (no_custom() if custom is None else custom).alias("custom"))


def theme_colour(theme: Column, name: Column) -> Column:
    """A theme's colour by its name, or null."""
    return F.try_element_at(theme, name)
