"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length for each source. A source's target is met by whole repeats of the source plus a
remaining budget; a like share of every length takes most of that budget, and bounded-knapsack dynamic programming over
the remaining counts fits what is left, exactly where any subset does. Documents of a length are then taken in the order
of a seeded hash, so reruns agree. Only counts by length reach a task as a group; the documents of one length and source
are split by their hash, so however many share a length, no task sorts more than about SPLIT of them.

Defined results: null text has size 0 and is never taken; null is a source of its own, last; equal rows are taken or
not by count; a source without words has target 0; texts of any length count whole; rows without doc_id are told apart by
size only; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import few, materialise, tidy_group

WORD = r"[^\x20\x09-\x0D]+"
SPLIT = 512
#: Documents of a mix whose numbers are broadcast at most (40 bytes each); beyond that texts are shuffled by id.
DRAWN = 400_000


def targets(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Shares of sum(sizes) by weight; none above `most` times its size, the excess reshared by weight."""
    budget, out = float(sum(sizes)), [0.0] * len(sizes)
    rest = sorted((i for i in range(len(sizes))), key=lambda i: most * sizes[i] / weights[i])
    weight = float(sum(weights))
    for k, i in enumerate(rest):
        share = budget / weight if weight else 0.0
        if most * sizes[i] <= share * weights[i]:
            out[i] = float(most * sizes[i])
            budget -= out[i]
            weight -= weights[i]
        else:
            for j in rest[k:]:
                out[j] = share * weights[j]
            break
    return out


def fill(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size to take so that the sum comes nearest to `budget` from below. All but the last `room` of the
    budget is shared over the sizes by count; the dynamic programme fits the rest."""
    total = int((sizes * counts).sum())
    if budget <= 0 or not total:
        return np.zeros(len(sizes), dtype=np.int64)
    if budget >= total:
        return counts.copy()
    room = max(1 << 16, 4 * int(sizes.max()))
    take = np.array([int(c) * max(0, budget - room) // total for c in counts], dtype=np.int64)
    rest = budget - int((take * sizes).sum())
    for i in np.argsort(-sizes, kind="stable"):
        if rest <= 2 * room:
            break
        n = min(int(counts[i] - take[i]), (rest - room) // int(sizes[i]))
        take[i] += n
        rest -= n * int(sizes[i])
    reached, by = np.zeros(rest + 1, dtype=bool), np.full(rest + 1, -1, dtype=np.int32)
    reached[0] = True
    for i in np.argsort(-sizes, kind="stable"):
        size, left = int(sizes[i]), int(counts[i] - take[i])
        if reached[rest] or not left or size > rest:
            continue
        front = np.flatnonzero(reached[: rest + 1 - size])
        while left and len(front):
            new = front + size
            new = new[new <= rest]
            new = new[~reached[new]]
            reached[new], by[new] = True, i
            front, left = new, left - 1
    at = int(np.flatnonzero(reached)[-1])
    while at:
        take[by[at]] += 1
        at -= int(sizes[by[at]])
    return take


def _fit(table: pa.Table) -> pa.Table:
    """One source: size, n, and its target; adds the whole repeats and how many of each size to take besides."""
    size, n = table.column("size").to_numpy(), table.column("n").to_numpy()
    total, target = int((size * n).sum()), table.column("target")[0].as_py()
    budget = int(round(target))
    whole, rest = divmod(budget, total) if total else (0, 0)
    take = fill(size, n, rest)
    return pa.table({"place": table.column("place"), "size": table.column("size"), "n": table.column("n"), "whole": pa.array(np.full(len(size), whole, dtype=np.int64)), "take": pa.array(take)})


def _size():
    """Words of the column text."""
    return F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def mix_sources(documents: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, seed: int = 17) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, taken. weights repeat over the sources in code point order;
    the sources of a mix are few, one row of each is read by the driver."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _size().alias("size"))
    docs = materialise(docs, "sizes")
    by = sorted(docs.groupBy("source").agg(F.sum("size").alias("n")).collect(), key=lambda r: (r.source is None, r.source or ""))
    goal = targets([r.n for r in by], [weights[i % len(weights)] for i in range(len(by))], most)
    mix = spark.createDataFrame([(r.source, i, r.n, t) for i, (r, t) in enumerate(zip(by, goal))], "its string, place int, source_size long, target double")
    placed = docs.join(F.broadcast(mix) if len(by) <= 10_000 else mix, F.col("source").eqNullSafe(F.col("its"))).drop("its").withColumn("h", F.xxhash64("doc_id", F.lit(seed)))
    lengths = placed.groupBy("place", "size").agg(F.count("*").alias("n"), F.first("target").alias("target"))
    plan = materialise(lengths.groupBy("place").applyInArrow(tidy_group(_fit), "place int, size long, n long, whole long, take long"), "plan")
    planned = placed.join(plan, ["place", "size"]).withColumn("part", F.pmod(F.col("h"), F.ceil(F.col("n") / SPLIT)))
    key = ["place", "size", "part"]
    parts = planned.groupBy(*key).agg(F.count("*").alias("own"), F.first("take").alias("goal"))
    parts = parts.withColumn("before", F.sum("own").over(Window.partitionBy("place", "size").orderBy("part")) - F.col("own")).select(*key, F.greatest(F.lit(0), F.least("own", F.col("goal") - F.col("before"))).alias("chosen"), "own")
    decided = planned.join(parts, key)
    edge = (F.col("chosen") > 0) & (F.col("chosen") < F.col("own"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("h", "doc_id"))
    inside = decided.where(edge).withColumn("more", (rank <= F.col("chosen")).cast("long"))
    outside = decided.where(~edge).withColumn("more", (F.col("chosen") > 0).cast("long"))
    return inside.unionByName(outside).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.col("more"))).alias("taken"))


def drawn_documents(documents: DataFrame, **options) -> DataFrame:
    """The rows of documents (all with a doc_id) that the mix takes, with size, source_size, target and taken; a column that
    documents have already is added as mix_<name>. Repeated rows come back as often as they are taken, each once at most."""
    added = {c: f"mix_{c}" if c in documents.columns else c for c in ("size", "source_size", "target", "taken")}
    drawn = materialise(mix_sources(documents, **options).select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), *(F.col(c).alias(f"__{c}") for c in added)), "drawn")
    several = materialise(drawn.groupBy("__id").agg(F.count("*").alias("n")).where("n > 1").select("__id"), "several")
    add = [F.col(f"__{c}").alias(name) for c, name in added.items()]
    taken = drawn.where("__taken > 0")
    if several.isEmpty():
        return documents.join(few(taken.drop("__source"), DRAWN), F.col("doc_id").cast("long") == F.col("__id")).select(*documents.columns, *add)
    once = documents.join(taken.join(several, "__id", "left_anti"), F.col("doc_id").cast("long") == F.col("__id")).select(*documents.columns, *add)
    # ids of several rows: of equal id, source and size as many rows as the mix takes, all alike to it
    key = ["__id", "__source", "__size"]
    counts = drawn.join(several, "__id", "left_semi").groupBy(*key).agg(F.first("__source_size").alias("__source_size"), F.first("__target").alias("__target"), F.max("__taken").alias("__high"), F.min("__taken").alias("__low"), F.count("*").alias("__n"), F.sum("__taken").alias("__sum"))
    high = F.when(F.col("__high") == F.col("__low"), F.col("__n")).otherwise(((F.col("__sum") - F.col("__n") * F.col("__low")) / (F.col("__high") - F.col("__low"))).cast("long"))
    counts = counts.select(*(F.col(k).alias(f"{k}_of") for k in key), "__source_size", "__target", "__high", "__low", high.alias("__many"))
    rows = documents.join(several, F.col("doc_id").cast("long") == F.col("__id"), "left_semi").withColumns({"__id": F.col("doc_id").cast("long"), "__source": F.col("source").cast("string"), "__size": _size()})
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("text")))
    ranked = rows.withColumn("__rank", rank)
    met = ranked.join(counts, (F.col("__id") == F.col("__id_of")) & F.col("__source").eqNullSafe(F.col("__source_of")) & (F.col("__size") == F.col("__size_of")))
    met = met.withColumn("__taken", F.when(F.col("__rank") <= F.col("__many"), F.col("__high")).otherwise(F.col("__low"))).where("__taken > 0")
    return once.unionByName(met.select(*documents.columns, *add))
