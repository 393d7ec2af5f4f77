"""Splitting of keys that hold too many rows for one task, and neighbours across the splits.

A *chunk* is a range of a key's order column. Ordinary keys have chunk 0 only. A key with more than ``rows_per_chunk``
rows is split at quantiles of the order column, so that a key with a third of a table becomes many tasks. The split
points are at most ``2 * rows / rows_per_chunk`` numbers over all keys, whatever the keys are; only that table, and one
edge row per chunk of a split key, is joined back. Key columns must not be NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_CHUNK = 500_000
#: Most chunks of a key; one with more rows than that has larger chunks.
MAX_PIECES = 16_384
#: Chunk number, and the number of split points of the row's key, NULL if it isn't split.
CHUNK, SPLIT = "__chunk", "__split"
#: Split points are searched in two steps: among every STRIDE-th, then among those that follow.
STRIDE = 64


def split_points(df: DataFrame, keys: Sequence[str], order: str, rows_per_chunk: int = ROWS_PER_CHUNK, sizes: DataFrame | None = None) -> tuple[DataFrame | None, int, int]:
    """Keys with more than ``rows_per_chunk`` rows and the order values at which to split them (None if there are none); the number of rows; the most of a key.

    ``sizes``: the keys with their numbers of rows as ``__n``, if they are known.
    """
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")) if sizes is None else sizes
    summary = sizes.agg(F.coalesce(F.count_if(F.col("__n") > rows_per_chunk), F.lit(0)), F.max("__n"), F.coalesce(F.sum("__n"), F.lit(0))).first()
    if not summary[0]:
        return None, summary[2], summary[1] or 0
    sizes = sizes.where(F.col("__n") > rows_per_chunk)
    pieces = min(MAX_PIECES, -(-summary[1] // rows_per_chunk))
    few = F.broadcast(sizes) if summary[0] <= 10_000 else sizes
    hot = df.select(*keys, order).join(few, keys)
    quantiles = F.percentile_approx(order, [i / pieces for i in range(1, pieces)] or [0.5], F.lit(max(1000, 20 * pieces)))
    step = F.greatest(F.lit(1), F.floor(F.lit(pieces) * rows_per_chunk / F.col("__n"))).cast("int")
    points = (
        hot.groupBy(*keys).agg(quantiles.alias("__q"), F.first("__n").alias("__n")).withColumn("__step", step)
        .withColumn(SPLIT, F.array_distinct(F.expr("filter(__q, (x, i) -> (i + 1) % __step = 0)"))).select(*keys, SPLIT)
    )
    return points, summary[2], summary[1]


def with_chunk(df: DataFrame, keys: Sequence[str], order: str, points: DataFrame | None) -> DataFrame:
    """``df`` with the column ``__chunk``: 0, or how many split points lie before the row's order value."""
    if points is None:
        return df.withColumn(CHUNK, F.lit(0))
    joined = df.join(points.withColumnRenamed(SPLIT, "__points").withColumn("__heads", F.expr(f"filter(__points, (x, i) -> i % {STRIDE} = 0)")), keys, "left")
    before = F.expr(f"size(filter(__heads, x -> x < {order})) - 1") * STRIDE
    joined = joined.withColumn("__from", before)
    chunk = F.expr(f"case when __points is null or __from < 0 then 0 else __from + size(filter(slice(__points, __from + 1, {STRIDE}), x -> x < {order})) end")
    return joined.withColumn(CHUNK, chunk).withColumn(SPLIT, F.when(F.col("__points").isNotNull(), F.size("__points"))).drop("__points", "__heads", "__from")


def neighbour(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, ahead: bool, split: bool) -> DataFrame:
    """``df`` with ``name``: ``value`` of the row before (``ahead``: after) in the key's order, also over chunk ends.

    ``value`` must not be NULL, so that NULL says that there is no such row. With ``split`` the rows at the ends of the
    chunks of split keys look up the edge row of the nearest chunk that has rows.
    """
    keys, order = list(keys), list(order)
    w = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    near = (F.lead if ahead else F.lag)(value, 1).over(w)
    if not split:
        return df.withColumn(name, near)
    pick = F.min_by if ahead else F.max_by
    edges = df.where(F.col(SPLIT).isNotNull()).groupBy(*keys, CHUNK).agg(pick(value, F.struct(*order)).alias("__edge"))
    over = Window.partitionBy(*keys).orderBy(CHUNK)
    edges = edges.select(*keys, CHUNK, (F.lead if ahead else F.lag)("__edge", 1).over(over).alias("__edge"))
    return df.withColumn(name, near).join(edges, [*keys, CHUNK], "left").withColumn(name, F.coalesce(name, "__edge")).drop("__edge")
