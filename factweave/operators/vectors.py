"""Vectors by tenant and scope: writes, exact search, scopes. Vectors are ``entity_id, scope_name, vec_id, v``."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCOPE = ["entity_id", "scope_name"]
#: Query vectors that go to a task at once; more are searched block after block.
QUERY_BLOCK = 20_000
#: Vectors that a block of queries meets in one task, where there are several blocks.
VECTOR_PART = 200_000


def accepted(writes: DataFrame, registry: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """``entity_id, scope_name, vec_id, v, dim, euclidean, *carry`` of the vectors that stand after all writes.

    writes: ``row_no, entity_id, scope_name, vec_id, v, op``, applied in the order of ``row_no``: a put sets the id's vector,
    a delete removes it. A put of a NULL vector, of another length than the scope's ``dim`` or with an element that is
    NULL or not finite is refused and changes nothing, as are writes to a scope that isn't registered, of another ``op``,
    or with NULL in a key or ``row_no``. A NULL or unknown metric is cosine. ``carry`` are further columns of the registry.
    """
    scopes = registry.groupBy(*SCOPE).agg(F.max("dim").alias("dim"), F.coalesce(F.lower(F.max("metric")) == "euclidean", F.lit(False)).alias("euclidean"), *[F.max(c).alias(c) for c in carry])
    good = F.coalesce(F.size("v") == F.col("dim"), F.lit(False)) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    w = writes.where("row_no is not null and vec_id is not null and op in ('put', 'delete')").select("row_no", *SCOPE, "vec_id", "v", "op")
    valid = w.join(scopes, SCOPE).where((F.col("op") == "delete") | F.coalesce(good, F.lit(False)))
    of_scope = ["dim", "euclidean", *carry]
    last = valid.groupBy(*SCOPE, "vec_id").agg(F.max_by(F.struct(F.when(F.col("op") == "put", F.col("v")).alias("v"), *of_scope), "row_no").alias("w"))
    return last.where("w.v is not null").select(*SCOPE, "vec_id", "w.v", *[f"w.{c}" for c in of_scope])


def insert(vectors: DataFrame, registry: DataFrame, new: DataFrame, order: str, metric: str = "cosine") -> tuple[DataFrame, DataFrame]:
    """(vectors, registry) after upserting ``new`` by id, of repeated ids the last by the column ``order``.

    The first insert of a scope fixes its length and metric. Raises ValueError for an empty vector, or one of another length than the scope's or than others of ``new`` in it.
    """
    sizes = new.groupBy(*SCOPE).agg(F.min(F.size("v")).alias("lo"), F.max(F.size("v")).alias("hi"), F.max(F.col("v").isNull()).alias("none"))
    wrong = sizes.join(registry.select(*SCOPE, "dim"), SCOPE, "left").where("none or lo <> hi or lo < 1 or (dim is not null and dim <> lo)").first()
    if wrong:
        raise ValueError(f"vectors of scope {wrong.scope_name} have the wrong length")
    added = sizes.join(registry, SCOPE, "left_anti").select(*SCOPE, F.col("lo").alias("dim"), F.lit(metric).alias("metric"))
    last = new.groupBy(*SCOPE, "vec_id").agg(F.max_by("v", order).alias("v"))
    kept = vectors.join(last, [*SCOPE, "vec_id"], "left_anti").select(*SCOPE, "vec_id", "v")
    return kept.unionByName(last), registry.select(*SCOPE, "dim", "metric").unionByName(added)


def delete(vectors: DataFrame, entity_id: str, scope: str, vec_id: str) -> DataFrame:
    """``vectors`` without one; raises KeyError if it isn't there."""
    this = (F.col("entity_id") == entity_id) & (F.col("scope_name") == scope) & (F.col("vec_id") == vec_id)
    if vectors.where(this).isEmpty():
        raise KeyError(vec_id)
    return vectors.where(~F.coalesce(this, F.lit(False)))


def drop_scope(vectors: DataFrame, registry: DataFrame, entity_id: str, scope: str) -> tuple[DataFrame, DataFrame]:
    """Both without the scope, whose length is free again; raises KeyError if it isn't registered."""
    this = F.coalesce((F.col("entity_id") == entity_id) & (F.col("scope_name") == scope), F.lit(False))
    if registry.where(this).isEmpty():
        raise KeyError(scope)
    return vectors.where(~this), registry.where(~this)


def scopes(vectors: DataFrame, registry: DataFrame) -> DataFrame:
    """``entity_id, scope_name, dim, metric, n``: registered scopes with their live vectors, 0 for an emptied one."""
    n = vectors.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("n"))
    return registry.select(*SCOPE, "dim", "metric").join(n, SCOPE, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all of ``q`` to all of ``x``; infinite where there is none."""
    if metric == "euclidean":
        square = (q**2).sum(1)[:, None] - 2 * q @ x.T + (x**2).sum(1)
        return np.sqrt(np.maximum(square, 0))
    norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(1 - q @ x.T / norms, nan=np.inf)


class _Nearest:
    """The k nearest of each query among the rows seen; equal distances by id."""

    def __init__(self, queries: np.ndarray, k: int, metric: str):
        self.queries, self.k, self.metric = queries, k, metric
        self.limit = np.full(len(queries), np.inf)
        self.query, self.distance, self.id = np.zeros(0, np.int64), np.zeros(0), pa.array([], pa.string())

    def add(self, ids: pa.Array, x: np.ndarray) -> None:
        d = _distances(self.queries, x, self.metric)
        if d.shape[1] >= self.k:
            self.limit = np.minimum(self.limit, np.partition(d, self.k - 1, axis=1)[:, self.k - 1])
        q, col = np.nonzero((d <= self.limit[:, None]) & np.isfinite(d))
        if not len(q):
            return
        query, distance = np.concatenate([self.query, q]), np.concatenate([self.distance, d[q, col]])
        id_ = pa.concat_arrays([self.id, ids.take(pa.array(col))])
        place = np.empty(len(query), np.int64)
        place[pc.sort_indices(id_).to_numpy()] = np.arange(len(query))
        order = np.lexsort((place, distance, query))
        query, distance = query[order], distance[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        self.limit[query[rank == self.k - 1]] = distance[rank == self.k - 1]
        self.query, self.distance, self.id = query[rank < self.k], distance[rank < self.k], id_.take(pa.array(order[rank < self.k]))


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(sizes):
        if n > 0:
            yield int(n), np.flatnonzero(sizes == n)


def _values(column: pa.Array, rows: np.ndarray, n: int) -> np.ndarray:
    return column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n).astype(np.float64)


def _search_block(queries: pa.Table, batches: Iterator[pa.RecordBatch], k: int, metric: str) -> Iterator[pa.RecordBatch]:
    """``query_id, vec_id, distance`` of queries ``query_id, v`` over batches ``vec_id, v``, in blocks of rows."""
    ids, v = queries.column(0).combine_chunks(), queries.column(1).combine_chunks()
    best = {n: (ids.take(pa.array(rows)), _Nearest(_values(v, rows, n), k, metric)) for n, rows in _by_length(v)}
    for b in batches:
        for n, rows in _by_length(b.column(1)):
            step = max(64, 4_000_000 // len(best[n][1].queries)) if n in best else len(rows)
            for s in range(0, len(rows) if n in best else 0, step):
                some = rows[s : s + step]
                best[n][1].add(b.column(0).take(pa.array(some)), _values(b.column(1), some, n))
    for names, near in best.values():
        yield pa.RecordBatch.from_arrays([names.take(pa.array(near.query)), near.id, pa.array(near.distance)], ["query_id", "vec_id", "distance"])


def search(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """``query_id, vec_id, distance, rank``: the ``k`` nearest vectors of each query, exactly; equal distances by id.

    vectors: ``vec_id, v``; queries: ``query_id, v``. Up to QUERY_BLOCK queries go to every task, which puts out its own k
    nearest, so k rows a query and task are shuffled; more queries are dealt out to blocks, and each block meets each part of
    the vectors in a task of its own. NULL vectors and those of another length than the query's, and, for cosine, zero
    vectors aren't found. ``k <= 0`` finds nothing.
    """
    spark = vectors.sparkSession
    ddl = "query_id string, vec_id string, distance double"
    q = queries.select(F.col("query_id").cast("string").alias("query_id"), "v").where("v is not null")
    x = vectors.select(F.col("vec_id").cast("string").alias("vec_id"), "v").where("v is not null")
    n = q.count() if k > 0 else 0
    if not n:
        return spark.createDataFrame([], ddl + ", rank int")
    if n <= QUERY_BLOCK:
        shared = spark.sparkContext.broadcast(q.toArrow())
        near = x.mapInArrow(lambda batches: _search_block(shared.value, batches, k, metric), ddl)
    else:
        blocks, parts = math.ceil(n / QUERY_BLOCK), max(spark.sparkContext.defaultParallelism, math.ceil(x.count() / VECTOR_PART))
        salt = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("bigint")
        every = lambda m: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(m - 1).cast("bigint")))
        rows = x.select(F.col("vec_id").alias("id"), "v", F.lit(False).alias("asks"), salt("vec_id", parts).alias("part"), every(blocks).alias("block"))
        rows = rows.unionByName(q.select(F.col("query_id").alias("id"), "v", F.lit(True).alias("asks"), every(parts).alias("part"), salt("query_id", blocks).alias("block")))

        def meet(table: pa.Table) -> pa.Table:
            asks, data = (table.filter(e).select(["id", "v"]).combine_chunks() for e in (pc.field("asks"), ~pc.field("asks")))
            out = list(_search_block(asks, data.to_batches(), k, metric))
            return pa.Table.from_batches(out, pa.schema([("query_id", pa.string()), ("vec_id", pa.string()), ("distance", pa.float64())]))

        near = rows.groupBy("block", "part").applyInArrow(meet, ddl)
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search_scope(vectors: DataFrame, registry: DataFrame, entity_id: str, scope: str, query: Sequence[float], k: int) -> DataFrame:
    """``vec_id, distance, rank``: the ``k`` vectors of a scope nearest to ``query`` by the scope's metric.

    Raises KeyError for a scope that isn't registered, ValueError for an empty query or one of another length than the scope's.
    """
    this = (F.col("entity_id") == entity_id) & (F.col("scope_name") == scope)
    known = registry.where(this).first()
    if known is None:
        raise KeyError(scope)
    if not len(query) or len(query) != known.dim:
        raise ValueError(f"the query has {len(query)} numbers, the scope {known.dim}")
    q = vectors.sparkSession.createDataFrame([("q", [float(x) for x in query])], "query_id string, v array<float>")
    return search(vectors.where(this), q, k, "euclidean" if str(known.metric).lower() == "euclidean" else "cosine").drop("query_id")
