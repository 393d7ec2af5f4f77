"""Most similar vectors for every vector, by stable projections and kd-trees.

Gaussian projections keep distances: for two vectors at distance d, the squared distance of their m projections over d^2
is chi-square with m degrees of freedom. So projected neighbours are visited in growing projected distance, each batch is
verified on the vectors themselves, and the visit stops where the chi-square test says that no nearer vector is to be
expected. That happens on two levels.

* A scope of many vectors is cut into cells by a shared kd-tree over the projections. Each vector first searches its home
  cell. Then it goes to further cells in growing projected distance, in batches, its radius being the distance of the k-th
  neighbour found so far, or the scope's limit; it stops at the first cell for which the test holds: approximately
  here, for a distance APPROXIMATION times less than the radius and with probability CELL_SURE.
* In a cell the vectors have a kd-tree of their own, and the test is that of the distance itself (SURE).

A search task holds at most CELL_ROWS vectors of a cell and BLOCK_ROWS vectors that ask; cells with more of either are
several tasks. Exact copies are joined to one representative first, so a group of copies costs one query whatever its size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.operators.vectors import SCOPE, accepted
from factweave.plans.shared import cut

#: Vectors a cell of the shared tree should have, and vectors that ask in one search task.
CELL_ROWS, BLOCK_ROWS = 20_000, 40_000
#: Vectors sampled to place a scope's splits: for each cell, and in all; most levels of a scope's tree. Beyond
#: CELL_ROWS << MAX_DEPTH vectors the cells of a scope have more rows and are searched in parts.
SAMPLE_PER_CELL, SAMPLE_ROWS, MAX_DEPTH = 64, 400_000, 14
#: Projections, and rows of a leaf of a cell's tree.
PROJECTIONS, LEAF_ROWS = 24, 256
#: Probability with which a neighbour passes the test in a cell; that of the test between cells, and its approximation.
SURE, CELL_SURE, APPROXIMATION = 0.999, 0.9, 2.0
#: Cells a vector visits in the first batch; each batch has four times as many.
FIRST_CELLS = 16
SEED = 20_240_229


def chi_square_bound(m: int, p: float) -> float:
    """The value below which a chi-square variable with ``m`` degrees of freedom lies with probability ``p``."""

    def below(x: float) -> float:  # the series of the lower incomplete gamma function
        a, half = m / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-12:
            n += 1
            term *= half / n
            total += term
        return total * math.exp(-half + a * math.log(half) - math.lgamma(a))

    low, high = 1e-9, 10.0 * m + 100
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def projection(dim: int, m: int = PROJECTIONS) -> np.ndarray:
    """The ``m`` projections for vectors of length ``dim``; the same in every task."""
    return np.random.default_rng(SEED + dim).standard_normal((m, dim)).T


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length as an array."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1), np.float32)


def _scaled(x: np.ndarray, cosine: bool) -> np.ndarray:
    """Vectors whose Euclidean distances order pairs as the metric does: for cosine those of unit length."""
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True) if cosine else x


def _radius(limit: np.ndarray, cosine: bool) -> np.ndarray:
    return np.sqrt(2 * np.maximum(limit, 0)) if cosine else limit


def build_tree(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(axis, cut) by node: node i splits its points at the median of their widest coordinate into nodes 2i and 2i+1."""
    axis, cuts = np.zeros(1 << depth, np.int32), np.zeros(1 << depth)
    todo = [(1, np.arange(len(points)))] if depth else []
    while todo:
        i, rows = todo.pop()
        own = points[rows]
        if len(own):
            axis[i] = int(np.argmax(own.std(0)))
            cuts[i] = np.median(own[:, axis[i]])
        right = own[:, axis[i]] > cuts[i]
        if 2 * i < len(axis):
            todo += [(2 * i, rows[~right]), (2 * i + 1, rows[right])]
    return axis, cuts


def home_cells(tree: tuple[np.ndarray, np.ndarray], points: np.ndarray) -> np.ndarray:
    axis, cuts = tree
    node, row = np.ones(len(points), np.int64), np.arange(len(points))
    for _ in range(len(axis).bit_length() - 1):
        node = 2 * node + (points[row, axis[node]] > cuts[node])
    return node - len(axis)


def cells_near(tree: tuple[np.ndarray, np.ndarray], boxes: tuple[np.ndarray, np.ndarray], points: np.ndarray, most: np.ndarray, rows_held: int = 400_000):
    """(row, cell) of the cells whose box lies within the squared projected distance ``most`` of the row, nearest first.

    boxes: the least and the greatest projections of each cell's vectors. The tree is followed where they can be in reach.
    """
    axis, cuts = tree
    row, node, total = np.arange(len(points)), np.ones(len(points), np.int64), np.zeros(len(points))
    gap = np.zeros(points.shape, np.float32)
    for _ in range(len(axis).bit_length() - 1):
        a = axis[node]
        off = points[row, a] - cuts[node]
        before = gap[np.arange(len(row)), a]
        beyond = np.maximum(before, off**2)
        far = total - before + beyond
        cross = far <= most[row] * (1 + 1e-5)
        if len(row) + cross.sum() > rows_held and len(points) > 1:
            half = len(points) // 2
            first, second = (cells_near(tree, boxes, points[x], most[x], rows_held) for x in (slice(half), slice(half, None)))
            return np.concatenate([first[0], second[0] + half]), np.concatenate([first[1], second[1]])
        side = (off > 0).astype(np.int64)
        own = gap[cross]
        own[np.arange(len(own)), a[cross]] = beyond[cross]
        row, total, gap = np.concatenate([row, row[cross]]), np.concatenate([total, far[cross]]), np.concatenate([gap, own])
        node = np.concatenate([2 * node + side, 2 * node[cross] + 1 - side[cross]])
    cell = node - len(axis)
    away = np.concatenate([(np.maximum(np.maximum(boxes[0][cell[s : s + 65536]] - points[row[s : s + 65536]], points[row[s : s + 65536]] - boxes[1][cell[s : s + 65536]]), 0) ** 2).sum(1) for s in range(0, len(row), 65536)] or [total])
    near = away <= most[row]
    row, cell, away = row[near], cell[near], away[near]
    order = np.lexsort((cell, away, row))
    return row[order], cell[order]


def _order(points: np.ndarray, leaf: int) -> list[np.ndarray]:
    """The leaves of a kd-tree: row numbers, halved at the median of the widest coordinate until at most ``leaf``."""
    todo, leaves = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            leaves.append(rows)
            continue
        own = points[rows]
        split = np.argpartition(own[:, int(np.argmax(own.max(0) - own.min(0)))], len(rows) // 2)
        todo += [rows[split[: len(rows) // 2]], rows[split[len(rows) // 2 :]]]
    return leaves


def search(data: np.ndarray, queries: np.ndarray, own: np.ndarray, radius: np.ndarray, k: int, sure: float = SURE):
    """Of each query the ``k`` nearest data rows within its radius: (query, data row, distance).

    ``own``: the data row that is the query itself, or -1. Ties keep the lower data row.
    """
    if not len(data) or not len(queries):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    project = projection(data.shape[1])
    p, q, bound = data @ project, queries @ project, chi_square_bound(PROJECTIONS, sure)
    leaves, blocks = _order(p, LEAF_ROWS), _order(q, LEAF_ROWS)
    low, high = np.stack([p[x].min(0) for x in leaves]), np.stack([p[x].max(0) for x in leaves])
    p32, q32 = p.astype(np.float32), q.astype(np.float32)
    square, slack = (p32**2).sum(1), 1e-5 * float((p32**2).sum(1).max() + (q32**2).sum(1).max())
    parts = [(p32[x], square[x]) for x in leaves]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for block in blocks:
        b = q[block]
        away = np.maximum(np.maximum(low - b.max(0), b.min(0) - high), 0)
        away = (away**2).sum(1)
        b32 = q32[block]
        b_square = (b32**2).sum(1)[:, None]
        best = radius[block].astype(np.float64)
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for i in np.argsort(away, kind="stable"):
            most = bound * best**2
            if away[i] > most.max() + slack:
                break
            near = b_square - 2 * (b32 @ parts[i][0].T) + parts[i][1]
            at, col = np.nonzero(near <= (most + slack).astype(np.float32)[:, None])
            if not len(at):
                continue
            row = leaves[i][col]
            keep = row != own[block[at]]
            at, row = at[keep], row[keep]
            distance = np.concatenate([np.sqrt(((queries[block[at[s : s + 8192]]] - data[row[s : s + 8192]]) ** 2).sum(1)) for s in range(0, len(at), 8192)] or [np.zeros(0)])
            keep = distance <= best[at]
            if not keep.any():
                continue
            at, row, distance = (np.concatenate([x, y[keep]]) for x, y in zip(held, (at, row, distance)))
            order = np.lexsort((row, distance, at))
            at, row, distance = at[order], row[order], distance[order]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            held = tuple(x[rank < k] for x in (at, row, distance))
            full = rank == k - 1
            best[at[full]] = np.minimum(best[at[full]], distance[full])
        found.append((block[held[0]], held[1], held[2]))
    return tuple(np.concatenate(x) for x in zip(*found))


def live_vectors(writes: DataFrame, registry: DataFrame) -> DataFrame:
    """``entity_id, scope_name, vec_id, v, cosine, near_limit`` of the vectors that exist after all writes.

    As of :func:`factweave.operators.vectors.accepted`. Zero vectors of a cosine scope have no distance to anything and are
    left out. Other columns are ignored.
    """
    live = accepted(writes, registry, ["near_limit"]).select(*SCOPE, "vec_id", "v", (~F.col("euclidean")).alias("cosine"), F.col("near_limit").cast("double").alias("near_limit"))
    return live.where(~F.col("cosine") | F.exists("v", lambda x: x != 0))


def _copies(live: DataFrame, k: int) -> DataFrame:
    """``entity_id, scope_name, rep, vec_id, place, copies`` for the first k+1 of each group of equal vectors, by id.

    Groups of one aren't listed. Vectors are compared by two 64-bit hashes. A group ranks first within 64 salts, so no
    task sorts more than a part of it.
    """
    key = [*SCOPE, "h1", "h2"]
    hashed = live.select(*SCOPE, "vec_id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), F.col("v")).alias("h2"))
    counts = hashed.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    of_group = hashed.join(counts, key)
    salted = of_group.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    some = salted.withColumn("r", F.row_number().over(Window.partitionBy(*key, "salt").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    w = Window.partitionBy(*key).orderBy("vec_id")
    first = some.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k + 1).withColumn("rep", F.min("vec_id").over(Window.partitionBy(*key)))
    return of_group.join(first.select(*key, F.col("vec_id").alias("first_id"), "place", "rep"), key).select(*SCOPE, "rep", "vec_id", "first_id", "place", "copies")


def _groups(b: pa.RecordBatch, names: list[str]):
    """(key values, row numbers) by equal values of ``names``."""
    by: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(*[b.column(b.schema.get_field_index(n)).to_pylist() for n in names])):
        by.setdefault(key, []).append(i)
    return by.items()


def _projected(b: pa.RecordBatch, cosine: bool) -> np.ndarray:
    v = _scaled(_matrix(b.column(b.schema.get_field_index("v"))), cosine)
    return v @ projection(v.shape[1])


def _trees(reps: DataFrame, cell_rows: int) -> dict[tuple[str, str], tuple[np.ndarray, np.ndarray]]:
    """The trees of the scopes with more than ``cell_rows`` vectors, each fitted in a task on a sample of its scope.

    Only where a cell ends depends on the sample; every vector is in a cell. To the driver go the trees alone, two numbers
    a cell, and later the cells' boxes.
    """
    sizes = reps.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell_rows)
    sizes = sizes.withColumn("depth", F.least(F.lit(MAX_DEPTH), F.ceil(F.log2(F.col("n") / cell_rows)).cast("int")))
    rate = F.least(F.lit(float(SAMPLE_ROWS)), SAMPLE_PER_CELL * F.pow(F.lit(2.0), F.col("depth"))) / F.col("n")
    some = reps.join(sizes.withColumn("rate", rate), SCOPE).where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) < F.col("rate") * (1 << 40))

    def project(batches):
        for b in batches:
            for (entity, scope, cosine, depth), rows in _groups(b, [*SCOPE, "cosine", "depth"]):
                p = _projected(b.take(pa.array(rows)), cosine).astype(np.float32)
                n = len(p)
                yield pa.RecordBatch.from_arrays([pa.array([entity] * n), pa.array([scope] * n), pa.array([depth] * n, pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), PROJECTIONS).cast(pa.list_(pa.float32()))], [*SCOPE, "depth", "p"])

    def fit(table: pa.Table) -> pa.Table:
        axis, cuts = build_tree(_matrix(table.column("p")), table.column("depth")[0].as_py())
        return pa.table({**{c: [table.column(c)[0].as_py()] for c in SCOPE}, "axis": [axis.tolist()], "cuts": [cuts.tolist()]}, schema=pa.schema([("entity_id", pa.string()), ("scope_name", pa.string()), ("axis", pa.list_(pa.int32())), ("cuts", pa.list_(pa.float64()))]))

    ddl = "entity_id string, scope_name string, depth int, p array<float>"
    fitted = some.select(*SCOPE, "cosine", "depth", "v").mapInArrow(project, ddl).groupBy(*SCOPE).applyInArrow(fit, "entity_id string, scope_name string, axis array<int>, cuts array<double>")
    return {(r.entity_id, r.scope_name): (np.array(r.axis, np.int32), np.array(r.cuts)) for r in fitted.collect()}


REP = "entity_id string, scope_name string, vec_id string, v array<float>, cosine boolean, near_limit double"


def _homes_udf(trees):
    """Adds the home cell, and whether the scope has ``several``."""

    def run(batches):
        for b in batches:
            cell, several = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, bool)
            for (entity, scope, cosine), rows in _groups(b, [*SCOPE, "cosine"]):
                if tree := trees.get((entity, scope)):
                    several[rows] = True
                    cell[rows] = home_cells(tree, _projected(b.take(pa.array(rows)), cosine))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(several)], [*b.schema.names, "cell", "several"])

    return run


def _boxes(homes: DataFrame, trees) -> dict[tuple[str, str], tuple[np.ndarray, np.ndarray]]:
    """By scope with a tree the least and the greatest projections of each cell's vectors, combined in each task first.

    A cell without vectors is out of reach.
    """

    def bound(batches):
        held: dict[tuple, list[np.ndarray]] = {}
        for b in batches:
            for (entity, scope, cosine, cell), rows in _groups(b, [*SCOPE, "cosine", "cell"]):
                if (entity, scope) in trees:
                    p = _projected(b.take(pa.array(rows)), cosine).astype(np.float32)
                    low, high = held.get((entity, scope, cell), (np.inf, -np.inf))
                    held[(entity, scope, cell)] = [np.minimum(low, p.min(0)), np.maximum(high, p.max(0))]
        if held:
            entity, scope, cell = zip(*held)
            yield pa.RecordBatch.from_arrays([pa.array(entity), pa.array(scope), pa.array(cell, pa.int64()), *[pa.array([x[i].tolist() for x in held.values()], pa.list_(pa.float32())) for i in (0, 1)]], [*SCOPE, "cell", "low", "high"])

    def combine(table: pa.Table) -> pa.Table:
        cell, low, high = table.column("cell").to_numpy(), _matrix(table.column("low")), _matrix(table.column("high"))
        n = len(trees[(table.column(0)[0].as_py(), table.column(1)[0].as_py())][0])
        least, most = np.full((n, PROJECTIONS), np.inf, np.float32), np.full((n, PROJECTIONS), -np.inf, np.float32)
        np.minimum.at(least, cell, low)
        np.maximum.at(most, cell, high)
        return pa.table({**{c: [table.column(c)[0].as_py()] for c in SCOPE}, "low": [least.ravel().tolist()], "high": [most.ravel().tolist()]}, schema=pa.schema([("entity_id", pa.string()), ("scope_name", pa.string()), ("low", pa.list_(pa.float32())), ("high", pa.list_(pa.float32()))]))

    scope = "entity_id string, scope_name string"
    found = homes.select(*SCOPE, "cosine", "cell", "v").mapInArrow(bound, f"{scope}, cell bigint, low array<float>, high array<float>").groupBy(*SCOPE).applyInArrow(combine, f"{scope}, low array<float>, high array<float>")
    return {(r.entity_id, r.scope_name): tuple(np.array(x, np.float32).reshape(-1, PROJECTIONS) for x in (r.low, r.high)) for r in found.collect()}


def _visits_udf(trees, boxes, start: int, end: int):
    """Replaces ``cell``, the home, by ``cells``: those at ranks ``start`` to ``end`` that pass the test, without the home.

    ``more``: there are further ones. Rows without any are left out.
    """
    factor = chi_square_bound(PROJECTIONS, CELL_SURE) / APPROXIMATION**2

    def run(batches):
        for b in batches:
            for (entity, scope, cosine), rows in _groups(b, [*SCOPE, "cosine"]):
                tree = trees.get((entity, scope))
                for s in range(0, len(rows) if tree else 0, 1024):
                    own = b.take(pa.array(rows[s : s + 1024]))
                    column = lambda n: own.column(own.schema.get_field_index(n))  # noqa: B023, E731
                    most = factor * _radius(column("near_limit").to_numpy(zero_copy_only=False), cosine) ** 2
                    row, cell = cells_near(tree, boxes[(entity, scope)], _projected(own, cosine), most)
                    away = cell != column("cell").to_numpy()[row]
                    row, cell = row[away], cell[away]
                    rank = np.arange(len(row)) - np.searchsorted(row, row)
                    size = np.bincount(row, minlength=own.num_rows)
                    use = (rank >= start) & (rank < end)
                    row, cell = row[use], cell[use]
                    some = np.unique(row)
                    if not len(some):
                        continue
                    out = own.take(pa.array(some))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(row, some), len(row)), pa.int32()), pa.array(cell))
                    names = [n for n in out.schema.names if n != "cell"]
                    yield pa.RecordBatch.from_arrays([*[out.column(out.schema.get_field_index(n)) for n in names], lists, pa.array(size[some] > end)], [*names, "cells", "more"])

    return run


FOUND = "entity_id string, scope_name string, vec_id string, other string, distance double"


def _search_udf(k: int, sure: float):
    schema = pa.schema([("entity_id", pa.string()), ("scope_name", pa.string()), ("vec_id", pa.string()), ("other", pa.string()), ("distance", pa.float64())])

    def run(table: pa.Table) -> pa.Table:
        asks, data = table.filter(pc.field("role") >= ASKS), table.filter(pc.field("role") != ASKS).sort_by("vec_id")
        cosine = table.column("cosine")[0].as_py()
        v, x = (_scaled(_matrix(t.column("v")), cosine) for t in (data, asks))
        limit = asks.column("near_limit").to_numpy().astype(np.float64)
        ids, own = data.column("vec_id").combine_chunks(), asks.column("vec_id").combine_chunks()
        place = pc.fill_null(pc.index_in(own, ids), -1).to_numpy(zero_copy_only=False)
        q, p, d = search(v, x, place, _radius(limit, cosine) * (1 + 1e-6), k, sure)
        if cosine:
            d = np.concatenate([1 - (x[q[s : s + 8192]] * v[p[s : s + 8192]]).sum(1) for s in range(0, len(q), 8192)] or [d])
        keep = d <= limit[q]
        q, p, d = q[keep], p[keep], d[keep]
        return pa.table([pa.array([table.column(c)[0].as_py()] * len(q), pa.string()) for c in SCOPE] + [own.take(pa.array(q)).cast(pa.string()), ids.take(pa.array(p)).cast(pa.string()), pa.array(d)], schema=schema)

    return run


#: What a row is in a search task: one of the vectors searched, one that asks, or both.
DATA, ASKS, BOTH = 0, 1, 2


def _searched(homes: DataFrame, asks: DataFrame | None, k: int, cell_rows: int, block_rows: int, sure: float) -> DataFrame:
    """The up to k nearest of each row of ``asks`` in each of its ``cells``; without ``asks``, of each row in its home cell.

    Rows of cells with more than twice ``cell_rows`` are dealt out to parts, all of which a query goes to, and queries of a
    cell to blocks, each of which gets the cell's rows. A home cell that is one part and one block is sent once, and a scope of
    one cell isn't counted.
    """
    cell = [*SCOPE, "cell"]
    salt = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(7)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    columns = [*cell, "vec_id", "v", "cosine", "near_limit"]
    size = lambda df, rows, name: df.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).alias(name))
    of = lambda df, role, part, block: df.select(*columns, F.lit(role).alias("role"), part.alias("part"), block.alias("block"))
    whole, homes = homes.where("not several"), homes.where("several")
    parts = size(homes, 2 * cell_rows, "parts")
    if asks is None:
        sizes, goes = parts.join(size(homes, block_rows, "blocks"), cell), homes
        one = "parts = 1 and blocks = 1"
    else:
        goes = asks.withColumn("cell", F.explode("cells"))
        sizes, one = parts.join(size(asks.select(*SCOPE, F.explode("cells").alias("cell")), block_rows, "blocks"), cell), "false"
    data, queries, zero = homes.join(sizes, cell), goes.join(sizes, cell), F.lit(0).cast("bigint")
    tasks = of(data.where(f"not ({one})"), DATA, salt("parts"), every("blocks")).unionByName(of(queries.where(f"not ({one})"), ASKS, every("parts"), salt("blocks")))
    if asks is None:
        tasks = tasks.unionByName(of(data.where(one), BOTH, zero, zero)).unionByName(of(whole, BOTH, zero, zero))
    return tasks.groupBy(*cell, "part", "block").applyInArrow(_search_udf(k, sure), FOUND)


def _nearest_reps(reps: DataFrame, k: int, cell_rows: int, block_rows: int, sure: float) -> DataFrame:
    """Up to k neighbours of each representative, and further ones from other cells: home cells, then batches of cells."""
    trees = _trees(reps, cell_rows)
    homes = cut(reps.mapInArrow(_homes_udf(trees), f"{REP}, cell bigint, several boolean"), "homes")
    found = cut(_searched(homes, None, k, cell_rows, block_rows, sure), "neighbours")
    boxes = _boxes(homes, trees) if trees else {}
    start, step, open_ = 0, FIRST_CELLS, homes.where("several")
    while trees:
        kth = found.groupBy(*SCOPE, "vec_id").agg(F.try_element_at(F.array_sort(F.collect_list("distance")), F.lit(k)).alias("kth"))
        nearer = open_.join(kth, [*SCOPE, "vec_id"], "left").withColumn("near_limit", F.least("near_limit", "kth")).select(*[c for c in homes.columns if c != "several"])
        asks = cut(nearer.mapInArrow(_visits_udf(trees, boxes, start, start + step), f"{REP}, cells array<bigint>, more boolean"), "visits")
        if asks.isEmpty():
            break
        found = found.unionByName(cut(_searched(homes, asks, k, cell_rows, block_rows, sure), "neighbours"))
        open_ = homes.join(asks.where("more").select(*SCOPE, "vec_id"), [*SCOPE, "vec_id"], "left_semi")
        start, step = start + step, 4 * step
    return found


def nearest(live: DataFrame, k: int = 5, cell_rows: int = CELL_ROWS, sure: float = SURE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``entity_id, scope_name, vec_id, other, distance``: for each vector its up to ``k`` nearest others in the scope.

    live: as of :func:`live_vectors`; only neighbours at most ``near_limit`` away count (infinity: all; NULL: none).
    Equal distances go by id. Within a cell a neighbour is missed with probability ``1 - sure`` at most; between cells the
    search is approximate. No bucket or candidate list is capped, and the same is done at every length and size. Of a group of more than k equal vectors each has the first k others by id as neighbours.
    """
    live = cut(live.where("near_limit is not null"), "vectors")
    copies = cut(_copies(live, k), "copies")
    listed = copies.where("vec_id = first_id").select(*SCOPE, "rep", "vec_id", "place", "copies")
    others = copies.where("vec_id <> rep").select(*SCOPE, "vec_id").distinct()
    reps = live.join(others, [*SCOPE, "vec_id"], "left_anti").select(*SCOPE, "vec_id", "v", "cosine", "near_limit")
    near = _nearest_reps(reps, k, cell_rows, block_rows, sure)
    w = Window.partitionBy(*SCOPE, "vec_id").orderBy("distance", "other")
    near = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")
    as_other = listed.select(*SCOPE, F.col("rep").alias("other"), F.col("vec_id").alias("copy"))
    near = near.join(as_other, [*SCOPE, "other"], "left").withColumn("other", F.coalesce("copy", "other")).drop("copy")
    as_query = listed.where(F.col("copies") <= k).select(*SCOPE, F.col("rep").alias("vec_id"), F.col("vec_id").alias("copy"), "copies")
    many = listed.where((F.col("copies") > k) & (F.col("place") == 1)).select(*SCOPE, F.col("rep").alias("vec_id"))
    near = near.join(many, [*SCOPE, "vec_id"], "left_anti").join(as_query, [*SCOPE, "vec_id"], "left")
    near = near.select(*SCOPE, F.coalesce("copy", "vec_id").alias("vec_id"), "other", "distance", (F.lit(k) - F.coalesce("copies", F.lit(1)) + 1).alias("room"))
    near = near.withColumn("r", F.row_number().over(w)).where("r <= room").select(*SCOPE, "vec_id", "other", "distance")
    same = copies.where("vec_id <> first_id and place <= case when vec_id >= first_id then %d else %d end" % (k, k + 1)).select(*SCOPE, "vec_id", F.col("first_id").alias("other"), F.lit(0.0).alias("distance"))
    return near.unionByName(same)


def near_pairs(live: DataFrame, k: int = 5, cell_rows: int = CELL_ROWS, sure: float = SURE) -> DataFrame:
    """Pairs within ``near_limit`` of which one is among the other's ``k`` nearest: ``..., vec_id_a < vec_id_b``."""
    n = nearest(live, k, cell_rows, sure)
    return n.select(*SCOPE, F.least("vec_id", "other").alias("vec_id_a"), F.greatest("vec_id", "other").alias("vec_id_b")).distinct()
