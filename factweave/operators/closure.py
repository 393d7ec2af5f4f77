"""Hierarchies of ``child, parent`` edges of one tenant, or of all with an ``entity_id``: ancestors, descendants, trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.functions.json import parsed, text_of, top
from factweave.plans.shared import cut

#: Fixed value: the store's cap on the depth of a hierarchy.
DEPTH = 256
#: Nodes of a level that the driver keeps at most; of all such levels DEPTH times as many.
FEW = 1000


def _walk(edges: DataFrame, start: DataFrame, up: bool) -> DataFrame:
    """``node, depth`` of all nodes above (below) the ``node`` of ``start``, level by level until a level is empty.

    A level of at most FEW nodes is a filter on the edges, and its nodes are kept in the driver; from the first larger one on,
    each level is a join of the last one with the edges, written to the shared folder, so lineage doesn't grow. A node seen
    before isn't walked again, so cycles end. Raises if there are nodes below (above) level DEPTH.
    """
    e = edges.where("child is not null and parent is not null").select("child", "parent").distinct()
    here, there = ("child", "parent") if up else ("parent", "child")
    e = cut(e.select(F.col(here).alias("here"), F.col(there).alias("there")), "edges")
    level, found, begin = start.select(F.col("node"), F.lit(0).alias("depth")), None, 1
    nodes, seen = [r.node for r in level.limit(FEW + 1).collect()], {}
    while nodes and len(nodes) <= FEW:
        nxt = e.where(F.col("here").isin(nodes)).select("there").distinct().limit(len(seen) + FEW + 1).collect()
        new = [r.there for r in nxt if r.there not in seen]
        if not new:
            nodes = []
            break
        if len(new) > FEW:
            break  # the level is walked again below, as a whole
        if begin > DEPTH:
            raise ValueError(f"the hierarchy is deeper than {DEPTH}")
        seen |= dict.fromkeys(new, begin)
        nodes, begin = new, begin + 1
    if seen:
        found = start.sparkSession.createDataFrame(list(seen.items()), "node string, depth int")
        level = found.where(F.col("depth") == begin - 1)
    if not nodes:
        return found if found is not None else start.sparkSession.createDataFrame([], "node string, depth int")
    for depth in range(begin, DEPTH + 2):
        nxt = level.join(e, level["node"] == e["here"]).select(F.col("there").alias("node"), F.lit(depth).alias("depth")).distinct()
        if found is not None:
            nxt = nxt.join(found.select("node"), "node", "left_anti")
        nxt = cut(nxt, "level")
        if nxt.isEmpty():
            break
        if depth > DEPTH:
            raise ValueError(f"the hierarchy is deeper than {DEPTH}")
        level, found = nxt, nxt if found is None else found.unionByName(nxt)
    return found if found is not None else start.sparkSession.createDataFrame([], "node string, depth int")


def _of(edges: DataFrame, entity_id: str | None) -> DataFrame:
    return edges if entity_id is None else edges.where(F.col("entity_id") == entity_id)


def body_edges(docs: DataFrame, attribute: str = "parent") -> DataFrame:
    """``entity_id, child, parent`` of JSON documents ``entity_id, doc_id, body`` whose top-level ``attribute`` is a text."""
    rows = parsed(docs, "body", "__v").select("entity_id", F.col("doc_id").alias("child"), text_of(top(F.col("__v"), attribute)).alias("parent"))
    return rows.where("coalesce(parent, '') <> ''")


def ancestors(edges: DataFrame, node: str, entity_id: str | None = None) -> DataFrame:
    """``node, depth``: the chain from the immediate parent (depth 1) to the root; none for a root or an unknown node."""
    start = edges.sparkSession.createDataFrame([(node,)], "node string")
    return _walk(_of(edges, entity_id), start, True).where(F.col("node") != node)


def descendants(edges: DataFrame, root: str, entity_id: str | None = None) -> DataFrame:
    """``node, depth``: every node below ``root``, without it."""
    start = edges.sparkSession.createDataFrame([(root,)], "node string")
    return _walk(_of(edges, entity_id), start, False).where(F.col("node") != root)


def category_in_tree(edges: DataFrame, root: str) -> DataFrame:
    """``name``: the root and all its descendants."""
    return descendants(edges, root).select(F.col("node").alias("name")).unionByName(edges.sparkSession.createDataFrame([(root,)], "name string")).distinct()


def closure(edges: DataFrame) -> DataFrame:
    """``descendant, ancestor, depth`` for all pairs of the hierarchy, by one join a level; raises on a cycle."""
    e = cut(edges.where("child is not null and parent is not null").select("child", "parent").distinct(), "edges")
    level = e.select(F.col("child").alias("descendant"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    found = level
    for depth in range(2, DEPTH + 1):
        level = cut(level.join(e, level["ancestor"] == e["child"]).select("descendant", F.col("parent").alias("ancestor"), F.lit(depth).alias("depth")), "level")
        if level.isEmpty():
            return found
        if not level.where("descendant = ancestor").isEmpty():
            raise ValueError("the hierarchy has a cycle")
        found = found.unionByName(level)
    raise ValueError(f"the hierarchy is deeper than {DEPTH}")
