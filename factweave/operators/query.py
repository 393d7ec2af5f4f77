"""Query, QueryAsOf and pull over documents: clauses compiled to one filter and one projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.operators.closure import category_in_tree
from factweave.plans.clauses import Aggregate, Env, Facts, Rule, Value, anchors, bound_value, check_rules, compile_clauses, narrowed, top_level

FUNCTIONS = ("count", "sum", "total", "avg", "min", "max")


def matching(facts: Facts, where: Sequence[object], edges: DataFrame | None, rules: Sequence[Rule] | None, anchored: bool) -> tuple[DataFrame, Env]:
    """(the documents for which all clauses hold, the variables bound there)."""
    if not where or (anchored and not anchors(where)):
        raise ValueError("the query needs a pattern with an attribute and a literal" if where else "the query has no clauses")
    narrow, calls = narrowed(where), []
    tests, env = compile_clauses(where if narrow is None else narrow, facts, {"?e": (True, facts.entity())}, calls)
    rows = facts.df
    for i, (call, value) in enumerate(calls):
        if rules is not None:
            check_rules(rules, call)
        if edges is None:
            raise ValueError("a rule call needs the edges of the tree")
        names = category_in_tree(edges, call.root).withColumnRenamed("name", f"__rule_{i}")  # distinct
        rows = rows.join(names, (F.lit(None).cast("string") if value.text is None else value.text) == F.col(f"__rule_{i}"), "left")
    for test in [F.lit(False)] if narrow is None else tests:
        rows = rows.where(test)
    return rows, env


def query(facts: Facts, find: Sequence[str] = (), where: Sequence[object] = (), aggregates: Sequence[Aggregate] = (), group_by: Sequence[str] = (), edges: DataFrame | None = None, rules: Sequence[Rule] | None = None, anchored: bool = True) -> DataFrame:
    """A row per document for which all clauses hold, with a column per variable of ``find`` (without ``?``; ``?e`` is the
    document); or aggregates over those documents, by ``group_by``.

    Rows aren't made distinct; an unbound variable is NULL. With ``anchored`` a top-level pattern with a literal must be
    there. Aggregates: ``count`` counts all rows, the others numbers only; sum and avg of none are 0, min and max NULL;
    without ``group_by`` there is always one row. ``edges`` are ``child, parent`` for rule calls, which may also stand below
    Or and Not; with ``rules`` given, a called rule must be a walk of a tree.
    """
    if bad := [a.fn for a in aggregates if a.fn not in FUNCTIONS]:
        raise ValueError(f"unknown aggregate {bad[0]}")
    rows, env = matching(facts, where, edges, rules, anchored)
    if not aggregates:
        return rows.select(*[bound_value(env, v).out().alias(v.lstrip("?")) for v in find])
    keys = [bound_value(env, v).out().alias(v.lstrip("?")) for v in group_by]
    nums = [_number(bound_value(env, a.over)).alias(f"n{i}") for i, a in enumerate(aggregates)]
    rows = rows.select(*keys, *nums)
    done = [_aggregate(a.fn, F.col(f"n{i}")).alias(a.name) for i, a in enumerate(aggregates)]
    if not group_by:
        return rows.agg(*done)
    names = [v.lstrip("?") for v in group_by]
    return rows.groupBy(*names).agg(*done).orderBy(*[F.col(n).cast("string") for n in names])


def _number(value: Value):
    return value.num if value.num is not None else F.lit(None).cast("double")


def _aggregate(fn: str, n):
    zero = F.lit(0.0)
    return {
        "count": lambda: F.count(F.lit(1)).cast("double"), "sum": lambda: F.coalesce(F.sum(n), zero), "total": lambda: F.coalesce(F.sum(n), zero),
        "avg": lambda: F.coalesce(F.avg(n), zero), "min": lambda: F.min(n), "max": lambda: F.max(n),
    }[fn]()


def query_as_of(versions: DataFrame, at_ns: int, make_facts, **request) -> DataFrame:
    """:func:`query` over the documents as they were at ``at_ns``; no anchor is needed. ``make_facts`` gets the documents."""
    from factweave.operators.store import as_of

    return query(make_facts(as_of(versions, at_ns)), anchored=False, **request)


def pull(facts: Facts, attributes: Sequence[str] | str, where: Sequence[object], edges: DataFrame | None = None, rules: Sequence[Rule] | None = None) -> DataFrame:
    """``doc_id, pulled``: the named attributes that are there (``"*"``: all) of each matching document, as JSON text.

    An attribute that is null in a JSON body is there. ``"*"`` over bodies gives the body, and no other columns.
    """
    if attributes != "*" and any("{" in a for a in attributes):
        raise ValueError("nested pull patterns aren't supported")
    rows, _ = matching(facts, where, edges, rules, True)
    if attributes == "*" and facts.variant is not None:
        pulled = F.to_json(facts.variant)
    else:
        body = None if facts.variant is None else top_level(facts.variant)
        names = list(facts.columns) if attributes == "*" else list(dict.fromkeys(attributes))
        known = {n: facts.columns[n] if n in facts.columns else F.try_element_at(body, F.lit(n)) for n in names if n in facts.columns or body is not None}
        pulled = F.to_json(F.struct(*[c.alias(n) for n, c in known.items()]))
    return rows.select(F.col(facts.doc_id).alias("doc_id"), pulled.alias("pulled"))
