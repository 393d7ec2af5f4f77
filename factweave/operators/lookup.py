"""Index-style lookups over JSON documents ``entity_id, doc_id, body``: terms, prefixes, numeric ranges.

Terms and numbers are taken from parsed bodies by built-in functions. A lookup is a filter on the documents: nothing is
exploded or shuffled for it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.json import leaves, lenient


def _docs(docs: DataFrame, entity_id: str | None = None) -> DataFrame:
    rows = docs if entity_id is None else docs.where(F.col("entity_id") == entity_id)
    return lenient(rows).select("entity_id", "doc_id", "body").where("body is not null")


def _terms() -> Column:
    """The terms of a document: each leaf's text, and it behind its key and a colon; an empty text has no bare term."""
    both = F.flatten(F.transform(leaves(F.col("body")), lambda e: F.array(e["text"], F.concat(e["key"], F.lit(":"), e["text"]))))
    return F.filter(both, lambda t: t != "")


def terms(docs: DataFrame) -> DataFrame:
    """``entity_id, doc_id, term``; bodies that are no JSON objects have none."""
    return _docs(docs).select("entity_id", "doc_id", F.explode(F.array_distinct(_terms())).alias("term"))


def numbers(docs: DataFrame) -> DataFrame:
    """``entity_id, doc_id, attr, num`` of each numeric leaf, all of a list."""
    return _docs(docs).select("entity_id", "doc_id", F.inline(F.transform(F.filter(leaves(F.col("body")), lambda e: e["num"].isNotNull()), lambda e: F.struct(e["key"].alias("attr"), e["num"].alias("num")))))


def term_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``entity_id, doc_id, gained, lost``: the sorted terms that documents have and had only after, and before."""
    sets = [_docs(d).select("entity_id", "doc_id", _terms().alias(n)) for d, n in ((before, "was"), (after, "has"))]
    none = F.array().cast("array<string>")
    both = sets[0].join(sets[1], ["entity_id", "doc_id"], "full").select("entity_id", "doc_id", F.coalesce("was", none).alias("was"), F.coalesce("has", none).alias("has"))
    both = both.select("entity_id", "doc_id", F.array_sort(F.array_except("has", "was")).alias("gained"), F.array_sort(F.array_except("was", "has")).alias("lost"))
    return both.where((F.size("gained") > 0) | (F.size("lost") > 0))


def lookup(docs: DataFrame, entity_id: str, term: str) -> DataFrame:
    """``doc_id`` of the documents with the term."""
    return lookup_all(docs, entity_id, [term])


def lookup_all(docs: DataFrame, entity_id: str, wanted: Sequence[str]) -> DataFrame:
    """``doc_id`` of the documents with all the terms; one pass instead of an intersection of lookups."""
    have = F.forall(F.array(*map(F.lit, dict.fromkeys(wanted))), lambda t: F.array_contains(F.col("terms"), t))
    return _docs(docs, entity_id).select("doc_id", F.coalesce(_terms(), F.array().cast("array<string>")).alias("terms")).where(have).select("doc_id").distinct()


def lookup_prefix(docs: DataFrame, entity_id: str, prefix: str) -> DataFrame:
    """``doc_id`` of the documents with a term that begins with ``prefix``; all that have terms for an empty one."""
    return _docs(docs, entity_id).where(F.exists(_terms(), lambda t: t.startswith(prefix))).select("doc_id").distinct()


def lookup_range(docs: DataFrame, entity_id: str, attr: str, low: float, high: float, open_low: bool = False, open_high: bool = False) -> DataFrame:
    """``doc_id`` of the documents with a number of ``attr`` in the range; none if ``low > high``; no bound may be NaN or infinite."""
    if not (math.isfinite(low) and math.isfinite(high)):
        raise ValueError("a bound must be finite")
    inside = lambda n: (n > low if open_low else n >= low) & (n < high if open_high else n <= high)
    has = F.exists(leaves(F.col("body")), lambda e: F.coalesce((e["key"] == attr) & inside(e["num"]), F.lit(False)))
    return _docs(docs, entity_id).where(has).select("doc_id").distinct()


def stats(docs: DataFrame, entity_id: str, attr: str) -> DataFrame:
    """``n, mean, m2, low, high`` of the distinct (document, number) of an attribute; ``m2`` is the sum of squared deviations."""
    x = numbers(docs.where(F.col("entity_id") == entity_id)).where(F.col("attr") == attr).distinct()
    return x.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("num"), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop("num") * F.count("num"), F.lit(0.0)).alias("m2"), F.min("num").alias("low"), F.max("num").alias("high"))


def stats_all(docs: DataFrame) -> DataFrame:
    """:func:`stats` of every tenant and attribute, with the sample standard deviation (NULL for one number)."""
    x = numbers(docs).distinct()
    return x.groupBy("entity_id", "attr").agg(F.count(F.lit(1)).alias("n"), F.avg("num").alias("mean"), (F.var_pop("num") * F.count("num")).alias("m2"), F.min("num").alias("low"), F.max("num").alias("high"), F.when(F.count("num") > 1, F.stddev_samp("num")).alias("stddev"))
