"""The tables of a data folder as facts, events, edges and current documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions.json import instant_of, parsed, text_of, top
from factweave.operators.store import as_of
from factweave.plans.clauses import Facts
from factweave.sources.entries import entry_rows
from factweave.sources.tables import table


def event_facts(spark: SparkSession, d: str) -> Facts:
    """A record per row of ``events``."""
    df = table(spark, d, "events")
    columns = {
        ":record/type": F.lit("event"), ":event/type": F.col("event_type"), ":event/value": F.col("value"),
        ":event/user": F.col("user_id"), ":event/k": F.get_json_object("props", "$.k").cast("double"),
    }
    return Facts(df, "event_id", columns)


def text_facts(spark: SparkSession, d: str) -> Facts:
    """A record per row of ``documents``; ``:doc/lines`` is a list."""
    df = table(spark, d, "documents")
    columns = {
        ":record/type": F.lit("document"), ":doc/text": F.col("text"), ":doc/lang": F.col("lang"), ":doc/source": F.col("source"),
        ":doc/title": F.col("title_id"), ":doc/chars": F.col("n_chars"), ":doc/lines": F.split("text", "\n"),
    }
    return Facts(df, "doc_id", columns)


def customer_facts(spark: SparkSession, d: str) -> Facts:
    """A record per row of ``customer``; the category is its nation's node in the hierarchy."""
    df = table(spark, d, "customer")
    columns = {
        ":record/type": F.lit("customer"), ":customer/segment": F.col("c_mktsegment"), ":customer/balance": F.col("c_acctbal"),
        ":customer/name": F.col("c_name"), ":category/name": F.concat(F.lit("N"), F.col("c_nationkey").cast("string")),
    }
    return Facts(df, "c_custkey", columns)


def current_documents(spark: SparkSession, d: str) -> DataFrame:
    """``entity_id, doc_id, at_ns, seq, body`` of the documents of ``doc_version`` that exist."""
    return as_of(table(spark, d, "doc_version"))


def body_facts(docs: DataFrame) -> Facts:
    """Documents with JSON bodies as facts; bodies that are no JSON have no attributes."""
    return Facts(parsed(docs, "body", "__variant"), "doc_id", {}, F.col("__variant"))


def entry_events(spark: SparkSession, d: str, entity_id: str | None = None, item_id: str | None = None) -> DataFrame:
    """The entries of ``temporal_entry`` as events ``entity_id, item_id, doc_id, type, at_ns``; ``doc_id`` is the entry's id.

    Of one tenant or item only its rows are compared with each other.
    """
    rows = entry_rows(table(spark, d, "temporal_entry"))
    rows = rows if entity_id is None else rows.where(F.col("entity_id") == entity_id)
    rows = (rows if item_id is None else rows.where(F.col("item_id") == item_id)).dropDuplicates(["entry_id"])
    return rows.select("entity_id", "item_id", F.lpad(F.col("entry_id").cast("string"), 20, "0").alias("doc_id"), F.col("entry_type").alias("type"), "at_ns")


def body_events(docs: DataFrame) -> DataFrame:
    """The events that JSON documents ``entity_id, doc_id, body`` are, as ``entity_id, item_id, doc_id, type, at_ns``.

    A document is one if its top level has a string ``item_id``, a string ``type`` and an instant ``at``, a number of
    nanoseconds or an RFC3339 text.
    """
    v = F.col("__variant")
    rows = parsed(docs, "body", "__variant").select("entity_id", text_of(top(v, "item_id")).alias("item_id"), "doc_id", text_of(top(v, "type")).alias("type"), instant_of(top(v, "at")).alias("at_ns"))
    return rows.where("item_id is not null and type is not null and at_ns is not null")


def nation_edges(spark: SparkSession, d: str) -> DataFrame:
    """``child, parent``: regions R, nations N, customers C and suppliers S by number."""
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    nations = table(spark, d, "nation").select(node("N", "n_nationkey").alias("child"), node("R", "n_regionkey").alias("parent"))
    customers = table(spark, d, "customer").select(node("C", "c_custkey").alias("child"), node("N", "c_nationkey").alias("parent"))
    suppliers = table(spark, d, "supplier").select(node("S", "s_suppkey").alias("child"), node("N", "s_nationkey").alias("parent"))
    return nations.unionByName(customers).unionByName(suppliers)
