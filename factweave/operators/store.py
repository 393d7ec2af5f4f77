"""Documents and their versions: put, delete, read, facts, as-of state. A version is ``seq, entity_id, doc_id, at_ns, deleted, body``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

KEYS = ["entity_id", "doc_id"]
DDL = "seq bigint, entity_id string, doc_id string, at_ns bigint, deleted boolean, body string"


def check_ids(entity_id: str, *doc_ids: str) -> None:
    """Tenants are non-empty and have no colon; documents are non-empty."""
    if not entity_id or ":" in entity_id:
        raise ValueError("a tenant is a non-empty text without ':'")
    if not all(doc_ids):
        raise ValueError("a document id can't be empty")


def valid_versions(versions: DataFrame) -> DataFrame:
    return versions.where("at_ns is not null and seq is not null and entity_id is not null and doc_id is not null").select("seq", *KEYS, "at_ns", F.coalesce("deleted", F.lit(False)).alias("deleted"), "body")


def as_of(versions: DataFrame, at_ns: int | None = None) -> DataFrame:
    """``entity_id, doc_id, at_ns, seq, body`` of the documents that exist at ``at_ns`` (None: after all versions).

    The version with the greatest ``at_ns``, then ``seq``, holds; it combines before the shuffle, so a document with many
    versions costs no task more than its share.
    """
    rows = valid_versions(versions)
    rows = rows if at_ns is None else rows.where(F.col("at_ns") <= at_ns)
    last = rows.groupBy(*KEYS).agg(F.max_by(F.struct("at_ns", "seq", "deleted", "body"), F.struct("at_ns", "seq")).alias("v"))
    return last.where("not v.deleted").select(*KEYS, "v.at_ns", "v.seq", "v.body")


def document(versions: DataFrame, entity_id: str, doc_id: str) -> DataFrame:
    """The row of :func:`as_of` of one document, or none."""
    check_ids(entity_id, doc_id)
    return as_of(versions.where((F.col("entity_id") == entity_id) & (F.col("doc_id") == doc_id)))


def get(versions: DataFrame, entity_id: str, doc_id: str) -> str | None:
    """The current body of one document; None if it isn't there."""
    row = document(versions, entity_id, doc_id).first()
    return row.body if row else None


def scan(versions: DataFrame, entity_id: str) -> DataFrame:
    """All current documents of a tenant."""
    check_ids(entity_id)
    return as_of(versions.where(F.col("entity_id") == entity_id))


def batch_put(spark: SparkSession, entity_id: str, docs: dict[str, str], at_ns: int, seq: int) -> DataFrame:
    """The versions that put all of ``docs`` at once; with any id that isn't valid, none."""
    check_ids(entity_id, *docs)
    return spark.createDataFrame([Row(seq=seq + i, entity_id=entity_id, doc_id=d, at_ns=at_ns, deleted=False, body=b) for i, (d, b) in enumerate(docs.items())], DDL)


def put(spark: SparkSession, entity_id: str, doc_id: str, body: str, at_ns: int, seq: int) -> DataFrame:
    return batch_put(spark, entity_id, {doc_id: body}, at_ns, seq)


def delete(versions: DataFrame, targets: DataFrame, at_ns: int, seq: int) -> DataFrame:
    """Tombstones for those of ``targets`` (``entity_id, doc_id``) that exist; deleting what isn't there does nothing."""
    live = as_of(versions).join(targets.select(*KEYS).distinct(), KEYS, "left_semi")
    return live.select(F.lit(seq).cast("bigint").alias("seq"), *KEYS, F.lit(at_ns).cast("bigint").alias("at_ns"), F.lit(True).alias("deleted"), F.lit(None).cast("string").alias("body"))


def last_written(versions: DataFrame) -> DataFrame:
    """``entity_id, doc_id, updated_at_ns, created_at_ns, version`` of the documents that exist.

    Every put counts, one of equal bytes too; after a delete a document starts again at version 1.
    """
    rows = valid_versions(versions).dropDuplicates([*KEYS, "at_ns", "seq"])
    gone = rows.where("deleted").groupBy(*KEYS).agg(F.max(F.struct("at_ns", "seq")).alias("gone"))
    live = rows.where("not deleted").join(gone, KEYS, "left").where(F.col("gone").isNull() | (F.struct("at_ns", "seq") > F.col("gone")))
    return live.groupBy(*KEYS).agg(F.max("at_ns").alias("updated_at_ns"), F.min("at_ns").alias("created_at_ns"), F.count(F.lit(1)).alias("version"))


def assert_facts(facts: DataFrame, order: str) -> DataFrame:
    """``entity_id, record_id, attribute, value``: the last value by ``order`` of each attribute of each record.

    Facts without a record or an attribute are skipped; earlier facts of the record with other attributes stay.
    """
    good = facts.where("coalesce(record_id, '') <> '' and coalesce(attribute, '') <> ''")
    return good.groupBy("entity_id", "record_id", "attribute").agg(F.max_by(F.struct("value"), order).alias("v")).select("entity_id", "record_id", "attribute", "v.value")


def retract(facts: DataFrame, record_id: str, attribute: str | None = None) -> DataFrame:
    """``facts`` without the record; a single attribute can't be retracted."""
    if attribute is not None:
        raise NotImplementedError("only whole records can be retracted")
    return facts.where(~F.coalesce(F.col("record_id") == record_id, F.lit(False)))
