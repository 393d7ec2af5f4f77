"""The change feed and the operation log, in batch and as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factweave.operators.cdc import CurrentState
from factweave.plans.shared import SharedFiles

KEYS = ["entity_id", "doc_id"]
#: Rows of one DataFrame that a stream's step puts out.
ROWS_OUT = 10_000


def classify(writes: DataFrame) -> DataFrame:
    """``seq, entity_id, doc_id, kind, old_doc, new_doc`` of writes ``seq, entity_id, doc_id, deleted, body``.

    Without a document before, a write is an assert; with one a change, of equal bytes too; a delete is a retract. A
    delete of nothing is no event. Rows of one ``seq`` are one write; NULL ids or ``seq`` are left out.
    """
    good = writes.where("seq is not null and entity_id is not null and doc_id is not null").dropDuplicates(["seq"])
    w = Window.partitionBy(*KEYS).orderBy("seq")
    gone = F.coalesce("deleted", F.lit(False))
    rows = good.select("seq", *KEYS, gone.alias("gone"), F.when(~gone, F.coalesce("body", F.lit(""))).alias("new_doc")).withColumn("old_doc", F.lag("new_doc").over(w))
    kind = F.when(F.col("gone"), "retract").when(F.col("old_doc").isNull(), "assert").otherwise("change")
    return rows.withColumn("kind", kind).where("not gone or old_doc is not null").select("seq", *KEYS, "kind", "old_doc", "new_doc")


def subscribe(feed: DataFrame, entity_id: str | None = None, prefix: str | None = None) -> DataFrame:
    """The events of a tenant and of documents whose ids begin with ``prefix``; works on streams as well."""
    feed = feed if entity_id is None else feed.where(F.col("entity_id") == entity_id)
    return feed if not prefix else feed.where(F.col("doc_id").startswith(prefix))


def number(writes: DataFrame, after: int = 0) -> DataFrame:
    """A log of ``writes`` with ``seq`` from ``after + 1`` without gaps, in the order of ``at_ns`` and the ids.

    Rows are numbered within ranges of the order, and each range begins after the rows of those before, of which only the
    counts go to the driver; so no task sees all rows.
    """
    from factweave.plans.shared import cut

    order = ["at_ns", *KEYS]
    ranged = cut(writes.drop("seq").repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "log")
    sizes = {r["__part"]: r["n"] for r in ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = {}, after
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    if not before:
        return ranged.withColumn("seq", F.lit(0).cast("bigint")).drop("__part")
    starts = F.create_map(*[F.lit(x) for p in before for x in (p, before[p])])
    w = Window.partitionBy("__part").orderBy(*order)
    return ranged.withColumn("seq", (starts[F.col("__part")] + F.row_number().over(w)).cast("bigint")).drop("__part")


def tail(log: DataFrame, from_seq: int, min_seq: int | None = None) -> DataFrame:
    """The entries from ``from_seq`` on; raises LookupError if entries before ``min_seq`` are asked for.

    ``min_seq`` is the least number that :func:`trim` would have left; by default that of the log's first entry, as in a log
    without gaps.
    """
    first = log.agg(F.min("seq")).first()[0] if min_seq is None else min_seq
    if first is not None and from_seq < first:
        raise LookupError("the log is trimmed; a snapshot is needed")
    return log.where(F.col("seq") >= from_seq).orderBy("seq")


def trim(log: DataFrame, keep: int) -> DataFrame:
    """The newest ``keep`` sequence numbers of the log."""
    last = log.agg(F.max("seq").alias("last"))
    return log.crossJoin(F.broadcast(last)).where(F.col("seq") > F.col("last") - keep).drop("last")  # one row


def replay(log: DataFrame) -> DataFrame:
    """``entity_id, doc_id, seq, body`` that stand after all entries ``seq, entity_id, doc_id, deleted, body``."""
    last = log.where("seq is not null and entity_id is not null and doc_id is not null").groupBy(*KEYS).agg(F.max_by(F.struct("seq", F.coalesce("deleted", F.lit(False)).alias("deleted"), "body"), "seq").alias("v"))
    return last.where("not v.deleted").select(*KEYS, "v.seq", "v.body")


def status(log: DataFrame, applied: int = 0) -> DataFrame:
    """``current_seq, min_seq, applied_seq``."""
    return log.agg(F.max("seq").alias("current_seq"), F.min("seq").alias("min_seq")).withColumn("applied_seq", F.lit(applied).cast("bigint"))


def write_snapshot(documents: DataFrame, seq: int, path: str) -> None:
    """The documents ``entity_id, doc_id, seq, body`` as they stood after entry ``seq``, complete once its header is there."""
    documents.select(*KEYS, "seq", "body").write.parquet(f"{path}/documents")
    SharedFiles(documents.sparkSession).publish_json(f"{path}/HEADER", {"seq": seq})


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(documents, the last entry in them) of :func:`write_snapshot`; raises LookupError if it isn't complete."""
    header = SharedFiles(spark).read_json(f"{path}/HEADER")
    if header is None:
        raise LookupError("there is no snapshot")
    return spark.read.schema("entity_id string, doc_id string, seq bigint, body string").parquet(f"{path}/documents"), header["seq"]


class Replica:
    """A read-only copy of a store, kept below ``root`` by a snapshot and the entries of the log behind it.

    The last entry applied is published with the documents that it led to, so an attempt that fails is done again from
    where the last one ended, and entries given twice change nothing.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root, SharedFiles(spark)

    def _state(self) -> CurrentState | None:
        copy = self.files.read_json(f"{self.root}/COPY")
        return CurrentState(self.spark, f"{self.root}/{copy['of']}") if copy else None

    def applied_seq(self) -> int | None:
        """The last entry applied; None before the first snapshot."""
        state = self._state()
        return state.manifest()["with"]["applied_seq"] if state else None

    def documents(self) -> DataFrame:
        """``entity_id, doc_id, seq, body`` of the documents that exist here."""
        state = self._state()
        rows = self.spark.createDataFrame([], "entity_id string, doc_id string, seq bigint, body string")
        return state.documents().select(*KEYS, "seq", F.col("new_doc").alias("body")) if state else rows

    def bootstrap(self, snapshot: str) -> None:
        """Begins anew from a snapshot; what was here stays current until the new copy is complete."""
        documents, seq = read_snapshot(self.spark, snapshot)
        before, name = self.files.read_json(f"{self.root}/COPY"), f"copy-{uuid.uuid4().hex}"
        CurrentState(self.spark, f"{self.root}/{name}").apply(_as_changes(documents.withColumn("deleted", F.lit(False))), publish={"applied_seq": seq})
        self.files.publish_json(f"{self.root}/COPY", {"of": name})
        if before:
            self.files.delete(f"{self.root}/{before['of']}")

    def catch_up(self, log: DataFrame, snapshot: str, min_seq: int | None = None) -> None:
        """Applies the entries behind the last one applied; at first, or if the log no longer has them, from ``snapshot`` on."""
        if self.applied_seq() is None:
            self.bootstrap(snapshot)
        try:
            entries = tail(log, self.applied_seq() + 1, min_seq)
        except LookupError:
            self.bootstrap(snapshot)
            entries = tail(log, self.applied_seq() + 1, min_seq)
        last = entries.agg(F.max("seq")).first()[0]
        if last is not None:
            self._state().apply(_as_changes(entries), publish={"applied_seq": last})

    def status(self, log: DataFrame) -> DataFrame:
        """``current_seq, min_seq, applied_seq`` of the log and this copy of it."""
        return status(log, self.applied_seq() or 0)

    def put(self, *_) -> None:
        """Writes are rejected."""
        raise PermissionError("a replica is read-only")

    delete = batch_put = put


def _as_changes(entries: DataFrame) -> DataFrame:
    """Entries of the log, in the order of ``seq``, as changes of :class:`CurrentState`."""
    kind = F.when(F.coalesce("deleted", F.lit(False)), "retract").otherwise("change")
    return entries.select(*KEYS, "seq", F.col("seq").alias("at_unix_nanos"), kind.alias("kind"), F.col("body").alias("new_doc"))


def follow(feed: DataFrame, state: CurrentState, checkpoint: str) -> StreamingQuery:
    """Keeps ``state`` up to date with a stream of changes (columns of :func:`factweave.operators.cdc.document_changes`).

    A batch that is given twice, after a failure, changes nothing the second time: an upsert only takes greater
    sequences, and a batch is published as a whole. Read-only copies are readers of ``state.documents()``.
    """
    return feed.writeStream.foreachBatch(lambda df, _: state.apply(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def classify_stream(feed: DataFrame) -> DataFrame:
    """:func:`classify` for a stream of writes that arrives in the order of ``seq``, in any order within a micro-batch.

    The state of a document is its last body and the ``seq`` of each write applied, 8 bytes a write; a write given again
    is dropped. One that comes after a later write of its document in an earlier micro-batch can't be classified any more:
    it raises. A micro-batch's writes of one document are held in its task's memory, as Spark gives them in no order.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    columns = ["seq", *KEYS, "kind", "old_doc", "new_doc"]

    def step(key, batches, state: GroupState):
        old, before = state.get if state.exists else (None, b"")
        applied = np.frombuffer(before, np.int64)  # ascending
        writes = pd.concat(list(batches), ignore_index=True).drop_duplicates("seq").sort_values("seq")
        writes = writes[~writes["seq"].isin(applied)]
        if len(applied) and len(writes) and writes["seq"].iloc[0] < applied[-1]:
            raise ValueError(f"write {writes['seq'].iloc[0]} of {key} came after write {applied[-1]}")
        out = []
        for r in writes.itertuples():
            gone = bool(r.gone)
            if not gone or old is not None:
                out.append((r.seq, *key, "retract" if gone else "assert" if old is None else "change", old, None if gone else r.body))
            old = None if gone else r.body
            if len(out) == ROWS_OUT:
                yield pd.DataFrame(out, columns=columns)
                out = []
        yield pd.DataFrame(out, columns=columns)
        state.update((old, np.concatenate([applied, writes["seq"].to_numpy(np.int64)]).tobytes()))

    gone = F.coalesce("deleted", F.lit(False)).alias("gone")
    rows = feed.where("seq is not null and entity_id is not null and doc_id is not null").select("seq", *KEYS, gone, F.coalesce("body", F.lit("")).alias("body"))
    return rows.groupBy(*KEYS).applyInPandasWithState(step, "seq bigint, entity_id string, doc_id string, kind string, old_doc string, new_doc string", "old string, applied binary", "append", GroupStateTimeout.NoTimeout)


def session_stream(events: DataFrame, keys: list[str], at: str, gap: str, late: str) -> DataFrame:
    """Sessions of a stream by Spark's session windows; one is put out when the watermark has passed its end."""
    return events.withWatermark(at, late).groupBy(*keys, F.session_window(at, gap)).agg(F.count(F.lit(1)).alias("n"))
