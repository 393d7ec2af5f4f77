"""A feed of inserts, updates and deletes applied in per-bucket embedded DuckDB.

Each input task first upserts its own rows, so that a document with many changes leaves a task as one row. Those rows go
to hash buckets, where the upsert runs again together with the bucket's rows already published. An upsert replaces a
stored row only if its sequence is greater; deletes are kept as tombstones, so that a late older change can't bring a
document back. The buckets that got changes are exported to a new generation; the others stay where they are. A manifest
says in which generation each bucket is, and renaming it into place publishes all buckets at once.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.plans.shared import SharedFiles

ROWS_PER_BUCKET = 400_000
#: What an embedded DuckDB may hold, in MB. Beyond that it spills to the shared folder, if that is one of the file system;
#: elsewhere its task fails, so there buckets must be small enough.
MEMORY_MB = 512
#: The kinds of the event feed and, behind a prefix, of the operation log.
KINDS = ("assert", "change", "retract")
OP_PREFIX = "op_kind_doc_"
LOWEST = -(2**63)


def document_changes(feed: DataFrame, payload: Sequence[str] = ("new_doc",)) -> DataFrame:
    """Asserts, changes and retracts of documents, as ``entity_id, doc_id, at_ns, seq, live, *payload``.

    Kinds count in either spelling and any case. Rows without a tenant or document, or of another or no kind, are left
    out. NULL in ``at_unix_nanos`` or ``seq`` comes before every number.
    """
    kind = F.regexp_replace(F.lower(F.trim("kind")), f"^{OP_PREFIX}", "")
    return feed.where(kind.isin(*KINDS) & F.col("entity_id").isNotNull() & F.col("doc_id").isNotNull()).select(
        "entity_id", "doc_id", F.coalesce("at_unix_nanos", F.lit(LOWEST)).alias("at_ns"), F.coalesce("seq", F.lit(LOWEST)).alias("seq"),
        (kind != "retract").alias("live"), *[F.when(kind != "retract", F.col(c)).alias(f"p_{c}") for c in payload])


def upsert_udf(payload: Sequence[str], spill: str | None = None):
    """For ``mapInArrow``: the row with the greatest (at_ns, seq) of each document among the task's rows, tombstones too.

    spill: a folder that all executors share, for what doesn't fit in memory.
    """
    extra = [f"p_{c}" for c in payload]
    columns = ["entity_id", "doc_id", "at_ns", "seq", "live", *extra]
    named = ", ".join(columns)
    create = "create table current (entity_id varchar, doc_id varchar, at_ns bigint, seq bigint, live boolean" + "".join(f", {c} varchar" for c in extra) + ", primary key (entity_id, doc_id))"
    insert = f"""insert into current
        select {named} from batch qualify row_number() over (partition by entity_id, doc_id order by at_ns desc, seq desc) = 1
        on conflict (entity_id, doc_id) do update set {", ".join(f"{c} = excluded.{c}" for c in columns[2:])}
        where excluded.at_ns > current.at_ns or (excluded.at_ns = current.at_ns and excluded.seq > current.seq)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = None
        try:
            for b in batches:
                if not b.num_rows:
                    continue
                if con is None:
                    folder = {"temp_directory": f"{spill}/{uuid.uuid4().hex}"} if spill else {"max_temp_directory_size": "0B"}
                    con = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY_MB}MB", "preserve_insertion_order": False, **folder})
                    con.execute(create)
                con.register("batch", pa.Table.from_batches([b]))
                con.execute(insert)
                con.unregister("batch")
            if con is not None:
                out = con.sql(f"select {named} from current").to_arrow_table()
                schema = pa.schema([("entity_id", pa.string()), ("doc_id", pa.string()), ("at_ns", pa.int64()), ("seq", pa.int64()), ("live", pa.bool_()), *[(c, pa.string()) for c in extra]])
                yield from out.cast(schema).to_batches(max_chunksize=20_000)
        finally:
            if con is not None:
                con.close()

    return run


class CurrentState:
    """The current documents below ``root``, a folder all executors share; one writer at a time, any readers."""

    def __init__(self, spark: SparkSession, root: str, payload: Sequence[str] = ("new_doc",)):
        self.spark, self.root, self.payload, self.files = spark, root, tuple(payload), SharedFiles(spark)
        self.ddl = "entity_id string, doc_id string, at_ns bigint, seq bigint, live boolean" + "".join(f", p_{c} string" for c in payload)

    def manifest(self) -> dict | None:
        """``buckets``, ``parts`` (the folder of each bucket that has rows), ``rows`` and what was published with them; None at first."""
        return self.files.read_json(f"{self.root}/CURRENT")

    def _read(self, parts: Iterable[str]) -> DataFrame:
        parts = [f"{self.root}/{p}" for p in parts]
        return self.spark.read.schema(self.ddl).parquet(*parts) if parts else self.spark.createDataFrame([], self.ddl)

    def rows(self) -> DataFrame | None:
        """The published rows with their tombstones; None before the first publication."""
        m = self.manifest()
        return self._read(m["parts"].values()) if m else None

    def documents(self) -> DataFrame:
        """``entity_id, doc_id, seq, at_unix_nanos, *payload`` of the documents that exist."""
        rows = self.rows()
        rows = self.spark.createDataFrame([], self.ddl) if rows is None else rows
        at = F.when(F.col("at_ns") != LOWEST, F.col("at_ns"))
        return rows.where("live").select("entity_id", "doc_id", F.when(F.col("seq") != LOWEST, F.col("seq")).alias("seq"), at.alias("at_unix_nanos"), *[F.col(f"p_{c}").alias(c) for c in self.payload])

    def apply(self, feed: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET, publish: dict | None = None) -> None:
        """Applies the changes of ``feed``, whatever their order and number; the same feed again changes nothing.

        Columns of ``feed`` beside those of :func:`document_changes` are ignored. Only buckets with changes are read and
        written; where their rows have come to twice ``rows_per_bucket``, all are dealt out anew to more. If the job fails at
        any point, what was published before stays current. ``publish`` is put into the manifest.
        """
        root = self.root.removeprefix("file://") if self.root.startswith(("file:", "/")) else None
        upsert = upsert_udf(self.payload, root and f"{root}/spill")
        local = document_changes(feed, self.payload).mapInArrow(upsert, self.ddl)
        arrived, before = feed.count(), self.manifest() or {"buckets": 0, "parts": {}, "rows": 0}
        buckets, rows = before["buckets"], before["rows"] + arrived
        anew = rows > 2 * rows_per_bucket * buckets
        if anew:
            buckets = max(self.spark.sparkContext.defaultParallelism, math.ceil(rows / rows_per_bucket))
        bucket = F.pmod(F.xxhash64("entity_id", "doc_id"), F.lit(buckets)).cast("int")
        if anew or arrived >= 4 * buckets:  # then there are changes for about every bucket
            changed = set(before["parts"])
        else:
            changed = {str(r[0]) for r in local.select(bucket).distinct().collect()}
        stored = [p for b, p in before["parts"].items() if b in changed]
        merged = (local.unionByName(self._read(stored)) if stored else local).withColumn("bucket", bucket)
        generation = f"generation-{uuid.uuid4().hex}"
        apart = merged.repartitionById(buckets, "bucket").drop("bucket").mapInArrow(upsert, self.ddl)
        apart.withColumn("bucket", bucket).write.partitionBy("bucket").parquet(f"{self.root}/{generation}")
        new = {b: f"{generation}/bucket={b}" for b in self.files.children(f"{self.root}/{generation}", "bucket=")}
        parts = {b: p for b, p in before["parts"].items() if b not in changed} | new
        kept = before["rows"] if not stored else before["rows"] - self._read(stored).count()
        gone = [p for b, p in before["parts"].items() if parts.get(b) != p]
        state = {"buckets": buckets, "parts": parts, "rows": kept + (self._read(new.values()).count() if new else 0), "gone": gone}
        self.files.publish_json(f"{self.root}/CURRENT", state | {"with": publish if publish is not None else before.get("with", {})})
        for part in before.get("gone", []):  # who still reads what was current until now can go on
            self.files.delete(f"{self.root}/{part}")
