"""Attributes as known at event time: as-of joins in per-bucket embedded DuckDB.

Events and versions are hash-partitioned by key into buckets; each bucket is one embedded DuckDB that resolves ties of
equal instants to the greatest sequence and runs one ASOF LEFT JOIN. A key with too many events is split by time; each
split gets, beside its own versions, the last version before it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.plans import skew

KEYS = ["entity_id", "doc_id"]
ROWS_PER_BUCKET = 250_000

_JOIN = """
    with v as (
        select entity_id, doc_id, at_ns, max(seq) as seq, arg_max(live, seq) as live
        from rows where id is null group by entity_id, doc_id, at_ns
    ), e as (select distinct entity_id, doc_id, at_ns, id from rows where id is not null)
    select e.id, e.at_ns as event_ns, v.seq, v.at_ns as version_ns, v.live
    from e asof left join v on e.entity_id = v.entity_id and e.doc_id = v.doc_id and e.at_ns >= v.at_ns
"""


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import duckdb

    held = list(batches)
    if not held:
        return
    con = duckdb.connect(config={"threads": 1})
    try:
        con.register("rows", pa.Table.from_batches(held))
        out = con.sql(_JOIN).to_arrow_table()
    finally:
        con.close()
    yield from out.cast(pa.schema([("id", pa.int64()), ("event_ns", pa.int64()), ("seq", pa.int64()), ("version_ns", pa.int64()), ("live", pa.bool_())])).to_batches(max_chunksize=50_000)


def asof_join(events: DataFrame, versions: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``id, event_ns, seq, version_ns, live`` for each distinct event; ``seq`` is NULL where no version is in force.

    events: ``id, entity_id, doc_id, at_ns``. versions: ``seq, entity_id, doc_id, at_ns, live``. Other columns are
    ignored. A version is in force from its ``at_ns`` on, the instant itself included; of equal instants the greatest
    ``seq``. Events with NULL in ``id``, a key or the instant are left out, as are versions with NULL in a key, the
    instant or ``seq``. ``rows_per_bucket`` bounds what a task holds, for hot keys as well.
    """
    e = events.select(F.col("id").cast("bigint").alias("id"), *KEYS, "at_ns").where("id is not null and entity_id is not null and doc_id is not null and at_ns is not null")
    v = versions.select("seq", *KEYS, "at_ns", "live").where("seq is not null and entity_id is not null and doc_id is not null and at_ns is not null")
    both = e.select(*KEYS, "at_ns").unionByName(v.select(*KEYS, "at_ns"))
    points, total, _ = skew.split_points(both, KEYS, "at_ns", rows_per_bucket)
    rows = e.withColumn("seq", F.lit(None).cast("bigint")).withColumn("live", F.lit(None).cast("boolean")).unionByName(v.withColumn("id", F.lit(None).cast("bigint")))
    rows = skew.with_chunk(rows, KEYS, "at_ns", points)
    columns = ["id", *KEYS, "at_ns", "seq", "live", skew.CHUNK]
    if points is not None:
        # The last version of each chunk also enters the later chunks up to the next one that has versions of its own.
        last = rows.where(f"id is null and {skew.SPLIT} is not null").groupBy(*KEYS, skew.CHUNK).agg(F.max(F.struct("at_ns", "seq", "live")).alias("m"), F.first(skew.SPLIT).alias(skew.SPLIT))
        following = F.lead(skew.CHUNK, 1).over(Window.partitionBy(*KEYS).orderBy(skew.CHUNK))
        carried = last.withColumn("upto", F.coalesce(following, F.col(skew.SPLIT))).where(F.col("upto") > F.col(skew.CHUNK))
        carried = carried.withColumn(skew.CHUNK, F.explode(F.sequence(F.col(skew.CHUNK) + 1, F.col("upto"))))
        carried = carried.select(F.lit(None).cast("bigint").alias("id"), *KEYS, "m.at_ns", "m.seq", "m.live", skew.CHUNK)
        rows = rows.select(*columns).unionByName(carried)
    buckets = max(1, math.ceil(total / rows_per_bucket))
    spread = rows.select(*columns).repartition(max(buckets, _cores(rows)), *KEYS, skew.CHUNK).drop(skew.CHUNK)
    return spread.mapInArrow(_bucket, "id bigint, event_ns bigint, seq bigint, version_ns bigint, live boolean")


def _cores(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism
