"""Sessions of activity by a sweep line over event deltas.

Every stretch of activity puts +1 at its first instant and -1 at its last plus the gap. Where the running sum of a key comes
back to zero, a session closes. Entries of a key within one bucket of time as wide as the gap are always of one session, so
each bucket is one stretch: its ends and its number of entries are aggregated before the sweep. Rows are shuffled once, by key
and bucket, so a hot key is as many tasks as it has buckets; only stretches, of which a key has at most (time span / gap)
however many rows it has, are shuffled by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAP_NS = 1_800_000_000_000


def _close(deltas: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Session numbers for rows ``ts, delta, weight``: how often the running sum was zero before the row."""
    w = Window.partitionBy(*keys).orderBy("ts", F.desc("delta"))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    swept = deltas.withColumn("open", F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return swept.withColumn("no", F.coalesce(F.sum((F.col("open") == 0).cast("long")).over(before), F.lit(0)))


def sessions(entries: DataFrame, keys: Sequence[str], at: str, identity: str, gap_ns: int = GAP_NS) -> DataFrame:
    """Sessions as ``*keys, start_ns, end_ns, duration_ns, n_entries``.

    entries: rows with the keys, an instant ``at`` (BIGINT) and an ``identity``; rows of one identity (repeated
    deliveries) have one key and instant and count once. An entry more than ``gap_ns`` after the one before opens a new
    session; one exactly ``gap_ns`` after doesn't. Rows with NULL in a key, the instant or the identity are no entries, nor are instants within ``gap_ns`` of the end of BIGINT. An
    empty table gives no sessions; other columns are ignored, whatever their names.
    """
    keys = list(keys)
    names = [f"k{i}" for i in range(len(keys))]
    rows = entries.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(at).alias("t"), F.col(identity).alias("id")).where(" and ".join(f"{c} is not null" for c in [*names, "t", "id"])).where(F.col("t") <= 2**63 - 1 - gap_ns)
    width = max(1, gap_ns)
    bucket = F.expr(f"t div {width}L - case when t < 0 and t % {width}L <> 0 then 1 else 0 end")
    rows = rows.withColumn("bucket", bucket).repartition(*names, "bucket")
    once = rows.groupBy(*names, "bucket", "id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    stretches = once.groupBy(*names, "bucket").agg(F.min("lo").alias("lo"), (F.max("hi") + gap_ns).alias("hi"), F.count(F.lit(1)).alias("n"))
    deltas = stretches.select(
        *names, F.inline(F.array(
            F.struct(F.col("lo").alias("ts"), F.lit(1).alias("delta"), F.col("n").alias("weight")),
            F.struct(F.col("hi").alias("ts"), F.lit(-1).alias("delta"), F.lit(0).cast("long").alias("weight")),
        )))
    out = _close(deltas, names).groupBy(*names, "no").agg(F.min("ts").alias("start_ns"), (F.max("ts") - gap_ns).alias("end_ns"), F.sum("weight").alias("n_entries"))
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "start_ns", "end_ns", (F.col("end_ns") - F.col("start_ns")).alias("duration_ns"), "n_entries")
