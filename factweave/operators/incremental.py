"""Runs that process only new or changed records.

A source is a set of partitions. Its fingerprint has, per partition, the number of rows and two additive row hashes, so
it combines before the shuffle and doesn't depend on the order of rows. The result of a partition, the newest state in it
of each document, is kept as the partition of the same name of the folder ``newest``, with the fingerprint it was made
from. A run recomputes only the partitions whose fingerprint isn't that of their result, and replaces each as a whole by a
dynamic overwrite. What it then takes in comes from the results of the partitions that differ from the last successful
run. A run counts only once its marker is renamed into place. One that dies before leaves results that are right for their
fingerprint, and rows that no one sees; doing it again, or the next run, takes in what it would have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.plans.shared import SharedFiles

LOWEST = -(2**63)
NEWEST = "entity_id string, doc_id string, c bigint, v bigint, fingerprint string, part string"
TAKEN = "run_no bigint, entity_id string, doc_id string, created_at_ns bigint, doc_version bigint"


def fingerprints(source: DataFrame, partition: str) -> DataFrame:
    """``partition, rows, low, high`` per partition. Sums of 32-bit halves of the row hashes can't overflow.

    xxhash64 skips NULLs, so where a row has them is hashed as well.
    """
    columns = sorted(source.columns)
    h = F.xxhash64(*[F.col(c) for c in columns], *[F.col(c).isNull() for c in columns])
    lanes = source.select(F.col(partition).cast("string").alias("partition"), (h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("a"), F.shiftrightunsigned(h, 32).alias("b"))
    return lanes.groupBy("partition").agg(F.count(F.lit(1)).alias("rows"), F.sum("a").alias("low"), F.sum("b").alias("high"))


class Consumer:
    """A consumer of document metadata below ``root``, a folder all executors share; one run at a time.

    Of two states of a document the newer has the greater ``created_at_ns``, then the greater ``doc_version``; NULL comes
    before every number. Rows without a tenant or a document are left out.
    """

    def __init__(self, spark: SparkSession, root: str, partition: str = "delivery_no"):
        self.spark, self.root, self.partition, self.files = spark, root, partition, SharedFiles(spark)

    def _committed(self) -> dict:
        return self.files.read_json(f"{self.root}/COMMITTED") or {"runs": [], "fingerprints": {}}

    def taken(self) -> DataFrame:
        """What the successful runs took in, as ``run_no, entity_id, doc_id, created_at_ns, doc_version``."""
        runs = self._committed()["runs"]
        if not runs or not self.files.exists(f"{self.root}/taken"):
            return self.spark.createDataFrame([], TAKEN)
        return self.spark.read.schema(TAKEN).parquet(f"{self.root}/taken").where(F.col("run_no").isin(runs))

    def _results(self) -> DataFrame:
        return self.spark.read.schema(NEWEST).parquet(f"{self.root}/newest") if self.files.exists(f"{self.root}/newest") else self.spark.createDataFrame([], NEWEST)

    def recompute(self, source: DataFrame, now: dict[str, str]) -> list[str]:
        """Brings the results of the partitions in ``now`` (fingerprint by partition) up to date; the partitions replaced.

        Each result has one row that names no document, so that an empty one has its fingerprint as well.
        """
        have = {r.part: r.fingerprint for r in self._results().where("entity_id is null").select("part", "fingerprint").collect()}
        stale = [p for p, f in now.items() if have.get(p) != f]
        if stale:
            created, version = F.coalesce("created_at_ns", F.lit(LOWEST)), F.coalesce("doc_version", F.lit(LOWEST))
            rows = source.where(F.col(self.partition).isin([self._typed(source, p) for p in stale]) & F.col("entity_id").isNotNull() & F.col("doc_id").isNotNull())
            part = F.col(self.partition).cast("string").alias("part")
            newest = rows.groupBy("entity_id", "doc_id", part).agg(F.max(F.struct(created.alias("c"), version.alias("v"))).alias("s")).select("entity_id", "doc_id", "s.c", "s.v", "part")
            pairs = [(p, now[p]) for p in stale]
            if len(pairs) <= 1000:
                made_from = self.spark.range(1).select(F.explode(F.create_map(*[F.lit(x) for pair in pairs for x in pair])).alias("part", "fingerprint"))
            else:
                made_from = self.spark.createDataFrame(pairs, "part string, fingerprint string")
            marks = made_from.select(*[F.lit(None).cast(t).alias(c) for c, t in (("entity_id", "string"), ("doc_id", "string"), ("c", "bigint"), ("v", "bigint"))], "fingerprint", "part")
            out = newest.join(F.broadcast(made_from) if len(pairs) <= 10_000 else made_from, "part").unionByName(marks)
            out.select("entity_id", "doc_id", "c", "v", "fingerprint", "part").hint("rebalance", "part").write.partitionBy("part").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.root}/newest")
        return stale

    def run(self, run_no: int, source: DataFrame, fail_before_commit: bool = False) -> list[str]:
        """Takes in the newest state of each document that is newer than all that earlier successful runs took in.

        source: ``entity_id, doc_id, created_at_ns, doc_version`` and the partition column; the rows the run sees. A row
        added to a partition seen before makes it a changed partition. To the driver goes one fingerprint a partition, as
        the list of its files would. ``fail_before_commit`` is for tests and for running what is known to have failed. The
        partitions recomputed are returned.
        """
        done = self._committed()
        if run_no in done["runs"]:
            raise ValueError(f"run {run_no} has already succeeded")
        now = {r.partition: f"{r.rows},{r.low},{r.high}" for r in fingerprints(source, self.partition).collect() if r.partition is not None}
        replaced = self.recompute(source, now)
        changed = [p for p, f in now.items() if done["fingerprints"].get(p) != f]
        self.files.delete(f"{self.root}/taken/run_no={run_no}")  # what an attempt that failed has left
        if changed:
            rows = self._results().where(F.col("part").isin(changed) & F.col("entity_id").isNotNull())
            now_ = rows.select("entity_id", "doc_id", F.struct("c", "v").alias("now"), F.lit(None).cast("struct<c:bigint,v:bigint>").alias("old"))
            old = self.taken().select("entity_id", "doc_id", F.lit(None).cast("struct<c:bigint,v:bigint>").alias("now"), F.struct(F.col("created_at_ns").alias("c"), F.col("doc_version").alias("v")).alias("old"))
            both = now_.unionByName(old).groupBy("entity_id", "doc_id").agg(F.max("now").alias("now"), F.max("old").alias("old"))
            new = both.where("now is not null and (old is null or now > old)")
            new.select("entity_id", "doc_id", F.col("now.c").alias("created_at_ns"), F.col("now.v").alias("doc_version")).write.parquet(f"{self.root}/taken/run_no={run_no}")
        if fail_before_commit:
            raise RuntimeError("the run failed before its commit")
        self.files.publish_json(f"{self.root}/COMMITTED", {"runs": [*done["runs"], run_no], "fingerprints": done["fingerprints"] | now})
        return replaced

    def _typed(self, source: DataFrame, value: str):
        kind = dict(source.dtypes)[self.partition]
        return int(value) if kind in ("int", "bigint", "smallint", "tinyint") else value
