"""History of changing documents in insert-only satellites.

The top-level attributes of the bodies are split by change rate into satellites. A version appends to a satellite, with the
attributes that are in it, only if the hash of that part differs from the last one the satellite has of the document;
nothing is ever updated. Ends of validity aren't stored: views find them as the beginning of the next row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions.bodies import satellites_udf
from factweave.plans import skew
from factweave.plans.shared import SharedFiles

KEYS = ["entity_id", "doc_id"]
#: Values per document from which on an attribute is in the fast (0), the medium (1) or else the slow satellite (2).
RATES = (2.0, 1.2)
#: Names of attributes taken to the driver, those that change most; any others are in the slow satellite.
MAX_ATTRIBUTES = 10_000


def change_rates(versions: DataFrame) -> DataFrame:
    """``attribute, rate``: distinct values per document that has the attribute, over all versions (HyperLogLog++).

    Both counts combine before the shuffle, so what moves is one sketch per attribute and task. Values are compared as they
    are written; only where an attribute is kept depends on it.
    """
    live = versions.where("body is not null and not coalesce(deleted, false)")
    each = live.select(F.xxhash64(*KEYS).alias("doc"), F.explode(F.from_json("body", "map<string,string>")).alias("attribute", "value"))
    return each.groupBy("attribute").agg((F.approx_count_distinct(F.xxhash64("doc", "value"), 0.02) / F.approx_count_distinct("doc", 0.02)).alias("rate"))


def satellite_of(versions: DataFrame) -> dict[str, int]:
    """Satellite number by attribute name. It decides where a change is kept, never whether it is one."""
    top = change_rates(versions).orderBy(F.desc("rate"), "attribute").limit(MAX_ATTRIBUTES).collect()
    return {r.attribute: next((i for i, least in enumerate(RATES) if r.rate >= least), len(RATES)) for r in top if r.attribute}


SATELLITES = len(RATES) + 2
ROW = "entity_id string, doc_id string, at_ns bigint, seq bigint, live boolean, hash bigint, attributes string, first boolean, satellite int"
LAST = "entity_id string, doc_id string, at_ns bigint, seq bigint, n bigint"


class Satellites:
    """The satellites below ``root``, a folder all executors share; one writer at a time, any readers.

    Satellites 0 to 2 are the fast, medium and slow attributes, 3 what is no JSON object. A row has the part of the document
    that is in the satellite as JSON (behind ``J`` or ``T``: JSON that is no object, a text), or says with ``live`` false that
    the document was deleted. ``first`` marks one row of each version that appended any.
    """

    def __init__(self, spark: SparkSession, root: str, rows_per_chunk: int = skew.ROWS_PER_CHUNK):
        self.spark, self.root, self.rows_per_chunk, self.files = spark, root, rows_per_chunk, SharedFiles(spark)

    def _loads(self) -> dict:
        return self.files.read_json(f"{self.root}/LOADS") or {"loads": [], "assignment": None, "most": 0}

    def _read(self, ddl: str, kind: str) -> DataFrame:
        empty = self.spark.createDataFrame([], ddl)
        paths = [f"{self.root}/{kind}/load={load}" for load in self._loads()["loads"]]
        return self.spark.read.schema(ddl).option("basePath", f"{self.root}/{kind}").parquet(*paths).select(*empty.columns) if paths else empty

    def rows(self) -> DataFrame:
        """All appended rows."""
        return self._read(ROW, "rows")

    def load(self, versions: DataFrame) -> None:
        """Appends what ``versions`` change; a load that fails leaves nothing that readers see.

        versions: ``seq, entity_id, doc_id, at_ns, deleted, body``; other columns are ignored. Rows with NULL in ``at_ns``,
        ``entity_id``, ``doc_id`` or ``seq`` count for nothing; rows of one ``seq`` are one version; of equal instants the
        greatest ``seq`` holds. NULL ``deleted`` means false. A live version without a body is a state of its own. A version
        that changes nothing has no row. The version loaded last of a document may come again. Others must be of later
        instants than it: one that isn't fails the load, as rows behind it may have been left out for being equal.
        Documents with more than ``rows_per_chunk`` rows are split over tasks.
        """
        done = self._loads()
        versions = versions.where("at_ns is not null and entity_id is not null and doc_id is not null and seq is not null").select("seq", *KEYS, "at_ns", "deleted", "body")
        assignment = satellite_of(versions) if done["assignment"] is None else done["assignment"]
        n = SATELLITES - 1
        alive = ~F.coalesce("deleted", F.lit(False))
        lean = versions.select(*KEYS, "at_ns", "seq", alive.alias("live"), F.when(alive, F.col("body")).alias("body"))
        rows = lean.mapInArrow(satellites_udf("body", assignment, n), "entity_id string, doc_id string, at_ns bigint, seq bigint, live boolean, state array<bigint>, parts array<string>")
        rows = rows.withColumn("stored", F.lit(False))
        if done["loads"]:
            rows = self._after(rows)
        load = uuid.uuid4().hex
        last = versions.groupBy(*KEYS).agg(F.max(F.struct("at_ns", "seq")).alias("m"), F.count(F.lit(1)).alias("n"))
        last.select(*KEYS, "m.at_ns", "m.seq", "n").write.parquet(f"{self.root}/last/load={load}")
        sizes = self.spark.read.schema(LAST).parquet(f"{self.root}/last/load={load}").select(*KEYS, F.col("n").alias("__n"))
        points, _, most = skew.split_points(versions, KEYS, "at_ns", self.rows_per_chunk, sizes)
        split = points is not None
        rows = skew.with_chunk(rows, KEYS, "at_ns", points)
        if not split:
            rows = rows.withColumn(skew.SPLIT, F.lit(None).cast("int"))
        # The last row of an instant holds; equal instants of a key are always in one chunk.
        rows = skew.neighbour(rows, KEYS, ["at_ns", "seq"], F.col("at_ns"), "next_at", True, False)
        held = rows.where("next_at is null or next_at <> at_ns").drop("next_at")
        held = skew.neighbour(held, KEYS, ["at_ns"], F.struct("live", "state"), "before", False, split)
        was = F.coalesce(F.col("before.live"), F.lit(False))
        differs = [(F.col("live") != was) | (F.col("live") & (F.col("state")[i] != F.coalesce(F.col("before.state")[i], F.lit(0)))) for i in range(SATELLITES)]
        added = F.filter(F.array(*[F.when(d, F.struct(F.lit(i).alias("satellite"), F.col("state")[i].alias("hash"), F.col("parts")[i].alias("attributes"))) for i, d in enumerate(differs)]), lambda x: x.isNotNull())
        appended = held.where("not stored").select(*KEYS, "at_ns", "seq", "live", F.posexplode(added).alias("place", "a"))
        appended = appended.select(*KEYS, "at_ns", "seq", "live", F.when(F.col("live"), F.col("a.hash")).alias("hash"), F.when(F.col("live"), F.col("a.attributes")).alias("attributes"), (F.col("place") == 0).alias("first"), "a.satellite")
        appended.write.partitionBy("satellite").parquet(f"{self.root}/rows/load={load}")
        self.files.publish_json(f"{self.root}/LOADS", {"loads": [*done["loads"], load], "assignment": assignment, "most": done["most"] + most})

    def _after(self, rows: DataFrame) -> DataFrame:
        """The rows after those loaded, and, as ``stored``, what the satellites have last of their documents."""
        touched = rows.select(*KEYS).distinct()
        last = self._read(LAST, "last").groupBy(*KEYS).agg(F.max(F.struct("at_ns", "seq")).alias("last"))
        late = (F.col("at_ns") <= F.col("last.at_ns")) & (F.struct("at_ns", "seq") != F.col("last"))
        text = F.concat(F.lit("a version of "), "doc_id", F.lit(" isn't later than the one loaded last"))
        new = rows.join(last, KEYS, "left").where(F.col("last").isNull() | F.when(late, F.raise_error(text).cast("boolean")).otherwise(F.col("at_ns") > F.col("last.at_ns"))).drop("last")
        kept = self.rows().join(touched, KEYS, "left_semi").groupBy(*KEYS, "satellite").agg(F.max_by(F.struct("at_ns", "seq", "live", "hash"), F.struct("at_ns", "seq")).alias("k"))
        empty = F.array(*[F.lit(0).cast("bigint")] * SATELLITES)
        of = F.map_from_entries(F.collect_list(F.struct("satellite", F.coalesce("k.hash", F.lit(0)))))  # one entry a satellite
        state = kept.groupBy(*KEYS).agg(F.max("k.at_ns").alias("at_ns"), F.max("k.seq").alias("seq"), F.max_by("k.live", F.struct("k.at_ns", "k.seq")).alias("live"), of.alias("of"))
        state = state.withColumn("state", F.transform(F.sequence(F.lit(0), F.lit(SATELLITES - 1)), lambda i: F.coalesce(F.try_element_at("of", i), empty[i]))).drop("of")
        return new.unionByName(state.withColumn("parts", F.lit(None).cast("array<string>")).withColumn("stored", F.lit(True)).select(*new.columns))

    def history(self) -> DataFrame:
        """The lead-based view over all satellites: ``entity_id, doc_id, valid_from_ns, valid_to_ns, seq``.

        One row per longest unbroken period in which a document existed in one state; ``valid_to_ns`` is -1 while it
        holds.
        """
        return self._view(self.rows().where("first"))

    def view(self, satellite: int) -> DataFrame:
        """The lead-based view of one satellite, with ``attributes``: the periods in which its part of a document stayed as it was."""
        return self._view(self.rows().where(F.col("satellite") == satellite), "attributes")

    def _view(self, rows: DataFrame, *more: str) -> DataFrame:
        rows = rows.select(*KEYS, "at_ns", "seq", "live", *more)
        points = None
        if self._loads()["most"] > self.rows_per_chunk:  # a document may have had so many versions
            points, _, _ = skew.split_points(rows, KEYS, "at_ns", self.rows_per_chunk)
        rows = skew.with_chunk(rows, KEYS, "at_ns", points)
        rows = skew.neighbour(rows, KEYS, ["at_ns"], F.col("at_ns"), "end", True, points is not None)
        return rows.where("live").select(*KEYS, F.col("at_ns").alias("valid_from_ns"), F.coalesce("end", F.lit(-1)).alias("valid_to_ns"), "seq", *more)


def document_history(versions: DataFrame, root: str, rows_per_chunk: int = skew.ROWS_PER_CHUNK) -> DataFrame:
    """:meth:`Satellites.history` after one load of ``versions`` into new satellites below ``root``."""
    satellites = Satellites(versions.sparkSession, root, rows_per_chunk)
    satellites.load(versions)
    return satellites.history()
