"""Ordered events of items: windows, clusters, sequences, last seen, grouped counts.

Events are ``entity_id, item_id, doc_id, type, at_ns`` with other columns ignored; of equal instants the lower ``doc_id`` is
first.
"""

from __future__ import annotations

import itertools
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.json import instant_of, parsed, scalars, text_of, top
from factweave.plans import skew
from factweave.plans.shared import cut

ITEM = ["entity_id", "item_id"]


def window_query(events: DataFrame, entity_id: str, item_id: str, types: Sequence[str] = ()) -> DataFrame:
    """The events of one tenant's item of the types (none: all) in order of time."""
    rows = events.where((F.col("entity_id") == entity_id) & (F.col("item_id") == item_id))
    rows = rows.where(F.col("type").isin(list(types))) if types else rows
    return rows.orderBy("at_ns", "doc_id")


def last_seen(events: DataFrame) -> DataFrame:
    """``entity_id, item_id, type, last_ns``: the latest instant of each item and type."""
    return events.where("item_id is not null and type is not null and at_ns is not null").groupBy(*ITEM, "type").agg(F.max("at_ns").alias("last_ns"))


def absent_since(events: DataFrame, type_: str, since_ns: int) -> DataFrame:
    """``entity_id, item_id, last_ns`` of the items that had an event of the type, but none from ``since_ns`` on."""
    return last_seen(events).where((F.col("type") == type_) & (F.col("last_ns") < since_ns)).select(*ITEM, "last_ns")


def _rows(events: DataFrame, types: Sequence[str]) -> DataFrame:
    rows = events.where("entity_id is not null and item_id is not null and at_ns is not null and type is not null")
    rows = rows.where(F.col("type").isin(list(types))) if types else rows
    return rows.select(*ITEM, "at_ns", F.col("doc_id").cast("string").alias("doc_id"), "type")


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64()}
    return pa.schema([(n, kinds[t]) for n, t in (f.split() for f in ddl.split(", "))])


def _by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns])


def _in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while out := list(itertools.islice(rows, 20_000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


CLUSTER = "entity_id string, item_id string, cluster_no bigint, pos bigint, at_ns bigint, doc_id string"
NEVER = -(2**63)


def clusters(events: DataFrame, types: Sequence[str], window_ns: int, min_size: int, rows_per_chunk: int = skew.ROWS_PER_CHUNK) -> DataFrame:
    """``entity_id, item_id, cluster_no, pos, at_ns, doc_id``: greedy clusters that don't overlap, numbered from 1 by item.

    A cluster begins at an event and takes all that follow within ``window_ns`` of it (0 or less: without bound). With
    fewer than ``min_size`` (at least 1) it is dropped and the next event tried; else the event after it.

    Items are streamed in order of time, each event looked at once. An item with more than ``rows_per_chunk`` events is cut
    into chunks of time: each finds, for every instant up to which a cluster of the chunk before may reach, how far its last
    cluster reaches; these few rows are followed through the item; then each chunk knows where it begins and puts out its own.
    """
    least = max(1, min_size)
    rows = _rows(events, types).drop("type")
    if window_ns <= 0:
        w = Window.partitionBy(*ITEM)
        enough = rows.groupBy(*ITEM).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(*ITEM)
        return rows.join(enough, ITEM, "left_semi").select(*ITEM, F.lit(1).cast("bigint").alias("cluster_no"), F.row_number().over(w.orderBy("at_ns", "doc_id")).cast("bigint").alias("pos"), "at_ns", "doc_id")
    points, _, _ = skew.split_points(rows, ITEM, "at_ns", rows_per_chunk)
    if points is None:
        return _streamed(rows, window_ns, least)
    rows = skew.with_chunk(rows, ITEM, "at_ns", points)
    whole = _streamed(rows.where(F.col(skew.SPLIT).isNull()).select(*ITEM, "at_ns", "doc_id"), window_ns, least)
    return whole.unionByName(_in_chunks(rows.where(F.col(skew.SPLIT).isNotNull()).drop(skew.SPLIT), window_ns, least))


def _streamed(rows: DataFrame, window_ns: int, least: int) -> DataFrame:
    def found(batches) -> Iterator[tuple]:
        item, held, number, until, pos = None, deque(), 0, NEVER, 0
        for entity, own, t, d in _by_row(batches):
            if (entity, own) != item:
                item, number, until = (entity, own), 0, NEVER
                held.clear()
            if t <= until:  # of the open cluster
                pos += 1
                yield *item, number, pos, t, d
                continue
            while held and t - held[0][0] > window_ns:
                held.popleft()
            held.append((t, d))
            if len(held) == least:
                number, until, pos = number + 1, held[0][0] + window_ns, least
                yield from ((*item, number, i + 1, t2, d2) for i, (t2, d2) in enumerate(held))
                held.clear()

    return rows.repartition(*ITEM).sortWithinPartitions(*ITEM, "at_ns", "doc_id").mapInArrow(lambda b: _in_batches(found(b), _schema(CLUSTER)), CLUSTER)


def _in_chunks(rows: DataFrame, window_ns: int, least: int) -> DataFrame:
    chunk = [*ITEM, skew.CHUNK]
    kind = lambda df, n: df.withColumn("kind", F.lit(n))
    none = F.lit(None).cast("bigint")
    # The least-1 events after each chunk tell whether a cluster begins at its end.
    heads = rows.withColumn("r", F.row_number().over(Window.partitionBy(*chunk).orderBy("at_ns", "doc_id"))).where(F.col("r") < least)
    heads = heads.withColumn("g", F.row_number().over(Window.partitionBy(*ITEM).orderBy("at_ns", "doc_id")))
    after = heads.groupBy(*chunk).agg(F.min("g").alias("g0")).withColumn("g0", F.lead("g0", 1).over(Window.partitionBy(*ITEM).orderBy(skew.CHUNK)))
    h = heads.select(*[F.col(c).alias(f"h_{c}") for c in ITEM], "at_ns", "g")
    near = [F.col(c) == F.col(f"h_{c}") for c in ITEM] + [F.col("g") >= F.col("g0"), F.col("g") < F.col("g0") + least - 1]
    ahead = after.join(h, near).select(*chunk, "at_ns", F.lit(None).cast("string").alias("doc_id"))
    both = kind(rows.select(*chunk, "at_ns", "doc_id"), 1).unionByName(kind(ahead, 2))

    def arrays(batches) -> Iterator[tuple]:
        """(chunk key, instants and documents of kind 1, instants of kind 2, row of kind 0) chunk after chunk."""
        for key, group in itertools.groupby(_by_row(batches), lambda r: r[:3]):
            parts: list[list] = [[], [], []]
            for r in group:
                parts[r[5]].append(r)
            yield key, [r[3] for r in parts[1]], [r[4] for r in parts[1]], [r[3] for r in parts[2]], parts[0]

    def starts(at: list[int], ahead_: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(whether a cluster begins at each event if none holds it, the first event after it)."""
        own, known = np.array(at, np.int64), np.array(at + ahead_, np.int64)
        last = np.arange(len(own)) + least - 1
        begins = np.zeros(len(own), bool)
        inside = last < len(known)
        begins[inside] = known[last[inside]] - own[inside] <= window_ns
        return begins, np.searchsorted(own, own + window_ns, "right")

    def reach(batches) -> Iterator[tuple]:
        """Rows ``upto, until, clusters, tail, n``: entered before ``upto``, the chunk ends with a cluster that reaches ``until``."""
        for key, at, _, ahead_, _ in arrays(batches):
            begins, after_ = (x.tolist() for x in starts(at, ahead_))
            n = len(at)
            until, count, tail = [NEVER] * (n + 1), [0] * (n + 1), [0] * (n + 1)
            for i in range(n - 1, -1, -1):
                j = after_[i] if begins[i] else i + 1
                if begins[i] and j == n:
                    until[i], count[i], tail[i] = at[i] + window_ns, 1, n - i
                else:
                    until[i], count[i], tail[i] = until[j], count[j] + begins[i], tail[j]
            before = None
            for i in range(n):
                if i and at[i - 1] - at[0] > window_ns:
                    break  # no cluster of an earlier chunk reaches so far
                if before is not None and (until[i], count[i], tail[i]) != before[1:]:
                    yield *key, before[0], *before[1:], n
                before = (at[i], until[i], count[i], tail[i])
            if before is not None:
                yield *key, before[0], *before[1:], n

    names = "entity_id string, item_id string, __chunk bigint"
    reached_ddl = f"{names}, upto bigint, until bigint, clusters bigint, tail bigint, n bigint"
    columns = [*chunk, "at_ns", "doc_id", "kind"]
    in_order = lambda df: df.select(*ITEM, F.col(skew.CHUNK).cast("bigint").alias(skew.CHUNK), "at_ns", "doc_id", "kind").repartition(*chunk).sortWithinPartitions(*chunk, "kind", "at_ns", "doc_id")
    reached = cut(in_order(both.select(*columns)).mapInArrow(lambda b: _in_batches(reach(b), _schema(reached_ddl)), reached_ddl), "clusters")

    def entries(batches) -> Iterator[tuple]:
        """For each chunk: the instant to which a cluster before it reaches, its number and the events it has so far."""
        item, until, number, held = None, NEVER, 0, 0
        for key, group in itertools.groupby(_by_row(batches), lambda r: r[:3]):
            if key[:2] != item:
                item, until, number, held = key[:2], NEVER, 0, 0
            yield *key, until, number, held
            chosen = None
            for _, _, _, upto, until_, count, tail, n in group:
                if chosen is None and upto > until:
                    chosen = (until_, count, tail)
                size = n
            if chosen is None:
                held += size  # all of the chunk belongs to the open cluster
            else:
                until, number, held = chosen[0], number + chosen[1], chosen[2]

    entry_ddl = f"{names}, until bigint, number bigint, held bigint"
    entered = reached.repartition(*ITEM).sortWithinPartitions(*chunk, "upto").mapInArrow(lambda b: _in_batches(entries(b), _schema(entry_ddl)), entry_ddl)
    entered = entered.select(*chunk, F.col("until").alias("at_ns"), F.concat_ws(",", "number", "held").alias("doc_id"), F.lit(0).alias("kind"))

    def found(batches) -> Iterator[tuple]:
        for (entity, item, _), at, docs, ahead_, entry in arrays(batches):
            if not at:
                continue
            until, (number, held) = entry[0][3], map(int, entry[0][4].split(","))
            begins, after_ = (x.tolist() for x in starts(at, ahead_))
            i = int(np.searchsorted(np.array(at, np.int64), until, "right"))
            yield from ((entity, item, number, held + j + 1, at[j], docs[j]) for j in range(i))
            while i < len(at):
                if begins[i]:
                    number += 1
                    yield from ((entity, item, number, j - i + 1, at[j], docs[j]) for j in range(i, after_[i]))
                    i = after_[i]
                else:
                    i += 1

    again = both.select(*columns).withColumn(skew.CHUNK, F.col(skew.CHUNK).cast("bigint")).unionByName(entered)
    return in_order(again).mapInArrow(lambda b: _in_batches(found(b), _schema(CLUSTER)), CLUSTER)


SEQUENCE = "entity_id string, item_id string, pos bigint, type string, at_ns bigint, doc_id string"


def _buckets(rows: DataFrame, window_ns: int) -> DataFrame:
    """``rows`` in buckets of four windows of time, with ``own``; those in a bucket's first window also in the one before.

    So all that follows an event within the window is in its bucket, and a hot item is as many tasks as it has buckets.
    """
    width = 4 * window_ns
    inside = F.pmod("at_ns", F.lit(width))
    own, before = F.struct((F.col("at_ns") - inside).alias("bucket"), F.lit(True).alias("own")), F.struct((F.col("at_ns") - inside - width).alias("bucket"), F.lit(False).alias("own"))
    return rows.select("*", F.inline(F.when(inside <= window_ns, F.array(own, before)).otherwise(F.array(own))))


def sequences(events: DataFrame, steps: Sequence[str], window_ns: int) -> DataFrame:
    """``entity_id, item_id, pos, type, at_ns, doc_id``: of each item the first run of ``steps`` that fits the window.

    From each event of the first type on, each next step is the earliest later event of its type; the run fits if it spans
    at most ``window_ns`` (0 or less: any). No steps, no rows. Runs that wait for one step move on together, so an event is
    looked at once and a run once a step; without a window only an item's first start counts, and each step is a minimum.
    """
    steps = list(steps)
    spark = events.sparkSession
    if not steps:
        return spark.createDataFrame([], SEQUENCE)
    rows, last = _rows(events, list(dict.fromkeys(steps))), len(steps) - 1
    when = F.struct("at_ns", "doc_id")
    if window_ns <= 0:
        runs = rows.where(F.col("type") == steps[0]).groupBy(*ITEM).agg(F.min(when).alias("s0"))
        for i, step in enumerate(steps[1:], 1):
            have = [f"s{j}" for j in range(i)]
            later = rows.where(F.col("type") == step).join(runs, ITEM).where(when > F.col(f"s{i - 1}"))
            runs = later.groupBy(*ITEM).agg(F.min(when).alias(f"s{i}"), *[F.first(h).alias(h) for h in have])
        each = F.array(*[F.struct(F.lit(i + 1).cast("bigint").alias("pos"), F.lit(s).alias("type"), F.col(f"s{i}.at_ns").alias("at_ns"), F.col(f"s{i}.doc_id").alias("doc_id")) for i, s in enumerate(steps)])
        return runs.select(*ITEM, F.inline(each))

    def found(batches) -> Iterator[tuple]:
        key, waiting, done = None, [], False
        for entity, item, bucket, t, d, kind, own in _by_row(batches):
            if (entity, item, bucket) != key:
                key, waiting, done = (entity, item, bucket), [deque() for _ in steps], False
            if done:
                continue
            for runs in waiting[1:]:
                while runs and t - runs[0][0][0] > window_ns:
                    runs.popleft()
            for i in range(last, 0, -1):
                if kind == steps[i] and waiting[i]:
                    for run in waiting[i]:
                        run.append((t, d))
                    if i == last:
                        done = True
                        yield from ((entity, item, bucket, p + 1, s, t2, d2) for p, (s, (t2, d2)) in enumerate(zip(steps, waiting[i][0])))
                    else:
                        waiting[i + 1].extend(waiting[i])
                    waiting[i] = deque()
            if own and kind == steps[0] and not done:
                if last:
                    waiting[1].append([(t, d)])
                else:
                    done = True
                    yield entity, item, bucket, 1, kind, t, d

    ddl = SEQUENCE.replace("pos", "bucket bigint, pos")
    placed = _buckets(rows, window_ns).select(*ITEM, "bucket", "at_ns", "doc_id", "type", "own")
    placed = placed.repartition(*ITEM, "bucket").sortWithinPartitions(*ITEM, "bucket", "at_ns", "doc_id")
    first = placed.mapInArrow(lambda b: _in_batches(found(b), _schema(ddl)), ddl).groupBy(*ITEM, "pos").agg(F.min_by(F.struct("type", "at_ns", "doc_id"), "bucket").alias("e"))
    return first.select(*ITEM, "pos", "e.type", "e.at_ns", "e.doc_id")


def followed_by(events: DataFrame, first: str, second: str, window_ns: int) -> DataFrame:
    """The two-step :func:`sequences` as ``entity_id, item_id, first_ns, second_ns``, by built-in functions alone."""
    if window_ns <= 0:
        pair = sequences(events, [first, second], window_ns)
        of = lambda pos: F.max(F.when(F.col("pos") == pos, F.col("at_ns")))
        return pair.groupBy(*ITEM).agg(of(1).alias("first_ns"), of(2).alias("second_ns"))
    placed = _buckets(_rows(events, [first, second]), window_ns)
    later = Window.partitionBy(*ITEM, "bucket").orderBy(F.desc("at_ns"), F.desc("doc_id")).rowsBetween(Window.unboundedPreceding, -1)
    nxt = placed.withColumn("second_ns", F.last(F.when(F.col("type") == second, F.col("at_ns")), ignorenulls=True).over(later))
    fits = nxt.where(F.col("own") & (F.col("type") == first) & (F.col("second_ns") - F.col("at_ns") <= window_ns))
    return fits.groupBy(*ITEM).agg(F.min(F.struct("at_ns", "second_ns")).alias("m")).select(*ITEM, F.col("m.at_ns").alias("first_ns"), "m.second_ns")


def group_count(events: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """``entity_id, item_id, attr, value, n, first_ns, last_ns``: distinct documents by item and attribute value."""
    pairs = F.inline(F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("value")) for a in attributes]))
    rows = events.where("item_id is not null").select(*ITEM, "doc_id", "at_ns", pairs).where("value is not null")
    return rows.groupBy(*ITEM, "attr", "value").agg(F.countDistinct("doc_id").alias("n"), F.min("at_ns").alias("first_ns"), F.max("at_ns").alias("last_ns"))


def group_count_bodies(docs: DataFrame) -> DataFrame:
    """``entity_id, item_id, attr, value, n, first_ns, last_ns`` over all top-level scalars of JSON documents with an item.

    docs: ``entity_id, doc_id, body``. A document counts if its ``item_id`` is a text; its instant, if it has one, is that of
    :func:`factweave.sources.views.body_events`. Groups without an instant have NULL in ``first_ns`` and ``last_ns``.
    """
    rows = _scalars(docs)
    return rows.groupBy(*ITEM, "attr", "value").agg(F.countDistinct("doc_id").alias("n"), F.min("at_ns").alias("first_ns"), F.max("at_ns").alias("last_ns"))


def group_documents(docs: DataFrame, entity_id: str, item_id: str, attr: str, value: str) -> DataFrame:
    """``doc_id`` of the documents of one group of :func:`group_count_bodies`."""
    own = _scalars(docs.where(F.col("entity_id") == entity_id)).where((F.col("item_id") == item_id) & (F.col("attr") == attr) & (F.col("value") == value))
    return own.select("doc_id").distinct()


def _scalars(docs: DataFrame) -> DataFrame:
    v = F.col("__v")
    dated = text_of(top(v, "item_id")).isNotNull() & text_of(top(v, "type")).isNotNull()
    rows = parsed(docs.select("entity_id", "doc_id", "body"), "body", "__v").select("entity_id", text_of(top(v, "item_id")).alias("item_id"), "doc_id", F.when(dated, instant_of(top(v, "at"))).alias("at_ns"), F.explode(scalars(v)).alias("s"))
    return rows.where("item_id is not null and s.key <> 'item_id'").select(*ITEM, "doc_id", "at_ns", F.col("s.key").alias("attr"), F.col("s.text").alias("value"))
