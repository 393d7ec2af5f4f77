"""Filling containers of fixed capacity by hierarchical residual packing.

A task measures the texts it reads and packs them best-fit, longest first. Nearly full containers are final. The others
go on as items of a merge round, in which fewer tasks hold the containers of several; rounds go on until one task holds
all that are left or merging no longer helps, which leaves at most one container per task and capacity badly filled.
Every round is written to the shared folder, so that a lost executor can't make later rounds see other containers than
the rounds before emitted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.encoding import TOKENIZERS, encoder
from factweave.plans.shared import cut
from factweave.plans.spread import spread

#: A container is nearly full if what is left is at most this share of its capacity.
NEARLY = 1 / 64
#: Underfull containers a merge task takes, and how many tasks of a round become one.
PER_TASK, FAN_IN = 200_000, 8

MEMBER = pa.struct([("doc_id", pa.int64()), ("token_from", pa.int64()), ("tokens", pa.int64())])
SCHEMA = pa.schema([("bin_kind", pa.string()), ("capacity", pa.int64()), ("container", pa.int64()), ("filled", pa.int64()), ("final", pa.bool_()), ("members", pa.list_(MEMBER))])
DDL = "bin_kind string, capacity bigint, container bigint, filled bigint, final boolean, members array<struct<doc_id: bigint, token_from: bigint, tokens: bigint>>"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Positions of ``sizes``, all in 1..capacity, by container: longest first, each into the fullest one that has room."""
    containers: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a container has r tokens of room
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            c = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            containers[c].append(i)
        else:
            room, c = capacity, len(containers)
            containers.append([i])
        room -= size
        if room:
            by_room[room].append(c)
            rooms |= 1 << room
    return containers


class _Out:
    """Batches of containers; their numbers are unique by round, task and place."""

    def __init__(self, number: int, last: bool):
        from pyspark import TaskContext

        self.next = (number << 54) | (TaskContext.get().partitionId() << 32)
        self.last, self.rows = last, []

    def add(self, kind, capacity, filled, members, final):
        self.rows.append((kind, capacity, self.next, filled, self.last or final, members))
        self.next += 1

    def full(self, upto: int = 0) -> Iterator[pa.RecordBatch]:
        if len(self.rows) > upto:
            columns = list(zip(*self.rows))
            self.rows = []
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, SCHEMA.types)], schema=SCHEMA)


def _first_udf(capacities: dict[str, int], vocabulary: str, folder: str, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, folder)
        out = _Out(0, last)
        items: dict[str, list] = {k: [] for k in capacities}
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                n = len(encode(text.as_py())) // 4
                for kind, capacity in capacities.items():
                    whole = n - n % capacity if n > capacity else 0
                    for start in range(0, whole, capacity):
                        out.add(kind, capacity, capacity, [(doc, start, capacity)], True)
                        yield from out.full(10_000)
                    if n > whole:
                        items[kind].append((doc, whole, n - whole))
        for kind, capacity in capacities.items():
            have = sorted(items.pop(kind), key=lambda m: (m[2], m[0] is None, m[0] or 0, m[1]))
            for c in best_fit([m[2] for m in have], capacity):
                members = [have[i] for i in c]
                filled = sum(m[2] for m in members)
                out.add(kind, capacity, filled, members, capacity - filled <= capacity * NEARLY)
                yield from out.full(10_000)
        yield from out.full()

    return run


def _merge_udf(number: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(number, last)
        items: dict[tuple, list] = {}
        for b in batches:
            columns = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("bin_kind", "capacity", "container", "filled")]
            members = b.column(b.schema.get_field_index("members"))
            for i, (kind, capacity, container, filled) in enumerate(zip(*columns)):
                items.setdefault((kind, capacity), []).append((filled, container, members[i]))
        for (kind, capacity), have in sorted(items.items(), key=lambda x: str(x[0])):
            have.sort(key=lambda x: x[:2])
            for c in best_fit([x[0] for x in have], capacity):
                members = [m for i in c for m in have[i][2].as_py()]
                filled = sum(have[i][0] for i in c)
                out.add(kind, capacity, filled, members, capacity - filled <= capacity * NEARLY)
                yield from out.full(5_000)
        yield from out.full()

    return run


def pack(documents: DataFrame, key: str, text: str, capacities: dict[str, int], vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS, per_task: int = PER_TASK) -> DataFrame:
    """``bin_kind, container, doc_id, token_from, tokens``: for each capacity, which tokens of which text are where.

    A text with more tokens than the capacity is divided into full containers and one rest, which is packed like any
    other text; no other text is divided. Texts without tokens, null ones too, take no container. ``container`` is unique
    over all capacities. Equal or null keys stay separate texts. Other columns are ignored.
    """
    capacities = {k: int(c) for k, c in capacities.items() if c and c > 0}
    rows = spread(documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")))
    rounds = [cut(rows.mapInArrow(_first_udf(capacities, vocabulary, folder, False), DDL), "pack")]
    tasks, left = rows.rdd.getNumPartitions(), None
    while True:
        open_ = rounds[-1].where("not final")
        before, left = left, open_.count()
        if not left:
            break
        tasks = max(math.ceil(left / per_task), math.ceil(tasks / FAN_IN))
        last = tasks == 1 or (before is not None and left > 0.95 * before)
        merged = open_.repartition(tasks, "container").mapInArrow(_merge_udf(len(rounds), last), DDL)
        rounds.append(cut(merged, "pack"))
        if last:
            break
    done = rounds[0].where("final")
    for r in rounds[1:]:
        done = done.unionByName(r.where("final"))
    return done.select("bin_kind", "container", F.inline("members"))
