"""History, sessions, incremental runs, change feed and as-of joins against plain Python, with hot keys and dirty rows."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from factweave.functions.bodies import parse, satellite_hashes
from factweave.functions.instants import rfc3339_ns
from factweave.operators import asof, cdc, history, incremental, sessions
from factweave.plans.shared import fresh_dir
from factweave.sources.entries import entry_rows

VERSION = "seq bigint, entity_id string, doc_id string, at_ns bigint, deleted boolean, body string, arrived_at string, __chunk string, live string, state int"


def versions(spark, data):
    return spark.createDataFrame([(*r, "x", "clash", "clash", 1) for r in data], VERSION)


def some_versions(n, docs, seed):
    r = random.Random(seed)
    bodies = ['{"a":1,"b":"x"}', '{"b":"x", "a":1.0}', '{"a":2}', "blob", '"blob"', None, "", '{"a":[1,{"c":null}]}', '{"a":1e999}', "[1]", "[1.0]"]
    out = []
    for i in range(n):
        row = (i, r.choice(["t", "u", None] if r.random() < 0.1 else ["t"]), "hot" if r.random() < 0.4 else f"d{r.randrange(docs)}", None if r.random() < 0.05 else r.randrange(60), r.choice([None, False, False, True]), r.choice(bodies))
        out += [row] * r.choice([1, 1, 1, 2])
    r.shuffle(out)
    return out


def state_of(body):
    ok, value = parse(body) if body is not None else (None, None)
    return repr((ok, sorted(value.items()) if isinstance(value, dict) else value))


def plain_history(data):
    held = {}
    for seq, e, d, at, deleted, body in data:
        if at is not None and e is not None and d is not None:
            held.setdefault((e, d), {}).setdefault(at, {})[seq] = None if deleted else state_of(body)
    out = []
    for key, by in held.items():
        steps = []
        for at in sorted(by):
            s = by[at][max(by[at])]
            if not steps and s is None or steps and steps[-1][1] == s:
                continue
            steps.append((at, s))
        out += [(*key, at, steps[i + 1][0] if i + 1 < len(steps) else -1) for i, (at, s) in enumerate(steps) if s is not None]
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk", [10, 10_000])
def test_history(spark, chunk):
    data = some_versions(300, 5, chunk)
    got = history.document_history(versions(spark, data), fresh_dir(spark, "t"), chunk).select("entity_id", "doc_id", "valid_from_ns", "valid_to_ns")
    assert rows(got) == plain_history(data)


def test_history_of_nothing(spark):
    assert rows(history.document_history(versions(spark, []), fresh_dir(spark, "t"))) == []


@pytest.mark.parametrize("chunk", [10, 10_000])
def test_history_in_several_loads(spark, chunk):
    data = some_versions(300, 5, 7)
    store = history.Satellites(spark, fresh_dir(spark, "t"), chunk)
    for low, high in ((0, 20), (20, 20), (20, 45), (45, 61)):
        store.load(versions(spark, [x for x in data if x[3] is None or low <= x[3] < high]))
    assert rows(store.history().select("entity_id", "doc_id", "valid_from_ns", "valid_to_ns")) == plain_history(data)
    n = store.rows().count()
    last = {}
    for x in data:
        if x[3] is not None and x[1] is not None and (x[3], x[0]) > last.get(x[1:3], (-1, -1))[:2]:
            last[x[1:3]] = (x[3], x[0], x)
    store.load(versions(spark, [x for _, _, x in last.values()]))  # the last versions again
    assert store.rows().count() == n
    with pytest.raises(Exception, match="later than the one loaded last"):
        store.load(versions(spark, [(999, "t", "hot", 1, False, "{}")]))
    assert store.rows().count() == n


def test_satellites_split_attributes(spark):
    data = [(i, "t", "d", i, False, '{"slow":"s","fast":%d}' % i) for i in range(9)]
    assert history.satellite_of(versions(spark, data)) == {"fast": 0, "slow": 2}
    s = history.Satellites(spark, fresh_dir(spark, "t"))
    s.load(versions(spark, data))
    assert s.view(0).count() == 9 and [(r.valid_from_ns, r.valid_to_ns, r.attributes) for r in s.view(2).collect()] == [(0, -1, '{"slow":"s"}')]
    s.load(versions(spark, [(20, "t", "d", 20, False, '{"slow":"s","fast":8}'), (21, "t", "d", 21, False, '{"slow":"z","fast":8}'), (22, "t", "new", 3, False, "text")]))
    assert s.rows().where("seq >= 20").select("doc_id", "satellite", "attributes", "first").collect().__len__() == 1 + 4
    assert rows(s.view(2).where("doc_id = 'd'").select("valid_from_ns", "valid_to_ns", "attributes")) == [(0, 21, '{"slow":"s"}'), (21, -1, '{"slow":"z"}')]
    assert [r.attributes for r in s.view(3).where("attributes is not null").collect()] == ["Ttext"]


def test_equal_bodies():
    same = lambda a, b: satellite_hashes(a, {}, 3) == satellite_hashes(b, {}, 3)
    assert same('{"a":1,"b":[1,2]}', '{"b":[1.0,2e0], "a":1}') and same("-0.0", "0") and same('{"a":1,"a":2}', '{"a":2}')
    assert not same("blob", '"blob"') and not same("NaN", "nan") and not same(None, "") and not same("[1]", "[2]")
    assert not same('{"a":1}', '{"a":"1"}') and same('"\\u0041"', '"A"') and not same("{" * 5000, "[" * 5000)


def plain_sessions(events, gap):
    out, by = [], {}
    for k, t, i in events:
        if k is not None and t is not None and i is not None:
            by.setdefault(k, set()).add((t, i))
    for k, own in by.items():
        own = sorted(own)
        start = last = own[0][0]
        n = 0
        for t, _ in own:
            if t - last > gap:
                out.append((k, start, last, last - start, n))
                start, n = t, 0
            last, n = t, n + 1
        out.append((k, start, last, last - start, n))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [10, 37, 10_000])
def test_sessions(spark, seed):
    r = random.Random(seed)
    events = [("hot" if r.random() < 0.4 else r.choice(["a", "b", None]), None if r.random() < 0.03 else r.randrange(-500, 1500), i) for i in range(400)]
    events += [r.choice(events) for _ in range(80)] + [("a", 5, None), ("edge", 0, 9001), ("edge", 10, 9002), ("edge", 21, 9003)]
    df = spark.createDataFrame([(*e, 1, "x") for e in events], "item string, t bigint, entry bigint, bucket int, delta string")
    assert rows(sessions.sessions(df, ["item"], "t", "entry", 10)) == plain_sessions(events, 10)
    assert rows(sessions.sessions(df.limit(0), ["item"], "t", "entry", 10)) == []


def test_instants(spark):
    texts = {
        "2021-01-01T00:00:01Z": 1_609_459_201_000_000_000, "2021-01-01T01:00:01.5+01:00": 1_609_459_201_500_000_000, "2020-12-31T16:00:01-08:00": 1_609_459_201_000_000_000,
        "1969-12-31T23:59:59.999999999Z": -1, "2021-01-01T0:00:01,25Z": 1_609_459_201_250_000_000, "2021-01-01T27:00:01Z": None, "2021-02-30T00:00:00Z": None,
        "2021-01-01 00:00:01": None, "2021-01-01T00:00:01": None, "this morning": None, "": None, "9999-01-01T00:00:00Z": None, "2021-01-01T00:00:60Z": None, "2021-01-01t00:00:01Z": None,
    }
    df = spark.createDataFrame([(k,) for k in texts], "t string")
    assert {r.t: r.x for r in df.withColumn("x", rfc3339_ns(F.col("t"))).collect()} == texts


def test_entries_need_item_type_and_instant(spark):
    ddl = "entry_id bigint, entity_id string, item_id string, doc_id string, entry_type string, at_ns bigint, at_text string, id string"
    df = spark.createDataFrame([(1, "t", "i", None, "x", 5, None, "c"), (2, "t", None, "d", "x", 5, None, "c"), (3, "t", "i", "d", None, 5, None, "c"), (4, "t", "i", "d", "x", None, "nonsense", "c"), (5, "t", "i", "d", "x", None, "1970-01-01T00:00:00Z", "c")], ddl)
    assert [(r.entry_id, r.at_ns) for r in entry_rows(df).orderBy("entry_id").collect()] == [(1, 5), (5, 0)]


META = "delivery_no int, entity_id string, doc_id string, created_at_ns bigint, updated_at_ns bigint, doc_version bigint, run_no string"


def plain_runs(data, runs):
    taken, out = {}, []
    for no, upto in runs:
        new = {}
        for n, e, d, c, _, v in data:
            if n is not None and n <= upto and e and d:
                new[(e, d)] = max(new.get((e, d), (-(2**63),) * 2), (-(2**63) if c is None else c, -(2**63) if v is None else v))
        for key, s in new.items():
            if key not in taken or s > taken[key]:
                taken[key] = s
                out.append((no, *key, s[1]))
    return sorted(out, key=repr)


def test_incremental_runs_survive_failures(spark):
    r = random.Random(4)
    data = [(r.choice([None, *range(1, 9)]), r.choice(["t", None, "u"]), "hot" if r.random() < 0.3 else f"d{r.randrange(6)}", r.choice([1, 2, None]), 0, r.choice([1, 2, 3, None])) for _ in range(120)]
    df = spark.createDataFrame([(*x, "clash") for x in data], META)
    runs = [(1, 2), (3, 5), (4, 4), (6, 8), (7, 8)]
    consumer = incremental.Consumer(spark, fresh_dir(spark, "t"))
    for no, upto in runs:
        with pytest.raises(RuntimeError):
            consumer.run(no, df.where(F.col("delivery_no") <= upto), fail_before_commit=True)
        consumer.run(no, df.where(F.col("delivery_no") <= upto))
    got = consumer.taken().select("run_no", "entity_id", "doc_id", "doc_version")
    assert rows(got) == plain_runs(data, runs)
    with pytest.raises(ValueError):
        consumer.run(1, df)


def test_incremental_sees_a_value_move_between_columns(spark):
    consumer = incremental.Consumer(spark, fresh_dir(spark, "t"))
    rows_ = lambda created, version: spark.createDataFrame([(1, "t", "a", created, version)], "delivery_no int, entity_id string, doc_id string, created_at_ns bigint, doc_version bigint")
    consumer.run(1, rows_(None, 5))
    consumer.run(2, rows_(5, None))
    assert sorted(r.run_no for r in consumer.taken().collect()) == [1, 2]


def test_only_changed_partitions_are_recomputed(spark):
    consumer = incremental.Consumer(spark, fresh_dir(spark, "t"))
    make = lambda x: spark.createDataFrame([(*y, "x") for y in x], META)
    first = [(1, "t", "a", 1, 0, 1), (2, "t", "b", 1, 0, 1), (3, None, "b", 1, 0, 1)]
    assert sorted(consumer.run(1, make(first))) == ["1", "2", "3"] and consumer.run(2, make(first)) == []
    more = [*first, (2, "t", "b", 1, 0, 3), (4, "t", "c", 1, 0, 1)]
    with pytest.raises(RuntimeError):
        consumer.run(3, make(more), fail_before_commit=True)
    assert consumer.run(4, make(first)) == ["2"]  # back to what it was: the failed run's result isn't for these rows
    assert sorted(consumer.run(5, make(more))) == ["2"]
    assert [(r.run_no, r.doc_id, r.doc_version) for r in consumer.taken().orderBy("run_no", "doc_id").collect()] == [(1, "a", 1), (1, "b", 1), (5, "b", 3), (5, "c", 1)]


def test_incremental_sees_rows_added_to_a_partition(spark):
    consumer = incremental.Consumer(spark, fresh_dir(spark, "t"))
    first = [(1, "t", "a", 1, 0, 1, "x"), (2, "t", "b", 1, 0, 1, "x")]
    consumer.run(1, spark.createDataFrame(first, META))
    consumer.run(2, spark.createDataFrame([*first, (1, "t", "b", 1, 0, 2, "x"), (1, "t", "a", 1, 0, 1, "x")], META))
    consumer.run(3, spark.createDataFrame([], META))
    assert [(r.run_no, r.doc_id, r.doc_version) for r in consumer.taken().orderBy("run_no", "doc_id").collect()] == [(1, "a", 1), (1, "b", 1), (2, "b", 2)]


FEED = "feed_no bigint, seq bigint, entity_id string, doc_id string, kind string, at_unix_nanos bigint, old_doc string, new_doc string, at_ns string, live string"


def plain_current(data):
    best = {}
    for _, seq, e, d, kind, at, _, new in data:
        k = (kind or "").lower().removeprefix("op_kind_doc_")
        if e and d and k in ("assert", "change", "retract"):
            order = (-(2**63) if at is None else at, seq)
            if (e, d) not in best or order > best[(e, d)][0]:
                best[(e, d)] = (order, k, new, seq)
    return sorted(((*key, seq, new) for key, (_, k, new, seq) in best.items() if k != "retract"), key=repr)


def test_change_feed_in_any_order_and_number(spark):
    r = random.Random(9)
    kinds = ["assert", "Change", "RETRACT", "OP_KIND_DOC_ASSERT", "op_kind_doc_retract", "OP_KIND_VEC_INSERT", None]
    data = [(i, i, r.choice(["t", "u", None]), "hot" if r.random() < 0.4 else r.choice([f"d{r.randrange(5)}", None]), r.choice(kinds), r.choice([None, 1, 2, 3, 4]), None, r.choice([None, "", f"n{i}", "long" * 5000])) for i in range(200)]
    data += [r.choice(data) for _ in range(60)]
    r.shuffle(data)
    make = lambda x: spark.createDataFrame([(*y, "a", "b") for y in x], FEED)
    state = cdc.CurrentState(spark, fresh_dir(spark, "t"))
    assert rows(state.documents()) == []
    for part in (data[:100], data[100:], data[50:150], []):
        state.apply(make(part), rows_per_bucket=20)
    assert rows(state.documents().select("entity_id", "doc_id", "seq", "new_doc")) == plain_current(data)


def test_only_buckets_with_changes_are_written(spark):
    state = cdc.CurrentState(spark, fresh_dir(spark, "t"))
    make = lambda x: spark.createDataFrame([(i, i, "t", d, "assert", i, None, f"n{i}", "a", "b") for i, d in x], FEED)
    state.apply(make([(i, f"d{i}") for i in range(200)]), rows_per_bucket=20)
    first = state.manifest()
    state.apply(make([(500, "d7")]), rows_per_bucket=20)
    second = state.manifest()
    assert first["buckets"] == 10 and first["rows"] == second["rows"] == 200 and len(first["parts"]) == 10
    assert sum(first["parts"][b] != second["parts"][b] for b in first["parts"]) == 1 == len(second["gone"])
    assert {r.doc_id: r.seq for r in state.documents().collect()} == {f"d{i}": 500 if i == 7 else i for i in range(200)}
    state.apply(make([(1000 + i, f"e{i}") for i in range(300)]), rows_per_bucket=20)
    assert state.manifest()["buckets"] == 25 and state.manifest()["rows"] == 500 == state.documents().count()
    assert not state.files.exists(f"{state.root}/{second['gone'][0]}") and state.files.exists(f"{state.root}/{next(iter(second['parts'].values()))}")


@pytest.mark.parametrize("bucket", [12, 100_000])
def test_asof_join(spark, bucket):
    r = random.Random(bucket)
    key = lambda: ("t", "hot") if r.random() < 0.5 else (r.choice(["t", "u", None]), r.choice(["a", "b", None]))
    vs = [(i, *key(), None if r.random() < 0.05 else r.randrange(100), r.choice([True, True, False])) for i in range(120)]
    es = [(i, *key(), None if r.random() < 0.05 else r.randrange(-10, 120)) for i in range(200)]
    vs, es = vs + vs[:20], es + es[:30]
    want = set()
    for i, e, d, at in es:
        if e and d and at is not None:
            fit = [(v[3], v[0], v[4]) for v in vs if v[1:3] == (e, d) and v[3] is not None and v[3] <= at]
            want.add((i, at, *((max(fit)[1], max(fit)[0], max(fit)[2]) if fit else (None, None, None))))
    events = spark.createDataFrame([(*x, "c") for x in es], "id bigint, entity_id string, doc_id string, at_ns bigint, seq string")
    versions_ = spark.createDataFrame([(*x, "c") for x in vs], "seq bigint, entity_id string, doc_id string, at_ns bigint, live boolean, id string")
    got = asof.asof_join(events, versions_, bucket)
    assert rows(got) == sorted(want, key=repr)
    assert rows(asof.asof_join(events.limit(0), versions_)) == []
    assert all(x[2] is None for x in rows(asof.asof_join(events, versions_.limit(0))))
