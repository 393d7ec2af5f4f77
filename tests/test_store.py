"""The store's operators on small fixtures with known results and against plain Python."""

import json
import os
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from factweave import reference_queries
from factweave.functions.bodies import parse
from factweave.functions.json import number_text
from factweave.operators import closure, lookup, store, temporal, vectors
from factweave.operators.cdc import CurrentState
from factweave.operators.query import pull, query, query_as_of
from factweave.operators.store import as_of
from factweave.plans import wire
from factweave.plans.clauses import Aggregate, Facts, FullText, Lit, Not, Or, Pattern, Predicate, Rule, RuleCall, narrowed
from factweave.plans.shared import fresh_dir
from factweave.sources.views import body_events, body_facts
from factweave.streaming import feed

V = store.DDL


def docs(spark, bodies):
    return spark.createDataFrame([("tenant-a", k, v) for k, v in bodies.items()], "entity_id string, doc_id string, body string")


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_lookups(spark):
    d = docs(spark, {"d1": '{"status":"active","category":"truck"}', "d2": '{"status":"retired","category":"trailer"}', "d3": '{"category":"car"}', "d4": "nonsense", "d5": None, "d6": "[1]"})
    assert ids(lookup.lookup(d, "tenant-a", "active")) == ["d1"] and ids(lookup.lookup(d, "tenant-a", "nothing")) == []
    assert ids(lookup.lookup_prefix(d, "tenant-a", "category:tr")) == ["d1", "d2"] and ids(lookup.lookup_prefix(d, "tenant-a", "")) == ["d1", "d2", "d3"]
    assert ids(lookup.lookup_all(d, "tenant-a", ["status:active", "truck"])) == ["d1"] and ids(lookup.lookup(d, "other", "active")) == []


@pytest.mark.parametrize("low,high,ol,oh,want", [(20, 40, False, False, "234"), (20, 40, True, True, "3"), (20, 40, True, False, "34"), (20, 40, False, True, "23"), (30, 30, False, False, "3"), (30, 30, True, False, ""), (40, 20, False, False, ""), (-5, 5, False, False, "")])
def test_numeric_range(spark, low, high, ol, oh, want):
    d = docs(spark, {str(i): '{"km":%d}' % (10 * i) for i in range(1, 6)})
    assert ids(lookup.lookup_range(d, "tenant-a", "km", low, high, ol, oh)) == list(want)


def test_bounds_and_stats(spark):
    d = docs(spark, {str(i): '{"km":%d}' % (10 * i) for i in range(1, 6)})
    with pytest.raises(ValueError):
        lookup.lookup_range(d, "tenant-a", "km", float("nan"), 1)
    assert tuple(lookup.stats(d, "tenant-a", "km").first()) == (5, 30.0, 1000.0, 10.0, 50.0)
    assert tuple(lookup.stats(d, "tenant-a", "none").first()) == (0, 0.0, 0.0, None, None)


def terms_of(spark, body):
    return sorted(r.term for r in lookup.terms(docs(spark, {"d": body})).collect())


def test_terms(spark):
    many = docs(spark, {
        "a": '{"status":"active","km":45000,"open":true}', "b": '{"coverage_feature":{"tierart":["hund","katze"]}}', "c": '{"coverage":[{"name":"hund","km":10},{"name":"katze","km":20}]}',
        "d": '{"a":null,"b":42,"c":""}', "e": '{"a":"x","b":"x"}', "f": '{"a":1,"a":"last"}', "g": '{"' + 'k":{"' * 14 + 'deep":[[7]]}' + "}" * 14, "h": '{"empty":{},"none":[]}',
        **{f"bad{i}": x for i, x in enumerate(("[1,2,3]", '"hello"', "42", "null", "true", "{not valid", "", None, '{"a":1e999,"b":2}'))},
    })
    got = {}
    for r in lookup.terms(many).collect():
        got.setdefault(r.doc_id, []).append(r.term)
    assert {k: sorted(v) for k, v in got.items()} == {
        "a": ["45000", "active", "km:45000", "open:true", "status:active", "true"], "b": ["hund", "katze", "tierart:hund", "tierart:katze"],
        "c": ["10", "20", "hund", "katze", "km:10", "km:20", "name:hund", "name:katze"], "d": ["42", "b:42", "c:"], "e": ["a:x", "b:x", "x"], "f": ["a:last", "last"], "g": ["7", "deep:7"],
    }
    assert {(r.doc_id, r.attr, r.num) for r in lookup.numbers(many).collect()} == {("a", "km", 45000.0), ("c", "km", 10.0), ("c", "km", 20.0), ("d", "b", 42.0), ("g", "deep", 7.0)}
    assert terms_of(spark, '{"k":' * 40 + "1" + "}" * 40) == ["1", "k:1"]
    assert "Python" not in lookup.lookup(many, "tenant-a", "x")._jdf.queryExecution().toString() and "InArrow" not in lookup.stats(many, "tenant-a", "x")._jdf.queryExecution().toString()


def test_number_texts(spark):
    want = {45000.0: "45000", 0.5: "0.5", 1e6: "1e+06", 1.5e-5: "1.5e-05", -2.0: "-2", 123456.7: "123456.7", 0.0: "0", 1234567.0: "1.234567e+06", 1e7: "1e+07", -1.25e21: "-1.25e+21", 1e300: "1e+300", 0.00012: "0.00012", 0.001: "0.001", 999999.5: "999999.5", 1000000.5: "1.0000005e+06", 3e-300: "3e-300", 100.0: "100"}
    df = spark.createDataFrame([(x,) for x in want], "x double")
    assert {r.x: r.t for r in df.withColumn("t", number_text(F.col("x"))).collect()} == want


def test_term_changes(spark):
    before, after = docs(spark, {"a": '{"x":1,"y":"p"}', "b": '{"x":1}', "c": '{"x":1}'}), docs(spark, {"a": '{"x":2,"y":"p"}', "c": '{"x":1}', "d": '{"z":true}'})
    assert rows(lookup.term_changes(before, after).select("doc_id", "gained", "lost")) == [("a", ["2", "x:2"], ["1", "x:1"]), ("b", [], ["1", "x:1"]), ("d", ["true", "z:true"], [])]


def facts(spark):
    df = spark.createDataFrame([(501, "item", "active", 45000.0, ["go.mod", "main.go"], "Vehicles"), (502, "item", "retired", 10000.0, [], "Buildings"), (503, "item", "scheduled", 99999.0, None, None), (601, "category", None, None, ["Readme"], "x")], "id bigint, type string, status string, km double, files array<string>, name string")
    return Facts(df, "id", {":type": F.col("type"), ":status": F.col("status"), ":km": F.col("km"), ":files": F.col("files"), ":name": F.col("name")})


def json_facts(spark):
    d = {"501": '{":type":"item",":status":"active",":km":45000,":files":["go.mod","main.go"],":name":"Vehicles"}', "502": '{":type":"item",":status":"retired",":km":10000,":files":[],":name":"Buildings"}', "503": '{":type":"item",":status":"scheduled",":km":99999}', "601": '{":type":"category",":files":["Readme"],":name":"x",":nil":null}'}
    return body_facts(docs(spark, d))


ITEM = Pattern("?e", ":type", "item")
KM = Pattern("?e", ":km", "?k")


@pytest.mark.parametrize("make", [facts, json_facts])
@pytest.mark.parametrize("where,want", [
    ([ITEM], [501, 502, 503]),
    ([ITEM, KM, Predicate("?k", ">", 20000)], [501, 503]),
    ([ITEM, Predicate("?k", ">", 20000), KM], []),
    ([ITEM, Predicate("?k", "!=", 20000), KM], [501, 502, 503]),
    ([ITEM, KM, Predicate("?k", ">", "20000")], []),
    ([ITEM, KM, Predicate("?k", "==", 10000)], [502]),
    ([ITEM, Or([[Pattern("?e", ":status", "active")], [Pattern("?e", ":status", "scheduled")]])], [501, 503]),
    ([ITEM, Not([Pattern("?e", ":status", "retired")])], [501, 503]),
    ([Pattern("?e", ":type", "?t"), Pattern("?e", ":type", "category"), Not([KM])], [601]),
    ([ITEM, Pattern("?e", ":name", "?n"), FullText("VEHIC", ":name")], [501]),
    ([ITEM, FullText("")], []),
    ([ITEM, FullText("main", ":files")], [501]),
    ([ITEM, Pattern("?e", ":files", "?f"), Predicate("?f", "ends_with", ".go")], [501]),
    ([ITEM, Pattern("?e", ":files", "go.mod")], []),
    ([ITEM, Pattern("?e", ":files")], [501, 502]),
    ([ITEM, Pattern("?e", "", "x")], []),
    ([ITEM, KM, Predicate("?k", "like", 1)], []),
    ([ITEM, KM, Pattern("?e", ":km", "?k")], [501, 502, 503]),
    ([ITEM, Pattern("?e", ":status", "?k"), Pattern("?e", ":km", "?k")], []),
    ([ITEM, KM, Predicate("?k", ">", 5), Predicate("?k", "<", 5)], []),
    ([ITEM, Or([[Pattern("?e", ":status", "active"), KM], [Pattern("?e", ":name", "?k")]]), Predicate("?k", "contains", "Build")], [502]),
    ([ITEM, Predicate(Lit("?k"), "==", "?x")], []),
])
def test_clauses(spark, make, where, want):
    assert sorted(int(float(r.e)) for r in query(make(spark), ["?e"], where).collect()) == want


def test_present_null_binds(spark):
    f = json_facts(spark)
    assert query(f, ["?e", "?n"], [Pattern("?e", ":type", "category"), Pattern("?e", ":nil", "?n"), Predicate("?n", "==", None)]).count() == 1
    assert query(f, ["?e"], [Pattern("?e", ":type", "category"), Pattern("?e", ":nil")]).count() == 1


def test_anchors_and_aggregates(spark):
    f = facts(spark)
    with pytest.raises(ValueError):
        query(f, ["?e"], [KM, Predicate("?k", ">", 1)])
    with pytest.raises(ValueError):
        query(f, where=[ITEM], aggregates=[Aggregate("stddev", "?e", "x")])
    agg = [Aggregate(fn, "?k", fn) for fn in ("count", "sum", "total", "avg", "min", "max")]
    assert tuple(query(f, where=[ITEM, KM], aggregates=agg).first()) == (3.0, 154999.0, 154999.0, 154999.0 / 3, 10000.0, 99999.0)
    assert tuple(query(f, where=[Pattern("?e", ":type", "none"), KM], aggregates=agg).first()) == (0.0, 0.0, 0.0, 0.0, None, None)
    assert rows(query(f, where=[Pattern("?e", ":type", "none"), Pattern("?e", ":status", "?s"), KM], aggregates=agg, group_by=["?s"])) == []
    grouped = query(f, where=[ITEM, Pattern("?e", ":status", "?s"), KM], aggregates=agg[:2], group_by=["?s"])
    assert [tuple(r) for r in grouped.collect()] == [("active", 1.0, 45000.0), ("retired", 1.0, 10000.0), ("scheduled", 1.0, 99999.0)]


def test_pull_and_rules(spark):
    f = facts(spark)
    got = {r.doc_id: r.pulled for r in pull(f, [":status", ":name"], [ITEM]).collect()}
    assert got[501] == '{":status":"active",":name":"Vehicles"}' and got[503] == '{":status":"scheduled"}'
    with pytest.raises(ValueError):
        pull(f, ["{:a}"], [ITEM])
    edges = spark.createDataFrame([("Trucks", "Vehicles"), ("BigRigs", "Trucks"), ("Sedans", "Vehicles"), ("Vehicles", "All"), ("Buildings", "All")], "child string, parent string")
    assert [r.e for r in query(f, ["?e"], [ITEM, Pattern("?e", ":name", "?c"), RuleCall("?c", "Vehicles")], edges=edges).collect()] == [501.0]
    assert [r.node for r in closure.ancestors(edges, "BigRigs").orderBy("depth").collect()] == ["Trucks", "Vehicles", "All"]
    assert ids(closure.descendants(edges, "Vehicles")) == ["BigRigs", "Sedans", "Trucks"] and ids(closure.descendants(edges, "Sedans")) == []
    assert closure.closure(edges).count() == 9
    cycle = spark.createDataFrame([("a", "b"), ("b", "a"), (None, "a")], "child string, parent string")
    with pytest.raises(ValueError):
        closure.closure(cycle)
    assert ids(closure.ancestors(cycle, "a")) == ["b"]


@pytest.mark.parametrize("few", [0, 1, 3, 1000])
def test_walk_with_small_and_large_levels(spark, monkeypatch, few):
    monkeypatch.setattr(closure, "FEW", few)
    r = random.Random(5)
    pairs = [(f"n{i}", f"n{r.randrange(max(0, i - 6), i)}") for i in range(1, 40)] + [("n3", "n9"), ("n0", "n20")]
    edges = spark.createDataFrame(pairs, "child string, parent string")
    for up, start in ((True, "n30"), (False, "n0"), (False, "n5"), (True, "none")):
        level, want, depth = {start}, {}, 0
        while level:
            depth += 1
            level = {b if up else a for a, b in pairs if (a if up else b) in level} - set(want)
            want |= dict.fromkeys(level, depth)
        want.pop(start, None)
        assert rows((closure.ancestors if up else closure.descendants)(edges, start)) == sorted(want.items(), key=repr), (few, start)


def test_walk_of_a_deep_hierarchy(spark, monkeypatch):
    monkeypatch.setattr(closure, "DEPTH", 3)
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(4)], "child string, parent string")
    assert ids(closure.ancestors(chain, "n1")) == ["n2", "n3", "n4"] and ids(closure.descendants(chain, "n3")) == ["n0", "n1", "n2"]
    for walk, start in ((closure.ancestors, "n0"), (closure.descendants, "n4"), (closure.category_in_tree, "n4")):
        with pytest.raises(ValueError, match="deeper than 3"):
            walk(chain, start)


BODIES = {
    "1": '{"type":"item","note":"The Crane","parts":["bolt",7,{"x":"deep"}],"km":45000,"open":true,"nil":null}', "2": '{"type":"item","notes":"no cranes","a.b":1.5}',
    "3": '{"type":"item","parts":["CRANE"],"in":{"note":"bolt"}}', "4": '{"type":"item"}', "5": "crane", "6": '["crane"]', "7": '"crane"', "8": None,
}


@pytest.mark.parametrize("text,want", [("crane", "123"), ("bolt", "1"), ("deep", ""), ("4500", ""), ("note", ""), ("item", "1234"), ("true", ""), ("", "")])
def test_fulltext_any_of_bodies(spark, text, want):
    where = [Pattern("?e", "type", "item"), FullText(text)]
    assert sorted(str(int(r.e)) for r in query(body_facts(docs(spark, BODIES)), ["?e"], where).select(F.col("e").cast("double").alias("e")).collect()) == list(want)
    v = docs(spark, BODIES).select(F.lit(1).alias("seq"), "entity_id", "doc_id", F.lit(1).alias("at_ns"), F.lit(False).alias("deleted"), "body")
    assert query_as_of(v, 5, body_facts, find=["?e"], where=[FullText(text)]).count() == len(want)


def test_pull_of_bodies(spark):
    f, where = body_facts(docs(spark, BODIES)), [Pattern("?e", "type", "item")]
    got = {r.doc_id: json.loads(r.pulled) for r in pull(f, "*", where).collect()}
    assert got == {k: json.loads(BODIES[k]) for k in "1234"}
    names = ["km", "nil", "a.b", "in", "parts", "it's?", "km"]
    got = {r.doc_id: json.loads(r.pulled) for r in pull(f, names, where).collect()}
    assert got == {k: {n: v for n, v in json.loads(BODIES[k]).items() if n in names} for k in "1234"}


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="no test data")
def test_bodies_of_doc_version(spark):
    current = as_of(spark.read.parquet("/root/testdata/sf0.01/doc_version.parquet"))
    own = {}
    for r in current.collect():
        is_json, body = parse(r.body or "")
        if is_json and isinstance(body, dict) and body.get("status") == "active":
            own[(r.entity_id, r.doc_id)] = body
    texts = lambda v: [v] if isinstance(v, str) else [x for x in v if isinstance(x, str)] if isinstance(v, list) else []
    f, active = body_facts(current), Pattern("?e", "status", "active")
    assert query(f, ["?e"], [active, FullText("HAUL")]).count() == sum(any("haul" in x.lower() for v in b.values() for x in texts(v)) for b in own.values()) > 0
    key = lambda x: sorted(json.dumps(b, sort_keys=True) for b in x)
    assert key(parse(r.pulled)[1] for r in pull(f, "*", [active]).collect()) == key(own.values())
    assert key(parse(r.pulled)[1] for r in pull(f, ["km", "status"], [active]).collect()) == key({k: v for k, v in b.items() if k in ("km", "status")} for b in own.values())


def test_versions(spark):
    v = spark.createDataFrame([(1, "t", "501", 10, False, '{":s":"active"}'), (2, "t", "501", 20, None, '{":s":"retired"}'), (3, "t", "x", 5, False, "1"), (4, "t", "x", 6, True, None), (5, "t", "n", None, False, "1")], V)
    where = [Pattern("?e", ":s", "active")]
    assert query_as_of(v, 15, body_facts, find=["?e"], where=where).count() == 1 and query_as_of(v, 25, body_facts, find=["?e"], where=where).count() == 0
    assert query_as_of(v, 9, body_facts, find=["?e"], where=where).count() == 0
    with pytest.raises(ValueError):
        query_as_of(v, 9, body_facts, find=["?e"], where=[])
    assert store.get(v, "t", "x") is None and store.get(v, "t", "501") == '{":s":"retired"}' and store.scan(v, "t").count() == 1
    assert [tuple(r) for r in store.last_written(v).collect()] == [("t", "501", 20, 10, 2)]
    gone = store.delete(v, v, 30, 9)
    assert gone.count() == 1 and store.as_of(v.unionByName(gone)).count() == 0
    assert store.batch_put(spark, "t", {"a": "1", "b": "2"}, 1, 1).count() == 2
    for bad in (("", "a"), ("a:b", "a"), ("a", "")):
        with pytest.raises(ValueError):
            store.put(spark, *bad, "1", 1, 1)


def test_facts(spark):
    f = spark.createDataFrame([("t", "r", "a", "1", 1), ("t", "r", "a", "2", 2), ("t", "r", "b", None, 3), ("t", "", "a", "x", 1), ("t", "r", None, "x", 1), ("t", "q", "a", "1", 1)], "entity_id string, record_id string, attribute string, value string, ord int")
    got = store.assert_facts(f, "ord")
    assert rows(got) == [("t", "q", "a", "1"), ("t", "r", "a", "2"), ("t", "r", "b", None)] and store.retract(got, "r").count() == 1
    with pytest.raises(NotImplementedError):
        store.retract(got, "r", "a")


def events(spark, data):
    return spark.createDataFrame([("t", i, f"{n:06d}", k, t, "clash") for n, (i, k, t) in enumerate(data)], "entity_id string, item_id string, doc_id string, type string, at_ns bigint, cluster_no string")


@pytest.mark.parametrize("times,window,least,want", [
    ((0, 3, 5), 10, 3, [3]), ((0, 5), 100, 3, []), ((0, 10, 20), 5, 3, []), ((0, 1, 2, 100, 101, 102), 5, 3, [3, 3]), ((0, 1, 2, 3, 4), 10, 3, [5]), ((0, 1, 2, 3, 100, 101, 102), 10, 3, [4, 3]),
    ((0, 10**6, 5 * 10**9), 0, 2, [3]), ((0, 100, 200), 1, 1, [1, 1, 1]), ((), 10, 1, []), ((0, 1), 100, 5, []),
])
def test_clusters(spark, times, window, least, want):
    got = temporal.clusters(events(spark, [("i", "f", t) for t in times]), [], window, least)
    assert [r.n for r in got.groupBy("cluster_no").agg(F.count("*").alias("n")).orderBy("cluster_no").collect()] == want


def plain_clusters(times, window, least):
    out, i = [], 0
    while i < len(times):
        j = i
        while j + 1 < len(times) and times[j + 1] - times[i] <= window:
            j += 1
        if j - i + 1 >= least:
            out.append(times[i : j + 1])
            i = j + 1
        else:
            i += 1
    return out


def plain_sequence(own, steps, window):
    for s, (t, k) in enumerate(own):
        if k == steps[0]:
            found, i = [t], s + 1
            for step in steps[1:]:
                while i < len(own) and own[i][1] != step:
                    i += 1
                if i == len(own):
                    break
                found.append(own[i][0])
                i += 1
            if len(found) == len(steps) and (window <= 0 or found[-1] - found[0] <= window):
                return found
    return None


@pytest.mark.parametrize("seed", range(3))
def test_clusters_and_sequences_against_plain(spark, seed):
    r = random.Random(seed)
    data = [("hot" if r.random() < 0.4 else f"i{r.randrange(20)}", r.choice("abc"), r.randrange(300)) for _ in range(500)]
    df = events(spark, data + [(None, "a", 1), ("i1", None, 1), ("i1", "a", None)])
    by = {}
    for n, (i, k, t) in enumerate(data):
        by.setdefault(i, []).append((t, n, k))
    own = {i: [(t, k) for t, _, k in sorted(x)] for i, x in by.items()}
    got = {}
    for x in temporal.clusters(df, ["a", "b"], 7, 3).orderBy("item_id", "cluster_no", "pos").collect():
        got.setdefault(x.item_id, {}).setdefault(x.cluster_no, []).append(x.at_ns)
    want = {i: plain_clusters([t for t, k in x if k in "ab"], 7, 3) for i, x in own.items()}
    assert {i: list(x.values()) for i, x in got.items()} == {i: x for i, x in want.items() if x}
    for window, least in ((7, 3), (2, 1), (60, 25), (1, 2), (400, 4), (3, 9)):
        whole = rows(temporal.clusters(df, [], window, least))
        assert rows(temporal.clusters(df, [], window, least, rows_per_chunk=17)) == whole, (window, least)
        assert sum(len(c) for x in own.values() for c in plain_clusters([t for t, _ in x], window, least)) == len(whole)
    for steps, window in ((list("abc"), 20), (list("aab"), 15), (list("ab"), 4), (list("abc"), 0), (["c"], 5)):
        seq = {}
        for x in temporal.sequences(df, steps, window).orderBy("item_id", "pos").collect():
            seq.setdefault(x.item_id, []).append(x.at_ns)
        assert seq == {i: s for i, x in own.items() if (s := plain_sequence(x, steps, window))}, (steps, window)
    assert temporal.sequences(df, [], 5).count() == 0


def test_two_step_sequence(spark):
    day = 86_400_000_000_000
    df = events(spark, [("truck-1", "inspect", 0), ("truck-1", "fault", 10 * day), ("truck-2", "fault", 0), ("truck-2", "inspect", day), ("truck-3", "inspect", 0), ("truck-3", "fault", 200 * day)])
    assert rows(temporal.followed_by(df, "inspect", "fault", 30 * day)) == [("t", "truck-1", 0, 10 * day)]
    assert [r.item_id for r in temporal.sequences(df, ["inspect", "fault"], 30 * day).where("pos = 1").collect()] == ["truck-1"]


def test_windows_and_counts(spark):
    df = events(spark, [("i1", "inspect", 1000), ("i1", "repair", 2000), ("i1", "inspect", 3000)])
    assert [r.at_ns for r in temporal.window_query(df, "t", "i1", ["inspect"]).collect()] == [1000, 3000] and temporal.window_query(df, "t", "i1").count() == 3 and temporal.window_query(df, "t", "no").count() == 0 and temporal.window_query(df, "u", "i1").count() == 0
    assert rows(temporal.last_seen(df)) == [("t", "i1", "inspect", 3000), ("t", "i1", "repair", 2000)]
    assert temporal.absent_since(df, "repair", 2500).count() == 1 and temporal.absent_since(df, "inspect", 2500).count() == 0
    assert rows(temporal.group_count(df, ["type"])) == [("t", "i1", "type", "inspect", 2, 1000, 3000), ("t", "i1", "type", "repair", 1, 2000, 2000)]


def test_a_hot_item_of_many_events(spark):
    """Time in proportion to the events, though a window holds thousands of them."""
    n = 200_000
    df = spark.range(n).select(F.lit("t").alias("entity_id"), F.lit("i").alias("item_id"), F.lpad(F.col("id").cast("string"), 9, "0").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("type"), (F.col("id") * 10).alias("at_ns"))
    assert temporal.clusters(df, [], 100_000, 50).agg(F.max("cluster_no"), F.count("*")).first()[:] == (20, n)
    assert temporal.clusters(df, [], 100_000, 50, rows_per_chunk=30_000).agg(F.max("cluster_no"), F.count("*")).first()[:] == (20, n)
    assert temporal.sequences(df, ["a", "c"], 100_000).count() == 0
    assert rows(temporal.sequences(df, ["a", "b", "b", "a"], 100_000).select("pos", "at_ns")) == [(1, 0), (2, 10), (3, 20), (4, 30)]
    assert rows(temporal.followed_by(df, "a", "b", 100_000)) == [("t", "i", 0, 10)] == rows(temporal.followed_by(df, "a", "b", 0))


def test_events_and_groups_of_bodies(spark):
    d = docs(spark, {
        "a": '{"item_id":"item-1","type":"inspect","at":100,"outcome":"pass","n":1.0,"list":[1],"none":null}', "b": '{"item_id":"item-1","type":"inspect","at":200,"outcome":"fail"}', "c": '{"item_id":"item-1","type":"inspect","at":"1970-01-01T00:00:00.000000300Z","outcome":"pass"}',
        "d": '{"item_id":"item-2","type":"inspect","at":400.7,"outcome":"pass"}', "e": '{"item_id":"item-1","outcome":"pass"}', "f": '{"item_id":7,"type":"inspect","at":1}', "g": '{"item_id":"item-1","type":"x","at":"soon"}', "h": "[]", "i": None, "j": "{}",
    })
    assert rows(body_events(d)) == [("tenant-a", "item-1", "a", "inspect", 100), ("tenant-a", "item-1", "b", "inspect", 200), ("tenant-a", "item-1", "c", "inspect", 300), ("tenant-a", "item-2", "d", "inspect", 400)]
    got = {(r.item_id, r.attr, r.value): (r.n, r.first_ns, r.last_ns) for r in temporal.group_count_bodies(d).collect()}
    assert got[("item-1", "type", "inspect")] == (3, 100, 300) and got[("item-1", "outcome", "pass")] == (3, 100, 300) and got[("item-1", "n", "1")] == (1, 100, 100) and got[("item-1", "type", "x")] == (1, None, None)
    assert ("item-1", "list", "[1]") not in got and not any(k[1] in ("item_id", "none") or k[0] == "7" for k in got)
    assert ids(temporal.group_documents(d, "tenant-a", "item-1", "outcome", "pass")) == ["a", "c", "e"]


VEC = "entity_id string, scope_name string, vec_id string, v array<float>"


def test_vectors(spark):
    v = spark.createDataFrame([("t", "s", "a", [1.0, 0.0, 0.0]), ("t", "s", "b", [0.0, 1.0, 0.0]), ("t", "s", "c", [0.0, 0.0, 1.0]), ("t", "s", "z", [0.0, 0.0, 0.0]), ("t", "s", "n", None), ("t", "s", "short", [1.0])], VEC)
    q = spark.createDataFrame([("q", [1.0, 0.0, 0.0])], "query_id string, v array<float>")
    assert [(r.vec_id, r.distance) for r in vectors.search(v, q, 2).orderBy("rank").collect()] == [("a", 0.0), ("b", 1.0)]
    assert vectors.search(v, q, 50).count() == 3 and vectors.search(v, q, 0).count() == 0 and vectors.search(v, q, 50, "euclidean").count() == 4
    none = spark.createDataFrame([], "entity_id string, scope_name string, dim int, metric string")
    three = v.where("vec_id in ('a', 'b', 'c')").withColumn("no", F.lit(1))
    stored, registry = vectors.insert(v.limit(0), none, three, "no")
    assert [tuple(r) for r in vectors.scopes(stored, registry).collect()] == [("t", "s", 3, "cosine", 3)]
    with pytest.raises(ValueError):
        vectors.insert(stored, registry, v.where("vec_id = 'short'").withColumn("no", F.lit(1)), "no")
    again, _ = vectors.insert(stored, registry, spark.createDataFrame([("t", "s", "a", [5.0, 0.0, 0.0], 2), ("t", "s", "a", [6.0, 0.0, 0.0], 1)], VEC + ", no int"), "no")
    assert again.count() == 3 and again.where("vec_id = 'a'").first().v == [5.0, 0.0, 0.0]
    left = vectors.delete(stored, "t", "s", "a")
    assert left.count() == 2 and [r.n for r in vectors.scopes(left.limit(0), registry).collect()] == [0]
    with pytest.raises(KeyError):
        vectors.delete(left, "t", "s", "a")
    assert [x.count() for x in vectors.drop_scope(stored, registry, "t", "s")] == [0, 0]


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="no test data")
def test_cosine_over_the_query_set(spark):
    got = [(r.query_id, r["rank"], r.vec_id, r.distance) for r in reference_queries.QUERIES["vector_cosine_batch"](spark, "/root/testdata/sf0.01").collect()]
    by = {str(r.vec_id): np.array(r.embedding, np.float64) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()}
    names, x = list(by), np.array(list(by.values()))
    x = x / np.linalg.norm(x, axis=1)[:, None]
    queries = [n for n in names if int(n) % 20 == 0]
    assert len(queries) > 1 and {(q, k) for q, k, _, _ in got} == {(q, k) for q in queries for k in range(1, 11)} and len(got) == 10 * len(queries)
    near = {q: np.sort(1 - x @ x[names.index(q)]) for q in queries}
    assert all(abs(d - near[q][k - 1]) < 2e-5 and abs(d - (1 - x[names.index(q)] @ x[names.index(v)])) < 2e-5 for q, k, v, d in got)


LOG = "seq bigint, entity_id string, doc_id string, deleted boolean, body string"


def test_feed(spark):
    w = spark.createDataFrame([(1, "t", "doc-1", False, '{"v":1}'), (2, "t", "doc-1", None, '{"v":2}'), (3, "t", "doc-1", True, None), (4, "t", "doc-1", True, None), (5, "u", "ticket-1", False, "x"), (5, "u", "ticket-1", False, "x"), (None, "u", "a", False, "x")], LOG)
    assert [tuple(r) for r in feed.classify(w).orderBy("seq").select("kind", "old_doc", "new_doc").collect()] == [("assert", None, '{"v":1}'), ("change", '{"v":1}', '{"v":2}'), ("retract", '{"v":2}', None), ("assert", None, "x")]
    assert feed.subscribe(feed.classify(w), "t").count() == 3 and feed.subscribe(feed.classify(w), None, "ticket-").count() == 1
    assert [tuple(r) for r in feed.replay(w).collect()] == [("u", "ticket-1", 5, "x")]
    log = feed.number(w.select(F.lit(1).alias("at_ns"), "entity_id", "doc_id"), 10)
    assert sorted(r.seq for r in log.collect()) == list(range(11, 18))
    assert sorted(r.seq for r in feed.trim(log, 3).collect()) == [15, 16, 17] and [r.seq for r in feed.tail(log, 16).collect()] == [16, 17]
    with pytest.raises(LookupError):
        feed.tail(log, 5).collect()
    assert tuple(feed.status(log, 4).first()) == (17, 11, 4)


def test_streams(spark, tmp_path):
    rows_ = [(i, i, "t", f"d{i % 3}", "retract" if i % 7 == 0 else "change", i, None, f"n{i}") for i in range(1, 30)]
    ddl = "feed_no bigint, seq bigint, entity_id string, doc_id string, kind string, at_unix_nanos bigint, old_doc string, new_doc string"
    spark.createDataFrame(rows_, ddl).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    state = CurrentState(spark, fresh_dir(spark, "follow"))
    feed.follow(stream, state, str(tmp_path / "checkpoint")).awaitTermination()
    batch = CurrentState(spark, fresh_dir(spark, "batch"))
    batch.apply(spark.createDataFrame(rows_, ddl))
    assert rows(state.documents()) == rows(batch.documents()) and state.documents().count() == 2

    writes = spark.createDataFrame([(i, "t", f"d{i % 3}", i % 5 == 0, f"b{i}") for i in range(1, 40)], LOG)
    writes.coalesce(1).write.parquet(str(tmp_path / "writes"))
    live = feed.classify_stream(spark.readStream.schema(LOG).parquet(str(tmp_path / "writes")))
    live.writeStream.format("memory").queryName("classified").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.table("classified")) == rows(feed.classify(writes))


def classified(spark, tmp_path, batches):
    """What classify_stream puts out for micro-batches of files of writes."""
    for batch in batches:
        for part in batch:
            spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live = feed.classify_stream(spark.readStream.schema(LOG).parquet(str(tmp_path / "in")))
        live.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_stream_of_one_hot_document(spark, tmp_path):
    writes = [(i, "t", "hot", i % 7 == 0, f"b{i}") for i in range(-2, 25_000)]
    random.Random(1).shuffle(writes)
    first, rest = [w for w in writes if w[0] < 24_000], [w for w in writes if w[0] >= 24_000]
    batches = [[first[k::4] for k in range(4)], [rest, first[:50]]]  # the second gives some writes again
    got = classified(spark, tmp_path, batches)
    assert rows(got) == rows(feed.classify(spark.createDataFrame(writes, LOG)))


def test_stream_out_of_order_raises(spark, tmp_path):
    with pytest.raises(Exception, match="came after write 5"):
        classified(spark, tmp_path, [[[(5, "t", "a", False, "x")]], [[(3, "t", "a", False, "y")]]])


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no test data")
@pytest.mark.parametrize("name,pushed", [
    ("query_pattern", ["EqualTo(event_type,click)"]),
    ("query_predicate_num", ["GreaterThan(value,20.0)", "LessThanOrEqual(value,60.0)"]),
    ("query_predicate_eq_ne", ["EqualTo(user_id,7)", "Not(EqualTo(event_type,click))"]),
    ("query_starts_with", ["StringStartsWith(source,fan)"]),
    ("query_ends_with", ["StringEndsWith(source,ocr)"]),
    ("query_contains", ["StringContains(text,harbour)"]),
    ("query_not", ["EqualTo(user_id,3)"]),
])
def test_conditions_reach_the_source(spark, name, pushed):
    plan = reference_queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PushedFilters") :].split("]")[0]
    assert all(p in filters for p in pushed), filters


def test_integers_compare_as_doubles_do(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([-3, -2, 0, 1, 2, 3, 2**53, 2**53 + 1])], "id bigint, n bigint")
    f = Facts(df, "id", {":t": F.lit("x"), ":n": F.col("n")})
    for op, test in {"<": float.__lt__, "<=": float.__le__, ">": float.__gt__, ">=": float.__ge__, "==": float.__eq__}.items():
        for number in (-2.5, -2, 0.0, 1.5, 2, 2**53, 1e300, float("inf")):
            want = [r.id for r in df.collect() if test(float(r.n), float(number))]
            assert ids(query(f, ["?e"], [Pattern("?e", ":t", "x"), Pattern("?e", ":n", "?n"), Predicate("?n", op, number)])) == want
            turned = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "==": "=="}[op]
            assert ids(query(f, ["?e"], [Pattern("?e", ":t", "x"), Not([Not([Pattern("?e", ":n", "?n"), Predicate(number, turned, "?n")])])])) == want


def test_intervals_are_merged():
    n = Pattern("?e", ":n", "?n")
    several = [Predicate("?n", ">", 1), n, Predicate("?n", ">", 2), Predicate(9, ">", "?n"), Predicate("?n", ">=", 2), Predicate("?n", "!=", 5)]
    assert narrowed(several) == [several[0], n, Predicate("?n", ">", 2), Predicate("?n", "<", 9), several[-1]]
    assert narrowed([n, Predicate("?n", ">=", 2), Predicate("?n", "<=", 2)]) == [n, Predicate("?n", "==", 2)]
    assert narrowed([n, Predicate("?n", ">=", 2), Predicate("?n", "<", 2)]) is None


def test_rules_anywhere(spark):
    f = facts(spark)
    edges = spark.createDataFrame([("Vehicles", "All"), ("Trucks", "Vehicles"), ("Buildings", "All")], "child string, parent string")
    name, call = Pattern("?e", ":name", "?c"), RuleCall("?c", "Vehicles")
    run = lambda *where: [int(e) for e in ids(query(f, ["?e"], [ITEM, *where], edges=edges))]
    assert run(name, call) == [501] and run(Or([[name, call], [Pattern("?e", ":status", "scheduled")]])) == [501, 503]
    assert run(name, Not([call])) == [502] and run(call) == []
    assert [r.doc_id for r in pull(f, [":name"], [ITEM, name, call], edges=edges).collect()] == [501]
    step = [Pattern("?e", ":category/parent", "?p"), RuleCall("?p", "?r")]
    rules = [Rule("category-in-tree", [Pattern("?e", ":category/name", "?c")]), Rule("category-in-tree", step)]
    assert query(f, ["?e"], [ITEM, name, call], edges=edges, rules=rules).count() == 1
    for wrong in (rules[:1], rules[1:], [rules[0], rules[0]], [*rules, rules[0]]):
        with pytest.raises(ValueError):
            query(f, ["?e"], [ITEM, name, call], edges=edges, rules=wrong)
    with pytest.raises(ValueError):
        query(f, ["?e"], [ITEM, name, RuleCall("?c", "?d")], edges=edges, rules=rules)


def test_clauses_as_dictionaries():
    where = [ITEM, KM, Pattern("?e", ":x"), Predicate("?k", ">", 5), Or([[ITEM], [Not([KM])]]), FullText("a", ":b"), FullText("c"), RuleCall("?c", "R"), Predicate(Lit("?k"), "==", True)]
    assert wire.from_dicts(json.loads(json.dumps(wire.to_dicts(where)))) == where
    for bad in ([{"join": {}}], [{}], [{"pattern": {"value": {"literal": 1}}}], [{"pattern": {"attribute": "a", "value": {}}}], [3], [{"pattern": {"attribute": "a", "value": {"var": "x"}}}]):
        with pytest.raises(ValueError):
            wire.from_dicts(bad)
    with pytest.raises(ValueError):
        wire.to_dicts(["x"])


def test_vectors_by_scope_and_in_blocks(spark, monkeypatch):
    g = np.random.default_rng(3)
    x = g.standard_normal((300, 6)).astype(np.float32)
    v = spark.createDataFrame([("t", "s", f"v{i:03d}", x[i].tolist()) for i in range(300)], VEC)
    registry = spark.createDataFrame([("t", "s", 6, "Euclidean")], "entity_id string, scope_name string, dim int, metric string")
    assert [r.vec_id for r in vectors.search_scope(v, registry, "t", "s", x[7].tolist(), 3).orderBy("rank").collect()][0] == "v007"
    for wrong, error in ((("t", "none", [1.0] * 6), KeyError), (("t", "s", []), ValueError), (("t", "s", [1.0]), ValueError)):
        with pytest.raises(error):
            vectors.search_scope(v, registry, *wrong, 3)
    q = v.where("vec_id < 'v040'").select(F.col("vec_id").alias("query_id"), "v")
    whole = rows(vectors.search(v, q, 4).select("query_id", "vec_id", "rank"))
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 15)
    monkeypatch.setattr(vectors, "VECTOR_PART", 50)
    assert rows(vectors.search(v, q, 4).select("query_id", "vec_id", "rank")) == whole and len(whole) == 160


def test_replica(spark):
    log = [(i + 1, "t", f"d{i % 7}", i % 5 == 4, None if i % 5 == 4 else f"b{i}") for i in range(40)]
    make = lambda x: spark.createDataFrame(x, "seq bigint, entity_id string, doc_id string, deleted boolean, body string")
    want = lambda n: rows(feed.replay(make(log[:n])).select("doc_id", "seq", "body"))
    have = lambda r: rows(r.documents().select("doc_id", "seq", "body"))
    early, late = fresh_dir(spark, "s"), fresh_dir(spark, "s")
    feed.write_snapshot(feed.replay(make(log[:10])), 10, early)
    feed.write_snapshot(feed.replay(make(log[:35])), 35, late)
    r = feed.Replica(spark, fresh_dir(spark, "r"))
    assert r.applied_seq() is None and have(r) == []
    with pytest.raises(LookupError):
        r.catch_up(make(log), fresh_dir(spark, "none"))
    r.catch_up(make(log[:20]), early)
    assert r.applied_seq() == 20 and have(r) == want(20)
    r.catch_up(make(log[12:25]), early)
    r.catch_up(make(log[12:25]), early)  # again
    assert r.applied_seq() == 25 and have(r) == want(25)
    r.catch_up(make(log[30:]), late)  # the log no longer has what comes next
    assert r.status(make(log[30:])).first()[:] == (40, 31, 40) and have(r) == want(40)
    with pytest.raises(PermissionError):
        r.put("t", "d", "{}")


def test_hierarchy_of_a_tenant(spark):
    d = docs(spark, {"BigRigs": '{"parent":"Trucks"}', "Trucks": '{"parent":"Vehicles"}', "Sedans": '{"parent":"Vehicles"}', "Vehicles": "{}", "x": '{"parent":7}', "y": '{"parent":""}', "z": None})
    edges = closure.body_edges(d.unionByName(spark.createDataFrame([("other", "Trucks", '{"parent":"Toys"}')], "entity_id string, doc_id string, body string")))
    assert [r.node for r in closure.ancestors(edges, "BigRigs", "tenant-a").orderBy("depth").collect()] == ["Trucks", "Vehicles"]
    assert ids(closure.descendants(edges, "Vehicles", "tenant-a")) == ["BigRigs", "Sedans", "Trucks"] and ids(closure.descendants(edges, "Toys", "tenant-a")) == []
