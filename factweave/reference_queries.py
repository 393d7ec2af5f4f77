"""Queries of the store's own operators over the data folder's tables, and the SQL that gives the same rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.operators import closure, lookup, store, temporal, vectors
from factweave.operators.query import matching, pull, query, query_as_of
from factweave.plans import wire
from factweave.plans.shared import fresh_dir
from factweave.plans.clauses import Aggregate, FullText, Not, Or, Pattern, Predicate, RuleCall
from factweave.sources import views
from factweave.sources.tables import table
from factweave.streaming import feed

TENANT = "harbor-east"
ITEM = "gantry-1"
#: Instants in the test data's time span.
MIDDLE, LATE = 1_610_000_000_000_000_000, 1_610_600_000_000_000_000
DAY = 86_400_000_000_000

QUERIES, SQL = {}, {}


def registered(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


EVENT = Pattern("?e", ":record/type", "event")


@registered("select cast(event_id as double) as e, value as v from events where event_type = 'click'")
def query_pattern(spark: SparkSession, d: str) -> DataFrame:
    return query(views.event_facts(spark, d), ["?e", "?v"], [Pattern("?e", ":event/type", "click"), Pattern("?e", ":event/value", "?v")])


@registered("select cast(event_id as double) as e, value as v from events where value > 20 and value <= 60")
def query_predicate_num(spark: SparkSession, d: str) -> DataFrame:
    return query(views.event_facts(spark, d), ["?e", "?v"], [EVENT, Pattern("?e", ":event/value", "?v"), Predicate("?v", ">", 20), Predicate(60, ">=", "?v")])


@registered("select cast(event_id as double) as e from events where value > 100 and value < 50")
def query_contradiction(spark: SparkSession, d: str) -> DataFrame:
    return query(views.event_facts(spark, d), ["?e"], [EVENT, Pattern("?e", ":event/value", "?v"), Predicate("?v", ">", 100), Predicate("?v", "<", 50)])


@registered("select cast(event_id as double) as e, event_type as t, cast(user_id as double) as u from events where user_id = 7 and event_type <> 'click'")
def query_predicate_eq_ne(spark: SparkSession, d: str) -> DataFrame:
    where = [EVENT, Pattern("?e", ":event/user", "?u"), Pattern("?e", ":event/type", "?t"), Predicate("?u", "==", 7), Predicate("?t", "!=", "click"), Predicate("?t", "!=", 7)]
    return query(views.event_facts(spark, d), ["?e", "?t", "?u"], where)


@registered("select cast(doc_id as double) as e, source as s from documents where source like 'fan%'")
def query_starts_with(spark: SparkSession, d: str) -> DataFrame:
    return query(views.text_facts(spark, d), ["?e", "?s"], [Pattern("?e", ":record/type", "document"), Pattern("?e", ":doc/source", "?s"), Predicate("?s", "starts_with", "fan")])


@registered("select cast(doc_id as double) as e from documents where source like '%_ocr'")
def query_ends_with(spark: SparkSession, d: str) -> DataFrame:
    return query(views.text_facts(spark, d), ["?e"], [Pattern("?e", ":record/type", "document"), Pattern("?e", ":doc/source", "?s"), Predicate("?s", "ends_with", "ocr")])


@registered("select cast(doc_id as double) as e from documents where contains(text, 'harbour')")
def query_contains(spark: SparkSession, d: str) -> DataFrame:
    return query(views.text_facts(spark, d), ["?e"], [Pattern("?e", ":record/type", "document"), Pattern("?e", ":doc/text", "?t"), Predicate("?t", "contains", "harbour")])


@registered("select cast(doc_id as double) as e from documents where len(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, 'What now'))) > 0")
def query_list_any(spark: SparkSession, d: str) -> DataFrame:
    return query(views.text_facts(spark, d), ["?e"], [Pattern("?e", ":record/type", "document"), Pattern("?e", ":doc/lines", "?l"), Predicate("?l", "starts_with", "What now")])


@registered("""select cast(event_id as double) as e, case when event_type = 'error' then value end as v, case when event_type <> 'error' then cast(user_id as double) end as u
    from events where event_type in ('error', 'signup')""")
def query_or_bindings(spark: SparkSession, d: str) -> DataFrame:
    either = Or([[Pattern("?e", ":event/type", "error"), Pattern("?e", ":event/value", "?v")], [Pattern("?e", ":event/type", "signup"), Pattern("?e", ":event/user", "?u")]])
    return query(views.event_facts(spark, d), ["?e", "?v", "?u"], [EVENT, either])


@registered("select cast(event_id as double) as e from events where not (event_type = 'click' and value > 10) and user_id = 3")
def query_not(spark: SparkSession, d: str) -> DataFrame:
    no = Not([Pattern("?e", ":event/type", "click"), Pattern("?e", ":event/value", "?v"), Predicate("?v", ">", 10)])
    return query(views.event_facts(spark, d), ["?e"], [Pattern("?e", ":event/user", 3), no])


@registered("select cast(doc_id as double) as e from documents where contains(lower(text), 'lighthouse')")
def query_fulltext_attr(spark: SparkSession, d: str) -> DataFrame:
    return query(views.text_facts(spark, d), ["?e"], [Pattern("?e", ":record/type", "document"), FullText("LightHouse", ":doc/text")])


@registered("select cast(doc_id as double) as e from documents where contains(lower(coalesce(text, '') || chr(1) || coalesce(lang, '') || chr(1) || coalesce(source, '') || chr(1) || coalesce(title_id, '') || chr(1) || 'document'), 'upload')")
def query_fulltext_any(spark: SparkSession, d: str) -> DataFrame:
    return query(views.text_facts(spark, d), ["?e"], [Pattern("?e", ":record/type", "document"), FullText("upload")])


@registered("select cast(event_id as double) as e from events where value = cast(json_extract_string(props, '$.k') as double)")
def query_unify(spark: SparkSession, d: str) -> DataFrame:
    return query(views.event_facts(spark, d), ["?e"], [EVENT, Pattern("?e", ":event/value", "?x"), Pattern("?e", ":event/k", "?x")])


@registered("select cast(doc_id as double) as e from documents where lang is not null and source is not null")
def query_wildcard(spark: SparkSession, d: str) -> DataFrame:
    return query(views.text_facts(spark, d), ["?e"], [Pattern("?e", ":record/type", "document"), Pattern("?e", ":doc/lang"), Pattern("?e", ":doc/source")])


@registered("select cast(event_id as double) as e, cast(null as varchar) as x from events where event_type = 'view'")
def query_unbound_ne(spark: SparkSession, d: str) -> DataFrame:
    where = [Pattern("?e", ":event/type", "view"), Predicate("?x", "!=", 5), Not([Predicate("?x", "<", 5)])]
    return query(views.event_facts(spark, d), ["?e", "?x"], where)


AGGREGATES = [Aggregate("count", "?e", "n"), Aggregate("sum", "?v", "total"), Aggregate("avg", "?v", "mean"), Aggregate("min", "?v", "low"), Aggregate("max", "?v", "high")]
_AGGREGATES_SQL = "cast(count(*) as double) as n, coalesce(sum(value), 0.0) as total, coalesce(avg(value), 0.0) as mean, min(value) as low, max(value) as high"


def _rounded(df: DataFrame) -> DataFrame:
    """Sums of doubles depend on the order of rows; six digits don't."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@registered(f"select n, round(total, 6) as total, round(mean, 6) as mean, low, high from (select {_AGGREGATES_SQL} from events)")
def query_agg_global(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(query(views.event_facts(spark, d), where=[EVENT, Pattern("?e", ":event/value", "?v")], aggregates=AGGREGATES))


@registered(f"select {_AGGREGATES_SQL} from events where event_type = 'nothing'")
def query_agg_empty(spark: SparkSession, d: str) -> DataFrame:
    return query(views.event_facts(spark, d), where=[Pattern("?e", ":event/type", "nothing"), Pattern("?e", ":event/value", "?v")], aggregates=AGGREGATES)


@registered(f"select t, n, round(total, 6) as total, round(mean, 6) as mean, low, high from (select event_type as t, {_AGGREGATES_SQL} from events where value > 10 group by event_type)")
def query_agg_group(spark: SparkSession, d: str) -> DataFrame:
    where = [EVENT, Pattern("?e", ":event/type", "?t"), Pattern("?e", ":event/value", "?v"), Predicate("?v", ">", 10)]
    return _rounded(query(views.event_facts(spark, d), where=where, aggregates=AGGREGATES, group_by=["?t"]))


@registered("select cast(c_custkey as double) as e, 'N' || c_nationkey as c from customer join nation on n_nationkey = c_nationkey where n_regionkey = 2 and c_mktsegment = 'BUILDING'")
def query_rule_in_tree(spark: SparkSession, d: str) -> DataFrame:
    where = [Pattern("?e", ":customer/segment", "BUILDING"), Pattern("?e", ":category/name", "?c"), RuleCall("?c", "R2")]
    return query(views.customer_facts(spark, d), ["?e", "?c"], where, edges=views.nation_edges(spark, d))


@registered("""select doc_id, case when source is null and lang is null then '{}' when source is null then '{":doc/lang":"' || lang || '"}'
    when lang is null then '{":doc/source":"' || source || '"}' else '{":doc/source":"' || source || '",":doc/lang":"' || lang || '"}' end as pulled
    from documents where title_id = 'show-00042'""")
def query_pull(spark: SparkSession, d: str) -> DataFrame:
    return pull(views.text_facts(spark, d), [":doc/source", ":doc/lang"], [Pattern("?e", ":doc/title", "show-00042")])


# Documents with JSON bodies.
_AS_OF = lambda at: f"""(select entity_id, doc_id, max(at_ns) as at_ns, arg_max(body, (at_ns, seq)) as body, arg_max(coalesce(deleted, false), (at_ns, seq)) as gone, arg_max(seq, (at_ns, seq)) as seq
    from (select entity_id, doc_id, at_ns, seq, deleted, coalesce(body, '') as body from doc_version where at_ns is not null and at_ns <= {at}) group by entity_id, doc_id)"""  # noqa: E731
_CURRENT = f"(select entity_id, doc_id, at_ns, seq, nullif(body, '') as body from {_AS_OF(2**63 - 1)} where not gone)"
_OBJECTS = f"(select * from {_CURRENT} where json_valid(body) and json_type(body) = 'OBJECT')"
_E = "case when try_cast(doc_id as bigint) is not null then cast(cast(try_cast(doc_id as bigint) as double) as varchar) else doc_id end"


@registered(f"select entity_id, doc_id, at_ns, seq, body from {_CURRENT}")
def current_state(spark: SparkSession, d: str) -> DataFrame:
    return views.current_documents(spark, d)


@registered(f"select doc_id, seq from {_AS_OF(MIDDLE)} where not gone and entity_id = '{TENANT}'")
def state_as_of(spark: SparkSession, d: str) -> DataFrame:
    return store.as_of(table(spark, d, "doc_version").where(F.col("entity_id") == TENANT), MIDDLE).select("doc_id", "seq")


@registered(f"select json_extract_string(body, '$.item_id') as i, cast(json_extract_string(body, '$.km') as double) as k from {_AS_OF(MIDDLE)} where not gone and json_valid(body) and json_extract_string(body, '$.status') = 'active' and cast(json_extract_string(body, '$.km') as double) > 50000")
def query_as_of_bodies(spark: SparkSession, d: str) -> DataFrame:
    where = [Pattern("?e", "status", "active"), Pattern("?e", "item_id", "?i"), Pattern("?e", "km", "?k"), Predicate("?k", ">", 50000)]
    return query_as_of(table(spark, d, "doc_version"), MIDDLE, views.body_facts, find=["?i", "?k"], where=where).select(F.col("i"), F.try_variant_get(F.try_parse_json("k"), "$", "double").alias("k"))


@registered(f"select json_extract_string(body, '$.status') as s, cast(count(*) as double) as n, sum(cast(json_extract_string(body, '$.km') as double)) as total from {_AS_OF(MIDDLE)} where not gone and json_valid(body) and json_exists(body, '$.status') and json_exists(body, '$.km') group by 1")
def query_as_of_agg(spark: SparkSession, d: str) -> DataFrame:
    where = [Pattern("?e", "status", "?s"), Pattern("?e", "km", "?k")]
    return query_as_of(table(spark, d, "doc_version"), MIDDLE, views.body_facts, where=where, aggregates=[Aggregate("count", "?e", "n"), Aggregate("sum", "?k", "total")], group_by=["?s"])


@registered("""with v as (select distinct entity_id, doc_id, at_ns, seq, coalesce(deleted, false) as gone from doc_version where at_ns is not null),
    g as (select entity_id, doc_id, max((at_ns, seq)) as last from v where gone group by all)
    select entity_id, doc_id, max(at_ns) as updated_at_ns, min(at_ns) as created_at_ns, count(*) as version from v left join g using (entity_id, doc_id)
    where not gone and (last is null or (at_ns, seq) > last) group by entity_id, doc_id""")
def last_written(spark: SparkSession, d: str) -> DataFrame:
    return store.last_written(table(spark, d, "doc_version"))


_LEAF = f"(select entity_id, doc_id, k as key, json_type(body, '$.' || k) as kind, json_extract_string(body, '$.' || k) as s from (select *, unnest(json_keys(body)) as k from {_OBJECTS}))"
_LEAF_THEN = _LEAF.replace(_CURRENT, f"(select entity_id, doc_id, nullif(body, '') as body from {_AS_OF(MIDDLE)} where not gone)")
_TEXT = "case when kind in ('UBIGINT', 'BIGINT', 'DOUBLE') then cast(cast(cast(s as double) as bigint) as varchar) else s end"


@registered(f"select distinct entity_id, doc_id, term from (select entity_id, doc_id, {_TEXT} as term from {_LEAF} union all select entity_id, doc_id, key || ':' || {_TEXT} from {_LEAF}) where term <> ''")
def term_extract(spark: SparkSession, d: str) -> DataFrame:
    return lookup.terms(views.current_documents(spark, d))


@registered(f"select entity_id, doc_id, key as attr, cast(s as double) as num from {_LEAF} where kind in ('UBIGINT', 'BIGINT', 'DOUBLE')")
def numeric_extract(spark: SparkSession, d: str) -> DataFrame:
    return lookup.numbers(views.current_documents(spark, d))


@registered(f"select distinct doc_id from {_LEAF} where entity_id = '{TENANT}' and s = 'active'")
def lookup_term(spark: SparkSession, d: str) -> DataFrame:
    return lookup.lookup(views.current_documents(spark, d), TENANT, "active")


@registered(f"select distinct doc_id from {_LEAF} where entity_id = '{TENANT}' and key = 'category' and starts_with(s, 'p')")
def lookup_prefix(spark: SparkSession, d: str) -> DataFrame:
    return lookup.lookup_prefix(views.current_documents(spark, d), TENANT, "category:p")


@registered(f"select doc_id from {_OBJECTS} where entity_id = '{TENANT}' and json_extract_string(body, '$.status') = 'active' and json_extract_string(body, '$.category') = 'hauling'")
def lookup_intersect(spark: SparkSession, d: str) -> DataFrame:
    return lookup.lookup_all(views.current_documents(spark, d), TENANT, ["status:active", "category:hauling"])


def _range(name: str, open_low: bool, open_high: bool) -> None:
    sql = f"select distinct doc_id from {_LEAF} where entity_id = '{TENANT}' and key = 'crew' and cast(s as double) {'>' if open_low else '>='} 3 and cast(s as double) {'<' if open_high else '<='} 6"

    def run(spark: SparkSession, d: str) -> DataFrame:
        return lookup.lookup_range(views.current_documents(spark, d), TENANT, "crew", 3, 6, open_low, open_high)

    QUERIES[name], SQL[name] = run, sql


_range("lookup_range_closed", False, False)
_range("lookup_range_open_min", True, False)
_range("lookup_range_open_max", False, True)
_range("lookup_range_open", True, True)


@registered(f"select n, round(mean, 6) as mean, round(m2, 3) as m2, low, high from (select count(*) as n, avg(x) as mean, var_pop(x) * count(*) as m2, min(x) as low, max(x) as high from (select cast(s as double) as x from {_LEAF} where entity_id = '{TENANT}' and key = 'km'))")
def stats(spark: SparkSession, d: str) -> DataFrame:
    return lookup.stats(views.current_documents(spark, d), TENANT, "km").select("n", F.round("mean", 6).alias("mean"), F.round("m2", 3).alias("m2"), "low", "high")


@registered(f"select entity_id, key as attr, count(*) as n, round(stddev_samp(cast(s as double)), 6) as stddev from {_LEAF} where kind in ('UBIGINT', 'BIGINT', 'DOUBLE') group by 1, 2")
def stats_stddev(spark: SparkSession, d: str) -> DataFrame:
    return lookup.stats_all(views.current_documents(spark, d)).select("entity_id", "attr", "n", F.round("stddev", 6).alias("stddev"))


_ALL_TEXTS = "(select json_type(body, '$.' || k) as kind, json_extract_string(body, '$.' || k) as s from (select unnest(json_keys(body)) as k))"


@registered(f"select entity_id, doc_id from {_OBJECTS} where json_extract_string(body, '$.status') = 'active' and exists (select 1 from {_ALL_TEXTS} where kind = 'VARCHAR' and contains(lower(s), 'aul'))")
def query_fulltext_body(spark: SparkSession, d: str) -> DataFrame:
    facts = views.body_facts(views.current_documents(spark, d))
    return matching(facts, [Pattern("?e", "status", "active"), FullText("AUL")], None, None, True)[0].select("entity_id", "doc_id")


@registered(f"select doc_id, json_extract_string(body, '$.category') as category, cast(json_extract_string(body, '$.crew') as double) as crew from {_OBJECTS} where json_extract_string(body, '$.status') = 'active'")
def pull_body(spark: SparkSession, d: str) -> DataFrame:
    pulled = pull(views.body_facts(views.current_documents(spark, d)), ["category", "crew"], [Pattern("?e", "status", "active")])
    v = F.parse_json("pulled")
    return pulled.select("doc_id", F.try_variant_get(v, "$.category", "string").alias("category"), F.try_variant_get(v, "$.crew", "double").alias("crew"))


_IN_R2 = "select n_nationkey from nation where n_regionkey = 2"


@registered(f"""select c_custkey as doc_id, '{{":customer/name":"' || c_name || '"}}' as pulled from customer where c_mktsegment = 'BUILDING' and c_nationkey in ({_IN_R2})""")
def pull_rule(spark: SparkSession, d: str) -> DataFrame:
    where = [Pattern("?e", ":customer/segment", "BUILDING"), Pattern("?e", ":category/name", "?c"), RuleCall("?c", "R2")]
    return pull(views.customer_facts(spark, d), [":customer/name"], where, edges=views.nation_edges(spark, d))


@registered(f"select cast(c_custkey as double) as e from customer where c_mktsegment = 'BUILDING' and (c_nationkey in ({_IN_R2}) or c_acctbal > 9000) and c_nationkey <> 8")
def query_rule_nested(spark: SparkSession, d: str) -> DataFrame:
    where = [Pattern("?e", ":customer/segment", "BUILDING"), Pattern("?e", ":category/name", "?c"), Or([[RuleCall("?c", "R2")], [Pattern("?e", ":customer/balance", "?b"), Predicate("?b", ">", 9000)]]), Not([RuleCall("?c", "N8")])]
    return query(views.customer_facts(spark, d), ["?e"], where, edges=views.nation_edges(spark, d))


@registered("select cast(event_id as double) as e, value as v from events where event_type = 'click' and (value > 50 or not user_id >= 10)")
def query_wire(spark: SparkSession, d: str) -> DataFrame:
    """A query whose clauses come as JSON."""
    where = [Pattern("?e", ":event/type", "click"), Pattern("?e", ":event/value", "?v"), Pattern("?e", ":event/user", "?u"), Or([[Predicate("?v", ">", 50)], [Not([Predicate("?u", ">=", 10)])]])]
    return query(views.event_facts(spark, d), ["?e", "?v"], wire.from_dicts(json.loads(json.dumps(wire.to_dicts(where)))))


# Reading and writing documents.
_FIRST_DOC = f"(select min(doc_id) from doc_version where entity_id = '{TENANT}')"


@registered(f"select doc_id, seq, body from {_CURRENT} where entity_id = '{TENANT}' and doc_id = {_FIRST_DOC}")
def document_get(spark: SparkSession, d: str) -> DataFrame:
    versions = table(spark, d, "doc_version")
    first = versions.where(F.col("entity_id") == TENANT).agg(F.min("doc_id")).first()[0]
    return store.document(versions, TENANT, first).select("doc_id", "seq", "body")


@registered(f"select doc_id, seq, body from {_CURRENT} where entity_id = '{TENANT}'")
def tenant_scan(spark: SparkSession, d: str) -> DataFrame:
    return store.scan(table(spark, d, "doc_version"), TENANT).select("doc_id", "seq", "body")


@registered(f"select doc_id, body from {_CURRENT} where entity_id = '{TENANT}' and doc_id not in ('new-1', 'new-2') union all values ('new-1', '{{\"a\":1}}'), ('new-2', 'opaque')")
def batch_put(spark: SparkSession, d: str) -> DataFrame:
    versions = table(spark, d, "doc_version").select("seq", "entity_id", "doc_id", "at_ns", "deleted", "body")
    new = store.batch_put(spark, TENANT, {"new-1": '{"a":1}', "new-2": "opaque"}, 2**62, 2**61)
    return store.scan(versions.unionByName(new), TENANT).select("doc_id", "body")


@registered("select cast(user_id as varchar) as record_id, cast(event_id as bigint) as ord, event_type as value from events where user_id <> 7")
def retract_record(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "events").select(F.col("user_id").cast("string").alias("record_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("value"))
    return store.retract(facts, "7")


@registered(f"with now as (select distinct entity_id, doc_id, term from (select entity_id, doc_id, {_TEXT} as term from {_LEAF} union all select entity_id, doc_id, key || ':' || {_TEXT} from {_LEAF}) where term <> ''), then_ as (select distinct entity_id, doc_id, term from (select entity_id, doc_id, {_TEXT} as term from {_LEAF_THEN} union all select entity_id, doc_id, key || ':' || {_TEXT} from {_LEAF_THEN}) where term <> '') select 'gained' as side, * from (select * from now except select * from then_) union all select 'lost', * from (select * from then_ except select * from now)")
def term_changes(spark: SparkSession, d: str) -> DataFrame:
    """The index entries that the writes after an instant add and take away."""
    versions = table(spark, d, "doc_version")
    both = lookup.term_changes(store.as_of(versions, MIDDLE), store.as_of(versions))
    side = lambda n: both.select(F.lit(n).alias("side"), "entity_id", "doc_id", F.explode(n).alias("term"))
    return side("gained").unionByName(side("lost"))


# Events of items.
def _entries_sql() -> str:
    from factweave.queries import ENTRIES_SQL

    return f"with recursive {ENTRIES_SQL}, ev as (select distinct entity_id, item_id, lpad(cast(entry_id as varchar), 20, '0') as doc_id, entry_type as type, at_ns from entry) "


@registered("EV select doc_id, type, at_ns from ev where entity_id = '" + TENANT + "' and item_id = '" + ITEM + "' and type in ('inspect', 'fault')")
def window_query(spark: SparkSession, d: str) -> DataFrame:
    return temporal.window_query(views.entry_events(spark, d, TENANT, ITEM), TENANT, ITEM, ["inspect", "fault"]).select("doc_id", "type", "at_ns")


@registered("EV select entity_id, item_id, type, max(at_ns) as last_ns from ev group by all")
def last_seen(spark: SparkSession, d: str) -> DataFrame:
    return temporal.last_seen(views.entry_events(spark, d))


@registered(f"EV select entity_id, item_id, max(at_ns) as last_ns from ev where type = 'inspect' group by all having max(at_ns) < {LATE}")
def absence_since(spark: SparkSession, d: str) -> DataFrame:
    return temporal.absent_since(views.entry_events(spark, d), "inspect", LATE)


@registered("EV select entity_id, item_id, 'type' as attr, type as value, count(*) as n, min(at_ns) as first_ns, max(at_ns) as last_ns from ev group by all")
def group_count(spark: SparkSession, d: str) -> DataFrame:
    return temporal.group_count(views.entry_events(spark, d), ["type"])


@registered(f"""EV , f as (
        select *, row_number() over w as rn, count(*) over (partition by entity_id, item_id order by at_ns range between unbounded preceding and {DAY} following) - row_number() over w + 1 as size
        from ev where type = 'fault' window w as (partition by entity_id, item_id order by at_ns, doc_id)),
    walk as (
        select entity_id, item_id, rn, size, cast(0 as bigint) as before from f where rn = 1
        union all select f.entity_id, f.item_id, f.rn, f.size, w.before + case when w.size >= 3 then 1 else 0 end
        from walk w join f on f.entity_id = w.entity_id and f.item_id = w.item_id and f.rn = w.rn + case when w.size >= 3 then w.size else 1 end)
    select f.entity_id, f.item_id, w.before + 1 as cluster_no, f.rn - w.rn + 1 as pos, f.at_ns, f.doc_id
    from walk w join f on f.entity_id = w.entity_id and f.item_id = w.item_id and f.rn between w.rn and w.rn + w.size - 1 where w.size >= 3""")
def cluster_query(spark: SparkSession, d: str) -> DataFrame:
    return temporal.clusters(views.entry_events(spark, d), ["fault"], DAY, 3)


@registered(f"select entity_id, item_id, key as attr, count(distinct doc_id) as n from (select l.*, json_extract_string(o.body, '$.item_id') as item_id, json_type(o.body, '$.item_id') as it from {_LEAF} l join {_OBJECTS} o using (entity_id, doc_id)) where it = 'VARCHAR' and key <> 'item_id' and kind in ('VARCHAR', 'BOOLEAN', 'UBIGINT', 'BIGINT', 'DOUBLE') group by all")
def group_count_bodies(spark: SparkSession, d: str) -> DataFrame:
    rows = temporal.group_count_bodies(views.current_documents(spark, d))
    return rows.groupBy("entity_id", "item_id", "attr").agg(F.sum("n").alias("n"))


@registered(f"select doc_id from {_OBJECTS} where entity_id = '{TENANT}' and json_type(body, '$.item_id') = 'VARCHAR' and json_extract_string(body, '$.item_id') = '{ITEM}' and json_extract_string(body, '$.status') = 'active'")
def group_documents(spark: SparkSession, d: str) -> DataFrame:
    return temporal.group_documents(views.current_documents(spark, d), TENANT, ITEM, "status", "active")


@registered("EV select entity_id, item_id, cast(1 as bigint) as cluster_no, row_number() over (partition by entity_id, item_id order by at_ns, doc_id) as pos, at_ns, doc_id from ev where type = 'fault' qualify count(*) over (partition by entity_id, item_id) >= 3")
def cluster_unbounded(spark: SparkSession, d: str) -> DataFrame:
    return temporal.clusters(views.entry_events(spark, d), ["fault"], 0, 3)


_PAIRS = """EV , nx as (select *, first_value(case when type = 'repair' then at_ns end ignore nulls) over (partition by entity_id, item_id order by at_ns, doc_id rows between 1 following and unbounded following) as second_ns
    from ev where type in ('fault', 'repair'))"""


@registered(_PAIRS + f" select entity_id, item_id, min(at_ns) as first_ns, arg_min(second_ns, (at_ns, doc_id)) as second_ns from nx where type = 'fault' and second_ns - at_ns <= {DAY} group by all")
def sequence_2(spark: SparkSession, d: str) -> DataFrame:
    return temporal.followed_by(views.entry_events(spark, d), "fault", "repair", DAY)


@registered(f"""EV , r as (select *, row_number() over (partition by entity_id, item_id order by at_ns, doc_id) as rn from ev where type in ('fault', 'repair', 'inspect')),
    n as (select *, min(case when type = 'repair' then rn end) over w as repair, min(case when type = 'inspect' then rn end) over w as inspect
        from r window w as (partition by entity_id, item_id order by rn rows between 1 following and unbounded following)),
    fits as (select a.entity_id, a.item_id, min((a.rn, a.repair, b.inspect)) as m from n a
        join n b on b.entity_id = a.entity_id and b.item_id = a.item_id and b.rn = a.repair join n c on c.entity_id = a.entity_id and c.item_id = a.item_id and c.rn = b.inspect
        where a.type = 'fault' and c.at_ns - a.at_ns <= {3 * DAY} group by all)
    select r.entity_id, r.item_id, cast(case r.rn when m[1] then 1 when m[2] then 2 else 3 end as bigint) as pos, r.type, r.at_ns, r.doc_id
    from fits join r on r.entity_id = fits.entity_id and r.item_id = fits.item_id and r.rn in (m[1], m[2], m[3])""")
def sequence_3(spark: SparkSession, d: str) -> DataFrame:
    return temporal.sequences(views.entry_events(spark, d), ["fault", "repair", "inspect"], 3 * DAY)


# Hierarchy.
@registered("select 'N' || c_nationkey as node, 1 as depth from customer where c_custkey = 17 union all select 'R' || n_regionkey, 2 from customer join nation on n_nationkey = c_nationkey where c_custkey = 17")
def ancestors(spark: SparkSession, d: str) -> DataFrame:
    return closure.ancestors(views.nation_edges(spark, d), "C17")


@registered("""select 'N' || n_nationkey as node, 1 as depth from nation where n_regionkey = 1
    union all select 'C' || c_custkey, 2 from customer join nation on n_nationkey = c_nationkey where n_regionkey = 1
    union all select 'S' || s_suppkey, 2 from supplier join nation on n_nationkey = s_nationkey where n_regionkey = 1""")
def descendants(spark: SparkSession, d: str) -> DataFrame:
    return closure.descendants(views.nation_edges(spark, d), "R1")


@registered("""with e as (select 'N' || n_nationkey as child, 'R' || n_regionkey as parent from nation union all select 'C' || c_custkey, 'N' || c_nationkey from customer union all select 'S' || s_suppkey, 'N' || s_nationkey from supplier)
    select child as descendant, parent as ancestor, 1 as depth from e union all select a.child, b.parent, 2 from e a join e b on a.parent = b.child""")
def closure_all(spark: SparkSession, d: str) -> DataFrame:
    return closure.closure(views.nation_edges(spark, d))


# Vectors.
def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("vec_id"), F.col("embedding").alias("v"))


def _knn_sql(distance: str, which: str) -> str:
    return f"""select query_id, vec_id, rank, round(distance, 5) as distance from (
        select cast(q.vec_id as varchar) as query_id, cast(x.vec_id as varchar) as vec_id, {distance} as distance,
            cast(row_number() over (partition by q.vec_id order by {distance}, cast(x.vec_id as varchar)) as integer) as rank
        from (select vec_id, cast(embedding as double[]) as v from embeddings where {which}) q, (select vec_id, cast(embedding as double[]) as v from embeddings) x) where rank <= 10"""


def _knn(spark: SparkSession, d: str, which: str, metric: str) -> DataFrame:
    v = _embeddings(spark, d)
    q = v.where(which).select(F.col("vec_id").alias("query_id"), "v")
    return vectors.search(v, q, 10, metric).select("query_id", "vec_id", "rank", F.round("distance", 5).alias("distance"))


@registered(_knn_sql("1 - list_cosine_similarity(q.v, x.v)", "vec_id = 5"))
def vector_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d, "vec_id = '5'", "cosine")


@registered(_knn_sql("list_distance(q.v, x.v)", "vec_id = 5"))
def vector_l2(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d, "vec_id = '5'", "euclidean")


@registered(_knn_sql("list_distance(q.v, x.v)", "vec_id % 20 = 0"))
def vector_knn_batch(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d, "cast(vec_id as bigint) % 20 = 0", "euclidean")


@registered(_knn_sql("1 - list_cosine_similarity(q.v, x.v)", "vec_id % 20 = 0"))
def vector_cosine_batch(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d, "cast(vec_id as bigint) % 20 = 0", "cosine")


_VECTORS = """(select entity_id, scope_name, vec_id, v, metric from (
    select w.*, r.metric from vec_data w join vec_registry r using (entity_id, scope_name)
    where op = 'delete' or (op = 'put' and v is not null and len(v) = dim and len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0)
    qualify row_number() over (partition by entity_id, scope_name, vec_id order by row_no desc) = 1) where op = 'put')"""


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    registry = table(spark, d, "vec_registry")
    return vectors.accepted(table(spark, d, "vec_data"), registry).select("entity_id", "scope_name", "vec_id", "v"), registry


@registered(f"select r.entity_id, r.scope_name, dim, r.metric, count(x.vec_id) as n from vec_registry r left join {_VECTORS} x on x.entity_id = r.entity_id and x.scope_name = r.scope_name group by all")
def vector_scopes(spark: SparkSession, d: str) -> DataFrame:
    return vectors.scopes(*_vectors(spark, d))


@registered(f"select scope_name, count(*) as n from {_VECTORS} where not (entity_id = '{TENANT}' and scope_name = 'photo_tags') group by all")
def vector_drop_scope(spark: SparkSession, d: str) -> DataFrame:
    left, _ = vectors.drop_scope(*_vectors(spark, d), TENANT, "photo_tags")
    return left.groupBy("scope_name").agg(F.count(F.lit(1)).alias("n"))


_ONES = f"[{', '.join(['1.0'] * 64)}]"


@registered(f"""select vec_id, cast(row_number() over (order by d, vec_id) as integer) as rank, round(d, 5) as distance from (
    select vec_id, 1 - list_cosine_similarity(cast(v as double[]), cast({_ONES} as double[])) as d from {_VECTORS} where entity_id = '{TENANT}' and scope_name = 'photo_tags' and len(list_filter(v, lambda x: x <> 0)) > 0)
    order by d, vec_id limit 10""")
def vector_search_scope(spark: SparkSession, d: str) -> DataFrame:
    return vectors.search_scope(*_vectors(spark, d), TENANT, "photo_tags", [1.0] * 64, 10).select("vec_id", "rank", F.round("distance", 5).alias("distance"))


@registered(f"""with w as (select *, ntile(2) over (order by row_no) as half from vec_data where op = 'put' and v is not null and len(v) = 64 and scope_name = 'photo_tags' and entity_id = '{TENANT}')
    select vec_id, arg_max(row_no, row_no) as row_no, cast(arg_max(v[1], row_no) as double) as first from w where vec_id is not null group by vec_id""")
def vector_insert(spark: SparkSession, d: str) -> DataFrame:
    """Two inserts of a scope's puts, the later half of them second."""
    puts = table(spark, d, "vec_data").where((F.col("op") == "put") & (F.size("v") == 64) & (F.col("scope_name") == "photo_tags") & (F.col("entity_id") == TENANT) & F.col("vec_id").isNotNull())
    middle = puts.agg(F.avg("row_no")).first()[0] or 0
    empty = spark.createDataFrame([], "entity_id string, scope_name string, vec_id string, v array<float>"), spark.createDataFrame([], "entity_id string, scope_name string, dim int, metric string")
    stored, registry = vectors.insert(*empty, puts.where(F.col("row_no") <= middle), "row_no")
    stored, _ = vectors.insert(stored, registry, puts.where(F.col("row_no") > middle), "row_no")
    last = puts.groupBy("vec_id").agg(F.max("row_no").alias("row_no"))
    return stored.join(last, "vec_id").select("vec_id", "row_no", F.col("v")[0].cast("double").alias("first"))


@registered(f"select scope_name, vec_id from {_VECTORS} where entity_id = '{TENANT}' and vec_id <> (select min(vec_id) from {_VECTORS} where entity_id = '{TENANT}' and scope_name = 'photo_tags')")
def vector_delete(spark: SparkSession, d: str) -> DataFrame:
    live = _vectors(spark, d)[0].where(F.col("entity_id") == TENANT)
    first = live.where("scope_name = 'photo_tags'").agg(F.min("vec_id")).first()[0]
    return vectors.delete(live, TENANT, "photo_tags", first).where(F.col("vec_id") != first).select("scope_name", "vec_id")


# Change feed and operation log.
_FEED = """(select seq, entity_id, doc_id, case when gone then 'retract' when old_doc is null then 'assert' else 'change' end as kind, old_doc, new_doc from (
    select *, lag(new_doc) over (partition by entity_id, doc_id order by seq) as old_doc from (
        select distinct seq, entity_id, doc_id, coalesce(deleted, false) as gone, case when not coalesce(deleted, false) then coalesce(body, '') end as new_doc from doc_version))
    where not gone or old_doc is not null)"""


@registered(f"select * from {_FEED}")
def mutation_feed(spark: SparkSession, d: str) -> DataFrame:
    return feed.classify(table(spark, d, "doc_version"))


@registered(f"select seq, doc_id, kind from {_FEED} where entity_id = '{TENANT}' and starts_with(doc_id, '40000')")
def mutation_feed_filtered(spark: SparkSession, d: str) -> DataFrame:
    return feed.subscribe(feed.classify(table(spark, d, "doc_version")), TENANT, "40000").select("seq", "doc_id", "kind")


@registered("select entity_id, doc_id, seq, body from (select * from doc_version qualify row_number() over (partition by entity_id, doc_id order by seq desc) = 1) where not coalesce(deleted, false)")
def oplog_replay(spark: SparkSession, d: str) -> DataFrame:
    return feed.replay(table(spark, d, "doc_version"))


@registered("select seq, entity_id, doc_id from doc_version where seq > (select max(seq) from doc_version) - 500")
def oplog_trim(spark: SparkSession, d: str) -> DataFrame:
    return feed.trim(table(spark, d, "doc_version"), 500).select("seq", "entity_id", "doc_id")


@registered("select seq, entity_id, doc_id from doc_version where seq >= (select max(seq) from doc_version) - 99")
def oplog_tail(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "doc_version")
    return feed.tail(log, log.agg(F.max("seq")).first()[0] - 99).select("seq", "entity_id", "doc_id")


def _replica(spark: SparkSession, d: str) -> tuple[feed.Replica, DataFrame]:
    """A replica from a snapshot of the log's first 1,000 numbers, then caught up with a log trimmed behind number 900."""
    log = table(spark, d, "doc_version")
    feed.write_snapshot(feed.replay(log.where("seq <= 1000")), 1000, path := fresh_dir(spark, "snapshot"))
    replica, rest = feed.Replica(spark, fresh_dir(spark, "replica")), feed.trim(log, log.agg(F.max("seq")).first()[0] - 900)
    replica.catch_up(rest, path, min_seq=901)
    return replica, rest


@registered("select entity_id, doc_id, seq, body from (select * from doc_version qualify row_number() over (partition by entity_id, doc_id order by seq desc) = 1) where not coalesce(deleted, false)")
def replica_documents(spark: SparkSession, d: str) -> DataFrame:
    return _replica(spark, d)[0].documents()


@registered("select max(seq) as current_seq, min(seq) as min_seq, max(seq) as applied_seq from doc_version where seq > 900")
def replica_status(spark: SparkSession, d: str) -> DataFrame:
    replica, rest = _replica(spark, d)
    return replica.status(rest)


@registered("select max(seq) as current_seq, min(seq) as min_seq, cast(0 as bigint) as applied_seq from doc_version")
def oplog_status(spark: SparkSession, d: str) -> DataFrame:
    return feed.status(table(spark, d, "doc_version"))


@registered("select cast(row_number() over (order by ts, event_id) as bigint) as seq, event_id from events")
def oplog_append(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select((F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("at_ns"), F.lit("events").alias("entity_id"), F.lpad(F.col("event_id").cast("string"), 20, "0").alias("doc_id"), "event_id")
    return feed.number(rows).select("seq", "event_id")


@registered("""select entity_id, record_id, attribute, arg_max(value, ord) as value from (
    select 'events' as entity_id, cast(user_id as varchar) as record_id, unnest(['type', 'value']) as attribute, unnest([event_type, cast(cast(value as decimal(18, 2)) as varchar)]) as value, event_id as ord from events) group by all""")
def assert_merge(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.inline(F.array(F.struct(F.lit("type").alias("attribute"), F.col("event_type").alias("value")), F.struct(F.lit("value").alias("attribute"), F.col("value").cast("decimal(18,2)").cast("string").alias("value"))))
    facts = table(spark, d, "events").select(F.lit("events").alias("entity_id"), F.col("user_id").cast("string").alias("record_id"), F.col("event_id").alias("ord"), pairs)
    return store.assert_facts(facts, "ord")


@registered(f"select doc_id from {_CURRENT} where entity_id = '{TENANT}' and doc_id not in (select doc_id from doc_meta where entity_id = '{TENANT}')")
def batch_delete(spark: SparkSession, d: str) -> DataFrame:
    versions = table(spark, d, "doc_version").where(F.col("entity_id") == TENANT)
    gone = store.delete(versions, table(spark, d, "doc_meta"), 2**62, 2**62)
    return store.as_of(versions.select("seq", "entity_id", "doc_id", "at_ns", "deleted", "body").unionByName(gone)).select("doc_id")


def sql() -> dict[str, str]:
    """The SQL with the entries' definition filled in."""
    entries = _entries_sql().rstrip()
    return {k: v.replace("EV ", entries + " ", 1) if v.startswith("EV ") else v for k, v in SQL.items()}
