"""Queries over the engine's tables and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.operators import asof, cdc, history, incremental, sessions
from factweave.plans.shared import fresh_dir
from factweave.sources.entries import entry_rows
from factweave.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return history.document_history(table(spark, d, "doc_version"), fresh_dir(spark, "satellites")).select("entity_id", "doc_id", "valid_from_ns", "valid_to_ns")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = sessions.sessions(entry_rows(table(spark, d, "temporal_entry")), ["entity_id", "item_id"], "at_ns", "entry_id")
    return found.select("entity_id", "item_id", "start_ns", "end_ns", "n_entries")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    meta = table(spark, d, "doc_meta")
    consumer = incremental.Consumer(spark, fresh_dir(spark, "consumer"))
    runs = table(spark, d, "sync_run").where("run_no is not null").orderBy("run_no").collect()
    for r in runs:
        try:  # runs that failed do all their work, but never come to their commit
            consumer.run(r.run_no, meta.where(F.col("delivery_no") <= r.upto_delivery), fail_before_commit=r.status != "ok")
        except RuntimeError:
            if r.status == "ok":
                raise
    return consumer.taken().select("run_no", "entity_id", "doc_id", F.when(F.col("doc_version") != incremental.LOWEST, F.col("doc_version")).alias("doc_version"))


def p5_current(spark: SparkSession, d: str) -> DataFrame:
    state = cdc.CurrentState(spark, fresh_dir(spark, "current"))
    state.apply(table(spark, d, "mutation_event"))
    return state.documents().select("entity_id", "doc_id", "seq", "new_doc")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_current(spark, d).select("entity_id", "doc_id", "seq")


def p6_joined(spark: SparkSession, d: str) -> DataFrame:
    entries = entry_rows(table(spark, d, "temporal_entry")).withColumnRenamed("entry_id", "id")
    versions = table(spark, d, "doc_version").withColumn("live", ~F.coalesce("deleted", F.lit(False)))
    return asof.asof_join(entries, versions)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_joined(spark, d).where("live").select(F.col("id").alias("entry_id"), "seq")


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p4_found, p5_found, p5_current, p6_found)}

_PART = lambda i: f"regexp_extract(at_text, '^(\\d{{4}}-\\d{{2}}-\\d{{2}})T(\\d{{1,2}}):(\\d{{2}}):(\\d{{2}})(?:[.,](\\d+))?(?:(Z)|([+-])(\\d{{2}}):(\\d{{2}}))$', {i})"
_NUMBER = lambda i: f"coalesce(try_cast(nullif({_PART(i)}, '') as bigint), 0)"
ENTRIES_SQL = f"""entry as (
    select distinct entry_id, entity_id, item_id, doc_id, entry_type, coalesce(at_ns, text_ns) as at_ns from (
        select *, case when try_cast({_PART(1)} as date) is not null and {_NUMBER(2)} < 24 and {_NUMBER(3)} < 60 and {_NUMBER(4)} < 60
            and {_NUMBER(8)} <= 24 and {_NUMBER(9)} <= 60 then
            (date_diff('day', date '1970-01-01', try_cast({_PART(1)} as date)) * 86400 + {_NUMBER(2)} * 3600 + {_NUMBER(3)} * 60 + {_NUMBER(4)}
            - case when {_PART(7)} = '-' then -1 else 1 end * ({_NUMBER(8)} * 3600 + {_NUMBER(9)} * 60)) * 1000000000
            + coalesce(try_cast(rpad(substr({_PART(5)}, 1, 9), 9, '0') as bigint), 0) end as text_ns
        from temporal_entry)
    where item_id is not null and entry_type is not null and coalesce(at_ns, text_ns) is not null)"""

SQL = {
    "p2_found": """
        with valid as (
            select seq, entity_id, doc_id, at_ns, coalesce(deleted, false) as gone,
                case when coalesce(deleted, false) then null when body is null then 'N'
                    when json_valid(body) and json_type(body) = 'OBJECT' then 'J' || cast(list_transform(list_sort(json_keys(body)), lambda k: k || '=' ||
                        case when json_type(body, '$."' || k || '"') in ('UBIGINT', 'BIGINT', 'DOUBLE')
                            then cast(cast(json_extract_string(body, '$."' || k || '"') as double) as varchar)
                            else cast(json_extract(body, '$."' || k || '"') as varchar) end) as varchar)
                    else 'T' || body end as state
            from doc_version where at_ns is not null),
        held as (
            select entity_id, doc_id, at_ns, max(seq) as seq, arg_max(gone, seq) as gone, arg_max(coalesce(state, 'D'), seq) as state
            from valid group by entity_id, doc_id, at_ns),
        steps as (select *, lag(state) over (partition by entity_id, doc_id order by at_ns) as before from held),
        changes as (select *, lead(at_ns) over (partition by entity_id, doc_id order by at_ns) as until from steps where before is null or before <> state)
        select entity_id, doc_id, at_ns as valid_from_ns, coalesce(until, -1) as valid_to_ns from changes where not gone""",
    "p3_found": f"""
        with {ENTRIES_SQL},
        steps as (select entity_id, item_id, entry_id, at_ns, lag(at_ns) over w as before from (select distinct entity_id, item_id, entry_id, at_ns from entry)
            window w as (partition by entity_id, item_id order by at_ns)),
        numbered as (select *, sum(case when before is null or at_ns - before > 1800000000000 then 1 else 0 end)
            over (partition by entity_id, item_id order by at_ns) as no from steps)
        select entity_id, item_id, min(at_ns) as start_ns, max(at_ns) as end_ns, count(*) as n_entries from numbered group by entity_id, item_id, no""",
    "p4_found": """
        with ok as (select run_no, upto_delivery from sync_run where status = 'ok'),
        state as (
            select run_no, entity_id, doc_id, max({'c': created_at_ns, 'v': doc_version}) as s
            from ok join doc_meta on delivery_no <= upto_delivery group by all),
        prior as (select *, max(s) over (partition by entity_id, doc_id order by run_no rows between unbounded preceding and 1 preceding) as taken from state)
        select cast(run_no as bigint) as run_no, entity_id, doc_id, s.v as doc_version from prior where taken is null or s > taken""",
    "p5_current": """
        select entity_id, doc_id, seq, new_doc from (
            select *, lower(kind) as k from mutation_event where doc_id is not null
                and regexp_replace(lower(kind), '^op_kind_doc_', '') in ('assert', 'change', 'retract')
            qualify row_number() over (partition by entity_id, doc_id order by at_unix_nanos desc, seq desc) = 1)
        where k not like '%retract'""",
    "p6_found": f"""
        with {ENTRIES_SQL},
        v as (select entity_id, doc_id, at_ns, max(seq) as seq, arg_max(coalesce(deleted, false), seq) as gone
            from doc_version where at_ns is not null group by entity_id, doc_id, at_ns)
        select e.entry_id, v.seq from (select distinct entry_id, entity_id, doc_id, at_ns from entry) e
        asof join v on e.entity_id = v.entity_id and e.doc_id = v.doc_id and e.at_ns >= v.at_ns where not v.gone""",
}
SQL["p5_found"] = f"select entity_id, doc_id, seq from ({SQL['p5_current']})"
