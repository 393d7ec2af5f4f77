"""Queries of the operators for training data and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factweave.llm import encoding, language, neighbours, packing
from factweave.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.near_pairs(neighbours.live_vectors(table(spark, d, "vec_data"), table(spark, d, "vec_registry")))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(table(spark, d, "documents"), "doc_id", "text")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    bins = {r.bin_kind: r.capacity_tokens for r in table(spark, d, "token_bin").collect()}
    return packing.pack(table(spark, d, "documents"), "doc_id", "text", bins)


def p9_languages(spark: SparkSession, d: str) -> DataFrame:
    return language.languages(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_languages(spark, d).where("differs").select("doc_id", "cue_pos", "lang")


QUERIES = {f.__name__: f for f in (p1_found, p7_ids, p8_containers, p9_found, p9_languages)}
SQL: dict[str, str] = {
    "p1_found": """
        with valid as (
            select w.*, r.metric, r.near_limit from vec_data w join vec_registry r using (entity_id, scope_name)
            where op = 'delete' or (op = 'put' and v is not null and len(v) = dim and len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0)),
        live as (
            select entity_id, scope_name, vec_id, cast(v as double[]) as v, metric, near_limit
            from (select * from valid qualify row_number() over (partition by entity_id, scope_name, vec_id order by row_no desc) = 1)
            where op = 'put' and (metric = 'euclidean' or len(list_filter(v, lambda x: x <> 0)) > 0)),
        pairs as (
            select a.entity_id, a.scope_name, a.vec_id as q, b.vec_id as o, a.near_limit,
                case when a.metric = 'euclidean' then list_distance(a.v, b.v) else 1 - list_cosine_similarity(a.v, b.v) end as d
            from live a join live b on a.entity_id = b.entity_id and a.scope_name = b.scope_name and a.vec_id <> b.vec_id),
        near as (select * from (select * from pairs qualify row_number() over (partition by entity_id, scope_name, q order by d, o) <= 5) where d <= near_limit)
        select distinct entity_id, scope_name, least(q, o) as vec_id_a, greatest(q, o) as vec_id_b from near""",
}
