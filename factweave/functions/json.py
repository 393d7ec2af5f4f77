"""JSON bodies as variants: leaves, scalars and their texts, without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.instants import rfc3339_ns


def parsed(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with the variant ``name`` of a JSON text, NULL where it is none; of equal keys the last holds."""
    return lenient(df).withColumn(name, F.try_parse_json(column))


def lenient(df: DataFrame) -> DataFrame:
    """``df``, after setting that of equal keys of a JSON object the last holds, as the store reads them."""
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return df


def kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def _members(v: Column) -> Column:
    """Keys and values of an object; NULL for anything else."""
    return F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))


def _leaf(key: Column, v: Column) -> Column:
    of = kind(v)
    return F.struct(key.alias("key"), v.alias("v"), of.alias("kind"), (of.startswith("OBJECT") | of.startswith("ARRAY")).alias("nested"))


def _below(e: Column) -> Column:
    listed = F.try_variant_get(e["v"], "$", "array<variant>")
    return (
        F.when(~e["nested"], F.array(e)).when(e["kind"].startswith("ARRAY"), F.transform(listed, lambda x: _leaf(e["key"], x)))
        .otherwise(F.transform(_members(e["v"]), lambda m: _leaf(m["key"], m["value"])))
    )


def is_number(of: Column) -> Column:
    return of.rlike("^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|DOUBLE|FLOAT)")


def leaves(body: Column) -> Column:
    """The scalars of the object in a JSON text as an array of structs ``key, text, num``, without nulls.

    ``key`` is the last key above the scalar; lists keep the one above them. NULL for texts that are no objects, or hold a number that no double does. Lists and
    objects are opened as often as the text has opening brackets, so at any depth.
    """
    members = F.transform(_members(F.try_parse_json(body)), lambda m: _leaf(m["key"], m["value"]))
    opened = lambda held, _: F.when(F.exists(held, lambda e: e["nested"]), F.flatten(F.transform(held, _below))).otherwise(held)
    num = lambda e: F.when(is_number(e["kind"]), F.try_variant_get(e["v"], "$", "double") + F.lit(0.0))
    brackets = F.length(F.regexp_replace(body, r"[^\[{]", ""))
    flat = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), brackets)), members, opened, lambda held: F.when(~F.exists(held, lambda e: F.coalesce(F.abs(num(e)) == float("inf"), F.lit(False))), held))
    scalars_ = F.transform(F.filter(flat, lambda e: ~e["nested"] & (e["kind"] != "VOID")), lambda e: F.struct(e["key"].alias("key"), F.try_variant_get(e["v"], "$", "string").alias("text"), num(e).alias("num")))
    return F.transform(scalars_, lambda e: F.struct(e["key"].alias("key"), F.coalesce(number_text(e["num"]), e["text"]).alias("text"), e["num"].alias("num")))


def number_text(x: Column) -> Column:
    """The shortest digits of a double, with an exponent below 1e-4 and from 1e6 on, as the store writes terms."""
    plain = F.abs(x).cast("string")
    mantissa = F.regexp_replace(F.regexp_extract(plain, r"^([0-9.]+)", 1), r"\.0$", "")
    power = F.regexp_extract(plain, r"E(-?[0-9]+)$", 1).try_cast("int")
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.", ""), "0+$", "")
    large = F.concat(F.substring(digits, 1, 1), F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, 2, 400))).otherwise(""), F.lit("e+06"))
    exponent = F.concat(mantissa, F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    text = (
        F.when(x == 0, "0").when(power.isNotNull() & (power == -4), F.concat(F.lit("0.000"), digits)).when(power.isNotNull(), exponent)
        .when(F.abs(x) >= 1e6, large).otherwise(mantissa)
    )
    return F.when(x.isNull(), None).otherwise(F.concat(F.when(x < 0, "-").otherwise(""), text))


def scalars(v: Column) -> Column:
    """The top-level scalars of a parsed object but nulls, as structs ``key, text``."""
    have = F.filter(F.transform(_members(v), lambda m: F.struct(m["key"].alias("key"), m["value"].alias("v"), kind(m["value"]).alias("kind"))), lambda e: ~e["kind"].rlike("^(OBJECT|ARRAY|VOID)"))
    return F.transform(have, lambda e: F.struct(e["key"].alias("key"), F.coalesce(number_text(F.when(is_number(e["kind"]), F.try_variant_get(e["v"], "$", "double"))), F.try_variant_get(e["v"], "$", "string")).alias("text")))


def top(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$['{name}']", "variant")


def text_of(v: Column) -> Column:
    """The string a variant is; NULL for any other."""
    return F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def instant_of(v: Column) -> Column:
    """Unix nanoseconds of a variant: a number, cut to an integer, or an RFC3339 text; else NULL."""
    return F.coalesce(F.when(is_number(kind(v)), F.coalesce(F.try_variant_get(v, "$", "bigint"), F.try_variant_get(v, "$", "double").try_cast("bigint"))), rfc3339_ns(text_of(v)))
