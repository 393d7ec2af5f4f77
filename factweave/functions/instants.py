"""Instants as Unix nanoseconds (BIGINT); never as DOUBLE, which loses digits beyond 2^53."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The shape of an RFC3339 instant as the store's reader takes it. One-digit hours, a comma before the
#: fraction and more than nine digits of it (the rest is cut) are accepted there as well.
RFC3339 = r"^(\d{4}-\d{2}-\d{2})T(\d{1,2}):(\d{2}):(\d{2})(?:[.,](\d+))?(?:(Z)|([+-])(\d{2}):(\d{2}))$"


def rfc3339_ns(text: Column) -> Column:
    """Unix nanoseconds of an RFC3339 text; NULL where the text isn't one, names no real instant or leaves BIGINT."""
    part = lambda i: F.regexp_extract(text, RFC3339, i)
    number = lambda i: part(i).try_cast("bigint")
    day = F.unix_date(part(1).try_cast("date")).cast("bigint")
    hour, minute, second = number(2), number(3), number(4)
    off_hour, off_minute = F.coalesce(number(8), F.lit(0)), F.coalesce(number(9), F.lit(0))
    offset = F.when(part(7) == "-", F.lit(-1)).otherwise(F.lit(1)) * (off_hour * 3600 + off_minute * 60)
    fraction = F.rpad(F.substring(part(5), 1, 9), 9, "0").try_cast("bigint")
    seconds = day * 86400 + hour * 3600 + minute * 60 + second - offset
    valid = text.rlike(RFC3339) & (hour < 24) & (minute < 60) & (second < 60) & (off_hour <= 24) & (off_minute <= 60)
    return F.when(valid, F.try_add(F.try_multiply(seconds, F.lit(1_000_000_000)), fraction))


def instant_ns(at_ns: Column, at_text: Column) -> Column:
    """``at_ns``, or else what ``at_text`` says."""
    return F.coalesce(at_ns, rfc3339_ns(at_text))
