"""The entries behind the deliveries of ``temporal_entry``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.functions.instants import instant_ns


def entry_rows(deliveries: DataFrame) -> DataFrame:
    """Deliveries that are entries, as ``entry_id, entity_id, item_id, doc_id, entry_type, at_ns``.

    A delivery counts if it has an ``entry_id``, a tenant, an item, a type and an instant. Deliveries of one entry stay
    separate rows here; operators count an ``entry_id`` once. Other columns are dropped, so their names can't clash.
    """
    return deliveries.select(
        "entry_id", "entity_id", "item_id", "doc_id", "entry_type",
        instant_ns(F.col("at_ns"), F.col("at_text")).alias("at_ns"),
    ).where("entry_id is not null and entity_id is not null and item_id is not null and entry_type is not null and at_ns is not null")
