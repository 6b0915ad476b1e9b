"""Joins by "the last one before": each row with the latest row of another table under the same key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_before(rows: DataFrame, events: DataFrame, keys: list[str], at: str, first: str | None = None, strict: bool = True, name: str = "event") -> DataFrame:
    """``rows`` with a struct column ``name``: of ``events`` with the same ``keys``, the one with the greatest ``at`` below the row's own; null if there is none.

    Both tables have the columns ``keys`` and ``at``. Events with the same ``at`` go by ``first``, least first; ``strict=False`` lets an event of the row's own ``at`` count.
    Rows and events without a key or without ``at`` match nothing. Both sides are one sorted pass by key: a shuffle of each row and event, no pairs.
    """
    own, told = F.struct(*(F.col(f"`{c}`") for c in rows.columns)), F.struct(*(F.col(f"`{c}`") for c in events.columns))
    side = (1, 0) if not strict else (0, 1)
    tag = lambda df, row, event, s, tie: df.select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)), F.col(f"`{at}`").alias("_at"), F.lit(s).alias("_side"), tie.alias("_tie"), row.alias("_row"), event.alias("_event"))
    tie = F.col(f"`{first}`").cast("bigint") if first else F.lit(0).cast("bigint")
    both = tag(rows, own, F.lit(None).cast(events.schema), side[0], F.lit(0).cast("bigint")).unionByName(tag(events.filter(F.col(f"`{at}`").isNotNull()), F.lit(None).cast(rows.schema), told, side[1], tie))
    order = Window.partitionBy(*(f"_k{i}" for i in range(len(keys)))).orderBy("_at", "_side", F.col("_tie").desc()).rowsBetween(Window.unboundedPreceding, 0)
    known = F.col("_at").isNotNull()
    for i in range(len(keys)):
        known = known & F.col(f"_k{i}").isNotNull()
    met = both.withColumn("_event", F.when(known, F.last("_event", ignorenulls=True).over(order))).filter("_row is not null")
    return met.select("_row.*", F.col("_event").alias(name))
