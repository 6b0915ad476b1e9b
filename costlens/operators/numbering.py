"""Numbers within groups of any size: a group with a third of all rows is numbered by several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "n", parts: int | None = None) -> DataFrame:
    """``rows`` with ``name``: 1, 2, ... in the order of the columns ``order`` within each group of ``keys``; null keys are a group, rows with equal order get their numbers in any order.

    First the rows are split into ``parts`` ranges of (keys, order), whose bounds Spark samples, and written, so that a row has its range once and for all. Then each range is numbered on its own,
    and a group that goes over several ranges adds what it has in the ranges before. Only groups at the ends of ranges do: the table of what is before them has at most one row a range, and is broadcast.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(f"`{k}`") for k in keys]
    # without clashes of names, whatever the columns are called
    ranged = rows.repartitionByRange(parts, *by, *(F.col(f"`{o}`") for o in order)).select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), F.spark_partition_id().alias("part"))
    ranged = kept(ranged, "ranges")
    of = [F.col("row")[k].alias(f"k{i}") for i, k in enumerate(keys)]
    held = [f"k{i}" for i in range(len(keys))]
    counts = ranged.groupBy(*of, "part").agg(F.count("*").alias("n"))
    ends = counts.groupBy("part").agg(F.min(F.struct(*held)).alias("lo"), F.max(F.struct(*held)).alias("hi"))
    wide = ends.select(F.explode(F.array("lo", "hi")).alias("k")).distinct().select("k.*")  # a group of several ranges is the last of one and the first of the next
    same = lambda a, b: F.expr(" and ".join(f"{a}.{h} <=> {b}.{h}" for h in held)) if held else F.lit(True)
    border = counts.alias("c").join(F.broadcast(wide).alias("w"), same("c", "w"), "left_semi")
    before = F.sum("n").over(Window.partitionBy(*held).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = border.select(*held, "part", F.coalesce(before, F.lit(0)).alias("before")).filter("before > 0")
    n = F.row_number().over(Window.partitionBy(*of, "part").orderBy(*(F.col("row")[o] for o in order)))
    local = ranged.select("row", "part", *of, n.alias("n"))
    met = local.alias("l").join(F.broadcast(offsets).alias("o"), same("l", "o") & F.expr("l.part = o.part"), "left")
    return met.select("l.row.*", (F.col("l.n") + F.coalesce("o.before", F.lit(0))).alias(name))
