"""Numbers within groups, heavy ones included, against one pass over sorted rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from costlens.operators import callsites as C
from costlens.operators import evals as E
from costlens.operators.numbering import numbered


def by_force(rows):
    met, out = Counter(), []
    for r in sorted(rows, key=lambda r: (str(r[0]), str(r[1]), r[2])):
        met[r[:2]] += 1
        out.append((*r, met[r[:2]]))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("hot", "parts"), [(0.0, 4), (0.4, 7), (1.0, 5), (0.4, 1)])
def test_numbers_by_force(spark, hot, parts):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < hot else rng.choice([None, *"abcdefgh"]), rng.choice([None, 1]), i) for i in range(3000)]
    rng.shuffle(rows)
    got = numbered(spark.createDataFrame(rows, "row string, part int, k0 int").repartition(3), ["row", "part"], ["k0"], "nth", parts).collect()
    assert sorted(map(tuple, got), key=repr) == by_force(rows)


def test_numbers_of_no_rows_and_no_keys(spark):
    empty = spark.createDataFrame([], "a string, b int")
    assert numbered(empty, ["a"], ["b"]).count() == 0
    assert sorted(r["n"] for r in numbered(spark.range(500), [], ["id"], parts=4).collect()) == list(range(1, 501))


def test_a_heavy_group_is_dealt_to_all_tasks(spark):
    """Half of all rows are one group's, and no range of rows has over twice the median."""
    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"), "id")
    sizes = [r["count"] for r in rows.repartitionByRange(8, "k", "id").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sorted(sizes)[4]
    got = numbered(rows, ["k"], ["id"], parts=8)
    assert got.filter("k = 'hot'").agg(F.max("n"), F.countDistinct("n"), F.count_if(F.col("n") == F.col("id") / 2 + 1)).first()[:] == (20_000, 20_000, 20_000)
    assert got.filter("k <> 'hot' and n <> 1").isEmpty()


def test_sites_cases_and_repeated_ids_of_a_heavy_group(spark):
    rows = spark.range(1000).select(F.lit("f.py").alias("file"), F.lit("ask").alias("function"), F.col("id").alias("ord"))
    for parsed in (True, False):
        assert {r["ord"]: r["id"] for r in C.number_sites(rows, parsed).collect()} == {i: "f.py::ask" + (f"#{i + 1}" if i else "") for i in range(1000)}
    cases = rows.select(F.lit("s").alias("site_id"), "function", "ord", F.lit("x").alias("id"), F.col("ord").alias("line"))
    assert {r["ord"]: r["id"] for r in E.renumber(cases).collect()} == {i: f"ask-{i + 1:02d}" for i in range(1000)}
    assert {r["line"] for r in E.duplicate_ids(cases).collect()} == set(range(1, 1000))
