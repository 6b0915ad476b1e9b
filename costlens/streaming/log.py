"""The result log as a stream: a table of each case's last row, kept by Structured Streaming in a bounded number of folders."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.results import KEY, last_wins

#: Folders of one size that are merged into the next size.
FANOUT = 8
_RUN = re.compile(r"^batches=(\d+)-(\d+)$")


def follow(spark: SparkSession, path: str, schema, max_files: int = 100) -> DataFrame:
    """A stream of the log's Parquet files, in the order they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def running_last(stream: DataFrame, keys: list[str] = KEY, order: str = "seq") -> DataFrame:
    """The position and content of each key's last row so far, as a stateful aggregate (update or complete mode); one row of state a key."""
    rest = [c for c in stream.columns if c not in keys and c != order]
    return stream.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("last")).select(*keys, "last.*")


def span_of(number: int, fanout: int = FANOUT) -> int:
    """How many batches, itself the last, the folder that batch ``number`` writes stands for: the largest power of ``fanout`` that divides the batches so far."""
    span = 1
    while (number + 1) % (span * fanout) == 0:
        span *= fanout
    return span


def _folder(spark: SparkSession, target: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def runs(spark: SparkSession, target: str) -> list[tuple[int, int]]:
    """``(first, end)`` of the folders that were written whole, as batch numbers; ``end`` is excluded."""
    path, fs = _folder(spark, target)
    if not fs.exists(path):
        return []
    names = [(s.getPath(), _RUN.match(s.getPath().getName())) for s in fs.listStatus(path)]
    done = lambda p: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted((int(m[1]), int(m[2])) for p, m in names if m and done(p))


def live(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The widest folders that together hold every batch, from the latest back: a folder inside another is left over from before their merge."""
    out: list[tuple[int, int]] = []
    for first, end in sorted(found, key=lambda r: (-r[1], r[0])):
        if not out or end <= out[-1][0]:
            out.append((first, end))
    return out


def _path(target: str, run: tuple[int, int]) -> str:
    return f"{target}/batches={run[0]:010d}-{run[1]:010d}"


def upsert(stream: DataFrame, target: str, checkpoint: str, keys: list[str] = KEY, order: str = "seq", fanout: int = FANOUT, grace: int = FANOUT, mode: str = "append") -> StreamingQuery:
    """Keeps ``target`` a table of last rows, whose folders are few at any number of batches.

    A batch writes one folder: its own last rows, and where the batches so far are a multiple of a power of ``fanout``, merged with all folders of the
    batches that this power spans. So n batches leave at most ``(fanout - 1) * log(n)`` live folders, and a row is written again ``log(n)`` times in all. What a batch
    writes follows from its number alone: one that runs again finds its folder whole and changes nothing, one that was cut off writes it anew. Folders that were merged
    stay for ``grace`` more batches, for those who still read them.
    """
    if fanout < 2 or grace < 0:
        raise ValueError("fanout must be 2 or more and grace not negative")

    def write(batch: DataFrame, number: int) -> None:
        write_batch(batch, number, target, keys, order, fanout, grace)

    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_batch(batch: DataFrame, number: int, target: str, keys: list[str] = KEY, order: str = "seq", fanout: int = FANOUT, grace: int = FANOUT) -> None:
    """Adds one batch to the table that :func:`upsert` keeps."""
    spark = batch.sparkSession
    end = number + 1
    run = (end - span_of(number, fanout), end)
    found = runs(spark, target)
    if run not in found:
        inside = [r for r in live([r for r in found if r[1] <= number]) if r[0] >= run[0]]
        rows = batch
        if inside:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(*(_path(target, r) for r in inside)))
        last_wins(rows, keys, order).write.mode("overwrite").parquet(_path(target, run))
        found = runs(spark, target)
    needed = set(live(found))
    _, fs = _folder(spark, target)
    for r in found:
        if r not in needed and r[1] <= end - grace:
            fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_path(target, r)), True)


def upserted(spark: SparkSession, target: str, keys: list[str] = KEY, order: str = "seq") -> DataFrame:
    """The table that :func:`upsert` keeps: the last of its live folders' last rows."""
    held = live(runs(spark, target))
    if not held:
        raise ValueError(f"{target} holds no batch yet")
    return last_wins(spark.read.parquet(*(_path(target, r) for r in held)), keys, order)
