"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Ids that a broadcast may carry (8 bytes each, about 32 MB once hashed); larger sides are shuffled.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, by a path that Spark alone resolves."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local session may go without; others are refused."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-costlens-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends at files that outlive any executor."""
    path = f"{shared_dir(df.sparkSession)}/costlens-{df.sparkSession.sparkContext.applicationId}-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> int:
    """Deletes the tables that ``cut`` wrote to the shared folder for this application; how many. To be called when no result is read any more."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [x.getPath() for x in fs.globStatus(jvm.org.apache.hadoop.fs.Path(folder, f"costlens-{spark.sparkContext.applicationId}-*")) or []]
    return sum(bool(fs.delete(path, True)) for path in found)


def semi(big: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``big`` whose ``key`` is in ``ids``: a broadcast while the ids fit its bound, a shuffle beyond."""
    few = ids.count() <= BROADCAST_ROWS
    return big.join(F.broadcast(ids) if few else ids, key, "left_semi")


def hot_keys(df: DataFrame, key: str, most: int) -> DataFrame:
    """``(key, parts)`` of the keys with over ``most`` rows in ``df``, and over a millionth of all rows: so never more than BROADCAST_ROWS keys."""
    return hot_counts(cut(df.groupBy(key).agg(F.count("*").alias("n")), "key-counts"), key, most)


def hot_counts(counts: DataFrame, key: str, most: int) -> DataFrame:
    """The same from ``counts(key, n)``."""
    most = max(most, (counts.agg(F.sum("n")).first()[0] or 0) // BROADCAST_ROWS + 1)
    return counts.filter(F.col("n") > most).select(key, F.ceil(F.col("n") / most).cast("int").alias("parts"))


def dealt(df: DataFrame, key: str, hot: DataFrame, *by: str) -> DataFrame:
    """``df`` with a column ``salt``: the rows of a hot key are dealt into its parts by a hash of ``by``, all others get 0."""
    some = df.join(F.broadcast(hot), key, "left")
    return some.withColumn("salt", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64(*by), F.col("parts")).cast("int")).otherwise(0)).drop("parts")


def copied(df: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """``df`` with a column ``salt``: one copy of each row for each part of its key."""
    some = df.join(F.broadcast(hot), key, "left")
    return some.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))).drop("parts")


#: Rows that Spark hands to a Python task at once, unless the session names a number: texts may be long. Spark bounds their bytes by itself.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_of(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and the text column; other columns are not read."""
    spark = docs.sparkSession
    ship(spark)
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, BATCH_ROWS)
    return docs.select(*keep, F.col("text").cast("string").alias("text"))
