"""Makes the package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local session may go without; others are refused."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-costlens-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so that what follows neither works it out twice nor loses it with an executor."""
    path = f"{shared_dir(df.sparkSession)}/costlens-{df.sparkSession.sparkContext.applicationId}-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Adds this package to the session's Python files, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="spark-costlens-"), "costlens.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(here)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)
