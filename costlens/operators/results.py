"""The append-only result log: what counts, what is left to do, and statistics of a site and model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["site_id", "model", "case_id"]


def last_wins(log: DataFrame, keys: list[str] = KEY, order: str = "seq") -> DataFrame:
    """The row of largest ``order`` for each key; of rows equal in that too, one.

    One scan and one shuffle: each task keeps the last row of a key before the shuffle, so a key with a third of the log is a row a task by then.
    """
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last"))
    return last.select(*(c if c in keys else F.col("_last")[c].alias(c) for c in log.columns))


def is_ok():
    """A row counts for quality: no error, and a score."""
    return F.col("error").isNull() & F.col("score").isNotNull()


def first_cases(spine: DataFrame, n: int) -> DataFrame:
    """The first n cases of each site in file order."""
    if n < 0:
        raise ValueError("limit must not be negative")
    return spine.withColumn("n", F.row_number().over(Window.partitionBy("site_id").orderBy("line"))).filter(F.col("n") <= n).drop("n")


def todo(spine: DataFrame, models: DataFrame, latest: DataFrame) -> DataFrame:
    """Cases of every site and model whose last row isn't ok: what a run resumes with."""
    done = latest.filter(is_ok()).select(*KEY)
    return spine.crossJoin(F.broadcast(models.select("model"))).join(done, KEY, "left_anti")


def to_rescore(latest: DataFrame, judge: str) -> DataFrame:
    """Judge-graded rows that another judge has yet to grade: kept output, no error but a failed scoring."""
    usable = F.col("error").isNull() | F.startswith("error", F.lit("scoring failed"))
    return latest.filter(usable & ~(is_ok() & F.col("judge_model").eqNullSafe(judge)))


def summarize(spine: DataFrame, models: DataFrame, latest: DataFrame) -> DataFrame:
    """Statistics of each site and model over the eval cases, with those never run counted as cases.

    The dimension ``models`` is broadcast; strays of the log that are no eval case fall away.
    """
    grid = spine.crossJoin(F.broadcast(models))
    rows = grid.join(latest, KEY, "left")
    ok = is_ok()
    mean = lambda c: F.avg(F.when(ok, F.col(c)))
    out = rows.groupBy("site_id", "model", *[c for c in models.columns if c != "model"]).agg(
        F.count("*").alias("cases"),
        F.count_if(ok).alias("scored"),
        F.count_if(ok & F.col("passed")).alias("passed"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        mean("score").alias("mean_score"),
        mean("latency_s").alias("avg_latency_s"),
        mean("prompt_tokens").alias("avg_prompt_tokens"),
        mean("completion_tokens").alias("avg_completion_tokens"),
        mean("judge_score").alias("avg_judge_score"),
    )
    return out.withColumns({"pass_rate": F.try_divide("passed", "scored"), "complete": (F.col("cases") > 0) & (F.col("errors") == 0) & (F.col("scored") == F.col("cases"))})


def pass_grid(latest: DataFrame, models: list[str]) -> DataFrame:
    """A row for each site and case, with a column of passes for each model."""
    shown = latest.filter(is_ok()).withColumn("passed", F.col("passed").cast("int"))
    return shown.groupBy("site_id", "case_id").pivot("model", models).agg(F.max("passed"))


def grid_totals(grid: DataFrame, models: list[str]) -> DataFrame:
    """For each site of a pass grid, the passes of each model over its cases."""
    return grid.groupBy("site_id").agg(*(F.coalesce(F.sum(m), F.lit(0)).cast("bigint").alias(m) for m in models))


def judge_models(latest: DataFrame) -> DataFrame:
    """One row: the sorted distinct names of the judges in a log."""
    return latest.agg(F.array_sort(F.collect_set(F.nullif("judge_model", F.lit("")))).alias("judges"))


def sum_cases(spine: DataFrame) -> DataFrame:
    """One row: eval sets and cases of all sites."""
    return spine.groupBy("site_id").count().agg(F.count("*").alias("sets"), F.coalesce(F.sum("count"), F.lit(0)).alias("cases"))


def examples(spine: DataFrame, latest: DataFrame, n: int) -> DataFrame:
    """The first n cases of each site with a map from model to its last output row."""
    entry = F.struct("model", F.struct("score", "passed", "error").alias("row"))
    held = latest.groupBy("site_id", "case_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("outputs"))
    return first_cases(spine, n).join(held, ["site_id", "case_id"], "left")
