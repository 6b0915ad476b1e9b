"""Money: cost of calls, sites and analyses, savings, payback and hosting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import DAYS_PER_MONTH, HOURS_PER_MONTH, JUDGE_COMPLETION_TOKENS, JUDGE_EXTRA_PROMPT_TOKENS, Settings


def volume_of(site: str, settings: Settings):
    """Calls a day of a site: its override, else the default."""
    out = F.lit(settings.default_volume)
    if settings.volumes:
        pairs = [F.lit(x) for s, v in settings.volumes.items() for x in (s, v)]
        out = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(site)), out)
    return out.cast("bigint")


def site_costs(decisions: DataFrame, rated: DataFrame, settings: Settings, days: int = DAYS_PER_MONTH) -> DataFrame:
    """Cost of each site before and after its decision; either model is priced with its own tokens. Unknown stays null."""
    if days <= 0 or settings.default_volume < 0 or min(settings.volumes.values(), default=0) < 0:
        raise ValueError("days must be over 0 and volumes not negative")
    before = rated.filter(F.col("model") == settings.baseline).select("site_id", F.col("cost_per_call").alias("before_call"))
    after = rated.select("site_id", "model", F.col("cost_per_call").alias("after_call"))
    rows = decisions.select("site_id", "action", "model").join(before, "site_id", "left").join(after, ["site_id", "model"], "left").withColumn("per_day", volume_of("site_id", settings))
    month = lambda c: F.col(c) * F.col("per_day") * days
    rows = rows.withColumns({"before_month": month("before_call"), "after_month": month("after_call")}).withColumn("savings", F.col("before_month") - F.col("after_month"))
    return rows.withColumn("savings_pct", F.try_divide(F.col("savings"), F.when(F.col("before_month") != 0, F.col("before_month"))) * 100)


def summary(costs: DataFrame, before: str = "before_month", after: str = "after_month", key: str = "site_id") -> DataFrame:
    """Totals over rows whose costs are both known, and the ids of the others."""
    known = F.col(before).isNotNull() & F.col(after).isNotNull()
    out = costs.agg(
        F.coalesce(F.sum(F.when(known, F.col(before))), F.lit(0.0)).alias("before"),
        F.coalesce(F.sum(F.when(known, F.col(after))), F.lit(0.0)).alias("after"),
        F.count_if(~known).alias("n_unknown"),
    )
    out = out.withColumn("savings", F.col("before") - F.col("after"))
    return out.withColumn("savings_pct", F.try_divide("savings", F.when(F.col("before") != 0, F.col("before"))) * 100)


def project_summary(decisions: DataFrame, costs: DataFrame, cases: DataFrame, latest: DataFrame) -> DataFrame:
    """One row of a project's figures: call sites and those that change, eval sets and cases, judges, monthly cost before and after. Each part is an aggregate of one row."""
    from .results import judge_models, sum_cases

    n = decisions.agg(F.count("*").alias("call_sites"), F.count_if(F.col("action") == "downgrade").alias("downgrades"))
    parts = [sum_cases(cases), judge_models(latest), summary(costs)]
    for part in parts:
        n = n.crossJoin(F.broadcast(part))
    return n


def dominant_judge(latest: DataFrame) -> DataFrame:
    """One row: the judge of most rows without an error, the first by name of equals; null if there is none."""
    counts = latest.filter(F.col("error").isNull() & F.col("judge_model").isNotNull()).groupBy("judge_model").count()
    return counts.agg(F.min_by("judge_model", F.struct(-F.col("count"), "judge_model")).alias("judge_model"), F.sum("count").alias("judge_rows"))


def analysis_cost(latest: DataFrame, settings: Settings, audit_cost: float = 0.0) -> DataFrame:
    """One row: the one-time cost of the eval runs in the log.

    Rows with an error cost nothing; models without a price are passed over. All judged rows are priced as
    the dominant judge, or as the baseline where that has no price; with neither priced they cost nothing.
    """
    if audit_cost < 0:
        raise ValueError(f"audit_cost must be >= 0, got {audit_cost}")
    spark = latest.sparkSession
    prices = F.broadcast(spark.createDataFrame([(m, *p) for m, p in settings.prices.items()], "model string, price_in double, price_out double"))
    rows = latest.filter(F.col("error").isNull()).join(prices, "model", "left")
    cost = (F.col("prompt_tokens") * F.col("price_in") + F.col("completion_tokens") * F.col("price_out")) / 1e6
    judged = F.col("judge_model").isNotNull()
    sums = rows.agg(
        F.count_if(F.col("price_in").isNotNull()).alias("model_calls"),
        F.coalesce(F.sum(cost), F.lit(0.0)).alias("model_cost"),
        F.count_if(judged).alias("judged"),
        F.coalesce(F.sum(F.when(judged, F.col("prompt_tokens") + F.col("completion_tokens") + JUDGE_EXTRA_PROMPT_TOKENS)), F.lit(0)).alias("judge_in"),
    )
    judge = dominant_judge(latest).select("judge_model")
    priced = F.when(F.col("judge_model").isin(*settings.prices), F.col("judge_model")).when(F.col("judge_model").isNotNull() & F.lit(settings.baseline in settings.prices), F.lit(settings.baseline))
    own = prices.select(F.col("model").alias("judge_priced_as"), F.col("price_in").alias("jin"), F.col("price_out").alias("jout"))
    out = sums.crossJoin(judge).withColumn("judge_priced_as", priced).join(own, "judge_priced_as", "left")
    out = out.withColumn("judge_calls", F.when(F.col("jin").isNotNull(), F.col("judged")).otherwise(0))
    out = out.withColumn("judge_cost", F.when(F.col("jin").isNotNull(), (F.col("judge_in") * F.col("jin") + F.col("judged") * JUDGE_COMPLETION_TOKENS * F.col("jout")) / 1e6).otherwise(0.0))
    out = out.withColumn("audit_cost", F.lit(float(audit_cost)))
    return out.select("model_calls", "model_cost", "judge_calls", "judge_cost", "judge_model", "judge_priced_as", "audit_cost", (F.col("model_cost") + F.col("judge_cost") + F.col("audit_cost")).alias("total"))


def payback_hours(total: str = "total", savings: str = "savings"):
    """Hours until monthly savings cover a one-time cost; null without savings."""
    return F.when(F.col(savings) > 0, F.col(total) / (F.col(savings) / HOURS_PER_MONTH))


def payback_label(hours: str = "hours"):
    """Hours in words: minutes under one hour, one decimal under 48, then days, both rounded up."""
    h = F.col(hours)
    minutes = F.greatest(F.ceil(h * 60), F.lit(1)).cast("bigint")
    days = F.ceil(h / 24).cast("bigint")
    return (
        F.when(h.isNull(), "never")
        .when(h < 1, F.concat(minutes.cast("string"), F.when(minutes == 1, " minute").otherwise(" minutes")))
        .when(h < 48, F.concat(F.format_string("%.1f", F.bround(h, 1)), F.lit(" hours")))
        .otherwise(F.concat(days.cast("string"), F.lit(" days")))
    )


def mean_quality(decisions: DataFrame, rated: DataFrame) -> DataFrame:
    """Mean pass rate before and after, over sites that have both."""
    rate = rated.select("site_id", "model", "pass_rate")
    both = decisions.join(rate, ["site_id", "model"], "left").filter(F.col("pass_rate").isNotNull() & F.col("baseline_pass_rate").isNotNull())
    return both.agg(F.avg("baseline_pass_rate").alias("before"), F.avg("pass_rate").alias("after"))


def hosting(rows: DataFrame) -> DataFrame:
    """``rows(gpu_hour, tokens_per_s, utilization, tokens_per_call, api_per_call, calls_per_day)`` with the monthly price of one GPU, its capacity, the calls a day from which it pays, whether it can, and the GPUs needed.

    ``can_win``: one GPU can serve the calls from which it pays. Prices and rates must not be negative, speed, utilization (1 at most) and
    tokens of a call must be over 0; other rows are an error.
    """
    bad = (F.col("gpu_hour") < 0) | (F.col("tokens_per_s") <= 0) | (F.col("utilization") <= 0) | (F.col("utilization") > 1) | (F.col("tokens_per_call") <= 0) | (F.col("api_per_call") < 0) | (F.col("calls_per_day") < 0)
    rows = rows.withColumn("gpu_hour", F.when(bad, F.raise_error(F.lit("hosting figures out of range")).cast("double")).otherwise(F.col("gpu_hour")))
    month = F.col("gpu_hour") * HOURS_PER_MONTH
    tokens = F.col("tokens_per_s") * F.col("utilization") * HOURS_PER_MONTH * 3600
    need = F.ceil(F.col("calls_per_day") * DAYS_PER_MONTH * F.col("tokens_per_call") / tokens)
    return rows.withColumns(
        {
            "gpu_month": month,
            "capacity_per_day": tokens / F.col("tokens_per_call") / DAYS_PER_MONTH,
            "tokens_per_month": tokens,
            "break_even_per_day": F.when(F.col("api_per_call") > 0, F.try_divide(month, F.col("api_per_call") * DAYS_PER_MONTH)).otherwise(F.lit(float("inf"))),
            "gpus": F.greatest(F.lit(1).cast("bigint"), need.cast("bigint")),
        }
    ).withColumn("can_win", F.col("break_even_per_day") <= F.col("capacity_per_day"))


def sort_by_savings(costs: DataFrame) -> DataFrame:
    """Largest savings first, unknown last, equals by id."""
    return costs.orderBy(F.desc_nulls_last("savings"), "site_id")
