"""Which model a site should use: candidate checks, decisions, and what needs a look."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import EPSILON, NEAR_MISS, Settings


def model_dim(spark: SparkSession, settings: Settings) -> DataFrame:
    """(model, ord, price_in, price_out): the baseline and the candidates in their order; a model without a price is an error where costs are needed."""
    rows = [(m, i, *settings.prices.get(m, (None, None))) for i, m in enumerate(settings.models)]
    return spark.createDataFrame(rows, "model string, ord int, price_in double, price_out double")


def call_cost(prompt="avg_prompt_tokens", completion="avg_completion_tokens"):
    """USD of one call; null where tokens or the price are unknown."""
    return (F.col(prompt) * F.col("price_in") + F.col(completion) * F.col("price_out")) / 1e6


def strict_price(stats: DataFrame) -> DataFrame:
    """Fails on a scored model that has no price."""
    message = F.concat(F.lit("no pricing for model "), F.col("model"))
    return stats.withColumn("price_in", F.when(F.col("price_in").isNull() & (F.col("scored") > 0), F.raise_error(message).cast("double")).otherwise(F.col("price_in")))


def with_cost(stats: DataFrame) -> DataFrame:
    return strict_price(stats).withColumn("cost_per_call", F.when(F.col("scored") > 0, call_cost()))


def percent(c):
    """A share as whole per cent, halves to even."""
    return F.concat(F.bround(F.col(c) * 100 if isinstance(c, str) else c * 100, 0).cast("bigint").cast("string"), F.lit("%"))


_ENTRY = ["model", "ord", "cases", "scored", "errors", "pass_rate", "complete", "cost_per_call"]


def by_site(rated: DataFrame, settings: Settings) -> DataFrame:
    """``(site_id, base, others)``: a site's few models in one row, the baseline apart; a site without a row of the baseline has none."""
    entry, is_base = F.struct(*_ENTRY), F.col("model") == settings.baseline
    rows = rated.groupBy("site_id").agg(F.first(F.when(is_base, entry), ignorenulls=True).alias("base"), F.array_sort(F.collect_list(F.when(~is_base, F.struct("ord", entry.alias("m"))))).alias("others"))
    return rows.filter("base is not null").select("site_id", "base", F.transform("others", lambda o: o["m"]).alias("others"))


def incomplete(of: str | None = None):
    text = lambda c: (F.col(of)[c] if of else F.col(c)).cast("string")
    return F.concat(F.lit("incomplete results ("), text("errors"), F.lit(" errors, "), text("scored"), F.lit("/"), text("cases"), F.lit(" scored)"))


def _check(c, base, settings: Settings):
    """struct(cost, less_rate, ord, model, reason, ok, ratio) of candidate ``c`` against ``base``, in an order that puts the best first."""
    ratio = F.try_divide(c["pass_rate"], base["pass_rate"])
    text = lambda k: c[k].cast("string")
    keeps = F.concat(F.lit("keeps "), percent(ratio), F.lit(" of baseline quality"))
    cheaper = F.coalesce(c["cost_per_call"] < base["cost_per_call"], F.lit(False))
    reason = (
        F.when(c["scored"] == 0, "no results")
        .when(~c["complete"], F.concat(F.lit("incomplete results ("), text("errors"), F.lit(" errors, "), text("scored"), F.lit("/"), text("cases"), F.lit(" scored)")))
        .when(ratio < settings.threshold - EPSILON, F.concat(keeps, F.lit(", needs "), percent(F.lit(settings.threshold))))
        .when(c["pass_rate"] < settings.floor - EPSILON, F.concat(F.lit("pass rate "), percent(c["pass_rate"]), F.lit(" is below the floor "), percent(F.lit(settings.floor))))
        .when(~cheaper, "not cheaper than the baseline")
        .otherwise(F.concat(keeps, F.lit(" and costs less")))
    )
    good = (c["scored"] > 0) & c["complete"] & (ratio >= settings.threshold - EPSILON) & (c["pass_rate"] >= settings.floor - EPSILON) & cheaper
    return F.struct(c["cost_per_call"].alias("cost"), (-c["pass_rate"]).alias("less_rate"), c["ord"].alias("ord"), c["model"].alias("model"), reason.alias("reason"), F.coalesce(good, F.lit(False)).alias("ok"), ratio.alias("ratio"), c.alias("m"))


def _checks(sites: DataFrame, settings: Settings) -> DataFrame:
    sound = F.col("base.complete") & (F.col("base.pass_rate") > 0)
    checks = F.transform("others", lambda c: _check(c, F.col("base"), settings))
    return sites.withColumn("checks", F.when(F.coalesce(sound, F.lit(False)), checks))


def check_candidates(rated: DataFrame, settings: Settings) -> DataFrame:
    """Each candidate against its site's baseline: ratio, verdict, and the reason of the first check it fails.

    Sites whose baseline is incomplete or passes nothing have no checks. Comparisons leave EPSILON of room.
    """
    rows = _checks(by_site(rated, settings), settings).select("site_id", "base", F.explode("checks").alias("x"))
    return rows.select("site_id", *(F.col("x.m")[c].alias(c) for c in _ENTRY), F.col("base.pass_rate").alias("base_rate"), F.col("base.cost_per_call").alias("base_cost"), "x.ratio", "x.reason", "x.ok")


def decide(rated: DataFrame, settings: Settings) -> DataFrame:
    """One decision for each site: the cheapest candidate that passed, ties to the higher pass rate and then the list's order, else the baseline with the reason.

    ``rated`` is read once and shuffled once, by site.
    """
    if not 0 < settings.threshold <= 1 or not 0 <= settings.floor <= 1:
        raise ValueError("threshold must be in (0, 1] and min_pass_rate in [0, 1]")
    sites = _checks(by_site(rated, settings), settings).withColumn("best", F.array_min(F.filter("checks", lambda x: x["ok"])))
    none = "no candidate models" if len(settings.models) == 1 else "no cheaper model passed the checks"
    reason = (
        F.when(F.col("base.scored") == 0, "no baseline results")
        .when(~F.col("base.complete"), F.concat(F.lit("baseline has "), incomplete("base")))
        .when(F.col("base.pass_rate") == 0, "baseline passes no cases; nothing to compare against")
        .otherwise(F.coalesce("best.reason", F.lit(none)))
    )
    return sites.select(
        "site_id",
        F.when(F.col("best").isNotNull(), "downgrade").otherwise("keep").alias("action"),
        F.coalesce("best.model", F.lit(settings.baseline)).alias("model"),
        F.lit(settings.baseline).alias("baseline"),
        reason.alias("reason"),
        F.col("base.pass_rate").alias("baseline_pass_rate"),
        F.coalesce(F.col("base.complete") & (F.col("base.pass_rate") < settings.floor - EPSILON), F.lit(False)).alias("baseline_below_floor"),
    )


def near_misses(checks: DataFrame, settings: Settings) -> DataFrame:
    """Failed candidates just under the threshold; unlike the checks, compared without room."""
    return checks.filter(~F.col("ok") & F.col("ratio").isNotNull() & (F.col("ratio") >= settings.threshold - NEAR_MISS) & (F.col("ratio") < settings.threshold) & (F.col("pass_rate") >= settings.floor))


def missing_data(rated: DataFrame, settings: Settings) -> DataFrame:
    """Sites whose baseline has no complete results."""
    return rated.filter((F.col("model") == settings.baseline) & ~F.col("complete"))


def model_entries(rated: DataFrame) -> DataFrame:
    """For each site its models in order, as one array of entries."""
    entry = F.struct("ord", "model", F.round("pass_rate", 6).alias("pass_rate"), "cases", "scored", "errors")
    return rated.groupBy("site_id").agg(F.array_sort(F.collect_list(entry)).alias("models"))


def entry_of(models: str, name):
    """The entry of the model ``name`` in an array of :func:`model_entries`, or null."""
    return F.get(F.filter(models, lambda m: m["model"] == name), F.lit(0))
