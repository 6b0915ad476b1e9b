"""Registered queries over the given tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import render
from ..operators import decide as D
from ..operators import money as M
from ..operators import results as R
from .bindings import DOMAIN_SQL, SETTINGS, results, spine, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with SQL over the given tables."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def domain(select: str) -> str:
    return f"{DOMAIN_SQL} {select}"


def dims(spark: SparkSession) -> DataFrame:
    return D.model_dim(spark, SETTINGS)


def latest(spark: SparkSession, d: str) -> DataFrame:
    return R.last_wins(results(spark, d))


def rated(spark: SparkSession, d: str) -> DataFrame:
    return D.with_cost(R.summarize(spine(spark, d), dims(spark), latest(spark, d)))


# ---- the result log


@query(domain("select site_id, model, case_id, seq, error, passed, round(score, 6) as score from latest"))
def results_last_wins(spark, d):
    return latest(spark, d).select("site_id", "model", "case_id", "seq", "error", "passed", F.round("score", 6).alias("score"))


@query(domain("select site_id, model, count(*) as n, count(*) filter (error is null and score is not null) as n_ok from results group by all"))
def results_ok(spark, d):
    return results(spark, d).groupBy("site_id", "model").agg(F.count("*").alias("n"), F.count_if(R.is_ok()).alias("n_ok"))


@query(domain("select s.site_id, m.model, s.case_id from spine s cross join models m anti join (select * from latest where error is null and score is not null) l on l.site_id = s.site_id and l.model = m.model and l.case_id = s.case_id"))
def resume_todo(spark, d):
    return R.todo(spine(spark, d).select("site_id", "case_id"), dims(spark), latest(spark, d)).select("site_id", "model", "case_id")


@query(domain("select site_id, model, case_id, judge_model from latest where (error is null or error like 'scoring failed%') and not (error is null and score is not null and judge_model is not distinct from 'j_b')"))
def rescore_select(spark, d):
    return R.to_rescore(latest(spark, d), "j_b").select("site_id", "model", "case_id", "judge_model")


ROUNDED = ["mean_score", "avg_latency_s", "avg_prompt_tokens", "avg_completion_tokens", "avg_judge_score", "pass_rate"]


@query(domain("select site_id, model, cases, scored, passed, errors, complete, " + ", ".join(f"round({c}, 9) as {c}" for c in ROUNDED) + " from rated"))
def run_summary(spark, d):
    return R.summarize(spine(spark, d), dims(spark), latest(spark, d)).select("site_id", "model", "cases", "scored", "passed", "errors", "complete", *(F.round(c, 9).alias(c) for c in ROUNDED))


@query(domain("select site_id, case_id, " + ", ".join(f"max(cast(passed as integer)) filter (model = '{m}') as {m}" for m in SETTINGS.models) + " from latest where error is null and score is not null group by site_id, case_id"))
def pass_grid_pivot(spark, d):
    return R.pass_grid(latest(spark, d), SETTINGS.models)


@query(domain("select site_id, case_id, line from spine where line < 5"))
def first_n_cases(spark, d):
    return R.first_cases(spine(spark, d), 5)


@query(domain("select site_id, case_id, line, n_outputs, n_passed from (select s.site_id, s.case_id, any_value(s.line) as line, count(l.model) as n_outputs, count(*) filter (l.passed) as n_passed from spine s left join latest l on l.site_id = s.site_id and l.case_id = s.case_id where s.line < 3 group by s.site_id, s.case_id)"))
def example_outputs(spark, d):
    rows = R.examples(spine(spark, d), latest(spark, d), 3)
    values = F.map_values("outputs")
    return rows.select("site_id", "case_id", "line", F.coalesce(F.size("outputs"), F.lit(0)).cast("bigint").alias("n_outputs"), F.coalesce(F.size(F.filter(values, lambda x: x["passed"])), F.lit(0)).cast("bigint").alias("n_passed")).withColumn("n_outputs", F.greatest("n_outputs", F.lit(0))).withColumn("n_passed", F.greatest("n_passed", F.lit(0)))


@query(domain("select judge_model, round(avg(judge_score), 6) as avg_judge_score, count(*) as n from latest where error is null and judge_model is not null group by judge_model"))
def judge_avg(spark, d):
    return latest(spark, d).filter("error is null and judge_model is not null").groupBy("judge_model").agg(F.round(F.avg("judge_score"), 6).alias("avg_judge_score"), F.count("*").alias("n"))


@query("with ev as (select *, cast(json_extract_string(props, '$.k') as integer) as k from events) select user_id % 512 as site, event_id % 4 as slot, count(*) as rows_, max(event_id) as last_seq, round(sum(value), 2) as total from ev group by all")
def wide_sites(spark, d):
    """512 sites, for shuffle pressure."""
    e = table(spark, d, "events")
    return e.groupBy((F.col("user_id") % 512).alias("site"), (F.col("event_id") % 4).alias("slot")).agg(F.count("*").alias("rows_"), F.max("event_id").alias("last_seq"), F.round(F.sum("value"), 2).alias("total"))


# ---- decisions


@query(domain("select site_id, model, round(ratio, 6) as ratio, round(pass_rate, 6) as pass_rate, round(cost_per_call, 12) as cost_per_call, ok, reason from judged"))
def candidate_checks(spark, d):
    return D.check_candidates(rated(spark, d), SETTINGS).select("site_id", "model", F.round("ratio", 6).alias("ratio"), F.round("pass_rate", 6).alias("pass_rate"), F.round("cost_per_call", 12).alias("cost_per_call"), "ok", "reason")


@query(domain("select site_id, action, model, baseline, reason, round(baseline_pass_rate, 6) as baseline_pass_rate, baseline_below_floor from decisions"))
def decide_site(spark, d):
    return D.decide(rated(spark, d), SETTINGS).withColumn("baseline_pass_rate", F.round("baseline_pass_rate", 6))


@query(domain("select site_id, model, round(ratio, 6) as ratio from judged where not ok and ratio >= 0.95 - 0.05 and ratio < 0.95 and pass_rate >= 0.8"))
def near_misses(spark, d):
    return D.near_misses(D.check_candidates(rated(spark, d), SETTINGS), SETTINGS).select("site_id", "model", F.round("ratio", 6).alias("ratio"))


@query(domain("select site_id, round(baseline_pass_rate, 6) as baseline_pass_rate from decisions where baseline_below_floor"))
def below_floor(spark, d):
    return D.decide(rated(spark, d), SETTINGS).filter("baseline_below_floor").select("site_id", F.round("baseline_pass_rate", 6).alias("baseline_pass_rate"))


@query(domain("select site_id, errors, scored, cases from rated where model = 'm_big' and not complete"))
def missing_data(spark, d):
    return D.missing_data(rated(spark, d), SETTINGS).select("site_id", "errors", "scored", "cases")


@query(domain("select site_id, count(*) as n_models, string_agg(model || ':' || scored, ',' order by ord) as listed from rated group by site_id"))
def model_entry(spark, d):
    e = D.model_entries(rated(spark, d))
    return e.select("site_id", F.size("models").cast("bigint").alias("n_models"), F.array_join(F.transform("models", lambda m: F.concat(m["model"], F.lit(":"), m["scored"].cast("string"))), ",").alias("listed"))


# ---- money


@query(domain("select site_id, model, round(cost_per_call, 12) as cost_per_call from rated"))
def call_cost(spark, d):
    return rated(spark, d).select("site_id", "model", F.round("cost_per_call", 12).alias("cost_per_call"))


def costs(spark, d):
    r = rated(spark, d)
    return M.site_costs(D.decide(r, SETTINGS), r, SETTINGS)


@query(domain("select site_id, action, model, cast(per_day as bigint) as per_day, round(before_month, 6) as before_month, round(after_month, 6) as after_month, round(before_month - after_month, 6) as savings from costs"))
def site_cost(spark, d):
    return costs(spark, d).select("site_id", "action", "model", "per_day", *(F.round(c, 6).alias(c) for c in ("before_month", "after_month", "savings")))


@query(domain("select round(coalesce(sum(before_month), 0), 6) as before, round(coalesce(sum(after_month), 0), 6) as after, round(coalesce(sum(before_month), 0) - coalesce(sum(after_month), 0), 6) as savings, count(*) filter (before_month is null or after_month is null) as n_unknown from costs"))
def cost_summary(spark, d):
    return M.summary(costs(spark, d)).select(*(F.round(c, 6).alias(c) for c in ("before", "after", "savings")), "n_unknown")


@query(domain("select site_id from costs where before_month is null or after_month is null"))
def cost_unknown(spark, d):
    return costs(spark, d).filter("before_month is null or after_month is null").select("site_id")


ANALYSIS_SQL = """select count(*) as model_calls, round(sum((prompt_tokens * price_in + completion_tokens * price_out) / 1e6), 9) as model_cost,
  count(*) filter (judge_model is not null) as judge_calls,
  round(sum(((prompt_tokens + completion_tokens + 150) * 2.5 + 200 * 10.0) / 1e6) filter (judge_model is not null), 9) as judge_cost,
  (select arg_min(judge_model, (-n, judge_model)) from (select judge_model, count(*) as n from latest where error is null and judge_model is not null group by judge_model)) as judge_model,
  'm_big' as judge_priced_as from latest join models using (model) where error is null"""


@query(domain(ANALYSIS_SQL))
def analysis_cost(spark, d):
    a = M.analysis_cost(latest(spark, d), SETTINGS)
    return a.select("model_calls", F.round("model_cost", 9).alias("model_cost"), "judge_calls", F.round("judge_cost", 9).alias("judge_cost"), "judge_model", "judge_priced_as")


@query(domain("select arg_min(judge_model, (-n, judge_model)) as judge_model, cast(sum(n) as bigint) as judge_rows from (select judge_model, count(*) as n from latest where error is null and judge_model is not null group by judge_model)"))
def dominant_judge(spark, d):
    return M.dominant_judge(latest(spark, d))


@query(domain("select site_id, round(case when before_month > after_month then 100.0 / ((before_month - after_month) / 730) end, 6) as hours from costs"))
def payback_hours(spark, d):
    return costs(spark, d).withColumn("total", F.lit(100.0)).select("site_id", F.round(M.payback_hours(), 6).alias("hours"))


@query("""select event_id, case when h is null then 'never' when h < 1 then cast(greatest(ceil(h * 60), 1) as bigint) || case when greatest(ceil(h * 60), 1) = 1 then ' minute' else ' minutes' end
  when h < 48 then printf('%.1f', round_even(h, 1)) || ' hours' else cast(ceil(h / 24) as bigint) || ' days' end as label
  from (select event_id, case when event_type <> 'error' then value * value / 64 end as h from events)""")
def payback_label(spark, d):
    h = F.when(F.col("event_type") != "error", F.col("value") * F.col("value") / 64)
    return table(spark, d, "events").select("event_id", h.alias("hours")).select("event_id", M.payback_label().alias("label"))


@query(domain("select round(avg(baseline_pass_rate), 6) as before, round(avg(r.pass_rate), 6) as after from decisions d join rated r on r.site_id = d.site_id and r.model = d.model where r.pass_rate is not null and d.baseline_pass_rate is not null"))
def mean_quality(spark, d):
    r = rated(spark, d)
    return M.mean_quality(D.decide(r, SETTINGS), r).select(F.round("before", 6).alias("before"), F.round("after", 6).alias("after"))


def hosts(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", (F.col("p_retailprice") / 1000).alias("gpu_hour"), (F.col("p_size") * 100.0).alias("tokens_per_s"), F.lit(0.5).alias("utilization"), (F.col("p_size") + 100.0).alias("tokens_per_call"), F.when(F.col("p_size") % 7 == 0, 0.0).otherwise(F.col("p_size") / 1e5).alias("api_per_call"), (F.col("p_partkey") * 1000).alias("calls_per_day"))


HOSTS_SQL = "with h as (select p_partkey, p_retailprice / 1000 as gpu_hour, p_size * 100.0 as tps, p_size + 100.0 as per_call, case when p_size % 7 = 0 then 0.0 else p_size / 1e5 end as api, p_partkey * 1000 as calls from part)"


@query(f"{HOSTS_SQL} select p_partkey, round(gpu_hour * 730, 6) as gpu_month, case when api > 0 then round(gpu_hour * 730 / (api * 30), 4) else cast('Infinity' as double) end as break_even_per_day from h")
def break_even(spark, d):
    return M.hosting(hosts(spark, d)).select("p_partkey", F.round("gpu_month", 6).alias("gpu_month"), F.when(F.col("api_per_call") > 0, F.round("break_even_per_day", 4)).otherwise(F.col("break_even_per_day")).alias("break_even_per_day"))


@query(f"{HOSTS_SQL} select p_partkey, greatest(1, cast(ceil(calls * 30 * per_call / (tps * 0.5 * 730 * 3600)) as bigint)) as gpus from h")
def gpus_needed(spark, d):
    return M.hosting(hosts(spark, d)).select("p_partkey", "gpus")


@query(domain("select site_id, round(before_month - after_month, 6) as savings, cast(row_number() over (order by before_month - after_month desc nulls last, site_id) as integer) as place from costs"))
def sort_by_savings(spark, d):
    from pyspark.sql import Window

    ranked = M.sort_by_savings(costs(spark, d)).withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("savings"), "site_id")))  # a row for each site
    return ranked.select("site_id", F.round("savings", 6).alias("savings"), "place")


@query("select l_shipmode_like as bucket, n, n_unknown, round(before, 2) as before, round(after, 2) as after, round(before - after, 2) as savings from (select l_suppkey % 64 as l_shipmode_like, count(*) as n, count(*) filter (l_returnflag = 'R') as n_unknown, sum(l_extendedprice) filter (l_returnflag <> 'R') as before, sum(l_extendedprice * (1 - l_discount)) filter (l_returnflag <> 'R') as after from lineitem group by 1)")
def rollup_savings(spark, d):
    known = F.col("l_returnflag") != "R"
    rows = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 64).alias("bucket")).agg(
        F.count("*").alias("n"),
        F.count_if(~known).alias("n_unknown"),
        F.sum(F.when(known, F.col("l_extendedprice"))).alias("before"),
        F.sum(F.when(known, F.col("l_extendedprice") * (1 - F.col("l_discount")))).alias("after"),
    )
    return rows.select("bucket", "n", "n_unknown", F.round("before", 2).alias("before"), F.round("after", 2).alias("after"), F.round(F.col("before") - F.col("after"), 2).alias("savings"))


@query(domain("select site_id, replace(site_id, '/', '.') as slug, action, model, count(*) as n_models, round(any_value(before_month), 4) as before_month from costs join (select site_id from rated) using (site_id) group by all"))
def export_sites(spark, d):
    """The fields of each site's JSON document."""
    from ..render import site_payload

    r = rated(spark, d)
    decisions = D.decide(r, SETTINGS)
    docs = site_payload(r, decisions, M.site_costs(decisions, r, SETTINGS))
    get = lambda p: F.get_json_object("doc", p)
    return docs.select("site_id", "slug", get("$.decision.action").alias("action"), get("$.decision.model").alias("model"), F.json_array_length(get("$.models")).cast("bigint").alias("n_models"), F.round(get("$.cost.before_month").cast("double"), 4).alias("before_month"))


# ---- many sites: incomplete baselines, unknown costs

WIDE = 512


def wide(select: str) -> str:
    return domain(select).replace("user_id % 8", f"user_id % {WIDE}")


def rated_wide(spark: SparkSession, d: str) -> DataFrame:
    return D.with_cost(R.summarize(spine(spark, d, WIDE), dims(spark), R.last_wins(results(spark, d, WIDE))))


@query(wide("select site_id, errors, scored, cases from rated where model = 'm_big' and not complete"))
def missing_data_wide(spark, d):
    return D.missing_data(rated_wide(spark, d), SETTINGS).select("site_id", "errors", "scored", "cases")


@query(f"select distinct 'site_' || (user_id % {WIDE}) as site_id from events where user_id % {WIDE} >= 8")
def cost_unknown_wide(spark, d):
    """Sites that have cases and were never run."""
    r = D.with_cost(R.summarize(spine(spark, d, WIDE), dims(spark), latest(spark, d)))
    return M.site_costs(D.decide(r, SETTINGS), r, SETTINGS).filter("before_month is null").select("site_id")


#: With this threshold some candidates are just under it.
LOWER = replace(SETTINGS, threshold=0.9, floor=0.0)


@query(domain("select site_id, model, round(ratio, 6) as ratio from checks0 where complete and ratio >= 0.9 - 0.05 and ratio < 0.9"))
def near_misses_lower(spark, d):
    return D.near_misses(D.check_candidates(rated(spark, d), LOWER), LOWER).filter("complete").select("site_id", "model", F.round("ratio", 6).alias("ratio"))


# ---- small results


@query(domain("select string_agg(distinct judge_model, ',' order by judge_model) as judges from latest"))
def judge_models(spark, d):
    return R.judge_models(latest(spark, d)).select(F.array_join("judges", ",").alias("judges"))


@query(domain("select count(distinct site_id) as sets, count(*) as cases from spine"))
def sum_cases(spark, d):
    return R.sum_cases(spine(spark, d))


@query(domain("select site_id, " + ", ".join(f"count(*) filter (model = '{m}' and passed and error is null and score is not null) as {m}" for m in SETTINGS.models) + " from latest where error is null and score is not null group by site_id"))
def grid_totals(spark, d):
    return R.grid_totals(R.pass_grid(latest(spark, d), SETTINGS.models), SETTINGS.models)


@query(domain("select d.site_id, r.model, r.scored, round(r.pass_rate, 6) as pass_rate from decisions d join rated r on r.site_id = d.site_id and r.model = d.model"))
def chosen_entry(spark, d):
    """The chosen model's entry of each site's array of models."""
    r = rated(spark, d)
    both = D.model_entries(r).join(D.decide(r, SETTINGS).select("site_id", F.col("model").alias("chosen")), "site_id").withColumn("e", D.entry_of("models", F.col("chosen")))
    return both.select("site_id", "e.model", "e.scored", "e.pass_rate")


@query(f"{HOSTS_SQL} select p_partkey, round(tps * 0.5 * 730 * 3600 / per_call / 30, 4) as capacity_per_day, case when api > 0 then gpu_hour * 730 / (api * 30) else cast('Infinity' as double) end <= tps * 0.5 * 730 * 3600 / per_call / 30 as can_win from h")
def hosting_capacity(spark, d):
    return M.hosting(hosts(spark, d)).select("p_partkey", F.round("capacity_per_day", 4).alias("capacity_per_day"), "can_win")


@query(domain("""select (select count(*) from decisions) as call_sites, (select count(*) from decisions where action = 'downgrade') as downgrades, (select count(distinct site_id) from spine) as sets, (select count(*) from spine) as cases,
  (select string_agg(distinct judge_model, ',' order by judge_model) from latest) as judges, round(coalesce(sum(before_month), 0), 6) as before, round(coalesce(sum(after_month), 0), 6) as after from costs where before_month is not null and after_month is not null"""))
def project_summary(spark, d):
    """The project's figures in one row."""
    r = rated(spark, d)
    decisions = D.decide(r, SETTINGS)
    out = M.project_summary(decisions, M.site_costs(decisions, r, SETTINGS), spine(spark, d), latest(spark, d))
    return out.select("call_sites", "downgrades", "sets", "cases", F.array_join("judges", ",").alias("judges"), F.round("before", 6).alias("before"), F.round("after", 6).alias("after"))


# ---- documents of cases


def case_rows(spark, d):
    line = F.col("line").cast("string")
    return spine(spark, d).withColumns({"inputs": F.create_map(F.lit("body"), F.concat(F.lit("in "), line)), "expected": F.concat(F.lit("want "), line), "notes": F.lit(None).cast("string")})


def answers(spark, d):
    return latest(spark, d).withColumns({"output": F.concat(F.lit("out "), F.col("seq").cast("string")), "detail": F.lit(None).cast("string")})


@query(domain("select site_id, case_id, " + ", ".join(f"max(passed) filter (model = '{m}') as {m}" for m in SETTINGS.models) + " from spine left join latest using (site_id, case_id) group by all"))
def grid_documents(spark, d):
    """What each model made of each case, read back from the documents; null where it never ran or failed."""
    docs = render.grid_payload(case_rows(spark, d), answers(spark, d), SETTINGS.models)
    kind = f"site_id string, id string, passed struct<{', '.join(f'{m}: boolean' for m in SETTINGS.models)}>"
    return docs.select(F.from_json("doc", kind).alias("x")).select("x.site_id", F.col("x.id").alias("case_id"), "x.passed.*")


@query(domain("""select s.site_id, s.case_id, 'in ' || s.line as body, 'want ' || s.line as expected, m.model, 'out ' || l.seq as output, l.passed, round(l.score, 4) as score, cast(l.judge_score as integer) as judge_score, l.error, 20 as cases
  from spine s cross join models m left join latest l on l.site_id = s.site_id and l.case_id = s.case_id and l.model = m.model where s.line < 5"""))
def example_documents(spark, d):
    """The first five cases of each site with every model's last answer, read back from the documents."""
    docs = render.examples_payload(case_rows(spark, d), answers(spark, d), SETTINGS.models, 5)
    kind = "site_id string, cases int, examples array<struct<id: string, inputs: map<string, string>, expected: string, outputs: map<string, struct<output: string, passed: boolean, score: double, judge_score: int, error: string>>>>"
    rows = docs.select(F.from_json("doc", kind).alias("x")).select("x.site_id", "x.cases", F.explode("x.examples").alias("e"))
    rows = rows.select("site_id", "cases", F.col("e.id").alias("case_id"), F.col("e.inputs")["body"].alias("body"), "e.expected", F.explode("e.outputs").alias("model", "o"))
    return rows.select("site_id", "case_id", "body", "expected", "model", "o.output", "o.passed", "o.score", "o.judge_score", "o.error", "cases")
