"""The domain's tables as views of the given ones, built the same way in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import Settings

SITES, CASES = 8, 20
MODELS = ["m_big", "m_mid", "m_small", "m_tiny"]
SETTINGS = Settings(
    baseline="m_big",
    candidates=["m_mid", "m_small", "m_tiny"],
    prices={"m_big": (2.5, 10.0), "m_mid": (0.4, 1.6), "m_small": (0.15, 0.6), "m_tiny": (0.1, 0.4)},
    threshold=0.95,
    floor=0.8,
    default_volume=20_000,
    volumes={"site_3": 5_000},
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def results(spark: SparkSession, sf_dir: str, sites: int = SITES) -> DataFrame:
    """The append-only result log: one row for each event."""
    return results_of(table(spark, sf_dir, "events"), sites)


def results_of(events: DataFrame, sites: int = SITES) -> DataFrame:
    e = events.select("event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    failed = (F.col("event_type") == "error") & (F.col("event_id") % 41 == 0)
    slot = F.col("event_id") % 4
    cutoff = F.when(slot == 0, 10).when(slot == 1, 11).when(slot == 2, 16).otherwise(35)
    passed = F.col("value") >= cutoff
    return e.select(
        F.concat(F.lit("site_"), (F.col("user_id") % sites).cast("string")).alias("site_id"),
        F.when(slot == 0, MODELS[0]).when(slot == 1, MODELS[1]).when(slot == 2, MODELS[2]).otherwise(MODELS[3]).alias("model"),
        F.concat(F.lit("c"), (F.col("k") % CASES).cast("string")).alias("case_id"),
        F.col("event_id").alias("seq"),
        F.when(failed, "call failed").alias("error"),
        F.when(~failed, passed).alias("passed"),
        F.when(~failed, F.when(passed, 1.0).otherwise(F.least(F.col("value") / 100, F.lit(0.75)))).alias("score"),
        (40 + F.col("k")).cast("bigint").alias("prompt_tokens"),
        (5 + F.col("event_id") % 50).alias("completion_tokens"),
        (F.col("value") / 100).alias("latency_s"),
        (1 + F.col("k") % 5).alias("judge_score"),
        F.when(F.col("event_id") % 3 == 0, "j_a").when(F.col("event_id") % 3 == 1, "j_b").alias("judge_model"),
    )


RESULTS_SQL = """
ev as (select *, cast(json_extract_string(props, '$.k') as integer) as k, event_type = 'error' and event_id % 41 = 0 as failed,
    case event_id % 4 when 0 then 10 when 1 then 11 when 2 then 16 else 35 end as cutoff from events),
results as (select 'site_' || cast(user_id % 8 as varchar) as site_id,
    case event_id % 4 when 0 then 'm_big' when 1 then 'm_mid' when 2 then 'm_small' else 'm_tiny' end as model,
    'c' || cast(k % 20 as varchar) as case_id, event_id as seq,
    case when failed then 'call failed' end as error,
    case when not failed then value >= cutoff end as passed,
    case when not failed then case when value >= cutoff then 1.0::double else least(value / 100, 0.75::double) end end as score,
    cast(40 + k as bigint) as prompt_tokens, cast(5 + event_id % 50 as bigint) as completion_tokens, value / 100 as latency_s,
    1 + k % 5 as judge_score, case event_id % 3 when 0 then 'j_a' when 1 then 'j_b' end as judge_model
  from ev),
latest as (select * from results qualify row_number() over (partition by site_id, model, case_id order by seq desc) = 1)
"""


def spine(spark: SparkSession, sf_dir: str, sites_: int = SITES) -> DataFrame:
    """(site_id, case_id, line): the eval cases of every site the log knows, whether run or not."""
    sites = results(spark, sf_dir, sites_).select("site_id").distinct()
    return sites.select("site_id", F.explode(F.sequence(F.lit(0), F.lit(CASES - 1))).alias("line")).select("site_id", F.concat(F.lit("c"), F.col("line").cast("string")).alias("case_id"), F.col("line").cast("bigint").alias("line"))


SPINE_SQL = """
spine as (select site_id, 'c' || cast(i as varchar) as case_id, i as line from (select distinct site_id from results), (select unnest(range(20)) as i)),
models as (select * from (values ('m_big', 0, 2.5::double, 10.0::double), ('m_mid', 1, 0.4::double, 1.6::double), ('m_small', 2, 0.15::double, 0.6::double), ('m_tiny', 3, 0.1::double, 0.4::double)) v(model, ord, price_in, price_out)),
stats as (select s.site_id, m.model, any_value(ord) as ord, any_value(price_in) as price_in, any_value(price_out) as price_out,
    count(*) as cases, count(*) filter (r.error is null and score is not null) as scored,
    count(*) filter (r.error is null and score is not null and passed) as passed, count(*) filter (r.error is not null) as errors,
    avg(score) filter (r.error is null) as mean_score, avg(latency_s) filter (r.error is null and score is not null) as avg_latency_s,
    avg(prompt_tokens) filter (r.error is null and score is not null) as avg_prompt_tokens,
    avg(completion_tokens) filter (r.error is null and score is not null) as avg_completion_tokens,
    avg(judge_score) filter (r.error is null and score is not null) as avg_judge_score
  from spine s cross join models m left join latest r on r.site_id = s.site_id and r.case_id = s.case_id and r.model = m.model
  group by s.site_id, m.model),
rated as (select *, case when scored > 0 then passed / scored end as pass_rate, cases > 0 and errors = 0 and scored = cases as complete,
    case when scored > 0 then (avg_prompt_tokens * price_in + avg_completion_tokens * price_out) / 1e6 end as cost_per_call from stats),
checks0 as (select c.*, b.pass_rate as base_rate, b.cost_per_call as base_cost, c.pass_rate / nullif(b.pass_rate, 0) as ratio
  from rated c join rated b on b.site_id = c.site_id and b.model = 'm_big' and c.model <> 'm_big' and b.complete and b.pass_rate > 0),
checks as (select *, case when scored = 0 then 'no results'
    when not complete then 'incomplete results (' || errors || ' errors, ' || scored || '/' || cases || ' scored)'
    when ratio < 0.95 - 1e-9 then 'keeps ' || cast(round_even(ratio * 100, 0) as bigint) || '% of baseline quality, needs 95%'
    when pass_rate < 0.8 - 1e-9 then 'pass rate ' || cast(round_even(pass_rate * 100, 0) as bigint) || '% is below the floor 80%'
    when not coalesce(cost_per_call < base_cost, false) then 'not cheaper than the baseline'
    else 'keeps ' || cast(round_even(ratio * 100, 0) as bigint) || '% of baseline quality and costs less' end as reason from checks0),
judged as (select *, reason like '%and costs less' as ok from checks),
best as (select site_id, count(*) as n, arg_min(model, (cost_per_call, -pass_rate, ord)) filter (ok) as model, arg_min(reason, (cost_per_call, -pass_rate, ord)) filter (ok) as reason from judged group by site_id),
decisions as (select b.site_id, case when best.model is not null then 'downgrade' else 'keep' end as action, coalesce(best.model, 'm_big') as model, 'm_big' as baseline,
    case when b.scored = 0 then 'no baseline results'
      when not b.complete then 'baseline has incomplete results (' || b.errors || ' errors, ' || b.scored || '/' || b.cases || ' scored)'
      when b.pass_rate = 0 then 'baseline passes no cases; nothing to compare against'
      when best.model is not null then best.reason else 'no cheaper model passed the checks' end as reason,
    b.pass_rate as baseline_pass_rate, coalesce(b.complete and b.pass_rate < 0.8 - 1e-9, false) as baseline_below_floor
  from rated b left join best using (site_id) where b.model = 'm_big'),
volumes as (select site_id, case when site_id = 'site_3' then 5000 else 20000 end as per_day from (select distinct site_id from results)),
costs as (select d.site_id, d.action, d.model, v.per_day, b.cost_per_call as before_call, a.cost_per_call as after_call,
    b.cost_per_call * v.per_day * 30 as before_month, a.cost_per_call * v.per_day * 30 as after_month
  from decisions d join volumes v using (site_id) join rated b on b.site_id = d.site_id and b.model = 'm_big' join rated a on a.site_id = d.site_id and a.model = d.model)
"""
DOMAIN_SQL = f"with {RESULTS_SQL.strip()}, {SPINE_SQL.strip()}"


def call_sites(spark: SparkSession, sf_dir: str, head: bool, every: bool = False) -> DataFrame:
    """Call sites of one side of a comparison, or ``every`` one: a conversation is a site and its turns the prompt."""
    c = table(spark, sf_dir, "conversations")
    kept = c if every else c.filter(F.col("conv_id") % (5 if head else 7) != 0)
    turned = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"), (F.col("turn") % 5 != 4).alias("resolved"))))
    grouped = kept.groupBy("conv_id").agg(turned.alias("turns"))
    altered = F.lit(head) & (F.col("conv_id") % 6 == 0)
    model = F.when(F.col("conv_id") % 4 == 0, None).when(altered, MODELS[2]).otherwise(F.element_at(F.array(*map(F.lit, MODELS)), (F.col("conv_id") % 4 + 1).cast("int")))
    tokens = F.when(F.col("conv_id") % 3 == 0, F.when(altered, 128)).otherwise(64 + 32 * (F.col("conv_id") % 5))
    return grouped.select(
        F.concat(F.lit("app/mod_"), (F.col("conv_id") % 16).cast("string"), F.lit(".py::fn_"), F.col("conv_id").cast("string")).alias("id"),
        F.when(model.isNotNull(), F.struct(model.alias("value"), F.lit("literal").alias("source"))).alias("model"),
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"), t["resolved"].alias("resolved"))).alias("messages"),
        tokens.cast("int").alias("max_tokens"),
        F.when(F.col("conv_id") % 2 == 0, "json").otherwise("text").alias("output_format"),
        F.when(F.col("conv_id") % 3 == 0, "json_fields").when(F.col("conv_id") % 3 == 1, "exact").otherwise("judge").alias("grading"),
        F.when(F.lit(head) & (F.col("conv_id") % 9 != 0), "triage").alias("purpose"),
        F.when(F.lit(head) & (F.col("conv_id") % 10 != 1), "one label").alias("output_contract"),
        F.when(F.lit(head) & (F.col("conv_id") % 11 != 2), "easy").alias("difficulty"),
        F.when(F.lit(head) & (F.col("conv_id") % 4 == 1), "auditor").otherwise("ast").alias("found_by"),
        F.when(F.lit(head) & (F.col("conv_id") % 7 == 3), F.concat(F.lit("app/mod_"), (F.floor(F.col("conv_id") / 10) * 5 % 16).cast("string"), F.lit(".py::fn_"), (F.floor(F.col("conv_id") / 10) * 5).cast("string"))).alias("via"),
    )


def side_sql(name: str, head: bool, every: bool = False) -> str:
    h = "true" if head else "false"
    return f"""
{name} as (select 'app/mod_' || cast(conv_id % 16 as varchar) || '.py::fn_' || cast(conv_id as varchar) as id, conv_id,
    case when conv_id % 4 = 0 then null when {h} and conv_id % 6 = 0 then 'm_small' else list_extract(['m_big', 'm_mid', 'm_small', 'm_tiny'], conv_id % 4 + 1) end as model,
    tokens, partial, unresolved = 0 as prompt_resolved,
    cast(case when conv_id % 3 = 0 then case when {h} and conv_id % 6 = 0 then 128 end else 64 + 32 * (conv_id % 5) end as integer) as max_tokens,
    case when conv_id % 2 = 0 then 'json' else 'text' end as output_format,
    case conv_id % 3 when 0 then 'json_fields' when 1 then 'exact' else 'judge' end as grading,
    case when {h} and conv_id % 9 <> 0 then 'triage' end as purpose, case when {h} and conv_id % 10 <> 1 then 'one label' end as output_contract,
    case when {h} and conv_id % 11 <> 2 then 'easy' end as difficulty, case when {h} and conv_id % 4 = 1 then 'auditor' else 'ast' end as found_by,
    case when {h} and conv_id % 7 = 3 then 'app/mod_' || cast((conv_id // 10 * 5) % 16 as varchar) || '.py::fn_' || cast(conv_id // 10 * 5 as varchar) end as via
  from (select conv_id, cast(coalesce(sum(n) filter (turn % 5 <> 4), 0) as bigint) as tokens, count(*) filter (turn % 5 = 4) > 0 as partial, count(*) filter (turn % 5 = 4) as unresolved
    from (select *, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\x0b\\x0c]+')) as n from conversations){'' if every else f' where conv_id % {5 if head else 7} <> 0'} group by conv_id))"""


SIDES_SQL = side_sql("base", False).strip() + "," + side_sql("head", True)
