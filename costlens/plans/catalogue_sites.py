"""Registered queries over call sites and eval sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import callsites as C
from ..operators import evals as E
from ..operators.numbering import numbered
from ..render import audit_payload
from .bindings import SETTINGS, SIDES_SQL, call_sites, side_sql, table
from .catalogue import query

PRICES_SQL = "prices as (select * from (values ('m_big', 2.5::double, 10.0::double), ('m_mid', 0.4::double, 1.6::double), ('m_small', 0.15::double, 0.6::double), ('m_tiny', 0.1::double, 0.4::double)) v(model, price_in, price_out))"


def _est(side: str) -> str:
    return f"""e_{side} as (select id, coalesce(s.model, 'm_big') as model, s.model is null as model_assumed, tokens as prompt_tokens, partial as prompt_partial,
    cast(coalesce(max_tokens, 256) as bigint) as completion_tokens, max_tokens is null as completion_assumed, cast(20000 as bigint) as calls_per_day,
    (tokens * price_in + coalesce(max_tokens, 256) * price_out) / 1e6 as per_call, (tokens * price_in + coalesce(max_tokens, 256) * price_out) / 1e6 * 20000 * 30 as monthly
  from {side} s left join prices p on p.model = coalesce(s.model, 'm_big'))"""


DIFF_SQL = f"""with {SIDES_SQL}, {PRICES_SQL}, {_est('base')}, {_est('head')},
j as (select coalesce(b.id, h.id) as id, b.id is not null as in_b, h.id is not null as in_h, b.monthly as bm, h.monthly as hm,
    b.per_call is not null or b.id is null as kb, h.per_call is not null or h.id is null as kh,
    concat_ws('; ', case when b.model <> h.model or b.model_assumed <> h.model_assumed then 'model ' || b.model || case when b.model_assumed then '†' else '' end || ' -> ' || h.model || case when h.model_assumed then '†' else '' end end,
      case when b.prompt_tokens <> h.prompt_tokens then 'prompt ~' || b.prompt_tokens || ' -> ~' || h.prompt_tokens || ' tokens' end,
      case when b.completion_tokens <> h.completion_tokens then 'max output ' || b.completion_tokens || ' -> ' || h.completion_tokens || ' tokens' end) as reasons
  from e_base b full outer join e_head h on b.id = h.id),
d as (select id, case when not in_b then 'added' when not in_h then 'removed' when reasons <> '' then 'changed' else 'unchanged' end as status,
    case when in_b and in_h then reasons else '' end as reasons, kb and kh as known, case when in_b then coalesce(bm, 0) else 0 end as before, case when in_h then coalesce(hm, 0) else 0 end as after from j)"""


EVERY_SQL = side_sql("base", False, every=True).strip() + "," + side_sql("head", True, every=True)


def estimates(spark, d, head):
    return C.estimate(call_sites(spark, d, head), SETTINGS)


def diffs(spark, d):
    return C.diff(estimates(spark, d, False), estimates(spark, d, True))


@query(f"with {EVERY_SQL} select id, tokens, partial from base")
def prompt_estimate(spark, d):
    return call_sites(spark, d, False, every=True).select("id", C.prompt_estimate().alias("p")).select("id", "p.tokens", "p.partial")


@query(f"with {EVERY_SQL}, {PRICES_SQL}, {_est('base')} select id, model, model_assumed, prompt_tokens, prompt_partial, completion_tokens, completion_assumed, calls_per_day, round(monthly, 6) as monthly from e_base")
def estimate_site(spark, d):
    return C.estimate(call_sites(spark, d, False, every=True), SETTINGS).drop("per_call").withColumn("monthly", F.round("monthly", 6))


@query(f"{DIFF_SQL} select id, status, known, round(before, 6) as before, round(after, 6) as after, round(after - before, 6) as delta from d")
def diff_sites(spark, d):
    return diffs(spark, d).select("id", "status", "known", *(F.round(c, 6).alias(c) for c in ("before", "after", "delta")))


@query(f"{DIFF_SQL} select id, reasons from d where reasons <> ''")
def diff_reasons(spark, d):
    return diffs(spark, d).filter(F.size("reasons") > 0).select("id", F.array_join("reasons", "; ").alias("reasons"))


@query(f"{DIFF_SQL} select round(coalesce(sum(before) filter (known), 0), 4) as before, round(coalesce(sum(after) filter (known), 0), 4) as after, round(coalesce(sum(after - before) filter (known), 0), 4) as delta, count(*) filter (not known) as n_unknown from d")
def diff_totals(spark, d):
    return C.diff_totals(diffs(spark, d)).select(*(F.round(c, 4).alias(c) for c in ("before", "after", "delta")), "n_unknown")


@query(f"{DIFF_SQL} select " + ", ".join(f"count(*) filter (status = '{s}') as n_{s}" for s in C.STATUSES) + " from d")
def diff_status_counts(spark, d):
    return C.diff_totals(diffs(spark, d)).select(*(f"n_{s}" for s in C.STATUSES))


@query(f"with {EVERY_SQL} select id, tokens, partial from base")
def prompt_estimate_every(spark, d):
    return call_sites(spark, d, False, every=True).select("id", C.prompt_estimate().alias("p")).select("id", "p.tokens", "p.partial")


@query(f"with {EVERY_SQL}, {PRICES_SQL}, {_est('base')} select id, model, model_assumed, prompt_tokens, prompt_partial, completion_tokens, completion_assumed, calls_per_day, round(monthly, 6) as monthly from e_base")
def estimate_every_site(spark, d):
    return C.estimate(call_sites(spark, d, False, every=True), SETTINGS).drop("per_call").withColumn("monthly", F.round("monthly", 6))


METRICS_SQL = """unpivot_{0} as (select unnest([{{'metric': 'call_sites', 'value': count(*)}}, {{'metric': 'models_resolved', 'value': count(model)}}, {{'metric': 'prompts_resolved', 'value': count(*) filter (prompt_resolved)}},
    {{'metric': 'enriched', 'value': count(*) filter (purpose is not null and output_contract is not null and difficulty is not null and grading is not null)}},
    {{'metric': 'found_by_auditor', 'value': count(*) filter (found_by = 'auditor')}}, {{'metric': 'via_helper', 'value': count(via)}}], recursive := true) from {0})"""


@query(f"with {EVERY_SQL}, {METRICS_SQL.format('base')} select metric, value from unpivot_base where metric in ('call_sites', 'models_resolved', 'prompts_resolved')")
def scan_summary(spark, d):
    return C.metrics(call_sites(spark, d, False, every=True)).filter(F.col("metric").isin("call_sites", "models_resolved", "prompts_resolved"))


@query(f"with {EVERY_SQL}, {METRICS_SQL.format('base')} select metric, value from unpivot_base where metric in ('call_sites', 'models_resolved', 'prompts_resolved')")
def scan_summary_every(spark, d):
    return C.metrics(call_sites(spark, d, False, every=True)).filter(F.col("metric").isin("call_sites", "models_resolved", "prompts_resolved"))


@query(f"with {SIDES_SQL}, {METRICS_SQL.format('base')}, {METRICS_SQL.format('head')} select b.metric, b.value as before, h.value as after from unpivot_base b join unpivot_head h using (metric)")
def compare_metrics(spark, d):
    return C.compare_metrics(call_sites(spark, d, False), call_sites(spark, d, True))


ENRICHED = "({0}.purpose is not null and {0}.output_contract is not null and {0}.difficulty is not null and {0}.grading is not null)"


@query(f"""with {SIDES_SQL}, kids as (select via as id, string_agg(id, ', ' order by id) as children from head where via is not null group by via),
gone as (select b.id, case when children is null then 'removed' else 'split' end as change, coalesce('into ' || children, 'not in the audit') as detail from base b anti join head h using (id) left join kids using (id)),
j as (select a.id, b.id is null as fresh, a.via, a.model as am, b.model as bm, b.id is not null and a.model is distinct from b.model as moved, b.id is not null and a.prompt_resolved and not b.prompt_resolved as prompt,
    {ENRICHED.format('a')} and not {ENRICHED.format('b')} as enriched from head a left join base b using (id))
select * from gone union all select id, case when fresh then 'added' when moved and bm is not null and not prompt then 'changed' when moved or prompt then 'resolved' when enriched then 'enriched' else 'unchanged' end,
  case when fresh then coalesce('via ' || via, 'not found by the scanner') when moved or prompt then concat_ws('; ', case when moved and bm is not null then 'model ' || bm || ' -> ' || coalesce(am, 'None') when moved then 'model resolved: ' || am end, case when prompt then 'prompt resolved' end)
  when enriched then 'purpose, output_contract, difficulty, grading' else '' end from j""")
def compare_changes(spark, d):
    return C.compare(call_sites(spark, d, False), call_sites(spark, d, True))


LINT_SQL = """select id, unnest(list_filter([case when grading = 'json_fields' and output_format <> 'json' then 'grading is json_fields but output_format is ' || output_format end,
  case when via in (select id from head) then 'via ' || via || ' is still listed as its own call site' end, case when found_by = 'auditor' then 'found_by is auditor but there is no note of it' end,
  case when purpose is null or output_contract is null or difficulty is null or grading is null then 'missing ' || concat_ws(', ', case when purpose is null then 'purpose' end, case when output_contract is null then 'output_contract' end, case when difficulty is null then 'difficulty' end, case when grading is null then 'grading' end) end,
  case when model is null then 'model still unresolved' end, case when not prompt_resolved then 'prompt still unresolved' end], lambda x: x is not null)) as warning from head"""


@query(f"with {EVERY_SQL} {LINT_SQL}")
def audit_lint(spark, d):
    return C.lint(call_sites(spark, d, True, every=True), "auditor")


@query(f"with {EVERY_SQL} {LINT_SQL}")
def audit_lint_every(spark, d):
    return C.lint(call_sites(spark, d, True, every=True), "auditor")


@query("select l_orderkey, l_linenumber, 'f' || (l_suppkey % 7) || '::fn_' || (l_orderkey % 5000) || case when row_number() over (partition by l_suppkey % 7, l_orderkey % 5000 order by l_orderkey, l_linenumber, l_partkey, l_quantity) > 1 then '#' || row_number() over (partition by l_suppkey % 7, l_orderkey % 5000 order by l_orderkey, l_linenumber, l_partkey, l_quantity) else '' end as id from lineitem")
def site_numbering(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("f"), (F.col("l_suppkey") % 7).cast("string")).alias("file"), F.concat(F.lit("fn_"), (F.col("l_orderkey") % 5000).cast("string")).alias("function"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").alias("ord")
    )
    return C.number_sites(rows).select("l_orderkey", "l_linenumber", "id")


@query("with n as (select *, row_number() over (partition by l_suppkey % 7, l_orderkey % 5000 order by l_orderkey, l_linenumber, l_partkey, l_quantity) as n from lineitem) select l_orderkey, l_linenumber, 'f' || (l_suppkey % 7) || '::fn_' || (l_orderkey % 5000) || case when n > 1 then '#' || n else '' end as id from n")
def site_numbering_every(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("f"), (F.col("l_suppkey") % 7).cast("string")).alias("file"), F.concat(F.lit("fn_"), (F.col("l_orderkey") % 5000).cast("string")).alias("function"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").alias("ord")
    )
    return C.number_sites(rows).select("l_orderkey", "l_linenumber", "id")


CALLERS_SQL = """with sites as (select 'mod_' || (s_nationkey) as file, 'Cls.' || 'fn_' || (s_suppkey % 50) as function, 'fn_' || (s_suppkey % 50) as last, s_suppkey from supplier),
calls as (select distinct 'mod_' || c_nationkey || '::' || case when c_custkey % 9 = 0 then 'Cls.fn_' || (c_custkey % 50) else 'caller_' || (c_custkey % 40) end as caller, 'fn_' || (c_custkey % 60) as callee from customer)
select s_suppkey, coalesce(string_agg(distinct caller, ',' order by caller), '') as callers from sites left join calls on callee = last and caller <> file || '::' || function group by s_suppkey"""


@query(CALLERS_SQL)
def attach_callers(spark, d):
    text = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    sites = table(spark, d, "supplier").select(F.concat(F.lit("mod_"), text("s_nationkey")).alias("file"), F.concat(F.lit("Cls.fn_"), text(F.col("s_suppkey") % 50)).alias("function"), F.col("s_suppkey").alias("id"))
    who = F.when(F.col("c_custkey") % 9 == 0, F.concat(F.lit("Cls.fn_"), text(F.col("c_custkey") % 50))).otherwise(F.concat(F.lit("caller_"), text(F.col("c_custkey") % 40)))
    calls = table(spark, d, "customer").select(F.concat(F.lit("mod_"), text("c_nationkey"), F.lit("::"), who).alias("caller"), F.concat(F.lit("fn_"), text(F.col("c_custkey") % 60)).alias("callee"))
    return C.attach_callers(sites, calls).select(F.col("id").alias("s_suppkey"), F.array_join("callers", ",").alias("callers"))


# ---- eval sets: an order is a case of its customer's set


def cases(spark, d):
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    names = F.array(*map(F.lit, ["subject", "body", "channel", "plan"]))
    return o.select(
        (F.col("o_custkey") % 500).alias("site_id"),
        key.alias("line"),
        F.concat(F.lit("case-"), (key % 37).cast("string")).alias("id"),
        F.when(key % 11 == 0, "judge").when(key % 3 == 0, "json_fields").otherwise("exact").alias("grading"),
        F.when(key % 3 == 0, "json_fields").otherwise("exact").alias("site_grading"),
        F.slice(names, F.lit(1), (1 + key % 3).cast("int")).alias("wanted"),
        F.slice(names, (1 + key % 2).cast("int"), F.lit(2)).alias("given"),
        F.array(*map(F.lit, ["F", "O"])).alias("labels"),
        F.when(key % 3 == 0, F.when(key % 5 != 0, '{"a": 1}').otherwise("text")).otherwise(F.when(key % 13 == 0, "  ").otherwise(F.col("o_orderstatus"))).alias("expected"),
    )


CASES_SQL = """cases as (select o_custkey % 500 as site_id, o_orderkey as line, 'case-' || (o_orderkey % 37) as id,
    case when o_orderkey % 11 = 0 then 'judge' when o_orderkey % 3 = 0 then 'json_fields' else 'exact' end as grading, case when o_orderkey % 3 = 0 then 'json_fields' else 'exact' end as site_grading,
    list_slice(['subject', 'body', 'channel', 'plan'], 1, 1 + o_orderkey % 3) as wanted, list_slice(['subject', 'body', 'channel', 'plan'], 1 + o_orderkey % 2, 2 + o_orderkey % 2) as given,
    case when o_orderkey % 3 = 0 then case when o_orderkey % 5 <> 0 then '{"a": 1}' else 'text' end else case when o_orderkey % 13 = 0 then '  ' else o_orderstatus end end as expected from orders),
ranked as (select *, row_number() over (partition by site_id, id order by line) as n, list_sort(list_filter(wanted, lambda x: not list_contains(given, x))) as missing, list_sort(list_filter(given, lambda x: not list_contains(wanted, x))) as extra from cases)"""


@query(f"with {CASES_SQL} select site_id, id, line from ranked where n > 1")
def eval_duplicate_ids(spark, d):
    return E.duplicate_ids(cases(spark, d)).select("site_id", "id", "line")


@query(f"with {CASES_SQL} select line, array_to_string(missing, ',') as missing, array_to_string(extra, ',') as extra from ranked")
def eval_input_diff(spark, d):
    return E.input_diff(cases(spark, d)).select("line", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"))


EXPECTED_SQL = """case when grading = 'exact' and trim(expected) = '' then 'exact grading needs expected to be a non-empty string'
    when grading = 'exact' and expected not in ('F', 'O') then 'expected ' || expected || ' is not one of F, O'
    when grading = 'json_fields' and expected not like '{%' then 'json_fields grading needs expected to be a non-empty object'
    when grading = 'judge' and trim(expected) = '' then 'judge grading needs expected to be a reference answer or rubric string' end"""


@query(f"""with {CASES_SQL} select site_id, line, unnest(list_filter([case when n > 1 then 'duplicate id' end, case when grading <> site_grading then 'grading ' || grading || ' does not match call site grading ' || site_grading end,
  case when len(missing) > 0 then 'inputs missing ' || array_to_string(missing, ', ') end, case when len(extra) > 0 then 'inputs not in the prompt: ' || array_to_string(extra, ', ') end, {EXPECTED_SQL}], lambda x: x is not null)) as problem from ranked""")
def eval_problems(spark, d):
    return E.problems(cases(spark, d))


@query(f"with {CASES_SQL} select site_id, 'only ' || count(*) || ' cases (aim for 20 or more)' as warning from cases group by site_id having count(*) < 20")
def eval_few_cases(spark, d):
    return E.few_cases(cases(spark, d))


@query("""with f as (select distinct 'mod.' || (o_custkey % 300) as slug from orders), s as (select distinct 'mod.' || (c_custkey % 250 + 100) as slug from customer)
select coalesce(f.slug, s.slug) as slug, case when s.slug is null then 'error' when f.slug is null then 'warning' else 'ok' end as state from f full outer join s on f.slug = s.slug""")
def eval_dir_coverage(spark, d):
    files = table(spark, d, "orders").select(F.concat(F.lit("mod."), (F.col("o_custkey") % 300).cast("string")).alias("slug"))
    sites = table(spark, d, "customer").select(F.concat(F.lit("mod."), (F.col("c_custkey") % 250 + 100).cast("string")).alias("slug"))
    return E.coverage(files, sites)


@query("""with f as (select distinct 'mod.' || (o_custkey % 300) as slug from orders) select c_custkey as site_id from customer anti join f on f.slug = 'mod.' || (c_custkey % 450)""")
def missing_evals(spark, d):
    """Customers as call sites, of which some share a slug; orders as cases."""
    slug = lambda c, n: F.concat(F.lit("mod."), (F.col(c) % n).cast("string")).alias("slug")
    return E.missing_evals(table(spark, d, "customer").select(F.col("c_custkey").alias("site_id"), slug("c_custkey", 450)), table(spark, d, "orders").select(slug("o_custkey", 300)))


@query(f"with {CASES_SQL} select line, array_to_string(list_sort(list_filter(['plan', 'subject', 'tone'], lambda x: list_contains(wanted, x))), ',') as kept from cases")
def shared_inputs_kept(spark, d):
    """Of three shared inputs, those that the case's prompt names."""
    shared = F.create_map(*(F.lit(x) for k in ("subject", "tone", "plan") for x in (k, k[0])))
    return cases(spark, d).select("line", F.array_join(F.array_sort(F.map_keys(E.shared_inputs(shared, F.col("wanted")))), ",").alias("kept"))


GENERATED_SQL = "select user_id % 40 as site_id, event_id as ord, event_type, cast(json_extract_string(props, '$.k') as integer) as k from events"


@query(f"select site_id, ord, event_type, k from ({GENERATED_SQL}) qualify row_number() over (partition by site_id, event_type, k order by ord) = 1")
def dedupe_inputs(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 40).alias("site_id"), F.col("event_id").alias("ord"), "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    keyed = e.withColumn("inputs", F.create_map(F.lit("type"), "event_type", F.lit("k"), F.col("k").cast("string"))).withColumn("key", E.canonical())
    return E.first_of_equal(keyed, "key").select("site_id", "ord", "event_type", "k")


@query(f"with g as (select * from ({GENERATED_SQL})) select ord, 'fn_' || site_id || '-' || lpad(cast(row_number() over (partition by site_id order by ord) as varchar), cast(greatest(2, len(cast(row_number() over (partition by site_id order by ord) as varchar))) as integer), '0') as id from g")
def renumber_cases(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 40).alias("site_id"), F.col("event_id").alias("ord"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    return E.renumber(e.withColumn("function", F.concat(F.lit("fn_"), F.col("site_id").cast("string")))).select("ord", "id")


@query("with g as (select user_id % 40 as site_id, event_id as ord from events), n as (select *, cast(row_number() over (partition by site_id order by ord) as varchar) as n from g) select ord, 'fn_' || site_id || '-' || lpad(n, cast(greatest(2, len(n)) as integer), '0') as id from n")
def renumber_every_case(spark, d):
    """Every event numbered."""
    e = table(spark, d, "events").select((F.col("user_id") % 40).alias("site_id"), F.col("event_id").alias("ord"))
    return E.renumber(e.withColumn("function", F.concat(F.lit("fn_"), F.col("site_id").cast("string")))).select("ord", "id")


@query("""select d.doc_id, source as site_id, lang as model, quality = 1 as passed from documents d join labels l using (doc_id)""")
def quality_grid(spark, d):
    """Labels as passes of a (site, model) grid."""
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("site_id"), F.col("lang").alias("model"))
    return docs.join(table(spark, d, "labels"), "doc_id").select("doc_id", "site_id", "model", (F.col("quality") == 1).alias("passed"))


# ---- several repositories, generation, grading

REPOS_SQL = "r as (select l_orderkey, l_linenumber, 'repo_' || (l_partkey % 3) as repo, 'f' || (l_suppkey % 7) as file, 'fn_' || (l_orderkey % 5000) as function, l_partkey, l_quantity from lineitem)"


@query(f"with {REPOS_SQL}, n as (select *, row_number() over (partition by repo, file, function order by l_orderkey, l_linenumber, l_partkey, l_quantity) as n from r) select l_orderkey, l_linenumber, repo, file || '::' || function || case when n > 1 then '#' || n else '' end as id from n")
def site_numbering_repos(spark, d):
    """Every line is a call of one of three repositories."""
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text("repo_", F.col("l_partkey") % 3).alias("repo"), text("f", F.col("l_suppkey") % 7).alias("file"), text("fn_", F.col("l_orderkey") % 5000).alias("function"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").alias("ord"))
    return C.number_sites(rows).select("l_orderkey", "l_linenumber", "repo", "id")


SKIPS_SQL = """select id as site_id, case when not prompt_resolved then 'prompt is unresolved' else 'prompt has expressions: x + ' || (conv_id % 3) end as reason from base where not prompt_resolved or conv_id % 5 = 1"""


@query(f"with {EVERY_SQL} {SKIPS_SQL}")
def generation_skips(spark, d):
    """Conversations as prompts; every fifth has an expression to fill in."""
    number = F.regexp_extract("id", "fn_([0-9]+)$", 1).cast("bigint")
    sites = call_sites(spark, d, False, every=True)
    plain = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.translate(F.coalesce(m["content"], F.lit("")), "{}", "()").alias("content"), m["resolved"].alias("resolved")))
    odd = F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("Add {x + "), (number % 3).cast("string"), F.lit("} and {name}")).alias("content"), F.lit(True).alias("resolved")))
    return E.generation_skips(sites.withColumn("messages", F.when(number % 5 == 1, F.concat(plain, odd)).otherwise(plain)))


@query("""select o_orderkey, case when o_orderkey % 3 = 0 then null when o_orderkey % 3 = 1 then 'expected has fields that are not graded: extra' else 'expected lacks graded fields status; expected has fields that are not graded: extra' end as problem from orders where o_orderkey % 4 <> 3
  union all select o_orderkey, null from orders where o_orderkey % 4 = 3""")
def eval_field_rules(spark, d):
    """The contract's graded fields against the keys of ``expected``; null where nothing is wrong or the case is not graded by fields."""
    key = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        "o_orderkey",
        F.when(key % 4 == 3, "exact").otherwise("json_fields").alias("grading"),
        F.array(F.lit("status"), F.lit("total")).alias("fields"),
        F.when(key % 3 == 0, '{"total": 1, "status": "x"}').when(key % 3 == 1, '{"total": 1, "status": null, "extra": 2}').otherwise('{"extra": {}, "total": 0}').alias("expected"),
    )
    return rows.select("o_orderkey", E.field_problem().alias("problem"))


@query("""with e as (select event_id, event_type, user_id % 16 as site, cast(json_extract_string(props, '$.k') as integer) as k, event_id % 5 as g from events)
select 'site_' || site as site_id, 'c' || event_id as case_id, case when g = 4 then null when g in (0, 1) then cast(k % 3 <> 0 as double) when g = 2 then case when k % 3 <> 0 then 1.0 else 0.5 end else k % 5 / 4.0 end as score,
  case when g = 4 then null when g = 3 then k % 5 >= 3 else k % 3 <> 0 end as passed, case when g = 3 then 'j_a' end as judge_model, case when g = 4 then 'scoring failed: unknown grading none' end as error from e""")
def run_graded(spark, d):
    """Every event is a case, called with a client that echoes its prompt and graded as its kind says: exactly, by fields, by a judge, or not at all."""
    from ..operators import model_calls as MC

    e = table(spark, d, "events").select("event_id", "event_type", (F.col("user_id") % 16).alias("site"), F.get_json_object("props", "$.k").cast("int").alias("k"), (F.col("event_id") % 5).alias("g"))
    right, k, g = F.col("k") % 3 != 0, F.col("k").cast("string"), F.col("g")
    said = F.when(g <= 1, F.concat(F.lit('"'), F.upper("event_type"), F.lit('".'))).when(g == 2, F.concat(F.lit('Sure: {"type": "'), F.col("event_type"), F.lit('", "at": {"b": [1], "a": '), k, F.lit(".0}}"))).otherwise(F.concat(F.lit("answer "), k))
    want = F.when(g <= 1, F.when(right, F.col("event_type")).otherwise("something else")).when(g == 2, F.concat(F.lit('{"at": {"a": '), k, F.lit('.0, "b": [1]}, "type": "'), F.when(right, F.col("event_type")).otherwise("no"), F.lit('"}'))).otherwise(F.concat(F.lit("rubric "), (F.col("k") % 5 + 1).cast("string")))
    kind = F.when(g <= 1, "exact").when(g == 2, "json_fields").when(g == 3, "judge").otherwise("none")
    todo = e.select(F.concat(F.lit("site_"), F.col("site").cast("string")).alias("site_id"), F.lit("m_big").alias("model"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("case_id"), F.array(F.struct(F.lit("user").alias("role"), said.alias("content"))).alias("messages"), want.alias("expected"), kind.alias("grading"))
    echo = lambda: MC.FixedClient(lambda model, messages: messages[0]["content"])
    judge = lambda: MC.FixedClient(lambda model, messages: '{"score": %s}' % messages[1]["content"].split("rubric ")[1][0])
    return MC.run_cases(todo, echo, "j_a", judge).select("site_id", "case_id", "score", "passed", "judge_model", "error")


@query("select l_orderkey, l_linenumber, l_returnflag as flag, row_number() over (partition by l_returnflag order by l_orderkey, l_linenumber) as n from lineitem")
def number_heavy_groups(spark, d):
    """Every line's number among those of its return flag: three groups hold the whole table, and each is numbered by several tasks."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("flag"))
    return numbered(rows, ["flag"], ["l_orderkey", "l_linenumber"])


REPORT_SQL = """with sites as (select 'm' || c_custkey || '.py::f' as site_id, 'm' || c_custkey || '__f' as slug, c_custkey % 5 = 0 as unknown, c_custkey % 5 = 1 as odd,
    case c_custkey % 4 when 1 then 'exact' when 2 then 'json_fields' when 3 then 'judge' end as site_grading, c_custkey % 3 = 0 as labelled, c_custkey % 3 = 1 as fielded from customer),
cases as (select case when o_orderkey % 97 = 0 then 'x' else 'm' end || o_custkey || '__f' as slug, o_orderkey as line, o_orderkey % 7 as id, case o_orderkey % 6 when 0 then 'judge' when 1 then 'json_fields' else 'exact' end as grading,
    o_orderkey % 4 as inputs, o_orderkey % 5 as kind, ['F', '7', '{"a":1}', ' ', '{"a":1,"c":2}'][1 + o_orderkey % 5] as expected from orders),
met as (select c.*, s.* exclude slug, row_number() over (partition by site_id, id order by line) as n from cases c join sites s using (slug)),
rows_ as (select slug, site_id, line, 'error' as severity, unnest(list_filter([case when n > 1 then 'duplicate id' end,
    case when grading <> site_grading then 'grading ' || grading || ' does not match call site grading ' || site_grading end,
    case when not odd and not unknown and inputs = 0 then 'inputs missing body' end,
    case when not odd and unknown then 'inputs not in the prompt: ' || ['subject', 'body, subject', 'body, subject, tone', 'body, subject'][1 + inputs] when not odd and inputs = 2 then 'inputs not in the prompt: tone' end,
    case when grading = 'exact' and kind <> 0 then 'exact grading needs expected to be a non-empty string' when grading = 'json_fields' and kind not in (2, 4) then 'json_fields grading needs expected to be a non-empty object'
      when grading = 'judge' and kind <> 0 then 'judge grading needs expected to be a reference answer or rubric string' end,
    case when grading = 'json_fields' and fielded then case when kind = 2 then 'expected lacks graded fields b' when kind = 4 then 'expected lacks graded fields b; expected has fields that are not graded: c' else 'expected lacks graded fields a, b' end end], lambda x: x is not null)) as problem from met),
held as (select distinct slug from cases),
sets as (
  select slug, site_id, 'error' as severity, 'prompt is unresolved' as problem from sites semi join held using (slug) where unknown
  union all select slug, site_id, 'error', 'prompt has expressions: x.y' from sites semi join held using (slug) where odd
  union all select slug, null, 'error', 'no call site' from held anti join sites using (slug)
  union all select slug, site_id, 'warning', 'no eval file' from sites anti join held using (slug)
  union all select slug, site_id, 'warning', 'output_contract names no graded fields' from sites semi join held using (slug) where site_grading = 'json_fields' and not fielded
  union all select slug, any_value(site_id), 'warning', 'only ' || count(*) || ' cases (aim for 20 or more)' from cases left join sites using (slug) group by slug having count(*) < 20)
"""


def eval_sets(spark, d):
    """(cases, call sites): each customer is a call site, its orders are the cases of its set."""
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    pick = lambda n, *xs: F.get(F.array(*map(F.lit, xs)), (n % len(xs)).cast("int"))
    message = lambda text: F.array(F.struct(F.lit("user").alias("role"), F.lit(text).alias("content"), F.lit(True).alias("resolved")))
    sites = table(spark, d, "customer").select(
        F.concat(F.lit("m"), c.cast("string"), F.lit(".py::f")).alias("id"), F.when(c % 5 == 0, None).when(c % 5 == 1, message("Tell {subject} {x.y}")).otherwise(message("Tell {subject} of {body}")).alias("messages"),
        pick(c, None, "exact", "json_fields", "judge").alias("grading"), pick(c, "One label from the set {F, O}", "Graded fields: a, b.", None).alias("output_contract"),
    )
    raw = F.concat(F.lit('{"inputs": '), pick(o, '{"subject": "s"}', '{"subject": "s", "body": "b"}', '{"subject": "s", "body": "b", "tone": "t"}', '{"body": "b", "subject": "s"}'), F.lit(', "expected": '), pick(o, '"F"', "7", '{"a": 1}', '" "', '{"a": 1, "c": 2}'), F.lit("}"))
    cases = table(spark, d, "orders").select(
        F.concat(F.when(o % 97 == 0, "x").otherwise("m"), F.col("o_custkey").cast("string"), F.lit("__f")).alias("slug"), o.alias("line"), (o % 7).cast("string").alias("id"), pick(o, "judge", "json_fields", "exact", "exact", "exact", "exact").alias("grading"), raw.alias("value")
    )
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("value"), "$.expected", "variant"))
    return cases.withColumns({"inputs": F.from_json(F.get_json_object("value", "$.inputs"), "map<string,string>"), "expected": F.get_json_object("value", "$.expected"), "expected_kind": kind}).drop("value"), sites


@query(REPORT_SQL + "select slug, site_id, line, severity, problem from rows_ union all select slug, site_id, null, severity, problem from sets")
def eval_set_report(spark, d):
    """All problems of all eval sets as one relation, typed: a number is no text."""
    cases, sites = eval_sets(spark, d)
    return E.set_report(cases, sites, spark.createDataFrame([], "slug string, line bigint, problem string"))


@query(REPORT_SQL + "select (select count(*) from held) as sets, (select count(*) from cases) as cases, (select count(*) from rows_) + (select count(*) from sets where severity = 'error') as errors, (select count(*) from sets where severity = 'warning') as warnings")
def eval_set_totals(spark, d):
    cases, sites = eval_sets(spark, d)
    return E.set_totals(E.set_report(cases, sites, spark.createDataFrame([], "slug string, line bigint, problem string")), cases)


# ---- an audit beside the scans before and after it

AFTER_SQL = "after as (select * replace (coalesce(model, 'm_big') as model, 'ast' as found_by) from head where conv_id % 3 <> 1)"


def three_scans(spark, d):
    """The scan before, the audit, and a later scan that knows every model but lacks a third of the call sites."""
    head = call_sites(spark, d, True)
    number = F.regexp_extract("id", "fn_([0-9]+)$", 1).cast("bigint")
    model = F.struct(F.coalesce("model.value", F.lit("m_big")).alias("value"), F.coalesce("model.source", F.lit("constant")).alias("source"))
    return {"ast": call_sites(spark, d, False), "audit": head, "ast_after": head.filter(number % 3 != 1).withColumns({"model": model, "found_by": F.lit("ast")})}


@query(f"""with {SIDES_SQL}, {AFTER_SQL}, {METRICS_SQL.format('base')}, {METRICS_SQL.format('head')}, {METRICS_SQL.format('after')}
select b.metric, b.value as ast, h.value as audit, a.value as ast_after from unpivot_base b join unpivot_head h using (metric) join unpivot_after a using (metric)""")
def audit_metrics(spark, d):
    return C.metrics_over(three_scans(spark, d))


@query(f"""with {SIDES_SQL}, {AFTER_SQL} select id, b.id is not null as in_ast, h.id is not null as in_audit, a.id is not null as in_after, b.model as ast_model, h.model as audit_model, a.model as after_model,
  h.prompt_resolved as audit_prompt, h.found_by as audit_found_by,
  case when b.id is not null and h.id is not null and a.id is not null then 'kept' when b.id is not null and h.id is null and a.id is not null then 'back' when b.id is not null then 'gone' when a.id is not null then 'new' else 'passing' end as fate
from base b full outer join head h using (id) full outer join after a using (id)""")
def audit_presence(spark, d):
    """Every call site of any of three scans, with what each says of it."""
    scans = three_scans(spark, d)
    rows = C.fates(C.presence(scans), list(scans))
    there = [F.col(c).isNotNull().alias(n) for c, n in (("ast", "in_ast"), ("audit", "in_audit"), ("ast_after", "in_after"))]
    return rows.select("id", *there, F.col("ast.model").alias("ast_model"), F.col("audit.model").alias("audit_model"), F.col("ast_after.model").alias("after_model"), F.col("audit.prompt_resolved").alias("audit_prompt"), F.col("audit.found_by").alias("audit_found_by"), "fate")


@query(f"""with {SIDES_SQL}, {AFTER_SQL}, ids as (select id from base union select id from head union select id from after)
select 'metric' as part, 6 as n union all select 'site', count(*) from ids union all select 'change', count(*) from base full outer join head using (id)""")
def audit_documents(spark, d):
    """How many documents of each kind an audit of three scans makes."""
    s = three_scans(spark, d)
    return audit_payload(s["audit"], s["ast"], s["ast_after"]).groupBy("part").agg(F.count("doc").alias("n"))


@query(f"select site_id, ord, event_type, k from ({GENERATED_SQL}) qualify row_number() over (partition by site_id, event_type, k order by ord) = 1")
def dedupe_nested_inputs(spark, d):
    """Cases whose inputs hold an object of objects, written in either order of keys: the order makes no difference."""
    e = table(spark, d, "events").select((F.col("user_id") % 40).alias("site_id"), F.col("event_id").alias("ord"), "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    one = F.format_string('{"at": {"k": %d, "of": ["%s", {"x": 1, "y": null}]}, "id": 7}', "k", "event_type")
    other = F.format_string(' {"id":7,"at":{"of":["%s",{"y":null,"x":1}],"k":%d}}', "event_type", "k")
    keyed = e.withColumn("inputs", F.create_map(F.lit("body"), F.when(F.col("ord") % 2 == 0, one).otherwise(other))).withColumn("key", E.canonical())
    return E.first_of_equal(keyed, "key").select("site_id", "ord", "event_type", "k")
