"""Registered queries over texts and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonvalues as J
from ..functions import text as T
from ..operators import evals as E
from .bindings import table
from .catalogue import query

#: A document's text as a model might give it back: plain, fenced, quoted, upper case, with marks at the end.
WRAPPED_SQL = r"""w as (select doc_id, text, case doc_id % 5 when 0 then text when 1 then '```json' || chr(10) || text || chr(10) || '```' when 2 then '"' || text || '"' when 3 then translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') else text || ' !?' end as output from documents)"""


def wrapped(spark, d):
    t, k = F.col("text"), F.col("doc_id") % 5
    out = F.when(k == 0, t).when(k == 1, F.concat(F.lit("```json\n"), t, F.lit("\n```"))).when(k == 2, F.concat(F.lit('"'), t, F.lit('"'))).when(k == 3, F.translate(t, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(F.concat(t, F.lit(" !?")))
    return table(spark, d, "documents").select("doc_id", "text", out.alias("output"))


def _fence(c: str) -> str:
    t = f"trim({c}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    inner = rf"regexp_extract({t}, '(?s)^```(?:[\w-]+\n)?\s*(.*?)\s*```$', 1)"
    return rf"case when regexp_matches({t}, '(?s)^```(?:[\w-]+\n)?\s*(.*?)\s*```$') then trim({inner}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) else {t} end"


def _norm(c: str) -> str:
    return rf"""trim(lower(trim(regexp_replace({_fence(c)}, '\s+', ' ', 'g'))), ' .,;:!?"''`*()[]' || chr(9) || chr(10) || chr(13))"""


@query(f"with {WRAPPED_SQL} select doc_id, md5({_fence('output')}) as stripped from w")
def strip_fences(spark, d):
    return wrapped(spark, d).select("doc_id", F.md5(T.strip_fences("output").cast("binary")).alias("stripped"))


@query(f"with {WRAPPED_SQL} select doc_id, md5({_norm('output')}) as normal from w")
def normalize_text(spark, d):
    return wrapped(spark, d).select("doc_id", F.md5(T.normalize_text("output").cast("binary")).alias("normal"))


@query(f"with {WRAPPED_SQL} select doc_id, {_norm('output')} = {_norm('want')} as passed, cast({_norm('output')} = {_norm('want')} as double) as value from (select doc_id, output, case when doc_id % 4 = 3 then 'another answer' else text end as want from w)")
def score_exact(spark, d):
    rows = wrapped(spark, d).withColumn("want", F.when(F.col("doc_id") % 4 == 3, "another answer").otherwise(F.col("text")))
    return rows.select("doc_id", E.score_exact("output", "want").alias("s")).select("doc_id", "s.passed", "s.value")


@query(r"select doc_id, cast(len(regexp_extract_all(text, '[^ \t\n\r\x0b\x0c]+')) as bigint) as tokens from documents")
def estimate_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", T.word_count("text").alias("tokens"))


@query("select doc_id, case when length(text) > 80 then substr(text, 1, 77) || '...' else text end as clipped from documents")
def clip(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clip("text").alias("clipped"))


PATHS_SQL = r"p as (select page_id, url, replace(regexp_replace(regexp_replace(url, '^[^:]*://', ''), '[?#].*$', ''), '.html', '.py') || case when page_id % 3 = 0 then '' else '::Cls.fn_' || (page_id % 17) end as id from pages)"


def paths(spark, d):
    bare = F.replace(F.regexp_replace(F.regexp_replace("url", "^[^:]*://", ""), "[?#].*$", ""), F.lit(".html"), F.lit(".py"))
    k = F.col("page_id")
    return table(spark, d, "pages").select("page_id", "url", F.concat(bare, F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("::Cls.fn_"), (k % 17).cast("string")))).alias("id"))


_MODULE = r"replace(trim(regexp_replace(split_part(id, '::', 1), '\.py$', ''), '/'), '/', '.')"


@query(f"with {PATHS_SQL} select page_id, {_MODULE} || case when contains(id, '::') then '__' || split_part(id, '::', 2) else '' end as slug from p")
def slug_for(spark, d):
    return paths(spark, d).select("page_id", T.slug_for("id").alias("slug"))


@query("select page_id, coalesce(nullif(trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '-'), ''), 'model') as name from pages")
def model_filename(spark, d):
    return table(spark, d, "pages").select("page_id", T.model_filename("url").alias("name"))


@query(f"with {PATHS_SQL} select page_id, split_part(id, '::', 1) as file, case when contains(id, '::') then split_part(id, '::', 2) else id end as name, list_extract(string_split(id, ':'), -1) as short from p")
def site_labels(spark, d):
    return paths(spark, d).select("page_id", T.site_file("id").alias("file"), T.site_name("id").alias("name"), T.short_model("id").alias("short"))


@query(f"with {PATHS_SQL} select page_id, (regexp_matches(id, '^.*\\.py$') or regexp_matches(id, '^www\\..*/en/.*$')) and not regexp_matches(id, '^.*/de/.*$') as kept from p")
def glob_filter(spark, d):
    return paths(spark, d).select("page_id", T.matches_globs("id", ["*.py", "www.*/en/*"], ["*/de/*"]).alias("kept"))


#: Prompts with placeholders, and a contract, made from events.
PROMPTS_SQL = """pr as (select event_id, event_type, cast(json_extract_string(props, '$.k') as integer) as k, 'Classify {subject} of {' || event_type || '} and { subject } for {a + ' || event_id % 3 || '}; reply {"x": 1}' as template,
  'Return JSON. Graded fields: category, `' || event_type || '`, two words, urgency. ' || chr(10) || 'One from the set {low, "' || event_type || '", , high}' as contract from events)"""


def prompts(spark, d):
    e = table(spark, d, "events")
    kind = F.col("event_type")
    return e.select(
        "event_id",
        "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.concat(F.lit("Classify {subject} of {"), kind, F.lit("} and { subject } for {a + "), (F.col("event_id") % 3).cast("string"), F.lit('}; reply {"x": 1}')).alias("template"),
        F.concat(F.lit("Return JSON. Graded fields: category, `"), kind, F.lit("`, two words, urgency. \nOne from the set {low, \""), kind, F.lit('", , high}')).alias("contract"),
    )


@query(f"with {PROMPTS_SQL} select event_id, 'subject,' || event_type as names from pr")
def placeholders(spark, d):
    return prompts(spark, d).select("event_id", F.array_join(T.placeholders("template"), ",").alias("names"))


@query(f"with {PROMPTS_SQL} select event_id, replace(replace(template, '{{subject}}', 'S' || k), '{{' || event_type || '}}', 'T') as text from pr")
def render_messages(spark, d):
    rows = prompts(spark, d).withColumns({"keys": T.placeholders("template"), "vals": F.create_map(F.lit("subject"), F.concat(F.lit("S"), F.col("k").cast("string")), "event_type", F.lit("T"))})
    return rows.select("event_id", T.render("template", "keys", "vals").alias("text"))


@query(f"with {PROMPTS_SQL} select event_id, 'category,' || event_type as fields from pr")
def graded_fields(spark, d):
    return prompts(spark, d).select("event_id", F.array_join(T.graded_fields("contract"), ",").alias("fields"))


@query(f"with {PROMPTS_SQL} select event_id, 'low,' || event_type || ',high' as labels from pr")
def allowed_values(spark, d):
    return prompts(spark, d).select("event_id", F.array_join(T.allowed_values("contract"), ",").alias("labels"))


@query(f"with {PROMPTS_SQL} select event_id, case when k % 2 = 0 then 'own' else 'shared' end as a, 'S' as b, cast(k as varchar) as c from pr")
def inputs_merge(spark, d):
    text = F.col("k").cast("string")
    shared = F.create_map(F.lit("a"), F.lit("shared"), F.lit("b"), F.lit("S"))
    own = F.when(F.col("k") % 2 == 0, F.create_map(F.lit("a"), F.lit("own"), F.lit("c"), text)).otherwise(F.create_map(F.lit("c"), text))
    m = prompts(spark, d).select("event_id", J.merge_inputs(shared, own).alias("m"))
    return m.select("event_id", *(F.col("m")[c].alias(c) for c in "abc"))


# ---- JSON outputs made from events

OUTPUTS_SQL = """o as (select event_id, event_type, k, event_id % 3 = 0 as prose, event_id % 7 = 0 as broken, event_id % 4 = 0 as differs from (select event_id, event_type, cast(json_extract_string(props, '$.k') as integer) as k from events))"""


def outputs(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    body = F.concat(F.lit('{"type": " '), F.initcap("event_type"), F.lit(' ", "k": '), F.col("k").cast("string"), F.lit(".0, \"flag\": true, \"none\": null}"))
    i = F.col("event_id")
    out = F.when(i % 7 == 0, F.concat(F.lit("{broken "), F.col("event_type"))).when(i % 3 == 0, F.concat(F.lit("Here it is: "), body, F.lit(" Done."))).when(i % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return e.withColumn("output", out)


@query(f"with {OUTPUTS_SQL} select event_id, not broken as parsed, case when not broken then k end as k from o")
def parse_json_object(spark, d):
    v = outputs(spark, d).withColumn("v", J.parse_json_object("output"))
    return v.select("event_id", F.col("v").isNotNull().alias("parsed"), F.try_variant_get("v", "$.k", "int").alias("k"))


@query(f"with {OUTPUTS_SQL} select event_id, case when broken then '' else event_type end as type, case when broken then '' else cast(k as varchar) end as k, case when broken then '' else 'true' end as flag, '' as none from o")
def norm_value(spark, d):
    v = outputs(spark, d).withColumn("v", J.parse_json_object("output"))
    return v.select("event_id", *(J.norm_value("v", f"$.{c}").alias(c) for c in ("type", "k", "flag", "none")))


@query(f"""with {OUTPUTS_SQL} select event_id, case when broken then 0.0::double when differs then 0.5::double else 0.75::double end as value, false as passed,
  case when broken then 'output is not a JSON object' when differs then 'k: expected ' || (k + 1) || ', got ' || k || '; absent: missing' else 'absent: missing' end as detail from o""")
def score_json_fields(spark, d):
    v = outputs(spark, d).withColumn("v", J.parse_json_object("output"))
    k = F.col("k")
    want = {"type": F.col("event_type"), "k": F.when(F.col("event_id") % 4 == 0, k + 1).otherwise(k).cast("string"), "flag": F.lit("TRUE"), "absent": F.lit("x")}
    return v.select("event_id", J.field_scores("v", want, list(want)).alias("s")).select("event_id", "s.value", "s.passed", "s.detail")


REPLIES_SQL = "r as (select event_id, event_id % 8 as kind, cast(json_extract_string(props, '$.k') as integer) % 7 as n from events)"
_JUDGED = "case kind when 0 then case when n between 1 and 5 then n end when 1 then case when n between 1 and 5 then n end when 2 then null when 3 then case when n between 1 and 5 then n end when 4 then case when n between 1 and 5 then n end when 5 then case when n between 1 and 5 then n end when 6 then null else null end"


def replies(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 8).alias("kind"), (F.get_json_object("props", "$.k").cast("int") % 7).alias("n"))
    n = F.col("n").cast("string")
    kinds = ['{"score": %s, "reason": "ok"}', '{"score": "%s.0"}', '{"score": true, "n": %s}', "**Score: %s** because", "I give it %s/5 overall", " %s. ", "{\"score\": %s.5}", "no number %s here"]
    text = F.lit(None).cast("string")
    for i, k in enumerate(kinds):
        text = F.when(F.col("kind") == i, F.replace(F.lit(k), F.lit("%s"), n)).otherwise(text)
    return e.withColumn("reply", text)


@query(f"with {REPLIES_SQL} select event_id, cast({_JUDGED} as integer) as score from r")
def parse_judge_score(spark, d):
    return replies(spark, d).select("event_id", J.parse_judge_score("reply").alias("score"))


@query(f"with {REPLIES_SQL} select event_id, coalesce(({_JUDGED} - 1) / 4, 0) as value, coalesce({_JUDGED} >= 4, false) as passed from r")
def score_judge_scale(spark, d):
    return replies(spark, d).select("event_id", J.judge_value(J.parse_judge_score("reply")).alias("s")).select("event_id", "s.value", "s.passed")


@query("select l_orderkey, l_linenumber, case when x < 0 then '-' else '' end || '$' || format('{:,.2f}', abs(x)) as shown, case when x >= 0.005 then '+' when x <= -0.005 then '-' else '' end || '$' || format('{:,.2f}', abs(x)) as signed_ from (select l_orderkey, l_linenumber, floor(l_extendedprice * 4) / 4 - 30000 as x from lineitem)")
def money_labels(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.floor(F.col("l_extendedprice") * 4) / 4 - 30000).alias("x"))
    return x.select("l_orderkey", "l_linenumber", T.money("x").alias("shown"), T.signed_money("x").alias("signed_"))


@query(f"""with {PROMPTS_SQL} select event_id, case when k % 2 = 0 then 'subject=S' else '' end as held from pr""")
def shared_inputs(spark, d):
    """Of shared inputs, those that the prompt names."""
    rows = prompts(spark, d).withColumn("names", T.placeholders("template"))
    shared = F.create_map(F.when(F.col("k") % 2 == 0, "subject").otherwise("topic"), F.lit("S"), F.lit("unused"), F.lit("U"))
    return rows.select("event_id", F.array_join(F.transform(F.map_entries(E.shared_inputs(shared, F.col("names"))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("held"))


@query(f"with {PROMPTS_SQL} select event_id, 'subject,' || event_type || ',a + ' || (event_id % 3) as fields, 'a + ' || (event_id % 3) as expressions from pr")
def template_fields(spark, d):
    """Everything that a template fills in, and what of it is no plain name; JSON in it is neither."""
    return prompts(spark, d).select("event_id", F.array_join(T.template_fields("template"), ",").alias("fields"), F.array_join(T.expression_fields("template"), ",").alias("expressions"))


@query(f"""with {OUTPUTS_SQL} select event_id, not broken and not differs as passed, case when broken then 0.0::double when differs then cast(2 as double) / 3 else 1.0::double end as value from o""")
def score_json_objects(spark, d):
    """Expected objects as JSON, graded on three of their keys; most rows pass."""
    k = F.col("k")
    want = F.concat(F.lit('{"flag": true, "type": "'), F.col("event_type"), F.lit('", "k": '), F.when(F.col("event_id") % 4 == 0, k + 1).otherwise(k).cast("string"), F.lit(', "more": [1]}'))
    rows = outputs(spark, d).withColumns({"want": want, "fields": F.array(F.lit("type"), F.lit("k"), F.lit("flag"))})
    return rows.select("event_id", J.object_scores("output", "want", "fields").alias("s")).select("event_id", "s.passed", "s.value")
