"""Registered queries that scan source, call models and follow the log."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import scan as S
from ..operators.asof import last_before
from ..session import shared_dir
from ..streaming import log
from .bindings import results_of, table
from .catalogue import domain, query

#: A source file for each supplier: its model is a literal, a constant, an environment default or a dictionary's entry.
SOURCE = '''import os
from openai import OpenAI

MODEL = "m_{k}"
ROUTES = {{"fast": "m_fast_{k}", "slow": MODEL}}
client = OpenAI()


def ask_{id}(text, limit=64):
    return client.chat.completions.create(model={model}, max_tokens={tokens}, messages=[{{"role": "user", "content": f"Say {{text}}"}}])


def main():
    ask_{id}("{word}")
'''
MODELS = ['"literal_{k}"', "MODEL", 'os.getenv("LLM", "m_env")', 'ROUTES["fast"]', 'ROUTES["slow"]', "pick(text)"]


def sources(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 6).alias("kind"), (F.col("s_nationkey")).alias("k"), F.col("s_name").alias("word"))
    model = F.lit(MODELS[-1])
    for i, m in enumerate(MODELS[:-1]):
        model = F.when(F.col("kind") == i, F.replace(F.lit(m), F.lit("{k}"), F.col("k").cast("string"))).otherwise(model)
    text = F.lit(SOURCE.replace("{{", "\x01").replace("}}", "\x02"))
    for name, value in {"{model}": model, "{k}": F.col("k").cast("string"), "{id}": F.col("s_suppkey").cast("string"), "{tokens}": (F.col("s_suppkey") % 100 + 1).cast("string"), "{word}": F.col("word")}.items():
        text = F.replace(text, F.lit(name), value)
    text = F.replace(F.replace(text, F.lit("\x01"), F.lit("{")), F.lit("\x02"), F.lit("}"))
    return s.select(F.lit("repo").alias("repo"), F.concat(F.lit("app/svc_"), F.col("s_suppkey").cast("string"), F.lit(".py")).alias("rel"), text.cast("binary").alias("content"))


@query("""select 'app/svc_' || s_suppkey || '.py::ask_' || s_suppkey as id, 'openai.chat.completions' as api, cast(s_suppkey % 100 + 1 as integer) as max_tokens, 10 as line, 'Say {text}' as prompt,
  'app/svc_' || s_suppkey || '.py::main' as callers from supplier""")
def scan_calls(spark, d):
    found = S.scan(S.python_files(sources(spark, d)))
    return found.select("id", "api", "max_tokens", "line", F.col("messages")[0]["content"].alias("prompt"), F.array_join("callers", ",").alias("callers"))


@query("""select 'app/svc_' || s_suppkey || '.py::ask_' || s_suppkey as id,
  case s_suppkey % 6 when 0 then 'literal_' || s_nationkey when 1 then 'm_' || s_nationkey when 2 then 'm_env' when 3 then 'm_fast_' || s_nationkey when 4 then 'm_' || s_nationkey end as model,
  case s_suppkey % 6 when 0 then 'literal' when 1 then 'constant' when 2 then 'env_default' when 3 then 'dict_lookup' when 4 then 'dict_lookup' else 'dynamic' end as source from supplier""")
def scan_resolve(spark, d):
    found = S.scan(S.python_files(sources(spark, d)))
    return found.select("id", F.col("model.value").alias("model"), F.col("model.source").alias("source"))


#: Three modules below ``src`` for each supplier, in two repositories of the same layout: the call's model and prompt are this module's or another's.
LAYOUT = {
    "src/lib_@id@/base.py": 'DEEP = "deep_@k@_@repo@"\n',
    "src/lib_@id@/conf.py": 'from lib_@id@.base import DEEP\n\nMODEL = "conf_@k@_@repo@"\nASK = "Ask well"\nLIST = [{"role": "user", "content": f"Tell {who}"}]\n',
    "src/app_@id@/main.py": """from openai import OpenAI
from lib_@id@.conf import ASK, DEEP, LIST, MODEL

client = OpenAI()


def ask_@id@(text, model="given_@k@_@repo@"):
    m = [{"role": "user", "content": "Sum: " + text}]
    @step@
    return client.chat.completions.create(model=@model@, messages=@messages@)
""",
}
#: (statement before the call, model, messages): a constant and a local list, names two modules away, a parameter and another module's list, a list that is changed, neither known.
LAYOUT_CALLS = [
    ("pass", "MODEL", "m"),
    ("pass", "DEEP", '[{"role": "user", "content": ASK}]'),
    ("pass", "model", "LIST"),
    ('m.append({"role": "user", "content": text})', '"literal_@k@_@repo@"', "m"),
    ("pass", "pick(text)", '[{"role": "user", "content": text}]'),
]


def layout_sources(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.explode(F.array(F.lit("r0"), F.lit("r1"))).alias("repo"))
    calls = F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(("step", "model", "messages"), c, strict=True))) for c in LAYOUT_CALLS))
    files = F.array(*(F.struct(F.lit(rel).alias("rel"), F.lit(text).alias("text")) for rel, text in LAYOUT.items()))
    rows = s.withColumn("call", F.get(calls, F.col("s_suppkey") % len(LAYOUT_CALLS))).withColumn("f", F.explode(files))
    rel, text = F.col("f.rel"), F.col("f.text")
    for name in ("step", "model", "messages"):
        text = F.replace(text, F.lit(f"@{name}@"), F.col(f"call.{name}"))
    for name, value in {"@id@": F.col("s_suppkey").cast("string"), "@k@": F.col("s_nationkey").cast("string"), "@repo@": F.col("repo")}.items():
        rel, text = F.replace(rel, F.lit(name), value), F.replace(text, F.lit(name), value)
    return rows.select("repo", rel.alias("rel"), text.cast("binary").alias("content"))


@query("""select repo, 'src/app_' || s_suppkey || '/main.py::ask_' || s_suppkey as id,
  case s_suppkey % 5 when 0 then 'conf' when 1 then 'deep' when 2 then 'given' when 3 then 'literal' end || '_' || s_nationkey || '_' || repo as model,
  case s_suppkey % 5 when 0 then 'constant' when 1 then 'constant' when 2 then 'parameter_default' when 3 then 'literal' else 'dynamic' end as source,
  case s_suppkey % 5 when 0 then 'Sum: {text}' when 1 then 'Ask well' when 2 then 'Tell {who}' when 4 then '{text}' end as prompt,
  case when s_suppkey % 5 <> 3 then true end as resolved
  from supplier cross join (values ('r0'), ('r1')) v(repo)""")
def scan_layouts(spark, d):
    """Models and prompts over imports, ``src`` folders, parameters, joined texts and changed lists, in two repositories apart."""
    found = S.scan(S.python_files(layout_sources(spark, d)))
    first = F.get("messages", 0)
    return found.select("repo", "id", F.col("model.value").alias("model"), F.col("model.source").alias("source"), first["content"].alias("prompt"), first["resolved"].alias("resolved"))


#: A module for each supplier whose call's model and prompt hang on the last assignment above it, or on a dictionary behind other names.
DEFINITIONS = {
    "far_@id@.py": 'TABLE = {"far": "far_@k@", "near": "near_@k@"}\n',
    "app_@id@.py": """from openai import OpenAI
from far_@id@ import TABLE as HELD

ROUTES = {"fast": "fast_@k@", "slow": "slow_@k@"}
client = OpenAI()


def ask_@id@(text, other, cfg=ROUTES, model="par_@k@"):
    p = "never"
    p = "Say " + text
    @step@
    return client.@call@
    p = m = "after"
""",
}
_CHAT = 'chat.completions.create(model=@model@, messages=[{"role": "user", "content": p}])'
#: (statements before the call, the call, its model as SQL over the nation's key, the model's source, the prompt).
DEFINITION_CASES = [
    ('m = "start"\n    if text:\n        m = "inner"\n    m = "last_@k@"', _CHAT.replace("@model@", "m"), "'last_' || k", "constant", "'Say {text}'"),
    ('if text:\n        for x in text:\n            m = "deep_@k@"', _CHAT.replace("@model@", "m"), "'deep_' || k", "constant", "'Say {text}'"),
    ("routes = ROUTES", _CHAT.replace("@model@", 'routes["fast"]'), "'fast_' || k", "dict_lookup", "'Say {text}'"),
    ("pass", _CHAT.replace("@model@", 'cfg["slow"]'), "'slow_' || k", "dict_lookup", "'Say {text}'"),
    ("t = HELD\n    u = t", _CHAT.replace("@model@", 'u["far"]'), "'far_' || k", "dict_lookup", "'Say {text}'"),
    ('a = "one"\n    b = a\n    a = "two_@k@"', _CHAT.replace("@model@", "b"), "'two_' || k", "constant", "'Say {text}'"),
    ('d = {"x": "old"}\n    d = {"x": "new", "y": ROUTES["fast"]}', _CHAT.replace("@model@", 'd["y"]'), "'fast_' || k", "dict_lookup", "'Say {text}'"),
    ('if text:\n        model = "set_@k@"', _CHAT.replace("@model@", "model"), "'set_' || k", "constant", "'Say {text}'"),
    ("p = other", _CHAT.replace("@model@", "model"), "'par_' || k", "parameter_default", "'{other}'"),
    ("pass", _CHAT.replace("@model@", 'other["fast"]'), "null", "dynamic", "'Say {text}'"),
    ("pass", 'responses.create(model="given_@k@", input=text)', "'given_' || k", "literal", "null"),
    ('w = "no"\n    w = f"Ask {other}"', 'responses.create(model=HELD["near"], input=w)', "'near_' || k", "dict_lookup", "'Ask {other}'"),
]


def definition_sources(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    cases = F.array(*(F.struct(F.lit(step).alias("step"), F.lit(call).alias("call")) for step, call, *_ in DEFINITION_CASES))
    files = F.array(*(F.struct(F.lit(rel).alias("rel"), F.lit(text).alias("text")) for rel, text in DEFINITIONS.items()))
    rows = s.withColumn("case", F.get(cases, (F.col("s_suppkey") % len(DEFINITION_CASES)).cast("int"))).withColumn("f", F.explode(files))
    rel, text = F.col("f.rel"), F.replace(F.replace(F.col("f.text"), F.lit("@step@"), F.col("case.step")), F.lit("@call@"), F.col("case.call"))
    for name, value in {"@id@": F.col("s_suppkey").cast("string"), "@k@": F.col("s_nationkey").cast("string")}.items():
        rel, text = F.replace(rel, F.lit(name), value), F.replace(text, F.lit(name), value)
    return rows.select(F.lit("repo").alias("repo"), rel.alias("rel"), text.cast("binary").alias("content"))


_CASE_SQL = [" ".join(f"when {i} then {x}" for i, x in enumerate(column)) for column in ([c[2] for c in DEFINITION_CASES], [f"'{c[3]}'" for c in DEFINITION_CASES], [c[4] for c in DEFINITION_CASES])]


@query(f"""select 'app_' || s_suppkey || '.py::ask_' || s_suppkey as id, case s_suppkey % {len(DEFINITION_CASES)} {_CASE_SQL[0]} end as model, case s_suppkey % {len(DEFINITION_CASES)} {_CASE_SQL[1]} end as source,
  case s_suppkey % {len(DEFINITION_CASES)} {_CASE_SQL[2]} end as prompt from (select s_suppkey, s_nationkey as k from supplier)""")
def scan_definitions(spark, d):
    """Models and prompts by the last assignment above the call, in branches and repeated, and by dictionaries behind aliases, parameters' defaults and imports."""
    found = S.scan(S.python_files(definition_sources(spark, d)))
    return found.select("id", F.col("model.value").alias("model"), F.col("model.source").alias("source"), F.get("messages", 0)["content"].alias("prompt"))


def rough_sources(spark, d):
    """A file for each supplier, of which every tenth is cut off in the middle of a call and every fifteenth is no UTF-8."""
    rows, n = sources(spark, d), F.regexp_extract("rel", "svc_([0-9]+)", 1).cast("bigint")
    text = F.decode("content", "UTF-8")
    cut = F.encode(F.concat(text, F.lit("\n\nask_x(1,\n")), "UTF-8")
    return rows.withColumn("content", F.when(n % 15 == 7, F.concat("content", F.lit(b"# \xff\xfe\n"))).when(n % 10 == 3, cut).otherwise(F.col("content")))


_ROUGH_SQL = "with s as (select s_suppkey, s_suppkey % 15 = 7 as bytes, s_suppkey % 10 = 3 as cut from supplier)"


@query(f"""{_ROUGH_SQL} select count(*) as files_scanned, count(*) filter (bytes or cut) as warnings, count(*) filter (not bytes and not cut) as call_sites,
  count(*) filter (not bytes and not cut and s_suppkey % 6 <> 5) as models_resolved, count(*) filter (not bytes and not cut) as prompts_resolved from s""")
def scan_totals(spark, d):
    """Files, warnings, call sites and what is known of them, all from one parse."""
    facts = S.scan_facts(S.python_files(rough_sources(spark, d)))
    return S.scan_totals(facts, S.scan_sites(facts))


@query(f"""{_ROUGH_SQL} select 'app/svc_' || s_suppkey || '.py' as rel, case when bytes then null else 17 end as line, case when bytes then 'could not read file' else 'syntax error' end as warning from s where bytes or cut""")
def scan_file_warnings(spark, d):
    """The files that can't be read or parsed, syntax errors with their line."""
    return S.scan_warnings(S.file_facts(S.python_files(rough_sources(spark, d)))).select("rel", "line", F.substring_index("warning", ",", 1).alias("warning"))


#: Statuses as a price list would know them: an order's status holds from its date on.
@query("""select l.l_orderkey, l.l_linenumber, l.l_shipdate as at, (select max(o.o_orderkey) from orders o where o.o_custkey = c.o_custkey and o.o_orderdate =
    (select max(o2.o_orderdate) from orders o2 where o2.o_custkey = c.o_custkey and o2.o_orderdate < l.l_shipdate)) as last_order
  from lineitem l join orders c on l.l_orderkey = c.o_orderkey""")
def last_order_before(spark, d):
    """Each line with its customer's last order before the day that it was shipped."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("at"))
    rows = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    events = orders.select("o_custkey", F.col("o_orderdate").alias("at"), "o_orderkey", (-F.col("o_orderkey")).alias("first"))
    met = last_before(rows, events, ["o_custkey"], "at", "first")
    return met.select("l_orderkey", "l_linenumber", "at", F.col("event.o_orderkey").alias("last_order"))


@query(domain("select site_id, model, case_id, seq, error, passed from latest"))
def stream_last_wins(spark, d):
    """The log followed as a stream into a table of last rows in the shared folder; nothing passes through the driver."""
    stream = results_of(log.follow(spark, f"{d}/events*.parquet", table(spark, d, "events").schema))
    folder = f"{shared_dir(spark)}/costlens-stream-{uuid.uuid4().hex}"
    log.upsert(stream, f"{folder}/table", f"{folder}/progress").awaitTermination()
    return log.upserted(spark, f"{folder}/table").select("site_id", "model", "case_id", "seq", "error", "passed")


@query(domain("select site_id, model, case_id, seq, error, passed from latest"))
def stream_running_last(spark, d):
    """The log's keys as state of the stream, one row a key: each batch hands on only the keys that changed, with their last row so far."""
    stream = results_of(log.follow(spark, f"{d}/events*.parquet", table(spark, d, "events").schema)).select("site_id", "model", "case_id", "seq", "error", "passed")
    folder = f"{shared_dir(spark)}/costlens-stream-{uuid.uuid4().hex}"
    log.upsert(log.running_last(stream), f"{folder}/table", f"{folder}/progress", mode="update").awaitTermination()
    return log.upserted(spark, f"{folder}/table")
