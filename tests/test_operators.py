"""Edges of decisions, the log, sources, scans, model calls and streams."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from costlens import render
from costlens.operators import callsites as C
from costlens.operators import decide as D
from costlens.operators import evals as E
from costlens.operators import model_calls as MC
from costlens.operators import money as M
from costlens.operators import results as R
from costlens.operators import scan as S
from costlens.schemas import Settings
from costlens.sources import files, gitref
from costlens.streaming import log

PRICES = {"big": (2.5, 10.0), "mid": (0.15, 0.6), "small": (0.1, 0.4), "twin": (0.15, 0.6), "dear": (5.0, 20.0)}
STATS = "site_id string, model string, cases long, scored long, passed long, errors long, avg_prompt_tokens double, avg_completion_tokens double"


def settings(*candidates, **more):
    return Settings(baseline="big", candidates=list(candidates), prices=PRICES, **more)


def stats(spark, s, rows):
    """rows: (model, passed, cases, errors)"""
    df = spark.createDataFrame([("s", m, n, n - e, p, e, 100.0, 10.0) for m, p, n, e in rows], STATS)
    df = df.withColumns({"pass_rate": F.try_divide("passed", "scored"), "complete": (F.col("cases") > 0) & (F.col("errors") == 0) & (F.col("scored") == F.col("cases"))})
    return D.with_cost(df.join(D.model_dim(spark, s), "model"))


@pytest.mark.parametrize(
    "candidates,rows,more,want",
    [
        (["mid"], [("big", 20, 20, 0), ("mid", 19, 20, 0)], {}, ("downgrade", "mid", "keeps 95% of baseline quality and costs less")),
        (["mid"], [("big", 20, 20, 0), ("mid", 18, 20, 0)], {}, ("keep", "big", "no cheaper model passed the checks")),
        (["mid"], [("big", 20, 22, 0), ("mid", 18, 22, 0)], {"threshold": 0.9}, ("downgrade", "mid", "keeps 90% of baseline quality and costs less")),
        (["mid"], [("big", 15, 20, 0), ("mid", 15, 20, 0)], {"floor": 0.8}, ("keep", "big", "no cheaper model passed the checks")),
        (["mid", "twin"], [("big", 20, 20, 0), ("mid", 19, 20, 0), ("twin", 20, 20, 0)], {}, ("downgrade", "twin", "keeps 100% of baseline quality and costs less")),
        (["twin", "mid"], [("big", 20, 20, 0), ("mid", 20, 20, 0), ("twin", 20, 20, 0)], {}, ("downgrade", "twin", "keeps 100% of baseline quality and costs less")),
        (["mid", "small"], [("big", 20, 20, 0), ("mid", 20, 20, 0), ("small", 19, 20, 0)], {}, ("downgrade", "small", "keeps 95% of baseline quality and costs less")),
        (["dear"], [("big", 20, 20, 0), ("dear", 20, 20, 0)], {}, ("keep", "big", "no cheaper model passed the checks")),
        (["mid"], [("big", 20, 20, 0), ("mid", 19, 20, 1)], {}, ("keep", "big", "no cheaper model passed the checks")),
        (["mid"], [("big", 18, 20, 2), ("mid", 20, 20, 0)], {}, ("keep", "big", "baseline has incomplete results (2 errors, 18/20 scored)")),
        (["mid"], [("big", 0, 20, 0), ("mid", 20, 20, 0)], {}, ("keep", "big", "baseline passes no cases; nothing to compare against")),
        (["mid"], [("big", 0, 0, 0), ("mid", 20, 20, 0)], {}, ("keep", "big", "no baseline results")),
        ([], [("big", 20, 20, 0)], {}, ("keep", "big", "no candidate models")),
    ],
)
def test_decisions(spark, candidates, rows, more, want):
    s = settings(*candidates, **more)
    r = D.decide(stats(spark, s, rows), s).first()
    assert (r["action"], r["model"], r["reason"]) == want


def test_checks_say_why(spark):
    s = settings("mid", "small", "twin", "dear", floor=0.8)
    rows = [("big", 20, 20, 0), ("mid", 10, 20, 0), ("small", 0, 0, 0), ("twin", 12, 20, 3), ("dear", 20, 20, 0)]
    got = {r["model"]: r["reason"] for r in D.check_candidates(stats(spark, s, rows), s).collect()}
    assert got == {"mid": "keeps 50% of baseline quality, needs 95%", "small": "no results", "twin": "incomplete results (3 errors, 17/20 scored)", "dear": "not cheaper than the baseline"}
    with pytest.raises(ValueError):
        D.decide(stats(spark, s, rows), settings("mid", threshold=1.5))


def test_missing_price_fails(spark):
    s = Settings(baseline="big", candidates=["new"], prices={"big": (1.0, 1.0)})
    with pytest.raises(Exception, match="no pricing for model new"):
        stats(spark, s, [("big", 1, 1, 0), ("new", 1, 1, 0)]).collect()


def test_settings_problems():
    assert settings("mid").problems() == []
    bad = Settings(baseline="big", candidates=["big", "big"], prices={"big": (-1, 0)}, threshold=0, floor=2, volumes={"s": -1}, base_url="ftp://x")
    assert len(bad.problems()) == 7


def test_money_of_sites_and_analyses(spark):
    s = settings("mid", volumes={"s": 10}, default_volume=5)
    rated = stats(spark, s, [("big", 20, 20, 0), ("mid", 20, 20, 0)])
    cost = M.site_costs(D.decide(rated, s), rated, s).first()
    assert cost["per_day"] == 10 and abs(cost["before_month"] - 0.00035 * 300) < 1e-12 and cost["after_month"] < cost["before_month"]
    log_ = spark.createDataFrame([("s", "big", "c1", None, 100, 10, "j2"), ("s", "mid", "c1", None, 100, 10, "j1"), ("s", "mid", "c2", "bad", 100, 10, "j1"), ("s", "free", "c3", None, 5, 5, None)], "site_id string, model string, case_id string, error string, prompt_tokens long, completion_tokens long, judge_model string")
    a = M.analysis_cost(log_, s, 1.0).first()
    assert (a["model_calls"], a["judge_calls"], a["judge_model"], a["judge_priced_as"]) == (2, 2, "j1", "big")
    assert abs(a["judge_cost"] - 2 * (260 * 2.5 + 200 * 10) / 1e6) < 1e-12 and abs(a["total"] - a["model_cost"] - a["judge_cost"] - 1) < 1e-12
    none = M.summary(spark.createDataFrame([("s", None, 1.0)], "site_id string, before_month double, after_month double")).first()
    assert (none["before"], none["n_unknown"], none["savings_pct"]) == (0.0, 1, None)


def test_self_hosting(spark):
    row = spark.createDataFrame([(1.0, 1000.0, 0.5, 110.0, 0.00035, 20000.0), (1.0, 1000.0, 0.5, 110.0, 0.0, 1e9)], "gpu_hour double, tokens_per_s double, utilization double, tokens_per_call double, api_per_call double, calls_per_day double")
    a, b = M.hosting(row).collect()
    assert (a["gpu_month"], a["tokens_per_month"], a["gpus"]) == (730, 1.314e9, 1)
    assert abs(a["break_even_per_day"] - 69523.8095) < 1e-3 and b["break_even_per_day"] == float("inf") and b["gpus"] > 1


def test_log_files(spark, tmp_path):
    folder = tmp_path / "results" / "app__f"
    folder.mkdir(parents=True)
    ok = {"case_id": "c1", "model": "m", "output": "a b", "score": 1.0, "passed": True, "extra": 1}
    lines = [json.dumps(ok, ensure_ascii=False), "{bad", "[1]", "", json.dumps({"case_id": "c2"}), json.dumps(ok | {"score": 0.0}), json.dumps(ok | {"case_id": "c3", "error": "x", "score": None})]
    (folder / "m.jsonl").write_text("\n".join(lines), encoding="utf-8")
    rows = {r["case_id"]: r for r in files.latest_results(spark, str(tmp_path / "results")).collect()}
    assert set(rows) == {"c1", "c3"} and rows["c1"]["score"] == 0.0 and rows["c1"]["output"] == "a b" and rows["c1"]["slug"] == "app__f"


def test_eval_files(spark, tmp_path):
    lines = [json.dumps({"shared": {"tone": "kind", "lang": "en"}}), json.dumps({"id": "a", "inputs": {"q": "1", "lang": "de"}, "expected": "x", "grading": "exact"}), "", "nonsense", json.dumps({"id": "b", "inputs": {}})]
    (tmp_path / "app__f.jsonl").write_text("\n".join(lines))
    cases, problems = files.eval_cases(spark, str(tmp_path))
    assert [(r["id"], r["line"], r["inputs"]) for r in cases.collect()] == [("a", 2, {"tone": "kind", "q": "1", "lang": "de"})]
    assert {(r["line"], r["problem"]) for r in problems.collect()} == {(4, "is not a JSON object"), (5, "missing expected, grading")}


SOURCE = {
    "app/main.py": """
import os
from openai import OpenAI
from app.conf import MODEL as chosen, ROUTES
import app.conf as conf
client = OpenAI()

class Bot:
    async def ask(self, text):
        return await client.chat.completions.create(model=chosen, temperature=0.2, response_format={"type": "json_object"}, messages=[{"role": "system", "content": "Be " + "kind"}, {"role": "user", "content": f"Say {text}"}])

def twice(q, model="fallback"):
    client.chat.completions.create(model=model, messages=build(q))
    client.responses.create(model=ROUTES["fast"], input="Hi")
    client.responses.create(input="no model here")
    client.chat.completions.create(**{"model": "spread", "x": 1})
    client.chat.completions.create(model=os.environ["M"], messages=[])
    client.chat.completions.create(model=conf.DEEP, max_tokens=5, messages=[{"role": "user", "content": q}])
    client.chat.completions.create(model=pick(q), messages=[])

def run():
    twice("x")
    Bot().ask("y")
""",
    "app/conf.py": "import os\nMODEL = os.getenv('MODEL', 'm1')\nROUTES = {'fast': 'quick'}\nA = 'deep'\nDEEP = A\n",
    "app/broken.py": "def (:",
    "build/skipped.py": "x = 1",
    "app/note.txt": "text",
}


def test_scan_of_a_small_repository(spark):
    given = spark.createDataFrame([("r", k, v.encode()) for k, v in SOURCE.items()], "repo string, rel string, content binary")
    kept = S.python_files(given, ["*.py"], ["*note*"])
    assert {r["rel"] for r in kept.select("rel").collect()} == {"app/main.py", "app/conf.py", "app/broken.py"}
    assert S.file_facts(kept).filter("kind = 'warning'").count() == 1
    sites = {r["id"]: r for r in S.scan(kept).collect()}
    told = {k.split("::")[1]: (r["model"]["value"], r["model"]["source"]) for k, r in sites.items()}
    assert told == {
        "Bot.ask": ("m1", "env_default"), "twice": ("fallback", "parameter_default"), "twice#2": ("quick", "dict_lookup"), "twice#3": ("spread", "dict_lookup"),
        "twice#4": (None, "env"), "twice#5": ("deep", "constant"), "twice#6": (None, "dynamic"),
    }
    ask = sites["app/main.py::Bot.ask"]
    assert ask["is_async"] and ask["output_format"] == "json" and ask["temperature"] == 0.2
    assert [(m["role"], m["content"], m["resolved"]) for m in ask["messages"]] == [("system", "Be kind", True), ("user", "Say {text}", True)]
    assert sites["app/main.py::twice"]["messages"] is None and sites["app/main.py::twice"]["callers"] == ["app/main.py::run"]
    assert sites["app/main.py::twice#5"]["max_tokens"] == 5 and sites["app/main.py::twice#5"]["messages"][0]["content"] == "{q}"


def test_scan_of_a_src_layout_and_of_long_chains(spark):
    call = "client.chat.completions.create(model={}, messages={})\n"
    head = "from openai import OpenAI\nclient = OpenAI()\n"
    tree = {
        "src/app/conf.py": "MODEL = 'm1'\nROUTES = {'a.b': 'm2'}\n",
        "one/same.py": "MODEL = 'x'\n",
        "two/same.py": "MODEL = 'y'\n",
        "src/app/main.py": head + "from app.conf import MODEL, ROUTES\nfrom same import MODEL as either\nfrom chain.c0 import MODEL as far\n"
        "def a():\n    " + call.format("MODEL", "[]") + "def b():\n    " + call.format("ROUTES['a.b']", "[]") + "def c():\n    " + call.format("either", "[]") + "def d():\n    " + call.format("far", "[]")
        + "def e():\n    m = []\n    m.append({'role': 'user', 'content': 'x'})\n    " + call.format("'m'", "m"),
        **{f"chain/c{i}.py": f"from chain.c{i + 1} import MODEL\n" for i in range(7)},
        "chain/c7.py": "MODEL = 'm7'\n",
    }
    given = spark.createDataFrame([("r", k, v.encode()) for k, v in tree.items()], "repo string, rel string, content binary")
    found = {r["function"]: r for r in S.scan(given).collect()}
    assert {k: r["model"]["value"] for k, r in found.items()} == {"a": "m1", "b": "m2", "c": None, "d": "m7", "e": "m"}
    assert found["e"]["messages"] is None and found["a"]["model"]["defined_in"] == "src/app/conf.py"


def test_prompts_are_found_where_they_are_defined(spark):
    call = "client.chat.completions.create(model='m', messages={})"
    user = "[{'role': 'user', 'content': %s}]"
    head = "from openai import OpenAI\nfrom lib.prompts import ASK, LIST, FORMED, HOP\nimport lib.prompts as P\nclient = OpenAI()\nMSGS = [{'role': 'user', 'content': 'top ' + name}]\nASK2 = f'in {x}'\nmodel = 'wrong'\nfrom lib.prompts import LOST\nLOST = 'here'\n"
    bodies = {
        "param": ("text", call.format(user % "text")), "concat": ("value", call.format(user % "'Sum: ' + value")), "top": ("", call.format("MSGS")), "imported": ("", call.format(user % "ASK")), "formed": ("", call.format(user % "FORMED")),
        "listed": ("", call.format("LIST")), "dotted": ("", call.format(user % "P.ASK")), "hops": ("", call.format(user % "HOP")), "local": ("", "q = ASK2\n    " + call.format(user % "q")), "opaque": ("", call.format(user % "build()")),
        "grown": ("", "m = []\n    m += [1]\n    " + call.format("m")), "no_role": ("role", call.format("[{'role': role, 'content': 'x'}]")), "plain_text": ("", call.format("'hello'")), "system": ("", "client.responses.create(model='m', instructions='Be kind')"),
        "answer": ("q", "client.responses.create(model='m', instructions='Be kind', input='Say ' + q)"), "no_default": ("model", "client.chat.completions.create(model=model, messages=[])"), "assigned": ("", "client.chat.completions.create(model=LOST, messages=[])"),
    }
    tree = {
        "src/app.py": head + "".join(f"def {k}({a}):\n    {b}\n" for k, (a, b) in bodies.items()),
        "src/lib/prompts.py": "ASK = 'Ask well'\nWHO = 'you'\nFORMED = f'Tell {who}' + ' now'\nLIST = [{'role': 'system', 'content': 'Be'}, {'role': 'user', 'content': FORMED}]\nfrom lib.more import HOP\nLOST = 'there'\n",
        "src/lib/more.py": "HOP = 'far'\n",
    }
    given = spark.createDataFrame([("r", k, v.encode()) for k, v in tree.items()], "repo string, rel string, content binary")
    sites = {r["function"]: r for r in S.scan(given).collect()}
    told = {k: None if r["messages"] is None else [(m["role"], m["content"], m["resolved"]) for m in r["messages"]] for k, r in sites.items()}
    one = lambda text, ok=True: [("user", text, ok)]
    assert told == {
        "param": one("{text}"), "concat": one("Sum: {value}"), "top": one("top {name}"), "imported": one("Ask well"), "formed": one("Tell {who} now"), "listed": [("system", "Be", True), ("user", "Tell {who} now", True)],
        "dotted": one("Ask well"), "hops": one("far"), "local": one("in {x}"), "opaque": one("{build()}", False), "grown": None, "no_role": None, "plain_text": None, "system": [("system", "Be kind", True)],
        "answer": [("system", "Be kind", True), ("user", "Say {q}", True)], "no_default": [], "assigned": [],
    }
    assert (sites["no_default"]["model"]["value"], sites["no_default"]["model"]["source"]) == (None, "dynamic") and sites["assigned"]["model"]["value"] == "here"


def test_a_lists_texts_may_be_a_third_modules(spark):
    tree = {
        "src/app.py": "from openai import OpenAI\nfrom lib.p import LIST\nclient = OpenAI()\ndef a():\n    client.chat.completions.create(model='m', messages=LIST)\n",
        "src/lib/p.py": "from lib.more import ASK\nLIST = [{'role': 'user', 'content': ASK}]\n",
        "src/lib/more.py": "ASK = 'far'\n",
    }
    site = S.scan(spark.createDataFrame([("r", k, v.encode()) for k, v in tree.items()], "repo string, rel string, content binary")).first()
    assert [(m["role"], m["content"], m["resolved"]) for m in site["messages"]] == [("user", "far", True)]


def test_repositories_are_apart(spark):
    text = "from openai import OpenAI\nclient = OpenAI()\ndef helper():\n    client.chat.completions.create(model='m', messages=[])\n"
    rows = [("r1", "app/a.py", text.encode()), ("r2", "app/a.py", text.encode()), ("r2", "app/b.py", b"def run():\n    helper()\n")]
    got = {r["repo"]: (r["id"], r["callers"]) for r in S.scan(spark.createDataFrame(rows, "repo string, rel string, content binary")).collect()}
    assert got == {"r1": ("app/a.py::helper", []), "r2": ("app/a.py::helper", ["app/b.py::run"])}


def test_git_source(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", tmp_path, "-c", "user.name=t", "-c", "user.email=t@example.org", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("A = 1\n")
    run("add", "-A")
    run("commit", "-qm", "one")
    (tmp_path / "src" / "a.py").write_text("A = 2\n")
    gitref.register(spark)
    read = lambda **o: spark.read.format("gitref").options(repo=str(tmp_path), **o).load()
    assert [(r["rel"], bytes(r["content"])) for r in read(ref="HEAD", path="src").collect()] == [("a.py", b"A = 1\n")]
    assert read(path="absent").count() == 0
    with pytest.raises(Exception, match="unknown ref"):
        read(ref="nope").collect()


def test_model_calls_and_judging(spark):
    todo = spark.createDataFrame([("s", "m", "c1", [("user", "Say hi")], "hi"), ("s", "bad", "c2", [("user", "x")], "hi")], "site_id string, model string, case_id string, messages array<struct<role:string,content:string>>, expected string")

    def client():
        def reply(model, messages):
            if model == "bad":
                raise MC.ModelError("refused")
            return "Hi!"

        return MC.FixedClient(reply)

    got = {r["case_id"]: r for r in MC.run_cases(todo, client).collect()}
    assert got["c1"]["passed"] and got["c1"]["prompt_tokens"] == 2 and got["c2"]["error"] == "refused" and got["c2"]["score"] is None
    rows = spark.createDataFrame([("c1", [("user", "q")], "an answer", "be kind"), ("c2", [("user", "q")], "  ", "be kind")], "case_id string, messages array<struct<role:string,content:string>>, output string, rubric string")
    graded = {r["case_id"]: r for r in MC.judge(rows, "j", lambda: MC.FixedClient('{"score": 4}')).collect()}
    assert (graded["c1"]["score"], graded["c1"]["passed"], graded["c1"]["detail"]) == (0.75, True, "judge 4/5") and graded["c2"]["detail"] == "empty output"
    assert MC.warm_up(["m", "bad"], client()) == {"bad": "refused"}


def test_generation_asks_for_what_is_missing(spark, tmp_path):
    sites = spark.createDataFrame([("a.py::f", "f", [("user", "Label {q}", True)], ["q"], "exact", ["x", "y"], None, "one of two")], "site_id string, function string, messages array<struct<role:string,content:string,resolved:boolean>>, wanted array<string>, grading string, labels array<string>, fields array<string>, output_contract string")

    def client():
        def reply(model, messages):
            n = int(messages[1]["content"].split("Write ")[1].split()[0])
            return json.dumps([{"inputs": {"q": f"t{i % 3 + (n < 4) * 10}"}, "expected": "x"} for i in range(n)])

        return MC.FixedClient(reply)

    cases, problems = MC.generate(sites, "m", client, 4, str(tmp_path))
    got = cases.orderBy("ord").collect()
    assert [r["id"] for r in got] == ["f-01", "f-02", "f-03", "f-04"] and len({r["inputs"]["q"] for r in got}) == 4 and problems.count() == 0


def test_grading_follows_the_case(spark):
    rows = [("c1", "exact", "say hi", "Hi!"), ("c2", "json_fields", '{"a": [1], "b": 2}', '{"b": 2.0, "a": [1]}'), ("c3", "json_fields", "no", '{"a": 1}'), ("c4", "judge", "good", "be good"), ("c5", "judge", " ", "be good"), ("c6", "other", "x", "x"), ("c7", "judge", "boom", "x")]
    todo = spark.createDataFrame([("s", "m", c, [("user", say)], want, g) for c, g, say, want in rows], "site_id string, model string, case_id string, messages array<struct<role:string,content:string>>, expected string, grading string")

    def judge():
        def reply(model, messages):
            if "boom" in messages[1]["content"]:
                raise MC.ModelError("busy")
            return '{"score": 5, "reason": "fine"}'

        return MC.FixedClient(reply)

    echo = lambda: MC.FixedClient(lambda model, messages: messages[0]["content"].removeprefix("say "))
    got = {r["case_id"]: r for r in MC.run_cases(todo, echo, "j", judge).collect()}
    assert [got[c]["passed"] for c, *_ in rows] == [True, True, False, True, False, None, None]
    assert got["c4"]["detail"] == "judge 5/5: fine" and got["c4"]["judge_model"] == "j" and got["c5"]["detail"] == "empty output"
    assert got["c6"]["error"].startswith("scoring failed: unknown grading") and got["c7"]["error"] == "scoring failed: busy" and got["c7"]["output"] == "boom"


def test_resume_and_rescore(spark):
    schema = "site_id string, model string, case_id string, seq long, error string, score double, judge_model string"
    log_ = spark.createDataFrame([("s", "m", "c1", 1, "e", None, None), ("s", "m", "c1", 2, None, 1.0, "j"), ("s", "m", "c2", 3, None, 1.0, "j"), ("s", "m", "c2", 4, "scoring failed: x", None, "j"), ("s", "m", "c3", 5, "other", None, "k")], schema)
    last = R.last_wins(log_)
    assert {r["case_id"]: r["seq"] for r in last.collect()} == {"c1": 2, "c2": 4, "c3": 5}
    cases = spark.createDataFrame([("s", f"c{i}", i) for i in (1, 2, 4)], "site_id string, case_id string, line int")
    assert {r["case_id"] for r in R.todo(cases.drop("line"), spark.createDataFrame([("m",)], "model string"), last).collect()} == {"c2", "c4"}
    assert {r["case_id"] for r in R.to_rescore(last, "k").collect()} == {"c1", "c2"}
    with pytest.raises(ValueError):
        R.first_cases(cases, -1)


def test_stream_keeps_the_last_rows(spark, tmp_path):
    schema = "site_id string, model string, case_id string, seq long, score double"
    for i, rows in enumerate([[("s", "m", "c1", 1, 0.0), ("s", "m", "c2", 2, 0.5)], [("s", "m", "c1", 3, 1.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = log.follow(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
        log.upsert(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
        assert i or log.upserted(spark, f"{tmp_path}/out").count() == 2
    assert {r["case_id"]: r["score"] for r in log.upserted(spark, f"{tmp_path}/out").collect()} == {"c1": 1.0, "c2": 0.5}


def test_lint_without_the_auditors_sites(spark):
    sites = spark.createDataFrame([("a", "text", "exact", None, "ast", "p", "o", "e")], "id string, output_format string, grading string, via string, found_by string, purpose string, output_contract string, difficulty string")
    sites = sites.withColumns({"model": F.expr("named_struct('value', 'm')"), "messages": F.expr("array(named_struct('role', 'user', 'content', 'Say {x.y} and {z}', 'resolved', true))")})
    got = {(r["id"], r["warning"]) for r in C.lint(sites, "auditor").collect()}
    assert got == {("a", "placeholder {x.y} is an expression; use a plain name"), (None, "generated_by is auditor but no call site has found_by auditor")}
    assert C.lint(sites, "ast").count() == 0


def test_rescoring_saved_outputs(spark):
    log_ = spark.createDataFrame([("s", "m", "c1", 1, None, 0.0, "j", "an answer", 3, 4, 0.5), ("s", "m", "c2", 2, None, 1.0, "j", "other", 3, 4, 0.5)], "site_id string, model string, case_id string, seq long, error string, score double, judge_model string, output string, prompt_tokens long, completion_tokens long, latency_s double")
    cases = spark.createDataFrame([("s", "c1", [("user", "q")], "be kind", "judge"), ("s", "c2", [("user", "q")], "x", "exact")], "site_id string, case_id string, messages array<struct<role:string,content:string>>, expected string, grading string")
    rows = MC.rescore(log_, cases, "k", lambda: MC.FixedClient("Score: 5")).collect()
    assert [(r["case_id"], r["score"], r["passed"], r["judge_model"], r["output"]) for r in rows] == [("c1", 1.0, True, "k", "an answer")]
    assert MC.rescore(log_, cases, "j", lambda: MC.FixedClient("5")).count() == 0


def test_generated_cases(spark):
    text = '```json\n[{"inputs": {"q": "a"}, "expected": "x"}, {"inputs": {"q": "a"}, "expected": "y"}, {"inputs": {"z": "1"}, "expected": "x"}, {"inputs": {"q": "b"}, "expected": "y"}]\n```'
    replies = spark.createDataFrame([("s", "f", text), ("t", "g", "sorry")], "site_id string, function string, text string")
    cases, problems = E.parse_generated(replies, ["q"])
    assert sorted((r["id"], r["inputs"]["q"], r["expected"]) for r in cases.collect()) == [("f-01", "a", "x"), ("f-02", "b", "y")]
    assert {(r["site_id"], r["problem"][:6]) for r in problems.collect()} == {("s", "case 3"), ("t", "the re")}


def test_selectors(spark):
    sites = spark.createDataFrame([("a", "a", True), ("b", "b", False), ("c", "c", True)], "site_id string, slug string, has_file boolean")
    assert [r["site_id"] for r in E.select_only(sites, "site_id", ["b"]).collect()] == ["b"]
    with pytest.raises(ValueError, match="unknown site_id: x, y"):
        E.select_only(sites, "site_id", ["a", "y", "x"])
    found = spark.createDataFrame([("c", "bad"), ("c", "worse")], "site_id string, problem string")
    assert {r["site_id"]: r["skipped"] for r in E.ready_sites(sites, found).collect()} == {"a": None, "b": "no eval file", "c": "2 problems"}


def test_fates_of_call_sites_over_scans(spark):
    kinds = "id string, model struct<value:string,source:string>, messages array<struct<role:string,content:string,resolved:boolean>>, purpose string, output_contract string, difficulty string, grading string, found_by string, via string"
    scan = lambda *ids: spark.createDataFrame([(i, ("m", "literal"), None, None, None, None, None, "ast", None) for i in ids], kinds)
    scans = {"ast": scan("a", "b", "c"), "audit": scan("a", "d", "e"), "ast_after": scan("a", "b", "e", "f")}
    got = {r["id"]: r["fate"] for r in C.fates(C.presence(scans), list(scans)).collect()}
    assert got == {"a": "kept", "b": "back", "c": "gone", "d": "passing", "e": "new", "f": "new"}
    docs = {(r["part"], r["key"]): json.loads(r["doc"]) for r in render.audit_payload(scans["audit"]).collect()}
    assert docs["metric", "call_sites"] == {"metric": "call_sites", "label": "Call sites", "audit": 3, "ast": None, "ast_after": None}
    assert docs["site", "a"]["ast"] is None and docs["site", "a"]["audit"]["model"] == "m" and not [k for k in docs if k[0] == "change"]
