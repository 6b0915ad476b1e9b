"""Validation of eval sets in commands, and rounds of generated cases."""

import json

from costlens import cli
from costlens.operators import evals as E
from costlens.operators import model_calls as MC
from costlens.operators.model_calls import FixedClient

SITE = {"file": "a.py", "line": 1, "function": "f", "api": "openai.chat.completions", "model": {"value": "big", "source": "literal", "expression": "'big'"}}
MODELS = {"models": {"baseline": "big", "candidates": ["mid"]}}


def project(tmp_path, sites, sets):
    (tmp_path / "c.json").write_text(json.dumps(MODELS))
    doc = {"schema_version": 1, "tool": "costlens", "generated_by": "auditor", "call_sites": [SITE | s for s in sites]}
    (tmp_path / "scan.json").write_text(json.dumps(doc))
    (tmp_path / "evals").mkdir()
    for slug, cases in sets.items():
        (tmp_path / "evals" / f"{slug}.jsonl").write_text("\n".join(map(json.dumps, cases)))


def prompt(text, resolved=True):
    return [{"role": "user", "content": text, "resolved": resolved}]


def case(i, expected, grading="exact", **inputs):
    return {"id": f"c{i}", "inputs": inputs, "expected": expected, "grading": grading}


def test_a_broken_set_is_reported_and_not_run(spark, tmp_path, capsys):
    sites = [
        {"id": "a.py::f", "messages": prompt("Label {text}"), "grading": "exact", "output_contract": "One label from the set {yes, no}"},
        {"id": "a.py::g", "messages": prompt("Label {text}"), "grading": "exact"},
        {"id": "a.py::h", "messages": prompt("Say {x.y}"), "grading": "judge"},
        {"id": "a.py::k", "messages": prompt("Say {x}", False), "grading": "json_fields", "output_contract": "JSON"},
    ]
    broken = [case(i, ["maybe", 7, "yes", "  ", None][i % 5], "judge" if i % 5 == 2 else "exact", **({"wrong": "x"} if i % 2 else {"text": "x"})) for i in range(25)]
    good = [case(i, "yes", text=f"t{i}") for i in range(20)]
    project(tmp_path, sites, {"a__f": broken, "a__g": good, "a__h": [case(0, "r", "judge", other="x")], "a__k": [case(0, {"a": 1}, "json_fields", x="1")], "a__gone": good})
    run = lambda *a, **more: cli.main(["--config", f"{tmp_path}/c.json", *a], spark, **more)
    assert run("check-evals", f"{tmp_path}/scan.json", f"{tmp_path}/evals") == 1
    told = capsys.readouterr().out.splitlines()
    assert any(line.startswith("error: a__f line 1: expected maybe is not one of yes, no") for line in told)
    assert any(line.startswith("error: a__f line 2: exact grading needs expected to be a non-empty string") for line in told)  # 7 is a number
    assert any(line.startswith("error: a__f line 3: grading judge does not match call site grading exact") for line in told)
    assert any(line == "error: a__f line 2: inputs missing text" for line in told) and any(line == "error: a__f line 2: inputs not in the prompt: wrong" for line in told)
    assert {"error: a__h: prompt has expressions: x.y", "error: a__k: prompt is unresolved", "error: a__gone: no call site", "warning: a__k: output_contract names no graded fields", "warning: a__h: only 1 cases (aim for 20 or more)"} <= set(told)
    assert not any(line.startswith(("error: a__h line", "error: a__g line", "error: a__g:")) for line in told)
    errors, warnings = sum(x.startswith("error") for x in told), sum(x.startswith("warning") for x in told)
    assert told[-1] == f"5 sets, 67 cases, {errors} errors, {warnings} warnings"
    assert run("run", f"{tmp_path}/scan.json", f"{tmp_path}/evals", f"{tmp_path}/results", client=lambda: FixedClient("yes")) == 0
    assert "skipped: a.py::f: " in capsys.readouterr().err
    rows = list((tmp_path / "results").rglob("*.jsonl")) or list((tmp_path / "results").rglob("part-*"))
    text = "".join(p.read_text() for p in rows)
    assert '"c19"' in text and "maybe" not in text


def test_a_good_set_passes_and_strict_wants_no_warnings(spark, tmp_path):
    project(tmp_path, [{"id": "a.py::f", "messages": prompt("Label {text}"), "grading": "exact"}, {"id": "a.py::g", "messages": prompt("x"), "grading": "exact"}], {"a__f": [case(i, "yes", text=f"t{i}") for i in range(20)]})
    run = lambda *a: cli.main(["--config", f"{tmp_path}/c.json", "check-evals", f"{tmp_path}/scan.json", f"{tmp_path}/evals", *a], spark)
    assert (run(), run("--strict")) == (0, 1)  # the other site has no file


def test_rounds_stay_in_order_and_drops_are_told(spark, tmp_path):
    reply = lambda *names: json.dumps([{"inputs": {"t": n}, "expected": "x"} for n in names])
    replies = {6: reply("r1a", "r1b", "r1a"), 4: reply("r2a", "r1b", "r2b"), 2: reply("r3a", "r3b", "r3c")}

    def answer(model, messages):
        missing = next(n for n in replies if f"Write {n} " in messages[1]["content"])
        return replies[missing]

    site = spark.createDataFrame(
        [("s", "f", [("user", "Do {t}", True)], ["t"], "judge", None, None, None)],
        "site_id string, function string, messages array<struct<role:string,content:string,resolved:boolean>>, wanted array<string>, grading string, labels array<string>, fields array<string>, output_contract string",
    )
    cases, problems = MC.generate(site, "m", lambda: FixedClient(answer), 6, f"{tmp_path}/rounds")
    got = sorted(cases.collect(), key=lambda r: r["id"])
    assert [r["inputs"]["t"] for r in got] == ["r1a", "r1b", "r2a", "r2b", "r3a", "r3b"] and [r["id"] for r in got] == [f"f-{n:02d}" for n in range(1, 7)]
    assert "a case has the inputs of an earlier one" in {r["problem"] for r in problems.collect()}


def test_set_report_of_nothing(spark):
    cases = spark.createDataFrame([], "slug string, line long, id string, inputs map<string,string>, expected string, expected_kind string, grading string")
    sites = spark.createDataFrame([], "id string, messages array<struct<role:string,content:string,resolved:boolean>>, output_contract string, grading string")
    report = E.set_report(cases, sites, spark.createDataFrame([], "slug string, line long, problem string"))
    assert report.count() == 0 and E.set_totals(report, cases).first()[:] == (0, 0, 0, 0)


def test_generated_inputs_that_differ_in_nested_order_alone_are_one(spark):
    cases = [{"inputs": {"a": {"x": 1, "y": [{"p": 1, "q": 2}]}, "b": "t"}, "expected": "1"}, {"inputs": {"b": "t", "a": {"y": [{"q": 2, "p": 1}], "x": 1}}, "expected": "2"}, {"inputs": {"a": {"x": 1, "y": [{"p": 1, "q": 3}]}, "b": "t"}, "expected": "3"}]
    replies = spark.createDataFrame([("s", "f", json.dumps(cases))], "site_id string, function string, text string")
    found, problems = E.parse_generated(replies, ["a", "b"])
    assert sorted((r["id"], r["expected"]) for r in found.collect()) == [("f-01", "1"), ("f-02", "3")] and problems.count() == 0


def test_the_canonical_form_leaves_texts_that_are_no_json(spark):
    rows = spark.createDataFrame([({"b": "[no json", "a": "x"},), ({"a": "{}", "b": ""},), ({},), (None,)], "inputs map<string,string>")
    assert [r[0] for r in rows.select(E.canonical()).collect()] == ['{"a":"x","b":"[no json"}', '{"a":"{}","b":""}', "{}", None]
