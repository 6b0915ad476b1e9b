"""The commands end to end, with a client that needs no network."""

import json

import pytest

from costlens import cli, config, render
from costlens.operators.model_calls import FixedClient

APP = """
from openai import OpenAI
client = OpenAI()

def label(text):
    return client.chat.completions.create(model="big", max_tokens=8, messages=[{"role": "user", "content": f"Label {text}"}])
"""
SETTINGS = {"models": {"baseline": "big", "candidates": ["mid"]}, "pricing": {"big": {"input": 2.5, "output": 10}, "mid": {"input": 0.1, "output": 0.4}}, "volume": {"default_per_day": 100}}


@pytest.fixture
def project(tmp_path):
    (tmp_path / "app").mkdir()
    (tmp_path / "app" / "main.py").write_text(APP)
    (tmp_path / "c.json").write_text(json.dumps(SETTINGS))
    (tmp_path / "evals").mkdir()
    cases = [{"id": f"c{i}", "inputs": {"text": f"t{i}"}, "expected": "Yes", "grading": "exact"} for i in range(20)]
    (tmp_path / "evals" / "main__label.jsonl").write_text("\n".join(map(json.dumps, cases)))
    return tmp_path


def test_commands_from_scan_to_report(spark, project):
    run = lambda *a, **more: cli.main(["--config", f"{project}/c.json", *a], spark, **more)
    assert run("scan", f"{project}/app", "--out", f"{project}/scan.json") == 0
    doc = json.loads((project / "scan.json").read_text())
    assert [(s["id"], s["model"]["value"], s["max_tokens"]) for s in doc["call_sites"]] == [("main.py::label", "big", 8)]
    assert run("validate", f"{project}/scan.json", "--strict") == 0
    assert run("check-evals", f"{project}/scan.json", f"{project}/evals", "--strict") == 0
    where = (f"{project}/scan.json", f"{project}/evals", f"{project}/results")
    for _ in range(2):  # the second run has nothing left to do
        assert run("run", *where, client=lambda: FixedClient("yes.")) == 0
    assert run("report", *where, "--out", f"{project}/report.md") == 0
    text = (project / "report.md").read_text()
    assert "| main.py::label | downgrade | mid |" in text and "| model calls | 40 |" in text
    assert run("export", *where, "--out", f"{project}/export") == 0 and (project / "export" / "callsites").is_dir()
    summary = json.loads(next((project / "export" / "summary").glob("*.json")).read_text())
    summary = json.loads(summary["doc"])
    assert (summary["call_sites"], summary["downgrades"], summary["sets"], summary["cases"], summary["analysis"]["model_calls"]) == (1, 1, 1, 20, 40)
    assert run("compare", f"{project}/scan.json", f"{project}/scan.json") == 0
    assert run("estimate", f"{project}/scan.json", f"{project}/scan.json", "--fail-above", "0") == 0


def test_a_report_lists_every_change(spark):
    row = "'added' as status, concat('s',id) as id, 1.0D as before, 2.0D as after, 1.0D as delta, true as known, array('x') as reasons, false as model_assumed, false as completion_assumed, false as prompt_partial"
    text = render.diff_report(spark.range(10_050).selectExpr(*row.split(", ")))
    assert text.count("| added |") == 10_050


def test_bad_input_is_2(spark, project):
    (project / "bad.json").write_text(json.dumps({"models": {"baseline": ""}, "extra": 1}))
    assert cli.main(["--config", f"{project}/bad.json", "validate", "x"], spark) == 2
    with pytest.raises(config.ConfigError, match="unknown field extra.*baseline.*candidates"):
        config.load(f"{project}/bad.json")


def test_a_report_names_sites_without_cases(spark, project):
    run = lambda *a, **more: cli.main(["--config", f"{project}/c.json", *a], spark, **more)
    (project / "app" / "other.py").write_text(APP.replace("def label", "def other"))
    run("scan", f"{project}/app", "--out", f"{project}/scan.json")
    where = (f"{project}/scan.json", f"{project}/evals", f"{project}/results")
    run("run", *where, client=lambda: FixedClient("yes."))
    run("report", *where, "--out", f"{project}/report.md")
    assert "- other.py::other: no eval cases" in (project / "report.md").read_text()


def test_a_scan_tells_its_files_and_warnings(spark, project, capsys):
    (project / "app" / "broken.py").write_text("x = 1\ndef f(:\n")
    (project / "app" / "plain.py").write_text("x = 1\n")
    assert cli.main(["--config", f"{project}/c.json", "scan", f"{project}/app", "--out", f"{project}/scan.json"], spark) == 0
    told = capsys.readouterr()
    assert "1 call sites in 3 files, models resolved 1/1, prompts resolved 1/1" in told.out and "warning: broken.py:2: syntax error" in told.err
    doc = json.loads((project / "scan.json").read_text())
    assert doc["summary"] == {"files_scanned": 3, "call_sites": 1, "models_resolved": 1, "prompts_resolved": 1}
    assert [w.split(",")[0] for w in doc["warnings"]] == ["broken.py:2: syntax error"] and len(doc["call_sites"]) == 1
    assert cli.main(["validate", f"{project}/scan.json", "--strict"], spark) == 0


BROKEN = [
    ({"line": 0}, "line must be >= 1"),
    ({"model": None}, "model must be object"),
    ({"model": {"value": "m", "source": "guess", "expression": "m"}}, "model: source must be in"),
    ({"model": {"value": 3, "source": "literal", "expression": "m", "extra": 1}}, "model: value must be string or null"),
    ({"messages": [{"role": "user", "content": "x"}, {"role": "user"}, "text"]}, r"messages\[1\]: content is missing; a.py::f: messages\[2\]: is no object"),
    ({"messages": [{"role": "", "content": "x", "resolved": "yes"}]}, "role must be non-empty"),
    ({"mystery": 1}, "unknown field mystery"),
]


@pytest.mark.parametrize(("change", "problem"), BROKEN)
def test_no_command_takes_a_broken_scan(spark, project, change, problem, capsys):
    import re

    site = {"id": "a.py::f", "file": "a.py", "line": 1, "function": "f", "api": "x", "model": {"value": "m", "source": "literal", "expression": "'m'"}} | change
    (project / "bad.json").write_text(json.dumps({"schema_version": 1, "call_sites": [site]}))
    assert cli.main(["--config", f"{project}/c.json", "estimate", f"{project}/bad.json", f"{project}/bad.json"], spark) == 2
    assert re.search(problem, capsys.readouterr().err)
    assert cli.main(["validate", f"{project}/bad.json"], spark) == 1


def test_a_scan_of_another_version_or_with_repeated_ids_is_bad_input(spark, project, capsys):
    site = {"id": "a.py::f", "file": "a.py", "line": 1, "function": "f", "api": "x", "model": {"value": None, "source": "env", "expression": "m"}}
    for doc, problem in (({"schema_version": 2, "call_sites": []}, "schema_version must be 1"), ({"schema_version": 1, "call_sites": [site, site]}, "duplicate id")):
        (project / "bad.json").write_text(json.dumps(doc))
        assert cli.main(["compare", f"{project}/bad.json", f"{project}/bad.json"], spark) == 2
        assert problem in capsys.readouterr().err


def test_export_holds_examples_and_a_grid_of_every_model(spark, project):
    site = {"id": "main.py::label", "file": "main.py", "line": 5, "function": "label", "api": "x", "model": {"value": "big", "source": "literal", "expression": "'big'"}}
    (project / "scan.json").write_text(json.dumps({"schema_version": 1, "call_sites": [site]}))
    log = project / "results" / "main__label"
    log.mkdir(parents=True)
    row = {"output": "yes", "prompt_tokens": 3, "completion_tokens": 1, "latency_s": 0.1, "score": 1.0, "passed": True, "detail": "match"}
    (log / "big.jsonl").write_text("\n".join(json.dumps({"case_id": f"c{i}", "model": "big"} | row) for i in range(20)))
    (log / "mid.jsonl").write_text(json.dumps({"case_id": "c1", "model": "mid", "error": "refused"}))
    where = (f"{project}/scan.json", f"{project}/evals", f"{project}/results")
    assert cli.main(["--config", f"{project}/c.json", "export", *where, "--out", f"{project}/export", "--examples", "2"], spark) == 0
    docs = lambda part: [json.loads(json.loads(line)["doc"]) for f in (project / "export" / part).glob("*.json") for line in f.read_text().splitlines()]
    (found,) = docs("examples")
    assert (found["cases"], found["models"], [e["id"] for e in found["examples"]]) == (20, ["big", "mid"], ["c0", "c1"])
    assert found["examples"][0]["inputs"] == {"text": "t0"} and found["examples"][0]["outputs"]["mid"] is None
    assert found["examples"][1]["outputs"] == {"big": {"output": "yes", "passed": True, "score": 1.0, "judge_score": None, "detail": "match", "error": None}, "mid": {"output": None, "passed": None, "score": None, "judge_score": None, "detail": None, "error": "refused"}}
    grid = {g["id"]: g["passed"] for g in docs("evals")}
    assert len(grid) == 20 and grid["c0"] == {"big": True, "mid": None}
