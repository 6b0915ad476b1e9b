"""Names in source: the last definition above a call, dictionaries behind names, prompts in parts; as-of joins by brute force."""

import random

import pytest

from costlens.operators import scan as S
from costlens.operators.asof import last_before
from costlens.sources import files

HEAD = 'from openai import OpenAI\nfrom lib import TABLE as T, WHO\nimport lib\nROUTES = {"fast": "f", "slow": "s", "env": os.getenv("LLM", "e")}\nNAME = "top"\nclient = OpenAI()\n'
LIB = 'TABLE = {"far": "far_model", "env": os.environ["M"]}\nWHO = "Dear " + name\nASK = [{"role": "user", "content": WHO}]\nMODEL = "lib_model"\n'
CALL = "client.chat.completions.create(model={}, messages=[{{'role': 'user', 'content': {}}}])"
#: (function, value, source, prompt, resolved)
CASES = {
    "branch": ("def f(x):\n    if x:\n        m = 'first'\n    m = 'second'\n    " + CALL.format("m", "'p'"), "second", "constant", "p", True),
    "nested_last": ("def f(x):\n    m = 'first'\n    for y in x:\n        if y:\n            m = 'deep'\n    " + CALL.format("m", "'p'"), "deep", "constant", "p", True),
    "later": ("def f(x):\n    m = 'before'\n    " + CALL.format("m", "'p'") + "\n    m = 'after'", "before", "constant", "p", True),
    "only_later": ("def f(x):\n    " + CALL.format("NAME", "'p'") + "\n    NAME = 'after'", "top", "constant", "p", True),
    "alias": ("def f(x):\n    routes = ROUTES\n    " + CALL.format("routes['fast']", "'p'"), "f", "dict_lookup", "p", True),
    "default": ("def f(x, cfg=ROUTES):\n    " + CALL.format("cfg['fast']", "'p'"), "f", "dict_lookup", "p", True),
    "imported": ("def f(x):\n    t = T\n    " + CALL.format("t['far']", "'p'"), "far_model", "dict_lookup", "p", True),
    "attribute": ("def f(x):\n    " + CALL.format("lib.TABLE['far']", "'p'"), "far_model", "dict_lookup", "p", True),
    "entry_env": ("def f(x):\n    " + CALL.format("ROUTES['env']", "'p'"), "e", "env_default", "p", True),
    "imported_env": ("def f(x):\n    " + CALL.format("T['env']", "'p'"), None, "env", "p", True),
    "no_entry": ("def f(x):\n    " + CALL.format("ROUTES['none']", "'p'"), None, "dynamic", "p", True),
    "entry_of_text": ("def f(x):\n    " + CALL.format("NAME['fast']", "'p'"), None, "dynamic", "p", True),
    "entry_of_entry": ("def f(x):\n    c = ROUTES['fast']\n    " + CALL.format("c['fast']", "'p'"), None, "dynamic", "p", True),
    "param": ("def f(x, m):\n    " + CALL.format("m", "m"), None, "dynamic", "{m}", True),
    "param_default": ("def f(x, m=lib.MODEL):\n    " + CALL.format("m", "m"), "lib_model", "parameter_default", "{m}", True),
    "param_set": ("def f(x, m='d'):\n    m = 's'\n    " + CALL.format("m", "m"), "s", "constant", "s", True),
    "kwonly": ("def f(*, m='d'):\n    " + CALL.format("m", "'p'"), "d", "parameter_default", "p", True),
    "circle": ("def f(x):\n    a = b\n    b = a\n    " + CALL.format("a", "'p'"), None, "dynamic", "p", True),
    "spread": ("def f(x):\n    kw = {'model': T['far'], 'messages': []}\n    client.chat.completions.create(**kw)", "far_model", "dict_lookup", None, None),
    "spread_unknown": ("def f(x):\n    client.chat.completions.create(**x)", None, "kwargs", None, None),
    "imported_prompt": ("def f(x):\n    w = WHO\n    " + CALL.format("'m'", "w"), "m", "literal", "Dear {name}", True),
    "unknown_prompt": ("def f(x):\n    w = make()\n    " + CALL.format("'m'", "w"), "m", "literal", "{make()}", False),
    "sum_of_parts": ("def f(x):\n    w = 'a' + x + f'b{x.y!r}c' + str(1)\n    " + CALL.format("'m'", "w"), "m", "literal", "a{x}b{x.y}c{str(1)}", True),
    "list_elsewhere": ("def f(x):\n    client.chat.completions.create(model='m', messages=lib.ASK)", "m", "literal", "Dear {name}", True),
    "list_local": ("def f(x):\n    w = 'one'\n    w = 'two'\n    ms = [{'role': 'user', 'content': w}]\n    client.chat.completions.create(model='m', messages=ms)", "m", "literal", "two", True),
    "list_changed": ("def f(x):\n    ms = [{'role': 'user', 'content': x}]\n    ms[0] = x\n    client.chat.completions.create(model='m', messages=ms)", "m", "literal", None, None),
    "responses_param": ("def f(text):\n    client.responses.create(model='m', input=text)", "m", "literal", None, None),
    "responses_text": ("def f(text):\n    w = 'Say ' + text\n    client.responses.create(model='m', input=w)", "m", "literal", "Say {text}", True),
    "responses_default": ("def f(text='hi'):\n    client.responses.create(model='m', input=text)", "m", "literal", "{text}", True),
    "responses_call": ("def f(text):\n    client.responses.create(model='m', input=make(text))", "m", "literal", "{make(text)}", False),
}


@pytest.fixture(scope="module")
def sites(spark):
    rows = [(name, "app.py", (HEAD + "\n\n" + text + "\n").encode()) for name, (text, *_) in CASES.items()] + [(name, "lib.py", LIB.encode()) for name in CASES]
    return {r["repo"]: r for r in S.scan(spark.createDataFrame(rows, "repo string, rel string, content binary")).collect()}


@pytest.mark.parametrize("case", CASES)
def test_definitions(sites, case):
    r = sites[case]
    first = r["messages"][0] if r["messages"] else None
    assert (r["model"]["value"], r["model"]["source"], first and first["content"], first and first["resolved"]) == CASES[case][1:]


@pytest.mark.parametrize("strict", [True, False])
def test_last_before_by_force(spark, strict):
    rng = random.Random(3)
    some = lambda top: rng.choice([None, *range(top)])
    rows = [(i, some(4), some(12)) for i in range(200)]
    events = [(some(4), some(12), rng.randrange(3), i) for i in range(60)]
    got = last_before(spark.createDataFrame(rows, "id int, k int, at int"), spark.createDataFrame(events, "k int, at int, first int, n int"), ["k"], "at", "first", strict).collect()
    for r in got:
        fits = [e for e in events if None not in (r["k"], r["at"], e[0], e[1]) and e[0] == r["k"] and (e[1] < r["at"] or not strict and e[1] == r["at"])]
        best = max(((e[1], -e[2]) for e in fits), default=None)
        assert (r["event"] is None) if best is None else (r["event"]["at"], -r["event"]["first"]) == best
    assert len(got) == 200


def test_warnings_and_totals_come_from_the_same_facts(spark):
    rows = [("r", "a.py", b"x = 1\n"), ("r", "b.py", b"def f(:\n"), ("r", "c.py", b"\xff\xfe"), ("r", "d.py", b""), ("r", "e.py", None)]
    facts = S.scan_facts(spark.createDataFrame(rows, "repo string, rel string, content binary"))
    warnings = {r["rel"]: (r["line"], r["warning"].split(",")[0]) for r in S.scan_warnings(facts).collect()}
    assert warnings == {"b.py": (1, "syntax error"), "c.py": (None, "could not read file")}
    assert S.scan_totals(facts, S.scan_sites(facts)).first().asDict() == {"files_scanned": 5, "warnings": 2, "call_sites": 0, "models_resolved": 0, "prompts_resolved": 0}


def test_a_tree_root_is_no_pattern_and_may_be_a_file(spark, tmp_path):
    root = tmp_path / "c++ [x] {y}"
    (root / "in").mkdir(parents=True)
    (root / "in" / "a.py").write_text("A = 1\n")
    rel = lambda at: [r["rel"] for r in files.source_tree(spark, str(at)).collect()]
    assert rel(root) == ["in/a.py"] and rel(root / "in" / "a.py") == ["a.py"]
