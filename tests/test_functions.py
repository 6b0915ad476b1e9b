"""Golden tables of the scalar functions."""

import json

import pytest
from pyspark.sql import functions as F

from costlens.functions import jsonvalues as J
from costlens.functions import text as T
from costlens.operators.evals import score_exact
from costlens.operators.money import payback_label


def apply(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f("x")).collect()]


def test_fences_and_normal_text(spark):
    cases = {"```json\n{}\n```": "{}", "```\nabc\n```": "abc", "```x y```": "x y", "  plain ": "plain", "``` open": "``` open", "a ```b``` c": "a ```b``` c"}
    assert apply(spark, list(cases), T.strip_fences) == list(cases.values())
    cases = {' "Refund." ': "refund", "**Yes**": "yes", "a\n\t b": "a b", "well-known!": "well-known", "`x`": "x", "": "", "```\nHi.\n```": "hi"}
    assert apply(spark, list(cases), T.normalize_text) == list(cases.values())


def test_short_forms(spark):
    assert apply(spark, ["a" * 80, "b" * 81, None], T.clip) == ["a" * 80, "b" * 77 + "...", None]
    assert apply(spark, ["", "  ", "a  b\tc\n", "one"], T.word_count) == [0, 0, 3, 1]
    assert apply(spark, ["a/b.py::f", "a\\b.py::C.f", "/x/y.py", "m::f::g"], T.slug_for) == ["a.b__f", "a.b__C.f", "x.y", "m__f::g"]
    assert apply(spark, ["qwen:7b", "//", "a b", "ok-1.2_x"], T.model_filename) == ["qwen-7b", "model", "a-b", "ok-1.2_x"]
    assert apply(spark, ["a.py::f", "a.py", "p::q::r"], T.site_name) == ["f", "a.py", "q::r"]


def test_placeholders_and_contracts(spark):
    assert apply(spark, ['{a} { b } {a} {"x": 1} {c.d} {1}'], T.placeholders) == [["a", "b"]]
    assert apply(spark, ["Graded fields: a, `b`, c d, e", "graded field: x.", "none", "Graded fields: two words"], T.graded_fields) == [["a", "b"], ["x"], None, None]
    assert apply(spark, ["from the set {low, 'mid', , high}", "from the set { }", None], T.allowed_values) == [["low", "mid", "high"], None, None]


def test_render_fills_in_order(spark):
    df = spark.sql("select 'Hi {name}, {b} {c}' as t, array('name', 'b') as k, map('name', '{b}', 'b', 'B') as v")
    assert df.select(T.render("t", "k", "v")).first()[0] == "Hi B, B {c}"


def test_globs_cross_slashes(spark):
    f = lambda x: T.matches_globs(x, ["*.py", "lib/?x*"], ["*test*"])
    assert apply(spark, ["a/b/c.py", "lib/ax/y", "a/test/c.py", "a.txt"], f) == [True, True, False, False]


def test_json_objects(spark):
    f = lambda x: F.to_json(J.parse_json_object(x))
    cases = ['{"a": 1}', '```json\n{"a": 2}\n```', 'Sure: {"a": 3} done', "[1]", "{broken", "", "5", 'x {"a": {"b": 1}} y']
    assert [json.loads(x) if x else None for x in apply(spark, cases, f)] == [{"a": 1}, {"a": 2}, {"a": 3}, None, None, None, None, {"a": {"b": 1}}]


def test_field_values(spark):
    values = ['{"v": 14.0}', '{"v": true}', '{"v": null}', '{"v": " A  b "}', '{"v": "None"}', "{}"]
    assert apply(spark, values, lambda x: J.norm_value(J.parse_json_object(x), "$.v")) == ["14", "true", "", "a b", "", ""]
    df = spark.createDataFrame([('{"a": "X", "b": 2, "z": 1}',), ('{"a": "y"}',), ("no",)], "o string").select(J.parse_json_object("o").alias("v"))
    got = [r["s"] for r in df.select(J.field_scores("v", {"a": F.lit("x"), "b": F.lit("2")}, ["a", "b"]).alias("s")).collect()]
    assert [(g["value"], g["passed"]) for g in got] == [(1.0, True), (0.0, False), (0.0, False)]
    assert got[1]["detail"] == "a: expected x, got y; b: missing" and got[2]["detail"] == "output is not a JSON object"
    with pytest.raises(ValueError):
        J.field_scores("v", {}, [])


def test_canonical_json(spark):
    df = spark.createDataFrame([('{"b": {"D": 1, "c": [2]}, "a": "X"}',), (None,)], "j string")
    assert [r[0] for r in df.select(J.canonical("j")).collect()] == ['{"a":"X","b":{"D":1,"c":[2]}}', None]
    got = spark.createDataFrame([('{"x": {"b": [2], "a": 1}, "y.z": "Q"}', '{"y.z": "q", "x": {"a": 1, "b": [2]}}')], "o string, e string").select(J.object_scores("o", "e", F.lit(None).cast("array<string>")).alias("s"), J.field_scores(J.parse_json_object("o"), {"x": F.get_json_object("e", "$.x"), "y.z": F.lit("Q")}, ["x", "y.z"]).alias("t")).first()
    assert got["s"]["passed"] and got["t"]["passed"]


@pytest.mark.parametrize(
    "text,score",
    [('{"score": 4}', 4), ('{"score": "3"}', 3), ('{"score": 3.0}', 3), ('{"score": 4.5}', None), ('{"score": true}', None), ('{"score": 9}', None), ("Score: 4", 4), ("**Score**: **5**", None), ("score is 2", 2), ("4/5", 4), ("3 out of 5", 3), (" 5. ", 5), ("Score: 4.5", None), ("I saw 3 cats", None), ("45", None), ('{"other": 1} Score: 2', 2), ("", None)],
)
def test_judge_scores(spark, text, score):
    assert apply(spark, [text], J.parse_judge_score) == [score]


def test_exact_scores_and_money(spark):
    df = spark.createDataFrame([(" Yes. ", "yes"), ("no", "yes"), (None, "yes")], "o string, e string")
    assert [(r["s"]["value"], r["s"]["passed"]) for r in df.select(score_exact("o", "e").alias("s")).collect()] == [(1.0, True), (0.0, False), (0.0, False)]
    assert apply(spark, [1234.5, -0.5, None], T.money, "double") == ["$1,234.50", "-$0.50", "n/a"]
    assert apply(spark, [0.001, 2.0, -3.0, None], T.signed_money, "double") == ["$0.00", "+$2.00", "-$3.00", "unknown"]
    assert apply(spark, [None, 0.001, 0.84, 1.0, 47.96, 48.0, 73.0], payback_label, "double") == ["never", "1 minute", "51 minutes", "1.0 hours", "48.0 hours", "2 days", "4 days"]
