"""Dynamic JSON: objects in model output, normal forms of values, judge scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, collapse, strip_fences

# Fixed patterns of a judge's reply.
SCORE_LABEL = r"(?i)\bscore\b\s*(?:is|of|=|:)?\s*\**\s*([1-5])(?!\d|\.\d)"
OUT_OF = r"(?i)(?<![\d.])([1-5])\s*(?:/|out of)\s*5(?!\d)"
LONE = r"^\s*([1-5])\s*\.?\s*$"


def let(value, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def parse_json_object(c) -> Column:
    """The object that a model's output is, fences and prose around it allowed, as VARIANT; null for anything else.

    The text between the first and the last brace is tried only where the whole is no JSON. Repeated keys and NaN are no JSON here.
    """
    found = let(strip_fences(c), lambda b: F.coalesce(F.try_parse_json(b), F.try_parse_json(F.nullif(F.regexp_extract(b, r"(?s)\{.*\}", 0), F.lit("")))))
    return let(found, lambda v: F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), v))


def norm_text(c) -> Column:
    """A scalar's text for comparison: single spaces, lower case, ``null`` and ``none`` empty."""
    t = F.lower(collapse(F.coalesce(col(c), F.lit(""))))
    return F.when(t.isin("null", "none"), "").otherwise(t)


def canonical(c) -> Column:
    """A JSON object or array as compact text with sorted keys, which is how a VARIANT prints; any other text as it is."""
    c = col(c)
    return F.when(c.rlike(r"^\s*[\[{]"), F.coalesce(F.to_json(F.try_parse_json(c)), c)).otherwise(c)


def field_path(name: str) -> str:
    """The path of a key, whatever characters it has."""
    return '$["' + name.replace("\\", "\\\\").replace('"', '\\"') + '"]' if not name.isidentifier() else f"$.{name}"


def norm_value(variant, path: str) -> Column:
    """A field of a VARIANT as text for comparison; 14.0 is 14, booleans are true and false, null is empty, nested values have sorted keys."""
    return norm_text(F.try_variant_get(col(variant), path, "string"))


def has_key(variant, name: str) -> Column:
    """Is the key there, even with null?"""
    return F.try_variant_get(col(variant), field_path(name), "variant").isNotNull()


def field_scores(variant, expected: dict[str, Column], names: list[str]) -> Column:
    """struct(value, passed, detail): the share of graded fields that match; a missing one is wrong. Nested values are compared with sorted keys on both sides."""
    if not names:
        raise ValueError("json_fields grading needs at least one field")

    def problem(v: Column, n: str) -> Column:
        want = F.coalesce(canonical(expected[n]), F.lit("null"))
        told = lambda got: F.when(norm_text(got) != norm_text(want), F.concat(F.lit(f"{n}: expected "), want, F.lit(", got "), F.coalesce(got, F.lit("null"))))
        return F.when(~has_key(v, n), F.lit(f"{n}: missing")).otherwise(let(F.try_variant_get(v, field_path(n), "string"), told))

    def score(wrong: Column) -> Column:
        none = wrong.isNull()
        return F.struct(
            F.when(none, 0.0).otherwise((F.lit(len(names)) - F.size(wrong)) / len(names)).alias("value"),
            (~none & (F.size(wrong) == 0)).alias("passed"),
            F.when(none, "output is not a JSON object").when(F.size(wrong) == 0, "all fields match").otherwise(F.array_join(wrong, "; ")).alias("detail"),
        )

    wrong = let(col(variant), lambda v: F.when(v.isNotNull(), F.array_compact(F.array(*(problem(v, n) for n in names)))))
    return let(wrong, score)


def object_scores(output, expected, fields) -> Column:
    """The same for columns of texts: ``expected`` is a JSON object, ``fields`` the array of graded names, or all keys of ``expected`` where it is null."""

    def score(v: Column) -> Column:
        names = F.coalesce(col(fields), F.json_object_keys(col(expected)))
        got, want = v.cast("map<string,variant>"), F.try_parse_json(col(expected)).cast("map<string,variant>")
        text = lambda m, n: F.coalesce(F.try_element_at(m, n).cast("string"), F.lit("null"))
        wrong = F.transform(
            F.filter(names, lambda n: ~F.map_contains_key(got, n) | (norm_text(text(got, n)) != norm_text(text(want, n)))),
            lambda n: F.when(~F.map_contains_key(got, n), F.concat(n, F.lit(": missing"))).otherwise(F.concat(n, F.lit(": expected "), text(want, n), F.lit(", got "), text(got, n))),
        )
        return let(wrong, lambda w: F.struct((F.size(names) - F.size(w)).cast("double") / F.size(names), F.size(w) == 0, F.when(F.size(w) == 0, "all fields match").otherwise(F.array_join(w, "; "))))

    kind = "struct<value:double,passed:boolean,detail:string>"
    none = F.struct(F.lit(0.0), F.lit(False), F.lit("output is not a JSON object")).cast(kind)
    return F.coalesce(let(parse_json_object(output), lambda v: F.when(v.isNotNull(), score(v).cast(kind))), none)


def parse_judge_score(c) -> Column:
    """1 to 5 from a judge's reply, or null: its ``score`` key if it has one, else a labelled score, n/5, or a lone digit."""
    data = parse_json_object(c)
    raw = F.try_variant_get(data, "$.score", "string")
    boolean = F.schema_of_variant(F.try_variant_get(data, "$.score", "variant")) == "BOOLEAN"
    number = raw.try_cast("double")
    keyed = F.when(~F.coalesce(boolean, F.lit(False)) & (number == F.floor(number)) & number.between(1, 5), number.cast("int"))
    grab = lambda p: F.nullif(F.regexp_extract(col(c), p, 1), F.lit(""))
    return F.when(data.isNotNull() & has_key(data, "score"), keyed).otherwise(F.coalesce(grab(SCORE_LABEL), grab(OUT_OF), grab(LONE)).cast("int"))


def judge_value(score, pass_at: int = 4) -> Column:
    """struct(value, passed): a judge's 1 to 5 as 0 to 1; null is 0 and failed."""
    s = col(score)
    return F.struct(F.coalesce((s - 1) / 4, F.lit(0.0)).alias("value"), F.coalesce(s >= pass_at, F.lit(False)).alias("passed"))


def merge_inputs(shared, own) -> Column:
    """Two maps as one; where both have a key, ``own`` wins."""
    kept = F.map_filter(col(shared), lambda k, v: ~F.map_contains_key(col(own), k))
    return F.map_concat(kept, col(own))
