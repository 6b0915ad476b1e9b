"""String functions of the domain as Column -> Column expressions."""

from __future__ import annotations

import ast
import fnmatch

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters trimmed from answers, and the patterns of fences, placeholders and output contracts.
OUTER_PUNCTUATION = " \t\r\n.,;:!?\"'`*()[]"
FENCE = r"(?s)^```(?:[\w-]+\n)?\s*(.*?)\s*```$"
BRACED = r"\{([^{}\n]+)\}"
GRADED_FIELDS = r"(?i)Graded fields?:\s*([^\n]+)"
VALUE_SET = r"(?i)from the set \{([^{}]+)\}"
IDENTIFIER = r"^[\p{L}_][\p{L}\p{N}_]*$"
WHITE = " \t\n\r\u000b\f\u001c\u001d\u001e\u001f\u0085     　"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Without white space, Unicode's too, at either end."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def collapse(c) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def strip_fences(c) -> Column:
    """The inside of a code fence that surrounds the whole text, else the text; trimmed."""
    t = strip(c)
    return F.when(t.rlike(FENCE), strip(F.regexp_extract(t, FENCE, 1))).otherwise(t)


def normalize_text(c) -> Column:
    """Lower case, single spaces, without fences and outer punctuation."""
    return F.btrim(F.lower(collapse(strip_fences(c))), F.lit(OUTER_PUNCTUATION))


def clip(c, limit: int = 80) -> Column:
    """At most ``limit`` characters, the last three dots if any are cut."""
    c = col(c)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 3), F.lit("..."))).otherwise(c)


def word_count(c) -> Column:
    """White-space words: the estimate of prompt tokens."""
    c = collapse(c)
    return F.when(c == "", 0).otherwise(F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1).cast("bigint")


def slug_for(c) -> Column:
    """``a/b.py::f`` -> ``a.b__f``."""
    c = col(c)
    path, function = F.substring_index(c, "::", 1), F.regexp_extract(c, "(?s)::(.*)$", 1)
    module = F.regexp_replace(path, r"\.py$", "")
    module = F.translate(F.btrim(F.translate(module, "\\", "/"), F.lit("/")), "/", ".")
    return F.when(function == "", module).otherwise(F.concat(module, F.lit("__"), function))


def model_filename(c) -> Column:
    """A model's name as a file name."""
    safe = F.btrim(F.regexp_replace(col(c), r"[^A-Za-z0-9._-]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit("model"))


def placeholders(c) -> Column:
    """Distinct names in braces, in order; braces around anything but a plain name, such as JSON, are left to :func:`braced`."""
    return F.filter(braced(c), lambda x: x.rlike(IDENTIFIER))


def is_expression(text: str) -> bool:
    """Does a text in braces parse as a Python expression that is more than a constant?"""
    try:
        return not isinstance(ast.parse(text.strip(), mode="eval").body, ast.Constant)
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return False


def template_fields(c) -> Column:
    """Distinct expressions in braces, plain names among them, in order. Python parses what is no plain name; the JVM has no such parser."""

    @F.pandas_udf("array<string>")
    def parsed(lists: pd.Series) -> pd.Series:
        return lists.map(lambda xs: None if xs is None else [x for x in xs if is_expression(x)])

    return parsed(braced(c))


def expression_fields(c) -> Column:
    """Those of :func:`template_fields` that are no plain name."""
    return F.filter(template_fields(c), lambda x: ~x.rlike(IDENTIFIER))


def braced(c) -> Column:
    """Distinct trimmed texts in braces, in order."""
    inner = F.transform(F.regexp_extract_all(col(c), F.lit(BRACED), F.lit(1)), lambda x: F.trim(x))
    return F.array_distinct(F.filter(inner, lambda x: x != ""))


def render(content, keys, values) -> Column:
    """``content`` with each ``{key}`` of the map ``values`` filled in, in the order of ``keys``."""
    return F.aggregate(col(keys), col(content), lambda acc, k: F.coalesce(F.replace(acc, F.concat(F.lit("{"), k, F.lit("}")), F.try_element_at(col(values), k)), acc))


def graded_fields(c) -> Column:
    """Names after ``Graded fields:`` up to the first that is none, or null."""
    parts = F.transform(F.split(F.regexp_extract(col(c), GRADED_FIELDS, 1), ","), lambda x: F.btrim(F.rtrim(F.trim(x), F.lit(".;")), F.lit("`'\"")))
    bad = F.array_position(F.transform(parts, lambda x: x.rlike(IDENTIFIER)), F.lit(False))
    taken = F.when(bad > 0, F.slice(parts, F.lit(1), (bad - 1).cast("int"))).otherwise(parts)
    return F.when(F.size(taken) > 0, taken)


def allowed_values(c) -> Column:
    """Labels in ``from the set {a, b}``, or null."""
    parts = F.transform(F.split(F.regexp_extract(col(c), VALUE_SET, 1), ","), lambda x: F.btrim(F.trim(x), F.lit("`'\"")))
    kept = F.filter(parts, lambda x: x != "")
    return F.when(F.size(kept) > 0, kept)


def matches_globs(c, include: list[str], exclude: list[str]) -> Column:
    """Some include glob fits and no exclude glob does; ``*`` crosses slashes."""
    any_of = lambda globs: F.lit(False) if not globs else col(c).rlike("|".join("(?:^" + _java(g) + "$)" for g in globs))
    return any_of(include) & ~any_of(exclude)


def _java(glob: str) -> str:
    return fnmatch.translate(glob).replace("(?s:", "(?:").removesuffix("\\z").removesuffix("\\Z").replace("(?>", "(?:")


def money(c, unknown: str = "n/a") -> Column:
    return F.coalesce(F.concat(F.when(col(c) < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.abs(col(c)), 2)), F.lit(unknown))


def signed_money(c, unknown: str = "unknown") -> Column:
    """With a sign; within half a cent of zero it has none."""
    c = col(c)
    sign = F.when(c >= 0.005, "+").when(c <= -0.005, "-").otherwise("")
    return F.coalesce(F.concat(sign, F.lit("$"), F.format_number(F.abs(c), 2)), F.lit(unknown))


def site_file(c) -> Column:
    return F.substring_index(col(c), "::", 1)


def site_name(c) -> Column:
    """What follows the first ``::``, or all of it."""
    return F.when(F.instr(col(c), "::") > 0, F.regexp_extract(col(c), "(?s)::(.*)$", 1)).otherwise(col(c))


def short_model(c) -> Column:
    return F.substring_index(col(c), ":", -1)
