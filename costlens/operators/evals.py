"""Eval sets: what is wrong with them, repeated and missing parts, grading of outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsonvalues import canonical as sorted_keys
from ..functions.text import allowed_values, clip, expression_fields, graded_fields, normalize_text, placeholders, slug_for, strip_fences
from ..schemas import MIN_CASES
from .callsites import prompt_resolved, prompt_text
from .numbering import numbered


def duplicate_ids(cases: DataFrame) -> DataFrame:
    """Second and later cases of one id in a set."""
    return numbered(cases, ["site_id", "id"], ["line"]).filter("n > 1").drop("n")


def input_diff(cases: DataFrame) -> DataFrame:
    """``cases(wanted, given)`` with the sorted inputs that are missing from, or not in, the prompt."""
    return cases.withColumns({"missing": F.array_sort(F.array_except("wanted", "given")), "extra": F.array_sort(F.array_except("given", "wanted"))})


def expected_problem(typed: bool = False):
    """What is wrong with ``expected`` under ``grading``, by the labels and fields of the contract; null if nothing is. ``typed`` says that ``expected_kind`` tells its JSON type, so that a number is no text."""
    is_a = lambda kind: F.coalesce(F.startswith("expected_kind", F.lit(kind)), F.lit(False)) if typed else F.lit(True)
    blank = F.coalesce(F.trim("expected") == "", F.lit(True)) | ~is_a("STRING")
    return (
        F.when((F.col("grading") == "exact") & blank, "exact grading needs expected to be a non-empty string")
        .when((F.col("grading") == "exact") & F.col("labels").isNotNull() & ~F.array_contains("labels", F.col("expected")), F.concat(F.lit("expected "), F.col("expected"), F.lit(" is not one of "), F.array_join("labels", ", ")))
        .when((F.col("grading") == "json_fields") & ((F.coalesce(F.size(F.json_object_keys("expected")), F.lit(0)) <= 0) | ~is_a("OBJECT")), "json_fields grading needs expected to be a non-empty object")
        .when((F.col("grading") == "judge") & blank, "judge grading needs expected to be a reference answer or rubric string")
    )


def field_problem():
    """What ``expected`` lacks of, or has beyond, the contract's graded ``fields`` under json_fields grading; null if they agree or none are named."""
    keys = F.coalesce(F.json_object_keys("expected"), F.array().cast("array<string>"))
    lacking, beyond = (F.array_sort(F.array_except(a, b)) for a, b in (("fields", keys), (keys, F.col("fields"))))
    parts = F.array_compact(F.array(F.when(F.size(lacking) > 0, F.concat(F.lit("expected lacks graded fields "), F.array_join(lacking, ", "))), F.when(F.size(beyond) > 0, F.concat(F.lit("expected has fields that are not graded: "), F.array_join(beyond, ", ")))))
    return F.when((F.col("grading") == "json_fields") & F.col("fields").isNotNull() & (F.size(parts) > 0), F.array_join(parts, "; "))


def prompt_problems(sites: DataFrame) -> DataFrame:
    """(site_id, problem) of ``sites(id, messages)`` whose prompt is not known whole, or has expressions where eval inputs need plain names."""
    odd = sites.select(F.col("id").alias("site_id"), prompt_resolved().alias("resolved"), expression_fields(prompt_text()).alias("expressions"))
    found = F.array_compact(F.array(F.when(~F.col("resolved"), "prompt is unresolved"), F.when(F.size("expressions") > 0, F.concat(F.lit("prompt has expressions: "), F.array_join("expressions", ", ")))))
    return odd.select("site_id", F.explode(found).alias("problem"))


def generation_skips(sites: DataFrame) -> DataFrame:
    """(site_id, reason): the sites that no cases can be generated for, with the first reason."""
    return prompt_problems(sites).groupBy("site_id").agg(F.max("problem").alias("reason"))  # "prompt is" sorts after "prompt has"


def shared_inputs(shared, names):
    """Of a map of shared inputs, those that the prompt names."""
    return F.map_filter(shared, lambda k, v: F.array_contains(names, k))


def problems(cases: DataFrame) -> DataFrame:
    """(site_id, line, problem) of ``cases(site_id, line, id, grading, site_grading, wanted, given, labels, expected)``; ``fields`` and ``expected_kind`` count where they are there."""
    n = F.row_number().over(Window.partitionBy("site_id", "id").orderBy("line"))
    rows = input_diff(cases.withColumn("n", n))
    found = F.array_compact(
        F.array(
            F.when(F.col("n") > 1, "duplicate id"),
            F.when(F.col("grading") != F.col("site_grading"), F.concat(F.lit("grading "), F.col("grading"), F.lit(" does not match call site grading "), F.col("site_grading"))),
            F.when(F.size("missing") > 0, F.concat(F.lit("inputs missing "), F.array_join("missing", ", "))),
            F.when(F.size("extra") > 0, F.concat(F.lit("inputs not in the prompt: "), F.array_join("extra", ", "))),
            expected_problem("expected_kind" in cases.columns),
            *([field_problem()] if "fields" in cases.columns else []),
        )
    )
    return rows.select("site_id", "line", F.explode(found).alias("problem"))


def few_cases(cases: DataFrame) -> DataFrame:
    """(site_id, warning) of sets under the usual least number of cases."""
    n = cases.groupBy("site_id").agg(F.count("*").alias("n")).filter(F.col("n") < MIN_CASES)
    return n.select("site_id", F.concat(F.lit("only "), F.col("n").cast("string"), F.lit(f" cases (aim for {MIN_CASES} or more)")).alias("warning"))


def coverage(files: DataFrame, sites: DataFrame) -> DataFrame:
    """(slug, state): eval files without a call site are errors, call sites without a file warnings."""
    both = files.select("slug", F.lit(True).alias("file")).distinct().join(sites.select("slug", F.lit(True).alias("site")).distinct(), "slug", "full_outer")
    return both.select("slug", F.when(F.col("site").isNull(), "error").when(F.col("file").isNull(), "warning").otherwise("ok").alias("state"))


def set_report(cases: DataFrame, sites: DataFrame, file_problems: DataFrame) -> DataFrame:
    """All that is wrong or doubtful with eval sets as one relation ``(slug, site_id, line, severity, problem)``; severity is error or warning, ``line`` null where a whole set is meant.

    ``cases(slug, line, id, inputs, expected, expected_kind, grading)`` meet ``sites(id, messages, output_contract, grading)`` by slug. ``file_problems(slug, line, problem)`` are what
    reading the files found. Inputs aren't compared with a prompt that has expressions, as those are reported themselves. Nothing is collected: a set may have any number of cases.
    """
    text = prompt_text()
    known = sites.select(
        F.col("id").alias("site_id"), slug_for("id").alias("slug"), F.col("grading").alias("site_grading"), graded_fields("output_contract").alias("fields"), allowed_values("output_contract").alias("labels"),
        F.coalesce(placeholders(text), F.array().cast("array<string>")).alias("named"), F.coalesce(F.size(expression_fields(text)) > 0, F.lit(False)).alias("odd"),
    )
    ids = known.select("slug", "site_id")
    given = F.map_keys("inputs")
    rows = cases.join(known, "slug").withColumns({"given": given, "wanted": F.when(F.col("odd"), given).otherwise(F.col("named"))})
    held = cases.select("slug").unionByName(file_problems.select("slug")).distinct()
    of_set = lambda found: found.withColumn("line", F.lit(None).cast("bigint"))
    sited = lambda found: found.join(ids, "slug", "left")
    errors = problems(rows).join(ids, "site_id").unionByName(sited(file_problems.select("slug", F.col("line").cast("bigint").alias("line"), "problem")))
    errors = errors.unionByName(of_set(prompt_problems(sites).join(ids, "site_id").join(held, "slug", "left_semi")))
    states = coverage(held, ids.select("slug"))
    errors = errors.unionByName(of_set(sited(states.filter("state = 'error'").select("slug", F.lit("no call site").alias("problem")))))
    few = few_cases(cases.withColumnRenamed("slug", "site_id")).select(F.col("site_id").alias("slug"), F.col("warning").alias("problem"))
    no_fields = known.filter("site_grading = 'json_fields' and fields is null").join(held, "slug", "left_semi").select("slug", F.lit("output_contract names no graded fields").alias("problem"))
    none = states.filter("state = 'warning'").select("slug", F.lit("no eval file").alias("problem"))
    warnings = of_set(sited(few.unionByName(no_fields).unionByName(none)))
    tagged = lambda found, severity: found.select("slug", "site_id", "line", F.lit(severity).alias("severity"), "problem")
    return tagged(errors, "error").unionByName(tagged(warnings, "warning"))


def set_totals(report: DataFrame, cases: DataFrame) -> DataFrame:
    """One row ``(sets, cases, errors, warnings)``."""
    found = report.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return cases.agg(F.count_distinct("slug").alias("sets"), F.count("*").alias("cases")).join(found)


def missing_evals(sites: DataFrame, cases: DataFrame) -> DataFrame:
    """(site_id) of ``sites(site_id, slug)`` that no case of ``cases(slug)`` belongs to."""
    return sites.join(cases.select("slug").distinct(), "slug", "left_anti").select("site_id")


def canonical(inputs: str = "inputs"):
    """A map as JSON with sorted keys, at every depth: values that are JSON objects or arrays are written with theirs sorted and without spaces, other texts as they are."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.transform_values(inputs, lambda _, value: sorted_keys(value))))))


def first_of_equal(generated: DataFrame, key: str) -> DataFrame:
    """The first generated case of each set of inputs."""
    n = F.row_number().over(Window.partitionBy("site_id", key).orderBy("ord"))
    return generated.withColumn("n", n).filter("n = 1").drop("n")


def renumber(cases: DataFrame) -> DataFrame:
    """New ids ``function-NN`` in the order of ``ord``."""
    n = F.col("n").cast("string")
    named = F.concat("function", F.lit("-"), F.lpad(n, F.greatest(F.lit(2), F.length(n)), F.lit("0")))
    return numbered(cases, ["site_id"], ["ord"]).withColumn("id", named).drop("n")


def score_exact(output: str, expected: str):
    """struct(value, passed, detail) of an output against the expected text, both normalised."""
    got, want = normalize_text(output), normalize_text(expected)
    same = F.coalesce(got == want, F.lit(False))
    return F.struct(same.cast("double").alias("value"), same.alias("passed"), F.when(same, "match").otherwise(F.concat(F.lit("expected '"), want, F.lit("', got '"), clip(got), F.lit("'"))).alias("detail"))


def grading_for():
    """How the cases of a call site are graded where nobody said so: by fields for JSON, exactly for a set of labels, else by a judge."""
    return F.coalesce("grading", F.when(F.col("output_format") == "json", "json_fields").when(F.col("labels").isNotNull(), "exact").otherwise("judge"))


def generation_messages():
    """The request for ``missing`` cases of ``rows(messages, wanted, grading, labels, fields, output_contract, missing)``: the prompt, its inputs, and what ``expected`` has to be."""
    rule = (
        F.when(F.col("grading") == "json_fields", F.concat(F.lit("an object"), F.coalesce(F.concat(F.lit(" with the keys "), F.array_join("fields", ", ")), F.lit(""))))
        .when((F.col("grading") == "exact") & F.col("labels").isNotNull(), F.concat(F.lit("one of: "), F.array_join("labels", ", ")))
        .when(F.col("grading") == "exact", "the exact answer as a string")
        .otherwise("a rubric or reference answer as a string")
    )
    user = F.concat(
        F.lit("Prompt of the call:\n"), prompt_text(), F.lit("\n\nContract of its output: "), F.coalesce("output_contract", F.lit("none")), F.lit("\nInputs: "), F.array_join("wanted", ", "),
        F.lit("\nExpected: "), rule, F.lit("\nWrite "), F.col("missing").cast("string"), F.lit(' different cases as a JSON array of {"inputs": {...}, "expected": ...}.'),
    )
    one = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(one("system", F.lit("You write test cases for calls to language models. Answer with JSON alone.")), one("user", user))


def parse_generated(replies: DataFrame, wanted: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(cases, problems) of ``replies(site_id, function, text)``: a JSON array of ``{inputs, expected}``, fences around it allowed.

    A case needs exactly the inputs ``wanted`` (else those of the column ``wanted``) and an expected value, text or JSON; of equal inputs the first counts; ids are numbered anew.
    """
    rows = replies if wanted is None else replies.withColumn("wanted", F.array(*map(F.lit, wanted)).cast("array<string>"))
    array = F.try_parse_json(strip_fences("text")).try_cast("array<variant>")
    parsed = rows.withColumn("items", array)
    rows = parsed.select("site_id", "function", "wanted", F.posexplode("items").alias("ord", "v"))
    rows = rows.select("site_id", "function", "wanted", "ord", F.try_variant_get("v", "$.inputs", "map<string,string>").alias("inputs"), F.try_variant_get("v", "$.expected", "string").alias("expected"))
    whole = F.col("inputs").isNotNull() & (F.size(F.array_except("wanted", F.map_keys("inputs"))) == 0) & (F.size(F.array_except(F.map_keys("inputs"), "wanted")) == 0) & F.col("expected").isNotNull()
    good = rows.filter(F.coalesce(whole, F.lit(False))).select("site_id", "function", "ord", "inputs", "expected")
    cases = renumber(first_of_equal(good.withColumn("key", canonical()), "key"))
    bad = rows.filter(~F.coalesce(whole, F.lit(False))).select("site_id", F.concat(F.lit("case "), (F.col("ord") + 1).cast("string"), F.lit(" has the wrong inputs or no expected value")).alias("problem"))
    none = parsed.filter(F.col("items").isNull()).select("site_id", F.lit("the reply is no JSON array").alias("problem"))
    return cases, bad.unionByName(none)


def ready_sites(sites: DataFrame, set_problems: DataFrame) -> DataFrame:
    """``sites(site_id, slug, has_file)`` with ``skipped``: why a run leaves it out, or null."""
    bad = set_problems.groupBy("site_id").agg(F.count("*").alias("n_problems"))
    return sites.join(bad, "site_id", "left").withColumn("skipped", F.when(~F.col("has_file"), "no eval file").when(F.col("n_problems") > 0, F.concat(F.col("n_problems").cast("string"), F.lit(" problems")))).drop("n_problems")


def select_only(rows: DataFrame, key: str, wanted: list[str]) -> DataFrame:
    """Rows whose key is wanted; a wanted key that no row has is an error."""
    spark = rows.sparkSession
    asked = spark.createDataFrame([(w,) for w in wanted], f"{key} string")
    if unknown := sorted(r[0] for r in asked.join(rows.select(key).distinct(), key, "left_anti").collect()):
        raise ValueError(f"unknown {key}: {', '.join(unknown)}")
    return rows.filter(F.col(key).isin(*wanted))
