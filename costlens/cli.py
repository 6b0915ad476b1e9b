"""Commands: ``python -m costlens.cli COMMAND``. Exit codes: 0 fine, 1 findings or failed calls, 2 bad input."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__, config, render
from .functions.text import allowed_values, graded_fields, placeholders, slug_for
from .functions.text import render as fill
from .operators import callsites as C
from .operators import decide as D
from .operators import evals as E
from .operators import model_calls as MC
from .operators import money as M
from .operators import results as R
from .operators import scan as S
from .schemas import CALL_SITE, Settings
from .session import kept
from .sources import files, gitref

#: Problems of a scan file that a command names before it stops.
SHOWN_PROBLEMS = 20
FIELDS = [f.split()[0] for f in CALL_SITE.replace("array<struct<role:string,content:string,resolved:boolean>>", "x").replace("struct<value:string,source:string,expression:string,env_var:string,defined_in:string>", "x").split(", ")]


def _tree(spark: SparkSession, root: str, s: Settings) -> DataFrame:
    return S.python_files(files.source_tree(spark, os.path.abspath(root)), s.include or ["*.py"], s.exclude)


def scan_tree(spark: SparkSession, root: str, s: Settings) -> DataFrame:
    return S.scan(_tree(spark, root, s))


def scan_ref(spark: SparkSession, repo: str, ref: str, path: str, s: Settings) -> DataFrame:
    gitref.register(spark)
    tree = spark.read.format("gitref").options(repo=repo, ref=ref, path=path).load()
    return S.scan(S.python_files(tree, s.include or ["*.py"], s.exclude))


def write_scan(sites: DataFrame, path: str, totals: DataFrame, warnings: DataFrame, root: str = ".") -> None:
    """One JSON document of a scan, written a call site and a warning at a time: the driver holds one partition of either."""
    shown = [c for c in FIELDS if c in sites.columns]
    rows = S.ordered(sites).select(F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}))
    told = warnings.orderBy("repo", "rel", "line").select(_told())
    count = totals.first().asDict()
    count.pop("warnings")
    head = {"schema_version": 1, "tool": "costlens", "tool_version": __version__, "generated_by": "ast", "root": root, "summary": count}

    def items(lines) -> None:
        for n, line in enumerate(lines):
            file.write(f"{',' if n else ''}\n  {line}")

    with open(path, "w", encoding="utf-8") as file:
        file.write(json.dumps(head, ensure_ascii=False)[:-1] + ',\n"warnings": [')
        items(json.dumps(r[0], ensure_ascii=False) for r in told.toLocalIterator())
        file.write('],\n"call_sites": [')
        items(r[0] for r in rows.toLocalIterator())
        file.write("]}\n")


def _told():
    """A warning of a scan as one text, its file and line first."""
    return F.concat("rel", F.coalesce(F.concat(F.lit(":"), F.col("line").cast("string")), F.lit("")), F.lit(": "), "warning")


def read_scan(spark: SparkSession, path: str) -> DataFrame:
    """The call sites of scan files that have no problems; those with some are bad input, with the first of them told."""
    found = files.scan_problems(spark, path, FIELDS).orderBy("id", "problem").limit(SHOWN_PROBLEMS + 1).collect()
    if found:
        told = [f"{r['id'] or path}: {r['problem']}" for r in found]
        raise ValueError("; ".join(told[:SHOWN_PROBLEMS] + ["and more: see validate"] * (len(told) > SHOWN_PROBLEMS)))
    return files.scan_file(spark, path)


def logged(spark: SparkSession, sites: DataFrame, evals: str, results: str, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(rated, latest) of the sites that have eval cases."""
    cases, _ = files.eval_cases(spark, evals)
    named = sites.select(F.col("id").alias("site_id"), slug_for("id").alias("slug"))
    spine = cases.join(F.broadcast(named), "slug").select("site_id", F.col("id").alias("case_id"), "line")
    log = files.latest_results(spark, results).join(F.broadcast(named), "slug")
    return D.with_cost(R.summarize(spine, D.model_dim(spark, s), log)), log


def command_scan(spark, a, s):
    """Finds the call sites of a source tree; files that can't be read are warnings."""
    facts = S.scan_facts(_tree(spark, a.root, s))
    sites, warnings = kept(S.scan_sites(facts), "scanned"), S.scan_warnings(facts)
    totals = kept(S.scan_totals(facts, sites), "scan-totals")
    write_scan(sites, a.out, totals, warnings, a.root)
    render.show(S.ordered(sites).select("id", "line", F.col("model.value").alias("model"), F.col("model.source").alias("source"), C.prompt_resolved().alias("prompt"), "output_format"))
    n = totals.first()
    print(f"{n['call_sites']} call sites in {n['files_scanned']} files, models resolved {n['models_resolved']}/{n['call_sites']}, prompts resolved {n['prompts_resolved']}/{n['call_sites']}")
    for r in warnings.orderBy("repo", "rel", "line").select(_told()).toLocalIterator():
        print(f"warning: {r[0]}", file=sys.stderr)
    return 0


def command_validate(spark, a, s):
    """Prints the problems of scan files, else what shows an unfinished audit, one partition at a time."""
    problems = kept(files.scan_problems(spark, a.scan, FIELDS), "scan-problems")
    for r in problems.orderBy("id", "problem").toLocalIterator():
        print(f"error: {r['id'] or a.scan}: {r['problem']}")
    if not problems.isEmpty():
        return 1
    by = a.generated_by or files.scan_heads(spark, a.scan).first()["generated_by"]
    warnings = kept(C.lint(files.scan_file(spark, a.scan), by), "scan-lint")
    for r in warnings.orderBy("id", "warning").toLocalIterator():
        print(f"warning: {r['id'] or 'scan'}: {r['warning']}")
    return int(a.strict and not warnings.isEmpty())


def command_compare(spark, a, s):
    before, after = read_scan(spark, a.before), read_scan(spark, a.after)
    C.compare_metrics(before, after).orderBy("metric").show(truncate=False)
    render.show(C.compare(before, after).orderBy("id"))
    return 0


def command_check_evals(spark, a, s):
    """Prints what is wrong with the eval sets, errors first, and the totals; rows come to the driver one partition at a time."""
    cases, problems = files.eval_cases(spark, a.evals)
    report = kept(E.set_report(cases, read_scan(spark, a.scan), problems), "set-report")
    for r in report.orderBy("severity", "slug", F.col("line").asc_nulls_first(), "problem").toLocalIterator():
        print(f"{r['severity']}: {r['slug']}{'' if r['line'] is None else ' line ' + str(r['line'])}: {r['problem']}")
    n = E.set_totals(report, cases).first()
    print(f"{n['sets']} sets, {n['cases']} cases, {n['errors']} errors, {n['warnings']} warnings")
    return int(bool(n["errors"] or a.strict and n["warnings"]))


def _clients(s: Settings, client, judge):
    """Factories of the client and of the judge's, which has an endpoint and a key of its own if the settings name them, and waits out rate limits longer."""
    make = client or (lambda url=s.base_url, key=s.api_key_env: MC.ChatClient(url, key))
    make_judge = judge or client or (lambda url=s.judge_url or s.base_url, key=s.judge_key_env or s.api_key_env: MC.ChatClient(url, key, retries=8))
    return make, make_judge


def _cases(spark, a, s: Settings) -> DataFrame:
    """The eval cases of the asked call sites with their filled-in prompt; sites whose set has problems are named and left out."""
    sites = read_scan(spark, a.scan)
    if a.site:
        sites = E.select_only(sites, "id", a.site)
    cases, problems = files.eval_cases(spark, a.evals)
    known = sites.select(F.col("id").alias("site_id"), slug_for("id").alias("slug"))
    has = cases.select("slug").unionByName(problems.select("slug")).distinct().withColumn("has_file", F.lit(True))
    errors = E.set_report(cases, sites, problems).filter("severity = 'error' and site_id is not null").select("site_id", "problem")
    ready = kept(E.ready_sites(known.join(has, "slug", "left").fillna(False, "has_file"), errors), "ready-sites")
    for r in ready.filter("skipped is not null").orderBy("site_id").toLocalIterator():
        print(f"skipped: {r['site_id']}: {r['skipped']}", file=sys.stderr)
    prompts = sites.select(F.col("id").alias("site_id"), F.col("messages").alias("prompt"), F.coalesce("temperature", F.lit(0.0)).alias("temperature"), "max_tokens", (F.col("output_format") == "json").alias("json_mode"), graded_fields("output_contract").alias("fields"), placeholders(C.prompt_text()).alias("names"))
    spine = cases.join(ready.filter("skipped is null").select("site_id", "slug"), "slug")
    if a.limit is not None:
        spine = R.first_cases(spine, int(a.limit))
    filled = F.transform("prompt", lambda m: F.struct(m["role"].alias("role"), fill(m["content"], "names", "inputs").alias("content")))
    return spine.join(prompts, "site_id").withColumnRenamed("id", "case_id").withColumn("messages", filled).drop("names")


def _has_log(path: str) -> bool:
    return os.path.isdir(path) and bool(os.listdir(path))


def command_run(spark, a, s, client=None, judge=None):
    """Calls the models on the cases without an ok row, and appends graded rows to the log."""
    make, make_judge = _clients(s, client, judge)
    asked = s.models if not a.model else a.model
    if unknown := sorted(set(asked) - set(s.models)):
        raise ValueError(f"unknown model: {', '.join(unknown)}")
    failed = MC.warm_up(asked, make())
    models = [m for m in asked if m not in failed]
    for m, why in failed.items():
        print(f"error: {m}: {why}", file=sys.stderr)
    cases = _cases(spark, a, s)
    todo, number = cases.crossJoin(F.broadcast(spark.createDataFrame([(m,) for m in models], "model string"))), 1
    if _has_log(a.results):
        done = files.latest_results(spark, a.results).filter(R.is_ok()).select("slug", "model", "case_id")
        todo, number = todo.join(done, ["slug", "model", "case_id"], "left_anti"), files.last_run(spark, a.results) + 1
    columns = ["site_id", "model", "case_id", "messages", "expected", "grading", "fields", "json_mode", "temperature", "max_tokens"]
    files.append_results(MC.run_cases(todo.select(*columns), make, s.judge, make_judge), a.results, number)
    spine = cases.select("site_id", "case_id", "slug")
    log = files.latest_results(spark, a.results).join(F.broadcast(spine.select("site_id", "slug").distinct()), "slug") if _has_log(a.results) else None
    errors = 0
    if log is not None:
        table = R.summarize(spine.drop("slug"), D.model_dim(spark, s), log)
        render.show(table.select("site_id", "model", render.passed_of("passed", "scored").alias("passed"), "errors", "cases").orderBy("site_id", "model"))
        errors = table.agg(F.sum("errors")).first()[0] or 0
    return int(bool(failed or errors))


def command_rescore(spark, a, s, client=None, judge=None):
    """Grades saved outputs of judge-graded cases anew with the settings' judge, and appends the rows."""
    _, make_judge = _clients(s, client, judge)
    cases = _cases(spark, a, s)
    slugs = cases.select("site_id", "slug").distinct()
    latest = files.latest_results(spark, a.results).join(F.broadcast(slugs), "slug")
    if a.model:
        latest = E.select_only(latest, "model", a.model)
    spine = cases.filter("grading = 'judge'").select("site_id", "case_id")
    number = files.last_run(spark, a.results) + 1
    files.append_results(MC.rescore(latest, cases, s.judge, make_judge), a.results, number)
    after = files.result_log(spark, a.results).filter(F.col("seq.run") == number).join(F.broadcast(slugs), "slug")
    table = MC.before_and_after(spine, D.model_dim(spark, s), latest, R.last_wins(after, ["site_id", "model", "case_id"]))
    render.show(table.select("site_id", "model", *(render.passed_of(f"{c}.passed", f"{c}.scored").alias(c) for c in ("before", "after"))).orderBy("site_id", "model"))
    return int(not after.filter("error is not null").isEmpty())


def command_evalgen(spark, a, s, client=None, judge=None):
    """Has a model write eval cases for call sites that have none yet."""
    make, _ = _clients(s, client, judge)
    sites = read_scan(spark, a.scan)
    if a.site:
        sites = E.select_only(sites, "id", a.site)
    skipped = E.generation_skips(sites)
    for r in skipped.orderBy("site_id").toLocalIterator():
        print(f"skipped: {r['site_id']}: {r['reason']}", file=sys.stderr)
    names = placeholders(C.prompt_text())
    rows = sites.join(skipped, sites["id"] == skipped["site_id"], "left_anti").withColumns({"labels": allowed_values("output_contract"), "fields": graded_fields("output_contract")})
    rows = rows.select(F.col("id").alias("site_id"), F.element_at(F.split("function", r"\."), -1).alias("function"), "messages", names.alias("wanted"), E.grading_for().alias("grading"), "labels", "fields", "output_contract")
    cases, problems = MC.generate(rows, a.model[0] if a.model else s.baseline, make, int(a.cases), f"{a.out}/_rounds")
    for r in problems.orderBy("site_id").toLocalIterator():
        print(f"error: {r['site_id']}: {r['problem']}", file=sys.stderr)
    made = cases.join(rows.select("site_id", "grading"), "site_id").withColumn("line", F.col("ord"))
    for r in rows.select("site_id", slug_for("site_id").alias("slug")).toLocalIterator():  # as many as call sites
        files.write_eval_set(made.filter(F.col("site_id") == r["site_id"]), f"{a.out}/{r['slug']}.jsonl")
    short = rows.join(cases.groupBy("site_id").count().filter(F.col("count") >= int(a.cases)), "site_id", "left_anti")
    return int(not short.isEmpty())


def command_report(spark, a, s):
    sites = read_scan(spark, a.scan)
    rated, log = logged(spark, sites, a.evals, a.results, s)
    without = E.missing_evals(sites.select(F.col("id").alias("site_id"), slug_for("id").alias("slug")), files.eval_cases(spark, a.evals)[0])
    with open(a.out, "w", encoding="utf-8") as file:
        file.writelines(line + "\n" for line in render.report_lines(rated, log, s, without))
    return 0


def command_export(spark, a, s):
    sites = read_scan(spark, a.scan)
    rated, log = logged(spark, sites, a.evals, a.results, s)
    known = files.eval_cases(spark, a.evals)[0].withColumnRenamed("id", "case_id").join(F.broadcast(sites.select(F.col("id").alias("site_id"), slug_for("id").alias("slug"))), "slug")
    decisions = D.decide(rated, s)
    render.write_payloads(render.site_payload(rated, decisions, M.site_costs(decisions, rated, s)), os.path.join(a.out, "callsites"))
    render.write_payloads(render.grid_payload(known, log, s.models), os.path.join(a.out, "evals"))
    render.write_payloads(render.examples_payload(known, log, s.models, a.examples), os.path.join(a.out, "examples"))
    render.write_payloads(render.summary_payload(rated, log, known, s), os.path.join(a.out, "summary"))
    return 0


def command_audit(spark, a, s):
    """Sets an audit beside the scan before it and the one after it, where they are given: figures on the console, all of it as documents."""
    optional = lambda path: None if path is None else read_scan(spark, path)
    audit, ast, after = read_scan(spark, a.audit), optional(a.ast), optional(a.ast_after)
    render.show(C.metrics_over(render.audit_scans(audit, ast, after)).orderBy("metric"))
    render.write_payloads(render.audit_payload(audit, ast, after), a.out)
    return 0


def _diffed(diffs: DataFrame, a) -> int:
    print(render.diff_report(diffs))
    return int(a.fail_above is not None and C.fails_above(C.diff_totals(diffs), a.fail_above))


def command_estimate(spark, a, s):
    return _diffed(C.diff(C.estimate(read_scan(spark, a.before), s), C.estimate(read_scan(spark, a.after), s)), a)


def command_diff(spark, a, s):
    side = lambda ref: C.estimate(scan_ref(spark, a.repo, ref, a.path, s), s)
    return _diffed(C.diff(side(a.base), side(a.head)), a)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="costlens", description="Call-cost analytics on Spark")
    top.add_argument("--config")
    top.add_argument("--version", action="version", version=f"costlens {__version__}")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, *positional: str, **options):
        p = sub.add_parser(name)
        for x in positional:
            p.add_argument(x)
        for x, default in options.items():
            flag = f"--{x.replace('_', '-')}"
            if default is False:
                p.add_argument(flag, action="store_true")
            else:
                p.add_argument(flag, default=default, type=float if x == "fail_above" else int if x in ("limit", "cases", "examples") else str, action="append" if x in ("site", "model") else "store")

    add("scan", "root", out="scan.json")
    add("validate", "scan", strict=False, generated_by=None)
    add("compare", "before", "after")
    add("check-evals", "scan", "evals", strict=False)
    chosen = {"site": None, "model": None, "limit": None}
    add("run", "scan", "evals", "results", **chosen)
    add("rescore", "scan", "evals", "results", **chosen)
    add("evalgen", "scan", out="evals", cases=25, site=None, model=None)
    add("report", "scan", "evals", "results", out="report.md")
    add("export", "scan", "evals", "results", out="export", examples=5)
    add("audit", "audit", ast=None, ast_after=None, out="audit")
    add("estimate", "before", "after", fail_above=None)
    add("diff", "base", "head", repo=".", path="", fail_above=None)
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None, **more) -> int:
    a = parser().parse_args(args)
    try:
        found = config.find(a.config, ".")
        s = config.load(found) if found else Settings(baseline="", candidates=[], prices={}, include=["*.py"])
        spark = spark or SparkSession.builder.appName("costlens").getOrCreate()
        return globals()[f"command_{a.command.replace('-', '_')}"](spark, a, s, **more)
    except (OSError, ValueError) as problem:
        print(problem, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
