"""Reports and payloads: Markdown line by line, its rows sorted in Spark; documents as JSON columns in Spark."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import money, signed_money, slug_for
from .operators import callsites as C
from .operators import decide as D
from .operators import money as M
from .operators.results import first_cases
from .schemas import Settings


def usd(x: float | None, unknown: str = "n/a") -> str:
    return unknown if x is None else f"{'-' if x < 0 else ''}${abs(x):,.2f}"


def share(x: float | None) -> str:
    return "n/a" if x is None else f"{x * 100:.1f}%"


def table(head: list[str], rows: Iterable[list]) -> Iterator[str]:
    line = lambda cells: "| " + " | ".join("-" if c is None else str(c).replace("|", "\\|") for c in cells) + " |"
    yield from (line(head), line(["---"] * len(head)))
    yield from map(line, rows)


def passed_of(passed: str, scored: str):
    """``passed/scored (per cent)``, or - without a scored row."""
    p, n = F.col(passed), F.col(scored)
    return F.when(n > 0, F.concat(p.cast("string"), F.lit("/"), n.cast("string"), F.lit(" ("), D.percent(F.try_divide(p, n)), F.lit(")"))).otherwise("-")


def show(rows: DataFrame) -> None:
    """Prints every row."""
    for line in table(rows.columns, rows.toLocalIterator()):
        print(line)


def report(rated: DataFrame, latest: DataFrame, settings: Settings) -> str:
    return "\n".join(report_lines(rated, latest, settings)) + "\n"


def report_lines(rated: DataFrame, latest: DataFrame, settings: Settings, without: DataFrame | None = None) -> Iterator[str]:
    """The Markdown report of a log: what changes, what it saves, what the analysis cost, what needs a look, with the call sites ``without(site_id)`` eval cases.

    Counts come from aggregates; the driver takes one partition of the rows at a time.
    """
    decisions = D.decide(rated, settings)
    costs = M.site_costs(decisions, rated, settings)
    checks = D.check_candidates(rated, settings)
    total = M.summary(costs).first()
    spent = M.analysis_cost(latest, settings).first()
    back = costs.sparkSession.createDataFrame([(spent["total"], total["savings"])], "total double, savings double").select(M.payback_hours().alias("hours")).select(M.payback_label().alias("label")).first()[0]
    n, down = decisions.agg(F.count("*"), F.count_if(F.col("action") == "downgrade")).first()
    yield from ["# Model cost report", "", f"- Cost now: {usd(total['before'])} a month", f"- Cost after: {usd(total['after'])} a month", f"- Savings: {usd(total['savings'])} ({'n/a' if total['savings_pct'] is None else f'{total['savings_pct']:.1f}%'})", f"- Call sites that change: {down} of {n}"]
    yield from ["", "## Cost of the analysis", "", *table(["part", "calls", "cost"], [["model calls", spent["model_calls"], usd(spent["model_cost"])], [f"judge calls ({spent['judge_model'] or 'none'})", spent["judge_calls"], usd(spent["judge_cost"])], ["total", None, usd(spent["total"])]]), "", f"Paid back after: {back}"]
    priced = decisions.select("site_id", "action", "model", "reason").join(costs.select("site_id", "before_month", "after_month"), "site_id", "left").orderBy("site_id")
    yield from ["", "## Decisions", ""]
    yield from table(["call site", "action", "model", "before", "after", "why"], ([r["site_id"], r["action"], r["model"], usd(r["before_month"]), usd(r["after_month"]), r["reason"]] for r in priced.toLocalIterator()))
    quality = rated.groupBy("site_id").pivot("model", settings.models).agg(F.first("pass_rate")).orderBy("site_id")
    yield from ["", "## Quality", ""]
    yield from table(["call site", *settings.models], ([r["site_id"], *(share(r[m]) for m in settings.models)] for r in quality.toLocalIterator()))
    yield from ["", "## Needs a look", ""]
    some = False
    for r in D.near_misses(checks, settings).orderBy("site_id", "ord").toLocalIterator():
        some = True
        yield f"- {r['site_id']}: {r['model']} keeps {share(r['ratio'])} of baseline quality, just under the threshold"
    for r in decisions.filter("baseline_below_floor").orderBy("site_id").toLocalIterator():
        some = True
        yield f"- {r['site_id']}: the baseline passes {share(r['baseline_pass_rate'])}, below the floor"
    for r in D.missing_data(rated, settings).orderBy("site_id").toLocalIterator():
        some = True
        yield f"- {r['site_id']}: the baseline has {r['scored']} of {r['cases']} cases scored"
    for r in without.orderBy("site_id").toLocalIterator() if without is not None else ():
        some = True
        yield f"- {r['site_id']}: no eval cases"
    if not some:
        yield "Nothing."


def diff_report(diffs: DataFrame) -> str:
    """The Markdown of a comparison, in its order, with marks for what is assumed."""
    total = C.diff_totals(diffs).first()
    rows = C.ordered(diffs.filter("status <> 'unchanged'")).withColumns({"shown": signed_money("delta"), "was": money("before", "unknown"), "is": money("after", "unknown")}).toLocalIterator()
    marks = lambda r: ("†" if r["model_assumed"] else "") + ("‡" if r["completion_assumed"] else "") + ("§" if r["prompt_partial"] else "")
    out = ["## Cost of this change", "", f"{usd(total['before'])} -> {usd(total['after'])} a month", ""]
    if not total["has_changes"]:
        return "\n".join([*out, "No call site changes."]) + "\n"
    out += table(["call site", "change", "before", "after", "difference", "why"], [[r["id"] + marks(r), r["status"], r["was"], r["is"], r["shown"], "; ".join(r["reasons"])] for r in rows])
    return "\n".join([*out, "", "† model assumed, ‡ output length assumed, § part of the prompt unknown", f"{total['n_unknown']} without a price."]) + "\n"


def site_payload(rated: DataFrame, decisions: DataFrame, costs: DataFrame) -> DataFrame:
    """``(site_id, slug, doc)``: a JSON document for each call site, its models in order."""
    entry = F.struct("ord", "model", "cases", "scored", "passed", "errors", "pass_rate", "avg_latency_s", "avg_prompt_tokens", "avg_completion_tokens", "cost_per_call")
    models = rated.groupBy("site_id").agg(F.array_sort(F.collect_list(entry)).alias("models"))
    rows = decisions.join(models, "site_id").join(costs.select("site_id", "before_month", "after_month", "savings", "savings_pct"), "site_id")
    doc = F.struct("site_id", F.struct("action", "model", "baseline", "reason", "baseline_pass_rate", "baseline_below_floor").alias("decision"), F.struct("before_month", "after_month", "savings", "savings_pct").alias("cost"), "models")
    return rows.select("site_id", slug_for("site_id").alias("slug"), F.to_json(doc, {"ignoreNullFields": "false"}).alias("doc"))


def summary_payload(rated: DataFrame, latest: DataFrame, cases: DataFrame, settings: Settings) -> DataFrame:
    """``(doc)``: one JSON document of the whole project, with its settings and what the analysis cost."""
    decisions = D.decide(rated, settings)
    figures = M.project_summary(decisions, M.site_costs(decisions, rated, settings), cases, latest)
    spent = M.analysis_cost(latest, settings).select(F.struct("model_calls", "model_cost", "judge_calls", "judge_cost", "judge_model", "total").alias("analysis"))
    chosen = F.struct(F.lit(settings.baseline).alias("baseline"), F.array(*map(F.lit, settings.candidates)).cast("array<string>").alias("candidates"), F.lit(settings.threshold).alias("quality_threshold"), F.lit(settings.floor).alias("min_pass_rate"))
    rows = figures.crossJoin(F.broadcast(spent))  # one row each
    return rows.select(F.to_json(F.struct(chosen.alias("settings"), *figures.columns, "analysis"), {"ignoreNullFields": "false"}).alias("doc"))


#: What an example tells of a model's last output.
OUTPUT_FIELDS = ["output", "passed", "score", "judge_score", "detail", "error"]


def _by_model(cases: DataFrame, latest: DataFrame, entry, models: list[str]) -> DataFrame:
    """``cases`` with ``of``: a struct of every configured model and its last row as ``entry``, null where it has none. The log is cut to these models and gathered by case: a few rows each."""
    rows = latest.filter(F.col("model").isin(*models)).groupBy("site_id", "case_id").agg(F.map_from_entries(F.collect_list(F.struct("model", entry))).alias("_held"))
    whole = F.struct(*(F.try_element_at("_held", F.lit(m)).alias(m) for m in models))
    return cases.join(rows, ["site_id", "case_id"], "left").withColumn("of", whole).drop("_held")


def grid_payload(cases: DataFrame, latest: DataFrame, models: list[str]) -> DataFrame:
    """``(site_id, line, doc)``: for each of ``cases(site_id, case_id, line)`` a document with what every model made of it; a site may have any number of cases, so each is a row."""
    rows = _by_model(cases.select("site_id", "case_id", "line"), latest, F.col("passed"), models)
    return rows.select("site_id", "line", F.to_json(F.struct("site_id", F.col("case_id").alias("id"), F.col("of").alias("passed")), {"ignoreNullFields": "false"}).alias("doc"))


def examples_payload(cases: DataFrame, latest: DataFrame, models: list[str], n: int) -> DataFrame:
    """``(site_id, slug, doc)``: a document for each site with its number of ``cases(site_id, case_id, line, inputs, expected, notes)``, and the first ``n`` of them as examples: what every model last answered, and null where one didn't."""
    first = first_cases(cases, n)
    held = latest.join(first.select("site_id", "case_id"), ["site_id", "case_id"], "left_semi")
    shown = _by_model(first, held, F.struct(*(F.round(c, 4).alias(c) if c == "score" else F.col(c) for c in OUTPUT_FIELDS)), models)
    entry = F.struct("line", F.col("case_id").alias("id"), "inputs", "expected", "notes", F.col("of").alias("outputs"))
    place = lambda x: F.struct(x["line"], x["id"])
    in_order = lambda x, y: F.when(place(x) < place(y), -1).when(place(x) > place(y), 1).otherwise(0)  # noqa: E731 - maps have no order of their own
    examples = shown.groupBy("site_id").agg(F.array_sort(F.collect_list(entry), in_order).alias("examples"))  # n of a site at most
    sizes = cases.groupBy("site_id").agg(F.count("*").alias("cases"))
    doc = F.struct("site_id", slug_for("site_id").alias("slug"), "cases", F.array(*map(F.lit, models)).alias("models"), "examples")
    rows = sizes.join(examples, "site_id", "left")
    return rows.select("site_id", slug_for("site_id").alias("slug"), F.to_json(doc, {"ignoreNullFields": "false"}).alias("doc"))


#: What a figure of a scan is called where it is shown.
METRIC_LABELS = {"call_sites": "Call sites", "models_resolved": "Models known", "prompts_resolved": "Prompts known", "enriched": "Described in full", "found_by_auditor": "Found by the auditor", "via_helper": "Behind a helper"}


def audit_scans(audit: DataFrame, ast: DataFrame | None = None, ast_after: DataFrame | None = None) -> dict[str, DataFrame]:
    """The scans that there are, by name, in the order they were made."""
    return {n: s for n, s in (("ast", ast), ("audit", audit), ("ast_after", ast_after)) if s is not None}


def audit_payload(audit: DataFrame, ast: DataFrame | None = None, ast_after: DataFrame | None = None) -> DataFrame:
    """``(part, key, doc)``: the audit as JSON documents, one for each figure (``metric``), call site of any scan (``site``) and, with ``ast``, change from it (``change``); a scan that wasn't given is null."""
    scans = audit_scans(audit, ast, ast_after)
    absent = [n for n in ("ast", "audit", "ast_after") if n not in scans]
    to_doc = lambda *columns: F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("doc")
    none = [F.lit(None).cast("string").alias(n) for n in absent]
    label = F.create_map(*(F.lit(x) for pair in METRIC_LABELS.items() for x in pair))[F.col("metric")].alias("label")
    out = C.metrics_over(scans).select(F.lit("metric").alias("part"), F.col("metric").alias("key"), to_doc("metric", label, *scans, *none))
    sites = C.fates(C.presence(scans), list(scans))
    out = out.unionByName(sites.select(F.lit("site").alias("part"), F.col("id").alias("key"), to_doc("id", "fate", *scans, *none)))
    if ast is not None:
        changes = C.compare(ast, audit)
        out = out.unionByName(changes.select(F.lit("change").alias("part"), F.col("id").alias("key"), to_doc("id", F.col("change").alias("kind"), "detail")))
    return out


def write_payloads(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").json(path)
