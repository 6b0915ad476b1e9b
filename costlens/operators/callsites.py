"""Call sites: static estimates, comparison of two versions, audit lint and scan metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import expression_fields, word_count
from ..schemas import DAYS_PER_MONTH, DEFAULT_COMPLETION_TOKENS, ENRICHMENT, Settings
from .money import volume_of
from .numbering import numbered

#: Order of a comparison's rows.
STATUSES = ["added", "changed", "removed", "unchanged"]


def prompt_resolved():
    """Messages are known and all resolved; no messages at all are."""
    return F.coalesce(F.forall("messages", lambda m: m["resolved"]), F.lit(False))


def prompt_text(messages: str = "messages"):
    """All messages of a prompt as one text, in their order; empty without messages."""
    return F.coalesce(F.array_join(F.transform(messages, lambda m: F.coalesce(m["content"], F.lit(""))), "\n"), F.lit(""))


def prompt_estimate():
    """struct(tokens, partial): words of the resolved messages; partial if some aren't, or there are none."""
    tokens = F.aggregate(F.filter("messages", lambda m: m["resolved"]), F.lit(0).cast("bigint"), lambda a, m: a + word_count(F.coalesce(m["content"], F.lit(""))))
    empty = F.coalesce(F.size("messages"), F.lit(0)) <= 0
    return F.struct(F.coalesce(tokens, F.lit(0)).alias("tokens"), (empty | F.exists("messages", lambda m: ~m["resolved"])).alias("partial"))


def estimate(sites: DataFrame, settings: Settings, days: int = DAYS_PER_MONTH) -> DataFrame:
    """A static monthly estimate of each call site; unknown models cost as the baseline, unknown output as the default, unpriced models null."""
    found = F.nullif(F.col("model.value"), F.lit(""))
    prices = sites.sparkSession.createDataFrame([(m, *p) for m, p in settings.prices.items()], "model string, price_in double, price_out double")
    rows = sites.select(
        "id",
        F.coalesce(found, F.lit(settings.baseline)).alias("model"),
        found.isNull().alias("model_assumed"),
        prompt_estimate().alias("p"),
        F.coalesce("max_tokens", F.lit(DEFAULT_COMPLETION_TOKENS)).cast("bigint").alias("completion_tokens"),
        F.col("max_tokens").isNull().alias("completion_assumed"),
        volume_of("id", settings).alias("calls_per_day"),
    )
    rows = rows.join(F.broadcast(prices), "model", "left")
    per_call = (F.col("p.tokens") * F.col("price_in") + F.col("completion_tokens") * F.col("price_out")) / 1e6
    rows = rows.withColumn("per_call", per_call)
    return rows.select("id", "model", "model_assumed", F.col("p.tokens").alias("prompt_tokens"), F.col("p.partial").alias("prompt_partial"), "completion_tokens", "completion_assumed", "calls_per_day", "per_call", (F.col("per_call") * F.col("calls_per_day") * days).alias("monthly"))


def diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """Two estimates side by side: status, the reasons of a change in order, money before and after; money of an unpriced side is unknown."""
    side = lambda df, s: df.select("id", F.struct(*[c for c in df.columns if c != "id"]).alias(s))
    rows = side(base, "b").join(side(head, "h"), "id", "full_outer")
    label = lambda s: F.concat(F.col(f"{s}.model"), F.when(F.col(f"{s}.model_assumed"), "†").otherwise(""))
    moved = lambda c: F.col(f"b.{c}") != F.col(f"h.{c}")
    text = lambda c: F.col(c).cast("string")
    reasons = F.array_compact(
        F.array(
            F.when(moved("model") | moved("model_assumed"), F.concat(F.lit("model "), label("b"), F.lit(" -> "), label("h"))),
            F.when(moved("prompt_tokens"), F.concat(F.lit("prompt ~"), text("b.prompt_tokens"), F.lit(" -> ~"), text("h.prompt_tokens"), F.lit(" tokens"))),
            F.when(moved("completion_tokens"), F.concat(F.lit("max output "), text("b.completion_tokens"), F.lit(" -> "), text("h.completion_tokens"), F.lit(" tokens"))),
            F.when(moved("calls_per_day"), F.concat(F.lit("calls/day "), F.format_number("b.calls_per_day", 0), F.lit(" -> "), F.format_number("h.calls_per_day", 0))),
        )
    )
    status = F.when(F.col("b").isNull(), "added").when(F.col("h").isNull(), "removed").when(F.size(reasons) > 0, "changed").otherwise("unchanged")
    known = F.when(F.col("b").isNotNull(), F.col("b.per_call").isNotNull()).otherwise(True) & F.when(F.col("h").isNotNull(), F.col("h.per_call").isNotNull()).otherwise(True)
    money = lambda s: F.when(F.col(s).isNull(), 0.0).otherwise(F.coalesce(F.col(f"{s}.monthly"), F.lit(0.0)))
    rows = rows.withColumns({"status": status, "reasons": F.when((status == "changed"), reasons).otherwise(F.array().cast("array<string>")), "known": known, "before": money("b"), "after": money("h")})
    mark = lambda c: F.coalesce(F.col(f"b.{c}"), F.lit(False)) | F.coalesce(F.col(f"h.{c}"), F.lit(False))
    rows = rows.withColumns({c: mark(c) for c in ("model_assumed", "completion_assumed", "prompt_partial")})
    return rows.withColumn("delta", F.when(F.col("known"), F.col("after") - F.col("before"))).drop("b", "h")


def ordered(diffs: DataFrame) -> DataFrame:
    """Added first, then changed, removed and unchanged; by id inside."""
    return diffs.orderBy(F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status")), "id")


def diff_totals(diffs: DataFrame) -> DataFrame:
    """One row: money of the rows whose costs are known, its change, and counts of each status."""
    known = F.col("known")
    out = diffs.agg(
        F.coalesce(F.sum(F.when(known, F.col("before"))), F.lit(0.0)).alias("before"),
        F.coalesce(F.sum(F.when(known, F.col("after"))), F.lit(0.0)).alias("after"),
        F.count_if(~known).alias("n_unknown"),
        *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES),
    )
    out = out.withColumn("delta", F.col("after") - F.col("before"))
    return out.withColumns({"delta_pct": F.try_divide("delta", F.when(F.col("before") > 0, F.col("before"))) * 100, "has_changes": F.col("n_added") + F.col("n_changed") + F.col("n_removed") > 0})


def fails_above(totals: DataFrame, limit: float) -> bool:
    """Does the monthly change exceed the limit?"""
    return bool(totals.select(F.col("delta") > limit).first()[0])


def enriched():
    return F.array_size(F.array_compact(F.array(*ENRICHMENT))) == len(ENRICHMENT)


def metrics(sites: DataFrame, auditor: str = "auditor") -> DataFrame:
    """(metric, value): sites, resolved models and prompts, enriched, found by the auditor, via a helper."""
    row = sites.agg(
        F.count("*").alias("call_sites"),
        F.count_if(F.col("model.value").isNotNull()).alias("models_resolved"),
        F.count_if(prompt_resolved()).alias("prompts_resolved"),
        F.count_if(enriched()).alias("enriched"),
        F.count_if(F.col("found_by") == auditor).alias("found_by_auditor"),
        F.count_if(F.col("via").isNotNull()).alias("via_helper"),
    )
    return row.unpivot([], row.columns, "metric", "value")


def compare_metrics(before: DataFrame, after: DataFrame) -> DataFrame:
    return metrics(before).withColumnRenamed("value", "before").join(metrics(after).withColumnRenamed("value", "after"), "metric")


def metrics_over(scans: dict[str, DataFrame]) -> DataFrame:
    """(metric, and a column for each of the named scans): a scan's figures are a row of counts, so all of them are."""
    tagged = [metrics(sites).withColumn("scan", F.lit(name)) for name, sites in scans.items()]
    return reduce(DataFrame.unionByName, tagged).groupBy("metric").pivot("scan", list(scans)).agg(F.first("value"))


def presence(scans: dict[str, DataFrame]) -> DataFrame:
    """(id, a struct for each of the named scans): every call site of any scan with what each says of it, null where it doesn't list it. One shuffle by id, whatever the number of scans."""
    brief = F.struct("found_by", "via", F.col("model.value").alias("model"), F.col("model.source").alias("model_source"), prompt_resolved().alias("prompt_resolved"))
    tagged = [sites.select("id", F.lit(name).alias("scan"), brief.alias("brief")) for name, sites in scans.items()]
    return reduce(DataFrame.unionByName, tagged).groupBy("id").pivot("scan", list(scans)).agg(F.first("brief"))


def fates(held: DataFrame, scans: list[str]) -> DataFrame:
    """:func:`presence` with ``fate``, how a call site fares over the scans in their order: kept in all, gone after the first ones, new in the last ones, passing in between, or back after it was missing."""
    there = F.array(*(F.col(s).isNotNull() for s in scans))
    first, last = F.array_position(there, True), F.size(there) - F.array_position(F.reverse(there), True) + 1
    whole = F.size(F.filter(there, lambda x: x)) == last - first + 1
    return held.withColumn("fate", F.when(~whole, "back").when((first == 1) & (last == len(scans)), "kept").when(first == 1, "gone").when(last == len(scans), "new").otherwise("passing"))


def compare(ast: DataFrame, audit: DataFrame) -> DataFrame:
    """(id, change, detail) for each call site of either scan: split, removed, added, resolved, changed, enriched or unchanged."""
    children = audit.filter(F.col("via").isNotNull()).groupBy(F.col("via").alias("id")).agg(F.array_sort(F.collect_list("id")).alias("children"))
    gone = ast.select("id").join(audit.select("id"), "id", "left_anti").join(children, "id", "left")
    gone = gone.select("id", F.when(F.col("children").isNotNull(), "split").otherwise("removed").alias("change"), F.coalesce(F.concat(F.lit("into "), F.array_join("children", ", ")), F.lit("not in the audit")).alias("detail"))
    facts = lambda df, s: df.select("id", F.struct(F.col("model.value").alias("model"), prompt_resolved().alias("resolved"), enriched().alias("enriched"), "via").alias(s))
    rows = facts(audit, "a").join(facts(ast, "b"), "id", "left")
    moved = ~F.col("a.model").eqNullSafe(F.col("b.model"))
    model = F.when(moved & F.col("b.model").isNotNull(), F.concat(F.lit("model "), "b.model", F.lit(" -> "), F.coalesce("a.model", F.lit("None")))).when(moved, F.concat(F.lit("model resolved: "), F.col("a.model")))
    prompt = F.when(F.col("a.resolved") & ~F.col("b.resolved"), "prompt resolved")
    parts = F.array_compact(F.array(model, prompt))
    gap = (moved & F.col("b.model").isNull()) | (F.col("a.resolved") & ~F.col("b.resolved"))
    new = F.col("b").isNull()
    fresh = F.col("a.enriched") & ~F.col("b.enriched")
    change = F.when(new, "added").when(F.size(parts) > 0, F.when(gap, "resolved").otherwise("changed")).when(fresh, "enriched").otherwise("unchanged")
    detail = F.when(new, F.coalesce(F.concat(F.lit("via "), F.col("a.via")), F.lit("not found by the scanner"))).when(F.size(parts) > 0, F.array_join(parts, "; ")).when(fresh, ", ".join(ENRICHMENT)).otherwise("")
    return rows.select("id", change.alias("change"), detail.alias("detail")).unionByName(gone)


def lint(sites: DataFrame, generated_by: str, auditor: str = "auditor") -> DataFrame:
    """(id, warning): what passes the schema but shows an unfinished audit; one row without an id if no site is the auditor's."""
    names = sites.select(F.col("id").alias("via")).distinct()
    listed = sites.select("id", "via").join(names, "via", "left_semi").select("id", F.lit(True).alias("via_listed"))
    rows = sites.join(listed, "id", "left")
    notes = F.col("notes") if "notes" in sites.columns else F.array().cast("array<string>")
    audited = F.lit(generated_by == auditor)
    missing = F.array_compact(F.array(*(F.when(F.col(c).isNull(), c) for c in ENRICHMENT)))
    expressions = expression_fields(prompt_text())
    warnings = F.array_compact(
        F.array(
            F.when((F.col("grading") == "json_fields") & (F.col("output_format") != "json"), F.concat(F.lit("grading is json_fields but output_format is "), F.col("output_format"))),
            F.when(F.col("via_listed"), F.concat(F.lit("via "), F.col("via"), F.lit(" is still listed as its own call site"))),
            F.when((F.col("found_by") == auditor) & ~F.exists(notes, lambda n: F.startswith(n, F.lit("Auditor:"))), f"found_by is {auditor} but there is no note of it"),
            F.when(audited & (F.size(missing) > 0), F.concat(F.lit("missing "), F.array_join(missing, ", "))),
            F.when(audited & F.col("model.value").isNull(), "model still unresolved"),
            F.when(audited & ~prompt_resolved(), "prompt still unresolved"),
        )
    )
    more = F.when(audited, F.transform(expressions, lambda e: F.concat(F.lit("placeholder {"), e, F.lit("} is an expression; use a plain name")))).otherwise(F.array().cast("array<string>"))
    out = rows.select("id", F.explode(F.concat(warnings, more)).alias("warning"))
    none = sites.agg(F.count_if(F.col("found_by") == auditor).alias("n")).filter(audited & (F.col("n") == 0)).select(F.lit(None).cast("string").alias("id"), F.lit(f"generated_by is {auditor} but no call site has found_by {auditor}").alias("warning"))
    return out.unionByName(none)


def number_sites(found: DataFrame, parsed: bool = False) -> DataFrame:
    """``found(file, function, ord)``, with ``repo`` if there are several, with ids: ``file::function``, and ``#n`` for the nth call of one function.

    ``parsed`` says that the calls of a function came out of one task, as those of a parsed file do: then one task can number them.
    """
    keys = [*_repo(found), "file", "function"]
    rows = found.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))) if parsed else numbered(found, keys, ["ord"])
    name = F.concat("file", F.lit("::"), "function")
    return rows.withColumn("id", F.when(F.col("n") > 1, F.concat(name, F.lit("#"), F.col("n").cast("string"))).otherwise(name)).drop("n")


def _repo(df: DataFrame) -> list[str]:
    return ["repo"] if "repo" in df.columns else []


def attach_callers(sites: DataFrame, calls: DataFrame) -> DataFrame:
    """``sites(id, file, function)`` with ``callers``: sorted distinct callers of the function's last name; itself and module-level sites get none.

    With a column ``repo`` on both sides only calls of the same repository count.
    """
    repo = _repo(sites)
    own = F.concat("file", F.lit("::"), "function")
    named = sites.withColumn("callee", F.element_at(F.split("function", "\\."), -1)).withColumn("own", own)
    met = named.filter(F.col("function") != "<module>").join(calls.select(*repo, "caller", "callee").distinct(), [*repo, "callee"]).filter("caller <> own")
    callers = met.groupBy(*repo, "id").agg(F.array_sort(F.collect_set("caller")).alias("callers"))
    return sites.join(callers, [*repo, "id"], "left").withColumn("callers", F.coalesce("callers", F.array().cast("array<string>")))
