"""Model calls as a stage over a DataFrame: one client for each partition, failures as rows."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsonvalues import judge_value, object_scores, parse_json_object, parse_judge_score
from ..functions.text import clip
from ..session import ship
from .evals import first_of_equal, generation_messages, parse_generated, renumber, score_exact
from .results import first_cases, is_ok, summarize, to_rescore

#: Numbers of a round of generated cases; more than a reply can have cases.
ROUND = 1 << 32
#: Most tokens of a judge's reply.
JUDGE_TOKENS = 200

CALLED = "text string, prompt_tokens bigint, completion_tokens bigint, latency_s double, error string"


class ModelError(RuntimeError):
    """A call failed, whatever the cause."""


@dataclass(frozen=True)
class ChatClient:
    """One chat completion over an OpenAI-compatible endpoint; the key is read in the task, so no plan holds it.

    A reply of 429 or over 499 is asked for again up to ``retries`` times, after a pause that doubles.
    """

    base_url: str
    api_key_env: str | None = None
    timeout_s: float = 120.0
    retries: int = 2
    pause_s: float = 0.5

    def complete(self, model: str, messages: list[dict], json_mode: bool = False, temperature: float = 0.0, max_tokens: int | None = None) -> tuple[str, int, int]:
        body = {"model": model, "messages": messages, "temperature": temperature} | ({"response_format": {"type": "json_object"}} if json_mode else {}) | ({"max_tokens": max_tokens} if max_tokens else {})
        headers = {"Content-Type": "application/json"}
        if self.api_key_env and os.environ.get(self.api_key_env):
            headers["Authorization"] = f"Bearer {os.environ[self.api_key_env]}"
        for attempt in range(self.retries + 1):
            try:
                request = urllib.request.Request(f"{self.base_url}/chat/completions", json.dumps(body).encode(), headers)
                with urllib.request.urlopen(request, timeout=self.timeout_s) as reply:
                    data = json.load(reply)
                use = data.get("usage") or {}
                return data["choices"][0]["message"]["content"] or "", use.get("prompt_tokens", 0), use.get("completion_tokens", 0)
            except urllib.error.HTTPError as problem:
                if attempt == self.retries or not (problem.code == 429 or problem.code > 499):
                    raise ModelError(str(problem)) from problem
                time.sleep(self.pause_s * 2**attempt)
            except Exception as problem:
                raise ModelError(str(problem)) from problem
        raise ModelError("no attempt was made")


@dataclass(frozen=True)
class FixedClient:
    """Answers without a network: the same text always, a text for each model, or a function of model and messages."""

    reply: str | dict[str, str] | Callable[[str, list[dict]], str]

    def complete(self, model: str, messages: list[dict], json_mode: bool = False, temperature: float = 0.0, max_tokens: int | None = None) -> tuple[str, int, int]:
        text = self.reply(model, messages) if callable(self.reply) else self.reply[model] if isinstance(self.reply, dict) else self.reply
        return text, sum(len(m["content"].split()) for m in messages), len(text.split())


OPTIONS = {"json_mode": bool, "temperature": float, "max_tokens": int}


def call_models(rows: DataFrame, make_client: Callable[[], object], prefix: str = "") -> DataFrame:
    """``rows(model, messages, ...)`` with the reply's text, tokens, latency and error added, names after ``prefix``.

    Columns json_mode, temperature and max_tokens are options of the call where they are there and not null. Rows without messages aren't called and have
    nulls. A failed call is a row with ``error``. Tasks may run twice, so results belong into the append-only log,
    where the last row of a case wins; rows to leave out must be gone before this stage.
    """
    ship(rows.sparkSession)
    columns, asked = rows.columns, [f"{prefix}{c}" for c in ("model", "messages")]
    options = {o: f"{prefix}{o}" for o in OPTIONS if f"{prefix}{o}" in rows.columns}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for part in parts:
            out = []
            for at, (model, messages) in enumerate(zip(*(part[c] for c in asked), strict=True)):
                if messages is None:
                    out.append((None, None, None, None, None))
                    continue
                given = {o: OPTIONS[o](part[c].iloc[at]) for o, c in options.items() if not pd.isna(part[c].iloc[at])}
                began = time.perf_counter()
                try:
                    text, tin, tout = client.complete(model, [{"role": m["role"], "content": m["content"]} for m in messages], **given)
                    out.append((text, tin, tout, time.perf_counter() - began, None))
                except ModelError as problem:
                    out.append((None, 0, 0, time.perf_counter() - began, str(problem)))
            told = pd.DataFrame(out, columns=[f"{prefix}{c}" for c in ("text", "prompt_tokens", "completion_tokens", "latency_s", "error")])
            for c in told.columns[1:3]:
                told[c] = told[c].astype("Int64")
            yield pd.concat([part[columns].reset_index(drop=True), told], axis=1)

    called = ", ".join(f"{prefix}{f}" for f in CALLED.split(", "))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", " + called
    return rows.mapInPandas(run, schema)


def judge_messages(messages="messages", output="output", rubric="rubric"):
    """The judge's prompt: the task, the output and the rubric, as one user message after the instruction."""
    task = F.array_join(F.transform(F.col(messages), lambda m: F.concat(F.lit("<"), m["role"], F.lit("> "), m["content"])), "\n")
    user = F.concat(F.lit("Task:\n"), task, F.lit("\n\nOutput:\n"), F.col(output), F.lit("\n\nRubric:\n"), F.col(rubric), F.lit("\n\nAnswer with JSON."))
    system = F.lit('Grade the output against the rubric from 1 to 5. Answer with JSON: {"score": n, "reason": "..."}.')
    one = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(one("system", system), one("user", user))


def judged(rows: DataFrame, model: str | None, make_client: Callable[[], object] | None, pass_at: int = 4) -> DataFrame:
    """``rows(messages, output, rubric, asked, ...)`` with ``judgement``: struct(score, passed, judge_score, detail, error), null where ``asked`` is false.

    Blank outputs fail without a call. The judge answers in JSON, with temperature 0 and JUDGE_TOKENS at most.
    """
    blank = F.coalesce(F.trim("output") == "", F.lit(True))
    call = F.col("asked") & ~blank if model and make_client else F.lit(False)
    ready = rows.withColumns({"judge_messages": F.when(call, judge_messages()), "judge_model": F.lit(model), "judge_json_mode": F.lit(True), "judge_max_tokens": F.lit(JUDGE_TOKENS)})
    called = call_models(ready, make_client or (lambda: None), "judge_")
    reason = F.try_variant_get(parse_json_object("judge_text"), "$.reason", "string")
    rows_ = called.withColumn("judge_score", parse_judge_score("judge_text")).withColumn("v", judge_value("judge_score", pass_at))
    kind = "struct<score:double,passed:boolean,judge_score:int,detail:string,error:string>"
    none = F.struct(F.lit(0.0), F.lit(False), F.lit(None).cast("int"), F.lit("empty output"), F.lit(None).cast("string")).cast(kind)
    failed = lambda why: F.struct(F.lit(None).cast("double"), F.lit(None).cast("boolean"), F.lit(None).cast("int"), F.lit(None).cast("string"), F.concat(F.lit("scoring failed: "), why)).cast(kind)
    detail = F.when(F.col("judge_score").isNull(), F.concat(F.lit("judge reply unparseable: "), clip("judge_text"))).otherwise(F.concat(F.lit("judge "), F.col("judge_score").cast("string"), F.lit("/5"), F.coalesce(F.concat(F.lit(": "), clip(reason)), F.lit(""))))
    told = F.struct("v.value", "v.passed", "judge_score", detail, F.lit(None).cast("string")).cast(kind)
    given = F.when(~F.col("asked"), None).when(blank, none).when(F.lit(not (model and make_client)), failed(F.lit("no judge is set"))).when(F.col("judge_error").isNotNull(), failed(F.col("judge_error"))).otherwise(told)
    return rows_.select(*rows.columns, given.alias("judgement"))


def judge(rows: DataFrame, model: str, make_client: Callable[[], object], pass_at: int = 4) -> DataFrame:
    """``rows(messages, output, rubric, ...)`` with score, passed, judge_score, detail and error; blank outputs fail without a call."""
    told = judged(rows.withColumn("asked", F.lit(True)), model, make_client, pass_at)
    return told.select(*rows.columns, "judgement.*")


def run_cases(todo: DataFrame, make_client: Callable[[], object], judge_model: str | None = None, make_judge: Callable[[], object] | None = None, pass_at: int = 4) -> DataFrame:
    """``todo(site_id, model, case_id, messages, expected, ...)`` called and graded: rows for the log.

    A column ``grading`` tells how (exact, json_fields or judge; exact without it), ``fields`` the graded fields (all of ``expected`` where null), and
    json_mode, temperature and max_tokens are options of the call. Both calls of a judged case are in one chain of stages, so none is made
    twice. A failed call or judgement is a row with ``error``.
    """
    rows = todo if "grading" in todo.columns else todo.withColumn("grading", F.lit("exact"))
    rows = rows if "fields" in todo.columns else rows.withColumn("fields", F.lit(None).cast("array<string>"))
    called = call_models(rows, make_client).withColumnsRenamed({"text": "output"}).withColumns({"rubric": F.col("expected"), "asked": (F.col("grading") == "judge") & F.col("error").isNull()})
    kind = "struct<score:double,passed:boolean,judge_score:int,detail:string,error:string>"
    told = judged(called, judge_model, make_judge, pass_at)
    plain = lambda s: F.struct(s["value"], s["passed"], F.lit(None).cast("int"), s["detail"], F.lit(None).cast("string")).cast(kind)
    other = F.struct(F.lit(None).cast("double"), F.lit(None).cast("boolean"), F.lit(None).cast("int"), F.lit(None).cast("string"), F.concat(F.lit("scoring failed: unknown grading "), F.coalesce("grading", F.lit("null")))).cast(kind)
    s = F.when(F.col("grading") == "exact", plain(score_exact("output", "expected"))).when(F.col("grading") == "json_fields", plain(object_scores("output", "expected", "fields"))).when(F.col("asked"), F.col("judgement")).otherwise(other)
    graded = told.withColumn("s", F.when(F.col("error").isNull(), s))
    return graded.select("site_id", "model", "case_id", "output", "prompt_tokens", "completion_tokens", "latency_s", "s.score", "s.passed", "s.detail", "s.judge_score", F.coalesce("error", "s.error").alias("error"), F.when(F.col("asked"), F.lit(judge_model)).alias("judge_model"))


def rescore(latest: DataFrame, cases: DataFrame, model: str, make_client: Callable[[], object], pass_at: int = 4) -> DataFrame:
    """New log rows for saved outputs that judge ``model`` has yet to grade; outputs, tokens and latency stay.

    ``cases(site_id, case_id, messages, expected, grading)`` has the prompt and the rubric; only judge-graded cases count.
    """
    asked = cases.filter("grading = 'judge'").select("site_id", "case_id", "messages", F.col("expected").alias("rubric"))
    kept = to_rescore(latest, model).select("site_id", "model", "case_id", "output", "prompt_tokens", "completion_tokens", "latency_s")
    graded = judge(kept.join(asked, ["site_id", "case_id"]), model, make_client, pass_at)
    return graded.drop("messages", "rubric").withColumn("judge_model", F.lit(model))


def before_and_after(spine: DataFrame, models: DataFrame, latest: DataFrame, fresh: DataFrame) -> DataFrame:
    """(site_id, model, cases, before, after, ...): pass rates of a log before and after new rows, where any case was graded anew."""
    keys = ["site_id", "model", "case_id"]
    common = [c for c in latest.columns if c in fresh.columns]
    after = latest.join(fresh.select(*keys), keys, "left_anti").select(*common).unionByName(fresh.select(*common))
    short = lambda log, name: summarize(spine, models, log).select("site_id", "model", "cases", F.struct("scored", "passed", "pass_rate").alias(name))
    return short(latest, "before").join(short(after, "after").drop("cases"), ["site_id", "model"]).join(fresh.select("site_id", "model").distinct(), ["site_id", "model"], "left_semi")


def warm_up(models: list[str], client) -> dict[str, str]:
    """One call of each model on the driver before a run; the models that fail, with why."""
    failed = {}
    for model in models:
        try:
            client.complete(model, [{"role": "user", "content": "Say ok."}])
        except ModelError as problem:
            failed[model] = str(problem)
    return failed


def generate(sites: DataFrame, model: str, make_client: Callable[[], object], wanted: int, folder: str, tries: int = 3) -> tuple[DataFrame, DataFrame]:
    """(cases, problems) for ``sites(site_id, function, messages, wanted, grading, labels, fields, output_contract)``: asks for what is missing until each site has
    ``wanted`` cases of different inputs, ``tries`` times at most.

    Each round's replies are written below ``folder`` before they are read, so no call is made twice.
    """
    spark, have, found = sites.sparkSession, None, None
    for number in range(1, tries + 1):
        n = sites.select("site_id") if have is None else None
        counts = n.withColumn("n", F.lit(0)) if n is not None else sites.select("site_id").join(have.groupBy("site_id").agg(F.count("*").alias("n")), "site_id", "left").fillna(0, "n")
        open_ = sites.join(counts.filter(F.col("n") < wanted), "site_id").withColumn("missing", F.lit(wanted) - F.col("n"))
        asked = open_.withColumns({"messages": generation_messages(), "model": F.lit(model), "json_mode": F.lit(False)})
        call_models(asked.select("site_id", "function", "wanted", "model", "messages"), make_client).write.mode("overwrite").parquet(f"{folder}/round={number}")
        replies = spark.read.parquet(f"{folder}/round={number}")
        cases, problems = parse_generated(replies.filter("error is null"))
        failed = replies.filter("error is not null").select("site_id", F.col("error").alias("problem"))
        problems = problems.unionByName(failed)
        cases = cases.withColumn("ord", F.lit(number).cast("bigint") * ROUND + F.col("ord"))  # once for each case: rounds stay in their order
        every = cases if have is None else have.unionByName(cases)
        have = first_of_equal(every, "key")
        again = cases.join(have.select("site_id", "ord"), ["site_id", "ord"], "left_anti").select("site_id", F.lit("a case has the inputs of an earlier one").alias("problem"))
        problems = problems.unionByName(again)
        found = problems if found is None else found.unionByName(problems)
        if sites.join(have.groupBy("site_id").agg(F.count("*").alias("n")).filter(F.col("n") >= wanted), "site_id", "left_anti").isEmpty():
            break
    return renumber(first_cases(have.withColumn("line", F.col("ord")), wanted)).drop("line"), found


__all__ = ["ChatClient", "FixedClient", "ModelError", "call_models", "generate", "before_and_after", "is_ok", "judge", "judge_messages", "judged", "rescore", "run_cases", "warm_up"]
