"""Reading and writing the domain's files: source trees, result logs, eval sets, scans."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import model_filename, slug_for
from ..schemas import DIFFICULTIES, GRADINGS, MODEL_SOURCES, OUTPUT_FORMATS, PRODUCERS, RESULT_ROW, SCAN_FILE


def source_tree(spark: SparkSession, root: str, repo: str = "repo") -> DataFrame:
    """``(repo, rel, content)`` of the Python files below ``root``, or of the one file that it is, by Spark's binary reader."""
    root = root.rstrip("/")
    plain = re.sub(r"([{}\[\]*?\\])", r"\\\1", root)  # a folder's name is no pattern
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").load(plain)
    rest = F.substr("path", F.locate(root, "path") + len(root) + 1)
    rel = F.when(rest == "", root.rsplit("/", 1)[-1]).otherwise(rest)  # a single file is its own root
    return raw.select(F.lit(repo).alias("repo"), rel.alias("rel"), "content")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(path, changed, line, value)`` of text files; lines end at ``\\n``, ``\\r`` or ``\\r\\n`` alone, and number from 1 in each file."""
    whole = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("changed"), "value")
    lines = whole.select("path", "changed", F.posexplode(F.split("value", "\r\n|\n|\r")).alias("pos", "value"))
    return lines.select("path", "changed", (F.col("pos") + 1).cast("bigint").alias("line"), "value")


def result_log(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a log with their place: ``<slug>/<model>.jsonl`` files, or the folders of :func:`append_results`.

    ``seq`` orders the rows of a site and model: by the number of the run that :func:`append_results` wrote into each row (0 in files that
    it didn't write), then by the place in the file, so copying a log changes nothing. Files are read in splits. Bad lines, a last line cut
    short, lines that are no object or lack a key are passed over, unknown keys dropped.
    """
    raw = spark.read.option("recursiveFileLookup", True).text(path)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    rows = raw.select(F.col("_metadata.file_path").alias("path"), place.alias("place"), F.from_json("value", RESULT_ROW).alias("r"))
    parts = F.split("path", "/")
    of_folder = lambda key, plain: F.coalesce(F.nullif(F.regexp_extract("path", f"/{key}=([^/]+)/", 1), F.lit("")), plain)
    slug = of_folder("slug", F.element_at(parts, -2))
    model_file = of_folder("model_file", F.regexp_replace(F.element_at(parts, -1), r"\.jsonl$", ""))
    seq = F.struct(F.coalesce("r.run", F.lit(0)).alias("run"), F.coalesce("r.pos", F.lit(0)).alias("pos"), "place.block", "place.line")
    rows = rows.select(slug.alias("slug"), model_file.alias("model_file"), seq.alias("seq"), "r.*").drop("run", "pos")
    return rows.filter(F.col("case_id").isNotNull() & F.col("model").isNotNull())


def last_run(spark: SparkSession, path: str) -> int:
    """The number of the last run in a log, 0 without one."""
    return result_log(spark, path).agg(F.max("seq.run")).first()[0] or 0


def latest_results(spark: SparkSession, path: str) -> DataFrame:
    """The last row of each case in each file."""
    from ..operators.results import last_wins

    return last_wins(result_log(spark, path), ["slug", "model_file", "case_id"])


def append_results(rows: DataFrame, path: str, run: int = 1) -> None:
    """Appends ``rows(site_id, model, ...)`` as JSON lines in one folder for each site and model, with the number of the run and their place in it; a task's lines appear whole or not at all."""
    out = rows.withColumns({"slug": slug_for("site_id"), "model_file": model_filename("model"), "run": F.lit(run).cast("bigint"), "pos": F.monotonically_increasing_id()})
    out.write.mode("append").partitionBy("slug", "model_file").option("ignoreNullFields", "false").json(path)


def append_line(row: dict, path: str) -> None:
    """Appends one row to a plain log file on the driver; a last line that was cut short is ended first, so that it alone is lost."""
    with open(path, "ab+") as file:
        end = file.seek(0, 2)
        if end:
            file.seek(end - 1)
            if file.read(1) != b"\n":
                file.write(b"\n")
        file.write(json.dumps(row, ensure_ascii=False).encode() + b"\n")


def scan_file(spark: SparkSession, path: str) -> DataFrame:
    """The call sites of scan files, with ``generated_by``; absent fields get their defaults; a file that isn't one fails."""
    raw = spark.read.schema(SCAN_FILE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    rows = raw.select("generated_by", F.explode("call_sites").alias("s")).select("generated_by", "s.*")
    empty = F.array().cast("array<string>")
    defaults = {"is_async": F.lit(False), "output_format": F.lit("text"), "callers": empty, "notes": empty, "found_by": F.lit("ast")}
    return rows.withColumns({c: F.coalesce(c, default) for c, default in defaults.items()})


def scan_heads(spark: SparkSession, path: str) -> DataFrame:
    """``(root, generated_by, tool_version, files_scanned, warnings)`` of scan files."""
    raw = spark.read.schema(SCAN_FILE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    empty = F.array().cast("array<string>")
    return raw.select("root", F.coalesce("generated_by", F.lit("ast")).alias("generated_by"), "tool_version", F.col("summary.files_scanned").alias("files_scanned"), F.coalesce("warnings", empty).alias("warnings"))


#: What the fields of a call site must be in a scan file: the JSON types of each (as Spark names them), and a rule on the value.
_TEXT, _LIST = "STRING", "ARRAY<(STRING|VOID)?>"
_SITE_RULES = {
    "id": (_TEXT, "<> ''"), "file": (_TEXT, "<> ''"), "function": (_TEXT, "<> ''"), "api": (_TEXT, "<> ''"),
    "line": ("BIGINT", ">= 1"), "end_line": ("BIGINT|VOID", ">= 1"), "is_async": ("BOOLEAN|VOID", None), "model": ("OBJECT<.*>", None), "messages": ("ARRAY<.*>|VOID", None),
    "output_format": ("STRING|VOID", f"in {tuple(OUTPUT_FORMATS)}"), "temperature": (r"BIGINT|DOUBLE|DECIMAL\(.*\)|VOID", None), "max_tokens": ("BIGINT|VOID", ">= 1"), "via": ("STRING|VOID", "<> ''"),
    "callers": (f"{_LIST}|VOID", None), "notes": (f"{_LIST}|VOID", None), "purpose": ("STRING|VOID", None), "output_contract": ("STRING|VOID", None),
    "difficulty": ("STRING|VOID", f"in {tuple(DIFFICULTIES)}"), "grading": ("STRING|VOID", f"in {tuple(GRADINGS)}"), "found_by": ("STRING|VOID", f"in {tuple(PRODUCERS)}"),
}
_NEEDED = ["id", "file", "function", "api", "line", "model"]
#: The same of a call site's model and of each message.
_MODEL_RULES = {"value": ("STRING|VOID", "<> ''"), "source": (_TEXT, f"in {tuple(MODEL_SOURCES)}"), "expression": (_TEXT, None), "env_var": ("STRING|VOID", "<> ''"), "defined_in": ("STRING|VOID", "<> ''")}
_MESSAGE_RULES = {"role": (_TEXT, "<> ''"), "content": (_TEXT, None), "resolved": ("BOOLEAN", None)}


def scan_problems(spark: SparkSession, path: str, known: list[str]) -> DataFrame:
    """``(id, problem)`` of scan files: a wrong version, unknown fields, absent, mistyped or invalid ones, and repeated ids. Problems of a whole file have no id."""
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    version = F.try_variant_get("v", "$.schema_version", "int")
    listed = F.try_variant_get("v", "$.call_sites", "array<variant>")
    file_ = F.array_compact(F.array(F.when(F.col("v").isNull(), "is no JSON"), F.when(F.col("v").isNotNull() & ~F.coalesce(version == 1, F.lit(False)), "schema_version must be 1"), F.when(F.col("v").isNotNull() & listed.isNull(), "call_sites must be a list")))
    of_file = whole.select(F.lit(None).cast("string").alias("id"), F.explode(file_).alias("problem"))
    return of_file.unionByName(site_problems(whole.select(F.posexplode(listed).alias("at", "s")), known))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _broken(variant: str, rules: dict[str, tuple[str, str | None]], needed: list[str], known: list[str]) -> str:
    """SQL of the list of what is wrong with a VARIANT by ``rules``; one text for all rules, as columns made one by one take seconds to build."""
    is_object = f"coalesce(startswith(schema_of_variant({variant}), 'OBJECT'), false)"
    unknown = f"array_sort(array_except(json_object_keys(to_json({variant})), array({', '.join(map(_quoted, known))})))"
    found = [f"if({is_object}, null, 'is no object')", f"if(size({unknown}) > 0, concat('unknown field ', array_join({unknown}, ', ')), null)"]
    for name, (kinds, rule) in rules.items():
        value = f"try_variant_get({variant}, '$.{name}', 'variant')"
        fits = f"schema_of_variant({value}) rlike {_quoted(f'^({kinds})$')}"
        if name in needed:
            found.append(f"if({is_object} and {value} is null, '{name} is missing', null)")
        found.append(f"if({value} is not null and not {fits}, {_quoted(f'{name} must be ' + kinds.replace('|VOID', ' or null').split('<')[0].lower())}, null)")
        if rule:
            typed = f"try_variant_get({variant}, '$.{name}', '{'bigint' if rule.startswith('>=') else 'string'}')"
            shown = rule.replace("<> ''", "non-empty")
            found.append(f"if({value} is not null and {fits} and not coalesce({typed} {rule}, true), {_quoted(f'{name} must be {shown}')}, null)")
    return f"array_compact(array({', '.join(found)}))"


def site_problems(sites: DataFrame, known: list[str]) -> DataFrame:
    """``(id, problem)`` of ``sites(at, s)``, call sites as VARIANT with their place in the list; a site without an id is named by its place. Those of its model and its messages name them first."""
    model = "try_variant_get(s, '$.model', 'variant')"
    of_model = f"if(startswith(schema_of_variant({model}), 'OBJECT'), transform({_broken(model, _MODEL_RULES, ['source', 'expression'], list(_MODEL_RULES))}, p -> concat('model: ', p)), null)"
    of_message = f"transform({_broken('m', _MESSAGE_RULES, ['role', 'content'], list(_MESSAGE_RULES))}, p -> concat('messages[', i, ']: ', p))"
    of_messages = f"flatten(transform(try_variant_get(s, '$.messages', 'array<variant>'), (m, i) -> {of_message}))"
    lists = [_broken("s", _SITE_RULES, _NEEDED, known), *(f"coalesce({x}, cast(array() as array<string>))" for x in (of_model, of_messages))]
    named = F.coalesce(F.try_variant_get("s", "$.id", "string"), F.concat(F.lit("call_sites["), F.col("at").cast("string"), F.lit("]")))
    rows = sites.select(named.alias("id"), F.expr(f"concat({', '.join(lists)})").alias("problems"))
    odd = rows.select("id", F.explode("problems").alias("problem"))
    twice = rows.groupBy("id").count().filter("count > 1").select("id", F.lit("duplicate id").alias("problem"))
    return odd.unionByName(twice)


_CASE_FIELDS = ["id", "inputs", "expected", "grading", "notes"]


def _shared_files(shared: DataFrame) -> DataFrame:
    """``shared(path, key, value)`` with ``text``: the value itself, or what the file holds that ``{"file": name}`` names beside the eval file; null if there is none."""
    spark = shared.sparkSession
    file = F.try_variant_get(F.try_parse_json("value"), "$.file", "string")
    rows = shared.withColumn("file", F.when(F.col("value").rlike(r"^\s*\{"), F.concat(F.regexp_replace("path", "[^/]*$", ""), file)))
    names = [r[0] for r in rows.select("file").dropna().distinct().collect()]  # as many as eval sets share files
    there = [n for n in names if _exists(spark, n)]
    if not there:
        return rows.withColumn("text", F.when(F.col("file").isNull(), F.col("value"))).drop("file")
    texts = spark.read.text(there, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("held"))
    return rows.join(texts, "file", "left").withColumn("text", F.when(F.col("file").isNull(), F.col("value")).otherwise(F.col("held"))).drop("file", "held")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def eval_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cases, problems) of eval files. A first record with ``shared`` only sets inputs that every case gets unless it has its own; ``{"file": name}`` there is the text of that file.

    Cases have slug, line, id, inputs, expected (JSON) and its JSON type, grading and notes; problems have slug, line and text. Unknown fields and
    a later ``shared`` record are problems too; a case with an unknown field only is still a case.
    """
    lines = numbered_lines(spark, path).filter(F.col("path").endswith(".jsonl") & (F.trim("value") != "")).withColumn("slug", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.jsonl$", ""))
    first = F.row_number().over(Window.partitionBy("path").orderBy("line")) == 1
    keys = F.json_object_keys("value")
    rows = lines.withColumns({"keys": keys, "has_shared": F.coalesce(F.array_contains(keys, "shared") & ~F.array_contains(keys, "id"), F.lit(False))}).withColumn("is_shared", first & F.col("has_shared"))
    given = F.from_json(F.get_json_object("value", "$.shared"), "map<string,string>")
    shared = _shared_files(rows.filter("is_shared").select("path", "slug", "line", F.explode(given).alias("key", "value")))
    lost = shared.filter("text is null").select("slug", "line", F.concat(F.lit("shared "), F.col("key"), F.lit(": file not found")).alias("problem"))
    badly = rows.filter("is_shared").filter(given.isNull()).select("slug", "line", F.lit("shared must be an object").alias("problem"))
    maps = shared.filter("text is not null").groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "text")))).alias("shared"))
    body = rows.filter("not is_shared").join(maps, "path", "left")
    need = F.array(*map(F.lit, _CASE_FIELDS[:4]))
    lacking = F.array_except(need, "keys")
    field = lambda n: F.get_json_object("value", f"$.{n}").alias(n)
    own = F.from_json(F.get_json_object("value", "$.inputs"), "map<string,string>")
    problem = (
        F.when(F.col("keys").isNull(), "is not a JSON object")
        .when(F.col("has_shared"), "shared must come first")
        .when(F.size(lacking) > 0, F.concat(F.lit("missing "), F.array_join(lacking, ", ")))
        .when(F.coalesce(F.trim(field("id")) == "", F.lit(True)), "id must be a non-empty string")
        .when(own.isNull(), "inputs is not an object")
        .when(~F.coalesce(field("grading").isin(*GRADINGS), F.lit(False)), F.concat(F.lit("grading must be one of "), F.lit(", ".join(GRADINGS))))
    )
    body = body.withColumns({"problem": problem, "own": own, "unknown": F.array_sort(F.array_except("keys", F.array(*map(F.lit, _CASE_FIELDS))))})
    merged = F.map_concat(F.map_filter(F.coalesce("shared", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key("own", k)), "own")
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("value"), "$.expected", "variant"))
    cases = body.filter("problem is null").select("slug", "line", field("id"), merged.alias("inputs"), field("expected"), kind.alias("expected_kind"), field("grading"), field("notes"))
    odd = body.filter("problem is null and size(unknown) > 0").select("slug", "line", F.concat(F.lit("unknown field "), F.array_join("unknown", ", ")).alias("problem"))
    problems = body.filter("problem is not null").select("slug", "line", "problem").unionByName(odd).unionByName(lost).unionByName(badly)
    return cases, problems


def write_eval_set(cases: DataFrame, path: str, shared: dict[str, str] | None = None) -> None:
    """Cases of one site as JSON lines in their order, after a record of ``shared`` inputs where there are any; an eval set is small, so it is one file.

    ``expected`` that is a JSON object or array is written as one, anything else as a string; notes are kept.
    """
    nested = F.when(F.col("expected").rlike(r"^\s*[\[{]"), F.try_parse_json("expected"))
    notes = [F.col("notes")] if "notes" in cases.columns else []
    line = F.to_json(F.struct("id", "inputs", F.coalesce(nested, F.to_variant_object(F.array("expected")).try_cast("array<variant>")[0]).alias("expected"), "grading", *notes))
    out = cases.select("line", line.alias("value"))
    if shared:
        head = cases.sparkSession.createDataFrame([(-1, json.dumps({"shared": shared}, ensure_ascii=False))], "line long, value string")
        out = head.unionByName(out.select(F.col("line").cast("bigint").alias("line"), "value"))
    out.orderBy("line").coalesce(1).select("value").write.mode("overwrite").text(path)
