"""10. URL filters: given rules first, association rules mined by FP-growth for the rest.

URLs that a given rule fits are the labelled rows. FP-growth mines sets of their tokens together
with the verdict; rules under the least support or confidence go, and so do rules that a shorter one
with as much confidence makes redundant. A mined rule is posted under its rarest token; a URL's tokens
look the postings up, the whole left-hand side is checked, and the surest rule decides. Everything
is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import copied, cut, dealt, hot_keys, table

#: (verdict, host, path) of the contract's rules.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
SUPPORT, CONFIDENCE = 0.01, 0.8
#: Verdict of a URL that neither a given nor a mined rule fits.
DEFAULT = "allow"
#: Rows of one URL that one task handles.
MOST = 4096
_MARK = "verdict="


def host_and_path(url: str = "url"):
    """Columns of a URL's host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    whole = F.coalesce(F.col(url).cast("string"), F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(whole, pattern, 1), upper, lower), F.regexp_extract(whole, pattern, 2)


def given_rule(rules: list[tuple[str, str, str]]):
    """The longest rule that fits ``host`` and ``path``, as struct(rule, verdict), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        own = (F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))
        out = F.when(own & F.startswith("path", F.lit(path)), F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens():
    """Distinct tokens of ``url``, ``host`` and ``path``: scheme, host labels and their place, path parts, the query's keys, a fragment. Runs of digits are one token."""
    flat = lambda c: F.regexp_replace(c, "[0-9]+", "#")
    whole = F.coalesce(F.col("url").cast("string"), F.lit(""))
    labels = F.reverse(F.split("host", "\\."))
    parts = F.split(F.btrim(F.col("path"), F.lit("/")), "/")
    query = F.split(F.regexp_extract(whole, r"(?s)^[^?#]*\?([^#]*)", 1), "&")
    tokens = F.concat(
        F.transform(labels, lambda x, i: F.concat(F.lit("host"), F.least(i, F.lit(3)).cast("string"), F.lit(":"), flat(x))),
        F.transform(parts, lambda x, i: F.concat(F.lit("path"), F.least(i, F.lit(3)).cast("string"), F.lit(":"), flat(x))),
        F.transform(query, lambda x: F.concat(F.lit("key:"), flat(F.substring_index(x, "=", 1)))),
        F.array(F.concat(F.lit("scheme:"), F.substring_index(whole, "://", 1))),
    )
    return F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(tokens, lambda x: ~F.endswith(x, F.lit(":")))))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``labelled(tokens, verdict)`` -> ``(left, verdict, confidence, support, key)``: the rules kept, with the token they are posted under."""
    items = labelled.filter(F.col("verdict").isNotNull()).select(F.array_append("tokens", F.concat(F.lit(_MARK), F.col("verdict"))).alias("items"), "tokens")
    items = cut(items, "url-items")
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    found = model.associationRules.filter(F.startswith(F.col("consequent")[0], F.lit(_MARK)) & ~F.exists("antecedent", lambda x: F.startswith(x, F.lit(_MARK))))
    found = found.select(F.array_sort("antecedent").alias("left"), F.substring(F.col("consequent")[0], len(_MARK) + 1, 1000).alias("verdict"), "confidence", "support")
    found = cut(found, "url-rules")
    one_less = found.select("left", "verdict", "confidence", F.explode("left").alias("x")).select("left", "verdict", "confidence", F.array_remove("left", F.col("x")).alias("less"))
    shorter = found.select(F.col("left").alias("less"), "verdict", F.col("confidence").alias("had"))
    redundant = one_less.join(shorter, ["less", "verdict"]).filter("had >= confidence").select("left", "verdict").distinct()
    kept = found.join(redundant, ["left", "verdict"], "left_anti")
    often = items.select(F.explode("tokens").alias("token")).groupBy("token").count()
    keyed = kept.select("left", "verdict", F.explode("left").alias("token")).join(often, "token").groupBy("left", "verdict").agg(F.min_by("token", F.struct("count", "token")).alias("key"))
    return kept.join(keyed, ["left", "verdict"])


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``pages(page_id, url, ...)`` -> ``(page_id, host, path, rule, verdict)``, a row for each page.

    Null URLs and URLs without ``://`` have an empty host and path, no rule and the default verdict. Of mined
    rules that fit, the highest confidence decides, then support, then fewer tokens, then ``block``. If no URL
    is labelled nothing is mined. Repeated rows come back repeated; other columns are ignored, whatever their names.
    """
    host, path = host_and_path()
    told = pages.select("page_id", F.col("url").cast("string").alias("url"), host.alias("host"), path.alias("path")).withColumn("given", given_rule(rules))
    told = cut(told, "urls")
    tokens = url_tokens()
    labelled = told.filter(F.col("given").isNotNull()).select(tokens.alias("tokens"), F.col("given.verdict").alias("verdict"))
    if labelled.isEmpty():
        found = None
    else:
        open_ = told.filter(F.col("given").isNull() & (F.col("host") != "")).select("url", "host", "path").distinct().select("url", tokens.alias("tokens"))
        posted = mine(labelled, support, confidence)
        hits = open_.select("url", "tokens", F.explode("tokens").alias("key")).join(posted, "key").filter(F.size(F.array_except("left", "tokens")) == 0)
        found = hits.groupBy("url").agg(F.max_by("verdict", F.struct("confidence", "support", -F.size("left"), "verdict")).alias("mined"))
    none = F.lit(None).cast("string").alias("mined")
    if found is None:
        out = told.withColumn("mined", none)
    else:  # only URLs that are open are looked up, and one of many pages in several tasks
        open_pages = F.col("given").isNull() & (F.col("host") != "")
        asked = told.filter(open_pages)
        hot = hot_keys(asked, "url", MOST)
        met = dealt(asked, "url", hot, "page_id").join(copied(found, "url", hot), ["url", "salt"], "left")
        out = told.filter(~open_pages).select("*", none).select("page_id", "host", "path", "given", "mined").union(met.select("page_id", "host", "path", "given", "mined"))
    return out.select("page_id", "host", "path", F.col("given.rule").alias("rule"), F.coalesce("given.verdict", "mined", F.lit(DEFAULT)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the verdict on every page's url."""
    return filter_urls(table(spark, sf_dir, "pages"))
