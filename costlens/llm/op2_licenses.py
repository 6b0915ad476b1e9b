"""2. License scans: MinHash bands over overlapping windows, then exact shingle containment.

Words are lower-cased runs of ASCII letters, digits and characters beyond ASCII; shingles are five
words. A template of n words belongs to the class of windows of 2L words that start every L words,
L the power of two from n on (8 at least), so each occurrence lies whole in some window. A window of
2L words that holds just the least number of a template's shingles has the least Jaccard similarity J
with it, 1/12 for a template of five words. Each class has the bands of one minimum that miss its least
J with a probability of MISS or under (64 at least), and fuller or shorter windows are missed less often.
Every shingle of a template holds one of its anchor words, so texts and windows without any are
passed over before hashing, which loses nothing. All of it is DataFrame functions on the JVM; the
templates are a small constant side.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SHINGLE, CONTAINED_PERCENT, BANDS, LEAST_CLASS = 5, 75, 64, 8
#: Largest probability that a window that holds enough of a template meets it in no band.
MISS = 1e-9
#: name -> notice: usual short notices of public licences. Fixed values.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAPS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Words too common to be an anchor where a shingle has another one.
COMMON = {"a", "and", "any", "are", "be", "in", "is", "it", "of", "or", "that", "the", "this", "to", "under", "use", "with", "work", "by", "for", "all", "following", "0", "2", "3", "4"}


def words_of(text: str) -> list[str]:
    out, now = [], ""
    for c in text.translate(str.maketrans(_UPPER, _LOWER)) + " ":
        if c.isascii() and not c.isalnum():
            if now:
                out.append(now)
            now = ""
        else:
            now += c
    return out


def _shingle_list(words: list[str]) -> list[str]:
    return list(dict.fromkeys(" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)))


def _anchors(shingles: list[str]) -> set[str]:
    """Words of which every shingle holds one: the word in most shingles still without, rarer kinds first."""
    left, chosen = [s.split() for s in shingles], set()
    while left:
        words = {w for s in left for w in s}
        best = max(sorted(words), key=lambda w: (w not in COMMON, sum(w in s for s in left), len(w)))
        chosen.add(best)
        left = [s for s in left if best not in s]
    return chosen


def window_class(n: int) -> int:
    size = LEAST_CLASS
    while size < n:
        size *= 2
    return size


def least_jaccard(words: list[str], percent: int = CONTAINED_PERCENT) -> float:
    """The least Jaccard similarity of a template with a window of its class that holds ``percent`` per cent of its shingles."""
    n = len(_shingle_list(words))
    held = max(1, -(-n * percent // 100))
    return held / (max(held, 2 * window_class(len(words)) - SHINGLE + 1) + n - held)


def bands_for(jaccard: float) -> int:
    return BANDS if jaccard >= 1 else max(BANDS, math.ceil(math.log(MISS) / math.log1p(-jaccard)))


def _minima(shingles, bands):
    return F.transform(F.sequence(F.lit(0), bands - 1), lambda b: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, b))))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, percent: int = CONTAINED_PERCENT) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, license, containment, word)``, a row for each document and template that it contains.

    ``containment`` is the largest share of the template's shingles that one window holds, ``word`` the first
    word of the first window that holds at least ``percent`` per cent. Null and empty texts, and texts under five
    words, contain nothing; repeated rows of a doc_id are one document; a null doc_id is a document of its own
    kind. Templates need five words or more. Other columns are ignored.
    """
    lists = {name: words_of(text) for name, text in templates.items()}
    if short := [name for name, w in lists.items() if len(w) < SHINGLE]:
        raise ValueError(f"templates of under {SHINGLE} words: {short}")
    classes: dict[int, list[str]] = {}
    for name, w in lists.items():
        classes.setdefault(window_class(len(w)), []).append(name)
    anchors = {size: sorted({a for n in names for a in _anchors(_shingle_list(lists[n]))}) for size, names in classes.items()}
    bands = {size: max(bands_for(least_jaccard(lists[n], percent)) for n in names) for size, names in classes.items()}
    every = sorted({a for some in anchors.values() for a in some})
    lower = F.translate(F.col("text").cast("string"), _UPPER, _LOWER)
    hinted = docs.select("doc_id", lower.alias("t")).filter(F.col("t").rlike("(?<![0-9a-z\\x{80}-\\x{10FFFF}])(?:" + "|".join(every) + ")(?![0-9a-z\\x{80}-\\x{10FFFF}])"))
    worded = hinted.select("doc_id", F.filter(F.split("t", _GAPS), lambda w: w != "").alias("w")).filter(F.size("w") >= SHINGLE)

    def cut_windows(size: int):
        starts = F.sequence(F.lit(0), F.size("w") - 1, F.lit(size))
        held = F.array(*map(F.lit, anchors[size]))
        made = F.transform(starts, lambda i: F.struct(F.lit(size).alias("class"), F.lit(bands[size]).alias("bands"), i.alias("word"), F.slice("w", i + 1, F.lit(2 * size)).alias("words")))
        return F.filter(made, lambda x: F.arrays_overlap(x["words"], held) & (F.size(x["words"]) >= SHINGLE))

    windows = worded.select("doc_id", F.explode(F.concat(*(cut_windows(size) for size in classes))).alias("x")).select("doc_id", "x.*")
    shingles = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("words") - SHINGLE + 1), lambda i: F.array_join(F.slice("words", i, F.lit(SHINGLE)), " ")))
    hashed = windows.select("doc_id", "class", "bands", "word", shingles.alias("shingles")).withColumn("minima", _minima(F.col("shingles"), F.col("bands")))
    entries = [F.struct(F.lit(name).alias("license"), F.lit(window_class(len(w))).alias("class"), F.lit(bands[window_class(len(w))]).alias("bands"), F.array(*map(F.lit, _shingle_list(w))).alias("template")) for name, w in lists.items()]
    known = docs.sparkSession.range(1, numPartitions=1).select(F.inline(F.array(*entries)))
    posted = known.select("license", "class", "template", F.posexplode(_minima(F.col("template"), F.col("bands"))).alias("band", "least"))
    met = hashed.select("doc_id", "class", "word", "shingles", F.posexplode("minima").alias("band", "least")).join(F.broadcast(posted), ["class", "band", "least"])
    share = F.size(F.array_intersect("shingles", "template")) / F.size("template")
    found = met.select("doc_id", "license", "word", share.alias("share"), F.size("template").alias("n")).filter(F.col("share") * 100 >= percent)
    return found.groupBy("doc_id", "license").agg(F.max("share").alias("containment"), F.min("word").cast("bigint").alias("word"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the licence notices of every document."""
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    names = ", ".join(f"('{name}', {window_class(len(words_of(text)))}, '{' '.join(words_of(text))}')" for name, text in TEMPLATES.items())
    return rf"""
with t as (
  select license, class, string_split(s, ' ') as w from (values {names}) v(license, class, s)
), ts as (
  select distinct license, class, array_to_string(w[i : i + 4], ' ') as g from (select *, unnest(range(1, len(w) - 3)) as i from t)
), tn as (
  select license, count(*) as n from ts group by license
), d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') as w from documents
), ds as (
  select doc_id, len(w) as m, i - 1 as p, array_to_string(w[i : i + 4], ' ') as g from (select *, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5)
), hit as (
  select doc_id, license, class, g, p, m from ds join ts using (g)
), win as (
  select doc_id, license, class, g, k from (select *, unnest([p // class, p // class - 1]) as k from hit) where k >= 0 and p + 5 <= k * class + 2 * class
), share as (
  select doc_id, license, k * class as word, count(distinct g) / any_value(n) as share from win join tn using (license) group by doc_id, license, class, k
)
select doc_id, license, max(share) as containment, cast(min(word) as bigint) as word from share where share * 100 >= 75 group by doc_id, license
"""


ORACLE_SQL = _oracle()
