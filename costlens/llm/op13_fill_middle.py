"""13. Fill-in-middle transformation by one match with repeated captures.

A text is units, here lines. One ``fullmatch`` of ``(unit)*`` keeps the end of every repetition, so
the number of units and both cut offsets are read from it, without a loop over the text.
Everything else (keys, sentinels, the way back) is column expressions; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import table, text_of

#: A line with its end, or the last one without. Possessive: what was matched is never given back, so a match is linear.
LINES = r"([^\n]*+\n|[^\n]++)*+"
PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM_RATE = 7, 100, 50

_CUTS = ["n", "first_cut", "second_cut"]


def draws(id_: str | Column, seed: int) -> list[Column]:
    """Four numbers under 2^32 from ``seed`` and an id: the first groups of eight hex digits of a SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_).cast("string") if isinstance(id_, str) else id_.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def cut_points(rows: DataFrame, units: str = LINES) -> DataFrame:
    """``rows(text, h1, h2, ...)`` with ``n`` units and the offsets, in code points, after the smaller and the larger of ``h1 % (n + 1)`` and ``h2 % (n + 1)`` of them."""
    names = rows.columns
    text_at, h1_at, h2_at = (names.index(c) for c in ("text", "h1", "h2"))
    schema = StructType([*rows.schema, *(StructField(name, LongType()) for name in _CUTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = regex.compile(units).fullmatch
        for batch in batches:
            found = []
            for text, h1, h2 in zip(batch.column(text_at), batch.column(h1_at).to_pylist(), batch.column(h2_at).to_pylist(), strict=True):
                got = match(text.as_py() or "")
                if got is None:
                    raise ValueError("the units do not cover a text")
                ends = got.ends(1)
                n = len(ends)
                low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
                found.append((n, ends[low - 1] if low else 0, ends[high - 1] if high else 0))
            cuts = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in cuts)], names=[*names, *_CUTS])

    return rows.mapInArrow(run, schema)


def fill_in_middle(docs: DataFrame, *keep: str, id_column: str = "doc_id", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, units: str = LINES) -> DataFrame:
    """``docs(text, id_column, keep...)`` -> ``(keep..., n, form, prefix_chars, middle_chars, output)``, a row for each row.

    A text is cut after two drawn numbers of units. ``rate`` percent of the texts are transformed, ``spm_rate`` percent of these with the suffix
    first (spm), the others with the prefix first (psm). Texts that are empty or hold a sentinel, and those not drawn, stay as they are (plain, lengths
    null). Null texts count as empty, null ids as an empty id. Draws hang on the id alone, so repeated rows come back equal, as often as they were.
    Columns not in ``keep`` aren't read, and kept ones may have any name but those of the result.
    """
    named = [f"_kept_{i}" for i in range(len(keep))]
    h = draws("_id", seed)
    given = text_of(docs.select(*(F.col(f"`{k}`").alias(a) for k, a in zip(keep, named, strict=True)), F.col(f"`{id_column}`").alias("_id"), "text"), *named, "_id")
    given = given.select(*named, F.coalesce("text", F.lit("")).alias("text"), h[0].alias("h1"), h[1].alias("h2"), (h[2] % 100 < rate).alias("drawn"), (h[3] % 100 < spm_rate).alias("spm"))
    rows = cut_points(given, units)
    holds = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    rows = rows.withColumn("form", F.when((F.col("text") == "") | holds | ~F.col("drawn"), "plain").when(F.col("spm"), "spm").otherwise("psm"))
    a, b = F.col("first_cut").cast("int"), F.col("second_cut").cast("int")
    prefix, middle, suffix = F.substring("text", F.lit(1), a), F.substring("text", a + 1, b - a), F.substring("text", b + 1, F.length("text"))
    prefixed, suffixed = F.concat(F.lit(PREFIX), prefix), F.concat(F.lit(SUFFIX), suffix)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(prefixed, suffixed, F.lit(MIDDLE), middle)).otherwise(F.concat(suffixed, prefixed, F.lit(MIDDLE), middle))
    known = F.col("form") != "plain"
    return rows.select(
        *(F.col(a).alias(k) for k, a in zip(keep, named, strict=True)), "n", "form", F.when(known, F.col("first_cut")).alias("prefix_chars"), F.when(known, F.col("second_cut") - F.col("first_cut")).alias("middle_chars"), output.alias("output")
    )


def restored(output: str = "output", form: str = "form") -> Column:
    """The text before the transformation, from its output and form alone.

    No sentinel begins with the end of another one, so the first of each kind in an output is the one that was put there.
    """
    before = lambda text, mark: F.substring_index(text, mark, 1)
    after = lambda text, mark: F.substring(text, F.length(before(text, mark)) + len(mark) + 1, F.length(text))
    body = F.substring(output, F.lit(len(PREFIX) + 1), F.length(output))
    psm_rest, spm_rest = after(body, SUFFIX), after(body, PREFIX)
    psm = F.concat(before(body, SUFFIX), after(psm_rest, MIDDLE), before(psm_rest, MIDDLE))
    spm = F.concat(before(spm_rest, MIDDLE), after(spm_rest, MIDDLE), before(body, PREFIX))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: every document's transformed text and the text rebuilt from it, as digests."""
    made = fill_in_middle(table(spark, sf_dir, "documents"), "doc_id")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored()).alias("restored_sha256"))


ORACLE_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u
  FROM documents),
drawn AS (
  SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM units),
cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, array_to_string(u[1:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:n], '') AS s FROM cuts)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
