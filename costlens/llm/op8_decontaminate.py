"""8. Benchmark decontamination with a broadcast hash set of normalised test n-grams.

The 13-word windows of the benchmark are hashed and broadcast: as a sorted array of hashes up to ``HELD`` of them, and
as a Bloom filter of bounded size for a larger benchmark. One map stage over the documents rolls the same hash over
their words and passes on the few windows that are in the set; a join on the words themselves verifies them and
brings the items. Hits belong to a text, so copies are verified once, and only documents with hits are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import BROADCAST_ROWS, copied, cut, dealt, hot_keys, table, text_of

WINDOW = 13
#: Hashes that are broadcast as they are (8 bytes each); beyond, a Bloom filter of 2**LARGEST bits at most, with so many probes.
HELD, LARGEST, PROBES = 1_000_000, 29, 4
#: Bytes of one of Spark's blocks of bits.
BLOCK_BYTES = 4096
#: Rows of one key that one task handles.
MOST = 1024
#: Least share of hit words, as 1/20, that makes a document contaminated.
SHARE = 20


def _item_windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for p in W.pieces(batch.column(1), W.ALNUM, lower=True):
                item, size, key, text = [], [], [], []
                h = p.hashes()
                for i, n in enumerate(p.counts):
                    if n:
                        w, at = min(width, int(n)), p.first[i]
                        for k, x in enumerate(W.windows(h[at : at + n], w).view(np.int64)):
                            item.append(ids[p.lo + i].as_py())
                            size.append(w)
                            key.append(int(x))
                            text.append(_words_at(p, at + k, w))
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(size, pa.int32()), pa.array(key, pa.int64()), pa.array(text, pa.binary())], names=["item_id", "width", "key", "words"])

    return run


def _words_at(p: W.Piece, at: int, width: int) -> bytes:
    raw = p.data
    return b" ".join(raw[s:e].tobytes() for s, e in zip(p.starts[at : at + width], p.ends[at : at + width], strict=True))


class KeySet:
    """The hashes of all windows as tasks look them up: a sorted array up to HELD of them, a Bloom filter beyond. It never misses one."""

    def __init__(self, widths: list[int], keys: np.ndarray | None, blocks: dict[int, bytes] | None = None, k: int = 20):
        self.widths, self.keys, self.k = widths, keys, k
        self.bits = np.zeros(1 << (k - 3), np.uint8)
        if keys is not None:
            np.bitwise_or.at(self.bits, (keys >> np.uint64(64 - k + 3)).astype(np.int64), np.uint8(1) << ((keys >> np.uint64(64 - k)) & np.uint64(7)).astype(np.uint8))
        for at, block in (blocks or {}).items():
            self.bits[at * BLOCK_BYTES : (at + 1) * BLOCK_BYTES] = np.frombuffer(block, np.uint8)[: len(self.bits) - at * BLOCK_BYTES]

    def _set(self, at: np.ndarray) -> np.ndarray:
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that are in the set, or seem to be."""
        if self.keys is None:
            at = np.arange(len(hashes))
            for probe in range(PROBES):
                at = at[self._set(_probe(hashes[at], probe, self.k))]
            return at
        at = np.flatnonzero(self._set(hashes >> np.uint64(64 - self.k)))
        near = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        return at[self.keys[near] == hashes[at]] if len(self.keys) else at[:0]


def _probe(hashes: np.ndarray, probe: int, k: int) -> np.ndarray:
    return W.mix(hashes + np.uint64(probe + 1) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - k)


def _bloom_places(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            at = np.concatenate([_probe(keys, probe, k).astype(np.int64) for probe in range(PROBES)])
            yield pa.RecordBatch.from_arrays([pa.array(at)], names=["at"])

    return run


def key_set(found: DataFrame, held: int = HELD) -> KeySet:
    """``found(width, key, ...)``, the windows -> what tasks look up: at most 8 * ``held`` bytes of hashes, or 2**(LARGEST - 3) bytes of bits."""
    keys = found.select("key").distinct()
    widths = sorted(r[0] for r in found.select("width").distinct().collect())  # as many as a window has words
    n = keys.count()
    if n <= held:
        return KeySet(widths, np.sort(keys.toArrow().column(0).to_numpy().view(np.uint64)))
    k = min(LARGEST, max(20, (64 * n).bit_length()))
    places = keys.mapInArrow(_bloom_places(k), "at long")
    at = F.col("at") + 1  # Spark's blocks of bits count from one
    blocks = places.groupBy(F.bitmap_bucket_number(at).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    return KeySet(widths, None, {r["block"] - 1: bytes(r["bits"]) for r in blocks.collect()}, k)


def _candidates(shared):
    """(same, text) -> the windows of texts whose hash is in the set, with their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            same = np.array(batch.column(0))
            for p in W.pieces(batch.column(1), W.ALNUM, lower=True):
                h = p.hashes()
                for width in known.widths:
                    rolled = W.windows(h, width)
                    at = known.has(rolled)
                    at = at[W.inside_docs(p.first, width)[at]] if len(at) else at
                    doc = np.searchsorted(p.first, at, side="right") - 1
                    words = pa.array([_words_at(p, i, width) for i in at], pa.binary())
                    columns = [pa.array(same[p.lo + doc], pa.int64()), pa.array((at - p.first[doc]).astype(np.int32)), pa.array(np.full(len(at), width, np.int32)), pa.array(rolled[at].view(np.int64)), words]
                    yield pa.RecordBatch.from_arrays(columns, names=["same", "pos", "width", "key", "words"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(same, windows, items) -> the runs of words under the windows, and the items in order."""
    for batch in batches:
        runs, items = [], []
        for windows, ids in zip(batch.column(1), batch.column(2), strict=True):
            lo = np.array(windows.values.field(0))
            hi = lo + np.array(windows.values.field(1))
            order = np.argsort(lo, kind="stable")
            lo, hi = lo[order], np.maximum.accumulate(hi[order])
            apart = np.ones(len(lo), bool)
            apart[1:] = lo[1:] > hi[:-1]
            first = np.flatnonzero(apart)
            runs.append(np.stack([lo[first], hi[np.append(first[1:], len(hi)) - 1]], 1).reshape(-1))
            items.append(np.sort(ids.values.to_numpy()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.int64()))], names=["same", "hit", "items"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [p.counts for p in W.pieces(batch.column(batch.schema.get_field_index("text")), W.ALNUM, lower=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64))], names=[*batch.schema.names, "n_words"])


def _same():
    return F.xxhash64(F.col("text").cast("string"))


def text_hits(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, held: int = HELD) -> DataFrame:
    """``(same, hit, items)``: a row for each distinct text that holds a window of the benchmark; ``same`` is the text's xxhash64."""
    spark = docs.sparkSession
    items = text_of(benchmark, F.col("item_id").cast("long").alias("item_id")).filter("item_id is not null")
    found = cut(items.mapInArrow(_item_windows(width), "item_id long, width int, key long, words binary").distinct(), "windows")
    known = spark.sparkContext.broadcast(key_set(found, held))
    seen = text_of(docs, _same().alias("same")).mapInArrow(_candidates(known), "same long, pos int, width int, key long, words binary").dropDuplicates(["same", "pos", "width"])
    seen = cut(seen, "candidates")
    hot = hot_keys(seen, "key", MOST)
    true_ = dealt(seen, "key", hot, "same").join(copied(found, "key", hot), ["key", "salt", "width", "words"])
    hits = true_.groupBy("same").agg(F.collect_set(F.struct("pos", "width")).alias("windows"), F.collect_set("item_id").alias("items"))
    return cut(hits.mapInArrow(_runs, "same long, hit array<int>, items array<bigint>"), "hits")


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, *keep: str, width: int = WINDOW, held: int = HELD) -> DataFrame:
    """``docs(text, keep...)`` and ``benchmark(item_id, text)`` -> ``(keep..., text, hit, items, n_words)``, a row for each document.

    Words are runs of ASCII letters (A-Z lower-cased), digits and characters beyond ASCII.
    A window is ``width`` consecutive words of an item, or all words of a shorter one. ``hit``
    holds the runs of document words inside any occurrence of a window, as word numbers
    from, to, from, to, ...; ``items`` the ids, ascending, of the items with occurring windows.

    Null and empty texts have no words and no hits; items with a null id or without words
    take no part; repeated rows of an item count once. Rows of ``docs`` are not merged: each
    comes back with the kept columns as they were, whatever their number of words. An empty benchmark hits nothing.
    ``held`` is the number of hashes from which on tasks look up a Bloom filter.
    """
    hits = text_hits(docs, benchmark, width, held)
    ids = hits.select("same")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    given = text_of(docs, *keep).select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), "text", _same().alias("same"))  # so that no column's name can clash
    clean = given.join(ids, "same", "left_anti").withColumns({"hit": F.array().cast("array<int>"), "items": F.array().cast("array<bigint>")})
    some = given.join(ids, "same", "left_semi")
    hot = hot_keys(some, "same", MOST)
    met = dealt(some.withColumn("part", F.spark_partition_id()), "same", hot, "part").drop("part").join(copied(hits, "same", hot), ["same", "salt"])
    columns = [*(f"k{i}" for i in range(len(keep))), "text", "hit", "items"]
    both = clean.select(*columns).union(met.select(*columns))
    out = both.mapInArrow(_count_words, both.withColumn("n_words", F.lit(0).cast("bigint")).schema)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "text", "hit", "items", "n_words")


def _kept_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kept columns..., text, hit): the text without the stretches that its hit words span."""
    for batch in batches:
        text, hit = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1).to_pylist()
        out = []
        for p in W.pieces(text, W.ALNUM, lower=True):
            raw, offsets = W.text_buffers(text.slice(p.lo, p.hi - p.lo))
            for i in range(p.hi - p.lo):
                runs, base, at, parts = hit[p.lo + i], p.first[i], offsets[i], []
                for k in range(0, len(runs), 2):
                    parts.append(raw[at : p.starts[base + runs[k]]].tobytes())
                    at = p.ends[base + runs[k + 1] - 1]
                parts.append(raw[at : offsets[i + 1]].tobytes())
                out.append(b"".join(parts).decode() if text[p.lo + i].is_valid else None)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, pa.string())], names=batch.schema.names[:-1])


def contaminated(n_words: str = "n_words", n_hit: str = "n_hit"):
    """The contract's rule: some hit words, at least one in twenty."""
    return (F.col(n_hit) > 0) & (SHARE * F.col(n_hit) >= F.col(n_words))


def _n_hit(df: DataFrame) -> DataFrame:
    return df.withColumn("n_hit", F.expr("aggregate(transform(hit, (x, i) -> if(i % 2 = 1, x, -x)), 0L, (a, x) -> a + x)"))


def remove_spans(docs: DataFrame, benchmark: DataFrame, *keep: str) -> DataFrame:
    """``(keep..., text)``: each document without its hit stretches; other text is untouched."""
    found = benchmark_hits(docs, benchmark, *keep).select(*keep, "text", "hit")
    return found.mapInArrow(_kept_text, found.drop("hit").schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns as they were, whatever their names."""
    packed = docs.select(F.struct(*(c for c in docs.columns if c != "text")).alias("row"), F.col("text").alias("whole"), "text")
    clean = _n_hit(benchmark_hits(packed, benchmark, "row", "whole")).filter(~contaminated())
    return clean.select(*(F.col("whole").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: hit words and items of every document."""
    found = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id")
    return _n_hit(found.drop("text")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.col("items").cast("array<string>")), ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


ORACLE_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w from benchmark
), win as (
  select distinct item_id, least(13, len(w)) as width, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') as s
  from (select item_id, w, unnest(range(1, greatest(2, len(w) - 11))) as i from b where len(w) > 0)
), pos as (
  select doc_id, w, x.width, i from d, (select distinct width from win) x, lateral (select unnest(range(1, len(w) - x.width + 2)) as i) where len(w) >= x.width
), hits as (
  select p.doc_id, p.i, p.width, win.item_id
  from (select doc_id, i, width, array_to_string(w[i : i + width - 1], ' ') as s from pos) p join win using (width, s)
), per as (
  select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + width)) as k from hits) group by doc_id
), its as (
  select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from hits group by doc_id
)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
from d left join per using (doc_id) left join its using (doc_id)
"""
