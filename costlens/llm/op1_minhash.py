"""1. Near-duplicate documents by MinHash, banding, verification and connected components.

Plan: a map stage turns each text into the digest of its set of 5-word shingles, a 128-bit
sketch and 32 band keys made from 128 universal hash minima. Documents with equal digests
meet in one pre-aggregated group, so any number of copies costs one node. Nodes that share
a band bucket are compared with the bucket's best connected node, not with each other; a
sketch test and then the exact sets confirm each link. Nodes of buckets that still hold several
components afterwards are looked at once more: a document of n shingles can only link to another component if
0.75 n of them occur in other components, and then its rarest such shingles meet those of its partner. That prefix filter
loses no pair, and it passes over templated documents, whose shared part is too small. A link is thus
lost only if no band agrees (4e-6 at a similarity of 0.75) or the sketch differs in over 40 of 128 bits
(under 1e-9 there). Keys with many rows are dealt to several tasks. Components are closed by
large-star and small-star rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import copied, cut, dealt, hot_counts, hot_keys, semi, table, text_of
from .components import components

SHINGLE, SIMILAR_PERCENT = 5, 75
BANDS, ROWS = 32, 4
SKETCH_BITS = 40
#: Rows of one key that one task handles.
MOST = 128
_RNG = np.random.Generator(np.random.PCG64(71))
_MUL = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sizes, hashes): the sorted distinct shingle hashes of some documents, one after another."""
    for p in W.pieces(column, W.SPACED, lower=True):
        h = p.hashes()
        rolled = W.windows(h, width)
        rolled = rolled[W.inside_docs(p.first, width)] if len(rolled) else rolled
        counts = p.counts
        per = np.maximum(counts - width + 1, 0)
        at = np.concatenate([[0], np.cumsum(per)])
        out = []
        for i, n in enumerate(counts):
            if n >= width:
                out.append(np.unique(rolled[at[i] : at[i + 1]]))
            elif n:
                out.append(W.windows(h[p.first[i] : p.first[i + 1]], int(n)) ^ np.uint64(n))
            else:
                out.append(np.zeros(0, np.uint64))
        yield p.lo, np.array([len(x) for x in out], np.int64), np.concatenate(out) if out else np.zeros(0, np.uint64)


def _minima(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Minima of universal hashes, a row for each non-empty set."""
    full = sizes[sizes > 0]
    at = np.concatenate([[0], np.cumsum(full)[:-1]]).astype(np.int64)
    out = np.empty((len(full), BANDS * ROWS), np.uint32)
    low = hashes >> np.uint64(1)
    work, short = np.empty_like(low), np.empty(len(low), np.uint32)
    for k in range(BANDS * ROWS):
        np.multiply(low, _MUL[k], out=work)
        np.add(work, _ADD[k], out=work)
        np.right_shift(work, np.uint64(32), out=work)
        short[:] = work
        out[:, k] = np.minimum.reduceat(short, at)
    return out


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        weight |= np.uint64(1)
        for batch in batches:
            for lo, sizes, hashes in _sets(batch.column(1), width):
                full = sizes > 0
                d1, d2, s1, s2 = (np.zeros(len(sizes), np.uint64) for _ in range(4))
                keys = np.zeros((0, BANDS), np.uint64)
                if full.any():
                    at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]]).astype(np.int64)
                    d1[full] = np.add.reduceat(W.mix(hashes), at)
                    d2[full] = np.add.reduceat(W.mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
                    low = _minima(hashes, sizes)
                    bit = (W.mix(low.astype(np.uint64)) & np.uint64(1)).astype(np.uint64) << (np.arange(BANDS * ROWS, dtype=np.uint64) % np.uint64(64))
                    s1[full], s2[full] = bit[:, :64].sum(1, dtype=np.uint64), bit[:, 64:].sum(1, dtype=np.uint64)
                    band = (W.mix(low.astype(np.uint64) + np.uint64(1)).reshape(-1, BANDS, ROWS) * weight).sum(2, dtype=np.uint64)
                    keys = W.mix(band + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
                per = np.where(full, BANDS, 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(sizes)), pa.array(sizes), *(pa.array(x.view(np.int64)) for x in (d1, d2, s1, s2)), W.list_column(keys.reshape(-1).view(np.int64), per, pa.int64())],
                    names=["doc_id", "n_shingles", "d1", "d2", "s1", "s2", "bands"],
                )

    return run


def _shingle_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, sizes, hashes in _sets(batch.column(1), width):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(sizes)), W.list_column(hashes.view(np.int64), sizes, pa.int64())], names=["node", "shingles"])

    return run


def _with_sets(pairs: DataFrame, sets: DataFrame, end: str) -> DataFrame:
    """``pairs`` with the set of the node in column ``end``; a node of many pairs is met in several tasks."""
    hot = hot_keys(pairs, end, MOST)
    own = sets.select(F.col("node").alias(end), F.col("shingles").alias(f"set_{end}"))
    return dealt(pairs, end, hot, "a", "b").join(copied(own, end, hot), [end, "salt"]).drop("salt")


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are similar enough."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "pair-nodes")
    sets = cut(semi(texts, ids, "node").mapInArrow(_shingle_sets(width), "node long, shingles array<long>"), "sets")
    both = F.size(F.array_intersect("set_a", "set_b"))
    linked = _with_sets(_with_sets(pairs, sets, "b"), sets, "a").filter(100 * both >= percent * (F.size("set_a") + F.size("set_b") - both))
    return linked.select("a", "b").distinct()


def across(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``nodes(node, s1, s2, component)`` and ``sets(node, shingles)`` -> pairs (a, b) of different components that may be similar enough.

    Both of a similar pair have ``percent`` per cent of their shingles in common. Only shingles in several components count as common ones;
    with those sorted by their number of nodes, the first c - need + 1 of a node's c hold at least one of any partner's first ones. Where
    a pair first meets, what comes after in both lists bounds the intersection, which rules out most pairs before they are made rows.
    """
    sets = sets.withColumn("set", F.xxhash64("shingles")).dropDuplicates(["node", "set"])  # a repeated doc_id may have several
    flat = sets.join(nodes.select("node", "component"), "node").select("node", "component", "set", F.size("shingles").alias("size"), F.explode("shingles").alias("token"))
    often = flat.groupBy("token").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("token", "n")
    often = cut(often, "crossing")
    hot = hot_counts(often, "token", MOST)
    held = dealt(flat, "token", hot, "node").join(copied(often, "token", hot), ["token", "salt"]).groupBy("node", "set", "size").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("held"))
    need = F.ceil(F.col("size") * percent / 100)
    first = held.withColumn("k", (F.size("held") - need + 1).cast("int")).filter("k > 0")
    first = first.select("node", "size", F.size("held").alias("c"), F.posexplode(F.slice("held", 1, F.col("k"))).alias("pos", "x"))
    first = cut(first.join(nodes, "node").select(F.col("x.token").alias("token"), "node", "size", (F.col("c") - F.col("pos")).alias("left"), "s1", "s2", "component"), "prefixes")
    # a token's nodes meet in blocks of MOST by MOST
    hot = hot_keys(first, "token", MOST)
    rows = copied(dealt(first, "token", hot, "node").withColumnRenamed("salt", "row"), "token", hot).withColumnRenamed("salt", "column")
    columns = copied(dealt(first, "token", hot, "node").withColumnRenamed("salt", "column"), "token", hot).withColumnRenamed("salt", "row")
    columns = columns.select("token", "row", "column", *(F.col(c).alias(f"{c}_") for c in ("node", "size", "left", "s1", "s2", "component")))
    near = F.bit_count(F.expr("s1 ^ s1_")) + F.bit_count(F.expr("s2 ^ s2_")) <= SKETCH_BITS
    enough = F.least("left", "left_") * (100 + percent) >= (F.col("size") + F.col("size_")) * percent
    met = rows.join(columns, ["token", "row", "column"]).filter((F.col("node") < F.col("node_")) & (F.col("component") != F.col("component_")) & enough & near)
    return met.select(F.col("node").alias("a"), F.col("node_").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = SHINGLE, percent: int = SIMILAR_PERCENT) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, n_shingles, component_id, kept)``, a row for each row of ``docs``.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; a document's set
    holds its distinct runs of ``width`` words, or all its words as one where there are fewer.
    Documents link when the sets' intersection is at least ``percent`` per cent of their union.

    Null and blank texts have an empty set and link with nothing. Repeated rows of a doc_id
    get the same class and count as one document, whatever their texts. A null doc_id
    can't name a class: component_id and kept are null there. Columns other than doc_id and
    text are ignored. No rows give no rows.
    """
    texts = text_of(docs, F.col("doc_id").cast("long").alias("doc_id"))
    schema = "doc_id long, n_shingles long, d1 long, d2 long, s1 long, s2 long, bands array<long>"
    signed = cut(texts.mapInArrow(_signatures(width), schema), "signatures")
    named = signed.filter("n_shingles > 0 and doc_id is not null")
    nodes = cut(named.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.first("s1").alias("s1"), F.first("s2").alias("s2"), F.first("bands").alias("bands")), "nodes")
    posted = nodes.select("node", "s1", "s2", F.explode("bands").alias("key"))
    shared = cut(posted.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    hot = cut(hot_counts(shared, "key", MOST), "hot-buckets")
    members = cut(dealt(posted, "key", hot, "node").join(copied(shared, "key", hot), ["key", "salt"]), "buckets")
    ranked = members.join(members.groupBy("node").agg(F.sum("n").alias("degree")), "node")
    centres = ranked.groupBy("key").agg(F.max(F.struct("degree", -F.col("node"), "s1", "s2")).alias("c"))
    centres = centres.select("key", (-F.col("c.col2")).alias("c"), F.col("c.s1").alias("c1"), F.col("c.s2").alias("c2"))
    near = F.bit_count(F.expr("s1 ^ c1")) + F.bit_count(F.expr("s2 ^ c2")) <= SKETCH_BITS
    pair = [F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")]
    starred = members.join(copied(centres, "key", hot), ["key", "salt"]).filter((F.col("node") != F.col("c")) & near)
    starred = cut(starred.select(*pair).distinct(), "star-pairs")
    by_node = texts.select(F.col("doc_id").alias("node"), "text")
    links = cut(_confirmed(starred, by_node, width, percent), "links")
    found = components(links)

    # what the stars leave open: nodes of buckets whose members are still in different components
    at = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_keys = at.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    open_ = cut(dealt(at.drop("salt"), "key", hot, "node").join(copied(open_keys, "key", hot), ["key", "salt"]).select("node", "s1", "s2", "component").distinct(), "open")
    sets = cut(semi(by_node, open_.select("node"), "node").mapInArrow(_shingle_sets(width), "node long, shingles array<long>"), "open-sets")
    rest = cut(across(open_, sets, percent).join(starred, ["a", "b"], "left_anti"), "rest-pairs")
    if not rest.isEmpty():
        links = links.union(_confirmed(rest, by_node, width, percent))
        found = components(links)

    # every document of a node, then the documents that share an id across nodes
    owner = named.select("doc_id", "d1", "d2").join(nodes.select("d1", "d2", "node"), ["d1", "d2"])
    owner = owner.join(found, "node", "left").select("doc_id", F.coalesce("component", "node").alias("c"))
    owner = cut(owner.distinct(), "owners")
    if not owner.groupBy("doc_id").count().filter("count > 1").isEmpty():
        found = components(owner.select(F.col("doc_id").alias("a"), F.col("c").alias("b")))
        owner = owner.select("doc_id").distinct().join(found, owner["doc_id"] == found["node"], "left").select("doc_id", F.coalesce("component", "doc_id").alias("c"))
    out = signed.select("doc_id", "n_shingles").join(owner, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that represent their near-duplicate class, all columns as they were.

    Rows with a null doc_id stay. Repeated rows of a kept doc_id stay too.
    """
    gone = near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the class of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), sh as (
  select distinct doc_id, case when len(w) >= 5 then array_to_string(w[i : i + 4], ' ') else array_to_string(w, ' ') end as g
  from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) as i from d where len(w) > 0)
), sizes as (
  select doc_id, count(*) as n from sh group by doc_id
), pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id
), links as (
  select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)
), both_ways as (
  select a, b from links union all select b, a from links
), reach as (
  select a, b from both_ways union select r.a, e.b from reach r join both_ways e on r.b = e.a
), least_ as (
  select a as doc_id, min(b) as b from reach group by a
)
select d.doc_id, coalesce(n, 0) as n_shingles, least(d.doc_id, coalesce(b, d.doc_id)) as component_id, d.doc_id = least(d.doc_id, coalesce(b, d.doc_id)) as kept
from d left join sizes using (doc_id) left join least_ using (doc_id)
"""
