"""9. Repeated long passages by a compacted de Bruijn graph of words.

Edges of the graph are runs of 35 words, nodes the 34 words that two neighbours share. A word of the corpus
has one coordinate, a 64-bit number: its text's base plus its place in the text.

1. A map stage takes a digest of each text and its anchors: of the 18-word hashes inside a
   window, the least one. Equal windows have equal anchors, and about one word in ten is one.
   Equal texts meet by their digest first and count as one text with a weight. Anchors seen once rule
   out their windows; only texts with repeated anchors are read again, and only windows there become edges.
2. Edges (from node, to node) are summed; those that repeat keep their least coordinate as the source.
   The in- and outdegree of each node are counted. A node with one edge in and one out is unbranched: where its two
   edges follow each other in the source text too they belong to one stretch of it, and where they don't, two
   stretches are joined. The stretches that hang together are one path; joins by large-star and small-star find them.
3. The occurrences of repeated edges are gathered into runs that keep pace with the source, and runs are cut at the
   ends of stretches. The words of each piece are compared with the words at its source coordinates, by SHA-256.
   Where any differ, two windows share a hash; then the windows concerned are counted anew by their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import copied, cut, dealt, hot_keys, semi, table, text_of
from .components import components

WINDOW, ANCHOR = 35, 18
#: Bits of a coordinate: words of one slot (a longer text takes several), and slots of one task of the first stage.
SLOT_BITS, TASK_BITS = 14, 26
#: Coordinates of one block when runs meet the stretches that they overlap; rows of one key that one task handles.
BLOCK_BITS, MOST = 6, 4096
_LOW = np.uint64((1 << 24) - 1)


def _anchors(p: W.Piece, h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, number of the anchor of each, anchor hashes, anchors of each document)."""
    starts = np.flatnonzero(W.inside_docs(p.first, width))
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64), np.zeros(p.hi - p.lo, np.int64)
    size = min(ANCHOR, width)
    grams = W.windows(h, size)
    low = (grams & ~_LOW) | (np.arange(len(grams), dtype=np.uint64) & _LOW)  # ties go to the first
    span, reach = width - size + 1, 1
    while 2 * reach <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if span > reach:
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    at = starts + (((low[starts] & _LOW).astype(np.int64) - starts) & int(_LOW))
    doc = np.searchsorted(p.first, starts, side="right") - 1
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    return starts, np.cumsum(fresh) - 1, grams[at[fresh]], np.bincount(doc[fresh], minlength=p.hi - p.lo)


def _twice_at_most(found: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's anchors, sorted, no hash more than twice: twice is enough to tell that it repeats."""
    doc = np.repeat(np.arange(len(per)), per)
    order = np.lexsort((found, doc))
    found, doc = found[order], doc[order]
    keep = np.ones(len(found), bool)
    keep[2:] = (found[2:] != found[:-2]) | (doc[2:] != doc[:-2])
    return found[keep], np.bincount(doc[keep], minlength=len(per))


def _digests(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each document's word sequence; both depend on its order."""
    n = np.diff(first)
    place = (np.arange(len(h)) - np.repeat(first[:-1], n)).astype(np.uint64)
    out = []
    for salt in (np.uint64(0x9FB21C651E98DF25), np.uint64(0xC13FA9A902A6328F)):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(W.mix(h + W.mix(place + salt)), out=total[1:])
        out.append(W.mix(total[first[1:]] - total[first[:-1]] + n.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _read(width: int):
    """A digest, the base coordinate, the SHA-256 of its words and the anchors of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, slot = TaskContext.get().partitionId(), 0
        for batch in batches:
            for p in W.pieces(batch.column(3), W.SPACED, lower=False):
                h = p.hashes()
                _, _, found, per = _anchors(p, h, width)
                found, per = _twice_at_most(found, per)
                t1, t2 = _digests(h, p.first)
                raw, offsets = W.text_buffers(batch.column(3).slice(p.lo, p.hi - p.lo))
                sha = [hashlib.sha256(b" ".join(raw[offsets[i] : offsets[i + 1]].tobytes().split())).hexdigest() for i in range(p.hi - p.lo)]
                slots = (p.counts >> SLOT_BITS) + 1
                base = ((task << TASK_BITS) + slot + np.cumsum(slots) - slots) << SLOT_BITS
                slot += int(slots.sum())
                if slot >> TASK_BITS or task >> (63 - SLOT_BITS - TASK_BITS):
                    raise OverflowError("a task of the first stage has too many texts: read the table in smaller splits")
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(p.lo, p.hi - p.lo) for k in range(3)), pa.array(base.astype(np.int64)), pa.array(p.counts), pa.array(t1), pa.array(t2), pa.array(sha), W.list_column(found.view(np.int64), per, pa.int64())],
                    names=["doc_id", "nameless", "same", "base", "n_words", "t1", "t2", "sha", "anchors"],
                )

    return run


def _edges(width: int, bits: int):
    """(text, base, t1, t2, weight, repeated anchors) -> the windows at those anchors as edges from node u to node v."""
    mask = np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases, want1, want2, weights = (np.array(batch.column(k)) for k in (1, 2, 3, 4))
            repeated = batch.column(5)
            for p in W.pieces(batch.column(0), W.SPACED, lower=False):
                h = p.hashes()
                starts, which, found, per = _anchors(p, h, width)
                t1, t2 = _digests(h, p.first)
                first = np.concatenate([[0], np.cumsum(per)])
                on = np.zeros(len(found), bool)
                for i in range(p.hi - p.lo):
                    if t1[i] == want1[p.lo + i] and t2[i] == want2[p.lo + i]:
                        on[first[i] : first[i + 1]] = np.isin(found[first[i] : first[i + 1]], repeated[p.lo + i].values.to_numpy().view(np.uint64))
                at = starts[on[which]] if len(starts) else starts
                doc = np.searchsorted(p.first, at, side="right") - 1
                node = W.windows(h, width - 1) & mask
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(node[at].view(np.int64)),
                        pa.array(node[at + 1].view(np.int64)),
                        pa.array(bases[p.lo + doc]),
                        pa.array((at - p.first[doc]).astype(np.int32)),
                        pa.array(weights[p.lo + doc]),
                    ],
                    names=["u", "v", "base", "pos", "weight"],
                )

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(base, coordinates of repeated edges and of their sources) -> runs of n edges that keep pace with the source, none over a slot's end."""
    for batch in batches:
        out = []
        for base, spots in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            pos, src = np.array(spots.values.field(0)), np.array(spots.values.field(1))
            pos, first = np.unique(pos, return_index=True)
            src = src[first]
            fresh = np.ones(len(pos), bool)
            fresh[1:] = (pos[1:] != pos[:-1] + 1) | (src[1:] != src[:-1] + 1) | (src[1:] >> SLOT_BITS != src[:-1] >> SLOT_BITS)
            begin = np.flatnonzero(fresh)
            out.append((np.full(len(begin), base), pos[begin], np.diff(np.append(begin, len(pos))).astype(np.int32), src[begin]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["base", "pos", "n", "src"])


def _range_digests(width: int):
    """(text, ranges of edges) -> two halves of a SHA-256 of the words under each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in W.pieces(batch.column(0), W.SPACED, lower=False):
                out = []
                for i in range(p.hi - p.lo):
                    ranges, at = batch.column(1)[p.lo + i].values, p.first[i]
                    pos, n, src, own = (np.array(ranges.field(k)) for k in range(4))
                    ok = pos + n + width - 1 <= p.counts[i]
                    for a, b, s, o in zip(p.starts[at + pos[ok]], p.ends[at + pos[ok] + n[ok] + width - 2], src[ok], own[ok], strict=True):
                        d = hashlib.sha256(b" ".join(p.data[a:b].tobytes().split())).digest()
                        out.append((s, o, int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:16], "big", signed=True)))
                    n_of = n[ok]
                    out[len(out) - len(n_of) :] = [(*x, m) for x, m in zip(out[len(out) - len(n_of) :], n_of.tolist(), strict=True)]
                cols = list(zip(*out, strict=True)) or [(), (), (), (), ()]
                kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["src", "own", "s1", "s2", "n"])

    return run


def _window_digests(width: int):
    """(text, base, weight, positions) -> a SHA-256 of the words of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in W.pieces(batch.column(0), W.SPACED, lower=False):
                base, pos, weight, sha = [], [], [], []
                for i in range(p.hi - p.lo):
                    for k in batch.column(3)[p.lo + i].values.to_pylist():
                        at = p.first[i] + k
                        if k + width <= p.counts[i]:
                            sha.append(hashlib.sha256(b" ".join(p.data[p.starts[at] : p.ends[at + width - 1]].tobytes().split())).digest())
                            base.append(batch.column(1)[p.lo + i].as_py())
                            weight.append(batch.column(2)[p.lo + i].as_py())
                            pos.append(k)
                yield pa.RecordBatch.from_arrays([pa.array(base, pa.int64()), pa.array(pos, pa.int32()), pa.array(weight, pa.int32()), pa.array(sha, pa.binary())], names=["base", "pos", "weight", "sha"])

    return run


def _covered(width: int):
    """(base, pieces) -> runs of words under the text's repeated windows, as word numbers from, to, ..."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pieces in batch.column(1):
                lo, hi = np.array(pieces.values.field(0)), np.array(pieces.values.field(1)) + np.array(pieces.values.field(0)) + width - 1
                order = np.argsort(lo, kind="stable")
                lo, hi = lo[order], np.maximum.accumulate(hi[order])
                apart = np.ones(len(lo), bool)
                apart[1:] = lo[1:] > hi[:-1]
                first = np.flatnonzero(apart)
                out.append(np.stack([lo[first], hi[np.append(first[1:], len(hi)) - 1]], 1).reshape(-1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["base", "runs"])

    return run


def _key():
    """A row's doc_id (for a null one a hash of its text) and a hash of its text: rows that share both are copies."""
    text = F.col("text").cast("string")
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text)).alias("doc_id"), F.xxhash64(text).alias("same")


def compact(repeated: DataFrame) -> DataFrame:
    """``repeated(u, v, src)``, the distinct repeated edges -> ``(path, start, end)``: stretches of source coordinates, and the path of each.

    A stretch runs from the edge at ``start`` to the edge before ``end`` and its inner nodes have one repeated edge in and
    one out. Stretches that follow each other over such a node are one path; ``path`` is the least of their
    starts. A cycle without a branch is a path too.
    """
    sides = repeated.select(F.col("v").alias("node"), F.col("src").alias("tail"), F.lit(None).cast("long").alias("head"))
    sides = sides.union(repeated.select(F.col("u").alias("node"), F.lit(None).cast("long"), F.col("src")))
    nodes = sides.groupBy("node").agg(F.count("tail").alias("ins"), F.count("head").alias("outs"), F.max("tail").alias("tail"), F.max("head").alias("head"))
    plain = (F.col("ins") == 1) & (F.col("outs") == 1) & (F.col("head") == F.col("tail") + 1) & (F.col("head").bitwiseAND((1 << SLOT_BITS) - 1) != 0)
    odd = cut(nodes.filter(~F.coalesce(plain, F.lit(False))), "odd-nodes")  # what is left are ends, branches and jumps
    ends_at = lambda side, edge, count: odd.filter(f"{count} = 1").select(F.col(side).alias("src")).union(repeated.join(odd.filter(f"{count} > 1").select(F.col("node").alias(edge)), edge, "left_semi").select("src"))
    slot = F.shiftright("src", SLOT_BITS)
    starts = ends_at("head", "u", "outs").groupBy(slot.alias("slot")).agg(F.sort_array(F.collect_list("src")).alias("starts"))  # one text's, at most SLOT_BITS of them
    ends = ends_at("tail", "v", "ins").groupBy(slot.alias("slot")).agg(F.sort_array(F.collect_list("src")).alias("ends"))
    # stretches of a slot don't overlap, so the n-th start belongs to the n-th end
    stretches = cut(starts.join(ends, "slot").select(F.explode(F.arrays_zip("starts", "ends")).alias("x")).select(F.col("x.starts").alias("start"), F.col("x.ends").alias("last")), "stretches")
    jumps = odd.filter("ins = 1 and outs = 1").select(F.col("tail").alias("last"), F.col("head").alias("b"))
    joined = components(jumps.join(stretches, "last").select(F.col("start").alias("a"), "b"))
    out = stretches.join(joined.withColumnRenamed("node", "start"), "start", "left")
    return cut(out.select(F.coalesce("component", "start").alias("path"), "start", (F.col("last") + 1).alias("end")), "paths")


def _pieces(runs: DataFrame, paths: DataFrame) -> DataFrame:
    """``runs(base, pos, n, src)`` cut where stretches end, each piece with its path; both sides meet by blocks of coordinates."""
    blocks = lambda lo, hi: F.explode(F.sequence(F.shiftright(lo, BLOCK_BITS), F.shiftright(hi - 1, BLOCK_BITS)))
    a = runs.withColumn("block", blocks(F.col("src"), F.col("src") + F.col("n")))
    b = paths.withColumn("block", blocks(F.col("start"), F.col("end")))
    hot = hot_keys(a, "block", MOST)
    met = dealt(a, "block", hot, "base", "pos").join(copied(b, "block", hot), ["block", "salt"])
    lo, hi = F.greatest("src", "start"), F.least(F.col("src") + F.col("n"), F.col("end"))
    met = met.filter((lo < hi) & (F.shiftright(lo, BLOCK_BITS) == F.col("block")))  # each overlap once, in its first block
    return met.select("base", (F.col("pos") + (lo - F.col("src"))).cast("int").alias("pos"), (hi - lo).cast("int").alias("n"), lo.alias("src"), "path")


def _gathered(rows: DataFrame, texts: DataFrame, known: DataFrame, what, name: str) -> DataFrame:
    """``rows(base, ...)`` gathered in one list for each text, a long list in parts, beside the text."""
    hot = hot_keys(rows, "base", MOST)
    lists = dealt(rows, "base", hot, *[c for c in rows.columns if c != "base"]).groupBy("base", "salt").agg(F.collect_list(what).alias(name))
    lists = cut(lists.join(known, "base"), name)
    return semi(texts, lists.select("doc_id").distinct(), "doc_id").join(lists, ["doc_id", "same"])


def _wrong(pieces: DataFrame, texts: DataFrame, known: DataFrame, long_: DataFrame, width: int) -> DataFrame:
    """The slots of source coordinates at which some piece has other words than its source."""
    asked = pieces.select("src", "n").distinct().withColumn("slot", F.shiftright("src", SLOT_BITS)).join(long_, "slot", "left")
    asked = asked.select(F.coalesce("base", F.shiftleft("slot", SLOT_BITS)).alias("base"), "src", "n")
    spot = lambda own: ["base", "pos", "n", "src", F.lit(own).alias("own")]
    every = pieces.select(*spot(True)).union(asked.withColumn("pos", (F.col("src") - F.col("base")).cast("int")).select(*spot(False)))
    read = _gathered(every, texts, known, F.struct("pos", "n", "src", "own"), "ranges").select("text", "ranges")
    told = read.mapInArrow(_range_digests(width), "src long, own boolean, s1 long, s2 long, n int")
    same = told.groupBy("src", "n").agg(F.count_if(~F.col("own")).alias("seen"), *(f(c).alias(f"{c}_{k}") for c in ("s1", "s2") for k, f in (("lo", F.min), ("hi", F.max))))
    return same.filter("seen = 0 or s1_lo <> s1_hi or s2_lo <> s2_hi").select(F.shiftright("src", SLOT_BITS).alias("slot")).distinct()


def _by_words(edges: DataFrame, repeated: DataFrame, slots: DataFrame, texts: DataFrame, known: DataFrame, width: int) -> DataFrame:
    """``(base, pos)`` of the windows with a source in ``slots`` whose words do repeat: counted by the words."""
    some = repeated.withColumn("slot", F.shiftright("src", SLOT_BITS)).join(slots, "slot", "left_semi").select("u", "v")
    spots = cut(edges.join(some, ["u", "v"]).select("base", "pos", "weight"), "doubtful")
    read = _gathered(spots.select("base", "pos"), texts, known, F.col("pos"), "windows").select("text", "base", "copies", "windows")
    told = cut(read.mapInArrow(_window_digests(width), "base long, pos int, weight int, sha binary").dropDuplicates(["base", "pos"]), "words")
    return told.join(told.groupBy("sha").agg(F.sum("weight").alias("n")).filter("n > 1"), "sha", "left_semi").select("base", "pos")


def repeated_spans(docs: DataFrame, width: int = WINDOW, bits: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``docs(doc_id, text, ...)`` -> (texts, spans, paths).

    ``texts(base, doc_id, same, nameless, n_words, sha, copies)``: a row for each row of ``docs``; ``base`` is the coordinate of its first word, a
    null doc_id is marked ``nameless``, ``same`` is a hash of the text, ``copies`` the rows that share its word sequence, ``sha`` the SHA-256 of its
    words joined by one space. ``spans(base, doc_id, same, runs)``: for texts that occur once and hold repeated
    windows of ``width`` words, the runs of words they cover as word numbers from, to, .... In a text of
    ``width`` words or more with copies over 1 every word is covered; such texts have no row in ``spans``.
    ``paths(path, start, end, base, pos, n)``: each piece of a text that lies on a path of the compacted graph, with the stretch of
    source coordinates that it repeats; a text with copies stands for all of them.

    Words are runs of bytes other than ASCII white space, as they are. Null and blank texts have no
    words; texts under ``width`` words have no window; a row repeated whole is a copy of itself. ``width`` is 2 or more.
    ``bits`` shortens the hashes of nodes, for tests of what happens when two windows share one.
    """
    texts = text_of(docs, *_key(), F.col("doc_id").isNull().alias("nameless")).select("doc_id", "nameless", "same", "text")
    found = cut(texts.mapInArrow(_read(width), "doc_id long, nameless boolean, same long, base long, n_words long, t1 long, t2 long, sha string, anchors array<long>"), "texts")
    nodes = cut(found.filter(F.col("n_words") >= width).groupBy("t1", "t2").agg(F.count("*").cast("int").alias("copies"), F.min("base").alias("base")), "nodes")
    posted = cut(found.select("base", "anchors").join(nodes.select("base", "copies"), "base").select("base", "copies", F.explode("anchors").alias("anchor")), "anchors")
    again = cut(posted.groupBy("anchor").agg(F.sum("copies").alias("n")).filter("n > 1").select("anchor"), "repeated")
    wanted = posted.join(again, "anchor").groupBy("base").agg(F.collect_set("anchor").alias("repeated"))
    wanted = cut(wanted.join(nodes, "base").join(found.select("base", "doc_id", "same", "n_words"), "base"), "wanted")
    known = wanted.select("base", "doc_id", "same", "copies")
    plain = texts.select("doc_id", "same", "text")
    some = semi(plain, wanted.select("doc_id").distinct(), "doc_id")
    read = some.join(wanted, ["doc_id", "same"]).select("text", "base", "t1", "t2", "copies", "repeated")
    edges = cut(read.mapInArrow(_edges(width, bits), "u long, v long, base long, pos int, weight int"), "edges")
    repeated = edges.groupBy("u", "v").agg(F.sum("weight").alias("n"), F.min(F.col("base") + F.col("pos")).alias("src")).filter("n > 1")
    repeated = cut(repeated.select("u", "v", "src"), "repeated-edges")
    paths = compact(repeated)

    spots = edges.join(repeated, ["u", "v"]).groupBy("base").agg(F.collect_list(F.struct("pos", "src")).alias("spots"))
    runs = cut(spots.mapInArrow(_runs, "base long, pos int, n int, src long"), "runs")
    pieces = cut(_pieces(runs, paths), "pieces")
    long_ = wanted.filter(F.col("n_words") >= 1 << SLOT_BITS).select("base", F.explode(F.sequence(F.shiftright("base", SLOT_BITS), F.shiftright(F.col("base") + F.col("n_words"), SLOT_BITS))).alias("slot"))
    wrong = cut(_wrong(pieces, plain, known, long_, width), "wrong")
    if not wrong.isEmpty():  # two windows share a hash there
        sure = pieces.withColumn("slot", F.shiftright("src", SLOT_BITS)).join(wrong, "slot", "left_anti").drop("slot")
        true_ = _by_words(edges, repeated, wrong, plain, known, width)
        pieces = cut(sure.unionByName(true_.select("base", "pos", F.lit(1).alias("n")), allowMissingColumns=True), "true-pieces")
    alone = known.filter("copies = 1").select("base", "doc_id", "same")
    spans = pieces.join(alone.select("base"), "base", "left_semi").groupBy("base").agg(F.collect_list(F.struct("pos", "n")).alias("pieces"))
    spans = cut(spans.mapInArrow(_covered(width), "base long, runs array<int>").join(alone, "base"), "spans")
    every = found.select("base", "doc_id", "same", "nameless", "n_words", "sha", "t1", "t2").join(nodes.select("t1", "t2", "copies"), ["t1", "t2"], "left")
    return every.drop("t1", "t2").withColumn("copies", F.coalesce("copies", F.lit(1))), spans, pieces


def _without(digest: bool):
    """(kept columns..., text, runs) -> the rest of each text, or the digest of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.num_columns - 2
            text, spans = batch.column(k), batch.column(k + 1)
            for p in W.pieces(text, W.SPACED, lower=False):
                raw, offsets = W.text_buffers(text.slice(p.lo, p.hi - p.lo))
                out = []
                for i in range(p.hi - p.lo):
                    runs = spans[p.lo + i].as_py()
                    if runs is None and not digest:
                        out.append(text[p.lo + i].as_py())
                        continue
                    base, at, rest = p.first[i], offsets[i], []
                    for j in range(0, len(runs or ()), 2):
                        rest.append(raw[at : p.starts[base + runs[j]]].tobytes())
                        at = p.ends[base + runs[j + 1] - 1]
                    rest.append(raw[at : offsets[i + 1]].tobytes())
                    whole = b"".join(rest)
                    out.append(hashlib.sha256(b" ".join(whole.split())).hexdigest() if digest else whole.decode())
                yield pa.RecordBatch.from_arrays([*(c.slice(p.lo, p.hi - p.lo) for c in batch.columns[:k]), pa.array(out, pa.string())], names=[*batch.schema.names[:k], "text"])

    return run


def remove_repeats(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """``docs`` with every word under a repeated window cut out of ``text``, and n_chars (where there is one) set anew.

    Every row stays, those left empty too; the white space beside removed words stays; a null text stays null.
    Columns may have any names, and rows may repeat.
    """
    texts, spans, _ = repeated_spans(docs, width)
    whole = texts.filter(f"copies > 1 and n_words >= {width}").select("doc_id", "same", F.array(F.lit(0), F.col("n_words").cast("int")).alias("runs")).distinct()
    every = spans.select("doc_id", "same", "runs").union(whole)
    packed = docs.select(F.struct(*(c for c in docs.columns if c != "text")).alias("row"), "text", *_key())  # so that no column's name can clash
    joined = packed.join(every, ["doc_id", "same"], "left").select("row", "text", "runs")
    out = joined.mapInArrow(_without(digest=False), joined.drop("runs").schema)
    length = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return out.select(*(F.col(c) if c == "text" else length.alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: what stays of every document."""
    docs = table(spark, sf_dir, "documents")
    texts, spans, _ = repeated_spans(docs)
    some = semi(text_of(docs, *_key()), spans.select("doc_id").distinct(), "doc_id")
    read = some.join(spans, ["doc_id", "same"]).select("base", "text", "runs")
    kept = read.mapInArrow(_without(digest=True), "base long, text string").withColumnRenamed("text", "left_sha")
    removed = spans.select("base", F.expr("aggregate(transform(runs, (x, i) -> if(i % 2 = 1, x, -x)), 0L, (a, x) -> a + x)").alias("n_removed"))
    all_ = (F.col("copies") > 1) & (F.col("n_words") >= WINDOW)
    return texts.join(kept.join(removed, "base"), "base", "left").select(
        F.when(~F.col("nameless"), F.col("doc_id")).alias("doc_id"),
        "n_words",
        F.when(all_, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(all_, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("left_sha", "sha")).alias("kept_sha256"),
    )


ORACLE_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), win as (
  select doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) as s from (select doc_id, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35)
), rep as (
  select doc_id, i from win join (select s from win group by s having count(*) > 1) using (s)
), gone as (
  select distinct doc_id, unnest(range(i, i + 35)) as k from rep
), words as (
  select doc_id, unnest(w) as word, generate_subscripts(w, 1) as k from d
), kept as (
  select doc_id, string_agg(word, ' ' order by k) as t, count(*) as n from words anti join gone using (doc_id, k) group by doc_id
)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(len(d.w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (doc_id)
"""
