"""11. Best-fit packing of tokenised documents into sequences of a fixed capacity.

A piece is known by its length alone, and lengths are whole numbers up to the capacity. So the
packing of any number of pieces is worked out on their histogram, which has at most as many entries
as a sequence has tokens: first the pieces over a third of the capacity, of which at most two share a
sequence, are matched greedily (the longest with the longest that fits, which leaves the fewest
sequences); then the smaller ones, longest first, go where they leave the smallest gap. A plan is
runs: "from its nth piece of that length on, one for each of these sequences, at that offset".

Pieces find their place by their number among those of their length. Each task numbers its own;
the tasks' counts, summed up in order, give the numbers over all. No length is gathered anywhere,
however many pieces have it.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from . import words as W
from .common import cut, table, text_of

VOCABULARY, CAPACITY, END_ID = "word_bpe_49k.json", 4096, 1
#: Parts of words whose ids a worker keeps (some 200 MB), and the longest that is kept; bytes of text whose distinct parts are looked up together; parts that the library is asked for at once.
KEPT_PARTS, KEPT_LENGTH, TOGETHER_BYTES, ASKED_PARTS = 1_000_000, 64, 1 << 22, 20_000
_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")
#: What special strings begin with, and the digit that stands between parts that are asked for together.
_SPECIAL, _BETWEEN, _DIGIT = b"<|", "0", b"0"
#: Kinds of bytes between which a pre-token always ends: letters, marks (without the apostrophe), digits; 0 are all others.
_KINDS = np.zeros(256, np.uint8)
_KINDS[[b for b in range(0x21, 0x7F) if b != 0x27]] = 2
_KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KINDS[0x30:0x3A] = 3


class PartIds:
    """Ids of texts, as little-endian 32-bit numbers, from those of their parts.

    The vocabulary's pre-tokens, normalisation and special strings never reach over ASCII white space, and a pre-token ends wherever an
    ASCII letter, digit or mark stands beside one of another kind, or two digits beside each other. So the ids of a text are those of its parts
    between such places, one after the other. ASCII letters are lower-cased in any case, so parts of ASCII alone are looked up in lower case. Each distinct part of some
    megabytes is looked up once; the library is asked for new ones only, for many in one call. Texts with what may be a special string go to the library as they are.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.known: dict[bytes, bytes] = {}
        self.between = self._of(_BETWEEN)

    def _of(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _ask(self, parts: list[bytes]) -> None:
        """Parts of lower-case letters are pre-tokens as they are, which the library's model takes. Of the others, those without the digit are asked for in one text, with the digit between them: no other part gives its id."""
        letters = [p for p in parts if p.isalpha() and p.islower()]
        found = [[t.id for t in self.library.model.tokenize(p.decode("ascii"))] for p in letters]
        raw, ends = np.fromiter(chain.from_iterable(found), "<u4").tobytes(), list(accumulate(map(len, found)))
        self.known |= {p: raw[4 * a : 4 * b] for p, a, b in zip(letters, [0, *ends[:-1]], ends, strict=True)} if letters else {}
        others = [p for p in parts if p not in self.known]
        joined = [p for p in others if _DIGIT not in p] if len(self.between) == 1 else []
        if joined:
            ids = np.array(self._of(f" {_BETWEEN} ".join(p.decode("utf-8") for p in joined)), "<u4")
            ends = np.flatnonzero(ids == self.between[0]).tolist()
            if len(ends) != len(joined) - 1:
                raise ValueError("the vocabulary's parts are not told apart by a digit")
            raw = ids.tobytes()
            self.known |= {p: raw[4 * a : 4 * b] for p, a, b in zip(joined, [0, *(e + 1 for e in ends)], [*ends, len(ids)], strict=True)}
        for p in others:
            if p not in self.known:
                self.known[p] = np.array(self._of(p.decode("utf-8")), "<u4").tobytes()

    def _together(self, data: np.ndarray, edges: np.ndarray) -> list[bytes]:
        """Ids of the texts between ``edges`` of ``data``, none with a special string."""
        if not len(data):
            return [b""] * (len(edges) - 1)
        inside, kind = W.SPACED[data], _KINDS[data]
        starts = np.empty(len(data) + 1, bool)
        starts[0] = starts[-1] = True
        before, after = kind[:-1], kind[1:]
        starts[1:-1] = ~inside[:-1] | (before != after) & (before > 0) & (after > 0) | (before == 3) & (after == 3)
        starts[edges[1:-1]] = True
        starts[:-1] &= inside
        ends = np.flatnonzero(inside & (starts[1:] | np.append(~inside[1:], True))) + 1
        starts = np.flatnonzero(starts[:-1])
        lower = W._LOWER[data]
        wide = np.zeros(len(data) + 1, np.int64)
        np.cumsum(data >= 0x80, out=wide[1:])
        plain = wide[ends] == wide[starts]
        first = np.searchsorted(starts, edges)
        cut_up = W.Piece(0, len(edges) - 1, data, starts, ends, first)
        hashes = np.where(plain, W.Piece(0, len(edges) - 1, lower, starts, ends, first).hashes(), cut_up.hashes())
        _, at, own = np.unique(hashes, return_index=True, return_inverse=True)
        texts = (data.tobytes(), lower.tobytes())
        parts = [texts[p][s:e] for p, s, e in zip(plain[at].tolist(), starts[at].tolist(), ends[at].tolist(), strict=True)]
        if len(self.known) > KEPT_PARTS:
            self.known.clear()
        new = list({p for p in parts if p not in self.known})
        for i in range(0, len(new), ASKED_PARTS):
            self._ask(new[i : i + ASKED_PARTS])
        found = [self.known[p] for p in parts]
        for p in [p for p in new if len(p) > KEPT_LENGTH]:
            del self.known[p]
        ids = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        places = np.cumsum(sizes) - sizes
        each = sizes[own]
        total = np.zeros(len(each) + 1, np.int64)
        np.cumsum(each, out=total[1:])
        whole = ids[np.repeat(places[own] - total[:-1], each) + np.arange(total[-1])].tobytes()
        at = (4 * total[first]).tolist()
        return [whole[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def encode(self, text: bytes) -> bytes:
        """Ids of one text of any length."""
        if _SPECIAL in text:
            return np.array(self._of(text.decode("utf-8")), "<u4").tobytes()
        out, at = [], 0
        while at < len(text):
            space = _SPACE.search(text, at + TOGETHER_BYTES)
            end = space.start() if space else len(text)
            out += self._together(np.frombuffer(text, np.uint8)[at:end], np.array([0, end - at]))
            at = end
        return b"".join(out)

    def encode_all(self, column: pa.Array) -> Iterator[bytes]:
        """Ids of each text of a column."""
        raw, offsets = W.text_buffers(column)
        for lo, hi in W.spans(offsets, TOGETHER_BYTES):
            data, edges = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            if len(data) > TOGETHER_BYTES or _SPECIAL in data.tobytes():
                yield from (self.encode(data[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True))
            else:
                yield from self._together(data, edges)


def pieces(docs: DataFrame, path: str, *keep: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``docs(text, keep...)`` -> ``(keep..., piece, start, length, ids, part, nth)``: each row's ids and ``end_id``, cut into pieces where there are more than ``capacity``.

    ``ids`` are little-endian 32-bit numbers; ``nth`` numbers the pieces of one length in the task ``part``. Null texts count as empty: ``end_id`` alone.
    Repeated rows are documents of their own; null ids stay null; columns not in ``keep`` aren't read. A text's ids are held whole, what they are made from only some megabytes at a time.
    """
    with open(path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    named = [f"_kept_{i}" for i in range(len(keep))]
    given = text_of(docs.select(*(F.col(f"`{k}`").alias(a) for k, a in zip(keep, named, strict=True)), "text"), *named)
    made = [("piece", IntegerType()), ("start", LongType()), ("length", LongType()), ("ids", BinaryType()), ("part", IntegerType()), ("nth", LongType())]
    schema = StructType([*given.drop("text").schema, *(StructField(n, t) for n, t in made)])
    k, key = len(keep), f"ids:{docs.sparkSession.sparkContext.applicationId}:{path}"
    last = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, met, part = W.held(key, lambda: PartIds(shared.value)), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            rows: list[tuple] = []
            for at, ids in enumerate(known.encode_all(batch.column(k))):
                ids += last
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + capacity)]
                    n = len(own) // 4
                    rows.append((at, piece, start, n, own, met[n]))
                    met[n] += 1
            at, piece, start, length, ids, nth = zip(*rows, strict=True) if rows else ((),) * 6
            columns = [c.take(pa.array(at, pa.int64())) for c in batch.columns[:k]]
            columns += [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array([part] * len(at), pa.int32()), pa.array(nth, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    cut_up = given.mapInArrow(run, schema)
    return cut_up.withColumnsRenamed(dict(zip(named, keep, strict=True)))


class Plan:
    """Where the pieces of each length go: runs of equal sequences, made from ``histogram`` (length -> pieces).

    ``runs`` holds (length, first piece, first sequence, offset, pieces a sequence): pieces of one length, numbered from 0, go to sequences in order.
    Lengths are 1 to ``capacity``, so both the histogram and the open gaps have at most ``capacity`` entries, whatever the number of pieces.
    """

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, dict(histogram)
        self.taken = dict.fromkeys(histogram, 0)
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self.gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, number of sequences)
        self.open: list[int] = []  # the gaps that there are, in order
        self._match()
        self._fill()

    def _place(self, length: int, first: int, sequences: int, offset: int, each: int) -> None:
        self.runs.append((length, self.taken[length], first, offset, each))
        self.taken[length] += sequences * each
        self.left[length] -= sequences * each

    def _gap(self, gap: int, first: int, sequences: int) -> None:
        if gap and sequences:
            if gap not in self.gaps:
                self.gaps[gap] = []
                insort(self.open, gap)
            self.gaps[gap].append((first, sequences))

    def _start(self, sequences: int) -> int:
        self.sequences += sequences
        return self.sequences - sequences

    def _match(self) -> None:
        """Pieces over a third of the capacity: the longest with the longest that still fits, else alone."""
        large = sorted(n for n, count in self.left.items() if 3 * n > self.capacity and count)
        while large:
            a = large[-1]
            if self.left[a] == 0:
                large.pop()
                continue
            at = bisect_right(large, min(a, self.capacity - a)) - 1
            if at >= 0 and large[at] == a and self.left[a] == 1:
                at -= 1
            b = large[at] if at >= 0 else 0
            if b == a:
                sequences = self.left[a] // 2
                self._place(a, first := self._start(sequences), sequences, 0, 2)
            else:
                sequences = min(self.left[a], self.left[b]) if b else self.left[a]
                self._place(a, first := self._start(sequences), sequences, 0, 1)
                if b:
                    self._place(b, first, sequences, a, 1)
                    if self.left[b] == 0:
                        large.pop(at)
            self._gap(self.capacity - a - b, first, sequences)

    def _fill(self) -> None:
        """The others, longest first: each where it leaves the smallest gap, so a sequence takes as many of one length as fit before the next is looked at."""
        for s in sorted((n for n, count in self.left.items() if 3 * n <= self.capacity and count), reverse=True):
            while self.left[s]:
                at = bisect_left(self.open, s)
                if at == len(self.open):
                    sequences = -(-self.left[s] // (self.capacity // s))
                    self._gap(self.capacity, self._start(sequences), sequences)
                    continue
                gap = self.open.pop(at)
                for first, sequences in self.gaps.pop(gap):
                    fit = gap // s
                    full = min(sequences, self.left[s] // fit)
                    if full:
                        self._place(s, first, full, self.capacity - gap, fit)
                        self._gap(gap - fit * s, first, full)
                    rest, more = sequences - full, self.left[s]
                    if rest and more:  # fewer are left than one sequence takes
                        self._place(s, first + full, 1, self.capacity - gap, more)
                        self._gap(gap - more * s, first + full, 1)
                        full, rest = full + 1, rest - 1
                    self._gap(gap, first + full, rest)

    def arrays(self) -> list[np.ndarray]:
        """Runs by length and first piece, a column each; lengths and pieces as one key that can be searched."""
        runs = np.array(sorted(self.runs), np.int64).reshape(-1, 5)
        return [(runs[:, 0] << 48) + runs[:, 1], *runs[:, 1:].T]


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces(length, part, nth, ...)`` with ``sequence_id`` and ``offset``; all other columns are carried along, under any other names.

    The pieces are written to the shared folder first: their numbers are made once, and a lost executor changes none. The histogram is all that the driver gets.
    An empty table gives an empty one.
    """
    numbered = cut(pieces, "pieces")
    spark = numbered.sparkSession
    counts = cut(numbered.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    if histogram and not 1 <= min(histogram) <= max(histogram) <= capacity:
        raise ValueError(f"pieces are 1 to {capacity} long")
    shared = spark.sparkContext.broadcast(Plan(histogram, capacity).arrays())
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    offsets = counts.select("length", "part", before.alias("before"))
    ranked = numbered.join(offsets, ["length", "part"]).withColumn("nth", F.col("nth") + F.col("before")).drop("part", "before")
    at_length, at_nth = ranked.columns.index("length"), ranked.columns.index("nth")
    schema = StructType([*ranked.drop("nth").schema, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first_piece, first_sequence, offset, each = shared.value
        for batch in batches:
            length, nth = (batch.column(c).to_numpy(zero_copy_only=False) for c in (at_length, at_nth))
            at = np.searchsorted(keys, (length << 48) + nth, "right") - 1
            sequence, within = np.divmod(nth - first_piece[at], each[at]) if len(at) else (nth, nth)
            columns = [c for i, c in enumerate(batch.columns) if i != at_nth]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(first_sequence[at] + sequence, pa.int64()), pa.array(offset[at] + within * length, pa.int64())], names=schema.names)

    return ranked.mapInArrow(run, schema)


def sequences(packed: DataFrame, *keep: str) -> DataFrame:
    """``packed(sequence_id, offset, length, ids, keep...)`` -> ``(sequence_id, n_tokens, ids, pieces)``: each sequence's ids in a row, and its pieces in order with ``keep``. A sequence has at most ``capacity`` pieces."""
    one = F.struct("offset", "length", *(F.col(f"`{k}`") for k in keep), "ids")
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(one)).alias("p"))
    ids = F.aggregate("p", F.lit(b"").cast("binary"), lambda got, x: F.concat(got, x["ids"]))
    return rows.select("sequence_id", "n_tokens", ids.alias("ids"), F.transform("p", lambda x: x.dropFields("ids")).alias("pieces"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: where each piece of each document is packed."""
    found = pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), "doc_id")
    digest = found.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(digest).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
