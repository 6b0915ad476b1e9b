"""5. SentencePiece encoding and decoding over a trie of distinct marked words.

Each task sorts the distinct marked words (a run of word marks and what follows it) of some
megabytes of text. In sorted order they are a trie met depth first: a word keeps the forward
states of the prefix that it shares with the one before and works out only what follows. Pieces
of a whole text are then put together from its words. One map stage, no shuffle; words that a
worker has met stay in a dictionary of bounded size.

For a unigram model the forward state of a prefix is its best sum of piece scores (Viterbi). The
scores of a BPE model are merge ranks, and their best sum is not what the library returns; there
the state is the one last piece that stands beside the last piece of the prefix before it when
the two are merged alone. That gives the library's pieces exactly, with the same sharing.
"""

from __future__ import annotations

from collections.abc import Iterator
from struct import pack

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import table, text_of

MODEL = "piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, USER_DEFINED, BYTE = 1, 2, 4, 6
UNIGRAM, BPE = 1, 2
#: Bytes of text whose distinct words make one trie; words, pairs of pieces and characters that a worker keeps.
TRIE_BYTES, KEPT_WORDS, KEPT_PAIRS, KEPT_CHARS = 1 << 20, 200_000, 250_000, 3_000_000


def load_model(path: str) -> dict:
    """What encoding needs of a SentencePiece file; only models without normalisation are taken."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    norm, kind = proto.normalizer_spec, proto.trainer_spec.model_type
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or kind not in (UNIGRAM, BPE):
        raise ValueError(f"{path}: only unigram and BPE models without normalisation are supported")
    return {"type": kind, "prefix": norm.add_dummy_prefix, "pieces": [(p.piece, p.score, p.type) for p in proto.pieces]}


class PieceCoder:
    """Pieces of marked words, and texts of pieces."""

    def __init__(self, model: dict):
        pieces = model["pieces"]
        self.prefix, self.bpe = model["prefix"], model["type"] == BPE
        known = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED)}
        self.score = {p: s for p, s, kind in pieces if kind in (NORMAL, USER_DEFINED)}
        self.unknown = next((i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN), 0)
        found = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.of_byte = [found.get(b, self.unknown) for b in range(256)] if found else None
        self.lowest = min(self.score.values(), default=0.0) - 10
        self.raw = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() if kind in (NORMAL, USER_DEFINED) else "⁇".encode() if kind == UNKNOWN else b"" for p, _, kind in pieces]
        whole = any(regex.search(f"[^{MARK}]{MARK}", p) for p in known)
        self.split = (lambda s: [s] if s else []) if whole else regex.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.chars = 0
        if self.bpe:  # pieces that merging never makes take no part
            known = {p: i for p, i in known.items() if len(p) == 1 or self.merged(p) == [p]}
        self.text = [p for p, _, _ in pieces]
        self.strange: dict[str, int] = {}  # characters without a piece get numbers after the pieces
        self.ends: dict = {}  # pieces from their last character to their first; the number of a piece is under ""
        for p, i in known.items():
            node = self.ends
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = i

    def merged(self, text: str) -> list[str]:
        """Merging by the definition: the adjacent pair whose piece has the best score, the first of equals, again and again."""
        now = list(text)
        while len(now) > 1:
            best, at = None, -1
            for i in range(len(now) - 1):
                s = self.score.get(now[i] + now[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            now[at : at + 2] = [now[at] + now[at + 1]]
        return now

    def beside(self, left: int, right: int) -> bool:
        """Do two pieces stay as they are when their texts are merged as one?"""
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        a, b = self.text[left], self.text[right]
        got = self.pairs[left << 32 | right] = self.merged(a + b) == [a, b]
        return got

    def stranger(self, c: str) -> int:
        """The number of a character without a piece."""
        if c not in self.strange:
            self.strange[c] = len(self.text)
            self.text.append(c)
        return self.strange[c]

    def walk(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """The piece numbers of sorted words; the forward states of a shared prefix are kept from word to word."""
        before, begin, last, total, pairs, ends = "", [0], [0], [0.0], self.pairs, self.ends
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del begin[shared + 1 :], last[shared + 1 :], total[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                node, j, found = ends, i, []
                while j:  # pieces that end here, the shortest first
                    node = node.get(word[j - 1])
                    if node is None:
                        break
                    j -= 1
                    if "" in node:
                        found.append((j, node[""]))
                if not found or found[0][0] != i - 1:
                    found.insert(0, (i - 1, self.stranger(word[i - 1])))
                if self.bpe:
                    for at, piece in reversed(found):
                        if not at:
                            break
                        fits = pairs.get(last[at] << 32 | piece)
                        if fits or fits is None and self.beside(last[at], piece):
                            break
                else:
                    scored = [(total[j] + (self.score[self.text[p]] if p < len(self.raw) else self.lowest), -j, p) for j, p in found]
                    best, at, piece = max(scored)
                    at = -at
                    total.append(best)
                begin.append(at)
                last.append(piece)
            ids, i = [], len(word)
            while i:
                ids.append(last[i])
                i = begin[i]
            ids.reverse()
            yield word, ids
            before = word

    def numbers(self, ids: list[int]) -> list[int]:
        """Ids of the model: characters without a piece as their bytes, or as one unknown."""
        if max(ids, default=0) < len(self.raw):
            return ids
        out = []
        for i in ids:
            if i < len(self.raw):
                out.append(i)
            elif self.of_byte:
                out += [self.of_byte[b] for b in self.text[i].encode("utf-8")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def marked(self, text: str) -> list[str]:
        return self.split((MARK if self.prefix and text else "") + text.replace(" ", MARK))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, four bytes each."""
        if len(self.words) > KEPT_WORDS or self.chars > KEPT_CHARS:
            self.words.clear()
            self.chars = 0
        split = [self.marked(t) for t in texts]
        known = self.words
        fresh = {w for ws in split for w in ws if w not in known}
        for word, ids in self.walk(sorted(fresh)):
            ids = self.numbers(ids)
            known[word] = pack(f"{len(ids)}i", *ids)
            self.chars += len(word)
        return [b"".join(map(known.__getitem__, ws)) for ws in split]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


def encode(docs: DataFrame, path: str, *keep: str, check: bool = False) -> DataFrame:
    """``docs(text, keep...)`` -> ``(keep..., ids)``: the ids that the library gives for each whole text, without begin or end.

    With ``check``, a column ``round_trip`` tells whether the ids decode to the text, worked out in the same stage. Null and
    empty texts have no ids. Characters without a piece become bytes where the model has
    byte pieces. Repeated rows come back repeated; columns that aren't kept are ignored. The driver
    reads the model at ``path`` and broadcasts its pieces, whose number the file fixes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_model(path))
    k, key = len(keep), f"pieces:{docs.sparkSession.sparkContext.applicationId}:{path}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = W.held(key, lambda: PieceCoder(shared.value))
        for batch in batches:
            text = batch.column(k)
            for lo, hi in W.spans(W.text_buffers(text)[1], TRIE_BYTES):
                texts = [t or "" for t in text.slice(lo, hi - lo).to_pylist()]
                got = coder.encode(texts)
                columns = [W.list_column(np.frombuffer(b"".join(got), np.int32), np.array([len(x) // 4 for x in got]), pa.int32())]
                if check:
                    columns.append(pa.array([coder.decode(np.frombuffer(x, np.int32).tolist()) == t for x, t in zip(got, texts, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:k]), *columns], names=[*batch.schema.names[:k], "ids", "round_trip"][: k + len(columns)])

    given = text_of(docs, *keep)
    out = given.drop("text").withColumn("ids", F.array().cast("array<int>"))
    return given.mapInArrow(run, (out.withColumn("round_trip", F.lit(True)) if check else out).schema)


def decode(coded: DataFrame, path: str, *keep: str) -> DataFrame:
    """``coded(ids, keep...)`` -> ``(keep..., text)``. Null and empty ids give an empty text; the mark that encoding put first is taken off."""
    shared = coded.sparkSession.sparkContext.broadcast(load_model(path))
    k, key = len(keep), f"pieces:{coded.sparkSession.sparkContext.applicationId}:{path}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = W.held(key, lambda: PieceCoder(shared.value))
        for batch in batches:
            for lo in range(0, max(1, batch.num_rows), 500):
                part = batch.slice(lo, 500)
                text = [coder.decode(x.values.to_numpy().tolist() if x.is_valid else []) for x in part.column(k)]
                yield pa.RecordBatch.from_arrays([*part.columns[:k], pa.array(text, pa.string())], names=[*batch.schema.names[:k], "text"])

    given = coded.select(*keep, "ids")
    return given.mapInArrow(run, given.drop("ids").withColumn("text", F.lit("").cast("string")).schema)


def round_trips(docs: DataFrame, path: str, *keep: str) -> DataFrame:
    """``(keep..., n_pieces, ids_hash, round_trip)``: how many ids, a hash of them in order, and whether they decode to the text.

    A text that holds the word mark itself doesn't come back, as in the library: the mark decodes to a space.
    """
    coded = encode(docs, path, *keep, check=True)
    return coded.select(*keep, F.size("ids").cast("bigint").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "round_trip")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: pieces of every document, there and back."""
    return round_trips(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL), "doc_id")
