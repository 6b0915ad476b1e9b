"""7. Token counts by byte-pair merging with a heap and a linked list.

The vocabulary's pattern cuts a text into pre-tokens; in each, the adjacent pair of lowest rank
is merged again and again, and the count is the number of bytes minus the number of merges. No
identifiers are made. Equal pre-tokens are merged once for each Python worker: their counts are
kept in a dictionary of bounded size. It is one map stage; nothing is shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import table, text_of

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
#: Pre-tokens whose counts a worker keeps, and the longest that is kept: about 120 MB at most.
KEPT_WORDS, KEPT_LENGTH = 1_000_000, 48
# Fixed values of byte-level vocabularies: the pattern of pre-tokens, and the bytes that stand for themselves.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


class MergeCounter(dict):
    """pre-token -> number of tokens, worked out when first asked for."""

    def __init__(self, merges: list[tuple[str, str]], specials: list[str]):
        super().__init__()
        shown = set(SHOWN)
        letters = dict(zip([*SHOWN, *(b for b in range(256) if b not in shown)], [*map(chr, SHOWN), *map(chr, range(256, 256 + 256 - len(SHOWN)))], strict=True))
        ids = {letters[b]: b for b in range(256)}
        self.merged: dict[int, tuple[int, int]] = {}  # left id and right id -> rank, id of both
        for rank, (left, right) in enumerate(merges):
            both = ids.setdefault(left + right, len(ids))
            self.merged.setdefault(ids[left] << 32 | ids[right], (rank, both))
        self.find = regex.compile(PATTERN).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None

    def __missing__(self, word: str) -> int:
        n = self.tokens(word.encode("utf-8"))
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = n
        return n

    def tokens(self, symbols: bytes) -> int:
        """Symbols left once the lowest-rank adjacent pair, the first of equals, was merged as long as there is one."""
        n = len(symbols)
        if n < 2:
            return n
        merged = self.merged
        now = list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            got = merged.get(now[i] << 32 | now[i + 1])
            if got:
                heap.append(got[0] << 40 | i)
        heapify(heap)
        left = n
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFFFF
            j = after[i]
            if now[i] < 0 or j >= n:
                continue
            got = merged.get(now[i] << 32 | now[j])
            if not got or got[0] != top >> 40:
                continue  # one of the two has been merged meanwhile
            now[i], now[j] = got[1], -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                got = merged.get(now[i] << 32 | now[k])
                if got:
                    heappush(heap, got[0] << 40 | i)
            h = before[i]
            if h >= 0:
                got = merged.get(now[h] << 32 | now[i])
                if got:
                    heappush(heap, got[0] << 40 | h)
        return left

    def count(self, text: str) -> int:
        if self.special is None:
            return sum(map(self.__getitem__, self.find(text)))
        parts = self.special.split(text)
        return sum(sum(map(self.__getitem__, self.find(x))) for x in parts) + len(parts) - 1


def load_vocabulary(path: str) -> tuple[list[tuple[str, str]], list[str]]:
    """Merges in order, and the special strings that a text may hold."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in spec["model"]["merges"]]
    return merges, [x["content"] for x in spec["added_tokens"]]


def token_counts(docs: DataFrame, path: str, *keep: str) -> DataFrame:
    """``docs(text, keep...)`` -> ``(keep..., n_bytes, n_tokens)``, a row for each document.

    Counts are those of the vocabulary at ``path`` without begin or end tokens; special strings
    inside a text are one token each. Null and empty texts have 0 bytes and 0 tokens. The
    driver reads the vocabulary and broadcasts its merges, whose number the file fixes.
    Repeated rows come back repeated; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))
    k, key = len(keep), f"merges:{docs.sparkSession.sparkContext.applicationId}:{path}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = W.held(key, lambda: MergeCounter(*shared.value))
        for batch in batches:
            n = [counter.count(x.as_py() or "") for x in batch.column(k)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], batch.column(k + 1), pa.array(n, pa.int64())], names=[*batch.schema.names[:k], "n_bytes", "n_tokens"])

    given = text_of(docs, *keep).withColumn("n_bytes", F.coalesce(F.octet_length("text").cast("bigint"), F.lit(0).cast("bigint")))
    schema = given.drop("text").withColumn("n_tokens", F.lit(0).cast("bigint")).schema
    return given.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: token counts of every document."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), "doc_id").withColumn("over_limit", F.col("n_tokens") > LIMIT)
