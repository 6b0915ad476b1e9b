"""6. Language of a text: script ranges, scores of words, and a Viterbi pass with a switching penalty.

Learning is one pass: byte trigrams inside words are counted by language over all training
rows, summed inside each task and then across tasks; the model is at most 2**16 counts a
language. Labelling is one map stage: a word's script leaves the languages that write in it,
its trigrams give a log probability for each of these, and Viterbi finds the labels of all
documents of a group at once, word by word. With two languages, neighbouring words with the same
best language enter the pass as one step, which changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import words as W
from .common import table, text_of

BUCKETS = 1 << 16
#: Cost of a change of language between two words, in nats.
SWITCH = 9.0
#: A language writes in a script if at least this share of its words does.
SCRIPT_SHARE = 0.002
#: Run scores that are labelled at once (4 bytes each).
GROUP_CELLS = 4_000_000
#: First code points of the ranges that are told apart, and the script of each: Latin, Greek, Cyrillic, Armenian, Hebrew, Arabic, Indic, Thai, Hangul, Kana, Han, others.
RANGES = [
    (0x0000, 0), (0x0370, 1), (0x0400, 2), (0x0530, 3), (0x0590, 4), (0x0600, 5), (0x0780, 11), (0x0900, 6), (0x0E00, 7), (0x0E80, 11),
    (0x1100, 8), (0x1200, 11), (0x1E00, 0), (0x1F00, 1), (0x2000, 11), (0x3040, 9), (0x3100, 11), (0x3130, 8), (0x3190, 11), (0x3400, 10),
    (0xA000, 11), (0xAC00, 8), (0xD800, 11), (0xF900, 10), (0xFB00, 0), (0xFB13, 3), (0xFB1D, 4), (0xFB50, 5), (0xFE00, 11), (0xFE70, 5), (0xFF00, 0), (0xFF66, 9), (0xFFA0, 11), (0x20000, 10),
]
SCRIPTS = 12
_STARTS, _SCRIPT = np.array([x for x, _ in RANGES]), np.array([x for _, x in RANGES])
_LETTERS = W.ALNUM.copy()
_LETTERS[0x30:0x3A] = False  # digits are no part of words here


def _features(p: W.Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram bucket of each letter byte, index of each word's first one, script of each word)."""
    size = p.ends - p.starts
    at = np.cumsum(size) - size
    total = int(size.sum())
    spot = np.repeat(p.starts - at, size) + np.arange(total)
    here = p.data[spot].astype(np.uint32)
    left, right = np.empty_like(here), np.empty_like(here)
    left[1:], right[:-1] = here[:-1], here[1:]
    if total:
        left[at], right[at + size - 1] = 32, 32
    code = (left << np.uint32(16)) | (here << np.uint32(8)) | right
    bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(16)
    data = np.append(p.data, np.zeros(3, np.uint8)).astype(np.int64)
    b0, b1, b2, b3 = (data[p.starts + k] for k in range(4))
    low = lambda x: x & 0x3F
    point = np.where(b0 < 0x80, b0, np.where(b0 < 0xE0, (b0 & 0x1F) << 6 | low(b1), np.where(b0 < 0xF0, (b0 & 0xF) << 12 | low(b1) << 6 | low(b2), (b0 & 7) << 18 | low(b1) << 12 | low(b2) << 6 | low(b3))))
    return bucket, at, _SCRIPT[np.searchsorted(_STARTS, point, side="right") - 1]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, lang) -> counts of trigram buckets, then of scripts, of each language in this task."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for p in W.pieces(batch.column(0), _LETTERS, lower=True):
            bucket, at, script = _features(p)
            own = np.array(langs[p.lo : p.hi], object)
            names, code = np.unique(own.astype(str), return_inverse=True)
            of_word = np.repeat(code, p.counts)
            of_byte = np.repeat(of_word, p.ends - p.starts)
            trigrams = np.bincount(of_byte * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
            scripts = np.bincount(of_word * SCRIPTS + script, minlength=len(names) * SCRIPTS).reshape(-1, SCRIPTS)
            for i, name in enumerate(names):
                both = np.concatenate([trigrams[i], scripts[i]])
                counts[name] = counts[name] + both if name in counts else both
    for name, c in counts.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([str(name)] * len(at)), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["lang", "feature", "n"])


def learn(docs: DataFrame) -> dict:
    """``docs(text, lang)`` -> the model: languages in order, log probabilities, and the scripts of each language.

    Rows with a null text or lang teach nothing. All others count whole; no rows give a model without languages.
    """
    ship(docs.sparkSession)
    rows = text_of(docs, "lang").select("text", F.col("lang").cast("string").alias("lang")).dropna()
    sums = rows.mapInArrow(_count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(sums["lang"].unique())
    counts = np.zeros((len(names), BUCKETS + SCRIPTS))
    counts[np.searchsorted(names, sums["lang"].to_numpy().astype(str)) if names else [], sums["feature"].to_numpy()] = sums["n"].to_numpy()
    trigrams, scripts = counts[:, :BUCKETS], counts[:, BUCKETS:]
    logs = np.log((trigrams + 0.5) / (trigrams.sum(1, keepdims=True) + 0.5 * BUCKETS))
    writes = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(1, keepdims=True))
    writes[:, ~writes.any(0)] = True  # a script that no language writes in excludes none
    return {"langs": names, "logs": logs.astype(np.float32), "writes": writes}


def _viterbi(scores: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The best label of each step, for sequences of ``counts`` steps one after another in ``scores``.

    Sums are doubles over the best of their step, which is taken off: they stay small however long a sequence is.
    """
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    order = np.argsort(-counts, kind="stable")
    first, counts = first[order], counts[order]
    lasts = np.searchsorted(-counts, -np.arange(1, (counts[0] if len(counts) else 0) + 1), side="right")  # sequences with a t-th step
    best, stay = np.zeros(len(scores), np.int16), np.zeros(scores.shape, bool)
    v = np.zeros((len(counts), scores.shape[1]), np.float64)
    for t, k in enumerate(lasts):
        now = v[:k]
        top = now.argmax(1)
        now -= now[np.arange(k), top][:, None]
        at = first[:k] + t
        best[at] = top
        same = now >= -SWITCH
        stay[at] = same
        v[:k] = np.where(same, now, -SWITCH) + scores[at] if t else scores[at]
    label = v.argmax(1).astype(np.int16)
    out = np.zeros(len(scores), np.int16)
    for t in range(len(lasts) - 1, -1, -1):
        k = lasts[t]
        at = first[:k] + t
        out[at] = label[:k]
        if t:
            keep = stay[at, label[:k]]
            label[:k] = np.where(keep, label[:k], best[at])
    return out


def _steps(p: W.Piece, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(scores of each step, its words, its letter bytes, steps of each document)."""
    bucket, at, script = _features(p)
    logs, writes = model["logs"], model["writes"]
    scores = np.empty((len(p.starts), len(logs)), np.float32)
    for k in range(len(logs)):
        scores[:, k] = np.add.reduceat(logs[k][bucket], at) if len(at) else 0
    allowed = writes[:, script].T
    if not allowed.all():
        scores = np.where(allowed, scores, scores.min(1, keepdims=True) - 50)
    top = scores.argmax(1)
    doc = p.doc_of_words()
    fresh = np.ones(len(top), bool)
    if len(logs) <= 2:  # a switch inside a run of one best language gains nothing; with a third language it can
        fresh[1:] = (top[1:] != top[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(fresh)
    if not len(begin):
        return scores, begin, begin, np.zeros(p.hi - p.lo, np.int64)
    words = np.diff(np.append(begin, len(top)))
    letters = np.add.reduceat(p.ends - p.starts, begin)
    return np.add.reduceat(scores, begin, axis=0), words, letters, np.bincount(doc[begin], minlength=p.hi - p.lo)


def _label(shared, keep: int):
    def flush(model, group):
        scores, words, letters, steps = (np.concatenate([g[k] for g in group]) for k in range(4))
        label = _viterbi(scores, steps)
        n, langs = len(model["langs"]), model["langs"]
        doc = np.repeat(np.arange(len(steps)), steps)
        share = np.bincount(doc * n + label, weights=letters, minlength=len(steps) * n).reshape(-1, n)
        top, total = share.argmax(1), share.sum(1)
        score = share[np.arange(len(steps)), top] / np.maximum(1, total)
        fresh = np.ones(len(label), bool)
        fresh[1:] = (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])
        begin = np.flatnonzero(fresh)
        before = np.cumsum(words) - words
        base = before[np.concatenate([[0], np.cumsum(steps)[:-1]]).clip(0, max(0, len(before) - 1))] if len(before) else np.zeros(len(steps), np.int64)
        lo = before[begin] - base[doc[begin]]
        end = np.append(begin[1:], len(label))
        hi = before[end - 1] + words[end - 1] - base[doc[begin]] if len(begin) else lo
        spans = pa.StructArray.from_arrays([pa.array(np.array(langs, object)[label[begin]], pa.string()), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["lang", "lo", "hi"])
        per = np.bincount(doc[begin], minlength=len(steps))
        offsets = pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32))
        named = [langs[k] if t else None for k, t in zip(top, total, strict=True)]
        return pa.array(named, pa.string()), pa.array(score), pa.ListArray.from_arrays(offsets, spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            names = [*batch.schema.names[:keep], "lang_pred", "score", "spans"]
            if not model["langs"]:
                kind = pa.list_(pa.struct([("lang", pa.string()), ("lo", pa.int32()), ("hi", pa.int32())]))
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.nulls(n, pa.string()), pa.array(np.zeros(n)), pa.array([[]] * n, kind)], names=names)
                continue
            group, begin, cells = [], 0, 0
            for p in W.pieces(batch.column(keep), _LETTERS, lower=True):
                group.append(_steps(p, model))
                cells += group[-1][0].size
                if cells >= GROUP_CELLS or p.hi == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*(c.slice(begin, p.hi - begin) for c in batch.columns[:keep]), *flush(model, group)], names=names)
                    group, begin, cells = [], p.hi, 0

    return run


def languages(docs: DataFrame, model: dict, *keep: str) -> DataFrame:
    """``docs(text, keep...)`` -> ``(keep..., lang_pred, score, spans)``, a row for each document.

    ``spans`` holds stretches of words (runs of letters) in one language: lang, first word, end.
    ``lang_pred`` has the most letters, ``score`` its share of them. Null texts and texts without a
    letter are ``und`` with score 0; so is everything if the model has no languages. Equal shares go to the
    language that sorts first. Repeated rows come back repeated.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given = text_of(docs, *keep).withColumn("_letter", F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)))
    given = given.select(*keep, "_letter", "text")
    kept = given.drop("text").withColumns({"lang_pred": F.lit(None).cast("string"), "score": F.lit(0.0), "spans": F.lit(None).cast("array<struct<lang:string,lo:int,hi:int>>")})
    out = given.mapInArrow(_label(shared, len(keep) + 1), kept.schema)
    sure = F.col("_letter") & F.col("lang_pred").isNotNull()
    return out.select(*keep, F.when(sure, F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(sure, F.col("score")).otherwise(0.0).alias("score"), "spans")


def keep_known(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs`` whose language is one that the model knows, all columns as they were."""
    rest = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*rest).alias("row"), F.col("text").alias("whole"), "text")  # so that no column's name can clash
    told = languages(packed, model, "row", "whole").filter("lang_pred <> 'und'")
    return told.select(*(F.col("whole").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id's digits is a multiple of 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the language of every document, learnt from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.filter(~held_out()))
    return languages(docs, model, "doc_id").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
