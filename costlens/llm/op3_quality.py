"""3. Text quality by positive-unlabelled learning with the non-negative risk.

Trusted positives are the documents labelled 1, unlabelled text is a sample of all documents; labels of 0 are not used. The
class prior is estimated from these two alone: above any threshold of a classifier that tells positives from
unlabelled text, the unlabelled share is at least the prior times the positives' share, so the least ratio of the two on rows
not fitted on bounds the prior, closely where some texts are surely good. A logistic model over
figures of a text's form then minimises the non-negative unbiased risk of Kiryo et al. (2017): the part
of the risk that stands for negatives, unlabelled minus prior times positive, is kept from going
below zero. Fitting takes bounded samples; scoring is one map stage over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import words as W
from .common import cut, table, text_of
from .op6_language import held_out

#: Most positives, and most unlabelled documents, that fitting uses: those of least hash.
SAMPLE = 10_000
THRESHOLD = 0.3
FEATURES = ["words", "word_bytes", "short", "distinct", "again", "top", "symbols", "marked", "caps", "shouted", "bangs", "digits", "lines", "line_again", "high"]
_KIND = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 3 digit, 4 sentence mark, 5 other ASCII symbol, 6 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 5
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = 4
_KIND[128:] = 6
_NOT_LINE = np.ones(256, bool)
_NOT_LINE[[10, 13]] = False


def _repeats(keys: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, count of the commonest key) of each document."""
    both = W.mix(keys + W.mix(doc.astype(np.uint64)))
    _, at, many = np.unique(both, return_index=True, return_counts=True)
    top = np.zeros(n)
    np.maximum.at(top, doc[at], many)
    return np.bincount(doc[at], minlength=n), top


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, a row of figures for each document) over a text column; an empty text has figures of 0."""
    lines = W.pieces(column, _NOT_LINE, lower=False)
    for p, q in zip(W.pieces(column, W.SPACED, lower=False), lines, strict=True):
        n, words = p.hi - p.lo, p.counts
        doc, h, size = p.doc_of_words(), p.hashes(), p.ends - p.starts
        kinds = np.zeros((7, len(p.data) + 1), np.int64)
        kind = _KIND[p.data]
        for k in range(1, 7):
            np.cumsum(kind == k, out=kinds[k, 1:])
        bang = np.concatenate([[0], np.cumsum(p.data == 33)])
        in_word = kinds[:, p.ends] - kinds[:, p.starts]
        by_doc = lambda x: np.bincount(doc, weights=x, minlength=n)
        bytes_ = by_doc(size)
        distinct, top = _repeats(h, doc, n)
        again = np.zeros(len(h))
        again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        line_doc, line_n = q.doc_of_words(), q.counts
        line_distinct, _ = _repeats(q.hashes(), line_doc, n)
        w, b, ln = np.maximum(1, words), np.maximum(1, bytes_), np.maximum(1, line_n)
        letters = np.maximum(1, by_doc(in_word[1] + in_word[2]))
        out = [
            np.log1p(words), bytes_ / w / 10, by_doc(size <= 2) / w, distinct / w, by_doc(again) / w, top / w,
            by_doc(in_word[5]) / b, by_doc(in_word[5] > 0) / w, by_doc(in_word[2]) / letters, by_doc((in_word[2] > 1) & (in_word[1] == 0)) / w,
            by_doc(bang[p.ends] - bang[p.starts]) / w, by_doc(in_word[3]) / b, np.log1p(line_n), 1 - line_distinct / ln, by_doc(in_word[6]) / b,
        ]
        out = np.stack(out, 1)
        out[words == 0] = 0
        yield p.lo, out


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, x in features(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(x)), W.list_column(x.reshape(-1), np.full(len(x), x.shape[1]), pa.float64())], names=["doc_id", "x"])


def _expand(x: np.ndarray) -> np.ndarray:
    """Figures with their square roots and a constant, so that a small share of bad words can weigh."""
    return np.concatenate([x, np.sqrt(np.abs(x)), np.ones((len(x), 1))], 1)


def fit_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 1500, rate: float = 0.05, ridge: float = 1e-4) -> dict:
    """Minimises prior * E_p[l(x, +)] + max(0, E_u[l(x, -)] - prior * E_p[l(x, -)]) with the logistic loss, by Adam."""
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    xp, xu = _expand((positive - mean) / scale), _expand((unlabelled - mean) / scale)
    w, m, v = (np.zeros(xp.shape[1]) for _ in range(3))
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, rounds + 1):
        zp, zu = xp @ w, xu @ w
        rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_rest = (sig(zu) @ xu) / len(xu) - prior * (sig(zp) @ xp) / len(xp)
        g = prior * (-sig(-zp) @ xp) / len(xp) + g_rest if rest >= 0 else -g_rest
        g = g + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return {"mean": mean, "scale": scale, "w": w}


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.3) -> float:
    """The share of positives in ``unlabelled``, both rows of figures in no order: the least ratio of tails that hold ``least`` of the positives."""
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    xp, xu = _expand((positive - mean) / scale), _expand((unlabelled - mean) / scale)
    p, u = max(1, len(xp) // 2), max(1, len(xu) // 2)
    w, m, v = (np.zeros(xp.shape[1]) for _ in range(3))
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, 401):
        g = (sig(xu[:u] @ w) @ xu[:u]) / u - (sig(-(xp[:p] @ w)) @ xp[:p]) / p + 1e-3 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    good, some = np.sort(xp[p:] @ w if len(xp) > p else xp @ w), np.sort(xu[u:] @ w if len(xu) > u else xu @ w)
    at = np.quantile(good, np.linspace(0, 1 - least, 200))
    share = lambda x: 1 - np.searchsorted(x, at) / len(x)
    return float(np.clip((share(some) / share(good)).min(), 0.01, 0.99))


def _least(ids: DataFrame, salt: int, sample: int) -> DataFrame:
    """``sample`` rows of the distinct ``ids(doc_id)``: those of least hash; rows that can't be among them are passed over before the sort."""
    h = F.xxhash64("doc_id", F.lit(salt))
    n = ids.count()
    some = ids if n <= 4 * sample else ids.filter(h < F.lit(int(-(2**63) + 2**64 * (4 * sample / n))))
    return some.orderBy(h, "doc_id").limit(sample)


def sampled(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Figures of at most ``sample`` positives and of at most ``sample`` documents, one row for each doc_id: that of its text of least hash."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).dropna().distinct()
    picks = [_least(marked.filter("quality = 1").select("doc_id").join(ids, "doc_id", "left_semi"), 1, sample), _least(ids, 2, sample)]
    both = picks[0].withColumn("kind", F.lit(1)).union(picks[1].withColumn("kind", F.lit(2))).groupBy("doc_id").agg(F.sum("kind").alias("kind"))
    both = cut(both, "sample")  # at most twice ``sample`` rows
    rows = text_of(docs, F.col("doc_id").cast("long").alias("doc_id")).join(F.broadcast(both), "doc_id")
    told = rows.select(F.struct("doc_id", "kind", F.xxhash64("text").alias("same")).alias("key"), "text").mapInArrow(_figures, "doc_id struct<doc_id:bigint,kind:bigint,same:bigint>, x array<double>")
    one = told.select("doc_id.*", "x").groupBy("doc_id", "kind").agg(F.min(F.struct("same", "x")).alias("m")).select("kind", F.col("m.x").alias("x"), F.xxhash64("doc_id").alias("place"))
    got = one.toPandas().sort_values("place")
    return tuple(np.stack(x.to_list()) if len(x) else np.zeros((0, len(FEATURES))) for x in (got["x"][got["kind"] & k > 0] for k in (1, 2)))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """``docs(doc_id, text)`` and ``labels(doc_id, quality)`` -> the model, and the prior it was fitted with.

    Labels with nulls are left out; a document labelled both ways is no positive. Without positives, or
    without documents, every score is 0.5. The driver holds the figures of 2 * ``sample`` documents at most.
    """
    ship(docs.sparkSession)
    good, some = sampled(docs, labels, sample)
    if not len(good) or not len(some):
        return {"prior": 0.5, "mean": np.zeros(len(FEATURES)), "scale": np.ones(len(FEATURES)), "w": np.zeros(2 * len(FEATURES) + 1)}
    prior = class_prior(good, some)
    return {"prior": prior} | fit_risk(good, some, prior)


def quality(docs: DataFrame, model: dict, *keep: str) -> DataFrame:
    """``docs(text, keep...)`` -> ``(keep..., score)``, a row for each document; null and empty texts get the score of figures of 0.

    Repeated rows come back repeated with one score; columns that aren't kept are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for lo, x in features(batch.column(k)):
                z = _expand((x - m["mean"]) / m["scale"]) @ m["w"]
                score = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, len(x)) for c in batch.columns[:k]), pa.array(score)], names=[*batch.schema.names[:k], "score"])

    given = text_of(docs, *keep)
    return given.mapInArrow(run, given.drop("text").withColumn("score", F.lit(0.0)).schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the quality of every document, learnt from labels of those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.filter(~held_out()), table(spark, sf_dir, "labels"))
    scored = quality(docs, model, "doc_id")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
