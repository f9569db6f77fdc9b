"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other text is merely unlabelled and holds toxic texts too, at the class prior.
The risk ``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` corrects for them; where the second part turns negative, the
step goes the other way, so that the classifier doesn't grow into the unlabelled toxic texts. Features say which words, and
which beginnings of words, occur in the whole text. Several linear classifiers are trained in numpy, each with its own share
of the unlabelled texts, and their weights are averaged. The sample they learn from is bounded; scoring is one pass over
all documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, labelled_sample, map_arrow, table
from .textbytes import chunks, lower_latin, mix, prefix_hashes, raw_texts, stretch_hash, words

BITS = 20
BEGINNINGS = (4, 5, 6)
#: Bounds of the sample that is fetched for training, and bytes of a text used for it.
POSITIVES = 4000
UNLABELLED = 12_000
FIT_BYTES = 1 << 16
MEMBERS = 3

_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[97:123] = _INSIDE[128:] = True


def occurring(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of every feature that occurs in a row, once each; with ``weights`` only those that have one."""
    low = lower_latin(data)
    start, end, row = words(low, offsets, _INSIDE)
    p = prefix_hashes(low)
    keys, rows = [], []
    for kind, size in enumerate((None, *BEGINNINGS)):
        if size is None:
            s, stop, r = start, end, row
        else:
            long = end - start > size
            s, r = start[long], row[long]
            stop = s + size
        f = (mix(stretch_hash(p, s, stop) + np.uint64(kind)) >> np.uint64(64 - BITS)).astype(np.int64)
        if weights is not None:
            some = weights[f] != 0
            f, r = f[some], r[some]
        keys.append(f)
        rows.append(r)
    both = np.unique((np.concatenate(rows) << BITS) | np.concatenate(keys))
    return both >> BITS, both & ((1 << BITS) - 1)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in chunks(batches):
        row, feature = occurring(*raw_texts(chunk.column(1)))
        cut = np.searchsorted(row, np.arange(chunk.num_rows + 1))
        packed = [feature[a:b].astype("<i4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array(packed, pa.binary())], names=["positive", "features"])


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 300, rate: float = 0.1,
          ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of one classifier, by full-batch Adam on the non-negative risk with the sigmoid loss.

    Features that at least three positives hold and that are twice as frequent there as in the unlabelled texts get a weight.
    """
    size = 1 << BITS
    n_p = np.bincount(np.concatenate(positive), minlength=size)
    n_u = np.bincount(np.concatenate(unlabelled), minlength=size)
    p, u = len(positive), len(unlabelled)
    chosen = np.flatnonzero((n_p >= 3) & (n_p / p > 2 * (n_u + 1) / (u + 1)))
    weights = np.zeros(size)
    if not len(chosen):
        return weights, float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    place = np.full(size, -1)
    place[chosen] = np.arange(len(chosen))
    docs = positive + unlabelled
    row = np.repeat(np.arange(p + u), [len(d) for d in docs])
    col = place[np.concatenate(docs)]
    row, col = row[col >= 0], col[col >= 0]
    w = np.append(np.log((n_p[chosen] + 0.5) / p) - np.log((n_u[chosen] + 0.5) / u), -4.0) * 0.5
    m = v = np.zeros_like(w)
    for t in range(1, rounds + 1):
        g = np.bincount(row, w[col], minlength=p + u) + w[-1]
        s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        slope = s * (1 - s)
        negative = s[p:].mean() - prior * s[:p].mean()  # the sigmoid loss of calling a text clean is s
        d = np.zeros(p + u)
        if negative >= 0:
            d[:p] = -prior * slope[:p] / p - prior * slope[:p] / p
            d[p:] = slope[p:] / u
        else:
            d[:p] = prior * slope[:p] / p
            d[p:] = -slope[p:] / u
        grad = np.append(np.bincount(col, d[row], minlength=len(chosen)) + ridge * w[:-1] / len(chosen), d.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights[chosen] = w[:-1]
    return weights, float(w[-1])


def learn_toxicity(docs: DataFrame, labels: DataFrame, unlabelled: DataFrame, prior: float | None = None) -> tuple[np.ndarray, float]:
    """Averaged weights and bias. ``prior`` is the share of toxic texts; by default that of the labelled rows."""
    if prior is None:
        marked = labels.where("toxic IN (0, 1)").agg(F.avg("toxic")).collect()[0][0]
        prior = float(marked or 0.0)
    known = labelled_sample(docs, labels, "toxic", {1: POSITIVES}).select(F.lit(True).alias("positive"), "text")
    others = unlabelled.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(UNLABELLED)
    loose = docs.select(docs["doc_id"].cast("long"), docs["text"]).join(F.broadcast(others), "doc_id", "left_semi")
    both = known.unionByName(loose.select(F.lit(False).alias("positive"), "text")).where(F.octet_length("text") <= FIT_BYTES)
    rows = map_arrow(both, _extract, "positive boolean, features binary").collect()
    p = sorted(bytes(r["features"]) for r in rows if r["positive"])
    u = sorted(bytes(r["features"]) for r in rows if not r["positive"])
    if not p or not u:
        return np.zeros(1 << BITS), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    p, u = ([np.frombuffer(x, "<i4") for x in some] for some in (p, u))
    found = [train(p, u[i::MEMBERS] or u, prior) for i in range(MEMBERS)]
    return np.mean([w for w, _ in found], axis=0), float(np.mean([b for _, b in found]))


def _score(batches: Iterator[pa.RecordBatch], index: np.ndarray, values: np.ndarray, bias: float) -> Iterator[pa.RecordBatch]:
    weights = np.zeros(1 << BITS)
    weights[index] = values
    for chunk in chunks(batches):
        row, feature = occurring(*raw_texts(chunk.column(1)), weights)
        g = np.bincount(row, weights[feature], minlength=chunk.num_rows) + bias
        score = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])


def score_toxicity(docs: DataFrame, labels: DataFrame, unlabelled: DataFrame, prior: float | None = None) -> DataFrame:
    """``doc_id, score`` for every row of ``docs`` (``doc_id``, ``text``); 1 is toxic.

    ``labels`` (``doc_id``, ``toxic``; only the value 1 marks a positive) and ``unlabelled`` (``doc_id``: whose texts may serve
    as unlabelled) name what is learnt from. Other columns are ignored. A null or empty text gets the score of no evidence.
    Without positives or unlabelled texts every score is the prior. Null ids stay null, repeated rows are each scored, an
    empty table gives no rows. Runs the jobs that fetch the bounded sample.
    """
    weights, bias = learn_toxicity(docs, labels, unlabelled, prior)
    index = np.flatnonzero(weights)
    shared = docs.sparkSession.sparkContext.broadcast((index, weights[index], bias))  # 2^20 weights at most
    return map_arrow(
        docs.select(docs["doc_id"].cast("long"), docs["text"]), lambda it: _score(it, *shared.value), "doc_id long, score double"
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = fold(F.col("doc_id"), 5) != 0
    labels = table(spark, sf_dir, "labels").where(learn).select("doc_id", "toxic")
    scored = score_toxicity(docs, labels, docs.where(learn).select("doc_id"))
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
