"""Quality scores by compression: which labelled half of the corpus helps to compress a text more?

Two zstandard dictionaries are built, one from good and one from bad labelled texts. A text is compressed in blocks of
``BLOCK`` bytes with each of them (a dictionary acts on the beginning of what it compresses, so blocks let it act on the
whole text). The normalised difference of the two sizes, and nothing else, goes through a logistic curve fitted on learning
texts that the dictionaries have not seen.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, labelled_sample, map_arrow, table
from .textbytes import chunks, raw_texts

BLOCK = 4096
LEVEL = 3
#: Bounds of the labelled sample: texts per class for the dictionaries and for the curve, and bytes of a text used for fitting.
DICTIONARY_TEXTS = 3000
CURVE_TEXTS = 3000
FIT_BYTES = 1 << 16
DICTIONARY_BYTES = 1 << 17


def compressors(good: bytes, bad: bytes) -> list[zstandard.ZstdCompressor]:
    found = []
    for d in (good, bad):
        data = zstandard.ZstdCompressionDict(d)
        data.precompute_compress(level=LEVEL)
        found.append(zstandard.ZstdCompressor(dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False))
    return found


def evidence(text: bytes, coders: list[zstandard.ZstdCompressor]) -> float:
    """Normalised difference of the compressed sizes; positive: closer to the good texts."""
    if not text:
        return 0.0
    view = memoryview(text)
    blocks = [view[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
    good, bad = (sum(len(c.compress(b)) for b in blocks) for c in coders)
    return (bad - good) / max(good, bad)


def features(e: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(e)), 10 * e])


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Newton's method for ridge logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def build_dictionary(texts: list[bytes]) -> bytes:
    """A zstandard dictionary; of few or uniform texts, their joined end, which serves as a raw dictionary."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts, k=256, d=8, steps=1).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(texts)[-DICTIONARY_BYTES:]


def learn_quality(docs: DataFrame, labels: DataFrame) -> tuple[bytes, bytes, np.ndarray] | None:
    """Dictionaries and curve from the texts of ``docs`` that ``labels`` marks; None unless both classes occur.

    The sample is bounded: ``DICTIONARY_TEXTS + CURVE_TEXTS`` documents of each class, without those of over ``FIT_BYTES``
    bytes. Only that many rows reach the driver.
    """
    most = dict.fromkeys((0, 1), DICTIONARY_TEXTS + CURVE_TEXTS)
    rows = (
        labelled_sample(docs, labels, "quality", most).where(F.octet_length("text").between(1, FIT_BYTES))
        .select("quality", "doc_id", "text").collect()
    )
    rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["text"]))
    sample = {k: [r["text"].encode() for r in rows if r["quality"] == k] for k in (0, 1)}
    if not sample[0] or not sample[1]:
        return None
    seen = {k: v[::2] for k, v in sample.items()}
    rest = {k: v[1::2] or v for k, v in sample.items()}
    good, bad = build_dictionary(seen[1]), build_dictionary(seen[0])
    coders = compressors(good, bad)
    x = features(np.array([evidence(t, coders) for k in (0, 1) for t in rest[k]]))
    y = np.repeat([0.0, 1.0], [len(rest[0]), len(rest[1])])
    return good, bad, fit_curve(x, y)


def _score(batches: Iterator[pa.RecordBatch], model: tuple | None) -> Iterator[pa.RecordBatch]:
    coders = compressors(model[0], model[1]) if model else None
    for chunk in chunks(batches):
        if model:
            data, off = raw_texts(chunk.column(1))
            raw, off = data.tobytes(), off.tolist()
            e = np.array([evidence(raw[a:b], coders) for a, b in zip(off[:-1], off[1:], strict=True)])
            score = 1 / (1 + np.exp(-np.clip(features(e) @ model[2], -30, 30)))
            difference = e
        else:
            score, difference = np.full(chunk.num_rows, 0.5), np.zeros(chunk.num_rows)
        yield pa.RecordBatch.from_arrays(
            [chunk.column(0), pa.array(score, pa.float64()), pa.array(difference, pa.float64())], names=["doc_id", "score", "difference"]
        )


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, score, difference`` for every row of ``docs`` (``doc_id``, ``text``), learnt from ``labels`` (``doc_id``,
    ``quality`` 0 or 1; nulls and other values take no part). Other columns are ignored.

    A null text counts as empty and gets the curve's value for no evidence. Without labelled texts of both classes every
    score is 0.5. Null ids stay null, repeated rows are each scored, an empty table gives no rows. Runs the jobs that fetch
    the bounded sample.
    """
    model = learn_quality(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size
    return map_arrow(
        docs.select(docs["doc_id"].cast("long"), docs["text"]), lambda it: _score(it, shared.value), "doc_id long, score double, difference double"
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 3) != 1).select("doc_id", "quality")
    scored = score_quality(docs, labels)
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "difference",
    )
