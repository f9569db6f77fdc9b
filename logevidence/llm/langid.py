"""Language identification by multilingual mixture inference.

Each language is a distribution over hashed byte n-grams, counted over all labelled learning texts. A text is cut into
segments of ``SEGMENT`` bytes; expectation-maximisation finds the proportions in which the languages produced the segments,
and the set of languages is chosen by penalised likelihood: starting from the best single language, the language that
raises the likelihood most joins as long as it gains more than the penalty. The counts are summed by Spark; the model
(languages x ``BUCKETS``) has a fixed size per language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, map_arrow, schema_with_row, table, whole_row
from .textbytes import chunks, lower_latin, raw_texts, text_of

BUCKETS = 1 << 15
SEGMENT = 48
ROUNDS = 12
#: More languages than this are refused: the model is sent to every task.
MAX_LANGUAGES = 256


def ngram_buckets(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The bucket of the 4-gram of bytes that ends at each byte; near the start of its row (``off``) a gram is shorter."""
    low = lower_latin(data).astype(np.uint32)
    gram = low.copy()
    for back in (1, 2, 3):
        gram[back:] |= low[:-back] << np.uint32(8 * back)
    for nth in range(3):
        at = off[:-1] + nth
        gram[at[at < off[1:]]] &= np.uint32((1 << 8 * (nth + 1)) - 1)
    return ((gram * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for chunk in chunks(batches):
        data, off = raw_texts(chunk.column(1))
        grams = ngram_buckets(data, off)
        names = chunk.column(0).to_pylist()
        of_row = np.repeat(np.arange(len(names)), np.diff(off))
        for name in set(names):
            mine = np.array([n == name for n in names])
            counts = np.bincount(grams[mine[of_row]], minlength=BUCKETS)
            total[name] = total[name] + counts if name in total else counts
    for name, counts in total.items():
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(counts[some], pa.int64())],
            names=["lang", "bucket", "n"],
        )


def learn_languages(labelled: DataFrame, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Language names and log-probabilities (languages x buckets) from all rows of ``lang``, ``text`` without nulls."""
    counted = (
        map_arrow(
            labelled.select(F.col("lang").cast("string"), "text").where("lang IS NOT NULL AND text IS NOT NULL"),
            _count, "lang string, bucket int, n long",
        ).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    )
    rows = counted.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c")).limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rows = sorted(rows, key=lambda r: r["lang"])
    logs = np.zeros((len(rows), BUCKETS), dtype=np.float32)
    for i, r in enumerate(rows):
        counts = np.full(BUCKETS, smoothing)
        for bucket, n in r["c"]:
            counts[bucket] += n
        logs[i] = np.log(counts / counts.sum())
    return [r["lang"] for r in rows], logs


def mixtures(like: np.ndarray, doc: np.ndarray, docs: int, penalty: float) -> np.ndarray:
    """Proportions (documents x languages) of the penalised mixture.

    ``like``: log-likelihood of each segment (rows, sorted by document) under each language.
    """
    langs = like.shape[1]
    peak = like.max(axis=1, keepdims=True)
    p = np.exp(like - peak)
    first = np.searchsorted(doc, np.arange(docs))
    some = np.bincount(doc, minlength=docs) > 0

    def per_doc(x: np.ndarray) -> np.ndarray:
        out = np.zeros((docs, *x.shape[1:]))
        if some.any():
            out[some] = np.add.reduceat(x, first[some], axis=0)
        return out

    def fit(allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        share = allowed / np.maximum(allowed.sum(axis=1, keepdims=True), 1)
        for _ in range(ROUNDS):
            joint = p * share[doc]
            total = joint.sum(axis=1, keepdims=True)
            share = per_doc(joint / np.maximum(total, 1e-300))
            share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
        return share, per_doc(np.log(np.maximum((p * share[doc]).sum(axis=1), 1e-300)))

    alone = per_doc(np.log(np.maximum(p, 1e-300)))
    allowed = np.zeros((docs, langs))
    allowed[np.arange(docs), alone.argmax(axis=1)] = 1
    share, best = allowed.copy(), alone.max(axis=1)
    open_docs = some.copy()
    for _ in range(langs - 1):
        # the language whose segments lie furthest above what the present mixture gives them
        now = np.log(np.maximum((p * share[doc]).sum(axis=1), 1e-300))
        hope = per_doc(np.maximum(np.log(np.maximum(p, 1e-300)) - now[:, None], 0)) * (1 - allowed)
        grow = open_docs & (hope.max(axis=1) > penalty)
        if not grow.any():
            break
        wider = allowed.copy()
        wider[grow, hope[grow].argmax(axis=1)] = 1
        keep = grow[doc]
        sub, sub_p = np.cumsum(grow) - 1, p
        p, doc_all, docs_all, first_all, some_all = p[keep], doc, docs, first, some
        doc, docs = sub[doc[keep]], int(grow.sum())
        first, some = np.searchsorted(doc, np.arange(docs)), np.ones(docs, bool)
        new_share, new_best = fit(wider[grow])
        p, doc, docs, first, some = sub_p, doc_all, docs_all, first_all, some_all
        better = new_best - best[grow] > penalty
        rows = np.flatnonzero(grow)[better]
        share[rows], best[rows], allowed[rows] = new_share[better], new_best[better], wider[rows]
        open_docs[:] = False
        open_docs[rows] = True
    return share


def _predict(batches: Iterator[pa.RecordBatch], names: list[str], logs: np.ndarray, penalty: float) -> Iterator[pa.RecordBatch]:
    table_ = np.ascontiguousarray(logs.T)
    for chunk in chunks(batches):
        data, off = raw_texts(text_of(chunk))
        rows = chunk.num_rows
        letters = np.array(chunk.column(1).to_pylist(), dtype=bool)
        size = np.diff(off)
        parts = -(-size // SEGMENT)
        doc = np.repeat(np.arange(rows), parts)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start = off[:-1][doc] + nth * SEGMENT
        lang, score = ["und"] * rows, np.zeros(rows)
        if len(start) and names:
            like = np.empty((len(start), len(names)))
            grams = ngram_buckets(data, off)
            for i in range(len(names)):
                like[:, i] = np.add.reduceat(table_[grams, i], start)
            share = mixtures(like, doc, rows, penalty)
            best = share.argmax(axis=1)
            sure = letters & (share.max(axis=1) > 0)
            score = np.where(sure, share.max(axis=1), 0.0)
            lang = [names[b] if s else "und" for b, s in zip(best.tolist(), sure.tolist(), strict=True)]
            shares = [{n: float(v) for n, v in zip(names, row, strict=True) if v > 0.005} if s else {} for row, s in zip(share, sure, strict=True)]
        else:
            shares = [{}] * rows
        yield pa.RecordBatch.from_arrays(
            [chunk.column(0), pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64()),
             pa.array([list(s.items()) for s in shares], pa.map_(pa.string(), pa.float64())),
             *(chunk.column(i) for i, n in enumerate(chunk.schema.names) if n == "row")],
            names=["doc_id", "lang_pred", "score", "shares", *(n for n in chunk.schema.names if n == "row")],
        )


def identify_languages(docs: DataFrame, labelled: DataFrame, penalty: float = 12.0, carry: bool = False) -> DataFrame:
    """``doc_id, lang_pred, score, shares`` for every row of ``docs`` (``doc_id``, ``text``; other columns are ignored).

    ``shares`` maps the languages of the chosen set to their proportions, ``lang_pred`` is the largest (ties: the smaller
    name) and ``score`` its proportion. ``penalty`` is the gain in log-likelihood that one more language must bring. A text
    that is null or holds no letter, or any text when nothing is known of any language, is ``und`` with score 0. Null ids
    stay null, repeated rows are each answered, an empty table gives no rows. Runs the job that counts ``labelled``
    (``lang``, ``text``); a null in either takes no part. The n-grams of a text lie within it, so an answer doesn't depend on
    the rows around it. With ``carry``, a column ``row`` holds the whole row of ``docs``.
    """
    names, logs = learn_languages(labelled)
    # a letter of any script; Java's classes decide, in one native pass
    letters = F.coalesce(docs["text"].rlike(r"\p{L}"), F.lit(False)).alias("letters")
    read = docs.select(docs["doc_id"].cast("long"), letters, whole_row(docs) if carry else docs["text"])
    shared = docs.sparkSession.sparkContext.broadcast(logs)  # fixed size per language
    schema = schema_with_row("", read, "doc_id long, lang_pred string, score double, shares map<string,double>")
    return map_arrow(read, lambda it: _predict(it, names, shared.value, penalty), schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = docs.where(fold(F.col("doc_id"), 4) != 2).select("lang", "text")
    found = identify_languages(docs.select("doc_id", "text"), labelled)
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "shares")
