"""Packing of token sequences by the sum-of-squares rule.

Documents come one after another; each goes to the fill level where the sum over all levels of the squared number of
partly filled windows becomes smallest. The only state is the level array (how many windows stand at each fill level)
and the windows themselves. Nothing is shuffled: every input partition packs its own rows, so the work is one pass and a
lost task is simply run again.

Lossless rules of this version: a document longer than a window is cut into whole windows and a rest, and the rest is
placed by the rule. Windows that are still open at the end of a partition (or when more than ``max_open`` are open, which
bounds the memory) are merged: their pieces are cut and joined to full windows, and the last rest is cut at powers of
two, where no padding is due.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow, table
from .textbytes import chunks

WINDOW = 2048
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    With ``ranks`` (the same vocabulary in tiktoken's form) tiktoken gives the ids, which are the same and come faster. Its
    pattern needs a look-ahead only where two white-space characters meet; other texts go by a pattern without one. Texts
    that may hold a special token always go to ``tokenizers``.
    """

    PLAIN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
    SPACES = re.compile(r"\s\s")

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer, self.full, self.plain = Tokenizer.from_file(path), None, None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.full, self.plain = (
                tiktoken.Encoding("ranks", pat_str=p, mergeable_ranks=known, special_tokens={}).encode_ordinary
                for p in (public_tokenizers.PATTERN, self.PLAIN)
            )

    def encode(self, text: str) -> bytes:
        if self.full is None or "<|" in text:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = (self.full if self.SPACES.search(text) else self.plain)(text)
        return np.array(ids, dtype="<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(path: str, ranks: str | None = None) -> Encoder:
    return Encoder(path, ranks)


class SquaresPacker:
    """The level array and the open windows of one partition.

    ``place`` returns finished windows, each a list of (document index, start, ids) pieces whose lengths sum up to the
    window, ``drain`` the merged rest.
    """

    def __init__(self, window: int = WINDOW, max_open: int = 4096):
        self.window, self.max_open, self.open = window, max_open, 0
        self.levels = np.zeros(window + 1, dtype=np.int64)
        self.standing: list[list[list]] = [[] for _ in range(window + 1)]

    def level_for(self, size: int) -> int:
        """The fill level to put ``size`` tokens on; 0 opens a window. Ties go to the fullest window."""
        b, n = self.window, self.levels
        top = b - size  # levels 1..top can take it
        cost = np.empty(top + 1, dtype=np.int64)
        cost[0] = 2 * n[size] + 1
        if top:
            cost[1:] = 2 * (n[size + 1 : b + 1] - n[1 : top + 1]) + 2
            cost[top] = 1 - 2 * n[top]  # the window is full and leaves the array
            cost[1:][n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        elif size == b:
            return 0
        return top - int(np.argmin(cost[::-1]))

    def place(self, piece: tuple) -> list[list]:
        size = len(piece[2]) // 4
        if size == self.window:
            return [[piece]]
        at = self.level_for(size)
        if at:
            self.levels[at] -= 1
            held = self.standing[at].pop()
            self.open -= 1
        else:
            held = []
        held.append(piece)
        if at + size == self.window:
            return [held]
        self.levels[at + size] += 1
        self.standing[at + size].append(held)
        self.open += 1
        return self.drain() if self.open > self.max_open else []

    def drain(self) -> list[list]:
        """Cuts and joins what the open windows hold; the rest goes to windows of 2^k tokens, which need no padding."""
        pieces = [p for level in reversed(self.standing) for held in level for p in held]
        self.levels[:] = 0
        self.standing, self.open = [[] for _ in range(self.window + 1)], 0
        left = sum(len(p[2]) // 4 for p in pieces)
        targets = [self.window] * (left // self.window)
        rest = left % self.window
        targets += [1 << k for k in reversed(range(self.window.bit_length())) if rest >> k & 1]
        out, pieces = [], pieces[::-1]
        for room in targets:
            held = []
            while room:
                doc, start, ids = pieces.pop()
                take = min(room, len(ids) // 4)
                held.append((doc, start, ids[: 4 * take]))
                if len(ids) > 4 * take:
                    pieces.append((doc, start + take, ids[4 * take :]))
                room -= take
            out.append(held)
        return out


def _pack_partition(batches: Iterator[pa.RecordBatch], path: str, ranks: str | None, window: int, end_id: int, max_open: int) -> Iterator[pa.RecordBatch]:
    coder, packer = encoder(path, ranks), SquaresPacker(window, max_open)
    end = np.array([end_id], dtype="<u4").tobytes()
    base = TaskContext.get().partitionId() << 32
    serial = 0
    rows: list[tuple] = []

    def close(windows: list[list]) -> None:
        nonlocal serial
        for held in windows:
            offset = 0
            for (doc_id, tokens), start, ids in held:
                n = len(ids) // 4
                rows.append((doc_id, start, n, zlib.crc32(ids), tokens, base + serial, offset))
                offset += n
            serial += 1

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 7)],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )
        rows.clear()
        return out

    for chunk in chunks(batches):
        for doc_id, text in zip(chunk.column(0).to_pylist(), chunk.column(1).to_pylist(), strict=True):
            ids = coder.encode(text or "") + end
            n = len(ids) // 4
            for start in range(0, n, window):
                close(packer.place(((doc_id, n), start, ids[4 * start : 4 * (start + window)])))
        if len(rows) >= 10_000:
            yield batch()
    close(packer.drain())
    yield batch()


def pack_documents(
    docs: DataFrame, tokenizer: str, ranks: str | None = None, window: int = WINDOW, end_id: int = 1, max_open: int = 4096
) -> DataFrame:
    """One row per piece of a document, with its sequence and its place there.

    ``tokenizer`` is a ``tokenizers`` JSON file that every executor can read at that path, ``ranks`` the same vocabulary
    for tiktoken (see ``Encoder``); ``window`` a power of two. Needs
    the columns ``doc_id`` and ``text``; others are left out. A null or empty text is one piece that holds the end token. A
    null doc_id stays null; repeated rows are packed each. An empty table gives no rows. Memory per task: ``max_open`` open
    windows and one chunk of texts. Sequence ids hold the partition's number in the upper 32 bits; the packing of a
    partition follows its row order, so read documents from files (as the pipeline does) or sort within partitions.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    return map_arrow(
        docs.select(docs["doc_id"].cast("long"), docs["text"]), lambda it: _pack_partition(it, tokenizer, ranks, window, end_id, max_open), SCHEMA
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path
    return pack_documents(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))
