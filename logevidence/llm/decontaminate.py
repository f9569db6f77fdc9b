"""Benchmark decontamination by suffix arrays of the training text.

Documents are worked on in shards (the chunks of a partition). A shard's words become 64-bit hashes; its suffix array holds
the word positions in the order of their next ``WINDOW`` words (packed into integer keys of four words each). Every suffix of
the benchmark that starts a window is found in it by binary search, identical ones once, which gives all its occurrences as one
stretch of the array; word by word comparison confirms them, first by hash and then by bytes. Occurrences that follow each other
in document and item make the longest verbatim matches. Documents are not shuffled; the benchmark is sent to the tasks in
blocks of bounded size, one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, schema_with_row, table, whole_row
from .textbytes import chunks, lower_ascii, raw_texts, text_of, word_hashes, words

WINDOW = 13
#: Bytes of benchmark text that one pass over the documents takes along; a larger benchmark needs more passes.
BLOCK_BYTES = 16 << 20
#: Pairs of a place in a document and one in an item that are looked at at once.
PAIRS = 2_000_000
#: Found documents up to this number are sent to the tasks that read the documents; more are joined by a shuffle.
MOST_SENT = 500_000

_INSIDE = np.ones(256, bool)
_INSIDE[0x00:0x30] = _INSIDE[0x3A:0x61] = _INSIDE[0x7B:0x80] = False
FOUND = "hits array<struct<first:long,last:long>>, items array<struct<item:string,longest:long,at:long>>"
_HITS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_ITEMS = pa.list_(pa.struct([("item", pa.string()), ("longest", pa.int64()), ("at", pa.int64())]))


class Words:
    """The words of a text column in lower case: hashes, places of their bytes, and the offsets of the rows among them."""

    def __init__(self, column: pa.Array, seed: int = 0):
        data, off = raw_texts(column)
        self.data = lower_ascii(data)
        self.start, self.end, self.row = words(self.data, off, _INSIDE)
        self.hash = word_hashes(self.data, self.start, self.end, seed)
        self.off = np.searchsorted(self.row, np.arange(len(off)))

    def __len__(self) -> int:
        return len(self.hash)

    def bytes_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of some words one after the other, and the length of each."""
        size = self.end[at] - self.start[at]
        head = np.cumsum(size) - size
        return self.data[np.repeat(self.start[at] - head, size) + np.arange(int(size.sum()))], size


def same_words(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Whether word i of ``a`` and word j of ``b`` have the same bytes."""
    out = a.end[i] - a.start[i] == b.end[j] - b.start[j]
    some = np.flatnonzero(out)
    x, size = a.bytes_of(i[some])
    y, _ = b.bytes_of(j[some])
    if len(x):
        out[some] = np.logical_and.reduceat(x == y, np.cumsum(size) - size)
    return out


def packed(seq: np.ndarray, at: np.ndarray, first: int) -> np.ndarray:
    """16 bits of each of the four words from ``first`` on, as one integer; words past the end count as zero."""
    key = np.zeros(len(at), dtype=np.uint64)
    for j in range(first, first + 4):
        key = (key << np.uint64(16)) | (seq[np.minimum(at + j, len(seq) - 1)] >> np.uint64(48)) * (at + j < len(seq))
    return key


class SuffixArray:
    """Positions of a word sequence in the order of their next ``window`` words, of which the keys hold 16 bits each."""

    def __init__(self, seq: np.ndarray, window: int = WINDOW):
        self.seq = seq
        every = np.arange(len(seq))
        keys = [packed(seq, every, first) for first in range(0, window, 4)]
        self.order = np.lexsort(keys[::-1]) if keys else every
        self.keys = [k[self.order] for k in keys]

    def bound(self, wanted: list[np.ndarray], low: np.ndarray, high: np.ndarray, after: bool) -> np.ndarray:
        """Within low..high the first suffix that does not stand before the wanted keys, or that stands after them."""
        low, high = low.copy(), high.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) // 2
            ahead = np.full(len(open_), after)  # equal in all keys
            for mine, theirs in zip(reversed(self.keys), reversed(wanted), strict=True):
                x, y = mine[middle], theirs[open_]
                ahead = np.where(x == y, ahead, x < y)
            low[open_], high[open_] = np.where(ahead, middle + 1, low[open_]), np.where(ahead, high[open_], middle)
            open_ = open_[low[open_] < high[open_]]
        return low

    def stretches(self, wanted: list[np.ndarray], length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the suffixes that begin with the first ``length`` of the words in the wanted keys."""
        least, most = [], []
        for k, key in enumerate(wanted):
            shown = np.clip(length - 4 * k, 0, 4).astype(np.uint64)
            rest = np.where(shown == 0, ~np.uint64(0), (np.uint64(1) << (np.uint64(16) * (np.uint64(4) - np.maximum(shown, np.uint64(1))))) - np.uint64(1))
            least.append(key & ~rest)
            most.append(key | rest)
        low = np.searchsorted(self.keys[0], least[0])
        high = np.searchsorted(self.keys[0], most[0], side="right")
        return self.bound(least, low, high, False), self.bound(most, low, high, True)


class Benchmark:
    """The windows of a block of items. Equal windows are one class: ``first`` its first word, ``length`` its words.

    ``of`` names the class of each window in the order of items and places; ``at`` is its first word.
    """

    def __init__(self, items: list[str], texts: list[str | None], window: int = WINDOW):
        self.items, self.window = items, window
        for seed in count():  # until no two words of the block share a hash
            self.words = Words(pa.array(texts, pa.string()), seed)
            _, at, of = np.unique(self.words.hash, return_index=True, return_inverse=True)
            if not len(self.words) or same_words(self.words, np.arange(len(self.words)), self.words, at[of]).all():
                self.seed = seed
                break
        off, size = self.words.off, np.diff(self.words.off)
        many = np.where(size > 0, np.maximum(size - window + 1, 1), 0)
        self.item = np.repeat(np.arange(len(items)), many)
        self.at = np.repeat(off[:-1] - np.cumsum(many) + many, many) + np.arange(many.sum())
        length = np.minimum(window, size[self.item])
        rank = np.unique(self.words.hash, return_inverse=True)[1]
        shown = np.array([np.where(j < length, rank[np.minimum(self.at + j, max(len(rank) - 1, 0))] + 1, 0) for j in range(window)] if len(self.at) else np.zeros((window, 0)))
        _, head, self.of = np.unique(shown, axis=1, return_index=True, return_inverse=True)
        self.of = self.of.ravel()
        self.first, self.length = self.at[head], length[head]
        self.keys = [packed(self.words.hash, self.first, k) for k in range(0, window, 4)] if len(self.words) else []
        classes = np.arange(len(self.first) + 1)
        pair, n = np.unique(np.column_stack([self.of, self.item]), axis=0, return_counts=True)
        looping = np.zeros(len(items), bool)  # items in which a window occurs twice
        looping[pair[n > 1, 1]] = True
        pair = pair[looping[pair[:, 1]]]
        self.looping_item, self.looping_start = pair[:, 1], np.searchsorted(pair[:, 0], classes)  # those items of each class
        # the windows of each class in other items, by item and place
        by_class = np.argsort(self.of, kind="stable")
        self.by_class = by_class[~looping[self.item[by_class]]]
        self.class_start = np.searchsorted(self.of[self.by_class], classes)

    def occurrences(self, text: Words) -> tuple[np.ndarray, np.ndarray]:
        """Class and place of each verified occurrence of a window within a row; a place has few: one of each length."""
        none = np.zeros(0, np.int64)
        if not len(self.first) or not len(text):
            return none, none
        sa = SuffixArray(text.hash, self.window)
        low, high = sa.stretches(self.keys, self.length)
        some = np.flatnonzero(high > low)
        n = (high - low)[some]
        c = np.repeat(some, n)
        p = sa.order[np.repeat(low[some] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        end = text.off[1:][text.row]
        for j in range(self.window):
            more = j < self.length[c]
            same = ~more | ((p + j < end[p]) & (text.hash[np.minimum(p + j, len(text) - 1)] == self.words.hash[np.minimum(self.first[c] + j, len(self.words) - 1)]))
            c, p = c[same], p[same]
        return self.confirmed(text, c, p)

    def confirmed(self, text: Words, c: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without the occurrences that hold a word whose hash is that of another word."""
        hit = covered(p, self.length[c], len(text))
        at = np.flatnonzero(hit)
        value, place = np.unique(self.words.hash, return_index=True)
        wrong = np.zeros(len(text) + 1, np.int64)
        wrong[at + 1] = ~same_words(text, at, self.words, place[np.searchsorted(value, text.hash[at])])
        wrong = np.cumsum(wrong)
        fine = wrong[p + self.length[c]] == wrong[p]
        return c[fine], p[fine]


def covered(p: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the stretches."""
    mark = np.zeros(n + 1, dtype=np.int64)
    np.add.at(mark, p, 1)
    np.add.at(mark, p + length, -1)
    return np.cumsum(mark[:-1]) > 0


def joined(stretches: list[dict]) -> list[dict]:
    """Stretches that touch or overlap become one."""
    out: list[dict] = []
    for s in sorted(stretches, key=lambda s: s["first"]):
        if out and s["first"] <= out[-1]["last"] + 1:
            out[-1]["last"] = max(out[-1]["last"], s["last"])
        else:
            out.append(dict(s))
    return out


def longest_common(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Length of the longest run of values that two sequences share, and its first place in ``a``.

    The runs of a length get the same number where they are equal (by doubling), so a length is tested by looking numbers up;
    the length itself is found by binary search.
    """
    r = np.unique(np.concatenate([a, b]), return_inverse=True)[1]
    both = np.concatenate([r[: len(a)], [len(r)], r[len(a) :], [len(r) + 1]])  # ends that equal nothing
    ranks = [both]  # numbers of the runs of 2^k values, by their first place
    while 1 << len(ranks) <= min(len(a), len(b)):
        r, half = ranks[-1], 1 << len(ranks) - 1
        ranks.append(np.unique(r[:-half] * np.int64(len(both)) + r[half:], return_inverse=True)[1])

    def meeting(n: int) -> int:
        k = n.bit_length() - 1
        r = ranks[k]
        key = r[: len(both) - n + 1] * np.int64(len(both)) + r[n - (1 << k) : n - (1 << k) + len(both) - n + 1]
        found = np.flatnonzero(np.isin(key[: max(len(a) - n + 1, 0)], key[len(a) + 1 : len(a) + 1 + max(len(b) - n + 1, 0)]))
        return int(found[0]) if len(found) else -1

    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if meeting(middle) >= 0 else (low, middle - 1)
    return low, meeting(low) if low else -1


def longest_matches(bench: Benchmark, text: Words, c: np.ndarray, p: np.ndarray) -> dict[tuple[int, str], tuple[int, int]]:
    """(row, item) -> length of the longest verbatim match and its first word in the row, of the first one negated.

    Items without a repeated window meet each place of a document at one place at most, and matches are chains of pairs of
    places; documents and items that repeat themselves are compared as sequences, since their pairs would multiply.
    """
    out: dict[tuple[int, str], tuple[int, int]] = {}
    if not len(c):
        return out

    def put(row: int, item: int, found: tuple[int, int]) -> None:
        key = (row, bench.items[item])
        out[key] = max(found, out.get(key, (0, 0)))

    order = np.lexsort((c, p))
    c, p = c[order], p[order]
    many = np.diff(bench.class_start)[c]
    parts = np.cumsum(many) // PAIRS
    row_class = np.unique(np.column_stack([text.row[p], c]), axis=0)
    n = np.diff(bench.looping_start)[row_class[:, 1]]
    loops = {
        (int(row), int(item)) for (row, k), some in zip(row_class[n > 0].tolist(), n[n > 0].tolist(), strict=True)
        for item in bench.looping_item[bench.looping_start[k] : bench.looping_start[k] + some]
    }
    chain: dict[tuple[int, int], tuple[int, int, int]] = {}  # (item, diagonal) -> its chain's first place, last place, length of the last window
    for part in np.unique(parts):
        some = np.flatnonzero(parts == part)
        n = many[some]
        at = np.repeat(some, n)
        window = bench.by_class[np.repeat(bench.class_start[c[some]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        item = bench.item[window]
        place, diagonal = p[at], p[at] - bench.at[window]
        by = np.lexsort((place, diagonal, item))
        place, diagonal, item, length = place[by], diagonal[by], item[by], bench.length[c[at]][by]
        new = np.append(True, (diagonal[1:] != diagonal[:-1]) | (place[1:] != place[:-1] + 1) | (item[1:] != item[:-1])) if len(place) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(place)) - 1 if len(place) else head
        after: dict[tuple[int, int], tuple[int, int, int]] = {}
        for a, b in zip(head.tolist(), tail.tolist(), strict=True):
            begin, end, last = int(place[a]), int(place[b]), int(length[b])
            key = (int(item[a]), int(diagonal[a]))
            if key in chain and chain[key][1] == begin - 1:  # goes on from the part before
                begin = chain[key][0]
            after[key] = (begin, end, last)
            row = int(text.row[begin])
            put(row, key[0], (end - begin + last, -int(begin - text.off[row])))
        chain = after
    for row, item in sorted(loops):
        mine = text.hash[text.off[row] : text.off[row + 1]]
        theirs = bench.words.hash[bench.words.off[item] : bench.words.off[item + 1]]
        n, begin = longest_common(mine.view(np.int64), theirs.view(np.int64))
        put(row, item, (n, -begin))
    return out


def _match(batches: Iterator[pa.RecordBatch], bench: Benchmark, only_found: bool) -> Iterator[pa.RecordBatch]:
    """Adds ``n_words, hits, items``; columns ``hits`` and ``items`` that are there already hold what other blocks found."""
    for chunk in chunks(batches):
        text = Words(text_of(chunk), bench.seed)
        n_words = np.diff(text.off)
        c, p = bench.occurrences(text)
        hits: list[list[dict]] = [[] for _ in range(chunk.num_rows)]
        items: list[dict] = [{} for _ in range(chunk.num_rows)]
        if len(p):
            inside = covered(p, bench.length[c], len(text))
            border = text.row[1:] != text.row[:-1]
            first = inside & np.append(True, ~inside[:-1] | border)
            last = inside & np.append(~inside[1:] | border, True)
            for a, b in zip(np.flatnonzero(first).tolist(), np.flatnonzero(last).tolist(), strict=True):
                r = int(text.row[a])
                hits[r].append({"first": a - int(text.off[r]), "last": b - int(text.off[r])})
            for (row, item), found in longest_matches(bench, text, c, p).items():
                items[row][item] = found
        names = chunk.schema.names
        if "hits" in names:
            for mine, theirs in zip(hits, chunk.column(names.index("hits")).to_pylist(), strict=True):
                mine[:] = joined(mine + (theirs or []))
            for mine, theirs in zip(items, chunk.column(names.index("items")).to_pylist(), strict=True):
                for x in theirs or []:
                    mine[x["item"]] = max((x["longest"], -x["at"]), mine.get(x["item"], (0, 0)))
        listed = [[{"item": i, "longest": n, "at": -at} for i, (n, at) in sorted(d.items())] for d in items]
        out = pa.RecordBatch.from_arrays(
            [chunk.column(0), *(chunk.column(names.index(k)) for k in ("th", "row") if k in names),
             pa.array(n_words, pa.int64()), pa.array(hits, _HITS), pa.array(listed, _ITEMS)],
            names=["doc_id", *(k for k in ("th", "row") if k in names), "n_words", "hits", "items"],
        )
        yield out.filter(pa.array([bool(h) for h in hits])) if only_found else out


def _merged(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document from lists of what several blocks found."""
    for batch in groups:
        hits = [joined([h for one in row for h in one]) for row in batch.column(2).to_pylist()]
        items = []
        for row in batch.column(3).to_pylist():
            best: dict = {}
            for x in (x for one in row for x in one):
                best[x["item"]] = max((x["longest"], -x["at"]), best.get(x["item"], (0, 0)))
            items.append([{"item": i, "longest": n, "at": -at} for i, (n, at) in sorted(best.items())])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(hits, _HITS), pa.array(items, _ITEMS)], names=["doc_id", "th", "hits", "items"]
        )


def blocks_of(benchmark: DataFrame, block_bytes: int) -> Iterator[list]:
    """The items in blocks of bounded size; the driver holds one block at a time."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("item IS NOT NULL AND text IS NOT NULL").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    parts = max(1, -(-size // block_bytes))
    for i in range(parts):
        yield rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == i).collect()


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, carry: bool = False, most_sent: int = MOST_SENT
) -> DataFrame:
    """``doc_id, n_words, hits, items`` for every row of ``docs`` (``doc_id``, ``text``; other columns are ignored).

    ``hits`` are the maximal stretches of words (first, last) that lie inside an occurrence of a benchmark window, ``items``
    the items with an occurring window, each with the length and first word of its longest verbatim match. ``benchmark`` has
    ``item_id, text``; rows with a null in either, or without words, have no window; an item_id with several texts has the
    windows of all. Null documents have no words; the memory for a long text is in proportion to it, also where document and
    item repeat one word. Null ids stay null, repeated rows are each answered, an empty table gives no rows. With ``carry``, a
    column ``row`` holds the whole row of ``docs``. Runs jobs that fetch the benchmark; beyond ``block_bytes`` of it, each
    block but the last takes a pass over the documents that writes what it found to the shared folder. What was found is sent
    to the tasks if it concerns at most ``most_sent`` documents, else joined by a shuffle.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    whole = whole_row(docs) if carry else docs["text"]
    key = [docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("th")]
    before: list[DataFrame] = []
    rows: list = []
    for i, rows_now in enumerate(blocks_of(benchmark, block_bytes)):
        if i:  # the block before is not the last
            sent = spark.sparkContext.broadcast(Benchmark([r["item"] for r in rows], [r["text"] for r in rows], window))
            found = map_arrow(docs.select(*key, docs["text"]), lambda it, b=sent: _match(it, b.value, True), f"doc_id long, th long, n_words long, {FOUND}")
            before.append(scratch.write(found.drop("n_words").dropDuplicates(["doc_id", "th"])))
            sent.destroy()
        rows = rows_now
    sent = spark.sparkContext.broadcast(Benchmark([r["item"] for r in rows], [r["text"] for r in rows], window))
    read = docs.select(key[0], whole)
    if before:
        every = before[0]
        for more in before[1:]:
            every = every.unionByName(more)
        lists = every.groupBy("doc_id", "th").agg(F.collect_list("hits").alias("hits"), F.collect_list("items").alias("items"))
        known = scratch.write(map_arrow(lists, _merged, f"doc_id long, th long, {FOUND}"))
        known = known.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "hits", "items")
        known = F.broadcast(known) if known.count() <= most_sent else known
        read = docs.select(*key, whole.alias("row" if carry else "text"))
        read = read.join(known, read["doc_id"].eqNullSafe(known["d"]) & (read["th"] == known["t"]), "left").drop("d", "t", "th")
    return map_arrow(read, lambda it: _match(it, sent.value, False), schema_with_row(f"n_words long, {FOUND}", read, "doc_id long"))


def verdicts(found: DataFrame) -> DataFrame:
    """The digest columns of ``contamination``, and whether a document is contaminated: a twentieth of its words are hit."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["last"] - h["first"] + 1)
    names = F.array_sort(F.transform("items", lambda x: x["item"]))
    return found.select(
        *(c for c in found.columns if c == "row"), "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.coalesce(F.array_max(F.transform("items", lambda x: x["longest"])), F.lit(0)).alias("longest_match"),
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
