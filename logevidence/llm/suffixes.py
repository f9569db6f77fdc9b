"""Removal of long repeated byte strings by hash-compared suffix sorts.

Every start of a ``LENGTH``-byte string is tied to the anchor of that string: of its ``ANCHOR``-byte substrings, the one with
the smallest hash (the last of equals). Equal strings have equal anchors at equal places, so they meet where anchors are
dealt by their hash, though only about one position in sixty is an anchor. Neighbouring starts with one anchor form a run.

1. Runs whose whole surroundings (all bytes of their strings) occur twice are repeated as they are. A task settles those it
   sees itself, checked byte by byte, and passes on one row of each, so that frequent passages don't pile up behind one key;
   between tasks surroundings are compared by a cryptographic digest, not by the polynomial hash that groups them.
2. What is left of an anchor with several surroundings, the edges of repeats, is settled by suffix sorts: the suffixes that
   start at the anchors, and the reversed prefixes that end there, are merge-sorted. Two suffixes are compared by a binary
   search for their common extension over prefix polynomial hashes, which takes logarithmically many steps; the extensions
   of neighbours are verified byte by byte. From both orders follow, for each distance k, the classes of equal k bytes before
   and ``LENGTH - k`` bytes from the anchor on; a string is repeated where another one shares both classes.
3. The covered stretches of each document are merged and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, table
from .textbytes import chunks, mix, prefix_hashes, raw_texts, stretch_hash

LENGTH, ANCHOR = 200, 64
#: Bits that hold a position within a chunk of text; the hash has the rest.
_PLACE = np.uint64(31)
#: Anchors with more different surroundings than this are settled string by string instead of in one task.
HOT = 20_000
#: Surroundings that are sorted at once.
SORT_ROWS = 20_000
RUN = "h long, c long, w int, doc_id long, th long, q int, a int, b int"


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` neighbours, from block-wise running minima of both directions."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, anchor, first and last start of each run (places in ``data``), and the hashes of anchor and surroundings."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    size = np.diff(off)
    if len(data) < LENGTH or not (size >= LENGTH).any():
        return none
    p = prefix_hashes(data)
    place = np.arange(len(data) - ANCHOR + 1)
    gram = mix(stretch_hash(p, place, place + ANCHOR))
    low = np.uint64((1 << int(_PLACE)) - 1)
    key = (gram >> _PLACE << _PLACE) | (low - place.astype(np.uint64))
    least = sliding_least(key, LENGTH - ANCHOR + 1)
    rows = np.flatnonzero(size >= LENGTH)
    many = size[rows] - LENGTH + 1
    row = np.repeat(rows, many)
    start = np.repeat(off[rows] - np.cumsum(many) + many, many) + np.arange(many.sum())
    anchor = (low - (least[start] & low)).astype(np.int64)
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    a, b, q = start[first], start[last], anchor[first]
    around = mix(stretch_hash(p, a, b + LENGTH) + ((b - a) * 65_536 + (q - a)).astype(np.uint64))
    return row[first], q, a, b, gram[q], around


def merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of each row, joined where they touch or overlap."""
    if not len(row):
        return row, start, end
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    shift = row * (int(end.max()) + 2)  # rows apart from each other on one axis
    reach = np.maximum.accumulate(end + shift)
    new = np.append(True, start[1:] + shift[1:] > reach[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    return row[first], start[first], reach[last] - shift[last]


def checked_groups(data: np.ndarray, h: np.ndarray, c: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which rows of equal h, c and bytes stand together, and where in it a group begins.

    Rows of equal hashes are compared with the first of them byte by byte; the few that differ, if any, go by their bytes.
    """
    order = np.lexsort((c, h))
    if not len(order):
        return order, np.zeros(0, bool)
    new = np.append(True, (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1]))
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    size = end - start
    differs = size[order] != size[head]
    rest = np.flatnonzero((order != head) & ~differs)
    for part in np.array_split(rest, max(1, int(size[order[rest]].sum()) // (8 << 20))):
        n = size[order[part]]
        if not len(n):
            continue
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        same = data[np.repeat(start[order[part]], n) + step] == data[np.repeat(start[head[part]], n) + step]
        differs[part] = ~np.logical_and.reduceat(same, np.cumsum(n) - n)
    if differs.any():
        raw = data.tobytes()
        order = np.array(sorted(range(len(h)), key=lambda i: (h[i], c[i], raw[start[i] : end[i]])), dtype=np.int64)
        key = [(h[i], c[i], raw[start[i] : end[i]]) for i in order]
        new = np.array([True] + [x != y for x, y in zip(key, key[1:], strict=False)])
    return order, new


def digests_of(data: np.ndarray, start: np.ndarray, end: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """64 bits of BLAKE2b of stretches of bytes, each with some numbers: equal by design for equal input, else by chance alone."""
    raw = memoryview(np.ascontiguousarray(data))
    extra = np.column_stack([x.astype(np.int32) for x in more])
    out = [
        hashlib.blake2b(raw[x:y], digest_size=8, salt=e.tobytes()).digest() for x, y, e in zip(start.tolist(), end.tolist(), extra, strict=True)
    ]
    return np.frombuffer(b"".join(out), np.uint64) if out else np.zeros(0, np.uint64)


def _batch(columns: dict[str, np.ndarray], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds[k]) for n, k in fields], names=[n for n, _ in fields])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of RUN. w = 0: the stretch a..b of a document is repeated. w = 1: a run; w = 2: one of several settled here."""
    for chunk in chunks(batches):
        data, off = raw_texts(chunk.column(2))
        row, q, a, b, h, c = runs_of(data, off)
        doc = chunk.column(0).to_numpy(zero_copy_only=False)
        doc = np.asarray([-1 if x is None else x for x in chunk.column(0).to_pylist()], dtype=np.int64) if chunk.column(0).null_count else doc.astype(np.int64)
        missing = np.asarray(chunk.column(0).is_null())
        th = chunk.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        order, new = checked_groups(data, h, c, a, b + LENGTH)
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1 if len(h) else new
        settled = order[many]
        passed = order[new]
        c = c.copy()
        c[passed] = digests_of(data, a[passed], b[passed] + LENGTH, (b - a)[passed], (q - a)[passed])
        w = np.where(many[new], 2, 1)
        r, s, e = merged(row[settled], a[settled] - off[row[settled]], b[settled] + LENGTH - off[row[settled]])
        zero = np.zeros(len(r), np.int64)
        parts = {
            "h": np.append(h[passed].view(np.int64), zero), "c": np.append(c[passed].view(np.int64), zero), "w": np.append(w, zero),
            "q": np.append((q - off[row])[passed], zero), "a": np.append((a - off[row])[passed], s), "b": np.append((b - off[row])[passed], e),
        }
        of = np.append(row[passed], r)
        parts["th"] = th[of]
        parts["doc_id"] = pa.array(doc[of], mask=missing[of])
        yield _batch(parts, RUN)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by h and c. Gives w = 0 for settled stretches, w = 1 for edges, w = 2 for settled partners of edges.

    Only the last group of equal (h, c) is held over from batch to batch.
    """
    held: list[pa.RecordBatch] = []
    before = None  # h of the group before the held one

    def answer(t: pa.Table, last_open: int | None) -> pa.RecordBatch:
        h, c, w = (t.column(i).to_numpy() for i in range(3))
        new = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]))
        group = np.cumsum(new) - 1
        weight = np.bincount(group, w)
        heads = h[new]
        company = np.zeros(len(heads), bool)  # other surroundings of the same anchor
        company[1:] |= heads[1:] == heads[:-1]
        company[:-1] |= heads[1:] == heads[:-1]
        company[0] |= before is not None and before == heads[0]
        company[-1] |= last_open is not None and last_open == heads[-1]
        repeated = weight[group] > 1
        settled = repeated & (w == 1)
        edge = ~repeated & company[group]
        partner = repeated & new & company[group]
        # the stretch of a settled run ends LENGTH bytes after its last start
        pick = np.concatenate([np.flatnonzero(settled), np.flatnonzero(edge), np.flatnonzero(partner)])
        kind = np.repeat([0, 1, 2], [settled.sum(), edge.sum(), partner.sum()])
        out = t.take(pa.array(pick))
        b = out.column(7).to_numpy() + np.where(kind == 0, LENGTH, 0)
        arrays = [out.column(i) for i in range(8)]
        arrays[2], arrays[7] = pa.chunked_array([pa.array(kind, pa.int32())]), pa.chunked_array([pa.array(b, pa.int32())])
        return pa.Table.from_arrays(arrays, names=t.column_names).combine_chunks().to_batches(max_chunksize=1 << 30)

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([*held, batch])
        h, c = t.column(0).to_numpy(), t.column(1).to_numpy()
        same = (h == h[-1]) & (c == c[-1])
        cut = int(np.flatnonzero(same)[0])
        if cut:
            yield from answer(t.slice(0, cut), int(h[-1]))
            before = int(h[cut - 1])
        held = t.slice(cut).to_batches()
    if held:
        yield from answer(pa.Table.from_batches(held), None)


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each run's strings. Columns: doc_id, th, text, edges (h, w, hot, q, a, b)."""
    for batch in batches:
        for chunk in chunks([batch]):
            data, off = raw_texts(chunk.column(2))
            raw = data.tobytes()
            out: list[list] = [[] for _ in range(9)]
            for i, (doc, th, edges) in enumerate(zip(*(chunk.column(k).to_pylist() for k in (0, 1, 3)), strict=True)):
                for e in edges:
                    at = int(off[i]) + e["a"]
                    row = (e["h"], e["hot"], doc, th, e["w"], e["q"], e["a"], e["b"], raw[at : int(off[i]) + e["b"] + LENGTH])
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["h", "hot", "doc_id", "th", "w", "q", "a", "b", "around"]
            )


class HashedSuffixes:
    """Suffixes of one byte string, compared through prefix hashes."""

    def __init__(self, data: np.ndarray, start: np.ndarray, room: np.ndarray):
        self.data, self.start, self.room = data, start, room
        self.p = prefix_hashes(data)

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes i and j, by binary search over hashes."""
        a, b = self.start[i], self.start[j]
        low, high = np.zeros(len(i), np.int64), np.minimum(self.room[i], self.room[j])
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = stretch_hash(self.p, a, a + middle) == stretch_hash(self.p, b, b + middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Does suffix i stand before suffix j? A suffix that ends first stands first; equal ones go by their number."""
        n = self.extension(i, j)
        end_i, end_j = n == self.room[i], n == self.room[j]
        last = len(self.data) - 1
        x, y = self.data[np.minimum(self.start[i] + n, last)], self.data[np.minimum(self.start[j] + n, last)]
        return np.where(end_i | end_j, np.where(end_i & end_j, i < j, end_i), x < y)

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes within each group (groups stand together): a bottom-up merge sort of all groups at once.

        An element's place in the merged run is its place in its own run plus its rank in the other, by binary search.
        """
        n = len(group)
        order = np.arange(n)
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else order
        size = np.diff(np.append(first, n))
        base, length = np.repeat(first, size), np.repeat(size, size)
        width = 1
        while n and width < size.max():
            live = np.flatnonzero(length > width)
            nth = live - base[live]
            own = nth // width
            other = own ^ 1
            low = np.minimum(other * width, length[live])
            high = np.minimum(low + width, length[live])
            start, me, is_left = low.copy(), order[live], own % 2 == 0
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) // 2
                that = order[base[live][open_] + middle]
                ahead = self.before(that, me[open_])
                low[open_], high[open_] = np.where(ahead, middle + 1, low[open_]), np.where(ahead, high[open_], middle)
            place = base[live] + np.where(is_left, own, other) * width + (nth - own * width) + (low - start)
            order[place] = me
            width *= 2
        return order

    def neighbours(self, order: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Common extension of each suffix with the one before it in its group, verified byte by byte; -1 at a group's first."""
        out = np.full(len(order), -1, dtype=np.int64)
        at = np.flatnonzero(group[1:] == group[:-1]) + 1
        i, j = order[at - 1], order[at]
        n = self.extension(i, j)
        for step in range(int(n.max()) if len(n) else 0):  # a hash collision would shorten the extension to where bytes differ
            wrong = (step < n) & (self.data[np.minimum(self.start[i] + step, len(self.data) - 1)] != self.data[np.minimum(self.start[j] + step, len(self.data) - 1)])
            n[wrong] = step
        out[at] = n
        return out


def repeated_starts(group: np.ndarray, around: list[bytes], anchor: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Member and distance k of every string that another member of its group has too.

    Members stand together by group. ``anchor`` is the anchor's place in each member's bytes, ``starts`` how many strings the
    member has (they begin at its first bytes).
    """
    size = np.array([len(x) for x in around], dtype=np.int64)
    data = np.frombuffer(b"".join(around), dtype=np.uint8)
    head = np.cumsum(size) - size
    ahead = HashedSuffixes(data, head + anchor, size - anchor)
    back = HashedSuffixes(data[::-1], len(data) - (head + anchor), anchor)
    n = len(size)
    orders = []
    for s in (ahead, back):
        order = s.sort(group)
        orders.append((order, s.neighbours(order, group)))
    found_m, found_k = [], []
    low, high = anchor - starts + 1, anchor  # the distances that a member's strings have
    for k in range(int(low.min()), int(high.max()) + 1):
        label = []
        for (order, common), depth in zip(orders, (LENGTH - k, k), strict=True):
            of = np.empty(n, dtype=np.int64)
            of[order] = np.cumsum(common < depth)
            label.append(of)
        part = np.flatnonzero((low <= k) & (k <= high))
        if len(part) < 2:
            continue
        both = label[0][part] * (n + 1) + label[1][part]
        _, inverse, count = np.unique(both, return_inverse=True, return_counts=True)
        twice = part[count[inverse] > 1]
        found_m.append(twice)
        found_k.append(np.full(len(twice), k))
    if not found_m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_m), np.concatenate(found_k)


SPAN = "doc_id long, th long, a int, b int"


def _sort_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches that the suffix sorts find repeated. Rows sorted by h."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        h = t.column("h").to_numpy()
        q, a, b, w = (t.column(c).to_numpy().astype(np.int64) for c in ("q", "a", "b", "w"))
        group = np.cumsum(np.append(True, h[1:] != h[:-1])) - 1
        m, k = repeated_starts(group, t.column("around").to_pylist(), q - a, b - a + 1)
        mine = w[m] == 1
        m, start = m[mine], (q[m] - k)[mine]
        m, start, end = merged(m, start, start + LENGTH)
        at = pa.array(m)
        yield from pa.table({
            "doc_id": t.column("doc_id").take(at), "th": t.column("th").take(at), "a": pa.array(start, pa.int32()), "b": pa.array(end, pa.int32()),
        }).to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= SORT_ROWS:
            t = pa.Table.from_batches(held)
            h = t.column("h").to_numpy()
            cut = int(np.flatnonzero(h == h[-1])[0])
            if cut:
                yield from solve(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                rows = t.num_rows - cut
    if held:
        yield from solve(pa.Table.from_batches(held))


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per string of a hot anchor: its place, and two hashes of its bytes."""
    for batch in batches:
        a, q = (batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("a", "q"))
        around = batch.column(batch.schema.get_field_index("around")).to_pylist()
        size = np.array([len(x) for x in around], dtype=np.int64)
        if not len(size):
            continue
        data = np.frombuffer(b"".join(around), dtype=np.uint8)
        many = size - LENGTH + 1
        of = np.repeat(np.arange(len(size)), many)
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        start = np.repeat(np.cumsum(size) - size, many) + nth
        p, back = prefix_hashes(data), prefix_hashes(data[::-1])
        x = mix(stretch_hash(p, start, start + LENGTH))
        y = mix(stretch_hash(back, len(data) - start - LENGTH, len(data) - start))
        at = pa.array(of)
        yield pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index(c)).take(at) for c in ("h", "w", "doc_id", "th")]
            + [pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), pa.array((a[of] + nth).astype(np.int32)), pa.array((a[of] + nth + LENGTH).astype(np.int32))],
            names=["h", "w", "doc_id", "th", "x", "y", "a", "b"],
        )


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks([batch]):
            data, off = raw_texts(chunk.column(2))
            raw = data.tobytes()
            out: list[list] = [[] for _ in range(6)]
            for i, (doc, th, spans) in enumerate(zip(*(chunk.column(k).to_pylist() for k in (0, 1, 3)), strict=True)):
                text = raw[int(off[i]) : int(off[i + 1])]
                a, b = (np.array([s[x] for s in spans], dtype=np.int64) for x in ("a", "b"))
                _, a, b = merged(np.zeros(len(a), np.int64), a, b)
                edges = [0, *np.column_stack([a, b]).ravel().tolist(), len(text)]
                kept = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                row = (doc, len(text), int((b - a).sum()), len(a), hashlib.sha256(kept).hexdigest(), [{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            kinds = [*[pa.int64()] * 4, pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
            )


def _texts_of(docs: DataFrame, rows: DataFrame, column: str, most_sent: int) -> DataFrame:
    """``doc_id, th, text`` with ``rows``' list, for the documents that have one. The texts are shuffled once.

    If there are at most ``most_sent`` of them, their keys go to the tasks that read, so that other texts aren't shuffled.
    """
    keys = rows.select("doc_id", "th")
    match = lambda left, right: left["doc_id"].eqNullSafe(right["doc_id"]) & (left["th"] == right["th"])
    if keys.count() <= most_sent:
        docs = docs.join(F.broadcast(keys), match(docs, keys), "left_semi")
    few = rows.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), column)
    return docs.join(few, docs["doc_id"].eqNullSafe(few["d"]) & (docs["th"] == few["t"])).select("doc_id", "th", "text", column)


def repeated_spans(docs: DataFrame, most_sent: int = 500_000) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed`` for every row of ``docs`` (``doc_id``, ``text``).

    A byte of a text's UTF-8 form is removed if it lies in a string of ``LENGTH`` bytes that also starts anywhere else in the
    table, in the same document or row copies included. ``removed`` lists the maximal removed stretches. A null text is
    empty; an empty or shorter one keeps everything. Null ids stay null, repeated rows are each answered (and are repeats of
    each other), other columns are ignored, an empty table gives no rows. Writes its intermediate tables to the shared folder
    and runs the jobs for that.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    runs = scratch.write(map_arrow(docs.where(F.octet_length("text") >= LENGTH), _anchors, RUN))
    # One exchange of the runs; a key has at most one row per chunk of text and surroundings.
    met = scratch.write(map_arrow(runs.where("w > 0").repartition("h").sortWithinPartitions("h", "c"), _settle, RUN))
    edges = met.where("w > 0")
    hot = edges.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("h", F.lit(True).alias("hot"))
    edges = edges.join(hot, "h", "left").select("doc_id", "th", F.struct("h", "w", F.coalesce("hot", F.lit(False)).alias("hot"), "q", "a", "b").alias("e"))
    edges = scratch.write(edges.groupBy("doc_id", "th").agg(F.collect_set("e").alias("edges")))  # rows that share both have one text
    around = scratch.write(map_arrow(
        _texts_of(docs, edges, "edges", most_sent), _surroundings, "h long, hot boolean, doc_id long, th long, w int, q int, a int, b int, around binary"
    ))
    cold = map_arrow(around.where("NOT hot").repartition("h").sortWithinPartitions("h"), _sort_edges, SPAN)
    strings = map_arrow(around.where("hot"), _strings, "h long, w int, doc_id long, th long, x long, y long, a int, b int")
    twice = strings.groupBy("h", "x", "y").agg(F.count("*").alias("n")).where("n > 1").select("h", "x", "y")
    warm = strings.where("w = 1").join(twice, ["h", "x", "y"]).select("doc_id", "th", "a", "b")
    settled = runs.where("w = 0").unionByName(met.where("w = 0")).select("doc_id", "th", "a", "b")
    spans = settled.unionByName(cold).unionByName(warm)
    spans = scratch.write(spans.groupBy("doc_id", "th").agg(F.collect_set(F.struct("a", "b")).alias("spans")))
    cut = map_arrow(
        _texts_of(docs, spans, "spans", most_sent), _cut_out,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>",
    )
    whole = docs.select("doc_id", "th", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
    keys = spans.select(F.col("doc_id").alias("d"), F.col("th").alias("t"))
    whole = whole.join(keys, whole["doc_id"].eqNullSafe(keys["d"]) & (whole["th"] == keys["t"]), "left_anti")
    zero = F.lit(0).cast("long")
    return cut.unionByName(whole.select(
        "doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), "kept_sha256", F.array().cast("array<struct<start:bigint,end:bigint>>").alias("removed")
    ))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
