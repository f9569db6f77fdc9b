"""Similarity join on word shingles by signature trees, and the components of its links.

Two documents link when their sets of shingles overlap by ``percent`` of their union. The steps, all exact up to equality of
64-bit hashes:

1. Documents with one set form a class; classes are the nodes. Each has a prefix of its set in an order that puts frequent
   shingles last; linked sets share a shingle of their prefixes, whatever the order.
2. The nodes that hold a shingle in their prefix form a bucket; buckets with the same nodes count once. In a bucket a
   signature tree holds token bitmaps and size ranges, leaves those of single sets, inner nodes the OR of their children's
   bitmaps. The tree is traversed against itself, and a pair of nodes is left out where the largest possible overlap cannot
   link. What is left are candidate links; of each task a spanning forest of them leaves.
3. Within the components of the candidates the same traversal runs over exact bitmaps (one bit per shingle that two sets of
   the job share), so the overlap of two leaves is their true overlap. The forests of true links give the components.

Buckets and components over ``BLOCK_NODES`` nodes are dealt into blocks, and each pair of blocks is a job of its own. No
pairs within a group leave a task, only forests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, table
from .components import components
from .textbytes import chunks, lower_ascii, mix, raw_texts, word_hashes, words

SHINGLE, PERCENT = 4, 85
#: Least words (64 bits each) of a hashed bitmap. It has two bits or more per shingle; a power of two, so that it folds.
BITMAP = 8
#: Shingles that a task counts at once to find frequent ones.
COUNTED = 1_500_000
LEAF, FANOUT = 32, 8
BLOCK_NODES = 2048
BLOCK_TOKENS = 1 << 19
#: How many of the most frequent shingles are put last in the order. Any order is right; this one keeps buckets small.
FREQUENT = 50_000

_INSIDE = np.ones(256, bool)
_INSIDE[[0x20, *range(0x09, 0x0E)]] = False


def shingle_sets(column: pa.Array, shingle: int, inside: np.ndarray = _INSIDE) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each distinct shingle of each row, sorted. Fewer words than a shingle has are one, none are none."""
    data, off = raw_texts(column)
    low = lower_ascii(data)
    start, end, row = words(low, off, inside)
    w = word_hashes(low, start, end)
    count = np.bincount(row, minlength=len(off) - 1)
    full = np.arange(max(len(w) - shingle + 1, 0))
    full = full[row[full] == row[full + shingle - 1]] if len(full) else full
    h = np.full(len(full), shingle, dtype=np.uint64)
    for j in range(shingle):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[full + j])
    rows = row[full] if len(full) else np.zeros(0, np.int64)
    few = np.flatnonzero((count > 0) & (count < shingle))
    if len(few):
        first = np.searchsorted(row, few)
        g = count[few].astype(np.uint64)
        for j in range(shingle - 1):
            more = j < count[few]
            g = np.where(more, mix(g * np.uint64(0x9E3779B97F4A7C15) + w[np.minimum(first + j, len(w) - 1)]), g)
        h, rows = np.append(h, g), np.append(rows, few)
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    new = np.append(True, (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])) if len(h) else np.zeros(0, bool)
    return rows[new], h[new]


def node_ids(rows: np.ndarray, h: np.ndarray, count: int) -> np.ndarray:
    """One 64-bit value per row for its whole set."""
    total = np.zeros(count, dtype=np.uint64)
    np.add.at(total, rows, mix(h ^ np.uint64(0x5851F42D4C957F2D)))
    size = np.bincount(rows, minlength=count).astype(np.uint64)
    return mix(total + size * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _frequent(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def count() -> pa.RecordBatch:
        token, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
        held.clear()
        token, n = token[n > 1], n[n > 1]
        return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n, pa.int64())], names=["token", "n"])

    for chunk in chunks(batches):
        held.append(shingle_sets(chunk.column(0), shingle)[1])
        if sum(map(len, held)) >= COUNTED:
            yield count()
    yield count()


def hashed_bitmaps(rows: np.ndarray, h: np.ndarray, size: np.ndarray) -> list[bytes]:
    """One bitmap per row, of twice as many bits as it has shingles, rounded up to a power of two."""
    width = np.maximum(1 << np.ceil(np.log2(np.maximum(2 * size, 1) / 64)).clip(0).astype(np.int64), BITMAP)
    head = np.append(0, np.cumsum(width))
    flags = np.zeros(int(head[-1]) * 64, dtype=np.uint8)
    flags[head[rows] * 64 + (h % (width[rows] * 64).astype(np.uint64)).astype(np.int64)] = 1
    raw = np.packbits(flags, bitorder="little").tobytes()
    return [raw[8 * a : 8 * b] for a, b in zip(head[:-1].tolist(), head[1:].tolist(), strict=True)]


def folded(raw: list[bytes], width: int | None = None) -> np.ndarray:
    """Bitmaps as rows of ``width`` words (the least that one of them has), longer ones folded by OR."""
    words_of = np.array([len(x) // 8 for x in raw])
    width = width or int(words_of.min())
    out = np.empty((len(raw), width), dtype=np.uint64)
    for w in np.unique(words_of):
        some = np.flatnonzero(words_of == w)
        part = np.frombuffer(b"".join(raw[i] for i in some.tolist()), np.uint64).reshape(len(some), w // width, width)
        out[some] = np.bitwise_or.reduce(part, axis=1)
    return out


def _prefixes(batches: Iterator[pa.RecordBatch], frequent: np.ndarray, shingle: int, percent: int) -> Iterator[pa.RecordBatch]:
    """``frequent``: hashes from the rarest to the most frequent."""
    by_value = np.argsort(frequent)
    known = frequent[by_value]
    for chunk in chunks(batches):
        count = chunk.num_rows
        rows, h = shingle_sets(chunk.column(1), shingle)
        size = np.bincount(rows, minlength=count)
        late = np.zeros(len(h), dtype=np.int64)
        if len(known) and len(h):
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            late = np.where(known[at] == h, by_value[at] + 1, 0)
        order = np.lexsort((h, late, rows))
        token = h[order]
        starts = np.cumsum(size) - size
        nth = np.arange(len(token)) - starts[rows]
        keep = nth < (size - (percent * size + 99) // 100 + 1)[rows]
        node = node_ids(rows, h, count)
        named = np.flatnonzero(chunk.column(0).is_valid().to_numpy(zero_copy_only=False))
        keep &= np.isin(rows, named[np.unique(node[named], return_index=True)[1]])  # one row with an id stands for all of a class seen here
        bits = hashed_bitmaps(rows, h, size)
        cut = np.append(0, np.cumsum(np.bincount(rows[keep], minlength=count)))
        yield pa.RecordBatch.from_arrays(
            [chunk.column(0), pa.array(size, pa.int64()), pa.array(node),
             pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(token[keep].view(np.int64))),
             pa.array([x if b > a else None for x, a, b in zip(bits, cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.binary())],
            names=["doc_id", "n_shingles", "node", "prefix", "bits"],
        )


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """The sets of the texts whose set is that of the given node. Columns: text, node, job, c, t."""
    for chunk in chunks(batches):
        rows, h = shingle_sets(chunk.column(0), shingle)
        cut = np.searchsorted(rows, np.arange(chunk.num_rows + 1))
        node = node_ids(rows, h, chunk.num_rows)
        some = np.flatnonzero(node == chunk.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays(
            [*(chunk.column(i).take(pa.array(some)) for i in range(1, 5)), pa.array(np.diff(cut)[some], pa.int64()),
             pa.array([h[cut[i] : cut[i + 1]].tobytes() for i in some.tolist()], pa.binary())],
            names=["node", "job", "c", "t", "n_shingles", "tokens"],
        )


def like_widths(raw: list[bytes], a: int, b: int) -> Iterator[np.ndarray]:
    """The places a..b in groups of one bitmap width and the next; sets further apart differ too much in size to link.

    So no bitmap is folded until it is full.
    """
    width = np.array([len(x) for x in raw[a:b]])
    for w in np.unique(width).tolist():
        part = a + np.flatnonzero((width == w) | (width == 2 * w))
        if len(part) > 1 and (width == w).any():
            yield part


class Forest:
    """Components of a job's sets, as labels."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.label[i], self.label[j]
            open_ = a != b
            if not open_.any():
                return
            i, j = i[open_], j[open_]
            low, high = min(a[open_][0], b[open_][0]), max(a[open_][0], b[open_][0])
            self.label[self.label == high] = low


class SignatureTree:
    """Bitmaps, size ranges and least numbers of set bits, level by level; the sets are sorted so that like sizes meet."""

    def __init__(self, bits: np.ndarray, size: np.ndarray, percent: int, exact: bool):
        self.percent, self.exact = percent, exact
        self.order = np.lexsort((bits[:, 0], size))
        self.bits, self.size = bits[self.order], size[self.order]
        self.ones = np.bitwise_count(self.bits).sum(axis=1).astype(np.int64)
        n, self.levels = len(size), []
        edges = np.append(np.arange(0, n, LEAF), n)
        bits, low, high, ones = self.bits, self.size, self.size, self.ones
        while True:
            at = edges[:-1]
            bits, low = np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(low, at)
            high, ones = np.maximum.reduceat(high, at), np.minimum.reduceat(ones, at)
            self.levels.append((bits, low, high, ones, edges))
            if len(at) == 1:
                break
            edges = np.append(np.arange(0, len(at), FANOUT), len(at))

    def may_link(self, a: tuple, b: tuple) -> np.ndarray:
        """For nodes (or sets) a and b given as bitmaps, least and greatest sizes, least ones: can their sets link?"""
        common = np.bitwise_count(a[0] & b[0]).sum(axis=-1).astype(np.int64)
        if self.exact:
            most = np.minimum(np.minimum(a[2], b[2]), common)
        else:  # each set bit that the other side lacks is a shingle at least that cannot be common
            most = np.minimum(a[2] - np.maximum(a[3] - common, 0), b[2] - np.maximum(b[3] - common, 0))
        return (100 + self.percent) * most >= self.percent * (a[1] + b[1])

    def links(self) -> np.ndarray:
        """The smallest index of the component of each set."""
        forest = Forest(len(self.size))
        top = len(self.levels) - 1
        pending = [(top, 0, 0)]
        while pending:
            level, i, j = pending.pop()
            bits, low, high, ones, edges = self.levels[level]
            if i != j and not self.may_link((bits[i], low[i], high[i], ones[i]), (bits[j], low[j], high[j], ones[j])):
                continue
            a, b = np.arange(edges[i], edges[i + 1]), np.arange(edges[j], edges[j + 1])
            if level:
                child = self.levels[level - 1]
                x, y = (m.ravel() for m in np.meshgrid(a, b, indexing="ij"))
                keep = (x <= y) if i == j else np.ones(len(x), bool)
                x, y = x[keep], y[keep]
                some = (x == y) | self.may_link(tuple(c[x] for c in child[:4]), tuple(c[y] for c in child[:4]))
                pending += [(level - 1, p, q) for p, q in zip(x[some].tolist(), y[some].tolist(), strict=True)]
                continue
            if len(np.unique(forest.label[np.append(a, b)])) == 1:
                continue
            side = lambda s, axis: (np.expand_dims(self.bits[s], axis), *(np.expand_dims(c[s], axis) for c in (self.size, self.size, self.ones)))
            linked = self.may_link(side(a, 1), side(b, 0)) & (forest.label[a][:, None] != forest.label[b][None, :])
            x, y = np.nonzero(linked)
            forest.join(a[x], b[y])
        smallest = np.full(len(self.size), len(self.size))
        np.minimum.at(smallest, forest.label, self.order)
        out = np.empty(len(self.size), dtype=np.int64)
        out[self.order] = smallest[forest.label]
        return out


def exact_bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """One bit per shingle that at least two of the sets hold; other shingles cannot be common."""
    token, inverse, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.full(len(token), -1)
    shared = n > 1
    place[shared] = np.arange(shared.sum())
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    col = place[inverse]
    row, col = row[col >= 0], col[col >= 0]
    width = max(1, -(-int(shared.sum()) // 64))
    out = np.zeros((len(sets), width), dtype=np.uint64)
    np.bitwise_or.at(out, (row, col // 64), np.uint64(1) << (col % 64).astype(np.uint64))
    return out


def _jobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that end where a job ends; rows come sorted by the columns job, part, other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
        if held:
            last = held[-1].slice(held[-1].num_rows - 1)
            ends = (key[0] != [last.column(i)[0].as_py() for i in range(3)]).any()
            if ends:
                yield pa.Table.from_batches(held)
                held = []
        new = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        if len(new):
            yield pa.Table.from_batches([*held, batch.slice(0, int(new[-1]))])
            held = []
            batch = batch.slice(int(new[-1]))
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _link_jobs(batches: Iterator[pa.RecordBatch], bitmaps: Callable[[list[bytes]], np.ndarray], percent: int, exact: bool) -> Iterator[pa.RecordBatch]:
    """``u, v``: a forest of the links of each job. Columns: job, part, other, node, n_shingles, and the set or its bitmap."""
    for jobs in _jobs(batches):
        key = np.column_stack([jobs.column(i).to_numpy() for i in range(3)])
        node, size = jobs.column(3).to_numpy(), jobs.column(4).to_numpy()
        raw = jobs.column(5).to_pylist()
        start = np.append(0, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1)
        end = np.append(start[1:], len(key))
        u, v = [], []
        if not exact:  # jobs of two sets, all of one width at once
            two = start[end - start == 2]
            width = np.array([min(len(raw[i]), len(raw[i + 1])) // 8 for i in two.tolist()], dtype=np.int64)
            test = SignatureTree.__new__(SignatureTree)
            test.percent, test.exact = percent, False
            ones = lambda x: np.bitwise_count(x).sum(axis=1).astype(np.int64)
            for w in np.unique(width).tolist():
                for at in np.array_split(two[width == w], max(1, int((width == w).sum()) * w // 500_000)):
                    x, y = (folded([raw[i] for i in (at + k).tolist()], w) for k in (0, 1))
                    s, t = size[at], size[at + 1]
                    some = at[test.may_link((x, s, s, ones(x)), (y, t, t, ones(y)))]
                    u.append(node[some])
                    v.append(node[some + 1])
        for a, b in zip(start.tolist(), end.tolist(), strict=True):
            if b - a < 2 or (b - a == 2 and not exact):
                continue
            for part in [np.arange(a, b)] if exact else like_widths(raw, a, b):
                label = SignatureTree(bitmaps([raw[i] for i in part.tolist()]), size[part], percent, exact).links()
                own = np.flatnonzero(label != np.arange(len(part)))
                u.append(node[part][own])
                v.append(node[part][label[own]])
        u, v = np.concatenate(u), np.concatenate(v)
        both = np.unique(np.column_stack([np.maximum(u, v), np.minimum(u, v)]), axis=0) if len(u) else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0], pa.int64()), pa.array(both[:, 1], pa.int64())], names=["u", "v"])


def _exact(raw: list[bytes]) -> np.ndarray:
    return exact_bitmaps([np.frombuffer(x, np.uint64) for x in raw])


def _dealt(rows: DataFrame, blocks: Column) -> DataFrame:
    """``job`` with its pairs of blocks: one job where ``blocks`` is 1, else one for each two blocks."""
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1), lambda i: i != mine)
    pairs = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("part"), F.lit(0).alias("other")))).otherwise(
        F.transform(others, lambda i: F.struct(F.least(i, mine).alias("part"), F.greatest(i, mine).alias("other")))
    )
    return rows.withColumn("blocks", blocks).withColumn("p", F.explode(pairs)).select("job", "p.part", "p.other", "node", *(c for c in rows.columns if c not in ("job", "node")))


def _together(rows: DataFrame, what: str) -> DataFrame:
    return rows.select("job", "part", "other", "node", "n_shingles", what).repartition("job", "part", "other").sortWithinPartitions("job", "part", "other")


def _fitting_sizes(held: DataFrame, percent: int) -> DataFrame:
    """``job, n_shingles`` of the sizes that could link with another set of their bucket.

    If the next smaller and the next larger set differ too much in size, all others do. Sizes are counted first, so that the
    window sees each size of a bucket once, however many sets have it.
    """
    size, by_size = F.col("n_shingles"), Window.partitionBy("job").orderBy("n_shingles")
    sizes = held.groupBy("job", "n_shingles").agg(F.count("*").alias("same"))
    sizes = sizes.withColumn("below", F.lag(size).over(by_size)).withColumn("above", F.lead(size).over(by_size))
    fits = (F.col("same") > 1) | (100 * F.col("below") >= percent * size) | (100 * size >= percent * F.col("above"))
    return sizes.where(fits).select("job", "n_shingles")


def linked_documents(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, most_sent: int = 500_000) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (``doc_id``, ``text``; other columns are ignored).

    Words are what stands between ASCII white space, A-Z in lower case. A text without words, or null, has no shingle and
    links with nothing. ``component_id`` is the smallest doc_id reachable by links; rows that share a doc_id are one document.
    A null doc_id has a null component and lends nothing to those of others. An empty table gives no rows. ``percent`` is over 50. Writes its
    intermediate tables to the shared folder and runs the jobs for that. The ids of documents with candidate links go to the
    tasks that read their texts again if there are at most ``most_sent`` of them; else both are shuffled.
    """
    if percent <= 50:
        raise ValueError("percent must be over 50")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    # written first: collected at once, each partition would send its own FREQUENT rows to the driver
    frequent = scratch.write(
        map_arrow(docs.select("text"), lambda it: _frequent(it, shingle), "token long, n long")
        .groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(FREQUENT)
    ).collect()
    frequent.sort(key=lambda r: (r["n"], -r["token"]))
    order = spark.sparkContext.broadcast(np.array([r["token"] for r in frequent], dtype=np.int64).view(np.uint64))
    every = scratch.write(map_arrow(
        docs, lambda it: _prefixes(it, order.value, shingle, percent),
        "doc_id long, n_shingles long, node long, prefix array<long>, bits binary",
    ))
    real = every.where("doc_id IS NOT NULL AND n_shingles > 0")
    first = real.where("bits IS NOT NULL")  # at least one row of each node, at most one per chunk of text
    nodes = first.groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.first("bits").alias("bits"))
    rows = first.select(F.explode("prefix").alias("token"), "node").repartition("token").dropDuplicates(["token", "node"])
    print_ = F.xxhash64("node")
    buckets = rows.groupBy("token").agg(
        F.count("*").alias("c"), F.bit_xor(print_).alias("x"), F.sum(print_.bitwiseAND(F.lit(0xFFFFFFFF))).alias("s"), F.min("node").alias("low"), F.max("node").alias("high")
    ).where("c > 1")
    buckets = buckets.groupBy("c", "x", "s", "low", "high").agg(F.min("token").alias("token")).select("token", "c")
    owners = first.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"))
    held = rows.join(buckets, "token").withColumnRenamed("token", "job").join(owners.select("node", "n_shingles"), "node")
    held = scratch.write(held)
    held = held.join(_fitting_sizes(held, percent), ["job", "n_shingles"]).drop("n_shingles").join(nodes, "node")
    blocks = F.when(F.col("c") <= BLOCK_NODES, 1).otherwise(F.ceil(2 * F.col("c") / BLOCK_NODES)).cast("long")
    near = map_arrow(_together(_dealt(held, blocks), "bits"), lambda it: _link_jobs(it, folded, percent, False), "u long, v long")

    groups = scratch.write(components(near, scratch).join(owners, "node"))
    sizes = groups.groupBy("root").agg(F.count("*").alias("c"), F.sum("n_shingles").alias("t"))
    wanted = groups.join(sizes, "root").select(F.col("doc_id").alias("owner"), "node", F.col("root").alias("job"), "c", "t")
    wanted = F.broadcast(wanted) if groups.count() <= most_sent else wanted
    again = docs.join(wanted, docs["doc_id"] == wanted["owner"]).select("text", "node", "job", "c", "t")
    sets = map_arrow(again, lambda it: _sets(it, shingle), "node long, job long, c long, t long, n_shingles long, tokens binary")
    blocks = F.greatest(F.ceil(F.col("c") / BLOCK_NODES), F.ceil(F.col("t") / BLOCK_TOKENS))
    blocks = F.when((F.col("c") <= BLOCK_NODES) & (F.col("t") <= 2 * BLOCK_TOKENS), 1).otherwise(F.greatest(F.lit(2), 2 * blocks)).cast("long")
    true = map_arrow(_together(_dealt(sets, blocks), "tokens"), lambda it: _link_jobs(it, _exact, percent, True), "u long, v long")

    repeated = real.groupBy("doc_id").agg(F.min("node").alias("v"), F.max("node").alias("high")).where("v < high").select("doc_id", "v")
    repeated = real.join(repeated, "doc_id").select(F.col("node").alias("u"), "v")
    roots = components(true.unionByName(repeated), scratch)
    placed = every.select("doc_id", "n_shingles", "node").join(roots, "node", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("root", "node")).alias("root"),
    )
    placed = scratch.write(placed)
    least = placed.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return placed.join(least, "root", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_documents(table(spark, sf_dir, "documents"))
