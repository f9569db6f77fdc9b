"""Nearest neighbours by cosine: rows dealt to balls, a vantage-point tree per shard of a ball, balls pruned for each query.

A bounded sample of rows gives pivots; every row belongs to the ball of its nearest pivot. Balls of over ``SHARD_ROWS`` rows are
cut into shards by a hash of the id, so that neither a hot ball nor a vector that occurs often makes a shard large; equal vectors
of a shard are kept once, with as many of their smallest ids as an answer can need. A query first searches one shard of its own
ball. The distance of its k-th nearest there tells which other balls the triangle inequality can't rule out, and it is sent to
the shards of these alone. So rows travel three times whatever the number of queries (once to make ids single, once for
either search; a shard with many visitors is repeated per ``BLOCK_ROWS`` of them), and queries once per shard that may help them.

Within a shard the tree over the unit vectors is walked with the whole block of queries. A subtree, as a ball, is skipped where
``factor * bound > radius``: bound is the least distance that the triangle inequality allows, radius the distance of the k-th
nearest found. Factor one is exact; above one it skips more. A second walk takes everything as far as the last one found, so
that ties of any number go by exact score and id. Only the k best of each shard leave a job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, ship, table

SHARD_ROWS = 16_384
BLOCK_ROWS = 4096
LEAF = 128
#: The most pivots; all tasks hold them and the figures of their balls.
PIVOTS = 4096
#: What a distance of unit vectors, taken from one large product, may be off by.
SLACK = 2e-7
SCHEMA = "query_id long, vec_id long, score double"


class VantageTree:
    """Nodes in arrays. Unit vectors are reordered so that every node owns a stretch of rows, its vantage point among them."""

    def __init__(self, unit: np.ndarray, leaf: int = LEAF):
        self.points, self.order = unit, np.arange(len(unit))
        self.nodes: list[tuple] = []  # start, end, inner, outer, vantage point, (lo, hi) of the distances of both children
        pending = [(0, len(unit), -1, 0)]
        while pending:
            start, end, parent, side = pending.pop()
            me = len(self.nodes)
            if parent >= 0:
                self.nodes[parent][2 + side] = me
            if end - start <= leaf:
                self.nodes.append([start, end, -1, -1, -1, None])
                continue
            mine = self.order[start:end]
            vantage = mine[(me * 2654435761) % len(mine)]
            d = np.sqrt(np.maximum(2 - 2 * (unit[mine] @ unit[vantage]), 0))
            half = len(d) // 2
            by = np.argpartition(d, half)
            mine[:], d = mine[by], d[by]
            self.nodes.append([start, end, -1, -1, vantage, (d[:half].min(), d[:half].max(), d[half:].min(), d[half:].max())])
            pending += [(start + half, end, me, 1), (start, start + half, me, 0)]
        self.unit = unit[self.order]

    def _from(self, queries: np.ndarray, vantage: int) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * (queries @ self.points[vantage]), 0))

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0, most: np.ndarray | float = np.inf) -> np.ndarray:
        """For each query the places (in the given rows, -1 where there are fewer) of its k nearest, by distance.

        What is farther than ``most`` may be left out. Each query first goes down to one leaf, which gives it a radius; then all
        nodes are visited once, each with the queries that it can't be ruled out for.
        """
        n = len(queries)
        most = np.broadcast_to(np.asarray(most, dtype=float) + SLACK, n)
        best = np.full((n, k), np.inf)
        found = np.full((n, k), -1)
        home = np.full(n, -1)

        def take(active: np.ndarray, start: int, end: int) -> None:
            d = np.sqrt(np.maximum(2 - 2 * (queries[active] @ self.unit[start:end].T), 0))
            both = np.hstack([best[active], d])
            where = np.hstack([found[active], np.broadcast_to(np.arange(start, end), d.shape)])
            at = np.argpartition(both, k - 1, axis=1)[:, :k]
            best[active], found[active] = np.take_along_axis(both, at, 1), np.take_along_axis(where, at, 1)

        down = [(0, np.arange(n))]
        while down:
            node, active = down.pop()
            start, end, inner, outer, vantage, rim = self.nodes[node]
            if inner < 0:
                home[active] = node
                take(active, start, end)
                continue
            near = self._from(queries[active], vantage) <= (rim[1] + rim[2]) / 2
            down += [(child, some) for child, some in ((outer, active[~near]), (inner, active[near])) if len(some)]
        pending = [(0, np.arange(n), np.zeros(n))]
        while pending:
            node, active, bound = pending.pop()
            keep = factor * (bound - SLACK) <= np.minimum(best[active].max(axis=1), most[active])
            active, bound = active[keep], bound[keep]
            start, end, inner, outer, vantage, rim = self.nodes[node]
            if inner < 0:
                active = active[home[active] != node]
                if len(active):
                    take(active, start, end)
            elif len(active):
                d = self._from(queries[active], vantage)
                for child, lo, hi in ((outer, rim[2], rim[3]), (inner, rim[0], rim[1])):
                    pending.append((child, active, np.maximum(bound, np.maximum(lo - d, d - hi))))
        return np.where(found >= 0, self.order[found], -1)

    def within(self, queries: np.ndarray, radius: np.ndarray, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query and a place (in the given rows) that are no farther apart than the query's radius, rounding allowed for."""
        who, where = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        pending = [(0, np.arange(len(queries)), np.zeros(len(queries)))]
        while pending:
            node, active, bound = pending.pop()
            keep = factor * (bound - SLACK) <= radius[active] + SLACK
            active, bound = active[keep], bound[keep]
            if not len(active):
                continue
            start, end, inner, outer, vantage, rim = self.nodes[node]
            if inner < 0:
                d = np.sqrt(np.maximum(2 - 2 * (queries[active] @ self.unit[start:end].T), 0))
                i, j = np.nonzero(d <= radius[active][:, None] + SLACK)
                who.append(active[i])
                where.append(start + j)
                continue
            d = self._from(queries[active], vantage)
            for child, lo, hi in ((inner, rim[0], rim[1]), (outer, rim[2], rim[3])):
                pending.append((child, active, np.maximum(bound, np.maximum(lo - d, d - hi))))
        return np.concatenate(who), self.order[np.concatenate(where)]


def _vectors(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of a list column without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    off = np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), off


def _by_size(t: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Dimension, ids and vectors (rows with one id: the first of them), for each dimension that occurs."""
    ids = t.column("vec_id").to_numpy()
    flat, off = _vectors(t.column("embedding"))
    size = np.diff(off)
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        v = flat[(off[rows][:, None] + np.arange(dim))]
        order = np.lexsort((*v.T[::-1], ids[rows]))
        rows, v = rows[order], v[order]
        first = np.append(True, ids[rows][1:] != ids[rows][:-1])
        yield int(dim), ids[rows][first], v[first]


def scaled(v: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component near one. Cosines keep every bit, squares their range."""
    _, exponent = np.frexp(np.abs(v).max(axis=1, initial=0))
    return np.ldexp(v, -exponent[:, None])


def search_shard(data: pa.Table, asked: pa.Table, k: int, factor: float) -> pa.Table:
    """The k nearest of each query within one shard; those farther than its ``radius`` may be left out."""
    limit_ids, first = np.unique(asked.column("vec_id").to_numpy(), return_index=True)
    limit = asked.column("radius").to_numpy()[first]
    known = {dim: (ids, scaled(v)) for dim, ids, v in _by_size(data)} if data.num_rows else {}
    out: list[list[np.ndarray]] = [[], [], []]
    for dim, query_ids, q in _by_size(asked) if asked.num_rows else ():
        if dim not in known:
            continue
        ids, v = known[dim]
        q = scaled(q)
        same, back = np.unique(v, axis=0, return_inverse=True)
        order = np.lexsort((ids, back.ravel()))
        starts = np.searchsorted(back.ravel()[order], np.arange(len(same) + 1))
        nth = np.arange(len(order)) - starts[back.ravel()[order]]
        members = np.full((len(same), k + 1), -1, dtype=np.int64)  # the smallest ids; one of them may be the query
        few = nth <= k
        members[back.ravel()[order][few], nth[few]] = ids[order][few]
        norm = np.sqrt((same * same).sum(axis=1))
        q_norm = np.sqrt((q * q).sum(axis=1))
        unit, q_unit = same / norm[:, None], q / q_norm[:, None]
        tree = VantageTree(unit)
        most = limit[np.searchsorted(limit_ids, query_ids)]
        units = tree.search(q_unit, min(k + 1, len(same)), factor, most)
        # the units as far as the last of these and no farther: ties among them are for the ids to settle, however many they are
        apart = np.where(units >= 0, 2 - 2 * np.einsum("qd,qkd->qk", q_unit, unit[units]), 0)
        radius = np.where((units >= 0).all(axis=1), np.sqrt(np.maximum(apart.max(axis=1, initial=0), 0)), np.inf)
        radius = np.minimum(radius, most)
        if units.shape[1] < len(same):
            who, found = tree.within(q_unit, radius, factor)
        else:
            who, found = np.repeat(np.arange(len(q)), len(same)), np.tile(np.arange(len(same)), len(q))
        by_query = np.argsort(who, kind="stable")
        cut = np.searchsorted(who[by_query], np.arange(len(q) + 1))
        some = np.arange(k + 1) < np.minimum(np.diff(starts), k + 1)[:, None]
        for i in range(len(q)):
            u = found[by_query[cut[i] : cut[i + 1]]]
            score = (same[u] * q[i]).sum(axis=1) / (norm[u] * q_norm[i])
            own = some[u] & (members[u] != query_ids[i])
            s, m = np.broadcast_to(score[:, None], own.shape)[own], members[u][own]
            top = np.lexsort((m, -s))[:k]
            for column, x in zip(out, (np.full(len(top), query_ids[i]), m[top], np.clip(s[top], -1, 1)), strict=True):
                column.append(x)
    a, b, c = (np.concatenate(x) if x else [] for x in out)
    return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of the rows whose vector can be compared."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))


class Balls:
    """Pivots as unit vectors by dimension, numbered through, and what is known of their balls.

    Ball -1 holds the rows of dimensions without a pivot; it is never ruled out. ``shards`` and ``blocks`` tell into how many parts
    the rows and the visitors of a ball are cut.
    """

    def __init__(self, pivots: list[list[float]]):
        self.by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        number = 0
        for dim in sorted({len(p) for p in pivots}):
            v = np.unique(_unit(np.array([p for p in pivots if len(p) == dim], dtype=np.float64)), axis=0)
            self.by_dim[dim] = (v, np.arange(number, number + len(v)))
            number += len(v)
        self.count = number
        self.near, self.far = np.full(number + 1, np.inf), np.full(number + 1, -np.inf)  # the last one is ball -1
        self.shards, self.blocks = np.zeros(number + 1, np.int64), np.ones(number + 1, np.int64)

    def distances(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of rows of one dimension from its pivots, and the balls' numbers."""
        pivots, numbers = self.by_dim[v.shape[1]]
        return np.sqrt(np.maximum(2 - 2 * (_unit(v) @ pivots.T), 0)), numbers

    def visits(self, v: np.ndarray, radius: np.ndarray, factor: float) -> Iterator[tuple[int, np.ndarray]]:
        """Balls that may hold something within the radius of rows of one dimension, with these rows."""
        if v.shape[1] in self.by_dim:
            d, numbers = self.distances(v)
            own = d.min(axis=1, keepdims=True)
            # inside of the ball's rim, outside of its core, or beyond the border that it shares with the own ball
            bound = np.maximum(np.maximum(d - self.far[numbers], self.near[numbers] - d), (d - own) / 2)
            may = (factor * (bound - 3 * SLACK) <= radius[:, None] + SLACK) & (self.shards[numbers] > 0)
            for j in np.flatnonzero(may.any(axis=0)):
                yield int(numbers[j]), np.flatnonzero(may[:, j])
        elif self.shards[-1]:
            yield -1, np.arange(len(v))


def _unit(v: np.ndarray) -> np.ndarray:
    v = scaled(v)
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def _spread(ids: np.ndarray, parts: int) -> np.ndarray:
    """A part for each id, by a multiplicative hash."""
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts


def _matrices(batch: pa.RecordBatch, *more: str) -> Iterator[tuple]:
    """For each dimension in a batch: ids, list column and matrix of its rows, and further columns."""
    lists = batch.column("embedding")
    flat, off = _vectors(lists)
    size = np.diff(off)
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        take = pa.array(rows)
        yield batch.column("vec_id").take(take), lists.take(take), flat[off[rows][:, None] + np.arange(dim)], *(batch.column(m).take(take) for m in more)


def in_balls(vectors: DataFrame, balls: Balls) -> DataFrame:
    """``vec_id, embedding, ball, distance``: each row with its nearest pivot."""

    def run(batches):
        for batch in batches:
            for ids, lists, v in _matrices(batch):
                ball, distance = np.full(len(v), -1), np.zeros(len(v))
                if v.shape[1] in balls.by_dim:
                    d, numbers = balls.distances(v)
                    at = d.argmin(axis=1)
                    ball, distance = numbers[at], d[np.arange(len(v)), at]
                yield pa.record_batch([ids, lists, pa.array(ball, pa.int32()), pa.array(distance)], ["vec_id", "embedding", "ball", "distance"])

    return map_arrow(vectors, run, "vec_id long, embedding array<double>, ball int, distance double")


def visitors(asked: DataFrame, balls: Balls, factor: float) -> DataFrame:
    """``vec_id, embedding, radius, ball, shard, block``: each query once per shard, its first one left out, that may hold nearer rows.

    ``asked`` has ``vec_id, embedding, radius, ball, shard``: what was found in the first shard.
    """

    def run(batches):
        names = ["vec_id", "embedding", "radius", "ball", "shard", "block"]
        for batch in batches:
            for ids, lists, v, radius, ball, shard in _matrices(batch, "radius", "ball", "shard"):
                first = list(zip(ball.to_pylist(), shard.to_pylist(), strict=True))
                for target, rows in balls.visits(v, radius.to_numpy(), factor):
                    block = _spread(ids.to_numpy()[rows], balls.blocks[target])
                    for part in range(balls.shards[target]):
                        some = np.array([first[r] != (target, part) for r in rows])
                        take = pa.array(rows[some])
                        if len(take):
                            same = [pa.array(np.full(len(take), x), pa.int32()) for x in (target, part)]
                            yield pa.record_batch([ids.take(take), lists.take(take), radius.take(take), *same, pa.array(block[some], pa.int32())], names)

    return map_arrow(asked, run, "vec_id long, embedding array<double>, radius double, ball int, shard int, block int")


def visitor_counts(asked: DataFrame, balls: Balls, factor: float) -> DataFrame:
    """``ball, n``: how many queries may find something in a ball."""

    def run(batches):
        for batch in batches:
            for _, _, v, radius in _matrices(batch, "radius"):
                found = [(ball, len(rows)) for ball, rows in balls.visits(v, radius.to_numpy(), factor)]
                yield pa.record_batch([pa.array([x[i] for x in found], pa.int32()) for i in (0, 1)], ["ball", "n"])

    return map_arrow(asked, run, "ball int, n int").groupBy("ball").agg(F.sum("n").alias("n"))


def _single(vectors: DataFrame) -> DataFrame:
    """One row per id and length of vector: the smallest vector."""
    return usable(vectors).groupBy("vec_id", F.size("embedding").alias("dim")).agg(F.min("embedding").alias("embedding")).drop("dim")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, factor: float = 1.0, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query its k nearest rows by cosine, ties to the smaller ``vec_id``.

    Both tables have ``vec_id, embedding``; other columns are ignored. Rows with a null id, or a vector that is null, empty,
    zero or has a null or non-finite component take no part; vectors are compared with those of the same length. A row never
    answers for its own id; rows that repeat an id count once (the smallest vector). Fewer candidates than k give fewer rows,
    an empty table none. Runs the first search and some counts, whose results are written in the shared folder; the driver gets
    at most ``PIVOTS`` vectors and as many counts.
    """
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    data, asked = scratch.write(_single(vectors)), _single(queries)
    wanted = min(PIVOTS, max(1, -(-data.count() // shard_rows)))
    pivots = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted)
    balls = Balls([list(r["embedding"]) for r in pivots.collect()])
    data, asked = scratch.write(in_balls(data, balls)), scratch.write(in_balls(asked, balls))
    counts = data.groupBy("ball").agg(F.count(F.lit(1)).alias("rows"), F.min("distance").alias("near"), F.max("distance").alias("far"))
    asked_counts = {r["ball"]: r["n"] for r in asked.groupBy("ball").agg(F.count(F.lit(1)).alias("n")).collect()}
    for r in counts.collect():
        b = r["ball"]
        balls.near[b], balls.far[b] = r["near"], r["far"]
        balls.shards[b] = max(-(-r["rows"] // shard_rows), -(-asked_counts.get(b, 0) // block_rows))

    def figures() -> DataFrame:
        rows = [(b, int(balls.shards[b]), int(balls.blocks[b])) for b in range(-1, balls.count) if balls.shards[b]]
        return F.broadcast(spark.createDataFrame(rows, "ball int, shards int, blocks int"))

    def in_shards(df: DataFrame) -> DataFrame:
        return df.join(figures(), "ball").withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"))

    def search(rows: DataFrame, by: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy(*keys).cogroup(by.groupBy(*keys)).applyInArrow(lambda left, right: search_shard(left, right, k, factor), SCHEMA)

    data = in_shards(data).select("vec_id", "embedding", "ball", "shard")
    unlimited = F.lit(float("inf")).alias("radius")
    home = in_shards(asked).select("vec_id", "embedding", "ball", "shard", unlimited)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    first = scratch.write(best(search(data, home, "ball", "shard")))
    kth = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0))).alias("kth"))
    # a query whose own ball holds no row has no first shard: it visits all balls that exist
    none = [F.col("vec_id"), F.col("embedding"), F.col("ball"), F.lit(-1).alias("shard")]
    every = home.drop("radius").unionByName(asked.join(figures(), "ball", "left_anti").select(*none))
    every = scratch.write(every.join(kth, "vec_id", "left").select("vec_id", "embedding", "ball", "shard", F.coalesce("kth", unlimited).alias("radius")))
    for r in visitor_counts(every, balls, factor).collect():
        balls.blocks[r["ball"]] = max(1, -(-r["n"] // block_rows))
    repeated = data.join(figures(), "ball").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    later = search(repeated.select("vec_id", "embedding", "ball", "shard", "block"), visitors(every, balls, factor), "ball", "shard", "block")
    return best(first.drop("rank").unionByName(later)).select("query_id", "rank", "vec_id", "score")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))
