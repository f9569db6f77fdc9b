"""Product codes of vectors: k-means per part over metric trees of an anchors hierarchy.

Vectors of whole numbers are cut into parts. Rows are dealt to chunks; a chunk builds one metric tree per part position,
middle out: about sqrt(n) anchors are set, each the point farthest from its anchor so far, and take over the points that are
nearer to them (points nearer to their anchor than half the distance of the anchors are not looked at); anchors are merged,
those with the smallest common ball first, into the upper tree, and each anchor's points are treated likewise. Every ball keeps
its centre, radius, count and sum. The trees are written once, as Parquet, and read in each round.

A round walks all balls of a level at once. A ball inherits its parent's list of candidate entries and strikes out each entry
that another one beats for the whole ball (the ball lies on one side of the plane between them). A ball with one entry left is
owned: its cached sum and count go to the entry without a look at its points. Leaves that stay undecided compare their points
with the entries left. All sums and distances are whole numbers; floats only strike out, with a margin for their rounding.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, table
from .vectors import by_length, complete, exact, largest, whole

PARTS, ENTRIES, ROUNDS = 16, 64, 2
CHUNK_ROWS = 4096
LEAF = 64
#: Relative margin for rounding when an entry is struck out.
MARGIN = 1e-9
#: As many labels, those with the most rows, are joined by broadcast; the others by a shuffle.
HOT_LABELS = 10_000

Codebooks = dict[int, np.ndarray]  # length of vector -> part x entry x position, Python integers


class Tree(NamedTuple):
    """Balls as arrays, parents before children; ``order`` lists the points so that a ball owns ``start:end``."""

    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    left: np.ndarray  # -1: a leaf
    right: np.ndarray
    radius: np.ndarray
    total: np.ndarray

    @property
    def centre(self) -> np.ndarray:
        return self.total.astype(np.float64) / np.maximum(self.end - self.start, 1)[:, None]

    def packed(self) -> bytes:
        """The arrays in the narrowest types that hold them."""
        return pickle.dumps(tuple(_narrow(a) for a in self), protocol=5)

    @staticmethod
    def unpacked(data: bytes) -> Tree:
        return Tree(*(a.astype(np.int64) if a.dtype.kind in "iu" else a for a in pickle.loads(data)))


def _narrow(a: np.ndarray) -> np.ndarray:
    if a.dtype.kind != "i" or not a.size:
        return a
    return next(a.astype(t) for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= a.min() and a.max() <= np.iinfo(t).max)


def _anchors(x: np.ndarray) -> list[np.ndarray]:
    """The points dealt to about sqrt(n) anchors; fewer if the points repeat."""
    owner = np.zeros(len(x), dtype=np.int64)
    places = [0]
    far = np.sqrt(((x - x[0]) ** 2).sum(axis=1))
    while len(places) < int(np.sqrt(len(x))):
        new = int(far.argmax())  # the farthest point of the anchor with the largest radius
        if far[new] == 0:
            break
        apart = np.sqrt(((x[places] - x[new]) ** 2).sum(axis=1))
        near = np.flatnonzero(far > apart[owner] / 2)
        d = np.sqrt(((x[near] - x[new]) ** 2).sum(axis=1))
        stolen = near[d < far[near]]
        far[stolen], owner[stolen] = d[d < far[near]], len(places)
        places.append(new)
    groups = np.argsort(owner, kind="stable")
    return [g for g in np.split(groups, np.cumsum(np.bincount(owner, minlength=len(places)))[:-1]) if len(g)]


def _merge(x: np.ndarray, groups: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs to merge, smallest common ball first; ball number len(groups) + i is made by the i-th pair."""
    size = np.array([len(g) for g in groups] + [0] * (len(groups) - 1), dtype=np.float64)
    centre = np.zeros((len(size), x.shape[1]))
    radius = np.zeros(len(size))
    for i, g in enumerate(groups):
        centre[i] = x[g].mean(axis=0)
        radius[i] = np.sqrt(((x[g] - centre[i]) ** 2).sum(axis=1).max())
    cost = np.full((len(size), len(size)), np.inf)

    def measure(i: int, others: np.ndarray) -> None:
        d = np.sqrt(((centre[others] - centre[i]) ** 2).sum(axis=1))
        cost[i, others] = cost[others, i] = np.maximum((d + radius[others] + radius[i]) / 2, np.maximum(radius[others], radius[i]))
        cost[i, i] = np.inf

    alive = np.arange(len(groups))
    for i in alive:
        measure(i, alive)
    out = []
    for new in range(len(groups), len(size)):
        a, b = divmod(int(cost[:new, :new].argmin()), new)
        out.append((a, b))
        size[new] = size[a] + size[b]
        centre[new] = (centre[a] * size[a] + centre[b] * size[b]) / size[new]
        radius[new] = cost[a, b]
        cost[[a, b], :] = cost[:, [a, b]] = np.inf
        alive = np.append(alive[(alive != a) & (alive != b)], new)
        measure(new, alive)
    return out


def build_tree(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The anchors hierarchy over rows of whole numbers."""
    x = points.astype(np.float64)
    nodes: list[list[int]] = []  # start, end, left, right
    order: list[np.ndarray] = []
    done = 0

    def add(parent: int, side: int) -> int:
        nodes.append([0, 0, -1, -1])
        if parent >= 0:
            nodes[parent][2 + side] = len(nodes) - 1
        return len(nodes) - 1

    # depth first, left before right, so that every ball owns a stretch; None closes the ball
    pending: list[tuple] = [("points", np.arange(len(x)), -1, 0)]
    while pending:
        kind, what, parent, side = pending.pop()
        if kind == "close":
            nodes[what][1] = done
            continue
        me = add(parent, side)
        nodes[me][0] = done
        if kind == "points":
            groups = _anchors(x[what]) if len(what) > leaf else []
            if len(groups) < 2:
                order.append(what)
                done += len(what)
                nodes[me][1] = done
                continue
            pairs = _merge(x[what], groups)
            what = ([what[g] for g in groups], pairs, len(groups) + len(pairs) - 1)
        groups, pairs, ball = what
        pending.append(("close", me, -1, 0))
        for s in (1, 0):
            child = pairs[ball - len(groups)][s]
            if child < len(groups):
                pending.append(("points", groups[child], me, s))
            else:
                pending.append(("merged", (groups, pairs, child), me, s))
    balls = np.array(nodes, dtype=np.int64).reshape(-1, 4)
    at = np.concatenate(order) if order else np.zeros(0, np.int64)
    start, end = balls[:, 0], balls[:, 1]
    rows = exact(points[at], max(1, len(at)) * largest(points))
    prefix = np.concatenate([np.zeros((1, points.shape[1]), dtype=rows.dtype), np.cumsum(rows, axis=0)])
    total = prefix[end] - prefix[start]
    tree = Tree(at, start, end, balls[:, 2], balls[:, 3], np.zeros(len(balls)), total)
    centre, radius = tree.centre, tree.radius
    sorted_x = x[at]
    for i, (a, b) in enumerate(zip(start, end, strict=True)):
        if b > a:
            radius[i] = np.sqrt(((sorted_x[a:b] - centre[i]) ** 2).sum(axis=1).max())
    return tree


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of every point to every entry."""
    bound = 4 * max(largest(points), largest(entries)) ** 2 * max(1, points.shape[1])
    a, b = exact(points, bound), entries.astype(object if bound >= 1 << 63 else np.int64)
    out = np.zeros((len(a), len(b)), dtype=a.dtype)
    for k in range(points.shape[1]):
        out += (a[:, k, None] - b[None, :, k]) ** 2
    return out


def assign(tree: Tree, points: np.ndarray, entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Balls owned by one entry and points of the leaves left over: ``(balls, their entries, 0)``, ``(points, their entries, 1)``.

    Together they cover every point once, with its nearest entry, ties to the lower index.
    """
    e = entries.astype(np.float64)
    _, first = np.unique(entries.astype(str), axis=0, return_index=True) if entries.shape[1] else (None, np.zeros(1, np.int64))
    allowed = np.zeros(len(entries), dtype=bool)
    allowed[first] = True  # of equal entries only the first can be nearest
    gap = np.sqrt(((e[:, None] - e[None]) ** 2).sum(axis=2))
    centre = tree.centre
    balls, lists = np.zeros(1, np.int64), allowed[None]
    while len(balls):
        far = ((centre[balls][:, None] - e[None]) ** 2).sum(axis=2)
        best = np.where(lists, far, np.inf).argmin(axis=1)
        least = far[np.arange(len(balls)), best][:, None]
        apart = gap[best]
        clear = (far - least) * (1 - MARGIN) - MARGIN * (far + least) > 2 * apart * tree.radius[balls][:, None] * (1 + MARGIN)
        lists = lists & (~clear | (apart == 0))
        lists[np.arange(len(balls)), best] = True
        owned = lists.sum(axis=1) == 1
        yield balls[owned], best[owned], 0
        leaf = ~owned & (tree.left[balls] < 0)
        if leaf.any():
            size = (tree.end - tree.start)[balls[leaf]]
            rank = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            rows = tree.order[np.repeat(tree.start[balls[leaf]], size) + rank]
            d = distances(points[rows], entries)
            worst = 1 << 200 if d.dtype == object else np.iinfo(np.int64).max
            yield rows, np.where(np.repeat(lists[leaf], size, axis=0), d, worst).argmin(axis=1), 1
        inner = ~owned & ~leaf
        balls, lists = np.concatenate([tree.left[balls[inner]], tree.right[balls[inner]]]), np.concatenate([lists[inner]] * 2)


def entry_sums(tree: Tree, points: np.ndarray, entries: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Per entry that owns a point: how many, and their sums."""
    count, total = np.zeros(len(entries), np.int64), np.zeros(entries.shape, dtype=object)
    for what, owner, single in assign(tree, points, entries):
        np.add.at(count, owner, 1 if single else (tree.end - tree.start)[what])
        np.add.at(total, owner, (points[what] if single else tree.total[what]).astype(object))
    return {int(i): (int(count[i]), [int(v) for v in total[i]]) for i in np.flatnonzero(count)}


def nearest_entries(tree: Tree, points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The entry of every point."""
    out = np.zeros(len(points), np.int64)
    for what, owner, single in assign(tree, points, entries):
        if single:
            out[what] = owner
        else:
            size = (tree.end - tree.start)[what]
            rank = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            out[tree.order[np.repeat(tree.start[what], size) + rank]] = np.repeat(owner, size)
    return out


def _parts(x: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(x, parts, axis=1)


def _planted(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows to chunks of one length, each with its ids, labels, vectors and trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, CHUNK_ROWS):
                some = batch.slice(begin, CHUNK_ROWS)
                for length, rows, x in by_length(some.column(2)):
                    at = pa.array(rows)
                    trees = [build_tree(p).packed() for p in _parts(x, parts)] if length % parts == 0 else None
                    yield pa.RecordBatch.from_arrays([
                        pa.array([length], pa.int32()), pa.array([some.column(0).take(at).to_pylist()], pa.list_(pa.int64())),
                        pa.array([some.column(1).take(at).to_pylist()], pa.list_(some.schema.field(1).type)),
                        pa.array([x.tobytes()], pa.binary()), pa.array([trees], pa.list_(pa.binary())),
                    ], names=["length", "ids", "labels", "x", "trees"])

    return run


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, list[Tree] | None, dict]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(k)[i] for k, n in enumerate(batch.schema.names)}
            length = row["length"].as_py()
            x = np.frombuffer(row["x"].as_buffer(), np.int64)
            x = x.reshape(-1, length) if length else np.zeros((len(row["ids"].values), 0), np.int64)
            trees = [Tree.unpacked(t.as_buffer()) for t in row["trees"].values] if row["trees"].is_valid else None
            yield length, x, trees, row


def _summed(codebooks: Codebooks, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], tuple[int, list[int]]] = {}
        for length, x, trees, _ in _chunks(batches):
            if trees is None or length not in codebooks:
                continue
            for p, (tree, points) in enumerate(zip(trees, _parts(x, parts), strict=True)):
                for entry, (n, total) in entry_sums(tree, points, codebooks[length][p]).items():
                    m, old = sums.get((length, p, entry), (0, [0] * len(total)))
                    sums[length, p, entry] = (m + n, [a + b for a, b in zip(old, total, strict=True)])
        if sums:
            rows = [(*k, i, n, v & ((1 << 40) - 1), v >> 40) for k, (n, total) in sums.items() for i, v in enumerate(total)]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["length", "part", "entry", "position", "n", "low", "high"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def next_codebooks(planted: DataFrame, codebooks: Codebooks, parts: int = PARTS) -> Codebooks:
    """One round: every part to its nearest entry, every entry to the floor of the mean of its parts; unused entries stay."""
    moved = map_arrow(
        planted, _summed(codebooks, parts), "length int, part int, entry int, position int, n long, low long, high long"
    ).groupBy("length", "part", "entry", "position").agg(F.sum("n").alias("n"), F.sum("low").alias("low"), F.sum("high").alias("high"))
    out = {length: c.copy() for length, c in codebooks.items()}
    for r in moved.collect():  # at most as many rows as the codebooks have numbers
        out[r.length][r.part, r.entry, r.position] = (r.low + (r.high << 40)) // r.n
    return out


def first_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks:
    """The parts of the vectors with the smallest ids, ascending, for each length that can be cut."""
    order = Window.partitionBy("length").orderBy("vec_id", "x")
    first = (
        rows.where(F.col("vec_id").isNotNull() & (F.size("x") % parts == 0)).withColumn("length", F.size("x"))
        .withColumn("place", F.row_number().over(order)).where(F.col("place") <= entries)
    )
    found: dict[int, list] = {}
    for r in first.collect():  # at most ``entries`` rows for each length
        found.setdefault(r.length, []).append((r.place, r.x))
    out = {}
    for length, some in found.items():
        x = np.array([v for _, v in sorted(some, key=lambda s: s[0])], dtype=object).reshape(len(some), length)
        out[length] = np.stack(_parts(x, parts)).astype(object)
    return out


def digest(codebooks: Codebooks) -> str:
    """SHA-256 of all entries' numbers by length, part, entry and position, joined by commas."""
    numbers = (str(v) for length in sorted(codebooks) for v in codebooks[length].ravel())
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def _coded(codebooks: Codebooks, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for length, x, trees, row in _chunks(batches):
            ids, labels = row["ids"].values, row["labels"].values
            codes: list[str | None] = [None] * len(ids)
            errors: list[int | None] = [None] * len(ids)
            if trees is not None and length in codebooks:
                books = codebooks[length]
                split = _parts(x, parts)
                best = np.stack([nearest_entries(t, p, books[k]) for k, (t, p) in enumerate(zip(trees, split, strict=True))], axis=1)
                chosen = np.concatenate([books[k][best[:, k]] for k in range(parts)], axis=1)
                bound = 4 * max(largest(x), largest(chosen)) ** 2 * max(1, length)
                error = ((exact(x, bound) - chosen.astype(object if bound >= 1 << 63 else np.int64)) ** 2).sum(axis=1)
                errors = [e if e < 1 << 63 else None for e in map(int, error)]
                digits = best.astype(np.uint8).tobytes().hex()
                codes = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
            yield pa.RecordBatch.from_arrays(
                [ids, labels, pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"]
            )

    return run


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """``vec_id, label, code, error`` of every usable row, and the codebooks.

    ``vectors`` has ``vec_id, embedding, label``; other columns are ignored. Components c become whole numbers floor(256 * c).
    Vectors that are null or have a null or non-finite component are left out. A codebook starts as the parts of the rows with
    the smallest ids (rows that share an id: the smaller vector first; fewer rows give fewer entries); each round assigns all
    parts and moves every used entry to the floor of the mean. Repeated rows count each. Rows with a null id are coded and
    counted but never start a codebook. Vectors are coded with those of their length; where that length cannot be cut into
    ``parts`` equal parts, or all its ids are null, ``code`` and ``error`` are null. ``error`` is null where it exceeds the range
    of long. An empty table gives no rows. ``entries`` is at most 256. Runs a job per round; the trees lie in the shared folder.
    """
    spark = vectors.sparkSession
    rows = vectors.where(complete()).select(F.col("vec_id").cast("long").alias("vec_id"), "label", whole().alias("x"))
    label = rows.schema["label"].dataType.simpleString()
    planted = Scratch(spark).write(
        map_arrow(rows, _planted(parts), f"length int, ids array<long>, labels array<{label}>, x binary, trees array<binary>")
    )
    codebooks = first_codebooks(rows, parts, entries)
    for _ in range(rounds):
        codebooks = next_codebooks(planted, codebooks, parts)
    return map_arrow(planted, _coded(codebooks, parts), f"vec_id long, label {label}, code string, error long"), codebooks


def with_label_errors(coded: DataFrame, hot: int = HOT_LABELS) -> DataFrame:
    """Adds ``label_error``, the sum of ``error`` over equal labels (nulls together; null errors left out).

    The ``hot`` labels with the most rows are joined by broadcast, so that no label fills a task; the rest by a shuffle.
    """
    spark = coded.sparkSession
    coded = Scratch(spark).write(coded)
    sums = Scratch(spark).write(coded.groupBy("label").agg(F.sum("error").alias("sum"), F.count(F.lit(1)).alias("n")))
    top = sums.orderBy(F.desc("n"), "label").limit(hot).select(F.col("label").alias("hot_label"), F.col("sum").alias("hot_sum"), F.lit(True).alias("hot"))
    joined = coded.join(F.broadcast(top), F.col("label").eqNullSafe(F.col("hot_label")), "left")
    fixed = joined.where("hot").select(*coded.columns, F.col("hot_sum").alias("label_error"))
    if sums.count() <= hot:
        return fixed
    rest = joined.where("hot IS NULL").select(*coded.columns)
    sums = sums.select(F.col("label").alias("other_label"), F.col("sum").alias("label_error"))
    return fixed.unionByName(rest.join(sums, F.col("label").eqNullSafe(F.col("other_label"))).select(*coded.columns, "label_error"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks = encode(table(spark, sf_dir, "embeddings"))
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


def _sql_round(n: int) -> str:
    return f"""
 near{n} AS MATERIALIZED (
  SELECT p.row_no, p.part, arg_min(b.entry, d * 64 + b.entry) AS entry, min(d) AS d
  FROM parts p JOIN book{n} b USING (part), LATERAL (
   SELECT CAST(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d) s
  GROUP BY p.row_no, p.part),"""


def _sql_book(n: int) -> str:
    return f"""
 book{n + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, CASE WHEN m.x IS NULL THEN b.x ELSE m.x END AS x
  FROM book{n} b LEFT JOIN (
   SELECT part, entry, list(v ORDER BY k) AS x FROM (
    SELECT p.part, near.entry, k, CAST((sum(p.x[k]) - ((sum(p.x[k]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS v
    FROM parts p JOIN near{n} near USING (row_no, part), LATERAL (SELECT unnest(generate_series(1, len(p.x))) AS k) g
    GROUP BY p.part, near.entry, k) GROUP BY part, entry) m USING (part, entry)),"""


OP12_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS row_no, vec_id, label,
   list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
 parts AS MATERIALIZED (
  SELECT row_no, part, x[part * (len(x) // {PARTS}) + 1 : (part + 1) * (len(x) // {PARTS})] AS x
  FROM kept, LATERAL (SELECT unnest(generate_series(0, {PARTS - 1})) AS part) g),
 book0 AS MATERIALIZED (SELECT part, row_no - 1 AS entry, x FROM parts WHERE row_no <= {ENTRIES}),
{"".join(_sql_round(n) + _sql_book(n) for n in range(ROUNDS))}{_sql_round(ROUNDS)}
 coded AS MATERIALIZED (
  SELECT row_no, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY row_no),
 hashed AS MATERIALIZED (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (row_no), hashed
"""
