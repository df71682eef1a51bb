"""Nearest neighbours by cosine with a vantage-point tree per shard.

On unit vectors the chord sqrt(2 - 2 cos) is a metric, and a smaller chord is a larger cosine. Each inner node holds a
vantage point and, for both halves of the rest, the range of their chords to it; a half is skipped if its lower bound
times `factor` exceeds the chord to the k-th neighbour found so far. Factor 1 is exact, larger ones skip more.
Copies of a vector are one point with a list of ids.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import partitions, stored

SHARD_ROWS, QUERY_ROWS, LEAF = 16384, 256, 128
#: Bytes of a shard's vectors in double precision, at most; tasks that hold trees, at most.
SHARD_BYTES, MOST_TASKS = 256 << 20, 20_000
_SLACK = 1e-9


class Tree:
    """points: distinct vectors in leaf order; ids[id_start[i]:id_start[i+1]]: the rows that hold point i, ascending.

    Nodes lie in preorder: a node covers points[lo:hi]; its vantage point is points[lo]; the inner half is
    points[lo+1:mid], the outer half points[mid:hi]; ranges holds the least and largest chord of either half.
    """

    def __init__(self, points, ids, id_start, nodes, ranges):
        self.points, self.ids, self.id_start, self.nodes, self.ranges = points, ids, id_start, nodes, ranges
        wide = points.astype(np.float64)
        self.norms = np.sqrt((wide * wide).sum(1)) if len(points) else np.zeros(0)
        self.unit = wide / self.norms[:, None] if len(points) else wide

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF, seed: int = 5) -> Tree:
        order = np.lexsort((ids, *vectors.T[::-1])) if len(ids) else np.zeros(0, dtype=np.int64)
        ids, vectors = ids[order], vectors[order]
        fresh = np.ones(len(ids), dtype=bool)
        fresh[1:] = (vectors[1:] != vectors[:-1]).any(1)
        first = np.append(np.flatnonzero(fresh), len(ids))
        points = vectors[fresh]
        wide = points.astype(np.float64)
        unit = wide / np.sqrt((wide * wide).sum(1))[:, None]
        place, nodes, ranges, draw = np.arange(len(points)), [], [], np.random.default_rng(seed)
        todo = [(0, len(points), -1)]
        while todo:
            lo, hi, parent = todo.pop()
            number = len(nodes)
            if parent >= 0:
                nodes[parent][3] = number
            if hi - lo <= leaf:
                nodes.append([lo, hi, -1, -1])
                ranges.append([0.0] * 4)
                continue
            rows = place[lo:hi]
            tried = draw.choice(len(rows), min(8, len(rows)), replace=False)
            against = draw.choice(len(rows), min(64, len(rows)), replace=False)
            spread = _chord(unit[rows[tried]] @ unit[rows[against]].T).var(1)
            v = tried[spread.argmax()]
            rows[[0, v]] = rows[[v, 0]]
            far = _chord(unit[rows[1:]] @ unit[rows[0]])
            half = len(far) // 2
            split = np.argpartition(far, half)
            place[lo + 1 : hi] = rows[1:][split]
            far = far[split]
            mid = lo + 1 + half
            nodes.append([lo, hi, mid, -1])
            ranges.append([far[:half].min(initial=0.0), far[:half].max(initial=0.0), far[half:].min(), far[half:].max()])
            todo += [(mid, hi, number), (lo + 1, mid, -1)]  # the inner half comes next in preorder
        counts = np.diff(first)[place]
        start = np.concatenate([[0], np.cumsum(counts)])
        listed = np.concatenate([ids[first[p] : first[p + 1]] for p in place]) if len(place) else ids
        return cls(points[place], listed, start, np.array(nodes, dtype=np.int64).reshape(-1, 4), np.array(ranges).reshape(-1, 4))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, self.points, self.ids, self.id_start, self.nodes, self.ranges)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Tree:
        with np.load(io.BytesIO(data)) as held:
            return cls(*(held[f"arr_{k}"] for k in range(5)))

    def search(self, own: np.ndarray, vectors: np.ndarray, k: int, factor: float = 1.0) -> tuple[list[np.ndarray], list[np.ndarray], int]:
        """For each query its k nearest rows other than `own` (ids, scores), nearest first, and the chords computed."""
        wide = vectors.astype(np.float64)
        norms = np.sqrt((wide * wide).sum(1))
        unit = wide / norms[:, None]
        keep = min(len(self.points), k + 4)  # its own point, and room for what rounding puts in another order
        best, at = np.full((len(unit), keep), -np.inf), np.zeros((len(unit), keep), dtype=np.int64)
        reach = np.full(len(unit), np.inf)
        work = 0

        def offer(who: np.ndarray, lo: int, hi: int) -> None:
            nonlocal work
            work += len(who) * (hi - lo)
            got = unit[who] @ self.unit[lo:hi].T
            both = np.concatenate([best[who], got], 1)
            places = np.concatenate([at[who], np.broadcast_to(np.arange(lo, hi), got.shape)], 1)
            top = np.argpartition(-both, keep - 1, axis=1)[:, :keep]
            best[who], at[who] = np.take_along_axis(both, top, 1), np.take_along_axis(places, top, 1)
            reach[who] = _chord(best[who].min(1))

        todo = [(0, np.arange(len(unit)), np.zeros(len(unit)))] if len(self.points) else []
        while todo:
            node, who, least = todo.pop()
            open_ = ~(least * factor > reach[who] + _SLACK)
            who = who[open_]
            if not len(who):
                continue
            lo, hi, mid, outer = self.nodes[node]
            if mid < 0:
                offer(who, lo, hi)
                continue
            far = _chord(unit[who] @ self.unit[lo])
            offer(who, lo, lo + 1)
            a, b, c, d = self.ranges[node]
            near_in, near_out = np.maximum(np.maximum(a - far, far - b), 0), np.maximum(np.maximum(c - far, far - d), 0)
            inner_first = near_in <= near_out
            inner, beyond = (node + 1, near_in), (outer, near_out)
            # queries nearer to one half see it first: the last pushed is visited first
            for chosen, (then, now) in ((inner_first, (beyond, inner)), (~inner_first, (inner, beyond))):
                if chosen.any():
                    todo += [(then[0], who[chosen], then[1][chosen]), (now[0], who[chosen], now[1][chosen])]
        ids, scores = [], []
        for q in range(len(unit)):
            hit = at[q][np.isfinite(best[q])]
            exact = (self.points[hit].astype(np.float64) * wide[q]).sum(1) / (self.norms[hit] * norms[q])
            if len(hit) == keep < len(self.points) and np.partition(best[q], -k - 1)[-k - 1] - best[q].min() < _SLACK:  # more points may tie with the last than are kept
                near = np.flatnonzero(self.unit @ unit[q] > best[q].min() - _SLACK)
                exact = (self.points[near].astype(np.float64) * wide[q]).sum(1) / (self.norms[near] * norms[q])
                hit = near
            rows = [(-s, i) for s, p in zip(exact.tolist(), hit.tolist()) for i in self.ids[self.id_start[p] : self.id_start[p + 1]][: k + 1].tolist() if i != own[q]]
            rows.sort()
            ids.append(np.array([i for _, i in rows[:k]], dtype=np.int64))
            scores.append(np.array([-s for s, _ in rows[:k]]))
        return ids, scores, work


def _chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


def _packed(make):
    """Groups that arrive sorted by their first two columns, each made into one row (dim, number, bytes)."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        key = None

        def row() -> pa.RecordBatch:
            data = make(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]))
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([data], pa.binary())], ["dim", "number", "data"])

        for frame in frames:
            dims, numbers = frame.column(0).to_numpy(), frame.column(1).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(dims) != 0) | (np.diff(numbers) != 0)) + 1, [len(dims)]])
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if key is not None and key != (int(dims[a]), int(numbers[a])):
                    yield row()
                    held = []
                key = (int(dims[a]), int(numbers[a]))
                part = frame.column(3).slice(a, b - a)
                held.append((frame.column(2).slice(a, b - a).to_numpy(), part.flatten().to_numpy().reshape(b - a, key[0])))
        if held:
            yield row()

    return run


def _block(ids: np.ndarray, vectors: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, ids, vectors)
    return out.getvalue()


def _search(k: int, factor: float):
    """Rows (dim, number, block, data), sorted: a shard's tree (block -1), then the blocks of queries that it is asked."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for frame in frames:
            for dim, block, data in zip(frame.column(0).to_pylist(), frame.column(2).to_pylist(), frame.column(3)):
                if block < 0:
                    tree = Tree.from_bytes(data.as_py())
                    continue
                with np.load(io.BytesIO(data.as_py())) as held:
                    own, vectors = held["arr_0"], held["arr_1"]
                ids, scores, _ = tree.search(own, vectors, k, factor)
                lengths = [len(i) for i in ids]
                n, place = sum(lengths), np.repeat(np.arange(len(own)), lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, dim, dtype=np.int32)), pa.array(np.full(n, block, dtype=np.int32)), pa.array(np.repeat(own, lengths)), pa.array(place), pa.array(np.concatenate([*ids, np.zeros(0, np.int64)])), pa.array(np.concatenate([*scores, np.zeros(0)]))],
                    ["dim", "block", "query_id", "place", "vec_id", "score"],
                )

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (floats as given, else doubles) and dim of the vectors that take part: not null or zero, all components finite."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null").where(fine).withColumn("dim", F.size(e))


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, factor: float = 1.0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (the cosine, in double precision) of each query's k nearest rows.

    Queries are the rows whose vec_id is divisible by `every`; candidates are all rows but those of the query's own
    vec_id; all candidates if there are fewer than k. Ties go to the smaller vec_id. Vectors that are null, zero, or
    hold null or non-finite components take no part, nor do rows without vec_id; vectors of different lengths are not
    compared. A vec_id that is repeated is a candidate as often as it occurs; as a query, each of its different vectors
    gets its own k rows. An empty table gives no rows. Other columns are not read.

    Every shard's tree stays in one task, and the blocks of queries come to it one after the other: a query travels once
    per shard, a tree once.
    """
    spark = vectors.sparkSession
    rows = stored(usable(vectors), "vectors")
    sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row for each length of vectors
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards = {d: max(1, -(-n // max(LEAF, min(shard_rows, SHARD_BYTES // (8 * d), max(2048, n // 64))))) for d, n in sizes.items()}  # a small table is shared out as well
    of = lambda numbers: F.element_at(F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair]), F.col("dim"))
    keyed = rows.withColumn("number", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), of(shards)).cast("int"))
    n = min(MOST_TASKS, sum(shards.values()))
    trees = keyed.select("dim", "number", "vec_id", "embedding").repartition(n, "dim", "number").sortWithinPartitions("dim", "number", "vec_id").mapInArrow(_packed(lambda i, v: Tree.build(i, v).to_bytes()), "dim int, number int, data binary")
    trees = stored(trees, "trees")
    blocks = {d: max(1, -(-m // every // QUERY_ROWS)) for d, m in sizes.items()}
    asked = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "embedding"])
    asked = asked.withColumn("number", F.pmod(F.xxhash64("vec_id", "embedding"), of(blocks)).cast("int"))
    asked = asked.select("dim", "number", "vec_id", "embedding").repartition(min(partitions(spark), sum(blocks.values())), "dim", "number").sortWithinPartitions("dim", "number", "vec_id").mapInArrow(_packed(_block), "dim int, number int, data binary")
    asked = stored(asked, "asked").select("dim", F.explode(F.sequence(F.lit(0), of(shards) - 1)).alias("number"), F.col("number").alias("block"), "data")
    met = trees.select("dim", "number", F.lit(-1).alias("block"), "data").union(asked).repartition(n, "dim", "number").sortWithinPartitions("dim", "number", "block")
    found = met.mapInArrow(_search(k, factor), "dim int, block int, query_id long, place long, vec_id long, score double")
    first = Window.partitionBy("dim", "block", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
