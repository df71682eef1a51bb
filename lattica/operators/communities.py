"""Label propagation, seeded propagation, k-cores, triangles, spanning forests, neighbourhoods."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.graph import canonical, ids_of, proper, reverse
from lattica.plans.store import Steps, stored

from .components import connected


def label_propagation(edges: DataFrame, supersteps: int = 10) -> DataFrame:
    """id and label: each superstep takes the label most frequent among all incident edges, ties to the larger one.

    Synchronous, with a fixed number of supersteps, as labels may swing for ever; stops early if none changes.
    """
    both = proper(edges).select("src", "dst")
    both = stored(both.union(reverse(both)), "both")
    state = stored(ids_of(edges).select("id", F.col("id").alias("label")), "labels")
    for _ in range(supersteps):
        counts = both.join(state.withColumnRenamed("id", "src"), "src").groupBy("dst", "label").agg(F.count("*").alias("n"))
        best = counts.groupBy(F.col("dst").alias("id")).agg(F.max(F.struct("n", "label")).alias("best"))
        new = state.join(best, "id", "left").select("id", F.coalesce(F.col("best.label"), F.col("label")).alias("label"), (F.col("best.label") != F.col("label")).alias("moved"))
        new = stored(new, "labels")
        state = new.select("id", "label")
        if new.where("moved").limit(1).count() == 0:
            break
    return state


def seeded_propagation(edges: DataFrame, seeds: DataFrame, alpha: float = 0.15, supersteps: int = 6, default_weight: float = 1.0) -> DataFrame:
    """id, label, prob: shares of labels spread backward over out-edges from seeds, which stay fixed.

    edges: src, dst and perhaps value, the weight; seeds: id, label, prob. A vertex becomes alpha times its own shares
    plus 1 - alpha times its out-neighbours' weighted shares normalised to 1, all normalised to 1. Vertices that no
    seed reaches have no rows. With edges in both directions and counts as weights this is co-training (CoEM).
    """
    weight = F.coalesce(F.col("value").cast("double"), F.lit(default_weight)) if "value" in edges.columns else F.lit(default_weight)
    weighted = stored(edges.select("src", "dst", weight.alias("w")), "weighted")
    fixed = stored(seeds.select("id", "label", F.col("prob").cast("double").alias("prob")), "seeds")
    state = fixed
    for _ in range(supersteps):
        got = weighted.join(state.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.sum(F.col("w") * F.col("prob")).alias("got"))
        got = got.withColumn("got", F.col("got") / F.sum("got").over(Window.partitionBy("id")))
        mixed = state.join(got, ["id", "label"], "full").select("id", "label", (alpha * F.coalesce("prob", F.lit(0.0)) + (1 - alpha) * F.coalesce("got", F.lit(0.0))).alias("prob"))
        mixed = mixed.join(fixed.select("id").distinct(), "id", "left_anti")
        mixed = mixed.withColumn("prob", F.col("prob") / F.sum("prob").over(Window.partitionBy("id")))
        state = stored(mixed.select("id", "label", "prob").union(fixed), "shares")
    return state


def co_training(pairs: DataFrame, positive: DataFrame, negative: DataFrame, alpha: float = 0.15, supersteps: int = 6) -> DataFrame:
    """noun and context phrases as id, prob: how positive each is, from seeds (id) fixed at 1 and 0. pairs: noun, context, n.

    Ids of nouns and contexts are told apart by `kind`: the id columns of the result are kind and name.
    """
    node = lambda kind, name: F.concat(F.lit(f"{kind}:"), F.col(name).cast("string"))
    forward = pairs.select(node("noun", "noun").alias("src"), node("context", "context").alias("dst"), F.col("n").cast("double").alias("w"))
    both = stored(forward.union(forward.select("dst", "src", "w")), "phrases")
    seeds = positive.select(node("noun", "id").alias("id"), F.lit(1.0).alias("p")).union(negative.select(node("noun", "id").alias("id"), F.lit(0.0).alias("p")))
    ids = both.select(F.col("src").alias("id")).distinct().join(seeds, "id", "left").select("id", F.col("p").alias("fixed"), F.coalesce("p", F.lit(0.5)).alias("p"))
    state = stored(ids, "phrases")
    for _ in range(supersteps):
        got = both.join(state.select(F.col("id").alias("dst"), "p"), "dst").groupBy(F.col("src").alias("id")).agg((F.sum(F.col("w") * F.col("p")) / F.sum("w")).alias("got"))
        state = stored(state.join(got, "id", "left").select("id", "fixed", F.coalesce("fixed", alpha * F.col("p") + (1 - alpha) * F.coalesce("got", F.col("p"))).alias("p")), "phrases")
    return state.select(F.substring_index("id", ":", 1).alias("kind"), F.regexp_replace("id", "^[a-z]+:", "").alias("name"), F.col("p").alias("prob"))


#: Pairs of neighbours up to which one task ends the work on core numbers.
ONE_TASK = 1_000_000


def _peel(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id and core from all rows (src, dst, n), both directions of each pair: vertices leave in the order of their open edges."""
    parts = [[f.column(k).to_numpy() for k in range(3)] for f in frames]
    if not parts:
        return
    src, dst, n = (np.concatenate(x) for x in zip(*parts))
    ids, src = np.unique(src, return_inverse=True)
    dst = np.searchsorted(ids, dst)
    order = np.argsort(src, kind="stable")
    dst, n, start = dst[order].tolist(), n[order].tolist(), np.searchsorted(src[order], np.arange(len(ids) + 1)).tolist()
    open_edges = np.bincount(src, weights=np.array(n)[np.argsort(order, kind="stable")], minlength=len(ids)).astype(np.int64).tolist()
    core, heap, k = [0] * len(ids), [(d, v) for v, d in enumerate(open_edges)], 0
    heapq.heapify(heap)
    while heap:
        d, v = heapq.heappop(heap)
        if core[v] or d != open_edges[v]:
            continue
        k = max(k, d)
        core[v] = k
        for at in range(start[v], start[v + 1]):
            u = dst[at]
            if not core[u]:
                open_edges[u] -= n[at]
                heapq.heappush(heap, (open_edges[u], u))
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(core, pa.int64())], ["id", "core"])


def core_numbers(edges: DataFrame, vertices: DataFrame | None = None, one_task: int = ONE_TASK) -> DataFrame:
    """id and core: the k with which a vertex closes if, for k = 1, 2, ..., vertices with at most k incident open edges close again and again.

    Parallel and reciprocal edges count separately; vertices without edges have core 1. If a count proves that at most
    `one_task` pairs of neighbours are there, one task peels them. Else a vertex's core is the fixed point of taking, from
    its degree on, the largest h such that h of its edges lead to values of h and more (Lu et al. 2016), in as many rounds
    as that takes; edges are summed by (vertex, value) first, so a hub costs one row per value.
    """
    both = proper(edges).select("src", "dst")
    both = stored(both.union(reverse(both)).groupBy("src", "dst").agg(F.count("*").alias("n")), "both")
    ids = vertices.select("id") if vertices is not None else ids_of(edges)
    if both.count() <= one_task:
        state = both.repartition(1).mapInArrow(_peel, "id long, core long")
    else:
        steps = Steps()
        state = steps.keep(both.groupBy(F.col("dst").alias("id")).agg(F.sum("n").alias("core")), "cores")
        falling = Window.partitionBy("id").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        while True:
            near = both.join(state.select(F.col("id").alias("src"), F.col("core").alias("value")), "src").groupBy(F.col("dst").alias("id"), "value").agg(F.sum("n").alias("n"))
            high = near.withColumn("upto", F.sum("n").over(falling)).groupBy("id").agg(F.max(F.least("value", "upto")).alias("h"))
            new = steps.keep(state.join(high, "id").select("id", F.least("core", "h").alias("core"), (F.col("h") < F.col("core")).alias("moved")), "cores")
            state = new.select("id", "core")
            if new.where("moved").limit(1).count() == 0:
                break
    return ids.join(state, "id", "left").select("id", F.greatest(F.coalesce("core", F.lit(1)), F.lit(1)).cast("int").alias("core"))


def core_table(edges: DataFrame, cores: DataFrame) -> DataFrame:
    """core, removed (vertices), removed_total, links_total: edges gone once all vertices up to that core are."""
    ends = proper(edges).join(cores.select(F.col("id").alias("src"), F.col("core").alias("a")), "src").join(cores.select(F.col("id").alias("dst"), F.col("core").alias("b")), "dst")
    links = ends.groupBy(F.least("a", "b").alias("core")).agg(F.count("*").alias("links"))
    table = cores.groupBy("core").agg(F.count("*").alias("removed")).join(links, "core", "left")
    upto = Window.orderBy("core").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row per core
    return table.select("core", "removed", F.sum("removed").over(upto).alias("removed_total"), F.sum(F.coalesce("links", F.lit(0))).over(upto).alias("links_total"))


def triangles(edges: DataFrame) -> DataFrame:
    """id and triangles of each vertex that is in one; a third of their sum is the number of triangles.

    Reciprocal and parallel edges count once. Edges point from the smaller (degree, id) to the larger, so that no
    vertex has more than about sqrt(2m) of them and hubs do not blow up the join of pairs.
    """
    pairs = stored(canonical(edges), "pairs")
    degree = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    known = pairs.join(degree.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    up = F.struct("da", "a") < F.struct("db", "b")
    oriented = stored(known.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v")), "oriented")
    wedges = oriented.alias("x").join(oriented.alias("y"), F.col("x.u") == F.col("y.u")).where("x.v < y.v").select(F.col("x.u").alias("u"), F.col("x.v").alias("a"), F.col("y.v").alias("b"))
    closed = wedges.join(pairs, ["a", "b"])
    return closed.select(F.explode(F.array("u", "a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))


def spanning_forest(edges: DataFrame, algorithm: str = "boruvka", most_rounds: int = 200, seed: int = 1) -> DataFrame:
    """src, dst, weight of a minimum spanning forest. edges: src, dst, weight.

    Edges are ordered by (weight, smaller end, larger end, src), so the forest is unique and ties make no cycles. Each
    round every component takes its least outgoing edge (boruvka), or only components whose coin is tails take it
    towards one whose coin is heads (star); components merge, and of parallel contracted edges the least stays.
    """
    first = proper(edges).groupBy(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).agg(F.min(F.struct("weight", "src", "dst")).alias("e"))
    open_edges = stored(first.select(F.col("lo").alias("a"), F.col("hi").alias("b"), F.struct("e.weight", "lo", "hi", "e.src", "e.dst").alias("e")), "open")
    taken = None
    for k in range(most_rounds):
        if open_edges.limit(1).count() == 0:
            break
        ends = open_edges.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("to"), "e"), F.struct(F.col("b").alias("c"), F.col("a").alias("to"), "e"))).alias("x")).select("x.*")
        least = ends.groupBy("c").agg(F.min(F.struct("e", "to")).alias("m")).select("c", "m.to", "m.e")
        if algorithm == "star":
            coin = lambda c: F.pmod(F.xxhash64(c, F.lit(seed), F.lit(k)), F.lit(2))
            least = least.where((coin("c") == 1) & (coin("to") == 0))
        least = stored(least, "least")
        chosen = least.select("e").distinct()
        taken = stored(chosen if taken is None else taken.union(chosen), "taken")
        merged = connected(least.select(F.col("c").alias("src"), F.col("to").alias("dst")))
        merged = stored(merged, "merged")
        moved = open_edges.join(merged.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left").join(merged.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
        moved = moved.select(F.coalesce("ca", "a").alias("x"), F.coalesce("cb", "b").alias("y"), "e").where("x <> y")
        open_edges = stored(moved.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("e").alias("e")), "open")
    else:
        raise RuntimeError(f"not finished after {most_rounds} rounds")
    if taken is None:
        return edges.select("src", "dst", "weight").limit(0)
    return taken.select("e.src", "e.dst", "e.weight").distinct()


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = 3, most_edges: int | None = None, undirected: bool = True) -> DataFrame:
    """src, dst, hop of the edges that seeds (id) reach in so many hops. most_edges keeps the nearest, then by (src, dst)."""
    pool = proper(edges).select("src", "dst")
    pool = stored(pool.union(reverse(pool)).distinct() if undirected else pool, "pool")
    frontier, seen, found = stored(seeds.select("id").distinct(), "frontier"), None, None
    for k in range(1, hops + 1):
        step = pool.join(frontier.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst", F.lit(k).alias("hop"))
        found = stored(step if found is None else found.union(step), "found")
        seen = frontier if seen is None else stored(seen.union(frontier), "seen")
        frontier = stored(found.where(F.col("hop") == k).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti"), "frontier")
        if frontier.limit(1).count() == 0:
            break
    if undirected:
        found = found.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("hop").alias("hop"))
    return found if most_edges is None else found.orderBy("hop", "src", "dst").limit(most_edges)


def seed_edges(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges whose ends are both seeds."""
    ids = seeds.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)
