"""Connected and strongly connected components, percolation, label histograms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.graph import ids_of, proper, reverse
from lattica.plans.store import stored

#: Links up to which one task finishes what partitions have contracted.
ONE_TASK = 1_000_000


def connected(edges: DataFrame, vertices: DataFrame | None = None, most_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """id and component, the smallest id that its edges, in either direction, lead to. Vertices without edges stand alone.

    Partitions contract their edges to stars; if at most one_task stars' edges are left, one task joins them, else
    rounds of large and small stars (Kiveris et al. 2014) do.
    """
    links = proper(edges).select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo"))
    stars = stored(links.mapInArrow(_contract, "hi long, lo long").where("hi <> lo"), "stars")
    before = None
    for _ in range(most_rounds):
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state[0] <= one_task:
            stars = stars.repartition(1).mapInArrow(_contract, "hi long, lo long").where("hi <> lo")
            break
        if state == before:
            break
        before = state
        stars = _round(stars)
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    ids = vertices.select("id") if vertices is not None else ids_of(edges)
    return ids.join(stars.select(F.col("hi").alias("id"), F.col("lo").alias("component")), "id", "left").withColumn("component", F.coalesce("component", "id"))


def _round(stars: DataFrame) -> DataFrame:
    both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(stars.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    top = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = stored(both.where("v > u").join(top, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct(), "large")
    top = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
    small = large.withColumnRenamed("hi", "u").join(top, "u")
    small = small.select(F.explode(F.array(F.struct(F.col("u").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.hi", "e.lo")
    return stored(small.where("hi <> lo").distinct(), "small")


def _contract(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(f.column(0).to_numpy(), f.column(1).to_numpy()) for f in frames]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts))
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while True:  # hook labels along edges, then halve the paths
        low, new = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    for at in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + (1 << 16)]), pa.array(nodes[label[at : at + (1 << 16)]])], ["hi", "lo"])


def min_label(edges: DataFrame, supersteps: int) -> DataFrame:
    """id and label after so many synchronous supersteps of taking the smallest label around; not converged if they are few.

    Only neighbours of vertices whose label changed receive messages.
    """
    both = proper(edges).select("src", "dst")
    both = stored(both.union(reverse(both)).distinct(), "both")
    state = stored(ids_of(edges).select("id", F.col("id").alias("label"), F.lit(True).alias("changed")), "labels")
    for _ in range(supersteps):
        sent = both.join(state.where("changed").select(F.col("id").alias("src"), "label"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("got"))
        lower = F.coalesce(F.col("got") < F.col("label"), F.lit(False))
        state = stored(state.join(sent, "id", "left").select("id", F.when(lower, F.col("got")).otherwise(F.col("label")).alias("label"), lower.alias("changed")), "labels")
        if state.where("changed").limit(1).count() == 0:
            break
    return state.select("id", "label")


def label_histogram(labels: DataFrame, label: str, compat: bool = False) -> DataFrame:
    """label and n, its vertices. compat leaves vertices that are their own label out of the rows and adds 1 to each count, so lone vertices are not listed."""
    if compat:
        return labels.where(F.col(label) != F.col("id")).groupBy(F.col(label).alias("label")).agg((F.count("*") + 1).alias("n"))
    return labels.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))


def component_statistics(edges: DataFrame, components: DataFrame) -> DataFrame:
    """component, vertices and edges of each."""
    inside = edges.join(components.select(F.col("id").alias("src"), "component"), "src").groupBy("component").agg(F.count("*").alias("n_edges"))
    return components.groupBy("component").agg(F.count("*").alias("n_vertices")).join(inside, "component", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))


def percolation(edges: DataFrame, p: float | None = None, seed: int = 1) -> DataFrame:
    """kind (site or bond), size, n: how many components have so many vertices and so many edges; p keeps edges at random first."""
    if p is not None:
        edges = edges.where(F.pmod(F.xxhash64("src", "dst", F.lit(seed)), F.lit(1 << 40)) < int(p * (1 << 40)))
    sizes = stored(component_statistics(edges, connected(edges)), "sizes")
    kinds = F.explode(F.array(F.struct(F.lit("site").alias("kind"), F.col("n_vertices").alias("size")), F.struct(F.lit("bond").alias("kind"), F.col("n_edges").alias("size")))).alias("k")
    return sizes.select(kinds).groupBy("k.kind", "k.size").agg(F.count("*").alias("n"))


def strongly_connected(edges: DataFrame) -> DataFrame:
    """id and component, the smallest id of its strongly connected component.

    Rounds: vertices without in- or out-edges among the open ones are components of their own; in what is left, the
    smallest id flows forward to a fixed point as a color; from each color's root a mark flows backward within the
    color; what is marked is the root's component. Edges that leave a color or touch a closed vertex go.
    """
    open_edges = stored(proper(edges).select("src", "dst").distinct(), "open")
    ids = stored(ids_of(edges), "ids")
    done = None
    while True:  # every round closes each color's root, so it ends
        while True:  # trim
            inner = open_edges.select(F.col("src").alias("id")).distinct().join(open_edges.select(F.col("dst").alias("id")).distinct(), "id")
            kept = stored(open_edges.join(inner.withColumnRenamed("id", "src"), "src", "left_semi").join(inner.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"), "open")
            same = kept.count() == open_edges.count()
            open_edges = kept
            if same:
                break
        if open_edges.limit(1).count() == 0:
            break
        color = _flow(open_edges, ids_of(open_edges).select("id", F.col("id").alias("label")))
        same_color = open_edges.join(color.select(F.col("id").alias("src"), F.col("label").alias("c1")), "src").join(color.select(F.col("id").alias("dst"), F.col("label").alias("c2")), "dst").where("c1 = c2")
        inside = stored(same_color.select("src", "dst"), "inside")
        marks = _flow(reverse(inside), color.select("id", F.when(F.col("id") == F.col("label"), F.lit(0)).otherwise(1).cast("long").alias("label")))
        found = stored(marks.where("label = 0").select("id").join(color.select("id", F.col("label").alias("component")), "id"), "found")
        done = found if done is None else stored(done.union(found), "done")
        closed = found.select("id")
        open_edges = stored(inside.join(closed.withColumnRenamed("id", "src"), "src", "left_anti").join(closed.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"), "open")
    if done is None:
        return ids.select("id", F.col("id").alias("component"))
    return ids.join(done, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _flow(edges: DataFrame, state: DataFrame) -> DataFrame:
    """id, label: the smallest label that reaches each vertex along edges, to the fixed point; only changes are sent."""
    state = stored(state.withColumn("changed", F.lit(True)), "flow")
    while True:
        sent = edges.join(state.where("changed").select(F.col("id").alias("src"), "label"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("got"))
        lower = F.coalesce(F.col("got") < F.col("label"), F.lit(False))
        state = stored(state.join(sent, "id", "left").select("id", F.when(lower, F.col("got")).otherwise(F.col("label")).alias("label"), lower.alias("changed")), "flow")
        if state.where("changed").limit(1).count() == 0:
            return state.select("id", "label")
