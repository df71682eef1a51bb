"""What the operators share: tables in the shared folder, checked broadcasts, connected components, tokenizer pieces."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.plans.store import shared_dir, stored

__all__ = ["BROADCAST_ROWS", "components", "few_files", "partitions", "settings", "shared_dir", "small_or_not", "smallest_reachable", "stored", "trusted_labels"]

#: Rows of a narrow table (a few numbers each) up to which it is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000


def small_or_not(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, a stored table, with a broadcast hint if a count proves that it is small; else df, so that a join with it shuffles."""
    return F.broadcast(df) if df.count() <= rows else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def few_files(df: DataFrame) -> DataFrame:
    """df, a narrow table (a few numbers each row, made without texts), in fewer partitions, as it needs no file for each. In a local folder each file costs the executor that writes it processes of its own, which set its mode."""
    return df.coalesce(-(-partitions(df.sparkSession) // 32))


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session that hold for what is run while this is open, and are put back then."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links (a[i], b[i]) and for each the smallest node reachable from it."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)  # hook the roots, then shorten every path
        np.minimum.at(new, label[b], low)
        while True:
            shorter = new[new]
            if (shorter == new).all():
                break
            new = shorter
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _contract(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's links, replaced by one link to the smallest node of each of their components."""
    parts = [(f.column(0).to_numpy(), f.column(1).to_numpy()) for f in frames]
    if parts:
        nodes, tops = smallest_reachable(*(np.concatenate(x) for x in zip(*parts)))
        for at in range(0, len(nodes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + (1 << 16)]), pa.array(tops[at : at + (1 << 16)])], ["hi", "lo"])


def components(links: DataFrame, most_rounds: int = 60, one_task: int = BROADCAST_ROWS) -> DataFrame:
    """Connected components of links (a, b): one row (node, component) per node, component the smallest node reachable.

    Each partition first contracts its links to stars. If a count then proves that at most `one_task` links are left,
    one task ends the work; else large-star and small-star steps alternate (Kiveris et al. 2014), each stored, until
    nothing changes. Empty links give no rows; loops and repeated links change nothing. Raises if most_rounds is not
    enough, rather than return something unfinished.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    edges = stored(edges.mapInArrow(_contract, "hi long, lo long").where("hi <> lo"), "links")
    before = None
    for _ in range(most_rounds):
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if after[0] <= one_task:
            return edges.repartition(1).mapInArrow(_contract, "hi long, lo long").select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        if after == before:
            break
        before = after
        both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        large = stored(large, "large")
        least = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        joined = large.withColumnRenamed("hi", "u").join(least, "u")
        small = joined.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(joined.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
        edges = stored(small.where("hi <> lo").distinct(), "small")
    else:
        raise RuntimeError(f"components not found in {most_rounds} rounds")
    tops = edges.select(F.col("lo").alias("node")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(tops.select("node", F.col("node").alias("component")))


def trusted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table labels with one row per doc_id: where a document was labelled twice, the larger values count; rows without doc_id go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("doc_id is not null")
    return labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
