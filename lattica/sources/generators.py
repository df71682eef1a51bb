"""Synthetic graphs and edges, without state: every row is a function of its number and the seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.numeric import draw


def _edges(rows: DataFrame, *pairs: tuple[str, str, str]) -> DataFrame:
    """pairs: source, target and condition as SQL expressions over rows."""
    out = F.array(*[F.struct(F.when(F.expr(c), F.expr(a)).alias("src"), F.expr(b).alias("dst")) for a, b, c in pairs])
    return rows.select(F.explode(out).alias("e")).select("e.src", "e.dst").where("src is not null")


def chain(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(max(0, n - 1)).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))


def grid(spark: SparkSession, n: int) -> DataFrame:
    """n by n vertices, each joined to the next in its row and the next in its column."""
    return _edges(spark.range(n * n), ("id", "id + 1", f"id % {n} < {n - 1}"), ("id", f"id + {n}", f"id < {n * (n - 1)}"))


def crossgrid(spark: SparkSession, n: int) -> DataFrame:
    """A grid with both diagonals of each cell."""
    inner = f"id % {n} < {n - 1} and id < {n * (n - 1)}"
    return _edges(spark.range(n * n), ("id", "id + 1", f"id % {n} < {n - 1}"), ("id", f"id + {n}", f"id < {n * (n - 1)}"), ("id", f"id + {n + 1}", inner), ("id + 1", f"id + {n}", inner))


def cubegrid(spark: SparkSession, n: int) -> DataFrame:
    """A grid in three dimensions."""
    return _edges(spark.range(n**3), ("id", "id + 1", f"id % {n} < {n - 1}"), ("id", f"id + {n}", f"(id div {n}) % {n} < {n - 1}"), ("id", f"id + {n * n}", f"id < {n * n * (n - 1)}"))


def quadgrid(spark: SparkSession, n: int) -> DataFrame:
    """A grid in which every vertex is also joined to the one two steps on in its row and column."""
    return grid(spark, n).union(_edges(spark.range(n * n), ("id", "id + 2", f"id % {n} < {n - 2}"), ("id", f"id + {2 * n}", f"id < {n * (n - 2)}")))


def erdos_renyi(spark: SparkSession, n: int, p: float, seed: int = 1) -> DataFrame:
    """Each of the n(n-1)/2 pairs with probability p, in a random direction. Pairs come from row numbers, not from a product of two tables."""
    rows = spark.range(n).select(F.col("id").alias("a"), F.explode(F.sequence(F.col("id"), F.lit(n - 1))).alias("b")).where("a < b")
    turn = draw(seed, "b", "a") < 0.5
    return rows.where(draw(seed, "a", "b") < p).select(F.when(turn, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(turn, F.col("b")).otherwise(F.col("a")).alias("dst"))


def random_weights(edges: DataFrame, below: int = 100_000_000, seed: int = 1) -> DataFrame:
    """edges with an integer weight from 0 to below - 1."""
    return edges.withColumn("weight", F.floor(draw(seed, "src", "dst") * below).cast("int"))


def base_and_stream(edges: DataFrame, share: float = 0.5, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Edges that are there from the start, and the rest with `turn`, a random order of arrival."""
    base = draw(seed, "src", "dst") < share
    return edges.where(base), edges.where(~base).withColumn("turn", draw(seed + 1, "dst", "src"))


def implicit_ratings(spark: SparkSession, users: int, items: int, n: int, value: float = 0.0, seed: int = 1, weight: float | None = None) -> DataFrame:
    """n user-item pairs drawn uniformly (ids from 1), all with one rating, for training on what was not rated."""
    pick = lambda name, size: (F.floor(draw(seed, "id", F.lit(name)) * size) + 1).cast("long").alias(name)
    rows = spark.range(n).select(pick("user", users), pick("item", items), F.lit(value).alias("rating"))
    return rows if weight is None else rows.withColumn("weight", F.lit(weight))
