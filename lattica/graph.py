"""The data model: a directed graph is a DataFrame of edges (src, dst and attributes) and, if wanted, one of vertices (id and attributes)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """edges: src, dst, attributes. vertices: id, attributes; without it the vertices are the ids that occur in edges."""

    edges: DataFrame
    given: DataFrame | None = None

    @property
    def vertices(self) -> DataFrame:
        return self.given if self.given is not None else ids_of(self.edges)

    def reversed(self) -> Graph:
        return Graph(reverse(self.edges), self.given)

    def symmetrised(self, distinct: bool = True) -> Graph:
        return Graph(symmetrise(self.edges, distinct), self.given)

    def degrees(self) -> DataFrame:
        return degrees(self.edges)

    def with_dense_ids(self) -> Graph:
        """Vertices 0 to the largest id, so that ids without edges exist too."""
        top = self.edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
        return Graph(self.edges, self.edges.sparkSession.range(0 if top is None else top + 1))

    def append(self, edges: DataFrame) -> Graph:
        """Adds edges as a multiset."""
        return Graph(self.edges.unionByName(edges, allowMissingColumns=True), self.given)

    def without(self, gone: DataFrame) -> Graph:
        """Drops the edges (src, dst) in gone, all parallel ones alike."""
        return Graph(self.edges.join(gone.select("src", "dst").distinct(), ["src", "dst"], "left_anti").select(*self.edges.columns), self.given)

    def without_vertices(self, ids: DataFrame, side: str = "all") -> Graph:
        """Drops the edges at the vertices in ids: their in-edges (side="in"), out-edges ("out") or both ("all")."""
        edges, gone = self.edges, ids.select("id").distinct()
        for end, which in (("dst", "in"), ("src", "out")):
            if side in ("all", which):
                edges = edges.join(gone.withColumnRenamed("id", end), end, "left_anti").select(*self.edges.columns)
        return Graph(edges, self.given)


def ids_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def proper(edges: DataFrame) -> DataFrame:
    """Without self-loops, as every reader leaves edges; parallel edges stay."""
    return edges.where("src <> dst")


def reverse(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)


def symmetrise(edges: DataFrame, distinct: bool = True) -> DataFrame:
    """Each edge in both directions; distinct makes one of parallel and reciprocal edges (without attributes)."""
    if distinct:
        pairs = edges.select("src", "dst")
        return pairs.union(reverse(pairs)).distinct()
    return edges.union(reverse(edges).select(*edges.columns))


def canonical(edges: DataFrame) -> DataFrame:
    """One row (a, b) with a < b for each pair of neighbours."""
    return proper(edges).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def dedupe(edges: DataFrame, order: Column | None = None) -> DataFrame:
    """One of parallel edges: the first by `order` (ascending), else any."""
    if order is None:
        return edges.dropDuplicates(["src", "dst"])
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    best = edges.groupBy("src", "dst").agg(F.min_by(F.struct(*rest), order).alias("best")) if rest else edges.select("src", "dst").distinct()
    return best.select("src", "dst", *[F.col("best")[c].alias(c) for c in rest])


def degrees(edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree and degree (their sum) with multiplicity, for every id that has an edge: one shuffle of partial counts."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o")))).alias("e"))
    counted = ends.groupBy(F.col("e.id").alias("id")).agg(F.sum(1 - F.col("e.o")).alias("in_degree"), F.sum("e.o").alias("out_degree"))
    return counted.withColumn("degree", F.col("in_degree") + F.col("out_degree"))
