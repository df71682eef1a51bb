"""PageRank, random walks and top vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.graph import ids_of
from lattica.plans.store import stored
from lattica.plans.supersteps import Context, iterate, sum_of_changes

#: Probability of a jump, and of following an edge.
JUMP, FOLLOW = 0.15, 0.85


def pagerank(edges: DataFrame, supersteps: int = 3, variant: str = "plain", vertices: DataFrame | None = None, tolerance: float | None = None, start: DataFrame | None = None, log: list[dict] | None = None) -> DataFrame:
    """id and rank after synchronous supersteps (a run of n iterations that counts its first pass has n - 1).

    plain: ranks start at 0.15 and become 0.15 + 0.85 * sum(rank / out-degree), where the first superstep receives
    1 / out-degree. normalized: ranks start at 1 and become 0.15 / N + 0.85 * sum. Mass of vertices without out-edges
    is lost in either. Parallel edges count as often as they occur. With a tolerance the loop ends when no rank moves
    further; start (id, rank) resumes an earlier run; log, a list, gets each superstep's sum of changes. Edges are joined with ranks already divided by out-degree, and the
    same partitioning by src serves every superstep.
    """
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    ids = (vertices.select("id") if vertices is not None else ids_of(edges)).join(out, "id", "left")
    base = stored(ids, "ids")
    n = base.count() if variant == "normalized" else 1
    jump = JUMP / n if n else JUMP
    if start is not None:
        state = base.join(start.select("id", "rank"), "id", "left").withColumn("rank", F.coalesce("rank", F.lit(JUMP if variant == "plain" else 1.0)))
    else:
        state = base.withColumn("rank", F.lit(1.0))

    def step(now: DataFrame, _: Context) -> DataFrame:
        sent = now.where("out_degree is not null").select(F.col("id").alias("src"), (F.col("rank") / F.col("out_degree")).alias("part"))
        got = edges.select("src", "dst").join(sent, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("part").alias("got"))
        return base.join(got, "id", "left").select("id", "out_degree", (jump + FOLLOW * F.coalesce("got", F.lit(0.0))).alias("rank"))

    def settled(old: DataFrame, new: DataFrame) -> bool:
        moved = new.join(old.select("id", F.col("rank").alias("old")), "id").where(F.abs(F.col("rank") - F.col("old")) > tolerance)
        return moved.limit(1).count() == 0

    if supersteps == 0 and start is None and variant == "plain":
        return state.select("id", F.lit(JUMP).alias("rank"))
    return iterate(state, step, supersteps, settled if tolerance is not None else None, every=2, measure=sum_of_changes("rank") if log is not None else None, log=log).select("id", "rank")


def top(vertices: DataFrame, value: str, n: int = 20) -> DataFrame:
    """The n rows with the largest value, ties to the smaller id: a top-k per task, then of those."""
    return vertices.orderBy(F.desc(value), "id").limit(n)


def random_walks(edges: DataFrame, walks: int = 100, every: int = 50, steps: int = 4, seed: int = 1) -> DataFrame:
    """id and visits: from each vertex whose id is divisible by `every`, walkers move along uniformly random out-edges.

    A walker without an out-edge stops. Draws are hashes of seed, walker and step, so runs agree.
    """
    numbered = edges.select("src", "dst").distinct().groupBy("src").agg(F.count("*").alias("n"))
    ranked = stored(_numbered_targets(edges), "targets")
    degree = stored(numbered, "degrees")
    starts = ids_of(edges).where(F.col("id") % every == 0)
    walkers = starts.select(F.col("id").alias("origin"), F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("walk"), F.col("id").alias("at"))
    visits = None
    for k in range(steps):
        draw = F.pmod(F.xxhash64("origin", "walk", F.lit(k), F.lit(seed)), F.col("n"))
        moved = walkers.join(degree.withColumnRenamed("src", "at"), "at").withColumn("turn", draw)
        walkers = stored(moved.join(ranked.withColumnRenamed("src", "at"), ["at", "turn"]).select("origin", "walk", F.col("dst").alias("at")), "walkers")
        seen = walkers.groupBy(F.col("at").alias("id")).agg(F.count("*").alias("visits"))
        visits = seen if visits is None else visits.union(seen)
    return visits.groupBy("id").agg(F.sum("visits").alias("visits"))


def _numbered_targets(edges: DataFrame) -> DataFrame:
    """src, turn (from 0), dst: the distinct out-edges of each vertex in ascending order."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("src").orderBy("dst")
    return edges.select("src", "dst").distinct().withColumn("turn", (F.row_number().over(order) - 1).cast("long"))


def order_by_degree(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with ids replaced by ranks of ascending (degree, id), from 0, and the map (id, new_id)."""
    from lattica.graph import degrees

    mapping = stored(number(degrees(edges).select("id", "degree"), ["degree", "id"]).select("id", F.col("number").alias("new_id")), "mapping")
    return translate(edges, mapping), mapping


def translate(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with both ends mapped by (id, new_id); ends without an entry lose their edges."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    out = edges.join(mapping.select(F.col("id").alias("src"), F.col("new_id").alias("new_src")), "src")
    out = out.join(mapping.select(F.col("id").alias("dst"), F.col("new_id").alias("new_dst")), "dst")
    return out.select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), *rest)


def number(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with `number`, 0 and up in ascending order of `by`, without gathering them in one task.

    Rows are range-partitioned; counts of the partitions, one row each, give the offsets.
    """
    from pyspark.sql.window import Window

    ranged = rows.repartitionByRange(*by).withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "ranged")
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    inner = F.row_number().over(Window.partitionBy("part").orderBy(*by))
    return ranged.withColumn("inner", inner).join(F.broadcast(before), "part").withColumn("number", F.col("before") + F.col("inner") - 1).drop("part", "inner", "before")  # a row per partition
