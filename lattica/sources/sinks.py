"""Writers of graphs, matrices and dictionaries. Text output goes through Spark, a file per task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_edges(edges: DataFrame, path: str, sep: str = "\t") -> None:
    """Lines `src dst [values]`."""
    edges.select(F.concat_ws(sep, *edges.columns).alias("value")).write.mode("overwrite").text(path)


def adjacency(edges: DataFrame) -> DataFrame:
    """id, n and targets (ascending) of every vertex with out-edges."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("dst")).alias("targets"))


def write_adjacency(edges: DataFrame, path: str) -> None:
    """Lines `from n to1 ... ton`."""
    rows = adjacency(edges).select(F.concat_ws(" ", F.col("id").cast("string"), F.col("n").cast("string"), F.array_join(F.col("targets").cast("array<string>"), " ")).alias("value"))
    rows.write.mode("overwrite").text(path)


def write_cassovary(edges: DataFrame, path: str) -> None:
    """A line `from n`, then a line for each target; a vertex's lines stay in one file."""
    rows = adjacency(edges).select(F.explode(F.concat(F.array(F.concat_ws(" ", "id", "n")), F.col("targets").cast("array<string>"))).alias("value"))
    rows.write.mode("overwrite").text(path)


def write_matrix(rows: DataFrame, path: str, height: int, width: int) -> None:
    """row, col (from 0), value as Matrix Market coordinates: a banner file and the entries, ids from 1."""
    spark, n = rows.sparkSession, rows.count()
    spark.createDataFrame([("%%MatrixMarket matrix coordinate real general",), (f"{height} {width} {n}",)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    rows.select(F.concat_ws(" ", F.col("row") + 1, F.col("col") + 1, "value").alias("value")).write.mode("overwrite").text(f"{path}/entries")


def write_dense(rows: DataFrame, path: str, height: int, width: int) -> None:
    """row, col (from 0), value as a dense Matrix Market file by columns: missing entries are 0. One file, as the format asks for one order."""
    spark = rows.sparkSession
    cells = spark.range(height * width).select((F.col("id") % height).alias("row"), F.expr(f"id div {height}").alias("col"), (F.col("id") + 2).alias("at"))
    values = cells.join(rows, ["row", "col"], "left").select("at", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).cast("string").alias("value"))
    head = spark.createDataFrame([(0, "%%MatrixMarket matrix array real general"), (1, f"{height} {width}")], "at long, value string")
    head.union(values).repartition(1).sortWithinPartitions("at").select("value").write.mode("overwrite").text(path)


def write_vector(rows: DataFrame, path: str, length: int) -> None:
    """id, value as one column."""
    write_matrix(rows.select(F.col("id").alias("row"), F.lit(0).alias("col"), "value"), path, length, 1)


def write_scalar(spark, value: float, path: str) -> None:
    """One number as a matrix of one entry."""
    write_matrix(spark.createDataFrame([(0, 0, float(value))], "row long, col long, value double"), path, 1, 1)


def write_table(df: DataFrame, path: str) -> None:
    """Vertex values, factors, dictionaries: Parquet keeps their names and types."""
    df.write.mode("overwrite").parquet(path)
