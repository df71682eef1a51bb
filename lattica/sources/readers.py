"""Readers of edge lists, adjacency lists, rating matrices, feature rows and text records.

All read text with Spark, drop comment and blank lines where the format has them, drop self-loops of graphs, and return
typed columns. A value that cannot be parsed is null, or `default` where one is given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.functions.numeric import draw

_GAP = r"[\t, ]+"


def _lines(spark: SparkSession, path: str, comments: str = "#%") -> DataFrame:
    rows = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"\r$", "")).alias("line"))
    return rows.where((F.col("line") != "") & ~F.col("line").rlike(f"^[{comments}]"))


def _numbered(spark: SparkSession, path: str, comments: str = "#%") -> DataFrame:
    """file, number (ascending in file order), line. monotonically_increasing_id follows the order of splits in a file."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("number"), F.trim(F.regexp_replace("value", r"\r$", "")).alias("line"))
    return rows.where((F.col("line") != "") & ~F.col("line").rlike(f"^[{comments}]"))


def _cast(token: Column, kind: str) -> Column:
    """One token as a value: booleans are 1 or not, char is the first character, pairs hold the token twice."""
    if kind == "boolean":
        return token == "1"
    if kind == "char":
        return F.substring(token, 1, 1)
    if kind == "pair":
        return F.struct(token.try_cast("double").alias("left"), token.try_cast("double").alias("right"))
    return token.try_cast(kind)


def edge_list(spark: SparkSession, path: str, value_type: str | None = "double", default: object = None) -> DataFrame:
    """Lines `from to [value]`, separated by blanks, tabs or commas."""
    part = F.split("line", _GAP)
    columns = [F.get(part, F.lit(0)).try_cast("long").alias("src"), F.get(part, F.lit(1)).try_cast("long").alias("dst")]
    if value_type:
        columns.append(F.coalesce(_cast(F.get(part, F.lit(2)), value_type), F.lit(default)).alias("value") if default is not None else _cast(F.get(part, F.lit(2)), value_type).alias("value"))
    return _lines(spark, path).select(*columns).where("src is not null and dst is not null and src <> dst")


def multi_value_edge_list(spark: SparkSession, path: str, value_type: str = "int") -> DataFrame:
    """Lines `from to v1:v2:...`; values is an array, empty if there is no third token."""
    part = F.split("line", _GAP)
    values = F.when(F.get(part, F.lit(2)).isNull(), F.array().cast(f"array<{value_type}>")).otherwise(F.transform(F.split(F.get(part, F.lit(2)), ":"), lambda x: x.try_cast(value_type)))
    rows = _lines(spark, path).select(F.get(part, F.lit(0)).try_cast("long").alias("src"), F.get(part, F.lit(1)).try_cast("long").alias("dst"), values.alias("values"))
    return rows.where("src is not null and dst is not null and src <> dst")


def adjacency_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines `from n to1 ... ton`. A wrong n does not matter: all that follows it counts."""
    part = F.transform(F.split("line", _GAP), lambda x: x.try_cast("long"))
    rows = _lines(spark, path).select(part.alias("p")).select(F.get("p", F.lit(0)).alias("src"), F.explode(F.slice("p", 3, F.greatest(F.size("p") - 2, F.lit(0)))).alias("dst"))
    return rows.where("src <> dst")


def adjacency_mismatches(spark: SparkSession, path: str) -> int:
    """Lines of an adjacency list whose n is not the number of targets."""
    part = F.split("line", _GAP)
    return _lines(spark, path).where(F.get(part, F.lit(1)).try_cast("long") != F.size(part) - 2).count()


def cassovary(spark: SparkSession, path: str) -> DataFrame:
    """Files of blocks: a line `from n`, then n lines with one target each. Blocks do not span files."""
    head = F.when(F.size(F.split("line", _GAP)) > 1, F.get(F.split("line", _GAP), F.lit(0)).try_cast("long"))
    rows = _numbered(spark, path).withColumn("head", head)
    rows = rows.withColumn("src", F.last("head", ignorenulls=True).over(Window.partitionBy("file").orderBy("number")))
    return rows.where("head is null").select("src", F.col("line").try_cast("long").alias("dst")).where("src is not null and dst is not null and src <> dst")


def metis(spark: SparkSession, path: str, zero_based: bool = False) -> DataFrame:
    """Header `n m`, then line i holds the neighbours of vertex i, counted from 1. Each edge is kept once, as u <= v.

    Ids start at 0 in the result; zero_based says that the file's own neighbour numbers do too. Weights are an error.
    """
    rows = _numbered(spark, path, comments="%")
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("file").orderBy("number")))
    header = rows.where("at = 1").select(F.split("line", _GAP).alias("h")).first()
    if header is not None and len(header.h) > 2 and header.h[2].strip("0"):
        raise ValueError("weighted METIS files are not supported")
    u = (F.col("at") - 2).cast("long")
    edges = rows.where("at > 1").select(u.alias("src"), F.explode(F.split("line", _GAP)).alias("t")).select("src", (F.col("t").try_cast("long") - (0 if zero_based else 1)).alias("dst"))
    return edges.where("dst is not null and src < dst")


def _binary(value: str | None):
    kinds = {None: None, "float": "<f4", "double": "<f8", "int": "<i4", "long": "<i8"}
    fields = [("src", "<u4"), ("dst", "<u4")] + ([("value", kinds[value])] if value else [])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for content in frame.column(0):
                rows = np.frombuffer(content.as_py(), dtype=np.dtype(fields))
                rows = rows[rows["src"] != rows["dst"]]
                columns = [pa.array(rows["src"].astype(np.int64)), pa.array(rows["dst"].astype(np.int64))]
                if value:
                    columns.append(pa.array(np.ascontiguousarray(rows["value"])))
                yield pa.RecordBatch.from_arrays(columns, [f[0] for f in fields])

    return run


def binary_edge_list(spark: SparkSession, path: str, value_type: str | None = None) -> DataFrame:
    """Files of little-endian (u32, u32[, value]); one task reads a file, so write many."""
    schema = "src long, dst long" + (f", value {value_type}" if value_type else "")
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_binary(value_type), schema)


FORMATS = {"edgelist": edge_list, "multivalueedgelist": multi_value_edge_list, "adjlist": adjacency_list, "cassovary": cassovary, "metis": metis, "binedgelist": binary_edge_list}


def read_graph(spark: SparkSession, path: str, format: str = "edgelist", max_vertex: int | None = None, **options) -> DataFrame:
    """Edges in any of FORMATS; with max_vertex those alone whose ends do not exceed it."""
    if format not in FORMATS:
        raise ValueError(f"unknown format {format!r}; known: {', '.join(FORMATS)}")
    edges = FORMATS[format](spark, path, **options)
    return edges if max_vertex is None else edges.where((F.col("src") <= max_vertex) & (F.col("dst") <= max_vertex))


def converted(spark: SparkSession, path: str, target: str, format: str = "edgelist", **options) -> DataFrame:
    """The edges of path as Parquet under target: written if it is not there or older than the newest input file."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    source, kept = hadoop.Path(path), hadoop.Path(f"{target}/_SUCCESS")
    files = source.getFileSystem(conf)
    newest = max((s.getModificationTime() for s in files.globStatus(source) or []), default=0)
    there = kept.getFileSystem(conf)
    if not there.exists(kept) or there.getFileStatus(kept).getModificationTime() < newest:
        read_graph(spark, path, format, **options).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


# rating matrices


def matrix_size(spark: SparkSession, path: str) -> tuple[int, int, int] | None:
    """Rows, columns and entries from a Matrix Market size line, or from the side file `path:info`; None if neither is there. Of several files, the one with the banner has the size line."""
    for place in (path, f"{path}:info"):
        try:
            lines = spark.read.text(place).select("value", F.col("_metadata.file_path").alias("file"))
            head = lines.where(F.lower("value").startswith("%%matrixmarket")).first()
        except Exception:  # no such side file
            continue
        lines = lines if head is None else lines.where(F.col("file") == head.file)
        line = lines.where(~F.col("value").startswith("%") & (F.trim("value") != "")).first()
        tokens = line.value.split() if line else []
        if len(tokens) == 3 and all(t.isdigit() for t in tokens):
            return tuple(map(int, tokens))
    return None


def _coordinates(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a Matrix Market file as arrays, without banner, comments and the size line (the first that is left in a file with a banner)."""
    every = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("number"), F.trim("value").alias("line")).where("line <> ''")
    comment = F.col("line").startswith("%")
    first = every.groupBy("file").agg(F.min(F.when(~comment, F.col("number"))).alias("number"), F.max(F.lower("line").startswith("%%matrixmarket")).alias("banner"))
    rows = every.where(~comment).join(F.broadcast(first.where("banner").drop("banner")), ["file", "number"], "left_anti")  # a row per file
    return rows.select(F.split("line", r"\s+").alias("p"), "number")


def ratings(spark: SparkSession, path: str, fourth: str | None = None, minval: float | None = None, maxval: float | None = None, allow_zeros: bool = False) -> DataFrame:
    """Matrix Market coordinates as user, item, rating (ids from 1), or with `fourth` ("time" or "weight") before the rating.

    A missing rating is 1. Zero ratings (unless allowed) and ratings outside the bounds are errors.
    """
    names = ["user", "item", *([fourth] if fourth else []), "rating"]
    at = lambda k, kind: F.get("p", F.lit(k)).try_cast(kind)
    columns = [at(0, "long").alias("user"), at(1, "long").alias("item")]
    if fourth:
        columns.append(at(2, "double").alias(fourth))
    columns.append(F.coalesce(at(len(names) - 1, "double"), F.lit(1.0)).alias("rating"))
    rating = F.col("rating")
    wrong = (rating == 0) if not allow_zeros else F.lit(False)
    wrong = wrong | (rating < minval if minval is not None else F.lit(False)) | (rating > maxval if maxval is not None else F.lit(False))
    return _coordinates(spark, path).select(*columns).withColumn("rating", F.when(wrong, F.raise_error(F.lit("rating out of range"))).otherwise(rating))


def similarity(spark: SparkSession, path: str) -> DataFrame:
    """item_i, item_j, sim of a square matrix; pairs of an item with itself are ignored."""
    return ratings(spark, path, allow_zeros=True).select(F.col("user").alias("item_i"), F.col("item").alias("item_j"), F.col("rating").alias("sim")).where("item_i <> item_j")


def ratings_and_similarity(spark: SparkSession, ratings_path: str, similarity_path: str) -> tuple[DataFrame, DataFrame]:
    """Ratings and the similarities of their items, those alone whose items both have been rated."""
    rated, pairs = ratings(spark, ratings_path), similarity(spark, similarity_path)
    known = rated.select("item").distinct()
    for side in ("item_i", "item_j"):
        pairs = pairs.join(known.withColumnRenamed("item", side), side, "left_semi")
    return rated, pairs.select("item_i", "item_j", "sim")


def in_range(rows: DataFrame, column: str, start: int, end: int) -> DataFrame:
    """Rows whose column is in [start, end)."""
    return rows.where((F.col(column) >= start) & (F.col(column) < end))


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """A dense (array) or sparse (coordinate) Matrix Market file as row, col (from 0), value; dense ones go by columns."""
    banner = (spark.read.text(path).where(F.lower("value").startswith("%%matrixmarket")).first() or [""])[0].lower()  # of several files one has it
    if "coordinate" in banner:
        return _coordinates(spark, path).select((F.get("p", F.lit(0)).cast("long") - 1).alias("row"), (F.get("p", F.lit(1)).cast("long") - 1).alias("col"), F.get("p", F.lit(2)).cast("double").alias("value"))
    size = spark.read.text(path).where(~F.col("value").startswith("%")).first()
    height = int(size.value.split()[0]) if size else 1
    rows = _coordinates(spark, path).select("number", F.posexplode("p").alias("k", "t")).withColumn("at", F.row_number().over(Window.orderBy("number", "k")) - 1)
    return rows.select((F.col("at") % height).cast("long").alias("row"), F.floor(F.col("at") / height).cast("long").alias("col"), F.col("t").cast("double").alias("value"))


def feature_rows(spark: SparkSession, path: str, from_pos: int = 0, to_pos: int = 1, val_pos: int = 2, features: tuple[int, ...] = (), real_features: tuple[int, ...] = (), sep: str = ",", header: bool = False, limit: int | None = None) -> DataFrame:
    """Delimited rows by column position: from, to, val, f<k> for categorical and r<k> for real columns."""
    rows = spark.read.option("sep", sep).option("header", header).csv(path)
    names = rows.columns
    out = rows.select(
        F.col(f"`{names[from_pos]}`").alias("from"), F.col(f"`{names[to_pos]}`").alias("to"), F.col(f"`{names[val_pos]}`").try_cast("double").alias("val"),
        *[F.col(f"`{names[k]}`").alias(f"f{k}") for k in features], *[F.col(f"`{names[k]}`").try_cast("double").alias(f"r{k}") for k in real_features],
    )
    return out if limit is None else out.limit(limit)


def sparse_rows(spark: SparkSession, path: str, keys_only: bool = False) -> DataFrame:
    """Lines `from to val key:value ...` (or `key ...`) as from, to, val, features map<string,double>."""
    part = F.split("line", r"\s+")
    tail = F.slice(part, 4, F.greatest(F.size(part) - 3, F.lit(0)))
    pair = lambda x: F.struct(F.element_at(F.split(x, ":"), 1).alias("k"), F.lit(1.0).alias("v") if keys_only else F.coalesce(F.get(F.split(x, ":"), F.lit(1)).try_cast("double"), F.lit(1.0)).alias("v"))
    entries = F.array_distinct(F.transform(tail, pair))
    return _lines(spark, path).select(F.get(part, F.lit(0)).alias("from"), F.get(part, F.lit(1)).alias("to"), F.get(part, F.lit(2)).try_cast("double").alias("val"), F.map_from_entries(entries).alias("features"))


def node_features(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Lines `node feature ...` as node, features array<string>."""
    part = F.split("line", sep)
    return _lines(spark, path).select(F.get(part, F.lit(0)).alias("node"), F.slice(part, 2, F.greatest(F.size(part) - 1, F.lit(0))).alias("features"))


def degree_of(degrees: DataFrame, vertex: int) -> DataFrame:
    """One vertex's row of a degree table beside the table's totals."""
    totals = degrees.agg(F.sum("in_degree").alias("total_in"), F.sum("out_degree").alias("total_out"), F.count("*").alias("n_vertices"))
    return totals.join(F.broadcast(degrees.where(F.col("id") == vertex)), F.lit(True), "left")  # one row and one row


# splits


def fold(rows: DataFrame, keys: list[str], k: int, which: int, held_out: bool = False) -> DataFrame:
    """k-fold split by a hash of the keys: the rows outside fold `which`, or those in it."""
    inside = F.floor(draw("fold", *keys) * k) == which
    return rows.where(inside if held_out else ~inside)


def given_n(rows: DataFrame, given: int, least: int = 0, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Train and test: `given` random items of each user for training; users with fewer than `least` rows go."""
    order = Window.partitionBy("user").orderBy(draw(seed, "user", "item"), "item")
    ranked = rows.withColumn("rank", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("user"))).where(F.col("n") >= least)
    return ranked.where(F.col("rank") <= given).drop("rank", "n"), ranked.where(F.col("rank") > given).drop("rank", "n")
