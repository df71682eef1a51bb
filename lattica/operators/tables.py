"""Counts, dictionaries, information measures and top-k over tables: the ETL programs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.functions.text import epoch, has_url, ipv4, mentions, profile_name, tokens

from .ranking import number


def value_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys and n, how many rows have them."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def group_sums(rows: DataFrame, value: str) -> DataFrame:
    """from, to and total of a column; rows whose from or to is 0 do not count."""
    return rows.where((F.col("from") != 0) & (F.col("to") != 0)).groupBy("from", "to").agg(F.sum(value).alias("total"))


def information(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row: h_x, h_y, h_xy (entropies in bits) and mutual (information) of two columns; rows with nulls do not count."""
    joint = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n"))
    total = joint.agg(F.sum("n").alias("total"))
    entropy = lambda counts: F.sum(-(F.col("n") / F.col("total")) * F.log2(F.col("n") / F.col("total"))).alias(counts)
    one = F.broadcast(total)  # one row
    parts = [joint.groupBy(k).agg(F.sum("n").alias("n")).join(one, F.lit(True)).agg(entropy(f"h_{k}")) for k in ("x", "y")]
    h = joint.join(one, F.lit(True)).agg(entropy("h_xy"))
    return parts[0].join(F.broadcast(parts[1]), F.lit(True)).join(F.broadcast(h), F.lit(True)).withColumn("mutual", F.col("h_x") + F.col("h_y") - F.col("h_xy"))


def dictionary(rows: DataFrame, column: str, first: int = 0) -> DataFrame:
    """value and id: consecutive numbers of the distinct values in ascending order, nulls left out."""
    values = rows.select(F.col(column).alias("value")).where("value is not null").distinct()
    return number(values, ["value"]).select("value", (F.col("number") + first).alias("id"))


def encode(rows: DataFrame, column: str, known: DataFrame, to: str, missing: str = "drop") -> DataFrame:
    """Adds the id of a column's value; values that are not known drop their rows, or get -1 (missing="mark")."""
    joined = rows.join(known.select(F.col("value").alias(column), F.col("id").alias(to)), column, "inner" if missing == "drop" else "left")
    return joined if missing == "drop" else joined.withColumn(to, F.coalesce(to, F.lit(-1)))


def consecutive(rows: DataFrame, first: int = 1, shared: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """from and to replaced by consecutive ids, of one dictionary or of two; and the dictionaries."""
    if shared:
        both = rows.select(F.col("from").alias("v")).union(rows.select("to"))
        a = b = dictionary(both, "v", first)
    else:
        a, b = dictionary(rows, "from", first), dictionary(rows, "to", first)
    out = encode(encode(rows, "from", a, "from_id"), "to", b, "to_id")
    return out.drop("from", "to").withColumnsRenamed({"from_id": "from", "to_id": "to"}), a, b


def token_counts(lines: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    """line, token, n of a table line, text: bags of words, counts within least to most."""
    counted = lines.select("line", F.explode(tokens(F.col("text"))).alias("token")).groupBy("line", "token").agg(F.count("*").alias("n"))
    counted = counted.where(F.col("n") >= least)
    return counted if most is None else counted.where(F.col("n") <= most)


def top_k(rows: DataFrame, key: str, order: list, k: int) -> DataFrame:
    """The first k rows of each key by `order`, with rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def top_k_lists(rows: DataFrame, k: int, arrival: str) -> DataFrame:
    """from, ids, vals: the first k (to, value) of each from, in order of arrival."""
    kept = top_k(rows, "from", [arrival], k)
    listed = kept.groupBy("from").agg(F.array_sort(F.collect_list(F.struct("rank", "to", "value"))).alias("l"))
    return listed.select("from", F.transform("l", lambda x: x["to"]).alias("ids"), F.transform("l", lambda x: x["value"]).alias("vals"))


def sorted_pairs(rows: DataFrame) -> DataFrame:
    """Pairs by first id, second id and falling similarity."""
    return rows.orderBy("item_i", "item_j", F.desc("sim"))


def cumulative(rows: DataFrame, order: str, value: str, by: list[str]) -> DataFrame:
    """Running sums within groups."""
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("cumulative", F.sum(value).over(upto))


def intersect_neighbours(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, common: ascending out-neighbours that both ends of each pair have."""
    a = edges.select(F.col("src").alias("a"), F.col("dst").alias("n")).distinct()
    b = edges.select(F.col("src").alias("b"), F.col("dst").alias("n")).distinct()
    return pairs.join(a, "a").join(b, ["b", "n"]).groupBy("a", "b").agg(F.sort_array(F.collect_set("n")).alias("common"))


# records


def call_records(lines: DataFrame) -> DataFrame:
    """from, to, time, duration of lines `date time<tab>from<tab>to<tab>d1<tab>d2`; duration is d2. Broken lines go."""
    part = F.split("text", "\t")
    out = lines.select(F.get(part, F.lit(1)).try_cast("long").alias("from"), F.get(part, F.lit(2)).try_cast("long").alias("to"), epoch(F.get(part, F.lit(0))).alias("time"), F.get(part, F.lit(4)).try_cast("long").alias("duration"))
    return out.dropna()


def tweet_links(records: DataFrame) -> DataFrame:
    """from, to, time, type of records ts, user (profile address), text: a row per mention (1) and retweet (2)."""
    user = profile_name(F.col("user"))
    rows = records.select(user.alias("from"), epoch(F.col("ts")).alias("time"), F.explode(mentions(F.col("text"))).alias("m"))
    return rows.where("`from` is not null").select("from", F.col("m.name").alias("to"), "time", F.col("m.type").alias("type"))


def tweets_per_user(records: DataFrame) -> DataFrame:
    rows = records.select(profile_name(F.col("user")).alias("user"), has_url(F.col("text")).cast("long").alias("url")).where("user is not null")
    return rows.groupBy("user").agg(F.count("*").alias("n"), F.sum("url").alias("with_url"))


def tweet_records(spark: SparkSession, path: str) -> DataFrame:
    """Lines `T time`, `U address`, `W text` as records ts, user, text: a T opens a record of its file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"), "value").where(F.col("value").rlike("^[TUW]\\s"))
    opened = lines.withColumn("record", F.sum(F.col("value").startswith("T").cast("long")).over(Window.partitionBy("file").orderBy("n")))
    kind, rest = F.substring("value", 1, 1), F.trim(F.substring("value", 2, 1_000_000))
    return opened.groupBy("file", "record").agg(*[F.max(F.when(kind == k, rest)).alias(name) for k, name in (("T", "ts"), ("U", "user"), ("W", "text"))]).select("ts", "user", "text")


def address_pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows src, dst, attr with both addresses replaced by consecutive ids in ascending order of address; and address, id."""
    valid = rows.withColumn("a", ipv4(F.col("src"))).withColumn("b", ipv4(F.col("dst"))).where("a is not null and b is not null")
    known = dictionary(valid.select(F.col("a").alias("v")).union(valid.select("b")), "v")
    out = encode(encode(valid, "a", known, "src_id"), "b", known, "dst_id")
    return out.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "attr"), known


def adjacency_of_names(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines `user n item ...` of names as edges of consecutive ids, and the dictionary both ends share."""
    part = F.split("text", r"\s+")
    pairs = lines.select(F.get(part, F.lit(0)).alias("from"), F.explode(F.slice(part, 3, F.greatest(F.size(part) - 2, F.lit(0)))).alias("to"))
    edges, known, _ = consecutive(pairs, 0, shared=True)
    return edges.select(F.col("from").alias("src"), F.col("to").alias("dst")), known
