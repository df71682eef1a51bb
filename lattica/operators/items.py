"""Item-item similarity, recommendation from similarity and from factors, and baselines.

ratings: user, item (whole numbers), rating. Pair sums are the blocked product of the users by items matrix with itself:
the cost is the sum of squares of users' counts; `most_items` leaves users above it out if a caller wants that (off by default).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.functions.numeric import clamp, log_likelihood
from lattica.plans.store import stored

LIST = 1000  # items of one user that meet others in one row
PAIRS = 12_000_000  # rated pairs in one task, about
RATERS = 200_000  # raters of an item in one task
_ENTRIES = 2_000_000  # rated pairs that a task holds at once, about

Values = dict[str, np.ndarray]
Sum = tuple[str, Callable[[Values, Values], np.ndarray]]


def _pairs(rows: DataFrame, own: list[str], other: list[str], sums: dict[str, Sum], most_items: int | None) -> DataFrame:
    """item_i > item_j, common (how many users rated both) and sums of every pair that a user has rated.

    rows: user, item, `raters` of the item, and columns. sums: name to kind (sum, mean, max, first or open, see _reduced)
    and a function of the columns `own` of the rows of item_i and `other` of those of item_j.

    A user's row of an item takes the list of the user's smaller items to the task that sums the item's pairs, so a pair
    goes through one shuffle, as one entry of a list, and nothing is joined to pairs later. Tasks hold ranges of items, so
    that where users keep to near ids, compression finds their list again in the rows of other items. Users of more than LIST
    items are cut into blocks, items of more than RATERS raters into pieces by their partners; tasks number by the pairs.
    """
    spark = rows.sparkSession
    columns = ["item", *dict.fromkeys(c for c in ["raters", *own, *other] if c != "d")]
    sized = F.sort_array(F.collect_list(F.struct(*columns)))
    # a null item is a rating of its user, but in no pair; its struct sorts first
    lists = rows.where("user is not null").groupBy("user").agg(sized.alias("l"))
    if most_items is not None:
        lists = lists.where(F.size("l") <= most_items)
    lists = stored(lists.select("user", F.size("l").cast("long").alias("d"), F.filter("l", lambda x: x["item"].isNotNull()).alias("l")), "lists")
    pairs, longest, most, low, high = lists.agg(F.sum(F.col("d") * (F.col("d") - 1) / 2), F.max("d"), F.max(F.array_max("l.raters")), F.min(F.array_min("l.item")), F.max(F.array_max("l.item"))).first()
    pairs, default = int(pairs or 0), int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, -(-pairs // PAIRS), min(default, -(-pairs // 100_000)))
    kind = "int" if low is not None and -(1 << 31) <= low and high < 1 << 31 else "long"
    taken = ["d", *[F.col(f"l.{c}").cast(f"array<{kind}>").alias(c) if c == "item" else F.col(f"l.{c}").alias(c) for c in columns]]
    blocks = lists.repartition(n, "user").select(*taken)
    flag = F.lit(True)
    if longest is not None and longest > LIST:  # every block of a user's items meets each block up to it
        cut = lambda names, at: [F.slice(c, F.col(at) * LIST + 1, LIST).alias(f"{c}_{at}") for c in names]
        blocks = blocks.withColumn("a", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size("item") / LIST).cast("int") - 1)))).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("a"))))
        blocks = blocks.select("d", "a", "b", *cut(columns, "a"), *cut(["item", *other], "b")).repartition(n)
        flag = F.col("a") == F.col("b")
    else:
        blocks = blocks.select("d", *[F.col(c).alias(f"{c}_a") for c in columns], *[F.col(c).alias(f"{c}_b") for c in ["item", *other]])
    met = blocks.select("*", F.posexplode("item_a").alias("at", "item_i"))
    upto = lambda c: F.when(flag, F.slice(F.col(f"{c}_b"), F.lit(1), F.col("at"))).otherwise(F.col(f"{c}_b"))
    own_now = [c for c in own if c != "d"]
    met = met.select(
        "item_i", F.lit(0).alias("piece"), F.get("raters_a", F.col("at")).alias("raters"), *(["d"] if "d" in own else []),
        *[F.get(f"{c}_a", F.col("at")).alias(f"own_{c}") for c in own_now], upto("item").alias("items"), *[upto(c).alias(f"other_{c}") for c in other],
    )
    if most is not None and most > RATERS:
        names = ["items", *[f"other_{c}" for c in other]]
        met = met.withColumn("pieces", F.ceil(F.col("raters") / RATERS).cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        met = met.withColumn("z", F.when(F.col("pieces") == 1, F.arrays_zip(*names)).otherwise(F.filter(F.arrays_zip(*names), lambda x: F.pmod(x["items"], F.col("pieces")) == F.col("piece"))))
        met = met.select(*[F.col(f"z.{c}").alias(c) if c in names else c for c in met.columns if c not in ("pieces", "z")])
    met = met.drop("raters").repartitionByRange(n, "item_i", "piece").sortWithinPartitions("item_i", "piece")
    schema = "item_i long, item_j long, common long" + "".join(f", {name} double" for name in sums)
    return met.mapInArrow(_reduced(own, other, sums), schema)


def _reduced(own: list[str], other: list[str], sums: dict[str, Sum]):
    """Sums the pairs of rows sorted by item and piece, some _ENTRIES at a time but groups whole.

    A null rating makes no part of sum, mean or max; first is a value that all rows of the pair share. open is the largest
    value that an item has from users who did not rate the other: values go by falling rank, so the users of the pair with
    ranks 0, 1, ... leave the one that `next` holds, or `top`.
    """

    def flat(frame: pa.Table) -> tuple:
        items = frame.column("items").combine_chunks()
        items = items.chunk(0) if isinstance(items, pa.ChunkedArray) else items
        n = pc.list_value_length(items).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.repeat(np.arange(len(n)), n)
        i, j = frame.column("item_i").to_numpy()[at].astype(np.int64), items.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        piece = frame.column("piece").to_numpy()[at]
        mine = {c: frame.column(c if c == "d" else f"own_{c}").combine_chunks() for c in own}
        theirs = {c: frame.column(f"other_{c}").combine_chunks() for c in other}
        theirs = {c: (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x).flatten() for c, x in theirs.items()}
        null = np.zeros(len(j), bool)
        if "rating" in mine and mine["rating"].null_count:
            null |= pc.is_null(mine["rating"]).to_numpy(zero_copy_only=False)[at]
        if "rating" in theirs and theirs["rating"].null_count:
            null |= pc.is_null(theirs["rating"]).to_numpy(zero_copy_only=False)
        return i, j, piece, {c: x.to_numpy(zero_copy_only=False).astype(float)[at] for c, x in mine.items()}, {c: x.to_numpy(zero_copy_only=False).astype(float) for c, x in theirs.items()}, null

    def summed(frame: pa.Table) -> Iterator[pa.RecordBatch]:
        i, j, piece, mine, theirs, null = flat(frame)
        if not len(j):
            return
        group = np.concatenate([[0], np.cumsum((i[1:] != i[:-1]) | (piece[1:] != piece[:-1]))])
        low = j.min()
        width = int(j.max() - low) + 1
        order = np.lexsort((j, group)) if width * (int(group[-1]) + 1) >= 1 << 62 else np.argsort(group * width + (j - low))
        i, j, group, null = i[order], j[order], group[order], null[order]
        mine, theirs = ({c: x[order] for c, x in side.items()} for side in (mine, theirs))
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (j[1:] != j[:-1])])
        start = np.flatnonzero(new)
        known = np.add.reduceat((~null).astype(np.int64), start)
        columns = [pa.array(i[start]), pa.array(j[start]), pa.array(np.diff(np.append(start, len(j))))]
        for kind, f in sums.values():
            if kind == "open":
                rank, following, top = f(mine, theirs)
                pair = np.cumsum(new) - 1
                ranked = np.lexsort((rank, pair))
                lead = np.add.reduceat((rank[ranked] == np.arange(len(j)) - start[pair]).astype(np.int64), start)
                left = np.where(lead == 0, top[start], following[ranked[start + np.maximum(lead, 1) - 1]])
                columns.append(pa.array(np.where(np.isnan(left), 0.0, left)))
                continue
            values = f(mine, theirs)
            if kind == "first":
                columns.append(pa.array(values[start]))
                continue
            values = np.where(null, -np.inf if kind == "max" else 0.0, values)
            total = (np.maximum if kind == "max" else np.add).reduceat(values, start)
            columns.append(pa.array(total / np.maximum(known, 1) if kind == "mean" else total, mask=known == 0))
        yield pa.RecordBatch.from_arrays(columns, ["item_i", "item_j", "common", *sums])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, entries = [], 0
        for frame in frames:
            if not frame.num_rows:
                continue
            held.append(frame)
            entries += len(frame.column("items").flatten())
            if entries < _ENTRIES:
                continue
            whole = pa.Table.from_batches(held)
            i, piece = whole.column("item_i").to_numpy(), whole.column("piece").to_numpy()
            cut = np.flatnonzero((i != i[-1]) | (piece != piece[-1]))  # the last group may go on
            if len(cut):
                yield from summed(whole.slice(0, int(cut[-1]) + 1))
                rest = whole.slice(int(cut[-1]) + 1)
                held = rest.combine_chunks().to_batches()
                entries = sum(len(x.column("items").flatten()) for x in held)
        if held:
            yield from summed(pa.Table.from_batches(held))

    return run


def _top(sims: DataFrame, k: int | None) -> DataFrame:
    if k is None:
        return sims
    return sims.withColumn("rank", F.row_number().over(Window.partitionBy("item_i").orderBy(F.desc("sim"), "item_j"))).where(F.col("rank") <= k).drop("rank")


def set_similarity(ratings: DataFrame, metric: str = "jaccard", k: int | None = None, least_common: int = 1, alpha: float = 0.5, most_items: int | None = None) -> DataFrame:
    """item_i, item_j, sim from who rated what; zeros are left out, the k best per item_i stay.

    jaccard, adamic_adar (sum of 1 / ln of users' counts) and resource_allocation (of 1 / count) are symmetric: one row
    with item_j < item_i. asym_cosine |common| / (|i|^alpha |j|^(1 - alpha)) and probabilistic |common| / |i| have both.
    """
    rows = ratings.select("user", F.col("item").cast("long").alias("item")).distinct().withColumn("raters", F.count("*").over(Window.partitionBy("item")))
    if metric in ("adamic_adar", "resource_allocation"):
        weight = (lambda own, _: np.where(own["d"] > 1, 1 / np.log(np.maximum(own["d"], 2)), 0.0)) if metric == "adamic_adar" else (lambda own, _: 1 / own["d"])
        summed = _pairs(rows, ["d"], [], {"w": ("sum", weight)}, most_items)
    else:
        summed = _pairs(rows, ["raters"], ["raters"], {"si": ("first", lambda own, _: own["raters"]), "sj": ("first", lambda _, other: other["raters"])}, most_items)
    summed = summed.where(F.col("common") >= least_common)
    if metric in ("asym_cosine", "probabilistic"):
        ways = [F.struct(F.col(a).alias("item_i"), F.col(b).alias("item_j"), "common", F.col(x).alias("si"), F.col(y).alias("sj")) for a, b, x, y in (("item_i", "item_j", "si", "sj"), ("item_j", "item_i", "sj", "si"))]
        summed = summed.select(F.inline(F.array(*ways)))
    sim = {
        "jaccard": lambda: F.col("common") / (F.col("si") + F.col("sj") - F.col("common")),
        "adamic_adar": lambda: F.col("w"), "resource_allocation": lambda: F.col("w"),
        "asym_cosine": lambda: F.col("common") / (F.pow("si", F.lit(alpha)) * F.pow("sj", F.lit(1 - alpha))),
        "probabilistic": lambda: F.col("common") / F.col("si"),
    }[metric]()
    return _top(summed.select("item_i", "item_j", sim.alias("sim")).where("sim <> 0"), k)


def rating_similarity(ratings: DataFrame, metric: str = "cosine", k: int | None = None, most_items: int | None = None) -> DataFrame:
    """item_i, item_j (smaller), sim from common ratings: pearson, cosine, chebyshev, manhattan, tanimoto, log_likelihood, slope_one.

    Pearson, cosine and tanimoto treat a missing rating as 0; manhattan and chebyshev are distances over the union of
    raters, turned into 1 / (1 + distance); slope_one is the mean difference over common raters.
    """
    rows = ratings.groupBy("user", F.col("item").cast("long").alias("item")).agg(F.max("rating").cast("double").alias("rating"))
    users = 0
    if metric in ("pearson", "log_likelihood"):
        rows = stored(rows, "rated")
        users = rows.select("user").distinct().count()
    x, item = F.col("rating"), Window.partitionBy("item")
    falling = item.orderBy(F.desc_nulls_last("size"), "user")
    stats = {"raters": F.count("*").over(item)} | {
        "pearson": {"s": F.sum(x).over(item), "ss": F.sum(x * x).over(item)}, "cosine": {"ss": F.sum(x * x).over(item)}, "tanimoto": {"ss": F.sum(x * x).over(item)},
        "manhattan": {"sa": F.sum(F.abs(x)).over(item)}, "log_likelihood": {}, "slope_one": {},
        "chebyshev": {"size": F.abs(x), "top": F.max(F.abs(x)).over(item)},
    }[metric]
    for name, value in stats.items():
        rows = rows.withColumn(name, value)
    if metric == "chebyshev":  # also the largest rating of either item by a user who did not rate the other
        rows = rows.withColumn("rank", F.row_number().over(falling) - 1).withColumn("next", F.lead("size").over(falling)).drop("size")
    shared = {"pearson": ["s", "ss"], "cosine": ["ss"], "tanimoto": ["ss"], "manhattan": ["sa"], "log_likelihood": ["raters"]}.get(metric, [])
    r = "rating"
    sums = {
        "manhattan": {"saved": ("sum", lambda a, b: np.abs(a[r]) + np.abs(b[r]) - np.abs(a[r] - b[r]))}, "slope_one": {"slope": ("mean", lambda a, b: b[r] - a[r])}, "log_likelihood": {},
        "chebyshev": {"far": ("max", lambda a, b: np.abs(a[r] - b[r])), "out_i": ("open", lambda a, _: (a["rank"], a["next"], a["top"])), "out_j": ("open", lambda _, b: (b["rank"], b["next"], b["top"]))},
    }.get(metric, {"xy": ("sum", lambda a, b: a[r] * b[r])})
    sums |= {f"{c}_i": ("first", lambda a, _, c=c: a[c]) for c in shared} | {f"{c}_j": ("first", lambda _, b, c=c: b[c]) for c in shared}
    carried = [*([r] if metric != "log_likelihood" else []), *shared, *(["rank", "next", "top"] if metric == "chebyshev" else [])]
    joined = _pairs(rows, carried, carried, sums, most_items)
    c = F.col
    sim = {
        "pearson": lambda: (c("xy") / users - c("s_i") * c("s_j") / users / users) / F.sqrt((c("ss_i") / users - (c("s_i") / users) ** 2) * (c("ss_j") / users - (c("s_j") / users) ** 2)),
        "cosine": lambda: c("xy") / F.sqrt(c("ss_i") * c("ss_j")),
        "tanimoto": lambda: c("xy") / (c("ss_i") + c("ss_j") - c("xy")),
        "manhattan": lambda: 1 / (1 + c("sa_i") + c("sa_j") - c("saved")),
        "chebyshev": lambda: 1 / (1 + F.greatest("far", "out_i", "out_j")),
        "log_likelihood": lambda: log_likelihood(c("common"), c("raters_i").cast("long"), c("raters_j").cast("long"), F.lit(users)),
        "slope_one": lambda: c("slope"),
    }[metric]()
    return _top(joined.select("item_i", "item_j", sim.alias("sim")), k)


def weighted_jaccard(edges: DataFrame) -> DataFrame:
    """item_i, item_j, sim = w / (sum of i's weights + sum of j's - w) of a weighted square graph (src, dst, value); larger id first."""
    w = edges.groupBy(F.greatest("src", "dst").alias("item_i"), F.least("src", "dst").alias("item_j")).agg(F.sum("value").alias("w")).where("item_i <> item_j")
    ends = w.select(F.explode(F.array("item_i", "item_j")).alias("item"), "w").groupBy("item").agg(F.sum("w").alias("s"))
    joined = w.join(ends.select(F.col("item").alias("item_i"), F.col("s").alias("si")), "item_i").join(ends.select(F.col("item").alias("item_j"), F.col("s").alias("sj")), "item_j")
    return joined.select("item_i", "item_j", (F.col("w") / (F.col("si") + F.col("sj") - F.col("w"))).alias("sim"))


def from_similarity(ratings: DataFrame, similarity: DataFrame, q: float = 3.0, undirected: bool = True, k: int | None = None, rule: str = "power") -> DataFrame:
    """user, item, score of unrated items. power: the sum over rated i of rating * sim(i, item)^q; shifted: of (rating - 0.5) / 0.5 * (sim - 1) where sim > 1.

    Self-pairs of similarity and scores of 0 are left out. A rating takes the list of its item's similar items to its
    user, where scores are summed and what the user has rated is left out: a part of a score goes through one shuffle.
    """
    sims = similarity.where("item_i <> item_j").select("item_i", "item_j", "sim")
    if rule != "power":
        sims = sims.where("sim > 1")  # nothing else adds to a score
    if undirected:
        ways = [F.struct(F.col(a).alias("item_i"), F.col(b).alias("item_j"), "sim") for a, b in (("item_i", "item_j"), ("item_j", "item_i"))]
        sims = sims.select(F.inline(F.array(*ways))).groupBy("item_i", "item_j").agg(F.max("sim").alias("sim"))
    near = sims.groupBy(F.col("item_i").alias("item")).agg(F.sort_array(F.collect_list(F.struct("sim", F.col("item_j").cast("long").alias("other")))).alias("l"))
    near = near.select("item", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / LIST).cast("int")), lambda k: F.slice("l", k * LIST + 1, F.lit(LIST)))).alias("block", "l"))
    near, rated = stored(near, "near"), stored(ratings.select("user", "item", "rating"), "rated")
    listed, n_items = near.agg(F.sum(F.size("l")), F.count_distinct("item")).first()
    entries = rated.count() * (1 + (listed or 0) / max(1, n_items))  # about
    n = max(int(rated.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(entries / PAIRS))
    met = rated.join(near, "item", "left").select("user", "item", "rating", "block", F.col("l.other").alias("others"), F.col("l.sim").alias("sims")).repartitionByRange(n, "user")
    own = F.when(F.coalesce("block", F.lit(0)) == 0, F.array(F.col("item").cast("long"))).otherwise(F.array().cast("array<bigint>"))
    met = met.select("user", "rating", "sims", own.alias("own"), "others").select("user", "rating", "sims", F.size("own").alias("skip"), F.posexplode(F.concat("own", F.coalesce("others", F.array().cast("array<bigint>")))).alias("at", "item"))
    sim = F.get("sims", F.col("at") - F.col("skip"))
    part = F.col("rating") * F.pow(sim, F.lit(q)) if rule == "power" else (F.col("rating") - 0.5) / 0.5 * (sim - 1)
    known = F.col("at") < F.col("skip")
    scored = met.select("user", "item", F.when(~known, part).alias("part"), known.alias("known")).groupBy("user", "item").agg(F.sum("part").alias("score"), F.max("known").alias("known"))
    return _best(scored.where("not known and score <> 0").select("user", "item", "score"), k)


def _best(scored: DataFrame, k: int | None) -> DataFrame:
    if k is None:
        return scored
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("user").orderBy(F.desc("score"), "item"))).where(F.col("rank") <= k)


def baseline(ratings: DataFrame, kind: str = "item_mean", test: DataFrame | None = None, minval: float | None = None, maxval: float | None = None) -> DataFrame:
    """test (or ratings) with predicted: the mean of all ratings, of the user's or of the item's; unknown ones take the overall mean."""
    test = ratings if test is None else test
    overall = ratings.agg(F.avg("rating").alias("mu"))
    joined = test.join(F.broadcast(overall), F.lit(True))  # one row
    mean = F.col("mu")
    if kind != "global_mean":
        key = kind.removesuffix("_mean")
        joined = joined.join(ratings.groupBy(key).agg(F.avg("rating").alias("mean")), key, "left")
        mean = F.coalesce("mean", "mu")
    return joined.withColumn("predicted", clamp(mean, minval, maxval)).drop("mu", "mean")


_ROWS = 256  # users whose scores are in memory at once


def _kth(x: np.ndarray, k: int) -> np.ndarray:
    """A column: the k-th smallest value of each row, or the largest if there are fewer; NaN counts as the largest."""
    k = min(k, x.shape[1])
    return np.partition(x, k - 1, axis=1)[:, k - 1 : k]


def recommend(users: DataFrame, items: DataFrame, rated: DataFrame | None, k: int = 10, block: int = 4096, offset: float = 0.0) -> DataFrame:
    """user, item, score, rank: the k unrated items with the largest dot product.

    users: user, factors; items: item, factors; optional column bias in both. Blocks of users meet blocks of items in
    numpy, each pair of blocks yields a few best candidates per user beyond those it has rated, and a window picks k. Only
    the candidates are sorted.
    """
    spark = users.sparkSession

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        n = max(1, -(-rows.count() // block))
        bias = F.col("bias").cast("double") if "bias" in rows.columns else F.lit(0.0)
        keyed = rows.select(F.pmod(F.xxhash64(name), F.lit(n)).cast("int").alias("b"), F.struct(F.col(name).cast("long").alias("id"), F.col("factors").cast("array<double>").alias("f"), bias.alias("bias")).alias("r"))
        return stored(keyed.groupBy("b").agg(F.collect_list("r").alias(name)), "blocks").withColumnRenamed("b", f"{name}_block")  # about `block` rows each

    u, i = blocks(users, "user"), blocks(items, "item")
    n_items = [r[0] for r in i.select("item_block").collect()]  # block numbers
    seen = rated.select("user", "item").distinct() if rated is not None else None
    most = seen.groupBy("user").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] if seen is not None else 0
    take = k + (most or 0)

    def unpacked(cell: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = cell.values
        return rows.field("id").to_numpy(zero_copy_only=False), rows.field("f").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1), rows.field("bias").to_numpy(zero_copy_only=False)

    def best(frames):
        for frame in frames:
            for us, its in zip(frame.column(0), frame.column(1)):
                (of, x, x_bias), (ids, y, y_bias) = unpacked(us), unpacked(its)
                for start in range(0, len(of), _ROWS):
                    part = slice(start, start + _ROWS)
                    low = -(x[part] @ y.T + x_bias[part, None] + y_bias[None, :] + offset)
                    at, j = np.nonzero(~(low > _kth(low, take)))  # the best and their ties
                    order = np.lexsort((ids[j], low[at, j], at))
                    at, j = at[order], j[order]
                    kept = np.arange(len(at)) - np.searchsorted(at, at) < take
                    at, j = at[kept], j[kept]
                    yield pa.RecordBatch.from_arrays([pa.array(of[part][at]), pa.array(ids[j]), pa.array(-low[at, j])], ["user", "item", "score"])

    met = u.withColumn("item_block", F.explode(F.lit(n_items).cast("array<int>") if n_items else F.array().cast("array<int>"))).join(i, "item_block")
    met = met.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "user_block", "item_block")
    found = met.select("user", "item").mapInArrow(best, "user long, item long, score double")
    if seen is not None:
        found = found.join(seen, ["user", "item"], "left_anti")
    return _best(found, k)
