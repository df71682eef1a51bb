"""Matrix factorisation.

Normal equations are sums of outer products, so they are aggregated in the JVM before the shuffle: a hot item costs one
partial sum per task, not a group in one task. Only the solved systems, one row per user or item, pass through numpy.
Gradient methods take one synchronous step per pass: the mean gradient of each user and item. Start values are hashes
of (side, id, dimension), so runs agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.numeric import clamp, dot, sum_arrays
from lattica.plans.store import stored


def start_factors(ids: DataFrame, key: str, d: int, seed: int = 1, scale: float = 0.1, positive: bool = False) -> DataFrame:
    """key and factors: d numbers in (-scale, scale), or (0, scale), by a hash."""
    u = lambda k: F.pmod(F.xxhash64(F.lit(key), F.col(key), F.lit(k), F.lit(seed)), F.lit(1 << 30)).cast("double") / float(1 << 30)
    return ids.select(key).distinct().select(key, F.array(*[(u(k) if positive else 2 * u(k) - 1) * scale + (1e-3 if positive else 0.0) for k in range(d)]).alias("factors"))


def _upper(d: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(d) for b in range(a, d)]


Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def ridge(lam: float, by_count: bool = False) -> Kernel:
    """Solves (A + lam I) x = b, or with lam times the number of ratings."""

    def solve(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.linalg.solve(a + (lam * (n if by_count else np.ones(len(n))))[:, None, None] * np.eye(a.shape[1]), b[..., None])[..., 0]

    return solve


def coordinate_descent(lam: float, sweeps: int = 3) -> Kernel:
    """Minimises the same objective one coordinate at a time."""

    def solve(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = np.zeros_like(b)
        for _ in range(sweeps):
            for k in range(b.shape[1]):
                rest = b[:, k] - (a[:, k] * x).sum(1) + a[:, k, k] * x[:, k]
                x[:, k] = rest / (a[:, k, k] + lam)
        return x

    return solve


def cosamp(a: np.ndarray, b: np.ndarray, k: int, most: int = 10, tolerance: float = 1e-6) -> np.ndarray:
    """The k-sparse x with a @ x close to b, by compressive sampling matching pursuit."""
    x, best, residual, support = np.zeros(a.shape[1]), None, b.copy(), np.zeros(0, dtype=int)
    for _ in range(most):
        proxy = np.abs(a.T @ residual)
        merged = np.union1d(support, np.argsort(-proxy, kind="stable")[: 2 * k])
        fit = np.linalg.lstsq(a[:, merged], b, rcond=None)[0]
        keep = np.argsort(-np.abs(fit), kind="stable")[:k]
        support = merged[keep]
        x = np.zeros(a.shape[1])
        x[support] = fit[keep]
        new = b - a @ x
        if best is not None and np.linalg.norm(new) > np.linalg.norm(residual) - tolerance:
            break  # no longer nearer: the step before it stands
        best, residual = x, new
    return best if best is not None else x


def sparse(lam: float, k: int) -> Kernel:
    """At most k factors different from zero, by matching pursuit on the normal equations."""

    def solve(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        eye = lam * np.eye(a.shape[1])
        return np.stack([cosamp(x + eye, y, k) for x, y in zip(a, b)]) if len(b) else b

    return solve


def sampled(lam: float, noise: float, seed: int) -> Kernel:
    """A draw from the normal distribution of the factors given everything else (Gibbs sampling), precision `noise` per rating."""

    def solve(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        precision = noise * a + lam * np.eye(a.shape[1])
        mean = np.linalg.solve(precision, noise * b[..., None])[..., 0]
        lower = np.linalg.cholesky(precision)
        out = np.empty_like(mean)
        for k in range(len(b)):
            draw = np.random.default_rng([seed, int(n[k]), int(np.abs(b[k]).sum() * 1e6) % (1 << 31)])
            out[k] = mean[k] + np.linalg.solve(lower[k].T, draw.standard_normal(b.shape[1]))
        return out

    return solve


def solve_side(rows: DataFrame, key: str, d: int, kernel: Kernel) -> DataFrame:
    """key and factors from rows key, f (the other side's factors), target, weight."""
    f = F.col("f")
    products = [F.sum(F.col("weight") * f[a] * f[b]) for a, b in _upper(d)]
    sides = [F.sum(F.col("weight") * f[a] * F.col("target")) for a in range(d)]
    sums = rows.groupBy(key).agg(F.array(*products).alias("a"), F.array(*sides).alias("b"), F.count("*").alias("n"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = np.array(_upper(d))
        for frame in frames:
            m = frame.num_rows
            if not m:
                continue
            flat = frame.column(1).flatten().to_numpy(zero_copy_only=False).reshape(m, -1)
            a = np.zeros((m, d, d))
            a[:, upper[:, 0], upper[:, 1]] = flat
            a[:, upper[:, 1], upper[:, 0]] = flat
            x = kernel(a, frame.column(2).flatten().to_numpy(zero_copy_only=False).reshape(m, d), frame.column(3).to_numpy().astype(float))
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, m * d + 1, d), pa.int32()), pa.array(x.ravel()))], [key, "factors"])

    return sums.mapInArrow(run, f"{key} long, factors array<double>")


def predict(rows: DataFrame, users: DataFrame, items: DataFrame, minval: float | None = None, maxval: float | None = None, offset: float = 0.0) -> DataFrame:
    """rows with predicted = offset + user's factors . item's factors, within the bounds; null where either is unknown."""
    out = rows.join(users.select("user", F.col("factors").alias("p")), "user", "left").join(items.select("item", F.col("factors").alias("q")), "item", "left")
    return out.withColumn("predicted", clamp(dot(F.col("p"), F.col("q")) + offset, minval, maxval)).drop("p", "q")


def als(ratings: DataFrame, d: int = 5, passes: int = 6, lam: float = 0.065, user_kernel: Kernel | None = None, item_kernel: Kernel | None = None, weight: str | None = None, start: DataFrame | None = None, by_count: bool = False, burn_in: int | None = None) -> tuple[DataFrame, DataFrame, list[float]]:
    """users (user, factors), items (item, factors) and the training RMSE before each pass.

    A pass solves all users against the items, then all items against the users. weight names a column that weighs the
    squared errors. start (item, factors) resumes. With burn_in the factors of later passes are averaged.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = stored(ratings.select(F.col("user").cast("long").alias("user"), F.col("item").cast("long").alias("item"), F.col("rating").cast("double").alias("target"), w.alias("weight")), "ratings")
    items = stored(start if start is not None else start_factors(rows, "item", d, positive=True, scale=1.0), "items")
    users, history, kept = None, [], []
    user_kernel, item_kernel = user_kernel or ridge(lam, by_count), item_kernel or ridge(lam, by_count)
    for k in range(passes):
        if users is not None:
            e = F.col("target") - F.col("predicted")
            history.append(predict(rows, users, items).agg(F.sqrt(F.avg(e * e))).first()[0])
        users = stored(solve_side(rows.join(items.withColumnRenamed("factors", "f"), "item"), "user", d, user_kernel), "users")
        items = stored(solve_side(rows.join(users.withColumnRenamed("factors", "f"), "user"), "item", d, item_kernel), "items")
        if burn_in is not None and k >= burn_in:
            kept.append((users, items))
    e = F.col("target") - F.col("predicted")
    history.append(predict(rows, users, items).agg(F.sqrt(F.avg(e * e))).first()[0])
    if kept:
        mean = lambda side, key: _mean([x[side] for x in kept], key, d)
        users, items = mean(0, "user"), mean(1, "item")
    return users, items, history


def _mean(parts: list[DataFrame], key: str, d: int) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    return stored(whole.groupBy(key).agg(F.array(*[F.avg(F.col("factors")[k]) for k in range(d)]).alias("factors")), "mean")


def pmf(ratings: DataFrame, d: int = 5, passes: int = 8, burn_in: int = 3, lam: float = 0.5, noise: float = 2.0, seed: int = 1) -> tuple[DataFrame, DataFrame, list[float]]:
    """Bayesian factorisation: Gibbs draws of both sides, averaged after burn_in."""
    return als(ratings, d, passes, lam, sampled(lam, noise, seed), sampled(lam, noise, seed + 1), burn_in=burn_in)


def tensor_als(ratings: DataFrame, d: int = 4, passes: int = 4, lam: float = 0.065) -> tuple[DataFrame, DataFrame, DataFrame]:
    """users, items, times of ratings user, item, time, rating ~ sum over k of p_k q_k t_k."""
    rows = stored(ratings.select(*[F.col(c).cast("long").alias(c) for c in ("user", "item", "time")], F.col("rating").cast("double").alias("target"), F.lit(1.0).alias("weight")), "ratings")
    sides = {k: stored(start_factors(rows, k, d, positive=True, scale=1.0), k) for k in ("user", "item", "time")}
    for _ in range(passes):
        for key in sides:
            a, b = (k for k in sides if k != key)
            joined = rows.join(sides[a].withColumnRenamed("factors", "fa"), a).join(sides[b].withColumnRenamed("factors", "fb"), b)
            sides[key] = stored(solve_side(joined.withColumn("f", F.zip_with("fa", "fb", lambda x, y: x * y)), key, d, ridge(lam)), key)
    return sides["user"], sides["item"], sides["time"]


def nmf(ratings: DataFrame, d: int = 5, passes: int = 6, floor: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """Non-negative users and items by multiplicative updates over the rated cells; sides alternate."""
    rows = stored(ratings.select(F.col("user").cast("long").alias("user"), F.col("item").cast("long").alias("item"), F.col("rating").cast("double").alias("r")), "ratings")
    sides = {k: stored(start_factors(rows, k, d, positive=True, scale=1.0), k) for k in ("user", "item")}
    for k in range(passes):
        key, other = ("user", "item") if k % 2 == 0 else ("item", "user")
        joined = rows.join(sides[key].withColumnRenamed("factors", "f"), key).join(sides[other].withColumnRenamed("factors", "g"), other)
        joined = joined.withColumn("guess", dot(F.col("f"), F.col("g")))
        sums = joined.groupBy(key).agg(
            F.array(*[F.sum(F.col("r") * F.col("g")[m]) for m in range(d)]).alias("up"), F.array(*[F.sum(F.col("guess") * F.col("g")[m]) for m in range(d)]).alias("down")
        )
        new = sides[key].join(sums, key).select(key, F.transform(F.arrays_zip("factors", "up", "down"), lambda x: F.greatest(F.lit(floor), x["factors"] * x["up"] / (x["down"] + floor))).alias("factors"))
        sides[key] = stored(new, key)
    return sides["user"], sides["item"]


# gradient methods


def _loss_gradient(loss: str, r: Column, guess: Column) -> Column:
    """What moves the linear predictor of a squared, absolute or logistic loss downhill; the last two through a sigmoid."""
    if loss == "square":
        return r - guess
    p = 1 / (1 + F.exp(-guess))
    return (r - p) if loss == "logistic" else F.signum(r - p) * p * (1 - p)


def sgd(
    ratings: DataFrame, d: int = 5, passes: int = 10, rate: float = 0.5, lam: float = 0.02, decay: float = 0.95, biased: bool = False, loss: str = "square",
    implicit: bool = False, time: str | None = None,
) -> dict:
    """Gradient factorisation; returns mu, users, items (key, factors, bias), further sides, and the RMSE before each pass.

    biased adds mu + b_u + b_i; loss may be logistic or absolute for ratings in [0, 1]; implicit adds the items' second
    factors, summed over what a user has rated and divided by the root of its count (SVD++); time names a column whose
    values get a bias and factors of their own. Each pass takes one step along the mean gradient of each row.
    """
    keys = ["user", "item", *([time] if time else [])]
    rows = stored(ratings.select(*[F.col(k).cast("long").alias(k) for k in keys], F.col("rating").cast("double").alias("r")), "ratings")
    mu = float(rows.agg(F.avg("r")).first()[0] or 0.0) if biased and loss == "square" else 0.0
    zero = F.lit(0.0).alias("bias")
    sides = {k: stored(start_factors(rows, k, d).select(k, "factors", zero), k) for k in keys}
    if implicit:
        sides["implicit"] = stored(start_factors(rows, "item", d, seed=2).select("item", "factors", zero), "implicit")
    history = []
    for k in range(passes):
        joined = rows
        for key in keys:
            joined = joined.join(sides[key].select(key, F.col("factors").alias(f"f_{key}"), F.col("bias").alias(f"b_{key}")), key)
        if implicit:
            n = rows.groupBy("user").agg(F.count("*").alias("n"))
            summed = rows.join(sides["implicit"].select("item", F.col("factors").alias("y")), "item").groupBy("user").agg(sum_arrays("y", d).alias("y"))
            summed = summed.join(n, "user").select("user", F.transform("y", lambda x: x / F.sqrt("n")).alias("y"), F.sqrt("n").alias("root"))
            joined = joined.join(summed, "user").withColumn("p", F.zip_with("f_user", "y", lambda a, b: a + b))
        else:
            joined = joined.withColumn("p", F.col("f_user"))
        guess = dot(F.col("p"), F.col("f_item"))
        if time:
            guess = guess + dot(F.col("f_item"), F.col(f"f_{time}")) + dot(F.col("p"), F.col(f"f_{time}"))
        if biased:
            guess = guess + mu + sum((F.col(f"b_{key}") for key in keys), F.lit(0.0))
        joined = joined.withColumn("guess", guess).withColumn("e", _loss_gradient(loss, F.col("r"), F.col("guess")))
        shown = F.col("guess") if loss == "square" else 1 / (1 + F.exp(-F.col("guess")))
        kept = [*keys, "e", "p", "f_item", *([f"f_{time}"] if time else []), *(["root"] if implicit else [])]  # what the gradients read
        if loss != "square":  # else it is e
            kept.append((F.col("r") - shown).alias("miss"))
        joined = stored(joined.select(*kept), "pass")
        miss = F.col("e" if loss == "square" else "miss")
        history.append(joined.agg(F.sqrt(F.avg(miss * miss))).first()[0])
        step = rate * decay**k
        other = {"user": F.col("f_item"), "item": F.col("p")}
        if time:
            t = F.col(f"f_{time}")
            add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
            other = {"user": add(F.col("f_item"), t), "item": add(F.col("p"), t), time: add(F.col("p"), F.col("f_item"))}
        new = {}
        for key in keys:
            moved = joined.select(key, "e", other[key].alias("g")).groupBy(key).agg(F.array(*[F.avg(F.col("e") * F.col("g")[m]) for m in range(d)]).alias("g"), F.avg("e").alias("eb"))
            factors = F.zip_with("factors", "g", lambda x, g: x + step * (g - lam * x))
            bias = F.col("bias") + step * (F.col("eb") - lam * F.col("bias")) if biased else F.lit(0.0)
            new[key] = stored(sides[key].join(moved, key).select(key, factors.alias("factors"), bias.alias("bias")), key)
        if implicit:
            moved = joined.groupBy("item").agg(F.array(*[F.avg(F.col("e") * F.col("f_item")[m] / F.col("root")) for m in range(d)]).alias("g"))
            factors = F.zip_with("factors", "g", lambda x, g: x + step * (g - lam * x))
            new["implicit"] = stored(sides["implicit"].join(moved, "item").select("item", factors.alias("factors"), "bias"), "implicit")
        sides = new
    return {"mu": mu, "users": sides["user"], "items": sides["item"], "times": sides.get(time), "implicit": sides.get("implicit"), "history": history}


def factorization_machine(rows: DataFrame, d: int = 4, passes: int = 20, rate: float = 0.3, lam: float = 0.001, loss: str = "square") -> tuple[float, DataFrame, list[float]]:
    """A second-order factorisation machine over rows (row, target, features map<string,double>).

    Returns the intercept, weights (feature, w, v array) and the error before each pass. A row's prediction is
    w0 + sum w x + half of sum over k of ((sum v x)^2 - sum v^2 x^2); steps follow mean gradients per feature.
    Categorical columns are features named column=value with value 1; user, item, time, last item, node features and
    links all enter this way. Unknown features at prediction are skipped.
    """
    flat = stored(rows.select("row", F.col("target").cast("double").alias("target"), F.explode("features").alias("feature", "x")), "features")
    u = lambda k: (F.pmod(F.xxhash64("feature", F.lit(k)), F.lit(1 << 20)) / float(1 << 20) - 0.5) * 0.1
    weights = stored(flat.select("feature").distinct().select("feature", F.lit(0.0).alias("w"), F.array(*[u(k) for k in range(d)]).alias("v")), "weights")
    w0 = float(flat.select("row", "target").distinct().agg(F.avg("target")).first()[0] or 0.0) if loss == "square" else 0.0
    history = []
    for _ in range(passes):
        scored = stored(_machine(flat, weights, w0, d), "scored")
        shown = F.col("guess") if loss == "square" else 1 / (1 + F.exp(-F.col("guess")))
        history.append(scored.agg(F.sqrt(F.avg((F.col("target") - shown) ** 2))).first()[0])
        e = _loss_gradient(loss, F.col("target"), F.col("guess"))
        back = flat.drop("target").join(scored.select("row", e.alias("e"), "s"), "row").join(weights, "feature")
        grads = back.groupBy("feature").agg(F.avg(F.col("e") * F.col("x")).alias("gw"), F.array(*[F.avg(F.col("e") * F.col("x") * (F.col("s")[k] - F.col("v")[k] * F.col("x"))) for k in range(d)]).alias("gv"))
        moved = weights.join(grads, "feature")
        weights = stored(moved.select("feature", (F.col("w") + rate * (F.col("gw") - lam * F.col("w"))).alias("w"), F.zip_with("v", "gv", lambda v, g: v + rate * (g - lam * v)).alias("v")), "weights")
        w0 += rate * float(scored.agg(F.avg(e)).first()[0] or 0.0)
    return w0, weights, history


def _machine(flat: DataFrame, weights: DataFrame, w0: float, d: int) -> DataFrame:
    """row, target, s (sum of v x) and guess."""
    x, v = F.col("x"), F.col("v")
    sums = flat.join(weights, "feature").groupBy("row", "target").agg(F.sum(F.col("w") * x).alias("lin"), F.array(*[F.sum(v[k] * x) for k in range(d)]).alias("s"), F.array(*[F.sum(v[k] * v[k] * x * x) for k in range(d)]).alias("q"))
    cross = F.aggregate(F.zip_with("s", "q", lambda a, b: a * a - b), F.lit(0.0), lambda t, y: t + y) / 2
    return sums.select("row", "target", "s", (w0 + F.col("lin") + cross).alias("guess"))


def machine_predict(rows: DataFrame, w0: float, weights: DataFrame, d: int = 4) -> DataFrame:
    flat = rows.select("row", F.col("target").cast("double").alias("target"), F.explode("features").alias("feature", "x"))
    return _machine(flat, weights, w0, d).select("row", "target", F.col("guess").alias("predicted"))


def climf(ratings: DataFrame, d: int = 4, passes: int = 10, rate: float = 0.2, lam: float = 0.001, threshold: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Factors that maximise a smoothed reciprocal rank of relevant items (rating >= threshold).

    The gradient of a user needs all pairs of its relevant items; those are joined by user and aggregated.
    """
    rows = stored(ratings.where(F.col("rating") >= threshold).select(F.col("user").cast("long").alias("user"), F.col("item").cast("long").alias("item")).distinct(), "relevant")
    sides = {k: stored(start_factors(rows, k, d, scale=0.1), k) for k in ("user", "item")}
    g = lambda x: 1 / (1 + F.exp(-x))
    for _ in range(passes):
        joined = rows.join(sides["user"].withColumnRenamed("factors", "p"), "user").join(sides["item"].withColumnRenamed("factors", "q"), "item")
        scored = stored(joined.withColumn("f", dot(F.col("p"), F.col("q"))), "scored")
        pairs = scored.select("user", "item", "p", "q", "f").join(scored.select("user", F.col("item").alias("item2"), F.col("q").alias("q2"), F.col("f").alias("f2")), "user").where("item <> item2")
        slope = lambda x: g(x) * (1 - g(x))
        push = slope(F.col("f") - F.col("f2")) * (1 / (1 - g(F.col("f2") - F.col("f"))) - 1 / (1 - g(F.col("f") - F.col("f2"))))
        pulled = pairs.withColumn("c", push)
        own = scored.withColumn("c", g(-F.col("f")))
        du = own.select("user", F.transform("q", lambda x: x * F.col("c")).alias("g")).union(pulled.select("user", F.transform(F.zip_with("q", "q2", lambda a, b: a - b), lambda x: x * F.col("c") / 2).alias("g")))
        dv = own.select("item", F.transform("p", lambda x: x * F.col("c")).alias("g")).union(pulled.select("item", F.transform("p", lambda x: x * F.col("c")).alias("g")))
        for key, grad in (("user", du), ("item", dv)):
            moved = sides[key].join(grad.groupBy(key).agg(sum_arrays("g", d).alias("g"), F.count("*").alias("n")), key)
            sides[key] = stored(moved.select(key, F.transform(F.arrays_zip("factors", "g"), lambda x: x["factors"] + rate * (x["g"] / F.sqrt("n") - lam * x["factors"])).alias("factors")), key)
    return sides["user"], sides["item"]


def rbm(ratings: DataFrame, hidden: int = 8, bins: int = 5, passes: int = 10, rate: float = 0.5, decay: float = 0.95, lam: float = 0.001, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """A restricted Boltzmann machine over binned ratings (1 to bins), by one-step contrastive divergence with expected values.

    Returns weights (item, bin, bias, w array) and the training data's expected ratings (user, item, rating, predicted).
    """
    rows = stored(ratings.select(F.col("user").cast("long").alias("user"), F.col("item").cast("long").alias("item"), F.least(F.greatest(F.round("rating"), F.lit(1)), F.lit(bins)).cast("int").alias("bin")), "binned")
    cells = rows.select("item").distinct().withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    u = lambda k: (F.pmod(F.xxhash64("item", "bin", F.lit(k), F.lit(seed)), F.lit(1 << 20)) / float(1 << 20) - 0.5) * 0.1
    weights = stored(cells.select("item", "bin", F.lit(0.0).alias("bias"), F.array(*[u(k) for k in range(hidden)]).alias("w")), "weights")
    on = lambda sums: F.transform(sums, lambda x: 1 / (1 + F.exp(-x)))

    def down(now: DataFrame, w: DataFrame) -> DataFrame:
        """user, item, bin, v: the chances of each bin given the user's hidden units."""
        open_ = rows.select("user", "item").join(now, "user").join(w, "item").withColumn("z", F.exp(F.col("bias") + dot(F.col("h"), F.col("w"))))
        total = open_.groupBy("user", "item").agg(F.sum("z").alias("total"))
        return open_.join(total, ["user", "item"]).select("user", "item", "bin", (F.col("z") / F.col("total")).alias("v"), "h", "w")

    hidden_of = lambda seen, w: seen.join(w.select("item", "bin", "w"), ["item", "bin"]).groupBy("user").agg(on(sum_arrays("w", hidden)).alias("h"))
    for k in range(passes):
        h0 = stored(hidden_of(rows, weights), "hidden")
        v1 = stored(down(h0, weights).drop("h"), "visible")
        scaled = v1.select("user", F.transform("w", lambda x: x * F.col("v")).alias("w"))
        h1 = scaled.groupBy("user").agg(on(sum_arrays("w", hidden)).alias("h"))
        up = rows.join(h0, "user").select("item", "bin", F.lit(1.0).alias("b"), "h")
        fall = v1.select("user", "item", "bin", "v").join(h1, "user").select("item", "bin", (-F.col("v")).alias("b"), F.transform("h", lambda x: -x * F.col("v")).alias("h"))
        raters = rows.groupBy("item").agg(F.count("*").alias("n"))
        grads = up.union(fall).groupBy("item", "bin").agg(F.sum("b").alias("gb"), sum_arrays("h", hidden).alias("g")).join(raters, "item")
        step = rate * decay**k
        moved = weights.join(grads, ["item", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(1)))
        new_w = F.transform(F.arrays_zip("w", F.coalesce("g", F.array(*[F.lit(0.0)] * hidden)).alias("g")), lambda x: x["w"] + step * (x["g"] / F.col("n") - lam * x["w"]))
        weights = stored(moved.select("item", "bin", (F.col("bias") + step * F.coalesce("gb", F.lit(0.0)) / F.col("n")).alias("bias"), new_w.alias("w")), "weights")
    guess = down(hidden_of(rows, weights), weights).groupBy("user", "item").agg(F.sum(F.col("bin") * F.col("v")).alias("predicted"))
    return weights, rows.withColumnRenamed("bin", "rating").join(guess, ["user", "item"])


# spectral


def multiply(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """id, val: matrix (row, col, value) times vector (id, val)."""
    return matrix.join(vector.select(F.col("id").alias("col"), "val"), "col").groupBy(F.col("row").alias("id")).agg(F.sum(F.col("value") * F.col("val")).alias("val"))


def transposed(matrix: DataFrame) -> DataFrame:
    return matrix.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


def vector_dot(a: DataFrame, b: DataFrame) -> float:
    return a.join(b.select("id", F.col("val").alias("other")), "id").agg(F.sum(F.col("val") * F.col("other"))).first()[0] or 0.0


def orthogonalize(vector: DataFrame, basis: list[DataFrame]) -> DataFrame:
    """vector less its components along the orthonormal basis."""
    for b in basis:
        c = vector_dot(vector, b)
        joined = vector.join(b.select("id", F.col("val").alias("other")), "id", "full")
        vector = stored(joined.select("id", (F.coalesce("val", F.lit(0.0)) - c * F.coalesce("other", F.lit(0.0))).alias("val")), "vector")
    return vector


def svd(matrix: DataFrame, k: int = 3, steps: int | None = None, seed: int = 1) -> tuple[list[float], DataFrame, DataFrame]:
    """The k largest singular values; left (k, id, val) and right vectors of a sparse matrix (row, col, value).

    Golub-Kahan-Lanczos bidiagonalisation with full re-orthogonalisation; vectors stay distributed, the small bidiagonal
    matrix is solved on the driver. Each vector's sign makes its entry of the largest magnitude (then smallest id) positive.
    """
    matrix = stored(matrix.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value")), "matrix")
    back = transposed(matrix)
    size = min(matrix.select("row").distinct().count(), matrix.select("col").distinct().count())
    steps = min(size, steps or max(3 * k, k + 10))
    unit = lambda v, n: stored(v.select("id", (F.col("val") / n).alias("val")), "vector")
    v = back.select(F.col("row").alias("id")).distinct().select("id", (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20) - 0.5).alias("val"))
    v = stored(v, "vector")
    v = unit(v, vector_dot(v, v) ** 0.5)
    us, vs, alphas, betas = [], [v], [], []
    for j in range(steps):
        u = orthogonalize(stored(multiply(matrix, vs[j]), "vector"), us)
        alpha = vector_dot(u, u) ** 0.5
        if alpha < 1e-10:
            break
        us.append(unit(u, alpha))
        alphas.append(alpha)
        w = orthogonalize(stored(multiply(back, us[j]), "vector"), vs)
        beta = vector_dot(w, w) ** 0.5
        if beta < 1e-10 or j + 1 == steps:
            break
        betas.append(beta)
        vs.append(unit(w, beta))
    n = len(alphas)
    b = np.diag(alphas) + (np.diag(betas[: n - 1], 1) if n > 1 else 0)
    p, s, qt = np.linalg.svd(b)
    k = min(k, n)

    def combine(basis: list[DataFrame], c: np.ndarray) -> DataFrame:
        parts = None
        for j, x in enumerate(basis[:n]):
            rows = x.select("id", F.explode(F.array(*[F.struct(F.lit(m).alias("k"), (F.col("val") * float(c[j, m])).alias("val")) for m in range(k)])).alias("e")).select("e.k", "id", "e.val")
            parts = rows if parts is None else parts.union(rows)
        return stored(parts.groupBy("k", "id").agg(F.sum("val").alias("val")), "singular")

    left, right = combine(us, p), combine(vs, qt.T)
    sign = right.groupBy("k").agg(F.signum(F.max_by("val", F.struct(F.abs(F.col("val")), -F.col("id")))).alias("sign"))
    fixed = lambda x: x.join(F.broadcast(sign), "k").select("k", "id", (F.col("val") * F.col("sign")).alias("val"))  # noqa: E731  k rows
    return s[:k].tolist(), fixed(left), fixed(right)
