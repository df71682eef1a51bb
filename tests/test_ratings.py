import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import numeric, text
from lattica.operators import factors, items, metrics, models, tables

GRAPH = [(1, 1, 1.0), (1, 3, 1.0), (1, 4, 1.0), (2, 3, 1.0), (2, 4, 0.1), (2, 5, 1.0), (3, 1, 1.0), (3, 2, 1.0), (3, 4, 1.0), (4, 1, 0.1), (4, 3, 1.0), (4, 5, 1.0), (5, 4, 0.1), (5, 5, 1.0), (5, 6, 1.0)]
RATINGS = "user long, item long, rating double"


def rows(df):
    return {tuple(r[:2]): r[2] for r in df.collect()}


def test_jaccard_of_common_raters(spark):
    got = rows(items.set_similarity(spark.createDataFrame(GRAPH, RATINGS), "jaccard", k=5, least_common=2))
    assert got == {k: pytest.approx(v) for k, v in {(5, 4): 0.4, (5, 3): 0.5, (4, 3): 0.4, (4, 1): 0.4, (3, 1): 0.5}.items()}


def test_weighted_jaccard(spark):
    edges = spark.createDataFrame([(2, 1, 2.0), (3, 1, 1.0), (4, 5, 1.0), (6, 7, 1.0)], "src long, dst long, value double")
    assert rows(items.weighted_jaccard(edges)) == {k: pytest.approx(v) for k, v in {(2, 1): 2 / 3, (3, 1): 1 / 3, (5, 4): 1, (7, 6): 1}.items()}


def test_scores_from_similarity(spark):
    r = spark.createDataFrame([(1, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0), (4, 4, 1.0), (4, 1, 1.0), (1, 4, 1.0), (2, 2, 1.0), (5, 3, 1.0)], RATINGS)
    s = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0), (1, 4, 1.0), (2, 2, 1.0)], "item_i long, item_j long, sim double")
    want = {(1, 3): 2, (2, 1): 1, (2, 4): 1, (3, 1): 1, (3, 3): 1, (4, 2): 1, (4, 3): 1, (5, 2): 1, (5, 4): 1}
    assert rows(items.from_similarity(r, s).select("user", "item", "score")) == want


def test_rating_similarities_against_dense_matrices(spark):
    draw = np.random.default_rng(1)
    dense = np.where(draw.random((12, 6)) < 0.6, draw.integers(1, 6, (12, 6)), 0).astype(float)
    data = [(u, i, float(dense[u, i])) for u in range(12) for i in range(6) if dense[u, i]]
    users, frame = len({u for u, _, _ in data}), spark.createDataFrame(data, RATINGS)
    dense = dense[[u for u in range(12) if dense[u].any()]]
    for metric in ("pearson", "cosine", "tanimoto", "manhattan", "chebyshev", "slope_one", "log_likelihood"):
        got = rows(items.rating_similarity(frame, metric))
        for (i, j), value in got.items():
            x, y = dense[:, i], dense[:, j]
            both = (x > 0) & (y > 0)
            n11, n10, n01 = both.sum(), ((x > 0) & (y == 0)).sum(), ((x == 0) & (y > 0)).sum()
            h = lambda *k: sum(-v * math.log(v / users) for v in k if v)
            want = {
                "pearson": np.corrcoef(x, y)[0, 1], "cosine": x @ y / math.sqrt((x @ x) * (y @ y)), "tanimoto": x @ y / (x @ x + y @ y - x @ y),
                "manhattan": 1 / (1 + np.abs(x - y).sum()), "chebyshev": 1 / (1 + np.abs(x - y).max()), "slope_one": (y - x)[both].mean(),
                "log_likelihood": max(0, 2 * (h(n11 + n10, users - n11 - n10) + h(n11 + n01, users - n11 - n01) - h(n11, n10, n01, users - n11 - n10 - n01))),
            }[metric]
            assert value == pytest.approx(want), (metric, i, j)
        assert len(got) == sum(((dense[:, i] > 0) & (dense[:, j] > 0)).any() for i in range(6) for j in range(i))


def test_average_precision(spark):
    lists = lambda d: spark.createDataFrame([(u, i, k + 1) for u, l in d.items() for k, i in enumerate(l)], "user long, item long, rank int")
    actual = lists({1: [1, 3, 4], 2: [1, 2, 4], 3: [1, 3]})
    got = {r.user: r.ap for r in metrics.average_precision(lists({u: [1, 2, 3, 4, 5] for u in (1, 2, 3)}), actual, 3).collect()}
    assert got == {1: pytest.approx(5 / 9), 2: pytest.approx(2 / 3), 3: pytest.approx(5 / 6)}
    assert metrics.mean_average_precision(actual, actual, 3).first().map == 1.0
    assert metrics.mean_reciprocal_rank(lists({1: [9, 4], 2: [7]}), actual).first().mrr == pytest.approx((1 / 2) / 3)
    assert metrics.halted([1.0, 2.0]) and not metrics.halted([2.0, 1.0]) and metrics.halted([2.0, 1.0], falling=False)


def test_roc(spark):
    draw = np.random.default_rng(2)
    y, s = draw.integers(0, 2, 300), np.round(draw.random(300), 1)
    pairs = [(1.0 if a > b else 0.5 if a == b else 0.0) for a in s[y == 1] for b in s[y == 0]]
    frame = spark.createDataFrame(list(zip(y.tolist(), s.tolist())), "label int, score double")
    assert metrics.roc_auc(frame).first().auc == pytest.approx(np.mean(pairs))


def low_rank(users=25, n=12, d=2, seed=3, share=0.7):
    draw = np.random.default_rng(seed)
    full = draw.random((users, d)) @ draw.random((n, d)).T + 0.5
    mask = draw.random((users, n)) < share
    return full, [(u, i, float(full[u, i])) for u in range(users) for i in range(n) if mask[u, i]]


def test_als_solves_the_normal_equations(spark):
    _, data = low_rank()
    users, its, history = factors.als(spark.createDataFrame(data, RATINGS), 3, 4, 0.05)
    p, q = ({r[0]: np.array(r.factors) for r in x.collect()} for x in (users, its))
    for i in q:  # items were solved last
        x = np.array([p[u] for u, k, _ in data if k == i])
        y = np.array([r for _, k, r in data if k == i])
        assert np.allclose(q[i], np.linalg.solve(x.T @ x + 0.05 * np.eye(3), x.T @ y))
    assert history[-1] < 0.1 and all(b <= a + 1e-9 for a, b in zip(history, history[1:]))


def test_other_als(spark):
    full, data = low_rank()
    frame = spark.createDataFrame(data, RATINGS)
    coordinate = factors.als(frame, 2, 6, 0.01, factors.coordinate_descent(0.01), factors.coordinate_descent(0.01))
    assert coordinate[2][-1] < 0.1
    sparse = factors.als(frame, 4, 3, 0.05, user_kernel=factors.sparse(0.05, 2))[0]
    assert all(sum(abs(x) > 0 for x in r.factors) <= 2 for r in sparse.collect())
    heavy = factors.als(frame.withColumn("w", F.when(F.col("user") == 1, 100.0).otherwise(1.0)), 2, 3, 0.5, weight="w")
    error = lambda f: factors.predict(frame.where("user = 1"), f[0], f[1]).agg(F.avg((F.col("rating") - F.col("predicted")) ** 2)).first()[0]
    assert error(heavy) < error(factors.als(frame, 2, 3, 0.5))
    assert factors.pmf(frame, 2, 6, 3, 0.1, 50.0)[2][-1] < 0.3
    timed = frame.withColumn("time", F.col("user") % 3)
    u, i, t = factors.tensor_als(timed, 2, 4, 0.01)
    assert u.count() == 25 and t.count() == 3


def test_cosamp():
    a = np.array([[0.9528, 0.5982, 0.8368], [0.7041, 0.8407, 0.5187], [0.9539, 0.4428, 0.0222]])
    assert np.allclose(factors.cosamp(a, np.array([0.3759, 0.8986, 0.4290]), 1), [0, 1.2032, 0], atol=1e-4)


def test_nmf_falls_and_stays_positive(spark):
    _, data = low_rank()
    frame = spark.createDataFrame(data, RATINGS)

    def error(passes):
        u, i = factors.nmf(frame, 3, passes)
        assert all(x > 0 for r in u.union(i).collect() for x in r.factors)
        return factors.predict(frame, u, i).agg(F.avg((F.col("rating") - F.col("predicted")) ** 2)).first()[0]

    assert error(10) < error(2)


@pytest.mark.parametrize("options", [{}, {"biased": True}, {"biased": True, "loss": "logistic"}, {"biased": True, "loss": "absolute"}, {"biased": True, "implicit": True}, {"biased": True, "implicit": True, "time": "time"}])
def test_gradient_methods_learn(spark, options):
    _, data = low_rank()
    frame = spark.createDataFrame([(u, i, r / 2.5) for u, i, r in data], RATINGS).withColumn("time", F.col("user") % 3)
    history = factors.sgd(frame, 2, 3, **options)["history"]
    assert history[-1] < history[0]


def test_machines(spark):
    draw = np.random.default_rng(5)
    data = []
    for k in range(200):
        a, b = int(draw.integers(4)), int(draw.integers(4))
        data.append((k, 1.0 + 0.5 * a - 0.3 * b + (1.0 if a == b else 0.0), {f"a={a}": 1.0, f"b={b}": 1.0}))
    frame = spark.createDataFrame(data, "row long, target double, features map<string,double>")
    w0, weights, history = factors.factorization_machine(frame, 3, 12)
    assert history[-1] < 0.8 * history[0]
    new = spark.createDataFrame([(1, 0.0, {"a=1": 1.0, "zzz": 1.0})], "row long, target double, features map<string,double>")
    assert factors.machine_predict(new, w0, weights, 3).count() == 1
    binary = frame.withColumn("target", (F.col("target") > 1.5).cast("double"))
    assert factors.factorization_machine(binary, 2, 8, loss="logistic")[2][-1] < 0.5


def test_climf_and_rbm(spark):
    data = [(u, i, 5.0 if (u + i) % 3 == 0 else 1.0) for u in range(12) for i in range(9)]
    frame = spark.createDataFrame(data, RATINGS)
    u, i = factors.climf(frame, 3, 5, threshold=4.0)
    scored = factors.predict(frame, u, i).groupBy((F.col("rating") > 4).alias("good")).agg(F.avg("predicted").alias("p")).collect()
    p = {r.good: r.p for r in scored}
    assert p[True] > p[False]
    early, late = (factors.rbm(frame, 4, 5, n)[1].agg(F.avg((F.col("rating") - F.col("predicted")) ** 2)).first()[0] for n in (1, 6))
    assert late < early


def test_svd(spark):
    draw = np.random.default_rng(6)
    dense = np.where(draw.random((14, 9)) < 0.6, draw.normal(size=(14, 9)), 0)
    matrix = spark.createDataFrame([(r, c, float(dense[r, c])) for r in range(14) for c in range(9) if dense[r, c]], "row long, col long, value double")
    values, left, right = factors.svd(matrix, 3)
    u, s, vt = np.linalg.svd(dense)
    assert np.allclose(values, s[:3])
    for k in range(3):
        v = np.zeros(9)
        for r in right.where(F.col("k") == k).collect():
            v[r.id] = r.val
        x = np.zeros(14)
        for r in left.where(F.col("k") == k).collect():
            x[r.id] = r.val
        assert np.allclose(np.abs(v @ vt[k]), 1) and np.allclose(dense @ v, values[k] * x, atol=1e-6) and v[np.abs(v).argmax()] > 0


def test_recommend(spark):
    draw = np.random.default_rng(7)
    p, q = draw.normal(size=(9, 3)), draw.normal(size=(20, 3))
    users = spark.createDataFrame([(u, x.tolist()) for u, x in enumerate(p)], "user long, factors array<double>")
    its = spark.createDataFrame([(i, x.tolist(), 0.1 * i) for i, x in enumerate(q)], "item long, factors array<double>, bias double")
    rated = spark.createDataFrame([(u, (u * 3 + k) % 20) for u in range(9) for k in range(4)], "user long, item long")
    got = {}
    for r in items.recommend(users, its, rated, 5, block=4).collect():
        got.setdefault(r.user, {})[r["rank"]] = r.item
    s = p @ q.T + 0.1 * np.arange(20)
    for u in range(9):
        order = [i for i in np.argsort(-s[u]) if i not in {(u * 3 + k) % 20 for k in range(4)}][:5]
        assert [got[u][k] for k in range(1, 6)] == order


def test_baselines(spark):
    frame = spark.createDataFrame([(1, 1, 4.0), (1, 2, 2.0), (2, 1, 5.0)], RATINGS)
    new = spark.createDataFrame([(1, 9), (9, 1)], "user long, item long")
    assert rows(items.baseline(frame, "user_mean", new).select("user", "item", "predicted")) == {(1, 9): 3.0, (9, 1): pytest.approx(11 / 3)}
    assert rows(items.baseline(frame, "item_mean", new, maxval=4.0).select("user", "item", "predicted")) == {(1, 9): pytest.approx(11 / 3), (9, 1): 4.0}


def test_top_k_in_order_of_arrival(spark):
    data = [(1, 1, 3), (1, 2, 4), (1, 4, 1), (1, 3, 5), (2, 1, 3), (2, 2, 4), (2, 6, 3), (3, 1, 1), (4, 2, 1), (5, 6, 1), (5, 5, 1), (5, 4, 1), (5, 3, 1)]
    frame = spark.createDataFrame([(a, b, float(v), k) for k, (a, b, v) in enumerate(data)], "from long, to long, value double, pos int")
    got = {r["from"]: r.ids for r in tables.top_k_lists(frame, 3, "pos").collect()}
    assert got == {1: [1, 2, 4], 2: [1, 2, 6], 3: [1], 4: [2], 5: [6, 5, 4]}


def test_text_functions(spark):
    frame = spark.createDataFrame([("a big, b (dog) x yy",), ("",)], "t string")
    assert [r[0] for r in frame.select(text.tokens(F.col("t"))).collect()] == [["a", "big", "dog", "yy"], []]
    one = lambda x, c: spark.createDataFrame([(x,)], "t string").select(c(F.col("t"))).first()[0]
    assert one("1.2.3.4", text.ipv4) == 16909060 and one("1.2.3.400", text.ipv4) is None
    assert one("@Bob:", text.user_name) == "bob" and one("a/b", text.user_name) is None and one("x" * 16, text.user_name) is None
    assert one("2009-06-11 16:56:42", text.epoch) == 1244739402 and one("no", text.epoch) is None
    assert [tuple(m) for m in one("RT @Ann hi @bob", text.mentions)] == [("ann", 2), ("bob", 1)]


def test_numbers(spark):
    x = spark.createDataFrame([(v,) for v in (-3.0, -0.5, 0.0, 1.2, 4.0)], "x double")
    for r in x.select("x", numeric.normal_cdf(F.col("x")).alias("p"), numeric.mills(F.col("x")).alias("v")).collect():
        p = 0.5 * (1 + math.erf(r.x / math.sqrt(2)))
        assert r.p == pytest.approx(p, abs=1e-7) and r.v == pytest.approx(math.exp(-r.x**2 / 2) / math.sqrt(2 * math.pi) / p, rel=1e-3)
    a = spark.createDataFrame([([3.0, 1.0, 2.0], [1.0, 2.0, 4.0])], "a array<double>, b array<double>")
    r = a.select(numeric.dot(F.col("a"), F.col("b")).alias("d"), numeric.norm(F.col("a")).alias("n"), numeric.sort_index(F.col("a")).alias("s"), numeric.running_sum(F.col("a")).alias("c"), numeric.outer(F.col("a"), F.col("b")).alias("o")).first()
    assert r.d == 13 and r.n == pytest.approx(math.sqrt(14)) and r.s == [1, 2, 0] and r.c == [3, 4, 6] and r.o[2] == [2, 4, 8]


def test_tweets_from_files(spark, tmp_path):
    (tmp_path / "t").write_text("T 2009-06-11 16:56:42\nU http://example.com/Bob\nW hi @Ann http://x\nT 2009-06-11 16:56:43\nU http://example.com/cy\nW RT @bob yes\n")
    records = tables.tweet_records(spark, f"file://{tmp_path}/t")
    assert {tuple(r) for r in tables.tweet_links(records).collect()} == {("bob", "ann", 1244739402, 1), ("cy", "bob", 1244739403, 2)}
    assert {tuple(r) for r in tables.tweets_per_user(records).collect()} == {("bob", 1, 1), ("cy", 1, 0)}


def test_models(spark):
    lines = spark.createDataFrame([(k, "cat dog pet " * 5 if k % 2 else "tax law court " * 5) for k in range(20)], "line long, text string")
    described, shares = models.topics(lines, 2, 20, 10)
    best = {r.line: max(range(2), key=lambda i: r.shares[i]) for r in shares.collect()}
    assert len({best[k] for k in range(0, 20, 2)}) == 1 and best[0] != best[1] and described.count() == 12
    clicks = spark.createDataFrame([(k, 1 if k % 2 else -1, [f"f{k % 2}", "all"]) for k in range(100)], "row long, target int, features array<string>")
    belief = {r.feature: r.mean for r in models.click_model(clicks, 4).collect()}
    assert belief["f1"] > 0.2 and belief["f0"] < -0.2 and abs(belief["all"]) < 0.1


def test_passes_store_what_gradients_read(spark):
    from lattica.plans.store import recorded

    _, data = low_rank()
    with recorded() as paths:
        factors.sgd(spark.createDataFrame(data, RATINGS), 2, 1, biased=True)
    passes = [p for p in paths if "/pass-" in p]
    assert spark.read.parquet(passes[0]).columns == ["user", "item", "e", "p", "f_item"]
