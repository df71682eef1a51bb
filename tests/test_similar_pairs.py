"""Pairs of items: one shuffle of lists, and the same sums however users and items are cut."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import items

METRICS = ("pearson", "cosine", "tanimoto", "manhattan", "chebyshev", "slope_one", "log_likelihood")
SETS = ("jaccard", "adamic_adar", "resource_allocation", "asym_cosine", "probabilistic")


@pytest.fixture(scope="module")
def frame(spark):
    draw = random.Random(1)
    data = [(u, i, float(draw.randint(1, 5))) for u in range(40) for i in draw.sample(range(1 << 33, (1 << 33) + 25), 12)]
    return spark.createDataFrame([*data, (3, 1, None), (5, 1, 2.0), (6, None, 1.0), (None, 1, 1.0), (None, 2, 1.0)], "user long, item long, rating double")


def test_pairs_are_not_joined_and_pass_one_exchange(frame):
    for got in (items.set_similarity(frame, "adamic_adar"), items.rating_similarity(frame, "cosine")):
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan and plan.count("RepartitionByExpression [item_i") == 1


def test_cuts_do_not_change_sums(frame, monkeypatch):
    found = lambda: {m: {tuple(r[:2]): r[2] for r in (items.set_similarity if m in SETS else items.rating_similarity)(frame, m).collect()} for m in (*METRICS, *SETS)}
    whole = found()
    for name, value in (("LIST", 5), ("RATERS", 7), ("PAIRS", 100), ("_ENTRIES", 50)):
        monkeypatch.setattr(items, name, value)
    cut = found()
    for m in whole:
        assert whole[m].keys() == cut[m].keys() and len(whole[m]) >= 300, m
        assert all(v == pytest.approx(cut[m][k]) for k, v in whole[m].items()), m


def test_null_ratings_make_no_part(spark):
    frame = spark.createDataFrame([(1, 1, 2.0), (1, 2, None), (2, 1, 3.0), (2, 2, 4.0), (3, 1, None), (3, 3, 1.0)], "user long, item long, rating double")
    got = lambda m: {tuple(r[:2]): r[2] for r in items.rating_similarity(frame, m).collect()}
    assert got("slope_one") == {(2, 1): -1.0, (3, 1): None}
    assert got("tanimoto") == {(2, 1): pytest.approx(12 / (13 + 16 - 12)), (3, 1): None}
    assert got("chebyshev")[(2, 1)] == pytest.approx(1 / 2) and frame.where(F.col("rating").isNull()).count() == 2


def test_similarities_that_add_nothing_do_not_meet_ratings(spark, monkeypatch):
    from lattica.plans.store import recorded

    monkeypatch.setattr(items, "LIST", 2)
    r = spark.createDataFrame([(1, 1, 1.0), (1, 2, 3.0), (2, 4, 2.0), (3, 9, 1.0)], "user long, item long, rating double")
    s = spark.createDataFrame([(1, 3, 2.0), (1, 4, 1.0), (2, 3, 0.5), (4, 2, 0.9), (1, 5, 1.5), (1, 6, 3.0), (1, 2, 4.0)], "item_i long, item_j long, sim double")
    with recorded() as paths:
        got = items.from_similarity(r, s, undirected=False, rule="shifted")
    near = [p for p in paths if "/near-" in p]
    assert sum(len(x.l) for x in spark.read.parquet(near[0]).collect()) == 4  # 1 with 3, 5, 6 and 2
    assert {tuple(x[:2]): x[2] for x in got.collect()} == {(1, 3): 1.0, (1, 5): 0.5, (1, 6): 2.0}
    power = {tuple(x[:2]): x[2] for x in items.from_similarity(r, s, q=1.0).collect()}
    assert power == {(1, 3): pytest.approx(2 + 1.5), (1, 4): pytest.approx(1 + 2.7), (1, 5): 1.5, (1, 6): 3.0, (2, 1): 2.0, (2, 2): pytest.approx(1.8)}


def test_recommendations_sort_candidates_alone(spark, monkeypatch):
    draw = np.random.default_rng(4)
    f = draw.integers(-2, 3, (60, 3)).astype(float)  # many ties
    e = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(f)], "item long, factors array<double>")
    monkeypatch.setattr(items, "_ROWS", 7)
    got = items.recommend(e.withColumnRenamed("item", "user"), e, e.select(e.item.alias("user"), "item"), 4, block=25)
    s = f @ f.T
    want = {(u, k + 1): (i, s[u, i]) for u in range(60) for k, i in enumerate(sorted((i for i in range(60) if i != u), key=lambda i: (-s[u, i], i))[:4])}
    assert {(r.user, r["rank"]): (r.item, r.score) for r in got.collect()} == want
    x = np.array([[3.0, np.nan, 1.0, 2.0], [np.nan] * 4])
    assert items._kth(x, 3)[0] == 3.0 and np.isnan(items._kth(x, 2)[1]) and items._kth(x[:, 2:], 9)[0] == 2.0
