import itertools
import random

import pytest
from pyspark.sql import functions as F

from lattica.graph import Graph, dedupe
from lattica.operators import communities, components, ranking
from lattica.plans import supersteps
from lattica.sources import generators
from lattica.streaming import dynamic


def frame(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long")


def random_edges(n, m, seed):
    draw = random.Random(seed)
    return [(draw.randrange(n), draw.randrange(n)) for _ in range(m)]


def of(df, key="id"):
    return {r[key]: r[1] if df.columns[0] == key else r[0] for r in df.collect()}


def reach(edges, start):
    seen, todo = {start}, [start]
    while todo:
        x = todo.pop()
        for a, b in edges:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_components(spark, one_task):
    rows = random_edges(60, 45, 3) + [(k, k + 1) for k in range(100, 130)]
    both = rows + [(b, a) for a, b in rows]
    got = of(components.connected(frame(spark, rows), one_task=one_task))
    assert got == {v: min(reach(both, v)) for v in {x for e in rows for x in e}}
    alone = components.connected(frame(spark, [(1, 2)]), spark.range(4))
    assert of(alone) == {0: 0, 1: 1, 2: 1, 3: 3}


def test_min_label_and_histograms(spark):
    chain = generators.chain(spark, 6)
    assert of(components.min_label(chain, 2)) == {0: 0, 1: 0, 2: 0, 3: 1, 4: 2, 5: 3}
    labels = components.connected(chain.union(frame(spark, [(20, 21), (30, 30)])))
    assert {tuple(r) for r in components.label_histogram(labels, "component").collect()} == {(0, 6), (20, 2), (30, 1)}
    assert {tuple(r) for r in components.label_histogram(labels, "component", True).collect()} == {(0, 6), (20, 2)}
    assert {tuple(r) for r in components.percolation(chain).collect()} == {("site", 6, 1), ("bond", 5, 1)}


@pytest.mark.parametrize("seed", [1, 2])
def test_strongly_connected(spark, seed):
    rows = random_edges(25, 40, seed) + [(100, 101), (101, 102), (102, 100), (102, 103)]
    ids = {x for e in rows for x in e}
    far = {v: reach(rows, v) for v in ids}
    assert of(components.strongly_connected(frame(spark, rows))) == {v: min(u for u in far[v] if v in far[u]) for v in ids}


def test_triangles(spark):
    rows = random_edges(30, 140, 5)
    pairs = {tuple(sorted(e)) for e in rows if e[0] != e[1]}
    want = {}
    for a, b, c in itertools.combinations(range(30), 3):
        if {(a, b), (a, c), (b, c)} <= pairs:
            for x in (a, b, c):
                want[x] = want.get(x, 0) + 1
    assert of(communities.triangles(frame(spark, rows))) == want and sum(want.values()) % 3 == 0
    k4 = [(a, b) for a in range(4) for b in range(4) if a != b] + [(3, 9)]
    assert sum(of(communities.triangles(frame(spark, k4))).values()) == 12


def peel(rows):
    left, core, k = [e for e in rows if e[0] != e[1]], {}, 1
    ids = {x for e in rows for x in e}
    while left:
        degree = {v: sum((a == v) + (b == v) for a, b in left) for v in ids - set(core)}
        low = {v for v, d in degree.items() if d <= k}
        if not low:
            k += 1
        core |= {v: k for v in low}
        left = [e for e in left if not low & set(e)]
    return {v: core.get(v, 1 if not core else core.get(v, max(core.values()))) for v in ids}, core


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cores(spark, seed):
    rows = random_edges(25, 90, seed)
    want, closed = peel(rows)
    got = of(communities.core_numbers(frame(spark, rows)))
    assert {v: got[v] for v in closed} == closed
    table = [tuple(r) for r in communities.core_table(frame(spark, rows), communities.core_numbers(frame(spark, rows))).orderBy("core").collect()]
    assert table[-1][2] == len(want) and table[-1][3] == sum(a != b for a, b in rows)
    k4 = [(a, b) for a, b in itertools.combinations(range(4), 2)] + [(3, 9)]
    assert of(communities.core_numbers(frame(spark, k4))) == {0: 3, 1: 3, 2: 3, 3: 3, 9: 1}


@pytest.mark.parametrize("algorithm", ["boruvka", "star"])
def test_spanning_forest(spark, algorithm):
    draw = random.Random(4)
    rows = [(a, b, draw.randrange(10)) for a, b in random_edges(40, 70, 6)]
    parent = {x: x for a, b, _ in rows for x in (a, b)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    want = []
    for a, b, w in sorted(rows, key=lambda e: (e[2], min(e[:2]), max(e[:2]), e[0])):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            want.append((a, b, w))
    got = communities.spanning_forest(spark.createDataFrame(rows, "src long, dst long, weight int"), algorithm)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_pagerank(spark):
    rows = list(dict.fromkeys(e for e in random_edges(20, 60, 7) if e[0] != e[1]))
    ids, out = {x for e in rows for x in e}, {}
    for a, _ in rows:
        out[a] = out.get(a, 0) + 1
    for variant, jump in (("plain", 0.15), ("normalized", 0.15 / len(ids))):
        rank = dict.fromkeys(ids, 1.0)
        for _ in range(4):
            rank = {v: jump + 0.85 * sum(rank[a] / out[a] for a, b in rows if b == v) for v in ids}
        got = of(ranking.pagerank(frame(spark, rows), 4, variant))
        assert all(got[v] == pytest.approx(rank[v]) for v in ids)
    settled = of(ranking.pagerank(frame(spark, rows), 100, tolerance=1e-8))
    again = of(ranking.pagerank(frame(spark, rows), 2, start=ranking.pagerank(frame(spark, rows), 100, tolerance=1e-8)))
    assert all(settled[v] == pytest.approx(again[v], abs=1e-6) for v in ids)


def test_every_neighbour_is_one_step_behind(spark):
    grid = generators.grid(spark, 4)
    kernel = supersteps.Kernel(F.lit(0.0), F.col("value"), F.max, F.coalesce("message", F.lit(0.0)) + 1)
    both = Graph(grid).symmetrised().edges
    assert set(of(supersteps.run_kernel(both, kernel, 5)).values()) == {5.0}


def test_iterate_hooks_and_stop(spark):
    seen = []
    state = spark.range(3).withColumn("x", F.lit(0))

    def step(now, context):
        if context.iteration == 2:
            context.stop()
        return now.withColumn("x", F.col("x") + 1)

    out = supersteps.iterate(state, step, 10, before=lambda s, c: seen.append(c.iteration), after=lambda s, c: c.log.append({"n": c.iteration}))
    assert {r.x for r in out.collect()} == {3} and seen == [0, 1, 2]
    fixed = supersteps.iterate(state, lambda s, c: s.withColumn("x", F.least(F.col("x") + 1, F.lit(4))), 50, until=supersteps.unchanged("x"))
    assert {r.x for r in fixed.collect()} == {4}


def test_gas_walks_outward(spark):
    edges = generators.chain(spark, 8)
    start = spark.range(8).withColumn("hops", F.when(F.col("id") == 0, 0).otherwise(99))
    program = supersteps.GasProgram(F.col("nbr_hops") + 1, F.min, {"hops": F.least("hops", "gathered")}, F.col("hops") < F.col("old_hops"))
    assert of(supersteps.run_gas(edges, start, program, 20)) == {k: k for k in range(8)}
    once = supersteps.GasProgram(F.col("nbr_hops"), F.min, {"hops": F.coalesce("gathered", F.lit(-1))}, None, gather_from="out")
    assert of(supersteps.run_gas(edges, start, once, 3)) == {0: 99, 1: 99, 2: 99, 3: 99, 4: 99, 5: 99, 6: 99, 7: -1}


def test_label_and_seeded_propagation(spark):
    two = [(a, b) for g in (0, 10) for a, b in itertools.combinations(range(g, g + 5), 2)] + [(4, 10)]
    labels = of(communities.label_propagation(frame(spark, two), 10))
    assert len({labels[v] for v in range(4)}) == 1 and len({labels[v] for v in range(11, 15)}) == 1 and labels[0] != labels[11]
    seeds = spark.createDataFrame([(0, 0, 1.0), (14, 1, 1.0)], "id long, label int, prob double")
    rows = communities.seeded_propagation(Graph(frame(spark, two)).symmetrised().edges, seeds, supersteps=8).collect()
    best = {}
    for r in rows:
        best[r.id] = max(best.get(r.id, (0, 0)), (r.prob, r.label))
    assert best[1][1] == 0 and best[13][1] == 1 and best[0] == (1.0, 0)
    sums = {}
    for r in rows:
        sums[r.id] = sums.get(r.id, 0) + r.prob
    assert all(s == pytest.approx(1) for s in sums.values())


def test_co_training(spark):
    pairs = spark.createDataFrame([("cat", "purrs", 5), ("dog", "barks", 4), ("cat", "eats", 1), ("dog", "eats", 1), ("lynx", "purrs", 2)], "noun string, context string, n int")
    named = lambda *x: spark.createDataFrame([(v,) for v in x], "id string")
    got = {(r.kind, r.name): r.prob for r in communities.co_training(pairs, named("cat"), named("dog")).collect()}
    assert got["noun", "cat"] == 1 and got["noun", "dog"] == 0 and got["noun", "lynx"] > 0.9 > got["context", "eats"] > 0.1 > got["context", "barks"]


def test_walks_neighbourhood_and_order(spark):
    ring = frame(spark, [(k, (k + 1) % 100) for k in range(100)])
    visits = of(ranking.random_walks(ring, walks=10, every=50, steps=3))
    assert visits == {k: 10 for k in (1, 2, 3, 51, 52, 53)}
    seeds = spark.createDataFrame([(0,)], "id long")
    found = {tuple(r) for r in communities.neighbourhood(ring, seeds, 2).collect()}
    assert found == {(0, 1, 1), (0, 99, 1), (1, 2, 2), (98, 99, 2)} and communities.neighbourhood(ring, seeds, 2, most_edges=3).count() == 3
    assert {tuple(r) for r in communities.neighbourhood(ring, seeds, 2, undirected=False).collect()} == {(0, 1, 1), (1, 2, 2)}
    edges, mapping = ranking.order_by_degree(frame(spark, [(5, 7), (5, 9), (5, 8), (9, 8)]))
    assert of(mapping) == {7: 0, 8: 1, 9: 2, 5: 3} and edges.count() == 4


def test_dedupe(spark):
    rows = spark.createDataFrame([(1, 2, 5), (1, 2, 3), (2, 1, 9)], "src long, dst long, w int")
    assert {tuple(r) for r in dedupe(rows, F.col("w")).collect()} == {(1, 2, 3), (2, 1, 9)} and dedupe(rows).count() == 2


def test_growing_graph(spark, tmp_path):
    edges = frame(spark, [e for e in random_edges(20, 80, 9) if e[0] != e[1]])
    base, later = edges.where("src < 5"), edges.where("src >= 5")
    place = f"file://{tmp_path}/in"
    later.repartition(3).write.parquet(place)
    ranks, tops = dynamic.streaming_pagerank(spark, base, dynamic.edge_stream(spark, place), 3, 60, n=5)
    want = of(ranking.pagerank(edges, 80))
    assert len(tops) == 3 and all(len(t) == 5 for t in tops)
    assert all(want[v] == pytest.approx(x, abs=1e-4) for v, x in of(ranks).items()) and len(want) == len(of(ranks))


def test_deletion_and_compaction(spark):
    graph = dynamic.DynamicGraph(spark)
    graph.add(frame(spark, [(1, 2), (2, 2), (2, 3), (3, 4)]), "base")
    graph.add(frame(spark, [(4, 5)]), "b1")
    graph.add(frame(spark, [(4, 5)]), "b1")  # a batch that is retried replaces itself
    graph.delete(frame(spark, [(2, 3)]), "d1")
    want = [(1, 2), (3, 4), (4, 5)]
    assert sorted(map(tuple, graph.edges().collect())) == want and graph.should_compact()
    graph.compact()
    assert sorted(map(tuple, graph.edges().collect())) == want and not graph.should_compact()


def test_core_numbers_of_long_chains_and_both_ways(spark):
    chain = [(k, k + 1) for k in range(3000)]
    assert set(of(communities.core_numbers(frame(spark, chain))).values()) == {1}
    draw = random.Random(6)
    rows = [(draw.randint(0, 40), draw.randint(0, 40)) for _ in range(260)] + [(k, k + 1) for k in range(100, 108)]
    rows = [r for r in rows if r[0] != r[1]]
    assert of(communities.core_numbers(frame(spark, rows))) == of(communities.core_numbers(frame(spark, rows), one_task=0))


def test_thirty_batches_with_compactions_and_retries(spark):
    graph, want = dynamic.DynamicGraph(spark), []
    for k in range(30):
        rows = [(k, k + 1), (k, 100 + k)]
        want += rows
        graph.add(frame(spark, rows), f"batch-{k}")
        if graph.should_compact(6):
            graph.compact()
            graph.add(frame(spark, rows), f"batch-{k}")  # retried after its compaction: counts once
            graph = dynamic.DynamicGraph(spark, graph.path)  # as a restarted driver finds it
    graph.add(frame(spark, [(29, 30), (29, 129)]), "batch-29")
    assert sorted(map(tuple, graph.edges().collect())) == sorted(want)


def test_no_machine_local_folder_on_a_cluster():
    from lattica.plans import store

    class Fake:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        store.shared_dir(Fake)
