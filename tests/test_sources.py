import struct

import pytest

from lattica.graph import Graph, degrees
from lattica.sources import generators, readers, sinks


def write(tmp_path, name, text):
    place = tmp_path / name
    place.write_text(text)
    return f"file://{place}"


def pairs(df, *columns):
    return sorted(map(tuple, df.select(*(columns or df.columns)).collect()))


def test_edge_list(spark, tmp_path):
    path = write(tmp_path, "e", "# note\n% note\n1 2 0.5\n2\t3\n3,1,7\n4 4 1\n\nbad line\n1 2 0.5\n")
    assert pairs(readers.edge_list(spark, path), "src", "dst") == [(1, 2), (1, 2), (2, 3), (3, 1)]
    assert pairs(readers.edge_list(spark, path, default=9.0)) == [(1, 2, 0.5), (1, 2, 0.5), (2, 3, 9.0), (3, 1, 7.0)]
    assert readers.edge_list(spark, path, "boolean").where("src = 3").first().value is False
    assert readers.edge_list(spark, path, "pair").where("src = 3").first().value == (7.0, 7.0)
    assert readers.edge_list(spark, path, None).columns == ["src", "dst"]


def test_other_graph_formats(spark, tmp_path):
    assert pairs(readers.read_graph(spark, write(tmp_path, "m", "1 2 3:4:5\n2 3\n"), "multivalueedgelist")) == [(1, 2, [3, 4, 5]), (2, 3, [])]
    path = write(tmp_path, "a", "1 2 5 6\n2 3 7\n3 1 3\n")
    assert pairs(readers.read_graph(spark, path, "adjlist")) == [(1, 5), (1, 6), (2, 7)] and readers.adjacency_mismatches(spark, path) == 1
    assert pairs(readers.read_graph(spark, write(tmp_path, "c", "1 2\n5\n6\n2 1\n7\n"), "cassovary")) == [(1, 5), (1, 6), (2, 7)]
    assert pairs(readers.read_graph(spark, write(tmp_path, "t", "% c\n3 2\n2\n1 3\n2\n"), "metis")) == [(0, 1), (1, 2)]
    with pytest.raises(ValueError):
        readers.metis(spark, write(tmp_path, "w", "3 2 1\n2 1\n"))
    (tmp_path / "b").write_bytes(struct.pack("<IIfIIfIIf", 1, 2, 0.5, 3, 3, 1.0, 4294967295, 0, 2.0))
    assert pairs(readers.read_graph(spark, f"file://{tmp_path}/b", "binedgelist", value_type="float")) == [(1, 2, 0.5), (4294967295, 0, 2.0)]
    with pytest.raises(ValueError):
        readers.read_graph(spark, path, "other")


def test_converted_follows_the_input(spark, tmp_path):
    path, target = write(tmp_path, "e", "1 2\n"), f"file://{tmp_path}/out"
    assert readers.converted(spark, path, target, value_type=None).count() == 1
    assert readers.converted(spark, path, target, value_type=None).count() == 1
    import os
    import time

    write(tmp_path, "e", "1 2\n2 3\n")
    os.utime(tmp_path / "e", (time.time() + 60, time.time() + 60))
    assert readers.converted(spark, path, target, value_type=None).count() == 2


MARKET = "%%MatrixMarket matrix coordinate real general\n% c\n4 3 3\n1 1 5\n2 3 1\n4 2 2.5\n"


def test_matrix_market(spark, tmp_path):
    path = write(tmp_path, "r", MARKET)
    assert pairs(readers.ratings(spark, path)) == [(1, 1, 5.0), (2, 3, 1.0), (4, 2, 2.5)]
    assert readers.matrix_size(spark, path) == (4, 3, 3)
    assert pairs(readers.matrix(spark, path)) == [(0, 0, 5.0), (1, 2, 1.0), (3, 1, 2.5)]
    with pytest.raises(Exception, match="out of range"):
        readers.ratings(spark, path, minval=2.0).collect()
    timed = write(tmp_path, "q", "%%MatrixMarket matrix coordinate real general\n2 2 2\n1 1 7 5\n2 2 8 1\n")
    assert pairs(readers.ratings(spark, timed, fourth="time")) == [(1, 1, 7.0, 5.0), (2, 2, 8.0, 1.0)]
    sims = write(tmp_path, "s", "%%MatrixMarket matrix coordinate real general\n2 2 2\n1 2 .5\n2 2 1\n")
    assert pairs(readers.similarity(spark, sims)) == [(1, 2, 0.5)]
    dense = write(tmp_path, "d", "%%MatrixMarket matrix array real general\n2 2\n1\n2\n3\n4\n")
    assert pairs(readers.matrix(spark, dense)) == [(0, 0, 1.0), (0, 1, 3.0), (1, 0, 2.0), (1, 1, 4.0)]


def test_feature_files(spark, tmp_path):
    path = write(tmp_path, "f", "u,i,v,c,x\na,b,1.5,k,2\n")
    assert readers.feature_rows(spark, path, features=(3,), real_features=(4,), header=True).first().asDict() == {"from": "a", "to": "b", "val": 1.5, "f3": "k", "r4": 2.0}
    sparse = write(tmp_path, "s", "a b 1 x:2 y:3.5\nc d 0 z\n")
    assert {r["from"]: r.features for r in readers.sparse_rows(spark, sparse).collect()} == {"a": {"x": 2.0, "y": 3.5}, "c": {"z": 1.0}}
    assert {r["from"]: r.features for r in readers.sparse_rows(spark, sparse, keys_only=True).collect()}["a"] == {"x": 1.0, "y": 1.0}
    assert readers.node_features(spark, write(tmp_path, "n", "1\ta\tb\n")).first().features == ["a", "b"]


def test_round_trips(spark, tmp_path):
    edges, place = generators.grid(spark, 4), f"file://{tmp_path}"
    sinks.write_edges(edges, f"{place}/e")
    sinks.write_adjacency(edges, f"{place}/a")
    sinks.write_cassovary(edges.coalesce(1), f"{place}/c")
    want = pairs(edges)
    assert pairs(readers.edge_list(spark, f"{place}/e", None)) == want == pairs(readers.adjacency_list(spark, f"{place}/a")) == pairs(readers.cassovary(spark, f"{place}/c"))
    m = spark.createDataFrame([(0, 1, 2.5), (3, 0, 1.0)], "row long, col long, value double")
    sinks.write_matrix(m, f"{place}/m", 4, 2)
    assert pairs(readers.ratings(spark, f"{place}/m/entries")) == [(1, 2, 2.5), (4, 1, 1.0)]
    sinks.write_vector(spark.createDataFrame([(0, 2.0)], "id long, value double"), f"{place}/v", 1)
    sinks.write_scalar(spark, 2.5, f"{place}/x")
    assert spark.read.text(f"{place}/x/entries").first()[0] == "1 1 2.5"
    sinks.write_table(m, f"{place}/t")
    assert spark.read.parquet(f"{place}/t").count() == 2


def test_generators(spark):
    n = 5
    assert generators.chain(spark, n).count() == n - 1 and generators.grid(spark, n).count() == 2 * n * (n - 1)
    assert generators.crossgrid(spark, n).count() == 2 * n * (n - 1) + 2 * (n - 1) ** 2 and generators.cubegrid(spark, 3).count() == 3 * 9 * 2
    graph = generators.erdos_renyi(spark, 100, 0.1)
    assert 300 < graph.count() < 700 and pairs(graph) == pairs(generators.erdos_renyi(spark, 100, 0.1)) and graph.where("src = dst").count() == 0
    base, later = generators.base_and_stream(graph, 0.3)
    assert base.count() + later.count() == graph.count()
    assert generators.random_weights(graph).where("weight < 0").count() == 0
    made = generators.implicit_ratings(spark, 10, 20, 500)
    assert made.where("user between 1 and 10 and item between 1 and 20").count() == 500


def test_splits(spark):
    rows = spark.range(1000).selectExpr("id % 10 as user", "id as item", "1.0 as rating")
    parts = [readers.fold(rows, ["user", "item"], 4, k, True) for k in range(4)]
    assert sum(p.count() for p in parts) == 1000 and readers.fold(rows, ["user", "item"], 4, 0).count() == 1000 - parts[0].count()
    train, test = readers.given_n(rows, 5, 50)
    assert train.count() == 50 and test.count() == 950


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (2, 3)], "src long, dst long")
    assert pairs(degrees(edges)) == [(1, 1, 1, 2), (2, 1, 3, 4), (3, 2, 0, 2)]
    graph = Graph(edges)
    assert pairs(graph.with_dense_ids().vertices) == [(0,), (1,), (2,), (3,)]
    assert pairs(graph.without(spark.createDataFrame([(2, 3)], "src long, dst long")).edges) == [(1, 2), (2, 1)]
    gone = spark.createDataFrame([(3,)], "id long")
    assert graph.without_vertices(gone, "out").edges.count() == 4 and graph.without_vertices(gone, "in").edges.count() == 2
    assert pairs(graph.reversed().edges) == [(1, 2), (2, 1), (3, 2), (3, 2)] and graph.symmetrised().edges.count() == 4 and graph.symmetrised(False).edges.count() == 8
