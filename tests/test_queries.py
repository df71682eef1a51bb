"""Every query with an SQL counterpart gives its rows, at the smallest scale; the others give rows."""

import datetime
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from lattica import queries

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x.isoformat() if isinstance(x, datetime.datetime) else x


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, database, name):
    got = queries.QUERIES[name](spark, SF)
    found = database.execute(queries.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(got.columns)
    order = sorted(columns)
    a = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=str)
    b = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in found.fetchall()), key=str)
    assert a == b


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES) - {"t_topics"}))
def test_gives_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).limit(1).count() == 1


def test_products_of_stored_floats_are_rounded_as_in_sql(spark, tmp_path):
    vectors = [(1, [1000.1, 2000.2, 3000.3]), (2, [0.1, -0.7, 1e7, 12345.678]), (3, [16777215.0, 16777215.0, 16777215.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    columns = ["vec_id", "dot", "dot3", "outer_sum", "mixed"]
    found = con.execute(f"select {', '.join(columns)} from ({queries.ORACLES['f_vectors']}) order by vec_id").fetchall()
    got = queries.QUERIES["f_vectors"](spark, str(tmp_path)).orderBy("vec_id").select(*columns).collect()
    assert [tuple(map(plain, r)) for r in got] == [tuple(map(plain, r)) for r in found]


def test_the_entry_module_stands_alone():
    import __spark_entry__

    assert set(queries.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_topics_use_the_whole_vocabulary(spark, monkeypatch):
    from pyspark.ml.clustering import LDA

    from lattica.operators.tables import token_counts

    fit, seen = LDA.fit, []
    monkeypatch.setattr(LDA, "fit", lambda self, rows: seen.append((self.getK(), self.getMaxIter(), rows.first().features.size)) or fit(self, rows))
    assert queries.QUERIES["t_topics"](spark, SF).count() == 20 * 10
    lines = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id as line", "text")
    assert seen == [(20, 10, token_counts(lines).select("token").distinct().count())]


def test_addresses_of_many_users(spark, tmp_path):
    rows = [(k, u, "t") for k, u in enumerate((0, 255, 256, 65535, 65536, 90000, 1 << 24, (1 << 24) + 70000))]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    found = con.execute(f"select src, dst, attr from ({queries.ORACLES['t_address_pairs']}) order by all").fetchall()
    assert sorted(map(tuple, queries.QUERIES["t_address_pairs"](spark, str(tmp_path)).select("src", "dst", "attr").collect())) == found


def test_matrix_files_are_written_by_many_tasks(spark):
    from lattica.sources import readers

    rows = spark.range(1, 1001, 1, 4).select((F.col("id") % 7 + 1).alias("user"), F.col("id").alias("item"), F.lit(2.5).alias("rating"))
    place = queries._market(spark, rows, "user", "item", "rating")
    assert spark.read.text(place).where("value not like '%\\%%' escape '\\\\'").select(F.input_file_name()).distinct().count() == 5
    assert readers.matrix_size(spark, place) == (7, 1000, 1000)
    assert sorted(readers.ratings(spark, place).collect()) == sorted(rows.collect())


def test_topics_of_large_vocabularies_leave_the_driver(spark, monkeypatch):
    from pyspark.ml.clustering import LDA

    from lattica.operators import models

    monkeypatch.setattr(models, "DENSE", 10)
    monkeypatch.setattr(LDA, "fit", lambda self, rows: pytest.fail("the model is on the driver"))
    lines = spark.range(400).select(F.col("id").alias("line"), F.concat_ws(" ", *[F.concat(F.when(F.col("id") % 2 == 0, "river").otherwise("stone"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(8)).cast("string")) for k in range(60)]).alias("text"))
    described, shares = models.topics(lines, k=2, passes=40, top=5)
    found = described.collect()
    assert sorted((r.topic, r["rank"]) for r in found) == [(t, n) for t in range(2) for n in range(1, 6)]
    kinds = {t: {r.token[:5] for r in found if r.topic == t} for t in range(2)}
    assert sorted(map(sorted, kinds.values())) == [["river"], ["stone"]]
    river = 0 if kinds[0] == {"river"} else 1
    got = shares.collect()
    assert len(got) == 400 and all((r.shares[river] > 0.5) == (r.line % 2 == 0) and abs(sum(r.shares) - 1) < 1e-9 for r in got)
