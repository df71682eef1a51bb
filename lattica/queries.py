"""Queries over the driver's tables, one per operator, each with the same computation in SQL where SQL can express it.

Graphs: `edges` links consecutive users of each day's events. Ratings: a customer rates
a part by the mean quantity ordered. Doubles are rounded to six decimals on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica import graph as G
from lattica.operators import communities, components, factors, items, metrics, models, ranking, tables
from lattica.functions import numeric
from lattica.plans import supersteps
from lattica.plans.store import shared_dir
from lattica.sources import generators, readers, sinks
from lattica.streaming import dynamic

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def edges(spark: SparkSession, sf: str) -> DataFrame:
    day = Window.partitionBy(F.to_date("ts")).orderBy("ts", "event_id")
    rows = _table(spark, sf, "events").select(F.col("user_id").alias("src"), F.lead("user_id").over(day).alias("dst"))
    return rows.where("dst is not null and src <> dst").distinct()


def weighted(spark: SparkSession, sf: str) -> DataFrame:
    return edges(spark, sf).withColumn("weight", ((F.col("src") * 31 + F.col("dst") * 17) % 101).cast("int"))


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    joined = _table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(_table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item")).agg(F.avg("l_quantity").alias("rating"))


def _r(x, name: str):
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x, 6).alias(name)


_E = """e as (select distinct src, dst from (select user_id as src, lead(user_id) over (partition by cast(ts as date) order by ts, event_id) as dst from events)
  where dst is not null and src <> dst),
se as (select src, dst from e),
v as (select src as id from e union select dst from e), sv as (select src as id from se union select dst from se),
both_se as (select src, dst from se union select dst, src from se)"""
_RATINGS = """r as (select o_custkey as u, l_partkey as i, avg(l_quantity) as x from orders join lineitem on o_orderkey = l_orderkey group by 1, 2),
t as (select * from r)"""


def _draw(*parts: str) -> str:
    """The draw() of lattica.functions.numeric in SQL; parts are SQL expressions, the first one the seed."""
    return "(('0x' || substr(md5(" + " || ':' || ".join(parts) + "), 1, 10))::bigint::double / 1099511627776)"


def _with(ctes: str, body: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{ctes}{body}"


def _place(spark: SparkSession, name: str) -> str:
    """A new path in the folder that executors share."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# graphs: structure


@_query("g_degrees", _with(_E, """ select id, (select count(*) from e where dst = id) as in_degree, (select count(*) from e where src = id) as out_degree,
  (select count(*) from e where dst = id or src = id) as degree from v"""))
def _(s, d):
    return G.degrees(edges(s, d))


@_query("g_symmetrise", _with(_E, " select src, dst from both_se"))
def _(s, d):
    return G.symmetrise(edges(s, d))


@_query("g_proper", "select user_id as src, user_id % 10 as dst from events where user_id <> user_id % 10")
def _(s, d):
    return G.proper(_table(s, d, "events").select(F.col("user_id").alias("src"), (F.col("user_id") % 10).alias("dst")))


@_query("g_dedupe_min", "select user_id as src, event_id % 7 as dst, min(value) as value from events where user_id <> event_id % 7 group by 1, 2")
def _(s, d):
    rows = _table(s, d, "events").select(F.col("user_id").alias("src"), (F.col("event_id") % 7).alias("dst"), "value")
    return G.dedupe(G.proper(rows), F.col("value"))


@_query("g_without_edges", _with(_E, " select src, dst from e where (src, dst) not in (select dst, src from e)"))
def _(s, d):
    return G.Graph(edges(s, d)).without(G.reverse(edges(s, d))).edges


@_query("g_without_vertices", _with(_E, " select src, dst from e where src % 3 <> 0 and dst % 3 <> 0"))
def _(s, d):
    return G.Graph(edges(s, d)).without_vertices(G.ids_of(edges(s, d)).where("id % 3 = 0")).edges


@_query("g_append", _with(_E, " select src, dst from e union all select src, dst from se"))
def _(s, d):
    return G.Graph(edges(s, d)).append(edges(s, d)).edges


@_query("g_dense_ids", _with(_E, " select id from range((select max(greatest(src, dst)) + 1 from e)) x(id)"))
def _(s, d):
    return G.Graph(edges(s, d)).with_dense_ids().vertices


@_query("g_adjacency", _with(_E, " select src as id, count(*) as n, list_sort(list(dst)) as targets from se group by 1"))
def _(s, d):
    return sinks.adjacency(edges(s, d))


@_query("g_order_by_degree", _with(_E, """, deg as (select id, (select count(*) from se where dst = id or src = id) as n from sv), m as (select id, row_number() over (order by n, id) - 1 as k from deg)
  select a.k as src, b.k as dst from se join m a on a.id = src join m b on b.id = dst"""))
def _(s, d):
    return ranking.order_by_degree(edges(s, d))[0]


@_query("g_top_degree", _with(_E, " select id, count(*) as degree from (select src as id from e union all select dst from e) group by id order by degree desc, id limit 20"))
def _(s, d):
    return ranking.top(G.degrees(edges(s, d)).select("id", "degree"), "degree", 20)


@_query("g_frontier", _with(_E, " select distinct dst as id from se where src % 5 = 0"))
def _(s, d):
    e = edges(s, d)
    return supersteps.active(G.ids_of(e).where("id % 5 = 0"), e)


@_query("g_common_neighbours", _with(_E, """ select p.src as a, p.dst as b, list_sort(list(x.dst)) as common from se p join e x on x.src = p.src join e y on y.src = p.dst and y.dst = x.dst group by 1, 2"""))
def _(s, d):
    return tables.intersect_neighbours(edges(s, d), edges(s, d).select(F.col("src").alias("a"), F.col("dst").alias("b")))


@_query("g_vertex_sum", _with(_E, " select sum(id)::bigint as total, count(*) as n from v"))
def _(s, d):
    return G.ids_of(edges(s, d)).agg(F.sum("id").alias("total"), F.count("*").alias("n"))


@_query("g_degree_of", _with(_E, """, g as (select id, (select count(*) from e where dst = id) as in_degree, (select count(*) from e where src = id) as out_degree from v)
  select (select sum(in_degree)::bigint from g) as total_in, (select sum(out_degree)::bigint from g) as total_out, (select count(*) from g) as n_vertices,
  id, in_degree, out_degree, in_degree + out_degree as degree from g where id = 1"""))
def _(s, d):
    return readers.degree_of(G.degrees(edges(s, d)), 1)


@_query("g_gather_max", _with(_E, " select dst as id, max(src) as message from se group by dst"))
def _(s, d):
    e = edges(s, d)
    return supersteps.messages(e, G.ids_of(e).withColumn("value", F.col("id")), F.col("value"), F.max)


@_query("g_edge_aggregate", _with(_E, """, deg as (select id, (select count(*) from e where dst = id or src = id) as n from v)
  select sum(a.n * b.n)::bigint as total from e join deg a on a.id = src join deg b on b.id = dst"""))
def _(s, d):
    e = edges(s, d)
    g = G.degrees(e).select("id", "degree")
    return e.join(g.select(F.col("id").alias("src"), F.col("degree").alias("a")), "src").join(g.select(F.col("id").alias("dst"), F.col("degree").alias("b")), "dst").agg(F.sum(F.col("a") * F.col("b")).alias("total"))


# graphs: iteration


def _pagerank_sql(steps: int, first: str, jump: str) -> str:
    ctes = [_E, "o as (select src, count(*) as n from e group by 1)", f"p0 as (select id, {first} as rank from v)"]
    for k in range(steps):
        ctes.append(f"p{k + 1} as (select v.id, {jump} + 0.85 * coalesce(s, 0) as rank from v left join (select dst, sum(rank / n) as s from e join o using (src) join p{k} on p{k}.id = src group by dst) on dst = v.id)")
    return f"with {', '.join(ctes)} select id, round(rank, 6) as rank from p{steps}"


_NORMALIZED = _pagerank_sql(3, "1.0::double", "0.15::double / (select count(*) from v)")
_PLAIN = _pagerank_sql(3, "1.0::double", "0.15::double")


@_query("g_convergence", _PLAIN.rsplit(" select id", 1)[0] + ", ".join([""] + ["dl as (" + " union all ".join(f"select {k} as iteration, sum(abs(b.rank - a.rank)) as delta from p{k} a join p{k + 1} b using (id)" for k in range(3)) + ")"]) + " select iteration::bigint as iteration, round(delta, 6) as delta from dl")
def _(s, d):
    log = []
    ranking.pagerank(edges(s, d), 3, log=log)
    return s.createDataFrame([(x["iteration"], x["delta"]) for x in log], "iteration long, delta double").select("iteration", _r("delta", "delta"))


@_query("g_hooks", _with(_E, " select id, 7::bigint as value from v"))
def _(s, d):
    """A step that adds 1, ended by its hook after the fifth of a hundred, on a state that was set anew before the first."""
    state = G.ids_of(edges(s, d)).withColumn("value", F.lit(2).cast("long"))
    seen = []
    return supersteps.iterate(state, lambda now, _: now.withColumn("value", F.col("value") + 1), 100, before=lambda now, c: seen.append(c.iteration), after=lambda now, c: c.stop() if len(seen) == 5 else None)


@_query("g_pagerank_resumed", _pagerank_sql(5, "1.0::double", "0.15::double"))
def _(s, d):
    e = edges(s, d)
    return ranking.pagerank(e, 2, start=ranking.pagerank(e, 3)).select("id", _r("rank", "rank"))


@_query("g_pagerank", _NORMALIZED)
def _(s, d):
    return ranking.pagerank(edges(s, d), 3, "normalized").select("id", _r("rank", "rank"))


@_query("g_pagerank_plain", _PLAIN)
def _(s, d):
    return ranking.pagerank(edges(s, d), 3).select("id", _r("rank", "rank"))


@_query("g_pagerank_top", _PLAIN.replace("select id, round(rank, 6) as rank from p3", "select id, round(rank, 6) as rank from p3 order by p3.rank desc, id limit 20"))
def _(s, d):
    return ranking.top(ranking.pagerank(edges(s, d), 3), "rank").select("id", _r("rank", "rank"))


@_query("g_kernel_pagerank", _NORMALIZED)
def _(s, d):
    kernel = supersteps.Kernel(F.lit(1.0), F.col("value") / F.col("out_degree"), F.sum, 0.15 / F.col("n") + 0.85 * F.coalesce("message", F.lit(0.0)))
    return supersteps.run_kernel(edges(s, d), kernel, 3).select("id", _r("value", "rank"))


@_query("g_gas_components", _with(_E + """, reach(id, other) as (select id, id from sv union select r.id, b.dst from reach r join both_se b on b.src = r.other)""", " select id, min(other) as label from reach group by id", True))
def _(s, d):
    e = edges(s, d)
    program = supersteps.GasProgram(F.col("nbr_label"), F.min, {"label": F.least("label", "gathered")}, F.col("label") < F.col("old_label"), "all", "all")
    first = supersteps.GasProgram(F.col("nbr_label"), F.min, {"label": F.least("label", "gathered")}, F.lit(True), "all", "all")
    start = supersteps.run_gas(e, G.ids_of(e).withColumn("label", F.col("id")), first, 1)
    return supersteps.run_gas(e, start, program, 200)


_REACH = _E + ", reach(id, other) as (select id, id from sv union select r.id, b.dst from reach r join both_se b on b.src = r.other), cc as (select id, min(other) as component from reach group by id)"


@_query("g_components", _with(_REACH, " select id, component from cc", True))
def _(s, d):
    return components.connected(edges(s, d))


@_query("g_min_label", _with(_E, """, l0 as (select id, id as label from sv), l1 as (select id, least(label, coalesce((select min(x.label) from both_se join l0 x on x.id = src where dst = l0.id), label)) as label from l0),
  l2 as (select id, least(label, coalesce((select min(x.label) from both_se join l1 x on x.id = src where dst = l1.id), label)) as label from l1) select id, label from l2"""))
def _(s, d):
    return components.min_label(edges(s, d), 2)


@_query("g_label_histogram", _with(_REACH, " select component as label, count(*) as n from cc group by 1", True))
def _(s, d):
    return components.label_histogram(components.connected(edges(s, d)), "component")


@_query("g_label_histogram_compat", _with(_REACH, " select component as label, count(*) + 1 as n from cc where component <> id group by 1", True))
def _(s, d):
    return components.label_histogram(components.connected(edges(s, d)), "component", compat=True)


_SIZES = _REACH + ", sizes as (select component, count(*) as n_vertices, (select count(*) from se join cc x on x.id = src where x.component = cc.component) as n_edges from cc group by component)"


@_query("g_component_statistics", _with(_SIZES, " select component, n_vertices, n_edges from sizes", True))
def _(s, d):
    e = edges(s, d)
    return components.component_statistics(e, components.connected(e))


@_query("g_percolation", _with(_SIZES, " select 'site' as kind, n_vertices as size, count(*) as n from sizes group by 2 union all select 'bond', n_edges, count(*) from sizes group by 2", True))
def _(s, d):
    return components.percolation(edges(s, d))


@_query("g_strongly_connected", _with(_E + ", reach(id, other) as (select id, id from sv union select r.id, se.dst from reach r join se on se.src = r.other)", " select a.id, min(a.other) as component from reach a join reach b on a.id = b.other and a.other = b.id group by a.id", True))
def _(s, d):
    return components.strongly_connected(edges(s, d))


def _lpa_sql(steps: int) -> str:
    ctes = [_E, "m as (select src, dst from se union all select dst, src from se)", "l0 as (select id, id as label from sv)"]
    for k in range(steps):
        ctes.append(f"c{k} as (select dst as id, label, count(*) as n from m join l{k} on l{k}.id = src group by 1, 2), l{k + 1} as (select id, label from c{k} qualify row_number() over (partition by id order by n desc, label desc) = 1)")
    return f"with {', '.join(ctes)} select id, label from l{steps}"


@_query("g_label_propagation", _lpa_sql(3))
def _(s, d):
    return communities.label_propagation(edges(s, d), 3)


def _seeded_sql(steps: int) -> str:
    ctes = [_E, "seeds as (select id, id % 2 as label, 1.0::double as prob from sv where id % 9 = 0)", "s0 as (select * from seeds)"]
    for k in range(steps):
        ctes.append(f"""g{k} as (select src as id, label, sum(prob) as got from se join s{k} on s{k}.id = dst group by 1, 2), n{k} as (select id, label, got / sum(got) over (partition by id) as got from g{k}),
          m{k} as (select coalesce(s{k}.id, n{k}.id) as id, coalesce(s{k}.label, n{k}.label) as label, 0.15 * coalesce(prob, 0) + 0.85 * coalesce(got, 0) as prob from s{k} full join n{k} on s{k}.id = n{k}.id and s{k}.label = n{k}.label),
          s{k + 1} as (select id, label, prob / sum(prob) over (partition by id) as prob from m{k} where id not in (select id from seeds) union all select * from seeds)""")
    return f"with {', '.join(ctes)} select id, label, round(prob, 6) as prob from s{steps}"


@_query("g_seeded_propagation", _seeded_sql(3))
def _(s, d):
    e = edges(s, d)
    seeds = G.ids_of(e).where("id % 9 = 0").select("id", (F.col("id") % 2).alias("label"), F.lit(1.0).alias("prob"))
    return communities.seeded_propagation(e, seeds, supersteps=3).select("id", "label", _r("prob", "prob"))


@_query("g_co_training")
def _(s, d):
    pairs = _table(s, d, "events").groupBy(F.col("user_id").alias("noun"), F.col("event_type").alias("context")).agg(F.count("*").alias("n"))
    ids = pairs.select(F.col("noun").alias("id")).distinct()
    return communities.co_training(pairs, ids.where("id % 10 = 0"), ids.where("id % 10 = 1"), supersteps=3).select("kind", "name", _r("prob", "prob"))


@_query("g_triangles", _with(_E, """, p as (select distinct least(src, dst) as a, greatest(src, dst) as b from e), tri as (select x.a as u, x.b as v, y.b as w from p x join p y on x.b = y.a join p z on z.a = x.a and z.b = y.b)
  select id, count(*) as triangles from (select u as id from tri union all select v from tri union all select w from tri) group by id"""))
def _(s, d):
    return communities.triangles(edges(s, d))


def _core_sql(rounds: int = 60) -> str:
    """The h-index taken again and again; rounds after the fixed point change nothing."""
    ctes = [_E, "nb as materialized (select src, dst, count(*) as n from (select src, dst from e union all select dst, src from e) group by all)", "c0 as materialized (select dst as id, sum(n) as core from nb group by 1)"]
    for k in range(rounds):
        ctes.append(f"""c{k + 1} as materialized (select id, least(max(least(value, upto)), any_value(core)) as core from (
          select g.id, g.value, c.core, sum(g.n) over (partition by g.id order by g.value desc rows unbounded preceding) as upto
          from (select dst as id, core as value, sum(n) as n from nb join c{k} on c{k}.id = src group by all) g join c{k} c on c.id = g.id) group by id)""")
    return f"with {', '.join(ctes)} select id, greatest(core, 1)::int as core from c{rounds}"


@_query("g_core_numbers", _core_sql())
def _(s, d):
    return communities.core_numbers(edges(s, d))


@_query("g_core_table")
def _(s, d):
    e = edges(s, d)
    return communities.core_table(e, communities.core_numbers(e))


_FOREST = _with(_E + """, w as (select src, dst, ((src * 31 + dst * 17) % 101)::int as weight, least(src, dst) as lo, greatest(src, dst) as hi from se), one as (select * from w qualify row_number() over (partition by lo, hi order by weight, src, dst) = 1),
  k as (select *, row_number() over (order by weight, lo, hi, src, dst) as n from one),
  reach(n, here) as (select n, src from k union select r.n, case when k.src = r.here then k.dst else k.src end from reach r join k on k.n < r.n and (k.src = r.here or k.dst = r.here))""", " select src, dst, weight from k where not exists (select 1 from reach where reach.n = k.n and reach.here = k.dst)", True)


@_query("g_spanning_forest", _FOREST)
def _(s, d):
    return communities.spanning_forest(weighted(s, d))


@_query("g_spanning_forest_star", _FOREST)
def _(s, d):
    return communities.spanning_forest(weighted(s, d), "star")


@_query("g_random_walks")
def _(s, d):
    return ranking.random_walks(edges(s, d), walks=20, steps=3)


@_query("g_neighbourhood", _with(_E, """, h1 as (select src, dst from both_se where src % 50 = 0), f1 as (select distinct dst as id from h1 where dst % 50 <> 0), h2 as (select b.src, b.dst from both_se b join f1 on f1.id = b.src),
  every as (select *, 1 as hop from h1 union all select *, 2 from h2) select least(src, dst) as src, greatest(src, dst) as dst, min(hop) as hop from every group by 1, 2"""))
def _(s, d):
    e = edges(s, d)
    return communities.neighbourhood(e, G.ids_of(e).where("id % 50 = 0"), hops=2)


@_query("g_seed_edges", _with(_E, " select src, dst from e where src % 5 = 0 and dst % 5 = 0"))
def _(s, d):
    e = edges(s, d)
    return communities.seed_edges(e, G.ids_of(e).where("id % 5 = 0"))


# generators

@_query("gen_chain", "select id as src, id + 1 as dst from range(99) x(id)")
def _(s, d):
    return generators.chain(s, 100)


@_query("gen_grid", "select id as src, id + 1 as dst from range(400) x(id) where id % 20 < 19 union all select id, id + 20 from range(400) x(id) where id < 380")
def _(s, d):
    return generators.grid(s, 20)


@_query("gen_crossgrid", """select id as src, id + 1 as dst from range(400) x(id) where id % 20 < 19 union all select id, id + 20 from range(400) x(id) where id < 380
  union all select id, id + 21 from range(400) x(id) where id < 380 and id % 20 < 19 union all select id + 1, id + 20 from range(400) x(id) where id < 380 and id % 20 < 19""")
def _(s, d):
    return generators.crossgrid(s, 20)


@_query("gen_cubegrid", """select id as src, id + 1 as dst from range(1000) x(id) where id % 10 < 9 union all select id, id + 10 from range(1000) x(id) where (id // 10) % 10 < 9 union all select id, id + 100 from range(1000) x(id) where id < 900""")
def _(s, d):
    return generators.cubegrid(s, 10)


@_query("gen_quadgrid", """select id as src, id + 1 as dst from range(400) x(id) where id % 20 < 19 union all select id, id + 20 from range(400) x(id) where id < 380
  union all select id, id + 2 from range(400) x(id) where id % 20 < 18 union all select id, id + 40 from range(400) x(id) where id < 360""")
def _(s, d):
    return generators.quadgrid(s, 20)


@_query("gen_erdos_renyi", f"select case when {_draw("'1'", 'b', 'a')} < 0.5 then a else b end as src, case when {_draw("'1'", 'b', 'a')} < 0.5 then b else a end as dst from range(200) x(a), range(200) y(b) where a < b and {_draw("'1'", 'a', 'b')} < 0.05")
def _(s, d):
    return generators.erdos_renyi(s, 200, 0.05)


@_query("gen_random_weights", _with(_E, f" select src, dst, floor({_draw("'1'", 'src', 'dst')} * 100000000)::int as weight from e"))
def _(s, d):
    return generators.random_weights(edges(s, d))


@_query("gen_base_and_stream", _with(_E, f" select src, dst, case when {_draw("'1'", 'src', 'dst')} >= 0.5 then round({_draw("'2'", 'dst', 'src')}, 9) end as turn from e"))
def _(s, d):
    base, later = generators.base_and_stream(edges(s, d))
    return base.withColumn("turn", F.lit(None).cast("double")).union(later.withColumn("turn", F.round("turn", 9)))


@_query("gen_implicit_ratings", f"select floor({_draw("'1'", 'id', "'user'")} * 1500)::bigint + 1 as \"user\", floor({_draw("'1'", 'id', "'item'")} * 2000)::bigint + 1 as item, 0.0::double as rating from range(1000) x(id)")
def _(s, d):
    return generators.implicit_ratings(s, 1500, 2000, 1000)


# ratings


@_query("cf_global_mean", _with(_RATINGS, " select round(sqrt(avg((x - mu) ** 2)), 6) as rmse, round(avg(abs(x - mu)), 6) as mae, count(*) as n from r, (select avg(x) as mu from r)"))
def _(s, d):
    return metrics.errors(items.baseline(ratings(s, d), "global_mean")).select(_r("rmse", "rmse"), _r("mae", "mae"), "n")


@_query("cf_user_mean", _with(_RATINGS, " select u as \"user\", i as item, round(avg(x) over (partition by u), 6) as predicted from r"))
def _(s, d):
    return items.baseline(ratings(s, d), "user_mean").select("user", "item", _r("predicted", "predicted"))


@_query("cf_item_mean", _with(_RATINGS, " select u as \"user\", i as item, round(least(greatest(avg(x) over (partition by i), 20), 30), 6) as predicted from r"))
def _(s, d):
    return items.baseline(ratings(s, d), "item_mean", minval=20.0, maxval=30.0).select("user", "item", _r("predicted", "predicted"))


@_query("cf_error_rate", _with(_RATINGS, ", p as (select x, avg(x) over (partition by i) as m from r) select round(avg(((x >= 25) <> (m >= 25))::int), 6) as error_rate, count(*) as n from p"))
def _(s, d):
    return metrics.errors(items.baseline(ratings(s, d)), cutoff=25.0).select(_r("error_rate", "error_rate"), "n")


@_query("cf_relevant", _with(_RATINGS, ' select u as "user", i as item from r where x >= 40'))
def _(s, d):
    return ratings(s, d).where("rating >= 40").select("user", "item")


_SETS = _RATINGS + """, deg as (select u, count(*) as d from t group by 1), sz as (select i, count(*) as s from t group by 1),
p as (select a.i as item_i, b.i as item_j, count(*) as common, sum(case when d > 1 then 1 / ln(d) else 0 end) as aa, sum(1.0::double / d) as ra from t a join t b using (u) join deg using (u) where a.i > b.i group by 1, 2),
q as (select p.*, x.s as si, y.s as sj from p join sz x on x.i = item_i join sz y on y.i = item_j)"""


@_query("cf_jaccard", _with(_SETS, " select item_i, item_j, round(common / (si + sj - common), 6) as sim from q where common >= 2"))
def _(s, d):
    return items.set_similarity(ratings(s, d), "jaccard", least_common=2).select("item_i", "item_j", _r("sim", "sim"))


@_query("cf_adamic_adar", _with(_SETS, " select item_i, item_j, round(aa, 6) as sim from q where aa <> 0"))
def _(s, d):
    return items.set_similarity(ratings(s, d), "adamic_adar").select("item_i", "item_j", _r("sim", "sim"))


@_query("cf_resource_allocation", _with(_SETS, " select item_i, item_j, round(ra, 6) as sim from q"))
def _(s, d):
    return items.set_similarity(ratings(s, d), "resource_allocation").select("item_i", "item_j", _r("sim", "sim"))


@_query("cf_asym_cosine", _with(_SETS, " select item_i, item_j, round(common / (pow(si, 0.3) * pow(sj, 0.7)), 6) as sim from (select item_i, item_j, common, si, sj from q union all select item_j, item_i, common, sj, si from q)"))
def _(s, d):
    return items.set_similarity(ratings(s, d), "asym_cosine", alpha=0.3).select("item_i", "item_j", _r("sim", "sim"))


@_query("cf_probabilistic", _with(_SETS, " select item_i, item_j, round(common / si, 6) as sim from (select item_i, item_j, common, si from q union all select item_j, item_i, common, sj from q)"))
def _(s, d):
    return items.set_similarity(ratings(s, d), "probabilistic").select("item_i", "item_j", _r("sim", "sim"))


_RATED = _RATINGS + """, st as (select i, count(*) as n, sum(x) as s, sum(x * x) as ss, sum(abs(x)) as sa from t group by 1), m as (select count(distinct u) as m from t),
p as (select a.i as item_i, b.i as item_j, count(*) as common, sum(a.x * b.x) as xy, sum(abs(a.x) + abs(b.x) - abs(a.x - b.x)) as saved, avg(b.x - a.x) as slope, max(abs(a.x - b.x)) as far from t a join t b using (u) where a.i > b.i group by 1, 2),
q as (select p.*, m.m as m, x.n as ni, y.n as nj, x.s as s1, y.s as s2, x.ss as ss1, y.ss as ss2, x.sa as sa1, y.sa as sa2 from p, m, st x, st y where x.i = item_i and y.i = item_j)"""
_METRICS = {
    "pearson": "(xy / m - s1 * s2 / m / m) / sqrt((ss1 / m - (s1 / m) ** 2) * (ss2 / m - (s2 / m) ** 2))",
    "cosine": "xy / sqrt(ss1 * ss2)",
    "tanimoto": "xy / (ss1 + ss2 - xy)",
    "manhattan": "1 / (1 + sa1 + sa2 - saved)",
    "slope_one": "slope",
    "chebyshev": "1 / (1 + greatest(far, (select coalesce(max(abs(x)), 0) from t z where (z.i = item_i and z.u not in (select u from t where i = item_j)) or (z.i = item_j and z.u not in (select u from t where i = item_i)))))",
    "log_likelihood": "greatest(0, 2 * (h(ni, m) + h(m - ni, m) + h(nj, m) + h(m - nj, m) - h(common, m) - h(ni - common, m) - h(nj - common, m) - h(m - ni - nj + common, m)))",
}


def _entropy_term(sql: str) -> str:
    import re

    return re.sub(r"h\(([^,]+), m\)", r"(case when \1 > 0 then -(\1) * ln((\1) / m) else 0 end)", sql)


def _rating_query(metric: str):
    sql = _METRICS[metric] if metric != "log_likelihood" else _entropy_term(_METRICS[metric])

    @_query(f"cf_{metric}", _with(_RATED, f" select item_i, item_j, round({sql}, 6) as sim from q") if metric != "chebyshev" else None)
    def _(s, d):
        return items.rating_similarity(ratings(s, d), metric).select("item_i", "item_j", _r("sim", "sim"))


for _metric in _METRICS:
    _rating_query(_metric)


@_query("cf_top_similar", _with(_SETS, " select item_i, item_j, round(common / (si + sj - common), 6) as sim from q qualify row_number() over (partition by item_i order by common / (si + sj - common) desc, item_j) <= 5"))
def _(s, d):
    return items.set_similarity(ratings(s, d), "jaccard", k=5).select("item_i", "item_j", _r("sim", "sim"))


_W = "g as (select greatest(user_id, event_id % 150) as i, least(user_id, event_id % 150) as j, sum(value) as w from events where user_id <> event_id % 150 group by 1, 2), ends as (select id, sum(w) as s from (select i as id, w from g union all select j, w from g) group by 1)"


@_query("cf_weighted_jaccard", f"with {_W} select g.i as item_i, g.j as item_j, round(w / (a.s + b.s - w), 6) as sim from g join ends a on a.id = g.i join ends b on b.id = g.j")
def _(s, d):
    rows = _table(s, d, "events").select(F.col("user_id").alias("src"), (F.col("event_id") % 150).alias("dst"), "value")
    return items.weighted_jaccard(G.proper(rows)).select("item_i", "item_j", _r("sim", "sim"))


@_query("cf_from_similarity", _with(_SETS, """, sims as (select item_i, item_j, common / (si + sj - common) as sim from q where common >= 2), two as (select item_i, item_j, sim from sims union all select item_j, item_i, sim from sims),
  sc as (select t.u, two.item_j as i, sum(x * pow(sim, 3)) as score from t join two on two.item_i = t.i group by 1, 2)
  select sc.u as "user", sc.i as item, round(score, 6) as score from sc left join t on t.u = sc.u and t.i = sc.i where t.u is null and score <> 0 qualify row_number() over (partition by sc.u order by score desc, sc.i) <= 10"""))
def _(s, d):
    r = ratings(s, d)
    return items.from_similarity(r, items.set_similarity(r, "jaccard", least_common=2), k=10).select("user", "item", _r("score", "score"))


@_query("cf_from_similarity_shifted", _with(_SETS, """, sims as (select item_i, item_j, aa as sim from q where aa <> 0),
  sc as (select t.u, sims.item_j as i, sum(case when sim > 1 then (x - 0.5) / 0.5 * (sim - 1) end) as score from t join sims on sims.item_i = t.i group by 1, 2)
  select sc.u as "user", sc.i as item, round(score, 4) as score from sc left join t on t.u = sc.u and t.i = sc.i where t.u is null and score <> 0 qualify row_number() over (partition by sc.u order by score desc, sc.i) <= 10"""))
def _(s, d):
    r = ratings(s, d)
    got = items.from_similarity(r, items.set_similarity(r, "adamic_adar"), undirected=False, rule="shifted", k=10)
    return got.select("user", "item", F.round("score", 4).alias("score"))


_RANKED = _RATINGS + """, lists as (select u, i, x, row_number() over (partition by u order by i) as k from r), act as (select u, i from r where x >= 40)"""


def _ranked(s, d):
    r = ratings(s, d)
    ranked = r.withColumn("rank", F.row_number().over(Window.partitionBy("user").orderBy("item")))
    return ranked.select("user", "item", "rank"), r.where("rating >= 40").select("user", "item")


_HITS = _RANKED


@_query("cf_map", _with(_HITS, """, h as (select lists.u, k, count(*) over (partition by lists.u order by k) as c from lists join act using (u, i) where k <= 10), n as (select u, count(*) as n from act group by 1), ap as (select n.u, coalesce((select sum(c / k) from h where h.u = n.u), 0) / least(n, 10) as ap from n)
  select round(avg(ap), 6) as map from ap"""))
def _(s, d):
    ranked, actual = _ranked(s, d)
    return metrics.mean_average_precision(ranked, actual, 10).select(_r("map", "map"))


@_query("cf_mrr", _with(_HITS, ", f as (select u, min(k) as k from lists join act using (u, i) group by 1) select round(avg(1 / k), 6) as mrr from f"))
def _(s, d):
    ranked, actual = _ranked(s, d)
    return metrics.mean_reciprocal_rank(ranked, actual).select(_r("mrr", "mrr"))


@_query("cf_auc", "with x as (select value as s, (event_type = 'purchase')::int as y from events), g as (select s, sum(y) as p, sum(1 - y) as n from x group by s), w as (select p, n, coalesce(sum(n) over (order by s rows between unbounded preceding and 1 preceding), 0) as below from g) select round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) as auc from w")
def _(s, d):
    rows = _table(s, d, "events").select(F.col("value").alias("score"), (F.col("event_type") == "purchase").cast("int").alias("label"))
    return metrics.roc_auc(rows).select(_r("auc", "auc"))


@_query("cf_log_loss", "with x as (select least(greatest(value / 100, 1e-15), 1 - 1e-15) as p, (event_type = 'purchase')::int as y from events where value between 0 and 100) select round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 6) as log_loss from x")
def _(s, d):
    rows = _table(s, d, "events").where("value between 0 and 100").select((F.col("value") / 100).alias("predicted"), (F.col("event_type") == "purchase").cast("int").alias("label"))
    return metrics.log_loss(rows).select(_r("log_loss", "log_loss"))


def _users(found: tuple) -> DataFrame:
    return found[0].select("user", F.size("factors").alias("d"), _r(F.aggregate("factors", F.lit(0.0), lambda a, x: a + x * x), "norm"))


def _als_query(name: str, **options):
    @_query(name)
    def _(s, d):
        return _users(factors.als(ratings(s, d), 3, 2, **options))


_als_query("cf_als", lam=0.5)
_als_query("cf_als_by_count", lam=0.065, by_count=True)
_als_query("cf_als_coordinate", user_kernel=factors.coordinate_descent(0.5), item_kernel=factors.coordinate_descent(0.5))
_als_query("cf_als_sparse", user_kernel=factors.sparse(0.5, 2), item_kernel=factors.ridge(0.5))


@_query("cf_als_weighted")
def _(s, d):
    return _users(factors.als(ratings(s, d).withColumn("w", F.lit(1.0) + F.col("item") % 3), 3, 2, 0.5, weight="w"))


@_query("cf_pmf")
def _(s, d):
    return _users(factors.pmf(ratings(s, d), 3, 3, 1))


@_query("cf_als_tensor")
def _(s, d):
    return _users(factors.tensor_als(ratings(s, d).withColumn("time", F.col("user") % 4), 3, 2))


@_query("cf_nmf")
def _(s, d):
    return _users(factors.nmf(ratings(s, d), 3, 4))


def _sgd_query(name: str, scale: float = 50.0, **options):
    @_query(name)
    def _(s, d):
        r = ratings(s, d).withColumn("rating", F.col("rating") / scale)
        if options.get("time"):
            r = r.withColumn("time", F.col("user") % 4)
        got = factors.sgd(r, 3, 3, **options)
        return _users((got["users"],))


_sgd_query("cf_sgd")
_sgd_query("cf_bias_sgd", biased=True)
_sgd_query("cf_logistic_sgd", biased=True, loss="logistic")
_sgd_query("cf_absolute_sgd", biased=True, loss="absolute")
_sgd_query("cf_svdpp", biased=True, implicit=True)
_sgd_query("cf_time_svdpp", biased=True, implicit=True, time="time")


def _features(s, d) -> DataFrame:
    rows = _table(s, d, "events")
    pairs = F.map_from_entries(F.array(F.struct(F.concat(F.lit("user="), F.col("user_id") % 20), F.lit(1.0)), F.struct(F.concat(F.lit("type="), F.col("event_type")), F.lit(1.0))))
    return rows.select(F.col("event_id").alias("row"), (F.col("value") / 100).alias("target"), pairs.alias("features"))


@_query("cf_factorization_machine")
def _(s, d):
    w0, weights, _ = factors.factorization_machine(_features(s, d), 2, 3)
    return weights.select("feature", _r("w", "w"))


@_query("cf_machine_classifier")
def _(s, d):
    rows = _features(s, d).withColumn("target", (F.col("target") > 0.2).cast("double"))
    w0, weights, _ = factors.factorization_machine(rows, 2, 3, loss="logistic")
    return factors.machine_predict(rows, w0, weights, 2).select("row", _r("predicted", "predicted"))


@_query("cf_climf")
def _(s, d):
    return _users(factors.climf(ratings(s, d), 2, 2, threshold=25.0))


@_query("cf_rbm")
def _(s, d):
    return factors.rbm(ratings(s, d).withColumn("rating", F.ceil(F.col("rating") / 10)), 3, 5, 2)[1].select("user", "item", "rating", _r("predicted", "predicted"))


@_query("cf_svd")
def _(s, d):
    m = ratings(s, d).select(F.col("user").alias("row"), F.col("item").alias("col"), F.col("rating").alias("value"))
    values, _, right = factors.svd(m, 2, 6)
    return right.select("k", "id", _r("val", "val"))


@_query("cf_multiply", _with(_RATINGS, " select u as id, round(sum(x * i), 3) as val from t group by u"))
def _(s, d):
    r = ratings(s, d)
    m = r.select(F.col("user").alias("row"), F.col("item").alias("col"), F.col("rating").alias("value"))
    v = r.select(F.col("item").alias("id")).distinct().withColumn("val", F.col("id").cast("double"))
    return factors.multiply(m, v).select("id", F.round("val", 3).alias("val"))


_DOT = "list_dot_product(a.embedding::double[], b.embedding::double[])"


@_query("cf_recommend", f"with s as (select a.vec_id as \"user\", b.vec_id as item, {_DOT} as score from embeddings a, embeddings b where a.vec_id <> b.vec_id) select \"user\", item, round(score, 6) as score, row_number() over (partition by \"user\" order by score desc, item)::int as rank from s qualify rank <= 5")
def _(s, d):
    e = _table(s, d, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("factors"))
    users = e.withColumnRenamed("item", "user")
    return items.recommend(users, e, users.select("user", F.col("user").alias("item")), 5).select("user", "item", _r("score", "score"), "rank")


# reading and writing: each query writes text in the format, and reads it


_IO = "from events where user_id <> event_id % 97"


def _io(s, d) -> DataFrame:
    """src, dst and value of each event."""
    return G.proper(_table(s, d, "events").select(F.col("user_id").alias("src"), (F.col("event_id") % 97).alias("dst"), "value", "event_id"))


def _text(rows: DataFrame, line, name: str) -> str:
    place = _place(rows.sparkSession, name)
    rows.select(line.alias("value")).write.text(place)
    return place


@_query("io_edge_list", f"select user_id as src, event_id % 97 as dst, round(value, 4) as value {_IO}")
def _(s, d):
    place = _place(s, "edges")
    sinks.write_edges(_io(s, d).select("src", "dst", "value"), place)
    s.createDataFrame([("# a comment",), ("% another",), ("",), ("5 5 1.0",), ("x y",)], "value string").write.mode("append").text(place)
    return readers.edge_list(s, place).withColumn("value", F.round("value", 4))


@_query("io_multi_value", f"select user_id as src, event_id % 97 as dst, case when event_id % 3 = 0 then [] else [(event_id % 7)::int, (event_id % 5)::int] end as \"values\" {_IO}")
def _(s, d):
    line = F.concat_ws(" ", "src", "dst", F.when(F.col("event_id") % 3 > 0, F.concat_ws(":", F.col("event_id") % 7, F.col("event_id") % 5)))
    return readers.multi_value_edge_list(s, _text(_io(s, d), line, "multi"))


_IO_DISTINCT = "select distinct user_id as src, event_id % 97 as dst from events where user_id <> event_id % 97"


@_query("io_adjacency", _IO_DISTINCT)
def _(s, d):
    place = _place(s, "adjacency")
    sinks.write_adjacency(_io(s, d).select("src", "dst").distinct(), place)
    return readers.adjacency_list(s, place)


@_query("io_cassovary", _IO_DISTINCT)
def _(s, d):
    place = _place(s, "cassovary")
    sinks.write_cassovary(_io(s, d).select("src", "dst").distinct(), place)
    return readers.cassovary(s, place)


@_query("io_read_graph", "select * from (" + _IO_DISTINCT + ") where src <= 50 and dst <= 50")
def _(s, d):
    place = _place(s, "adjacency")
    sinks.write_adjacency(_io(s, d).select("src", "dst").distinct(), place)
    return readers.read_graph(s, place, "adjlist", max_vertex=50)


@_query("io_metis", "select id as src, id + 1 as dst from range(299) x(id) union all select id, id + 7 from range(293) x(id)")
def _(s, d):
    lines = s.range(300).select((F.col("id") + 1).alias("at"), F.concat_ws(" ", *[F.when((F.col("id") + k >= 0) & (F.col("id") + k < 300), F.col("id") + k + 1) for k in (-7, -1, 1, 7)]).alias("value"))
    place = _place(s, "metis")
    s.createDataFrame([(0, "300 592")], "at long, value string").union(lines).repartition(1).sortWithinPartitions("at").select("value").write.text(place)
    return readers.metis(s, place)


@_query("io_converted", f"select user_id as src, event_id % 97 as dst, round(value, 4) as value {_IO}")
def _(s, d):
    place = _place(s, "edges")
    sinks.write_edges(_io(s, d).select("src", "dst", "value"), place)
    readers.converted(s, f"{place}/part-*", f"{place}-parquet")
    return readers.converted(s, f"{place}/part-*", f"{place}-parquet").withColumn("value", F.round("value", 4))


_BANNER = "%%MatrixMarket matrix coordinate real general"


def _market(s, rows: DataFrame, *columns: str) -> str:
    """A Matrix Market folder whose entries have these columns: a file of the banner and the size line, which counts the entries, and as many files of entries as there are tasks."""
    size = rows.agg(F.concat_ws(" ", F.max(columns[0]), F.max(columns[1]), F.count("*")).alias("value"))
    head = s.createDataFrame([(0, _BANNER), (1, "% a comment")], "at int, value string").union(size.select(F.lit(2), "value"))
    place = _place(s, "market")
    head.repartition(1).sortWithinPartitions("at").select("value").write.text(f"{place}/header")
    rows.select(F.concat_ws(" ", *columns).alias("value")).write.text(f"{place}/entries")
    return f"{place}/*"


@_query("io_ratings", _with(_RATINGS, ' select u as "user", i as item, round(x, 4) as rating from r'))
def _(s, d):
    return readers.ratings(s, _market(s, ratings(s, d), "user", "item", "rating")).withColumn("rating", F.round("rating", 4))


@_query("io_ratings_timed", _with(_RATINGS, ' select u as "user", i as item, (u % 4)::double as time, round(x, 4) as rating from r where u > 20'))
def _(s, d):
    rows = ratings(s, d).withColumn("time", F.col("user") % 4)
    return readers.in_range(readers.ratings(s, _market(s, rows, "user", "item", "time", "rating"), fourth="time").withColumn("rating", F.round("rating", 4)), "user", 21, 1 << 40)


@_query("io_ratings_and_similarity", _with(_RATINGS, " select distinct i as item_i, i % 13 + 1 as item_j, 0.5::double as sim from r where i <> i % 13 + 1 and i % 13 + 1 in (select i from r)"))
def _(s, d):
    r = ratings(s, d)
    pairs = r.select("item").distinct().select("item", (F.col("item") % 13 + 1).alias("other"), F.lit(0.5).alias("sim")).union(s.createDataFrame([(1 << 30, 1, 0.5)], "item long, other long, sim double"))
    return readers.ratings_and_similarity(s, _market(s, r, "user", "item", "rating"), _market(s, pairs, "item", "other", "sim"))[1]


@_query("io_matrix_size", _with(_RATINGS, " select max(u) as height, max(i) as width, count(*) as entries from r"))
def _(s, d):
    size = readers.matrix_size(s, _market(s, ratings(s, d), "user", "item", "rating"))
    return s.createDataFrame([size], "height long, width long, entries long")


@_query("io_matrix", f"select user_id as row, event_id as col, round(value, 4) as value {_IO}")
def _(s, d):
    place = _place(s, "matrix")
    sinks.write_matrix(_io(s, d).select(F.col("src").alias("row"), F.col("event_id").alias("col"), "value"), place, 10_000, 1 << 40)
    return readers.matrix(s, f"{place}/*").withColumn("value", F.round("value", 4))


@_query("io_matrix_dense", "select id % 40 as row, id // 40 as col, case when (id % 40) % 3 = (id // 40) % 3 then ((id % 40) * 31 + id // 40)::double else 0.0::double end as value from range(1200) x(id)")
def _(s, d):
    place = _place(s, "dense")
    cells = s.range(1200).select((F.col("id") % 40).alias("row"), F.expr("id div 40").alias("col")).where("row % 3 = col % 3").withColumn("value", (F.col("row") * 31 + F.col("col")).cast("double"))
    sinks.write_dense(cells, place, 40, 30)
    return readers.matrix(s, place)


@_query("io_vector", "select event_id as row, 0::bigint as col, round(value, 4) as value from events")
def _(s, d):
    place, e = _place(s, "vector"), _table(s, d, "events")
    sinks.write_vector(e.select(F.col("event_id").alias("id"), "value"), place, 1 << 40)
    return readers.matrix(s, f"{place}/*").withColumn("value", F.round("value", 4))


@_query("io_scalar", "select 0::bigint as row, 0::bigint as col, count(*)::double as value from events")
def _(s, d):
    place = _place(s, "scalar")
    sinks.write_scalar(s, _table(s, d, "events").count(), place)
    return readers.matrix(s, f"{place}/*")


@_query("io_table", f"select user_id as src, event_id % 97 as dst, value {_IO}")
def _(s, d):
    place = _place(s, "table")
    sinks.write_table(_io(s, d).select("src", "dst", "value"), place)
    return s.read.parquet(place)


@_query("io_features", "select user_id::varchar as \"from\", event_type as \"to\", round(value, 4) as val, (event_id % 5)::varchar as f3, round(value * 2, 4) as r4 from events")
def _(s, d):
    line = F.concat_ws(",", "user_id", "event_type", "value", F.col("event_id") % 5, F.col("value") * 2)
    rows = readers.feature_rows(s, _text(_table(s, d, "events"), line, "features"), features=(3,), real_features=(4,))
    return rows.withColumn("val", F.round("val", 4)).withColumn("r4", F.round("r4", 4))


@_query("io_sparse_rows", "select user_id::varchar as \"from\", event_type as \"to\", round(value, 4) as val, 1.0::double as a, (event_id % 5)::double as b from events")
def _(s, d):
    line = F.concat_ws(" ", "user_id", "event_type", "value", F.lit("a"), F.concat(F.lit("b:"), F.col("event_id") % 5))
    rows = readers.sparse_rows(s, _text(_table(s, d, "events"), line, "sparse"))
    return rows.select("from", "to", F.round("val", 4).alias("val"), F.col("features")["a"].alias("a"), F.col("features")["b"].alias("b"))


@_query("io_node_features", "select user_id::varchar as node, [event_type, 'x'] as features from events")
def _(s, d):
    return readers.node_features(s, _text(_table(s, d, "events"), F.concat_ws("\t", "user_id", "event_type", F.lit("x")), "nodes"))


# functions


_VEC = "select vec_id, embedding::double[] as a, list_transform(embedding, lambda x, i: x * i)::double[] as b from embeddings"


@_query("f_vectors", f"""with x as ({_VEC}) select vec_id, round(list_dot_product(a, b), 6) as dot, round(list_sum(a), 6) as total, round(sqrt(list_dot_product(a, a)), 6) as norm,
  round(sqrt(list_dot_product(a, a) + list_dot_product(b, b) - 2 * list_dot_product(a, b)), 3) as far, round(list_sum(list_transform(range(1, len(a) + 1), lambda i: a[i] * b[i] * a[i])), 6) as dot3,
  round(list_sum(a[1:3]), 6) as head, round(list_sum(a[-2:]), 6) as tail, round(list_sum(a[3:4]), 6) as mid, round(list_sum(list_transform(range(1, len(a) + 1), lambda i: a[i] * (len(a) + 1 - i))), 6) as running,
  round(list_sum(a) * list_sum(b), 6) as outer_sum, round(list_sum(a) * 2 + list_sum(b) - list_sum(a), 6) as mixed, list_transform(list_grade_up(a), lambda i: (i - 1)::int) as places from x""")
def _(s, d):
    b = F.transform("embedding", lambda x, i: x * (i + 1).cast("float"))  # a product of the stored floats is a float in SQL, rounded before it is widened
    e = _table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"), b.cast("array<double>").alias("b"))
    a, b, n = F.col("a"), F.col("b"), numeric
    return e.select(
        "vec_id", _r(n.dot(a, b), "dot"), _r(n.total(a), "total"), _r(n.norm(a), "norm"), F.round(n.euclidean(n.dot(a, a), n.dot(b, b), n.dot(a, b)), 3).alias("far"), _r(n.dot3(a, b, a), "dot3"),
        _r(n.total(n.head(a, 3)), "head"), _r(n.total(n.tail(a, 2)), "tail"), _r(n.total(n.mid(a, 2, 2)), "mid"), _r(n.total(n.running_sum(a)), "running"),
        _r(n.total(F.transform(n.outer(a, b), n.total)), "outer_sum"), _r(n.total(n.minus(n.plus(n.scaled(a, 2.0), b), a)), "mixed"), n.sort_index(a).alias("places"),
    )


@_query("f_scalars", """select event_id, round(1 / (1 + exp(-x)), 6) as sigmoid, round(exp(-x * x / 2) / sqrt(2 * pi()), 6) as density, round(least(greatest(x, -1), 1), 6) as clamped, try_cast(event_type as double) as parsed,
  round(x * (0.5 + x), 6) as poly from (select event_id, event_type, value / 100 - 0.5 as x from events)""")
def _(s, d):
    e = _table(s, d, "events").select("event_id", "event_type", (F.col("value") / 100 - 0.5).alias("x"))
    x = F.col("x")
    return e.select("event_id", _r(numeric.sigmoid(x), "sigmoid"), _r(numeric.normal_density(x), "density"), _r(numeric.clamp(x, -1.0, 1.0), "clamped"), F.col("event_type").try_cast("double").alias("parsed"), _r(x * (0.5 + x), "poly"))


@_query("f_sparse", """select event_id, round(value * 2 + 3 * (event_id % 2), 6) as dot, round(value * value + (event_id % 2) * 9, 6) as squares, round(value - 2, 6) as minus_a, case when event_id % 2 = 0 then 1 else 2 end - (value = 0)::int as entries,
  round(value * 2, 6) as times_a, round(abs(value), 6) as abs_a, 5.0::double as set_c from events""")
def _(s, d):
    e = _table(s, d, "events").select("event_id", F.create_map(F.lit("a"), F.col("value"), F.lit("b"), 3.0 * (F.col("event_id") % 2)).alias("x"), F.create_map(F.lit("a"), F.lit(2.0), F.lit("b"), F.lit(1.0), F.lit("z"), F.lit(1.0)).alias("y"))
    x, y, n = F.col("x"), F.col("y"), numeric
    return e.select(
        "event_id", _r(n.sparse_dot(x, y), "dot"), _r(n.sparse_sum_squares(x), "squares"), _r(n.sparse_minus(x, y)["a"], "minus_a"), n.sparse_count(x).alias("entries"),
        _r(n.sparse_times(x, y)["a"], "times_a"), _r(n.sparse_abs(x)["a"], "abs_a"), n.sparse_set(x, F.lit("c"), F.lit(5.0))["c"].alias("set_c"),
    )


# tables and text


@_query("t_value_counts", "select event_type, count(*) as n from events group by 1")
def _(s, d):
    return tables.value_counts(_table(s, d, "events"), "event_type")


@_query("t_multi_counts", "select o_orderstatus, o_orderpriority, year(o_orderdate) as y, count(*) as n from orders group by 1, 2, 3")
def _(s, d):
    return tables.value_counts(_table(s, d, "orders").withColumn("y", F.year("o_orderdate").cast("long")), "o_orderstatus", "o_orderpriority", "y")


@_query("t_group_sums", "select user_id as \"from\", event_id % 9 as \"to\", round(sum(value), 4) as total from events where user_id <> 0 and event_id % 9 <> 0 group by 1, 2")
def _(s, d):
    rows = _table(s, d, "events").select(F.col("user_id").alias("from"), (F.col("event_id") % 9).alias("to"), "value")
    return tables.group_sums(rows, "value").withColumn("total", F.round("total", 4))


@_query("t_information", """with j as (select o_orderstatus as x, o_orderpriority as y, count(*) as n from orders group by 1, 2), t as (select sum(n) as t from j),
  hx as (select sum(-(n / t) * log2(n / t)) as h from (select x, sum(n) as n from j group by x), t), hy as (select sum(-(n / t) * log2(n / t)) as h from (select y, sum(n) as n from j group by y), t), hxy as (select sum(-(n / t) * log2(n / t)) as h from j, t)
  select round(hx.h, 6) as h_x, round(hy.h, 6) as h_y, round(hxy.h, 6) as h_xy, round(hx.h + hy.h - hxy.h, 6) as mutual from hx, hy, hxy""")
def _(s, d):
    return tables.information(_table(s, d, "orders"), "o_orderstatus", "o_orderpriority").select(*[_r(c, c) for c in ("h_x", "h_y", "h_xy", "mutual")])


@_query("t_dictionary", "select p_name as value, row_number() over (order by p_name) as id from (select distinct p_name from part where p_name is not null)")
def _(s, d):
    return tables.dictionary(_table(s, d, "part"), "p_name", 1)


@_query("t_encode", "with k as (select p_brand as value, row_number() over (order by p_brand) - 1 as id from (select distinct p_brand from part where p_size > 25)) select p_partkey, coalesce(id, -1) as brand from part left join k on p_brand = value")
def _(s, d):
    part = _table(s, d, "part")
    return tables.encode(part, "p_brand", tables.dictionary(part.where("p_size > 25"), "p_brand"), "brand", "mark").select("p_partkey", "brand")


@_query("t_consecutive", "with a as (select u, row_number() over (order by u) as k from (select distinct user_id * 1000003 as u from events)), b as (select t, row_number() over (order by t) as k from (select distinct event_type as t from events)) select a.k as \"from\", b.k as \"to\" from events join a on a.u = user_id * 1000003 join b on b.t = event_type")
def _(s, d):
    rows = _table(s, d, "events").select((F.col("user_id") * 1000003).alias("from"), F.col("event_type").alias("to"))
    return tables.consecutive(rows)[0].select("from", "to")


_TOKENS = """tok as (select doc_id as line, unnest(list_filter(list_filter(string_split_regex(text, '[ \\r\\n\\t!?@#$%^&*()\\-+.,~`''";:]+'), lambda x: x <> ''), lambda x, i: i = 1 or length(x) > 1)) as token from documents)"""


@_query("t_token_counts", f"with {_TOKENS} select line, token, count(*) as n from tok group by 1, 2 having count(*) between 2 and 50")
def _(s, d):
    return tables.token_counts(_table(s, d, "documents").select(F.col("doc_id").alias("line"), "text"), 2, 50)


@_query("t_top_k", "select user_id, event_id, value from events qualify row_number() over (partition by user_id order by value desc, event_id) <= 3")
def _(s, d):
    return tables.top_k(_table(s, d, "events"), "user_id", [F.desc("value"), "event_id"], 3).select("user_id", "event_id", "value")


@_query("t_top_k_lists", "with x as (select user_id, event_id, value from events qualify row_number() over (partition by user_id order by event_id) <= 3) select user_id as \"from\", list(event_id order by event_id) as ids, list(value order by event_id) as vals from x group by 1")
def _(s, d):
    rows = _table(s, d, "events").select(F.col("user_id").alias("from"), F.col("event_id").alias("to"), "value")
    return tables.top_k_lists(rows, 3, "to")


@_query("t_sorted_pairs", "select row_number() over (order by user_id, event_id, value desc) as at, user_id as item_i, event_id as item_j, value as sim from events")
def _(s, d):
    pairs = tables.sorted_pairs(_table(s, d, "events").select(F.col("user_id").alias("item_i"), F.col("event_id").alias("item_j"), F.col("value").alias("sim")))
    return pairs.select((F.row_number().over(Window.orderBy("item_i", "item_j", F.desc("sim")))).cast("long").alias("at"), "item_i", "item_j", "sim")


@_query("t_cumulative", "select event_id, round(sum(value) over (partition by user_id order by event_id), 4) as cumulative from events")
def _(s, d):
    return tables.cumulative(_table(s, d, "events"), "event_id", "value", ["user_id"]).select("event_id", F.round("cumulative", 4).alias("cumulative"))


@_query("t_call_records", "select user_id as \"from\", event_id % 97 as \"to\", epoch(date_trunc('second', ts))::bigint as time, event_id % 60 as duration from events")
def _(s, d):
    text = F.concat_ws("\t", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "user_id", F.col("event_id") % 97, F.lit("0"), F.col("event_id") % 60)
    return tables.call_records(_table(s, d, "events").select(text.alias("text")))


def _tweets(s, d) -> DataFrame:
    e = _table(s, d, "events")
    text = F.concat(F.lit("RT @u"), F.col("event_id") % 13, F.lit(" hello @V"), F.col("event_id") % 7, F.when(F.col("event_id") % 2 == 0, " http://x.example").otherwise(""))
    return e.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.concat(F.lit("http://example.com/User"), "user_id").alias("user"), text.alias("text"))


@_query("t_tweet_links", """select 'user' || user_id as "from", 'u' || event_id % 13 as "to", epoch(date_trunc('second', ts))::bigint as time, 2 as type from events
  union all select 'user' || user_id, 'v' || event_id % 7, epoch(date_trunc('second', ts))::bigint, 1 from events""")
def _(s, d):
    return tables.tweet_links(_tweets(s, d))


@_query("t_tweets_per_user", "select 'user' || user_id as \"user\", count(*) as n, sum((event_id % 2 = 0)::int)::bigint as with_url from events group by 1")
def _(s, d):
    return tables.tweets_per_user(_tweets(s, d))


@_query("t_address_pairs", """with x as (select 10 * 16777216::bigint + user_id as a, 192 * 16777216::bigint + event_id % 50 as b, event_type as attr from events), k as (select v, row_number() over (order by v) - 1 as id from (select a as v from x union select b from x))
  select p.id as src, q.id as dst, attr from x join k p on p.v = a join k q on q.v = b""")
def _(s, d):
    part = lambda bits: F.expr(f"user_id div {1 << bits}") % 256
    rows = _table(s, d, "events").select(F.concat_ws(".", F.expr("10 + user_id div 16777216"), part(16), part(8), part(0)).alias("src"), F.concat(F.lit("192.0.0."), F.col("event_id") % 50).alias("dst"), F.col("event_type").alias("attr"))
    return tables.address_pairs(rows)[0]


@_query("t_adjacency_of_names", "with x as (select 'n' || user_id as a, event_type as b from events), k as (select v, row_number() over (order by v) - 1 as id from (select a as v from x union select b from x)) select p.id as src, q.id as dst from x join k p on p.v = a join k q on q.v = b")
def _(s, d):
    text = F.concat(F.lit("n"), "user_id", F.lit(" 1 "), "event_type")
    return tables.adjacency_of_names(_table(s, d, "events").select(text.alias("text")))[0]


@_query("t_fold", _with(_RATINGS, f' select u as "user", i as item from r where floor({_draw("'fold'", 'u', 'i')} * 5) = 1'))
def _(s, d):
    return readers.fold(ratings(s, d), ["user", "item"], 5, 1, held_out=True).select("user", "item")


@_query("t_given_n", _with(_RATINGS, f' select u as "user", i as item from r qualify count(*) over (partition by u) >= 10 and row_number() over (partition by u order by {_draw("'1'", 'u', 'i')}, i) <= 5'))
def _(s, d):
    return readers.given_n(ratings(s, d), 5, 10)[0].select("user", "item")


@_query("t_topics")
def _(s, d):
    lines = _table(s, d, "documents").select(F.col("doc_id").alias("line"), "text")
    return models.topics(lines)[0].select("topic", "rank", "token")


@_query("t_click_model")
def _(s, d):
    e = _table(s, d, "events")
    rows = e.select(F.col("event_id").alias("row"), F.when(F.col("value") > 20, 1).otherwise(-1).alias("target"), F.array(F.concat(F.lit("t="), "event_type"), F.concat(F.lit("u="), F.col("user_id") % 10)).alias("features"))
    return models.click_model(rows, 2).select("feature", _r("mean", "mean"), _r("variance", "variance"))


# streams


def _resumed_sql(batches: int = 3, supersteps: int = 2) -> str:
    """PageRank resumed after each batch of edges and once more at the end."""
    ctes, last = [_E, "parts as (select src, dst, (src * 31 + dst * 17) % 5 as m from e)"], None
    for b in [*range(1, batches + 1), batches + 1]:
        top = 1 + min(b, batches)
        ctes += [f"e{b} as (select src, dst from parts where m <= {top})", f"o{b} as (select src, count(*) as n from e{b} group by 1)", f"v{b} as (select src as id from e{b} union select dst from e{b})"]
        ctes.append(f"r{b}_0 as (select v{b}.id, {'1.0::double' if last is None else 'coalesce(rank, 0.15)'} as rank from v{b} {'' if last is None else f'left join {last} using (id)'})")
        for k in range(supersteps):
            ctes.append(f"r{b}_{k + 1} as (select v{b}.id, 0.15 + 0.85 * coalesce(s, 0) as rank from v{b} left join (select dst, sum(rank / n) as s from e{b} join o{b} using (src) join r{b}_{k} on id = src group by dst) on dst = v{b}.id)")
        last = f"r{b}_{supersteps}"
    return f"with {', '.join(ctes)} select id, round(rank, 6) as rank from {last}"


@_query("s_pagerank", _resumed_sql())
def _(s, d):
    every = edges(s, d).withColumn("m", (F.col("src") * 31 + F.col("dst") * 17) % 5)
    place = _place(s, "stream")
    for k in (2, 3, 4):  # files in the order of their arrival
        every.where(F.col("m") == k).select("src", "dst").coalesce(1).write.mode("append").parquet(place)
    ranks, _ = dynamic.streaming_pagerank(s, every.where("m < 2").select("src", "dst"), dynamic.edge_stream(s, place), supersteps=2, final_supersteps=2, most_parts=2)
    return ranks.select("id", _r("rank", "rank"))


@_query("s_compaction", _with(_E, " select src, dst from e where (src * 31 + dst * 17) % 5 <> 3"))
def _(s, d):
    every = edges(s, d).withColumn("m", (F.col("src") * 31 + F.col("dst") * 17) % 5)
    graph = dynamic.DynamicGraph(s)
    for k in range(5):
        graph.add(every.where(F.col("m") == k), f"batch-{k}")
        if k == 3:
            graph.delete(every.where("m = 3"), "gone")
            graph.compact()
    graph.add(every.where("m = 2"), "batch-2")  # a batch that is retried after its compaction
    graph.compact()
    return dynamic.DynamicGraph(s, graph.path).edges()  # as a restarted driver finds it


@_query("s_windowed_counts", "select time_bucket(interval '6 hours', ts) as start, time_bucket(interval '6 hours', ts) + interval '6 hours' as \"end\", event_type, count(*) as n from events group by 1, 2, 3")
def _(s, d):
    return dynamic.windowed_counts(_table(s, d, "events"), "ts", "6 hours", by=["event_type"])
