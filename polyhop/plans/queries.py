"""The graph queries and the SQL that gives the same rows.

Graphs come from the test tables: G1 nation to nation, G2 orders to parts (the main one), G3 ratings of parts by
customers, G4 the acyclic part of G2, G5 users to event types. Sources are the ids 1 to 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dataflow as D
from ..sources import readers, writers
from ..sources.graph import Direction, Graph, queries_of
from ..streaming.server import QueryServer
from . import algorithms as A
from .bsp import run

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
HOPS, ROUNDS = 30, 16

G1 = """SELECT CAST(s_nationkey AS BIGINT) AS src, CAST(c_nationkey AS BIGINT) AS dst, CAST(min(1 + l_linenumber) AS BIGINT) AS w FROM lineitem
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
WHERE s_nationkey <> c_nationkey GROUP BY 1, 2"""
G2 = """SELECT CAST(l_orderkey % 2000 AS BIGINT) AS src, CAST(l_partkey % 2000 AS BIGINT) AS dst, CAST(min(1 + l_suppkey % 10) AS BIGINT) AS w
FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 2000 <> l_partkey % 2000 GROUP BY 1, 2"""
G3 = """SELECT src, dst, avg(1 + q % 5) AS obs, CASE WHEN any_value(k) = 0 THEN 'VALIDATE' ELSE 'TRAIN' END AS role FROM (
SELECT CAST(o_custkey AS BIGINT) AS src, CAST(-(l_partkey + 2) AS BIGINT) AS dst, CAST(l_quantity AS BIGINT) AS q, (o_custkey + l_partkey) % 10 AS k
FROM lineitem JOIN orders ON l_orderkey = o_orderkey) t GROUP BY src, dst"""
G4 = f"SELECT * FROM ({G2}) g WHERE src < dst"
G5 = """SELECT CAST(user_id AS BIGINT) AS src, CAST(-(k + 2) AS BIGINT) AS dst, count(*) AS w FROM events
JOIN (SELECT event_type AS t, row_number() OVER (ORDER BY event_type) - 1 AS k FROM (SELECT DISTINCT event_type FROM events) d) n ON event_type = t GROUP BY 1, 2"""
TABLES = {"lineitem": (G1, G2, G3), "orders": (), "customer": (), "supplier": (), "events": ()}


def _sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """sql over the tables of sf_dir; names are replaced, so that no view is left behind."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if t in sql}
    return spark.sql(_named(sql, frames), **frames)


def _named(sql: str, frames: dict) -> str:
    for t in frames:
        for before in ("FROM ", "JOIN "):
            sql = sql.replace(f"{before}{t}", f"{before}{{{t}}}")
    return sql


def graph(spark: SparkSession, sf_dir: str, sql: str = G2) -> Graph:
    return Graph.of(_sql(spark, sf_dir, sql))


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


E = f"e AS MATERIALIZED ({G2})"
EU = f"{E}, u AS MATERIALIZED (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e)"
V = "v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e)"
Q8 = "q AS (SELECT CAST(i - 1 AS INTEGER) AS qid, CAST(i AS BIGINT) AS source FROM range(1, 9) t(i) WHERE i IN (SELECT id FROM v))"


def eight(spark: SparkSession) -> DataFrame:
    return queries_of(spark, range(1, 9))


# graphs as such

query("load_edges", f"SELECT * FROM ({G2}) g")(lambda s, d: graph(s, d).edges)
query("nation_edges", f"SELECT * FROM ({G1}) g")(lambda s, d: graph(s, d, G1).edges)
query("event_edges", f"SELECT * FROM ({G5}) g")(lambda s, d: graph(s, d, G5).edges)
query("degrees", f"WITH {E}, {V} SELECT id, (SELECT count(*) FROM e WHERE dst = id) AS in_deg, (SELECT count(*) FROM e WHERE src = id) AS out_deg FROM v")(lambda s, d: graph(s, d).degrees())
query("num_vertices_edges", f"WITH {E}, {V} SELECT (SELECT count(*) FROM v) AS num_vertices, (SELECT count(*) FROM e) AS num_edges")(lambda s, d: graph(s, d).counts())
query("reverse_edges", f"SELECT dst AS src, src AS dst, w FROM ({G2}) g")(lambda s, d: graph(s, d).reversed().edges)
query("make_undirected", f"WITH {EU} SELECT DISTINCT src, dst FROM u")(lambda s, d: graph(s, d).undirected().edges)
query("num_neighbors", f"WITH {EU} SELECT src AS id, count(DISTINCT dst) AS n FROM u GROUP BY 1")(lambda s, d: D.num_neighbors(graph(s, d)))
query("partitioned_edges", f"SELECT * FROM ({G2}) g")(lambda s, d: graph(s, d).partitioned("hybrid").edges)


@query("isolated_handling", f"WITH {E}, v AS (SELECT src AS id FROM e UNION SELECT dst FROM e UNION SELECT CAST(c_custkey AS BIGINT) FROM customer) SELECT id, id NOT IN (SELECT src FROM e UNION SELECT dst FROM e) AS isolated FROM v")
def isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("bigint").alias("id"))
    g = Graph.of(graph(spark, sf_dir).edges, more)
    deg = g.degrees()
    return deg.select("id", ((F.col("in_deg") + F.col("out_deg")) == 0).alias("isolated"))


@query("duplicate_vertices", "SELECT CAST(o_custkey AS BIGINT) AS id, sum(o_orderkey)::BIGINT AS total FROM orders GROUP BY 1")
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").cast("bigint").alias("total"))
    none = spark.createDataFrame([], "src bigint, dst bigint")
    return Graph.of(none, v, {"total": "sum"}).vertices


# multi-instance programs

BFS = """, r AS (SELECT qid, source AS id, CAST(0 AS BIGINT) AS d FROM q UNION SELECT qid, {t}.dst, d + 1 FROM r JOIN {t} ON r.id = {t}.src WHERE d < 30)"""
IBFS = "WITH RECURSIVE {e}, {v}, {q}{b} SELECT qid, id, min(d) AS hops FROM r GROUP BY 1, 2"
_ibfs = IBFS.format(e=E, v=V, q=Q8, b=BFS.format(t="e"))


def _value(df: DataFrame, name: str) -> DataFrame:
    return df.select("qid", "id", F.col("value").alias(name))


def _instances(name: str, program, column: str, oracle: str, iterations: int, k: int = 8, sql: str = G2, modes=("long", "lanes")) -> None:
    for mode in modes:
        label = f"{name}_{mode}" if mode != "long" else name
        query(label, oracle)(lambda s, d, m=mode: _value(run(program(), graph(s, d, sql), queries_of(s, range(1, k + 1)), m, iterations).df, column))


_instances("ibfs_k8", A.ibfs, "hops", _ibfs, HOPS)
query("ibfs_k8_single", _ibfs)(lambda s, d: _value(run(A.ibfs(), graph(s, d), eight(s), "single", HOPS).df, "hops"))
_instances("bbfs_k8", A.bbfs, "reached", _ibfs.replace("SELECT qid, id, min(d) AS hops FROM r GROUP BY 1, 2", "SELECT DISTINCT qid, id, true AS reached FROM r"), HOPS)
query("undirected_ibfs", IBFS.format(e=EU, v=V, q=Q8, b=BFS.format(t="u")))(lambda s, d: _value(run(A.ibfs(directed=False), graph(s, d), eight(s), "long", HOPS).df, "hops"))


def _rounds(n: int, first: str, step: str) -> str:
    """CTEs s0 ... sn: first, then step with {p} for the one before."""
    return ", ".join([f"s0 AS MATERIALIZED ({first})"] + [f"s{i} AS MATERIALIZED ({step.format(p=f's{i - 1}')})" for i in range(1, n + 1)])


def _walk(n: int, first: str, step: str, out: str, e: str = E, q: str = Q8) -> str:
    return f"WITH {e}, {V}, {q}, {_rounds(n, first, step)} {out.format(p=f's{n}')}"


_relax = "SELECT qid, id, min(x) AS x FROM (SELECT qid, id, x FROM {p} UNION ALL SELECT qid, {t}.dst, x + w FROM {p} JOIN {t} ON id = {t}.src) z GROUP BY 1, 2"
_zero = "SELECT qid, source AS id, CAST(0 AS BIGINT) AS x FROM q"
_dist = "SELECT qid, id, x AS dist FROM {p}"
_instances("sssp_k8", A.sssp, "dist", _walk(ROUNDS, _zero, _relax.replace("{t}", "e"), _dist), ROUNDS)
query("sssp_k8_single", ORACLES["sssp_k8"])(lambda s, d: _value(run(A.sssp(), graph(s, d), eight(s), "single", ROUNDS).df, "dist"))
query("sssp_undirected", _walk(ROUNDS, _zero, _relax.replace("{t}", "u"), _dist, EU))(lambda s, d: _value(run(A.sssp(directed=False), graph(s, d), eight(s), "long", ROUNDS).df, "dist"))
query("sssp_nations", _walk(ROUNDS, _zero, _relax.replace("{t}", "e"), _dist, f"e AS MATERIALIZED ({G1})"))(lambda s, d: _value(run(A.sssp(), graph(s, d, G1), eight(s), "long", ROUNDS).df, "dist"))

Q4 = Q8.replace("range(1, 9)", "range(1, 5)")
_one = "SELECT qid, source AS id, CAST(1 AS DOUBLE) AS x FROM q"
_spmv = _walk(3, _one, "SELECT qid, dst AS id, sum(x * w) AS x FROM {p} JOIN e ON id = src GROUP BY 1, 2", "SELECT qid, id, round(x, 6) AS value FROM {p} WHERE x <> 0", q=Q4)
_deg = E + ", g AS MATERIALIZED (SELECT src, count(*) AS deg FROM e GROUP BY 1)"
# shares such as 0.0006375 lie between two sixth places, where engines round differently: 1e-9 settles them upwards
_ppr_step = """SELECT qid, id, sum(x) AS x FROM (SELECT qid, dst AS id, 0.15::DOUBLE * x / deg AS x FROM {p} JOIN e ON id = e.src JOIN g ON e.src = g.src
UNION ALL SELECT qid, source, 0.85::DOUBLE FROM q) z GROUP BY 1, 2"""
_ppr = _walk(5, "SELECT qid, source AS id, 0.85::DOUBLE AS x FROM q", _ppr_step, "SELECT qid, id, round(x + 1e-9, 6) AS value FROM {p}", _deg, Q4)
for _mode in ("long", "lanes"):
    _end = "" if _mode == "long" else "_lanes"
    query(f"spmv_k4_it3{_end}", _spmv)(lambda s, d, m=_mode: run(A.spmv(), graph(s, d), queries_of(s, range(1, 5)), m, 3).df.select("qid", "id", F.round("value", 6).alias("value")))
    query(f"ppr_k4_it5{_end}", _ppr)(lambda s, d, m=_mode: run(A.ppr(), graph(s, d), queries_of(s, range(1, 5)), m, 5).df.select("qid", "id", F.round(F.col("value") + 1e-9, 6).alias("value")))
query("ppr_top10", f"SELECT qid, id, value, rank FROM (SELECT qid, id, value, CAST(row_number() OVER (PARTITION BY qid ORDER BY value DESC, id) AS INTEGER) AS rank FROM ({_ppr}) y) t WHERE rank <= 10")(lambda s, d: A.topk(QUERIES["ppr_k4_it5"](s, d), 10))

_color = """SELECT z.qid, z.id, CASE WHEN coalesce(z.acc, 0) <> 0 THEN (z.acc + 1) & ~z.acc ELSE z.old END AS x FROM (
SELECT qid, id, bit_or(m) AS acc, max(o) AS old FROM (SELECT qid, u.dst AS id, x AS m, CAST(NULL AS BIGINT) AS o FROM {p} JOIN u ON id = u.src UNION ALL SELECT qid, id, CAST(NULL AS BIGINT), x FROM {p}) y GROUP BY 1, 2) z"""
_coloring = _walk(3, "SELECT qid, source AS id, CAST(1 AS BIGINT) AS x FROM q", _color, "SELECT qid, id, x AS color FROM {p}", EU, Q4)
_instances("coloring_it3", A.coloring, "color", _coloring, 3, k=4)

# whole-graph algorithms

_pr = ", ".join(["s0 AS MATERIALIZED (SELECT id, CAST(1 AS DOUBLE) AS x FROM v)"] + [f"s{i} AS MATERIALIZED (SELECT v.id, 0.15::DOUBLE + 0.85::DOUBLE * coalesce(a.x, 0) AS x FROM v LEFT JOIN (SELECT dst, sum(x / deg) AS x FROM s{i - 1} JOIN e ON id = e.src JOIN g ON e.src = g.src GROUP BY 1) a ON v.id = a.dst)" for i in range(1, 6)])
query("pagerank_it5", f"WITH {_deg}, {V}, {_pr} SELECT id, round(x, 6) AS value FROM s5")(lambda s, d: A.pagerank(graph(s, d), 5).df.select("id", F.round("value", 6).alias("value")))
_cc = ", ".join(["s0 AS MATERIALIZED (SELECT id, id AS x FROM v)"] + [f"s{i} AS MATERIALIZED (SELECT id, min(x) AS x FROM (SELECT id, x FROM s{i - 1} UNION ALL SELECT u.dst, x FROM s{i - 1} JOIN u ON id = u.src) z GROUP BY 1)" for i in range(1, 21)])
query("components_minlabel", f"WITH {EU}, {V}, {_cc} SELECT id, x AS label FROM s20")(lambda s, d: A.components(graph(s, d), 20).df)
query("toposort_levels", f"WITH RECURSIVE e AS MATERIALIZED ({G4}), {V}, r AS (SELECT id, CAST(0 AS BIGINT) AS d FROM v UNION SELECT dst, d + 1 FROM r JOIN e ON id = src) SELECT id, max(d) AS level FROM r GROUP BY 1")(lambda s, d: A.toposort(graph(s, d, G4)))


# factorisation

_f = lambda q: ", ".join(f"((id * 31 + {k * 17} + qid * 7) % 1000 + 1000) % 1000 / 1000.0::DOUBLE AS f{k}" for k in range(5))
_fac = f"r AS MATERIALIZED ({G3}), n AS MATERIALIZED (SELECT qid, id, {_f(0)} FROM (SELECT src AS id FROM r UNION SELECT dst FROM r) i, (SELECT CAST(i AS INTEGER) AS qid FROM range(0, 2) t(i)) q)"
_dot = " + ".join(f"a.f{k} * b.f{k}" for k in range(5))
_err = f"j AS MATERIALIZED (SELECT a.qid, r.src, r.dst, r.role, obs - greatest(1.0, least(5.0, {_dot})) AS err, {', '.join(f'a.f{k} AS s{k}, b.f{k} AS d{k}' for k in range(5))} FROM r JOIN n a ON r.src = a.id JOIN n b ON r.dst = b.id AND a.qid = b.qid)"
_grad = " UNION ALL ".join(f"SELECT qid, {me} AS id, {', '.join(f'err * {o}{k} AS g{k}' for k in range(5))} FROM j WHERE role = 'TRAIN'" for me, o in (("src", "d"), ("dst", "s")))
# some sums lie just between two sixth places and come out on either side by the order of summing: 3e-13 settles them upwards
_sgd = f"WITH {_fac}, {_err}, g AS (SELECT qid, id, {', '.join(f'sum(g{k}) AS g{k}' for k in range(5))} FROM ({_grad}) z GROUP BY 1, 2) SELECT n.qid, n.id, {', '.join(f'round(n.f{k} + 0.001 * (coalesce(g.g{k}, 0) - 0.001 * n.f{k}) + 3e-13, 6) AS f{k}' for k in range(5))} FROM n LEFT JOIN g ON n.qid = g.qid AND n.id = g.id"


def _ratings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r = _sql(spark, sf_dir, G3)
    return r, A.start_factors(r, queries_of(spark, (0, 0)))


@query("cf_sgd_step1", _sgd)
def cf(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, f = _ratings(spark, sf_dir)
    return A.sgd(r, f).select("qid", "id", *[F.round(F.col(f"f{k}") + 3e-13, 6).alias(f"f{k}") for k in range(5)])


@query("cf_rmse", f"WITH {_fac}, {_err} SELECT qid, role, round(sqrt(avg(err * err)), 6) AS rmse FROM j GROUP BY 1, 2")
def cf_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rmse(*_ratings(spark, sf_dir)).select("qid", "role", F.round("rmse", 6).alias("rmse"))


# dataflow


def _ranked(spark: SparkSession, sf_dir: str) -> Graph:
    g = graph(spark, sf_dir)
    return D.transform_vertices(g, {"x": F.pmod(F.col("id") * 7, F.lit(101))})


X = f"{E}, v AS MATERIALIZED (SELECT id, id * 7 % 101 AS x FROM (SELECT src AS id FROM e UNION SELECT dst FROM e) i)"
query("transform_vertices", f"WITH {X} SELECT id, x FROM v")(lambda s, d: _ranked(s, d).vertices)
query("transform_edges", f"WITH {X} SELECT src, dst, e.w, a.x + b.x + e.w AS t FROM e JOIN v a ON src = a.id JOIN v b ON dst = b.id")(
    lambda s, d: D.transform_edges(_ranked(s, d), {"t": F.col("src_x") + F.col("dst_x") + F.col("w")}, endpoints=True).edges.select("src", "dst", "w", "t"))
query("transform_neighborhood", f"WITH {X} SELECT src, dst, CASE WHEN src IN (SELECT id FROM v WHERE x < 10) THEN -w ELSE w END AS w FROM e")(
    lambda s, d: D.transform_neighborhood(g := _ranked(s, d), D.select(g, F.col("x") < 10), {"w": -F.col("w")}).edges.select("src", "dst", "w"))
query("select_vset", f"WITH {X} SELECT id FROM v WHERE x < 10")(lambda s, d: D.select(_ranked(s, d), F.col("x") < 10))
query("map_reduce_vertices", f"WITH {X} SELECT coalesce(sum(x), 0)::BIGINT AS value FROM v")(lambda s, d: D.map_reduce_vertices(_ranked(s, d), F.col("x"), "sum", 0))
query("map_reduce_vertices_empty", "SELECT CAST(0 AS BIGINT) AS value")(lambda s, d: D.map_reduce_vertices(g := _ranked(s, d), F.col("x"), "sum", 0, D.empty_set(g)))
query("map_reduce_edges_all", f"WITH {E} SELECT (2 * sum(w))::BIGINT AS value FROM e")(lambda s, d: D.map_reduce_edges(graph(s, d), F.col("w"), "sum", 0, direction=Direction.ALL))
query("fold_edges", f"WITH {E} SELECT max(w) AS value FROM e WHERE src % 2 = 0")(lambda s, d: D.fold_edges(g := graph(s, d), F.col("w"), "max", 0, D.select(g, F.col("id") % 2 == 0), Direction.OUT))


@query("aggregator_sum", f"WITH {E} SELECT sum(w)::BIGINT AS value FROM e")
def aggregator(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = D.Aggregators()
    a.add("weight", "edges", F.sum("w"))
    return a.frame(graph(spark, sf_dir), "weight")


def _sets(op):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = _ranked(spark, sf_dir)
        return op(g, D.select(g, F.col("x") < 40), D.select(g, F.col("x") % 2 == 0))

    return f


_a, _b = "SELECT id FROM v WHERE x < 40", "SELECT id FROM v WHERE x % 2 = 0"
query("vset_union", f"WITH {X} {_a} UNION {_b}")(_sets(lambda g, a, b: D.union(a, b)))
query("vset_intersect", f"WITH {X} {_a} INTERSECT {_b}")(_sets(lambda g, a, b: D.intersect(a, b)))
query("vset_diff", f"WITH {X} {_a} EXCEPT {_b}")(_sets(lambda g, a, b: D.difference(a, b)))
query("vset_invert", f"WITH {X} SELECT id FROM v EXCEPT {_a}")(_sets(lambda g, a, b: D.invert(g, a)))
query("vset_neighbors", f"WITH {X} SELECT dst AS id FROM e WHERE src IN ({_a}) UNION SELECT src FROM e WHERE dst IN ({_a})")(_sets(lambda g, a, b: D.neighbors(g, a)))
query("gather_apply_once", f"WITH {X}, a AS (SELECT dst, sum(x * e.w) AS acc FROM e JOIN v ON src = id GROUP BY 1) SELECT id, x, (coalesce(acc, 0) + x)::BIGINT AS y FROM v LEFT JOIN a ON id = dst")(
    lambda s, d: D.gather_apply(_ranked(s, d), F.col("src_x") * F.col("w"), "sum", 0, F.col("acc") + F.col("x"), "y"))
query("map_reduce_neighborhood", f"WITH {EU} SELECT dst AS id, max(w) AS value FROM u GROUP BY 1")(lambda s, d: D.map_reduce_neighborhood(graph(s, d), F.col("w"), "max", Direction.ALL))
query("broadcast_neighborhood", f"WITH {X} SELECT dst AS id, min(x) AS value FROM e JOIN v ON src = id WHERE x < 10 GROUP BY 1")(
    lambda s, d: D.broadcast_neighborhood(g := _ranked(s, d), g.vertices.where("x < 10"), F.col("x"), "min"))


def _keyed(side: str):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        a = _ranked(spark, sf_dir).vertices
        b = graph(spark, sf_dir, G1).degrees()
        key, far = F.when(F.col("id") < 20, F.col("id")).otherwise(F.lit(-1)), F.col("id")
        if side == "left":
            return D.injective_join(a, b, key, far, {"deg": F.coalesce("right_out_deg", F.lit(0).cast("bigint"))})
        return D.injective_join(b, a, far, key, {"x": F.coalesce("right_x", F.lit(-1).cast("bigint"))})

    return f


_d1 = f"{X}, g AS ({G1}), n AS (SELECT src AS id FROM g UNION SELECT dst FROM g), m AS (SELECT id, (SELECT count(*) FROM g WHERE dst = id) AS in_deg, (SELECT count(*) FROM g WHERE src = id) AS out_deg FROM n)"
query("left_injective_join", f"WITH {_d1} SELECT v.id, x, coalesce(out_deg, 0) AS deg FROM v LEFT JOIN m ON v.id = m.id AND v.id < 20")(_keyed("left"))
query("right_injective_join", f"WITH {_d1} SELECT m.id, in_deg, out_deg, coalesce(x, -1) AS x FROM m LEFT JOIN v ON v.id = m.id AND v.id < 20")(_keyed("right"))
query("request_respond", f"WITH {X} SELECT t.id, t.target, v.x FROM (SELECT src AS id, dst + 1 AS target FROM e) t LEFT JOIN v ON target = v.id")(
    lambda s, d: D.request_respond((g := _ranked(s, d)).vertices, g.edges.select(F.col("src").alias("id"), (F.col("dst") + 1).alias("target")), ["x"]).select("id", "target", "x"))
query("neighbor_info", f"WITH {X} SELECT src, dst, w, x AS dst_x FROM e JOIN v ON dst = id")(lambda s, d: D.neighbor_info(_ranked(s, d), ["x"]).select("src", "dst", "w", "dst_x"))


def _joined(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.array_join(c, " ") for c in columns})


query("adjacency_out2inout", f"WITH {E}, {V} SELECT id, coalesce((SELECT string_agg(dst, ' ' ORDER BY dst) FROM e WHERE src = id), '') AS out_nbs, coalesce((SELECT string_agg(src, ' ' ORDER BY src) FROM e WHERE dst = id), '') AS in_nbs FROM v")(lambda s, d: _joined(D.out_to_in(graph(s, d)), "out_nbs", "in_nbs"))
query("metis_structure", f"WITH {EU} SELECT src AS id, string_agg(dst, ' ' ORDER BY dst) AS neighbours FROM (SELECT DISTINCT src, dst FROM u) z GROUP BY 1")(lambda s, d: _joined(writers.metis(graph(s, d)), "neighbours"))
query("hypergraph_structure", f"WITH {E}, {V} SELECT src AS id, string_agg(dst, ' ' ORDER BY dst) AS pins FROM (SELECT src, dst FROM e UNION SELECT id, id FROM v) z GROUP BY 1")(lambda s, d: _joined(writers.hypergraph(graph(s, d)), "pins"))
query("adjacency_lines", f"WITH {E} SELECT src || chr(9) || count(*) || ' ' || string_agg(dst || ' ' || w, ' ' ORDER BY dst, w) AS value FROM e GROUP BY src")(lambda s, d: D.adjacency_lines(graph(s, d), "w"))


@query("query_server", _ibfs)
def served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight queries that come in while others run, at most three in flight."""
    server = QueryServer(graph(spark, sf_dir), A.ibfs(), 3)
    for source in range(1, 9):
        server.submit(source)
        if source % 2 == 0:
            server.tick()
    answers = server.drain()
    server.close()
    return _value(answers, "hops")
