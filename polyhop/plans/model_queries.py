"""Queries for what runs can do besides plain programs (keys, hooks, aggregates, blocks), and SQL in rounds for the
algorithms whose number of rounds is known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spread import RANGE, spread_sql
from ..operators import dataflow as D
from ..sources import readers
from ..sources.graph import Direction, queries_of
from ..streaming.server import QueryServer
from . import algorithms as A
from .blocks import run_blocks
from .bsp import VertexProgram, Watch, run
from .queries import BFS, E, G1, IBFS, ORACLES, Q8, V, _deg, _fac, _ratings, _rounds, graph, query

E1 = f"e AS MATERIALIZED ({G1})"


def bfs_sql(hops: int) -> str:
    return IBFS.format(e=E, v=V, q=Q8, b=BFS.format(t="e").replace("d < 30", f"d < {hops}"))


# keys, hooks and aggregates

_keyed = f"""WITH {E}, {V}, {Q8}, a AS (SELECT qid, dst AS id, min(w) AS x FROM q JOIN e ON src = source GROUP BY 1, 2),
k AS (SELECT qid, dst AS id, w % 3 AS k, min(x + w) AS m FROM a JOIN e ON id = src GROUP BY 1, 2, 3),
b AS (SELECT qid, id, sum(m)::BIGINT AS x FROM k GROUP BY 1, 2), s AS (SELECT qid, source AS id, CAST(0 AS BIGINT) AS x FROM q)
SELECT qid, id, x AS value FROM s UNION ALL SELECT qid, id, x FROM a ANTI JOIN s USING (qid, id)
UNION ALL SELECT qid, id, x FROM b ANTI JOIN (SELECT qid, id FROM s UNION ALL SELECT qid, id FROM a) t USING (qid, id)"""


@query("secondary_key", _keyed)
def secondary_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages combine by the least among those of one key; a vertex reached adds up its keys."""
    added = lambda acc: F.aggregate(F.map_values(acc), F.lit(0).cast("bigint"), lambda a, x: a + x)
    program = VertexProgram(
        "keyed", lambda v, e: v + e("w"), "min", lambda old, acc, s: F.coalesce(old, added(acc)), F.lit(0), key=lambda v, e: F.pmod(e("w"), F.lit(3))
    )
    return run(program, graph(spark, sf_dir), queries_of(spark, range(1, 9)), max_iterations=2).df


@query("post_round_adds_vertices", f"SELECT qid, id, hops FROM ({bfs_sql(2)}) t UNION ALL SELECT qid, CAST(10000 + qid AS BIGINT), CAST(0 AS BIGINT) FROM (SELECT DISTINCT qid FROM ({bfs_sql(1)}) u) v")
def post_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hook that gives each instance a vertex of its own after the first superstep."""

    def hook(state: DataFrame, superstep: int) -> DataFrame | None:
        if superstep != 1:
            return None
        more = state.select("qid").distinct().select("qid", (F.col("qid") + 10_000).cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("value"), F.lit(False).alias("changed"))
        return state.unionByName(more)

    got = run(A.ibfs(), graph(spark, sf_dir), queries_of(spark, range(1, 9)), max_iterations=2, watch=Watch(post_round=hook)).df
    return got.select("qid", "id", F.col("value").alias("hops"))


@query("post_round_wakes_all", bfs_sql(2))
def wake_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vertices awake again after each superstep: the same rows, with more sent."""
    watch = Watch(post_round=lambda state, _: state.withColumn("changed", F.lit(True)))
    return run(A.ibfs(), graph(spark, sf_dir), queries_of(spark, range(1, 9)), max_iterations=2, watch=watch).df.select("qid", "id", F.col("value").alias("hops"))


@query("instances_stopped", f"SELECT * FROM ({bfs_sql(1)}) a WHERE qid % 2 = 0 UNION ALL SELECT * FROM ({bfs_sql(3)}) b WHERE qid % 2 = 1")
def instances_stopped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances that their aggregates end, after one hop or three, while the others go on."""
    most = F.max("value")
    watch = Watch(aggregates={"far": most, "odd": F.max(F.col("qid") % 2)}, stop_query=lambda a: a["far"] >= (3 if a["odd"] else 1))
    return run(A.ibfs(), graph(spark, sf_dir), queries_of(spark, range(1, 9)), max_iterations=6, watch=watch).df.select("qid", "id", F.col("value").alias("hops"))


@query("instance_aggregates", f"SELECT CAST(n AS INTEGER) AS superstep, qid, count(*) AS reached, max(hops) AS far FROM ({bfs_sql(3)}) b, range(0, 4) s(n) WHERE hops <= n GROUP BY 1, 2")
def instance_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each instance's aggregates after each superstep."""
    watch = Watch(aggregates={"reached": F.count(F.lit(1)), "far": F.max("value")})
    stats = run(A.ibfs(), graph(spark, sf_dir), queries_of(spark, range(1, 9)), max_iterations=3, watch=watch).stats
    rows = [(s["superstep"], q, a["reached"], a["far"]) for s in stats for q, a in s["aggregates"].items()]
    return spark.createDataFrame(rows, "superstep int, qid int, reached bigint, far bigint")


@query("periodic_aggregate", f"WITH {E} SELECT CAST(n AS INTEGER) AS superstep, (SELECT sum(w) FROM e)::BIGINT AS weight FROM range(0, 5) s(n) WHERE n % 2 = 0")
def periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate that is due every second superstep of a run."""
    g, a = graph(spark, sf_dir), D.Aggregators()
    a.add("weight", "edges", F.sum("w"), finalize=int)
    a.periodic("weight", 2)
    stats = run(A.ppr(), g, queries_of(spark, [1, 2]), max_iterations=4, watch=Watch(periodic=lambda step: a.tick(g, step))).stats
    return spark.createDataFrame([(s["superstep"], s["periodic"]["weight"]) for s in stats if "periodic" in s], "superstep int, weight bigint")


@query("server_aggregate", f"SELECT qid, id, hops FROM ({bfs_sql(2)}) t")
def server_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A server whose queries end when their own aggregate says so."""
    server = QueryServer(graph(spark, sf_dir), A.ibfs(), 4, aggregates={"far": F.max("value")}, stop=lambda a: a["far"] >= 2)
    for source in range(1, 9):
        server.submit(source)
    answers = server.drain()
    server.close()
    return answers.select("qid", "id", F.col("value").alias("hops"))


@query("user_index", f"WITH {E}, v AS (SELECT id, id * 7 % 101 AS x FROM (SELECT src AS id FROM e UNION SELECT dst FROM e) i) SELECT x, id FROM v WHERE x IN (3, 50, 77)")
def user_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices by a key of theirs."""
    g = D.transform_vertices(graph(spark, sf_dir), {"x": F.pmod(F.col("id") * 7, F.lit(101))})
    return D.Index(g.vertices, "x").lookup([3, 50, 77])


# blocks


def _block_queries() -> None:
    for mode in ("V", "B", "VB"):

        def labels(spark: SparkSession, sf_dir: str, mode: str = mode) -> DataFrame:
            g = graph(spark, sf_dir)
            blocks = g.vertices.select("id", F.pmod("id", F.lit(16)).alias("block"))
            got = run_blocks(g, blocks, g.vertices.select("id", F.col("id").alias("value")), mode=mode, direction=Direction.ALL)
            return got.df.select("id", F.col("value").alias("label"))

        def distances(spark: SparkSession, sf_dir: str, mode: str = mode) -> DataFrame:
            g = graph(spark, sf_dir)
            blocks = g.vertices.select("id", F.floor(F.col("id") / 100).alias("block"))
            start = spark.createDataFrame([(1, 0)], "id bigint, value bigint")
            return run_blocks(g, blocks, start, "w", mode).df.select("id", F.col("value").alias("dist"))

        query(f"block_components_{mode.lower()}", ORACLES["components_minlabel"])(labels)
        query(f"block_sssp_{mode.lower()}", f"SELECT id, dist FROM ({ORACLES['sssp_k8']}) t WHERE qid = 0")(distances)


_block_queries()

# algorithms in known rounds

_tol, _many = 1e-3, 50
_moved = f"""SELECT p.id, 0.15::DOUBLE + 0.85::DOUBLE * (p.acc + coalesce(a.more, 0)) AS rank, p.acc + coalesce(a.more, 0) AS acc,
0.15::DOUBLE + 0.85::DOUBLE * (p.acc + coalesce(a.more, 0)) - p.rank + CASE WHEN abs(p.delta) > {_tol} THEN 0 ELSE p.delta END AS delta
FROM {{p}} p LEFT JOIN (SELECT dst, sum(z.delta / deg) AS more FROM {{p}} z JOIN e ON z.id = e.src JOIN g ON e.src = g.src WHERE abs(z.delta) > {_tol} GROUP BY 1) a ON p.id = a.dst"""
_start = "SELECT id, CAST(1 AS DOUBLE) AS rank, CAST(0 AS DOUBLE) AS acc, CAST(1 AS DOUBLE) AS delta FROM v"
query("pagerank_dynamic", f"WITH {_deg}, {V}, {_rounds(_many, _start, _moved)} SELECT id, round(rank, 6) AS value FROM s{_many}")(
    lambda s, d: A.pagerank(graph(s, d), _many, _tol).df.select("id", F.round("value", 6).alias("value")))

# 25 vertices: as many rounds colour all
_turn = f"""SELECT p.id, CASE WHEN p.color IS NULL AND (n.first IS NULL OR p.h < n.first OR (p.h = n.first AND p.id < n.who)) THEN (coalesce(n.used, 0) + 1) & ~coalesce(n.used, 0) ELSE p.color END AS color, p.h
FROM {{p}} p LEFT JOIN (SELECT src, bit_or(coalesce(z.color, 0)) AS used, min(CASE WHEN z.color IS NULL THEN z.h END) AS first, arg_min(CASE WHEN z.color IS NULL THEN z.id END, CASE WHEN z.color IS NULL THEN z.h END) AS who
FROM u JOIN {{p}} z ON u.dst = z.id GROUP BY 1) n ON p.id = n.src"""
_uncoloured = f"SELECT id, CAST(NULL AS BIGINT) AS color, {spread_sql('id', 0)} AS h FROM v"
_both = "u AS MATERIALIZED (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"
query("proper_coloring", f"WITH {E1}, {_both}, {V}, {_rounds(25, _uncoloured, _turn)} SELECT id, color FROM s25")(
    lambda s, d: A.proper_coloring(graph(s, d, G1)).df.select("id", A.color_bit(F.col("color")).alias("color")))
query("proper_coloring_conflicts", f"WITH {E}, {V} SELECT count(*) AS vertices, CAST(0 AS BIGINT) AS uncoloured, CAST(0 AS BIGINT) AS conflicts FROM v")(lambda s, d: _conflicts(s, d))


def _conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    got = A.proper_coloring(g).df
    near = g.edges.join(got.select(F.col("id").alias("src"), F.col("color").alias("a")), "src").join(got.select(F.col("id").alias("dst"), F.col("color").alias("b")), "dst")
    bad = near.agg(F.count_if(F.col("a") == F.col("b")).alias("conflicts"))
    return got.agg(F.count(F.lit(1)).alias("vertices"), F.count_if(F.col("color").isNull()).alias("uncoloured")).join(F.broadcast(bad))  # one row each


def _voronoi_sql(rate: float = 0.01, growth: float = 2.0, hops: int = 10, rounds: int = 6, seed: int = 7) -> str:
    steps = []
    for r in range(rounds):
        share = int(min(1.0, rate * growth**r) * RANGE)
        steps.append(f"SELECT id, CASE WHEN block IS NULL AND {spread_sql('id', seed + r)} < {share} THEN id ELSE block END AS block FROM {{p}}")
        steps += ["SELECT p.id, coalesce(p.block, n.near) AS block FROM {p} p LEFT JOIN (SELECT dst, min(block) AS near FROM {p} z JOIN u ON z.id = u.src WHERE block IS NOT NULL GROUP BY 1) n ON p.id = n.dst"] * hops
    parts = ["s0 AS MATERIALIZED (SELECT id, CAST(NULL AS BIGINT) AS block FROM v)"]
    parts += [f"s{i} AS MATERIALIZED ({step.format(p=f's{i - 1}')})" for i, step in enumerate(steps, 1)]
    last = f"s{len(steps)}"
    parts.append(f"c0 AS MATERIALIZED (SELECT id, id AS x FROM {last} WHERE block IS NULL)")
    parts += [f"c{i} AS MATERIALIZED (SELECT id, min(x) AS x FROM (SELECT id, x FROM c{i - 1} UNION ALL SELECT u.dst, x FROM c{i - 1} JOIN u ON id = src WHERE u.dst IN (SELECT id FROM c0)) z GROUP BY 1)" for i in range(1, 13)]
    return f"WITH {E}, {_both}, {V}, {', '.join(parts)} SELECT s.id, coalesce(s.block, c.x) AS block FROM {last} s LEFT JOIN c12 c ON s.id = c.id"


VORONOI = _voronoi_sql()
query("voronoi_blocks", VORONOI)(lambda s, d: A.voronoi(graph(s, d)))
WORKERS = 8
_loads = f"""WITH RECURSIVE b AS MATERIALIZED (SELECT block, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, block) AS i FROM ({VORONOI}) t GROUP BY 1),
r(i, block, worker, loads) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), [CAST(0 AS HUGEINT) FOR x IN range({WORKERS})]
UNION ALL SELECT b.i, b.block, w - 1, [CASE WHEN k + 1 = w THEN loads[k + 1] + b.n ELSE loads[k + 1] END FOR k IN range({WORKERS})]
FROM (SELECT *, list_position(loads, list_min(loads)) AS w FROM r) r JOIN b ON b.i = r.i + 1)
SELECT block, CAST(worker AS INTEGER) AS worker FROM r WHERE i > 0"""


@query("block_assignment", _loads)
def block_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = {r[0]: r[1] for r in A.voronoi(graph(spark, sf_dir)).groupBy("block").count().collect()}  # a row a block
    return spark.createDataFrame(sorted(A.assign_blocks(sizes, WORKERS).items()) or [], "block bigint, worker int")


_points = "p AS (SELECT CAST(c_custkey AS BIGINT) AS id, CAST(c_acctbal AS DOUBLE) AS x, CAST(c_custkey * 37 % 1009 AS DOUBLE) AS y FROM customer)"
_nth = lambda k: f"(SELECT x FROM (SELECT x, row_number() OVER (ORDER BY x) AS r, count(*) OVER () AS n FROM p) z WHERE r = CAST(ceil({k} / 4.0 * n) AS BIGINT))"
_xs = " + ".join(f"CASE WHEN x > {_nth(k)} THEN 1 ELSE 0 END" for k in (1, 2, 3))
_cuts = ", ".join(f"max(CASE WHEN r = CAST(ceil({k} / 4.0 * n) AS BIGINT) THEN y END) AS c{k}" for k in (1, 2, 3))
STR = f"""WITH {_points}, s AS MATERIALIZED (SELECT *, {_xs} AS stripe FROM p),
c AS (SELECT stripe, {_cuts} FROM (SELECT stripe, y, row_number() OVER (PARTITION BY stripe ORDER BY y) AS r, count(*) OVER (PARTITION BY stripe) AS n FROM s) z GROUP BY 1)
SELECT id, CAST(stripe * 4 + (y > c1)::INTEGER + (y > c2)::INTEGER + (y > c3)::INTEGER AS INTEGER) AS block FROM s JOIN c USING (stripe)"""


@query("str_partition", STR)
def spatial(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("bigint").alias("id"), F.col("c_acctbal").cast("double").alias("x"), F.pmod(F.col("c_custkey") * 37, F.lit(1009)).cast("double").alias("y"))
    return A.str_partition(points, 4, 4).select("id", "block")


def _powerlaw_sql(n: int = 2000, alpha: float = 2.0, seed: int = 1) -> str:
    """Degrees by inverting the distribution: 64 exact probabilities, then the integral of the tail."""
    few, top, e = readers.EXACT_DEGREES, n - 1, 1.0 - alpha
    weights = [d**-alpha for d in range(1, few + 1)]
    low, high = (few + 0.5) ** e, (top + 0.5) ** e
    total, sums = sum(weights) + (low - high) / (alpha - 1), []
    for w in weights:
        sums.append((sums[-1] if sums else 0.0) + w / total)
    exact = " + ".join(["1"] + [f"(u >= {c!r}::DOUBLE)::INTEGER" for c in sums[: few - 1]])
    far = f"floor(pow({low!r}::DOUBLE - (u - {sums[-1]!r}::DOUBLE) / {1.0 - sums[-1]!r}::DOUBLE * {low - high!r}::DOUBLE, {1.0 / e!r}::DOUBLE) + 0.5)"
    return f"""WITH h AS (SELECT id, CAST({spread_sql('id', seed)} AS DOUBLE) / {float(RANGE)!r}::DOUBLE AS u FROM range({n}) r(id)),
d AS (SELECT id, CASE WHEN u < {sums[-1]!r}::DOUBLE THEN {exact} ELSE least({far}, {top})::BIGINT END AS degree FROM h),
t AS (SELECT id, unnest(range(1, degree + 1)) AS t FROM d)
SELECT id AS src, (id + t * 2654435761) % {n} AS dst FROM t WHERE id <> (id + t * 2654435761) % {n}"""


query("powerlaw_edges", _powerlaw_sql())(lambda s, d: readers.powerlaw(s, 2000))


def _sgd_sql(steps: int) -> str:
    """Gradient steps one after the other, rounded at the end; 3e-13 as for one step."""
    f = range(A.LATENT)
    dot = " + ".join(f"a.f{k} * b.f{k}" for k in f)
    parts = [_fac.replace("n AS MATERIALIZED", "n0 AS MATERIALIZED")]
    for i in range(steps):
        sides = ", ".join(f"a.f{k} AS s{k}, b.f{k} AS d{k}" for k in f)
        parts.append(f"j{i} AS MATERIALIZED (SELECT a.qid, src, dst, obs - greatest(1.0, least(5.0, {dot})) AS err, {sides} FROM r JOIN n{i} a ON src = a.id JOIN n{i} b ON dst = b.id AND a.qid = b.qid WHERE role = 'TRAIN')")
        ends = " UNION ALL ".join(f"SELECT qid, {me} AS id, {', '.join(f'err * {o}{k} AS g{k}' for k in f)} FROM j{i}" for me, o in (("src", "d"), ("dst", "s")))
        parts.append(f"g{i} AS (SELECT qid, id, {', '.join(f'sum(g{k}) AS g{k}' for k in f)} FROM ({ends}) z GROUP BY 1, 2)")
        new = ", ".join(f"n.f{k} + 0.001 * (coalesce(g.g{k}, 0) - 0.001 * n.f{k}) AS f{k}" for k in f)
        parts.append(f"n{i + 1} AS MATERIALIZED (SELECT n.qid, n.id, {new} FROM n{i} n LEFT JOIN g{i} g ON n.qid = g.qid AND n.id = g.id)")
    return f"WITH {', '.join(parts)} SELECT qid, id, {', '.join(f'round(f{k} + 3e-13, 6) AS f{k}' for k in f)} FROM n{steps}"


@query("cf_sgd_step3", _sgd_sql(3))
def sgd_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = A.sgd(*_ratings(spark, sf_dir), steps=3)
    return got.select("qid", "id", *[F.round(F.col(f"f{k}") + 3e-13, 6).alias(f"f{k}") for k in range(A.LATENT)])
