"""Small graphs with known answers: readers, writers, programs, sets, joins, lanes and the server."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from polyhop.functions import lanes as L
from polyhop.functions.spread import spread
from polyhop.operators import dataflow as D
from polyhop.plans import algorithms as A
from polyhop.plans.blocks import run_blocks
from polyhop.plans.bsp import ENGINES, SCHEDULERS, Layout, Watch, layout, run
from polyhop.sources import readers, writers
from polyhop.sources.graph import Direction, Graph, queries_of
from polyhop.streaming.server import EXIT, QueryServer, serve
from polyhop.tables import laid, release

F1 = [(1, 2), (1, 5), (7, 5), (5, 7), (7, 1)]
F2 = [(1, 2, 4), (1, 3, 1), (3, 2, 1), (2, 4, 1), (3, 4, 5), (5, 1, 2)]


@pytest.fixture(scope="module")
def f1(spark):
    return Graph.of(spark.createDataFrame(F1, "src bigint, dst bigint"))


@pytest.fixture(scope="module")
def f2(spark):
    return Graph.of(spark.createDataFrame(F2, "src bigint, dst bigint, w bigint"))


def values(result, qid=0):
    return {r.id: r.value for r in result.df.where(F.col("qid") == qid).collect()}


@pytest.mark.parametrize("mode", ["long", "lanes", "single"])
def test_programs(spark, f1, f2, mode):
    got = run(A.ibfs(), f1, queries_of(spark, [1, 7, 2, 1]), mode)
    assert [values(got, q) for q in range(4)] == [{1: 0, 2: 1, 5: 1, 7: 2}, {7: 0, 1: 1, 5: 1, 2: 2}, {2: 0}, {1: 0, 2: 1, 5: 1, 7: 2}]
    assert got.status == "task_depletion"
    assert set(values(run(A.bbfs(), f1, queries_of(spark, [7]), mode))) == {1, 2, 5, 7}
    assert values(run(A.sssp(), f2, queries_of(spark, [1]), mode)) == {1: 0, 3: 1, 2: 2, 4: 3}
    assert values(run(A.sssp(), f2, queries_of(spark, [5]), mode)) == {5: 0, 1: 2, 3: 3, 2: 4, 4: 5}
    assert values(run(A.sssp(directed=False), f2, queries_of(spark, [1]), mode)) == {1: 0, 3: 1, 2: 2, 5: 2, 4: 3}
    for n, want in ((1, {2: 4, 3: 1}), (2, {2: 1, 4: 9}), (3, {4: 1})):
        assert values(run(A.spmv(), f2, queries_of(spark, [1]), mode, n)) == want
    got = values(run(A.ppr(), f1, queries_of(spark, [1]), mode, 3))
    assert got == pytest.approx({1: 0.85071719, 2: 0.06375, 5: 0.06446719, 7: 0.0095625}, abs=1e-8)


def test_absent_source_and_empty_graph(spark, f1):
    assert run(A.ibfs(), f1, queries_of(spark, [99])).df.count() == 0
    none = Graph.of(spark.createDataFrame([], "src bigint, dst bigint"))
    assert run(A.ibfs(), none, queries_of(spark, [1])).df.count() == 0


def test_coloring(spark):
    path = Graph.of(spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src bigint, dst bigint"))
    assert values(run(A.coloring(), path, queries_of(spark, [1]), "long", 6)) == {1: 1, 2: 2, 3: 1, 4: 2}
    triangle = Graph.of(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src bigint, dst bigint"))
    assert run(A.coloring(), triangle, queries_of(spark, [1]), "long", 5).status == "max_iterations"
    colors = {r.id: r.color for r in A.proper_coloring(triangle).df.collect()}
    assert len(set(colors.values())) == 3


def test_proper_coloring_of_more_than_63_colours(spark):
    clique = Graph.of(spark.createDataFrame([(i, j) for i in range(70) for j in range(i)], "src bigint, dst bigint"))
    got = A.proper_coloring(clique)
    assert got.status == "task_depletion"
    assert sorted(r.color for r in got.df.collect()) == list(range(70))
    with pytest.raises(Exception, match="63 colours"):
        got.df.select(A.color_bit(F.col("color"))).collect()


@pytest.mark.parametrize("batch", [0, 12, 2**20])
def test_proper_coloring_is_greedy_by_hash(spark, monkeypatch, batch):
    monkeypatch.setattr(A, "BATCH", batch)
    draw = random.Random(3)
    m = 2_147_483_647  # ids of one hash
    ids = [1, 1 + m, 1 + 2 * m, -5, *range(2, 9)]
    pairs = {(a, b) for a in ids for b in ids if a < b and (draw.random() < 0.5 or (b - a) % m == 0)}
    got = A.proper_coloring(Graph.of(spark.createDataFrame(sorted(pairs), "src bigint, dst bigint"), spark.createDataFrame([(99,)], "id bigint")))
    hashes = {r.id: r.h for r in spark.createDataFrame([(i,) for i in [*ids, 99]], "id bigint").select("id", spread("id", 0).alias("h")).collect()}
    want = {}
    for v in sorted(hashes, key=lambda i: (hashes[i], i)):
        taken = {want.get(b if a == v else a) for a, b in pairs if v in (a, b)}
        want[v] = next(c for c in range(99) if c not in taken)
    assert got.status == "task_depletion"
    assert {r.id: r.color for r in got.df.collect()} == want


def test_proper_coloring_tells_what_is_left(spark, monkeypatch):
    monkeypatch.setattr(A, "BATCH", 10)
    clique = Graph.of(spark.createDataFrame([(i, j) for i in range(12) for j in range(i)], "src bigint, dst bigint"))
    got = A.proper_coloring(clique, 1)
    colors = [r.color for r in got.df.collect()]
    assert got.status == "max_iterations" and len(colors) == 12 and 0 < colors.count(None) < 12


def test_whole_graph(spark, f1):
    exact = {r.id: r.value for r in A.pagerank(f1, 60).df.collect()}
    near = {r.id: r.value for r in A.pagerank(f1, 200, 1e-6).df.collect()}
    assert near == pytest.approx(exact, abs=1e-3)
    with pytest.raises(ValueError):
        A.toposort(f1)
    assert A.assign_blocks({1: 5, 2: 4, 3: 3}, 2) == {1: 0, 2: 1, 3: 1}


def test_toposort_raises_where_levels_run_out(spark):
    path = Graph.of(spark.createDataFrame([(i, i + 1) for i in range(4)], "src bigint, dst bigint"))
    assert {r.id: r.level for r in A.toposort(path, 5).collect()} == {i: i for i in range(5)}
    with pytest.raises(ValueError, match="left"):
        A.toposort(path, 4)


@pytest.mark.parametrize("batch", [0, 60, 2**20])
def test_toposort_levels_of_a_dense_graph(spark, monkeypatch, batch):
    monkeypatch.setattr(A, "BATCH", batch)
    draw, n = random.Random(5), 14
    order = draw.sample(range(-40, 40), n)
    pairs = [(order[i], order[j]) for j in range(n) for i in range(j) if j == i + 1 < 9 or draw.random() < 0.4]
    want = {v: 0 for v in order}
    for a, b in sorted(pairs, key=lambda p: order.index(p[0])):
        want[b] = max(want[b], want[a] + 1)
    g = Graph.of(spark.createDataFrame(pairs + pairs[:5], "src bigint, dst bigint"), spark.createDataFrame([(v,) for v in [*order, 99]], "id bigint"))
    assert {r.id: r.level for r in A.toposort(g).collect()} == want | {99: 0}
    back = Graph.of(g.edges.union(spark.createDataFrame([(order[8], order[3])], "src bigint, dst bigint")))
    with pytest.raises(ValueError, match="cycle"):
        A.toposort(back)


def test_toposort_takes_many_levels_a_round(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(A, "cut", lambda df, real=A.cut: tables.append(df) or real(df))
    dense = Graph.of(spark.createDataFrame([(i, j) for j in range(60) for i in range(j)], "src bigint, dst bigint"))
    assert {r.id: r.level for r in A.toposort(dense).collect()} == {i: i for i in range(60)}
    assert len(tables) < 20
    none = Graph.of(spark.createDataFrame([], "src bigint, dst bigint"))
    assert A.toposort(none).collect() == []


def test_structure(spark):
    edges = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (-1, 3), (4, -1)], "src bigint, dst bigint")
    g = Graph.of(edges, spark.createDataFrame([(9,)], "id bigint"))
    assert sorted(r.id for r in g.vertices.collect()) == [1, 2, 9] and g.edges.count() == 2
    assert {r.id: (r.in_deg, r.out_deg) for r in g.degrees().collect()} == {1: (0, 2), 2: (2, 0), 9: (0, 0)}


def test_sets(spark, f1):
    s = lambda *i: spark.createDataFrame([(x,) for x in i], "id bigint")
    ids = lambda df: sorted(r.id for r in df.collect())
    a, b = s(1, 2, 5), s(5, 7)
    assert (ids(D.intersect(a, b)), ids(D.union(a, b)), ids(D.difference(a, b)), ids(D.invert(f1, a))) == ([5], [1, 2, 5, 7], [1, 2], [7])
    assert ids(D.neighbors(f1, s(1), Direction.OUT)) == [2, 5]
    assert ids(D.neighbors(f1, s(5), Direction.IN)) == [1, 7]
    assert ids(D.neighbors(f1, s(7))) == [1, 5]
    v = f1.vertices
    with pytest.raises(ValueError):
        D.injective_join(v, v, F.lit(1), F.col("id"), {})


def test_readers(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return f"file://{tmp_path}/{name}"

    def edges(fmt, text):
        return sorted(tuple(r) for r in readers.read(spark, fmt, put(f"{fmt}.txt", text)).edges.collect())

    assert edges("snap", "# c\n1 2\n3\t4\n5 5\n") == [(1, 2), (3, 4)]
    assert edges("rtsv", "1\t2\n") == [(2, 1)]
    assert edges("csv", "1,2\nnone\n") == [(1, 2)]
    assert edges("etuple", "# c\n1,2#\nx,3\n") == [(1, 2)]
    assert edges("wtuple", "# c\nx,1,2\n1,2,4#\n3,3,9\n") == [(1, 2, 4)]
    g = readers.read(spark, "adj", put("adj.txt", "1 2 2 3\n4 0\n5 2 1\n"))
    assert sorted(tuple(r) for r in g.edges.collect()) == [(1, 2), (1, 3)] and g.vertices.count() == 4
    assert edges("online_weighted_adj", "1\t2 2 7 3 8\n") == [(1, 2, 7), (1, 3, 8)]
    with pytest.raises(ValueError):
        readers.read(spark, "adj", put("bad.txt", "1 9 2\n"), failfast=True)
    (tmp_path / "b.bin").write_bytes(struct.pack("<IIII", 1, 2, 9, 2**32 - 1))
    g = readers.read(spark, "bintsv4", f"file://{tmp_path}/b.bin")
    assert sorted(r.id for r in g.vertices.collect()) == [1, 2, 9]
    q = readers.query_file(spark, put("q.txt", "num_queries=3,\n95,146,165,\n"), 2)
    assert [tuple(r) for r in q.orderBy("qid").collect()] == [(0, 95), (1, 146)]
    put("r.txt.validate", "1 2 3.5\n")
    assert tuple(readers.ratings(spark, f"file://{tmp_path}/r.txt.validate").first()) == (1, -4, 3.5, "VALIDATE")


@pytest.mark.parametrize("fmt", ["tsv", "etuple", "wtuple", "bin", "bintsv4"])
def test_writers(spark, f2, tmp_path, fmt):
    at = f"file://{tmp_path}/out"
    writers.write(f2, fmt, at)
    back = readers.read(spark, fmt, at).edges.select("src", "dst")
    assert sorted(map(tuple, back.collect())) == sorted((a, b) for a, b, _ in F2)


def test_lanes(spark):
    df = spark.createDataFrame([(1, 5, True, False)], "a0 int, a1 int, m0 boolean, m1 boolean")
    a, m = L.lanes("a", 2), L.lanes("m", 2)
    assert list(df.select(*L.op("add", a, F.lit(2), m)).first()) == [3, 5]
    new, any_set = L.or_update(m, [F.lit(True), F.lit(False)])
    assert list(df.select(*new, any_set).first()) == [True, False, False]
    assert df.select(L.all_zeros(L.negate(m, m))).first()[0]


def test_server(spark, f1, tmp_path):
    server = QueryServer(f1, A.ibfs(), 2)
    for s in (1, 7, 2):
        server.submit(s)
        server.tick()
    got = server.drain()
    assert {(r.qid, r.id): r.value for r in got.collect()} == {(0, 1): 0, (0, 2): 1, (0, 5): 1, (0, 7): 2, (1, 7): 0, (1, 1): 1, (1, 5): 1, (1, 2): 2, (2, 2): 0}
    assert {r.qid: r.access_rate for r in server.stats().collect()} == {0: 1.0, 1: 1.0, 2: 0.25}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("1\n")
    more = QueryServer(f1, A.ibfs())
    serve(more, spark.readStream.text(f"file://{tmp_path}/in"), f"file://{tmp_path}/cp").awaitTermination()
    assert more.drain().count() == 4
    more.submit(EXIT)
    with pytest.raises(RuntimeError):
        more.submit(1)
    server.close()
    more.close()


def test_watch(spark, f2, tmp_path):
    q = queries_of(spark, [1, 5])
    watch = Watch(aggregates={"far": F.max("value")}, snapshot_every=2, snapshot_path=f"file://{tmp_path}/snap")
    got = run(A.sssp(), f2, q, watch=watch)
    assert [(s["superstep"], s["active"], s["messages"]) for s in got.stats] == [(0, 2, 0), (1, 3, 3), (2, 4, 4), (3, 3, 3), (4, 1, 1), (5, 0, 0)]
    assert got.stats[-1]["aggregates"] == {0: {"far": 3}, 1: {"far": 5}}
    assert sorted(p.name for p in (tmp_path / "snap").iterdir()) == ["superstep=0", "superstep=2", "superstep=4"]
    # a snapshot goes on to the same end, with every vertex awake
    later = run(A.sssp(), f2, q, start=spark.read.parquet(f"file://{tmp_path}/snap/superstep=2"))
    assert sorted(map(tuple, later.df.collect())) == sorted(map(tuple, got.df.collect()))
    assert run(A.sssp(), f2, q, watch=Watch(timeout=-1)).status == "timeout"
    assert run(A.sssp(), f2, q, "single", watch=Watch(timeout=-1)).status == "timeout"
    assert run(A.sssp(), f2, q, stop_when=F.max("value") >= 1).status == "forced_abort"
    assert spark.catalog.listTables() == []


def test_watch_in_lanes(spark, f2):
    """Aggregates, ends of instances, conditions and starting states, as by rows."""
    q = queries_of(spark, [1, 5])
    rows = lambda r: sorted(map(tuple, r.df.collect()))
    watch = lambda: Watch(aggregates={"far": F.max("value"), "n": F.count(F.lit(1))}, stop_query=lambda a: a["far"] >= 4)
    by_rows, by_lanes = run(A.sssp(), f2, q, watch=watch()), run(A.sssp(), f2, q, "lanes", watch=watch())
    assert rows(by_rows) == rows(by_lanes) != rows(run(A.sssp(), f2, q))
    assert all(a["aggregates"] == b["aggregates"] for a, b in zip(by_rows.stats, by_lanes.stats, strict=False))
    assert run(A.sssp(), f2, q, "lanes", stop_when=F.max("value") >= 1).status == "forced_abort"
    start = run(A.sssp(), f2, q, max_iterations=1).df
    assert rows(run(A.sssp(), f2, q, "lanes", start=start)) == rows(run(A.sssp(), f2, q))
    with pytest.raises(ValueError):
        run(A.sssp(), f2, q, "lanes", watch=Watch(post_round=lambda s, n: None))


def test_edges_stay_in_place(spark, f2):
    """A join on the source shuffles what is sent, not the edges."""
    from polyhop.tables import bucketed

    with bucketed(f2.edges, "src") as edges:
        sent = spark.range(6).withColumnRenamed("id", "src").hint("merge").join(edges, "src")
        assert sent._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
        assert sent.count() == 6


def test_powerlaw(spark):
    degrees = readers.powerlaw(spark, 20_000, 2.0).groupBy("src").count().select("count").toPandas()["count"]
    assert len(degrees) == 20_000 and degrees.max() > 1000
    # probabilities d**-2 over their sum, which is 1.6449 less the tail
    assert [round((degrees == d).mean(), 2) for d in (1, 2, 3)] == pytest.approx([0.61, 0.15, 0.07], abs=0.015)
    assert (degrees > 64).mean() == pytest.approx(1 / 64.5 / 1.645, rel=0.25)
    assert readers.powerlaw(spark, 1).count() == 0
    assert readers.powerlaw(spark, 1000, 2.0, truncate=3).groupBy("src").count().agg(F.max("count")).first()[0] == 3


def _random_graph(spark, n=60, m=150, seed=3):
    r = random.Random(seed)
    rows = [(r.randrange(n), r.randrange(n), r.randint(1, 9)) for _ in range(m)]
    return Graph.of(spark.createDataFrame(rows, "src bigint, dst bigint, w bigint"), spark.createDataFrame([(i,) for i in range(n)], "id bigint"))


def test_block_modes_end_alike(spark):
    g = _random_graph(spark)
    want = {r.id: r.value for r in run(A.sssp(), g, queries_of(spark, [1])).df.collect()}
    start = spark.createDataFrame([(1, 0)], "id bigint, value bigint")
    steps = {}
    for mode in ("V", "B", "VB"):
        got = run_blocks(g, g.vertices.select("id", F.floor(F.col("id") / 20).alias("block")), start, "w", mode)
        assert {r.id: r.value for r in got.df.collect()} == want and got.status == "task_depletion"
        steps[mode] = got.supersteps
    assert steps["B"] <= steps["V"]
    one = run_blocks(g, g.vertices.select("id", F.lit(0).cast("bigint").alias("block")), start, "w", "B")
    assert one.supersteps == 1 and {r.id: r.value for r in one.df.collect()} == want
    with pytest.raises(ValueError):
        run_blocks(g, g.vertices, start, mode="X")


@pytest.mark.parametrize("mode", ["long", "lanes", "single"])
def test_hubs_are_dealt(spark, mode):
    """A vertex with a great part of all edges gives the same result when its edges lie in parts."""
    rows = [(0, i, i % 7 + 1) for i in range(1, 200)] + [(i, (i * 5) % 230, 2) for i in range(1, 60)]
    g = Graph.of(spark.createDataFrame(rows, "src bigint, dst bigint, w bigint"))
    q = queries_of(spark, [0, 3])
    assert sorted(map(tuple, run(A.sssp(), g, q, mode, hub=20).df.collect())) == sorted(map(tuple, run(A.sssp(), g, q, mode).df.collect()))
    with layout(g.edges, 20) as lay:
        sizes = [r["count"] for r in lay.edges.groupBy("src", "part").count().collect()]
        assert lay.hubs.collect() == [(0, 10)] and max(sizes) < 45 and sum(sizes) == g.edges.count()
    assert spark.catalog.listTables() == []


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def test_supersteps_shuffle_what_is_sent(spark):
    """The state lies where it is joined: messages are exchanged, and by instances the frontier."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        g = _random_graph(spark)
        edges = laid(g.edges, "src", deal=True)
        seeds = queries_of(spark, [1, 2]).select("qid", F.col("source").alias("id"), F.lit(0).cast("bigint").alias("value"))
        state = laid(seeds, "qid", "id", deal=True)
        got = A.sssp().gathered(Layout(edges).sent(state))
        assert _exchanges(state.join(got, ["qid", "id"], "full")) == 2
        lanes = laid(g.vertices.withColumn("v0", F.lit(0)), "id", deal=True)
        sums = Layout(edges).sent(lanes).groupBy(F.col("dst").alias("to")).agg(F.min("v0").alias("a"))
        assert _exchanges(lanes.join(sums, F.col("id") == F.col("to"), "left")) == 1
        release(edges, state, lanes)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_named_engines(spark, f2):
    q = queries_of(spark, [1])
    want = sorted(map(tuple, run(A.sssp(), f2, q).df.collect()))
    assert all(sorted(map(tuple, run(A.sssp(), f2, q, engine=e, scheduler=s).df.collect())) == want for e, s in zip(ENGINES, SCHEDULERS, strict=True))
    for wrong in ({"engine": "msync"}, {"scheduler": "none"}):
        with pytest.raises(ValueError):
            run(A.sssp(), f2, q, **wrong)


def test_bintsv4_refuses_wide_ids(spark, tmp_path):
    for i in (2**32 - 1, 2**40, -5):
        with pytest.raises(ValueError):
            writers.write(Graph.of(spark.createDataFrame([(1, i)], "src bigint, dst bigint")), "bintsv4", f"file://{tmp_path}/x")


def test_server_ends_queries_by_their_aggregates(spark, f1):
    server = QueryServer(f1, A.ibfs(), 2, {"far": F.max("value")}, lambda a: a["far"] >= 1)
    for s in (1, 7, 99):
        server.submit(s)
    got = server.drain()
    assert {(r.qid, r.id): r.value for r in got.collect()} == {(0, 1): 0, (0, 2): 1, (0, 5): 1, (1, 7): 0, (1, 1): 1, (1, 5): 1}
    assert [d["aggregates"] for d in sorted(server.done, key=lambda d: d["qid"])] == [{"far": 1}, {"far": 1}, {}]
    server.force_terminate(5)
    server.close()


def test_arrivals_share_supersteps(spark, f1, tmp_path):
    """Queries of two files are in flight together: fewer supersteps than one after the other."""
    (tmp_path / "in").mkdir()
    for i, s in enumerate((1, 7)):
        (tmp_path / "in" / f"{i}.txt").write_text(f"{s}\n")
    server = QueryServer(f1, A.ibfs())
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(f"file://{tmp_path}/in")
    serve(server, lines, f"file://{tmp_path}/cp").awaitTermination()
    assert len(server.live) == 2
    assert server.drain().count() == 8
    server.close()


def test_server_goes_on_after_a_restart(spark, f1, tmp_path):
    first = QueryServer(f1, A.ibfs(), 2)
    for s in (1, 7, 2):
        first.submit(s)
    first.tick()
    first.save(f"file://{tmp_path}/server")
    first.tick()
    first.tick()
    first.save(f"file://{tmp_path}/server")
    want = sorted(map(tuple, first.drain().collect()))
    first.close()
    again = QueryServer.restore(f1, A.ibfs(), f"file://{tmp_path}/server", capacity=2)
    assert again.ticks == 3
    assert sorted(map(tuple, again.drain().collect())) == want and len(want) == 9
    assert sorted(d["qid"] for d in again.done) == [0, 1, 2]
    again.close()


def test_components_of_a_long_path(spark):
    """Labels jump: far fewer rounds than hops."""
    path = Graph.of(spark.createDataFrame([(i * 37 % 401, (i + 1) * 37 % 401) for i in range(400)], "src bigint, dst bigint"))
    got = A.components(path)
    assert {r.label for r in got.df.collect()} == {0} and got.status == "task_depletion" and got.supersteps < 16
