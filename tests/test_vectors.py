"""Small fixtures for what SQL can't state: traversal, codecs, files, errors."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecforge.functions import codec, distance
from vecforge.operators import caches, evaluate, exact, graph, layout, pq, table, traverse
from vecforge.plans import queries
from vecforge.plans.options import BuildOptions, SearchOptions
from vecforge.sources import files, vectors
from vecforge.streaming import upserts

VECTORS = [[1.0, 0, 0], [0, 1.0, 0], [0, 0, 1.0], [1.0, 0, 1.0], [1.0, 1.0, 1.0]]


def frame(spark, rows, key="id"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], f"{key} long, v array<double>")


@pytest.mark.parametrize(("metric", "want"), [("l2", [0, 1, 2, 2, 2]), ("ip", [-2, -1, 0, 0, 0]), ("cosine", [0, 0.1835, 0.4226, 0.4226, 0.4226])])
def test_metrics(spark, metric, want):
    base = frame(spark, enumerate(VECTORS))
    got = exact.knn(base, frame(spark, [(9, VECTORS[-1])], "query_id"), 5, metric).orderBy("rank").collect()
    assert np.allclose([r["dist"] for r in got], want, atol=1e-3)
    assert [r["id"] for r in got][:2] == [4, 3]


def test_kernels_and_columns_agree(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(20, 70)), rng.normal(size=(20, 70))
    for dim in (64, 70):
        df = spark.createDataFrame([(i, a[i, :dim].tolist(), b[i, :dim].tolist()) for i in range(20)], "i int, a array<double>, b array<double>")
        for name in distance.KERNELS:
            if name in ("l2", "ip", "cosine"):
                got = [r[0] for r in df.orderBy("i").select(distance.METRICS[name](F.col("a"), F.col("b"), dim)).collect()]
                want = [distance.KERNELS[name](a[i : i + 1, :dim], b[i : i + 1, :dim])[0, 0] for i in range(20)]
                assert got == want


def test_zero_vector(spark):
    got = exact.knn(frame(spark, [(1, [0, 0]), (2, [3, 4])]), frame(spark, [(0, [1, 0])], "query_id"), 2, "cosine").orderBy("rank").collect()
    assert [(r["id"], round(r["dist"], 6)) for r in got] == [(2, 0.4), (1, 1.0)]


def test_ties_short_and_empty(spark):
    base = frame(spark, [(5, [1, 1]), (3, [1, 1]), (4, [1, 1])])
    q = frame(spark, [(0, [1, 1])], "query_id")
    assert [r["id"] for r in exact.knn(base, q, 2).orderBy("rank").collect()] == [3, 4]
    assert exact.knn(base, q, 10).count() == 3
    assert exact.knn(base.where("id > 99"), q, 2).count() == 0
    assert exact.knn(base, q.where("query_id > 9"), 2).count() == 0
    with pytest.raises(ValueError):
        exact.knn(base, q, 10, strict=True)
    assert exact.radius(base, q, 0.0).count() == 3 and exact.radius(base, q, 0.0, most=1).count() == 1


def test_missed_neighbours_are_completed(spark):
    """A search that found other rows, too few of them, or none at all."""
    rng = np.random.default_rng(4)
    base = frame(spark, enumerate(rng.integers(0, 3, size=(200, 3)).tolist()))
    asked = base.where("id < 4").select(F.col("id").alias("query_id"), "v")
    want = exact.knn(base, asked, 6).orderBy("query_id", "rank").collect()
    some = exact.ranked(exact.knn(base, asked, 40).where("query_id < 2 and rank % 5 = 2 or query_id = 2 and rank < 5").select("query_id", "id", "dist"), 6)
    assert some.orderBy("query_id", "rank").collect() != want
    assert exact.completed(some, base, asked, 6).orderBy("query_id", "rank").collect() == want


def test_trained_codes_lose_no_neighbour(spark, tmp_path):
    """More vectors than the SQL is run on: two hundred candidates by codes don't hold all true neighbours."""
    b = spark.read.parquet("/root/testdata/check_s/embeddings.parquet").where("vec_id < 3000")
    b.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.k14_trained(spark, str(tmp_path)).collect()
    assert len(got) == 120 and {(r["found"], r["hits"]) for r in got} == {(10, 10)}


def test_blocks_meet_in_every_partition(spark):
    """Small shuffles are put together to one partition, which hid that the blocks of both sides were dealt differently."""
    rng = np.random.default_rng(3)
    base = frame(spark, enumerate(rng.normal(size=(300, 4)).tolist()))
    asked = base.select(F.col("id").alias("query_id"), "v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = exact.ranked(exact.nearest_by_blocks(base, asked, 5, "l2"), 5).orderBy("query_id", "rank").collect()
        graphed = graph.knn_graph(base, 5).count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == exact.knn(base, asked, 5).orderBy("query_id", "rank").collect() and graphed == 1500


def test_bounds_spare_pairs_and_lose_none(monkeypatch):
    """All pairs were summed dimension by dimension, and 100,000 vectors didn't end in time."""
    rng, summed = np.random.default_rng(5), []
    real = exact.pair_distances
    monkeypatch.setattr(exact, "pair_distances", lambda q, b, rows, cols: summed.append(len(rows)) or real(q, b, rows, cols))
    x = rng.normal(size=(5000, 24))
    odd = x[:700].copy()
    odd[3, 2] = np.nan
    cases = [(x[:1200], x), (x[:90] + 1e4, x + 1e4), (x[:90] * 1e30, x[:700] * 1e30), (x[:9], x[:4]), (x[:40], odd), (np.repeat(x[:2], 9, axis=0), np.repeat(x[:3], 500, axis=0)), *[(y[:200], y) for y in [rng.integers(0, 2, (4000, 14)).astype(float)]]]
    for i, (q, b) in enumerate(cases):
        ids, best = rng.permutation(len(b)), exact.Best(7, len(q))
        best.add(ids, distance.np_l2(q, b))
        got = exact.nearest_l2(q, b, ids, 7)
        assert all(np.array_equal(a, c) for a, c in zip(got, best.rows(np.arange(len(q))), strict=True))
        assert i or sum(summed) < 0.05 * len(q) * len(b)


@given(st.lists(st.integers(0, 2**32 - 1), unique=True))
@settings(deadline=None, max_examples=100)
def test_delta_codec(values):
    values = sorted(values)
    assert codec.decode(codec.encode(values)) == values


def test_bad_codes():
    for data in (b"\x80", b"\x80\x80\x80\x80\x80\x01"):
        with pytest.raises(ValueError):
            codec.decode(data)


def test_vector_files(spark, tmp_path):
    rows = np.arange(12, dtype=np.float32).reshape(3, 4)
    data = vectors.pack(rows, "fvecs")
    assert (vectors.parse(data + b"\1\0", "fvecs") == rows).all()
    with pytest.raises(ValueError):
        vectors.parse(data + b"\1\0", "fvecs", strict=True)
    with pytest.raises(ValueError):
        vectors.parse(data + vectors.pack(np.zeros((4, 3)), "fvecs"), "fvecs")
    (tmp_path / "x.fvecs").write_bytes(data)
    assert [r["v"] for r in vectors.read(spark, str(tmp_path)).orderBy("row").collect()] == rows.tolist()
    ids = np.arange(6).reshape(2, 3)
    assert (vectors.truth(vectors.truth_bytes(ids), 3) == ids).all()
    with pytest.raises(ValueError):
        vectors.truth(vectors.truth_bytes(ids), 2)


def test_table_errors(spark):
    state = table.new(frame(spark, enumerate(VECTORS)), 3)
    one, other = frame(spark, [(1, [1, 2, 3])]), spark.createDataFrame([(77,)], "id long")
    for f in (lambda: table.insert(state, one), lambda: table.insert(state, frame(spark, [(9, [1, 2, 3])]), 5), lambda: table.mark_deleted(state, other), lambda: table.unmark_deleted(state, one.select("id")), lambda: table.get(state, other), lambda: table.resize(state, 4), lambda: table.new(one, 2), lambda: table.new(one.unionByName(one))):
        with pytest.raises(table.TableError):
            f()
    gone = table.mark_deleted(state, one.select("id"))
    with pytest.raises(table.TableError):
        table.mark_deleted(gone, one.select("id"))
    with pytest.raises(table.TableError):
        table.upsert(gone, one, replacing=True)
    assert table.upsert(gone, one).where("deleted").count() == 0
    assert table.remove(state, other).count() == 5


def queue_order(n, near, start):
    seen, order = {start}, [start]
    for x in order:
        for y in near.get(x, []):
            if y not in seen:
                seen.add(y)
                order.append(y)
    return order + [x for x in range(n) if x not in seen]


def test_bfs_of_two_components(spark):
    near = {0: [3, 1], 1: [0, 2], 3: [2, 0], 2: [], 4: [5], 5: [4]}
    edges = spark.createDataFrame([(a, b, 1.0, i + 1) for a, bs in near.items() for i, b in enumerate(bs)], "src long, dst long, dist double, pos int")
    nodes = spark.range(6).toDF("id")
    got = graph.bfs_order(nodes, edges, 0).orderBy("new_id").collect()
    assert [r["old_id"] for r in got] == queue_order(6, near, 0)
    checks = graph.verify(frame(spark, [(i, [1.0]) for i in range(6)]), edges, graph.bfs_order(nodes, edges, 0), layout.vector_blocks(graph.bfs_order(nodes, edges, 0), 64, 4))
    assert {r["failures"] for r in checks.collect()} == {0}


def test_bfs_needs_no_round_for_each_level(spark, monkeypatch):
    rng = np.random.default_rng(6)
    near = {i: [i + 1, *rng.permutation(i + 1)[:2].tolist()] for i in range(29)} | {29: [], 30: [31], 31: [2]}
    edges = spark.createDataFrame([(a, b, i + 1) for a, bs in near.items() for i, b in enumerate(bs)], "src long, dst long, pos int")
    nodes, jobs = spark.range(32).toDF("id"), lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("bfs"))
    spark.sparkContext.setJobGroup("bfs", "")
    try:
        got = [r["old_id"] for r in graph.bfs_order(nodes, edges, 0).orderBy("new_id").collect()]
        assert jobs() < 29
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == queue_order(32, near, 0)
    monkeypatch.setattr(graph, "WALKED_EDGES", 0)
    short = edges.where("src < 4")
    assert [r["old_id"] for r in graph.bfs_order(nodes, short, 0).orderBy("new_id").collect()] == queue_order(32, {a: b for a, b in near.items() if a < 4}, 0)


def test_selection_over_many_lists_at_once(spark):
    """Lists were a call of Python each; now several share a step, and a list goes on over batches."""
    rng = np.random.default_rng(8)
    vectors_ = rng.integers(0, 3, (40, 3)).astype(float)
    rows = [(s, int(x), float(distance.np_l2(vectors_[s : s + 1], vectors_[x : x + 1])[0, 0])) for s in range(9) for x in rng.permutation(40)[: s * 3 + 1]]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        for most, least, over in ((3, 0, None), (4, 3, 6)):
            want = set()
            for s in range(9):
                own = sorted((d, x) for a, x, d in rows if a == s)
                v = vectors_[[x for _, x in own]]
                kept = graph.select_neighbours(np.array([d for d, _ in own]), distance.np_l2(v, v), most) if over is None or len(own) > over else list(range(len(own)))
                kept = sorted(kept + [i for i in range(len(own)) if i not in kept][: max(0, least - len(kept))])
                want |= {(s, own[i][1], own[i][0], pos + 1) for pos, i in enumerate(kept)}
            got = graph.diversified(spark.createDataFrame(rows, "src long, dst long, dist double"), frame(spark, enumerate(vectors_.tolist())), most, least=least, over=over)
            assert {tuple(r) for r in got.collect()} == want and "FlatMapGroups" not in got._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_selection_rule():
    d = np.array([1.0, 1.1, 4.0])
    among = np.array([[0, 0.1, 9], [0.1, 0, 9], [9, 9, 0]])
    assert graph.select_neighbours(d, among, 2) == [0, 2]
    assert graph.select_neighbours(d, among, 4) == [0, 1, 2]


def test_graph_search_recall(spark):
    rng = np.random.default_rng(47)
    x = rng.random((1200, 16))
    base = frame(spark, enumerate(x))
    queries = frame(spark, enumerate(x[:40]), "query_id")
    truth = exact.knn(base, queries, 10)
    for shard in (5000, 400):
        index = traverse.build_index(base, BuildOptions(m=8, ef_construction=60, shard=shard)).cache()
        got = traverse.search_index(index, queries, SearchOptions(ef=80)).cache()
        assert evaluate.recall(got, truth, 40, 10).first()["recall"] > 0.95
        assert got.where("rank = 1 and id = query_id").count() == 40
        wide = traverse.search_index(index, queries, SearchOptions(ef=80, beam_width=4))
        assert evaluate.recall(wide, truth, 40, 10).first()["recall"] > 0.95
        none = traverse.search_index(index, queries, SearchOptions(), allowed=base.where("id < 0"))
        assert none.count() == 0
        edges = traverse.edges_of(index).where("level = 0")
        assert graph.integrity(base.select("id"), edges).first()["self_loops"] == 0


def test_blocks_and_carried_best_agree(spark, monkeypatch):
    """Both ways of finding the nearest, over many partitions, steps and blocks, with ties and more wanted than there are."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, (300, 4)).astype(float)
    base, q = frame(spark, enumerate(x)).repartition(5), frame(spark, enumerate(x[:50]), "query_id")
    d = ((x[:50, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    want = sorted((i, int(j), d[i, j], r + 1) for i in range(50) for r, j in enumerate(np.lexsort((np.arange(300), d[i]))[:7]))
    for step, rows, limit in ((2048, 8192, 1 << 30), (16, 40, 1 << 30), (16, 40, 100)):
        monkeypatch.setattr(exact, "STEP", step)
        monkeypatch.setattr(exact, "BLOCK_ROWS", rows)
        monkeypatch.setattr(exact, "QUERY_BYTES", limit)
        got = exact.knn(base, q, 7).select("query_id", "id", "dist", "rank").collect()
        assert sorted(map(tuple, got)) == want
    assert exact.knn(base.where("id < 3"), q, 7).count() == 150 and exact.knn(base.where("id < 0"), q, 7).count() == 0
    assert exact.knn(base, q.where("query_id < 0"), 7).count() == 0


def test_no_vectors_through_the_driver(spark, monkeypatch):
    monkeypatch.setattr(exact, "query_blocks", lambda queries: pytest.fail("the base was collected"))
    assert graph.knn_graph(frame(spark, enumerate(VECTORS)), 2).count() == 10


def test_documents_by_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(exact, "STEP", 8)
    rng = np.random.default_rng(6)
    x, docs = rng.integers(0, 4, (120, 3)).astype(float), rng.integers(0, 9, 120).tolist()
    base = spark.createDataFrame([(i, v.tolist(), docs[i]) for i, v in enumerate(x)], "id long, v array<double>, doc_id long").repartition(4)
    got = exact.documents(base, frame(spark, enumerate(x[:10]), "query_id"), 3).collect()
    for i in range(10):
        order = sorted((float(((x[i] - v) ** 2).sum()), j) for j, v in enumerate(x))
        seen, want = set(), []
        for _, j in order:
            if len(seen | {docs[j]}) > 3:
                break
            seen.add(docs[j])
            want.append(j)
        assert [r["id"] for r in sorted((r for r in got if r["query_id"] == i), key=lambda r: r["rank"])] == want


def test_lockstep_search_and_descent(spark):
    """Queries in lockstep find what each finds alone; the walk through the upper levels ends where a plain one does."""
    rng = np.random.default_rng(8)
    x = rng.random((600, 8))
    index = traverse.build_index(frame(spark, enumerate(x)), BuildOptions(m=4, ef_construction=30, shard=250)).cache()
    q = frame(spark, enumerate(x[:25]), "query_id")
    for width in (1, 3):
        alone, together = (traverse.search_index(index, q, SearchOptions(ef=20, beam_width=width, lockstep=many)).select("query_id", "rank", "id", "dist").collect() for many in (False, True))
        assert sorted(map(tuple, alone)) == sorted(map(tuple, together))
    nodes = {r["id"]: r for r in index.collect()}
    for r in traverse.entry_points(index, q).collect():
        at = next(n for n in nodes.values() if n["shard"] == r["shard"] and n["entry"])
        dist = lambda n: ((x[r["query_id"]] - x[n]) ** 2).sum()  # noqa: B023, E731
        for level in range(at["level"], 0, -1):
            while True:
                near = min(at["links"][level], key=lambda n: (dist(n), at["links"][level].index(n)), default=at["id"])
                if dist(near) >= dist(at["id"]):
                    break
                at = nodes[near]
        assert at["id"] == r["id"]


def test_graph_prefetch(spark):
    trace = [(1, 0), (2, 1), (3, 0), (4, 2), (5, 1)]
    near = {0: [1, 2], 1: [0], 2: [1, 3], 3: [0]}
    edges = [(a, b, i + 1) for a, bs in near.items() for i, b in enumerate(bs)]
    got = {r["kind"]: (r["fetched"], r["useful"]) for r in caches.graph_prefetch(spark.createDataFrame(trace, "seq long, node long"), spark.createDataFrame(edges, "src long, dst long, pos int"), 2, 1).collect()}
    soon = lambda seq, n: any(n == m and seq < t <= seq + 2 for t, m in trace)
    one = {(t, y) for t, n in trace for y in near[n]}
    two = one | {(t, z) for t, n in trace for y in near[n][:1] for z in near[y]}
    ahead = {(t, y) for (t, _), (_, n) in zip(trace, trace[1:], strict=False) for y in near[n]}
    assert got == {k: (len(v), sum(soon(*x) for x in v)) for k, v in (("one_hop", one), ("two_hop", two), ("lookahead", ahead))}


def test_prefetch_makes_no_row_for_each_fetch(spark, monkeypatch):
    """Pairs of nodes are counted along the trace, over the ends of its stretches too."""
    monkeypatch.setattr(caches, "STRETCH", 7)
    rng = np.random.default_rng(7)
    nodes = [*rng.integers(-2, 6, 60).tolist(), None, 3, None, 70]
    trace = [(i + 1, n) for i, n in enumerate(nodes)]
    got = {tuple(r)[:3]: r["n"] for r in caches.followers(spark.createDataFrame(trace, "seq long, node long"), 5).collect()}
    want: dict[tuple, int] = {}
    for i in range(len(nodes)):
        soon = {n for n in nodes[i + 1 : i + 6] if n is not None}
        for ahead, a in ((False, nodes[i]), (True, nodes[i + 1] if i + 1 < len(nodes) else None)):
            for b in ({None} | soon) if a is not None else ():
                want[ahead, a, b] = want.get((ahead, a, b), 0) + 1
    assert got == want


def test_files_by_ranges(spark, tmp_path):
    """Written by partitions, read by ranges; damaged files are an error where the range is read."""
    for kind, rows in (("fvecs", np.arange(90, dtype=np.float32).reshape(30, 3)), ("bvecs", (np.arange(90) % 256).reshape(30, 3)), ("ivecs", np.arange(90).reshape(30, 3) - 40)):
        path = str(tmp_path / kind)
        typed = "array<float>" if kind == "fvecs" else "array<int>"
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], f"id long, v {typed}")
        files.write(df, path, kind, files=3)
        files.write(df, path, kind, files=4)
        back = sorted((r["path"], r["row"], r["v"]) for r in files.read(spark, path, kind, split=4).collect())
        assert [v for _, _, v in back] == rows.tolist()
        one = back[0][0]
        assert files.read(spark, one, kind, strict=True).count() == sum(p == one for p, _, _ in back)
        with open(one, "ab") as f:
            f.write(b"\1\0")
        assert files.read(spark, one, kind).count() == sum(p == one for p, _, _ in back)
        with pytest.raises(Exception, match="ends within a record"):
            files.read(spark, one, kind, strict=True).collect()
    (tmp_path / "bad.fvecs").write_bytes(vectors.pack(np.zeros((2, 3)), "fvecs") + vectors.pack(np.zeros((1, 7)), "fvecs"))
    with pytest.raises(Exception, match="different lengths"):
        files.read(spark, str(tmp_path / "bad.fvecs")).collect()
    with pytest.raises(Exception, match="different lengths"):
        files.write(spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "id long, v array<float>"), str(tmp_path / "odd"), files=1)
    assert files.read(spark, str(tmp_path / "odd")).count() == 0


def test_order_beyond_doubles(spark):
    big = [(1 << 60) + i for i in range(200)]
    got = table.numbered(spark.createDataFrame([(x,) for x in big], "x long"), "x", "n").collect()
    assert {r["x"]: r["n"] for r in got} == {x: i for i, x in enumerate(big)}


def test_broken_index_is_found(spark):
    ids = frame(spark, [(i, [1.0]) for i in range(4)])
    order = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (7, 9)], "old_id long, new_id long")
    routes = spark.createDataFrame([(0, 0), (0, 1)], "node_id long, block_id long")
    bad = graph.verify(ids.unionByName(frame(spark, [(0, [float("nan")])])), spark.createDataFrame([(0, 9)], "src long, dst long"), order, routes)
    assert {r["check"]: r["failures"] for r in bad.collect()} == {"edge_range": 1, "nan_vectors": 1, "label_unique": 1, "order_unique": 1, "order_range": 1, "order_covers": 1, "one_block": 1, "route_covers": 3}


def test_policies():
    rng = np.random.default_rng(3)
    blocks = (rng.zipf(1.4, 500) % 40).tolist()
    for slots in (1, 4, 16):
        lru = caches.Lru(slots)
        hits = [lru.access(b, i) for i, b in enumerate(blocks)]
        assert hits == [0 <= d < slots for d in caches.stack_distances(blocks).tolist()]
        for kind, key in ((caches.Lfu, lambda h: (h[0], h[1])), (caches.LruK, None)):
            cache, held, out = kind(slots), {}, []
            for i, b in enumerate(blocks):
                out.append(b in held)
                if b in held:
                    held[b].append(i)
                else:
                    if len(held) >= slots:
                        rank = (lambda x: (len(held[x]), held[x][0])) if key else (lambda x: (len(held[x]) >= 2, held[x][-2:][0]))
                        del held[min(held, key=rank)]
                    held[b] = [i]
            assert [cache.access(b, i) for i, b in enumerate(blocks)] == out


def test_missing_in_every_batch(spark, sf):
    t = queries.trace(spark, sf).select("query_no", "block_id").collect()
    batches = {q: {r["block_id"] for r in t if r["query_no"] == q} for q in {r["query_no"] for r in t}}
    want = sorted((q, b) for q, own in batches.items() for b in own - batches.get(q - 1, set()))
    assert len(batches) > 2 and sorted(map(tuple, queries.c9_all(spark, sf).select("query_no", "block_id").collect())) == want


def test_sweep_has_all_values(spark, sf):
    got = {r["ef"]: r["recall"] for r in queries.a5(spark, sf).collect()}
    assert sorted(got) == evaluate.sweep_values(queries.K) and got[460] >= 0.95


def test_distance_tables_of_all_queries(spark, sf):
    asked = {r["query_id"] for r in queries.asked(queries.base(spark, sf)).collect()}
    got = [(r["query_id"], r["m"], r["k"]) for r in queries.q5_all(spark, sf).collect()]
    assert {q for q, _, _ in got} == asked and len(got) == len(set(got)) == len(asked) * queries.M * queries.CENTROIDS


def test_block_sizes():
    assert layout.vector_capacity(65536, 128) == 126
    with pytest.raises(ValueError):
        layout.vector_capacity(64, 128)
    assert [pq.auto_m(d) for d in (64, 128, 30, 7)] == [8, 32, 6, 1]
    with pytest.raises(ValueError):
        pq.auto_m(30, 4)
    assert SearchOptions(two_stage=True, has_codes=True).mode() == "two_stage"
    assert evaluate.sweep_values(28)[:4] == [28, 29, 30, 40]


def test_stream_upserts(spark, tmp_path):
    src = tmp_path / "in"
    rows = [(1, 1, [1.0], False), (1, 3, [2.0], False), (2, 2, [5.0], False), (2, 4, [5.0], True)]
    schema = "id long, seq long, v array<double>, deleted boolean"
    spark.createDataFrame(rows, schema).write.parquet(str(src))
    stream = spark.readStream.schema(schema).parquet(str(src))
    q = upserts.upsert_stream(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    q.awaitTermination()
    live = upserts.current(spark.read.parquet(str(tmp_path / "out"))).collect()
    assert [(r["id"], r["v"]) for r in live] == [(1, [2.0])]
