"""Traversals against queue models on random multigraphs, in content and order."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from skeinwork.model import PropertyGraph
from skeinwork.operators import adjacency, code, graph, traverse

RELS = ["calls", "imports", "uses", "contains", "depends-on", "called_by"]


def random_graph(seed):
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(rng.randint(3, 8))]
    return nodes, [(rng.choice(nodes), rng.choice(nodes), rng.choice(RELS)) for _ in range(rng.randint(2, 22))]


def as_frames(spark, nodes, edges):
    n = spark.createDataFrame([(x, x.upper(), "code", i, "{}") for i, x in enumerate(nodes)], "id string, label string, type string, pos long, attrs string")
    e = spark.createDataFrame([(a, b, r, None, i, "{}") for i, (a, b, r) in enumerate(edges)], "src string, dst string, rel string, confidence string, pos long, attrs string")
    return PropertyGraph(n, e)


def model_paths(edges, source, target, depth, directed, cap):
    around = defaultdict(list)
    for a, b, r in edges:
        around[a].append((b, r))
        if not directed:
            around[b].append((a, r))
    waiting, found = [(source, [source], [])], []
    while waiting and len(found) < cap:
        node, path, rels = waiting.pop(0)
        if len(path) - 1 > depth:
            continue
        if node == target:
            found.append((path, rels))
        else:
            waiting += [(x, [*path, x], [*rels, r]) for x, r in around[node] if x not in path]
    return found


def model_dependencies(edges, start, depth):
    around = defaultdict(list)
    for a, b, r in edges:
        around[a].append((b, r))
        around[b].append((a, r))
    done, waiting, out = set(), [(start, 0)], []
    while waiting:
        node, d = waiting.pop(0)
        if d > depth or node in done:
            continue
        done.add(node)
        for x, r in around[node]:
            if x not in done and d < depth:
                waiting.append((x, d + 1))
                out.append((x, r, d + 1))
    return out


def model_callers(edges, start, depth, cap):
    calls = [(a, b, r) for a, b, r in edges if "call" in r]
    out = [(a, r, 1) for a, b, r in calls if b == start]
    done, waiting = {start}, [(a, 2) for a, *_ in out]
    while waiting and len(out) < cap:
        node, d = waiting.pop(0)
        if d > depth or node in done:
            continue
        done.add(node)
        for a, b, r in calls:
            if b == node:
                out.append((a, r, d))
                waiting.append((a, d + 1))
    return out


@pytest.mark.parametrize(("seed", "few"), [(1, 5000), (2, 5), (3, -1)])
def test_random_graphs(spark, monkeypatch, seed, few):
    """Walked at hand, by tables from the first step on, and in between."""
    monkeypatch.setattr(traverse, "FEW_EDGES", few)
    nodes, edges = random_graph(seed)
    rng = random.Random(100 + seed)
    g = as_frames(spark, nodes, edges)
    depth, directed, cap = rng.randint(1, 4), bool(seed % 2), rng.choice([3, 7, 100])
    source, target = rng.choice(nodes), rng.choice(nodes)
    got = [(r["nodes"], r["rels"]) for r in traverse.simple_paths(traverse.store_of(g), source, target, depth, cap, directed).orderBy("rank").collect()]
    assert got == model_paths(edges, source, target, depth, directed, cap)
    start = spark.createDataFrame([(source,)], "node string")
    rows = traverse.dependency_rows(traverse.store_of(g), start, depth).orderBy("depth", "order_key").collect()
    assert [(r["other"], r["rel"], r["depth"]) for r in rows] == model_dependencies(edges, source, depth)
    calls = traverse.Around(traverse.store_of(g), "in", F.col("rel").contains("call"))
    got = sorted(tuple(r) for r in traverse.caller_rows(calls, start, True, depth, cap).collect())
    assert got == sorted(model_callers(edges, source, depth, cap))


def test_path_edges(spark):
    g = as_frames(spark, ["a", "b"], [("a", "b", "calls"), ("a", "b", "uses"), ("b", "b", "calls")])
    one = traverse.simple_paths(traverse.store_of(g), "ghost", "ghost", 3, 10).collect()
    assert [(r["nodes"], r["rels"]) for r in one] == [(["ghost"], [])]
    assert traverse.simple_paths(traverse.store_of(g), "a", "a", -1, 10).count() == 0
    assert [r["rels"] for r in traverse.simple_paths(traverse.store_of(g), "a", "b", 5, 10).orderBy("rank").collect()] == [["calls"], ["uses"]]
    assert traverse.simple_paths(traverse.store_of(g), "a", "nowhere", 5, 10).count() == 0


def test_generic_and_code_operators(spark):
    nodes = ["lib.utils", "lib.utils.helper", "app.main", "app.main.run", "tests.test_utils"]
    edges = [("app.main.run", "lib.utils.helper", "calls"), ("app.main", "lib.utils", "imports"), ("tests.test_utils", "lib.utils.helper", "calls"), ("lib.utils", "lib.utils.helper", "contains"), ("lib.utils", "tests.test_utils", "contains")]
    g = as_frames(spark, nodes, edges)
    assert [r["id"] for r in graph.search_nodes(g, "HELPER", fuzzy=True).collect()] == ["lib.utils.helper"]
    assert graph.search_nodes(g, "utils", fuzzy=True, limit=0).count() == 0
    assert graph.search_nodes(g, "_", fuzzy=True).count() == 1
    assert graph.get_node(g, "nothing").count() == 0
    both = {(r["direction"], r["node"]) for r in graph.neighbors(g, "lib.utils").collect()}
    assert both == {("incoming", "app.main"), ("outgoing", "lib.utils.helper"), ("outgoing", "tests.test_utils")}
    with pytest.raises(ValueError):
        graph.neighbors(g, "x", "sideways")
    sub = graph.subgraph(g, ["app.main", "ghost"], 1)
    assert {r["id"] for r in sub.nodes.collect()} == {"app.main", "lib.utils"} and sub.edges.count() == 1
    assert {r["caller"] for r in code.find_callers(g, "helper").collect()} == {"app.main.run", "tests.test_utils"}
    assert code.find_callers(g, "main.run").count() == 0 and code.find_callers(g, "unknown").count() == 0
    assert {(r["bucket"], r["node"]) for r in code.symbol_edges(g, "app.main").collect()} == {("imports", "lib.utils")}
    assert {(r["bucket"], r["node"]) for r in code.impact(g, "lib.utils").collect()} == {("modules_affected", "lib.utils.helper"), ("tests", "tests.test_utils")}
    assert graph.find_paths(g, "lib.utils.helper", "app.main").count() == 0
    assert graph.find_paths(g, "lib.utils.helper", "app.main.run", directed=False).count() == 1


# ---- the prepared store


def ordinals(store, direction, nodes):
    frontier = store.spark.createDataFrame([(n,) for n in nodes], "node string")
    return sorted((r["node"], r["ord"], r["other"], r["rel"]) for r in store.touched(frontier, len(nodes), direction).collect())


def plain_ordinals(edges, direction):
    """What ordinals are: places among a node's edges, in their order; of a loop, the side along it first."""
    seen = defaultdict(list)
    for a, b, r in edges:
        if direction != "in":
            seen[a].append((b, r))
        if direction != "out":
            seen[b].append((a, r))
    return sorted((n, i, x, r) for n, found in seen.items() for i, (x, r) in enumerate(found, 1))


@pytest.mark.parametrize(("direction", "limit"), [("out", 50_000), ("in", 0), ("both", 0), ("both", 50_000)])
def test_ordinals_of_two_levels(spark, monkeypatch, direction, limit):
    """Blocks of three edges over five parts: places in all earlier blocks of a node add up, by either kind of join."""
    monkeypatch.setattr(adjacency, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(adjacency, "PUSHED_ROWS", limit)
    rng = random.Random(3)
    nodes = [f"n{i}" for i in range(6)]
    edges = [(rng.choice(nodes[:2]) if i % 3 else rng.choice(nodes), rng.choice(nodes), rng.choice(RELS)) for i in range(90)]
    store = adjacency.AdjacencyStore(as_frames(spark, nodes, edges).edges, block=3, parts=5)
    assert ordinals(store, direction, [*nodes, "ghost"]) == plain_ordinals(edges, direction)
    blocks, hubs, _ = store.direction(direction)
    assert blocks.agg(F.max("count")).first()[0] <= 3 and hubs.count() >= 2
    got = {r["node"]: r["count"] for r in store.degrees(spark.createDataFrame([(n,) for n in nodes], "node string"), 6, direction).collect()}
    assert got == {n: max(o for m, o, *_ in plain_ordinals(edges, direction) if m == n) for n in {m for m, *_ in plain_ordinals(edges, direction)}}


@pytest.mark.parametrize("limit", [50_000, 0])
def test_hub_of_a_third_of_all_edges(spark, monkeypatch, limit):
    """No task reads more of a hub than a few blocks, and the others' scan reads none of its row groups."""
    monkeypatch.setattr(adjacency, "BROADCAST_ROWS", limit)
    n = 30_000
    edges = spark.range(n).select(F.when(F.col("id") % 3 == 0, "hub").otherwise(F.concat(F.lit("x"), F.col("id") % 700)).alias("src"), F.concat(F.lit("y"), F.col("id")).alias("dst"), F.lit("calls").alias("rel"), F.col("id").alias("pos"))
    store = adjacency.AdjacencyStore(edges, block=256, parts=12)
    hub = spark.createDataFrame([("hub",)], "node string")
    kept = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        found = store.touched(hub, 1 if limit else 10**9, "out").withColumn("task", F.spark_partition_id())
        by_task = [r["count"] for r in found.groupBy("task").count().collect()]
        assert sum(by_task) == n // 3 and len(by_task) >= 4 and max(by_task) <= 12 * 256
        assert found.agg(F.max("ord"), F.min("ord"), F.count_distinct("ord")).first() == (n // 3, 1, n // 3)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", kept[0])
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept[1])
    pushed = store.touched(spark.createDataFrame([("x7",)], "node string"), 1, "out")._jdf.queryExecution().executedPlan().toString()
    assert "x7" in pushed[pushed.index("PushedFilters") :] or not limit


def test_store_is_found_again(spark, tmp_path, monkeypatch):
    """Queries over the same files write their edges once; changed files make a new store."""
    written, prepare = [], adjacency.AdjacencyStore._prepare
    monkeypatch.setattr(adjacency.AdjacencyStore, "_prepare", lambda self, direction: written.append(direction) or prepare(self, direction))
    path = str(tmp_path / "edges")
    as_frames(spark, ["a", "b"], [("a", "b", "calls"), ("b", "a", "uses")]).edges.write.parquet(path)

    def ask():
        return adjacency.AdjacencyStore.of_files(spark.read.parquet(path), [path], "test")

    for _ in range(3):
        assert ordinals(ask(), "out", ["a"]) == [("a", 1, "b", "calls")]
    assert written == ["out"]
    as_frames(spark, ["a", "b"], [("b", "b", "calls")]).edges.write.mode("overwrite").parquet(path)
    assert ordinals(ask(), "out", ["a", "b"]) == [("b", 1, "b", "calls")] and written == ["out", "out"]


# ---- first paths


@pytest.mark.parametrize("seed", [1, 3])
def test_first_paths_in_small_batches(spark, monkeypatch, seed):
    """Batches of few walks, so that most prefixes wait; dense multigraphs with loops and parallel edges."""
    monkeypatch.setattr(traverse, "FEW_WALKS", 2)
    monkeypatch.setattr(traverse, "NEAR_EDGES", -1)
    monkeypatch.setattr(traverse, "FEW_EDGES", [5000, 5, 5000, -1][seed])
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(5)]
    edges = [(rng.choice(nodes), rng.choice(nodes), rng.choice(RELS)) for _ in range(14)]
    g, directed, cap = as_frames(spark, nodes, edges), bool(seed % 2), [1, 4, 9, 25, 60][seed]
    got = [(r["nodes"], r["rels"]) for r in traverse.simple_paths(traverse.store_of(g), "n0", "n4", 4, cap, directed).orderBy("rank").collect()]
    assert got == model_paths(edges, "n0", "n4", 4, directed, cap)


def test_layers_expand_little(spark, monkeypatch):
    """Eight layers of twelve nodes, each joined with all of the next: 12 ** 7 paths, of which ten are wanted."""
    monkeypatch.setattr(traverse, "NEAR_EDGES", -1)
    layers = [["s"], *([f"l{i}.{j:02}" for j in range(12)] for i in range(7)), ["t"]]
    edges = [(a, b, "calls") for here, there in zip(layers, layers[1:], strict=False) for a in here for b in there]
    g = as_frames(spark, sorted({x for e in edges for x in e[:2]}), edges)
    finder = traverse.PathFinder(traverse.store_of(g), "s", "t", 8, 10, True)
    found = sorted((r["key"], r["nodes"]) for r in finder.first(8).collect())[:10]
    assert len(found) == 10 and [n for _, n in found] == [n for n, _ in model_layers(layers, 10)]
    assert finder.expanded <= 8 * 12 * 12 * 12


def model_layers(layers, most):
    import itertools

    return [(list(p), None) for p in itertools.islice(itertools.product(*layers), most)]


# ---- stores on demand


def test_on_demand_is_the_same(spark, monkeypatch):
    """A store that orders the edges met alone, by windows or as blocks, gives what the models give, and prepares nothing."""
    monkeypatch.setattr(adjacency.AdjacencyStore, "_prepare", lambda self, direction: pytest.fail("a whole direction was prepared"))
    rng = random.Random(11)
    nodes = [f"n{i}" for i in range(7)]
    edges = [(rng.choice(nodes), rng.choice(nodes), rng.choice(RELS)) for _ in range(24)]
    plain = as_frames(spark, nodes, edges)
    store = adjacency.AdjacencyStore(plain.edges, block=3, parts=3)
    store.on_demand = True
    g = PropertyGraph(plain.nodes, plain.edges, store)
    for few in (100_000, 3):
        monkeypatch.setattr(adjacency, "ORDERED_ROWS", few)
        for direction in ("in", "both"):
            assert ordinals(store, direction, [*nodes, "ghost"]) == plain_ordinals(edges, direction)
    monkeypatch.setattr(traverse, "FEW_EDGES", 4)  # so that searches become tables
    got = [(r["nodes"], r["rels"]) for r in traverse.simple_paths(store, "n0", "n4", 3, 9, False).orderBy("rank").collect()]
    assert got == model_paths(edges, "n0", "n4", 3, False, 9)
    calls = [(a, b, r) for a, b, r in edges if "call" in r]
    level = {"n1": 0}
    for step in (1, 2):
        level |= {a: step for a, b, _ in calls if level.get(b) == step - 1 and a not in level}
    want = sorted((a, r, level[b] + 1) for a, b, r in calls if b in level)
    for cap in (None, 1000):
        rows = traverse.caller_rows(traverse.Around(store, "in", F.col("rel").contains("call")), spark.createDataFrame([("n1",)], "node string"), True, 3, cap)
        assert sorted((r["caller"], r["rel"], r["depth"]) for r in rows.collect()) == want


def test_queries_from_few_nodes_prepare_no_store(spark, monkeypatch):
    """What they shuffle and write is that of the edges at their nodes."""
    import os

    from skeinwork.plans import queries as plans

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("needs the test tables")
    monkeypatch.setattr(adjacency.AdjacencyStore, "_prepare", lambda self, direction: pytest.fail("a whole direction was prepared"))
    monkeypatch.setattr(adjacency.AdjacencyStore, "path", property(lambda self, made=f"/tmp/none-{random.random()}": made))
    found = {name: plans.queries()[name](spark, d).count() for name in ("subgraph_edges", "callers_direct", "callers_transitive", "callers_capped")}
    assert all(found.values())
