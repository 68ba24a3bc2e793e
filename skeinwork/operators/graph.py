"""Operators over any property graph: search, lookup, neighbours, paths, subgraphs, status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.functions import predicates as P
from skeinwork.model import PropertyGraph
from skeinwork.operators import traverse


def search_nodes(graph: PropertyGraph, query: str, node_type: str | None = None, fuzzy: bool = False, limit: int = 50) -> DataFrame:
    """The first `limit` nodes in file order whose id or label equals the query or, fuzzy, holds it without regard to case.

    node_type filters by containment. A limit of 0 or less gives no rows. A caller that gets `limit` rows must take the
    result as truncated.
    """
    match = P.holds(query, "id", "label") if fuzzy else P.exact(query, "id", "label")
    if node_type:
        match = match & P.type_holds(node_type)
    nodes = graph.nodes_like(query) if fuzzy else graph.nodes
    return nodes.filter(match).orderBy("pos").limit(max(0, limit))


def get_node(graph: PropertyGraph, node_id: str) -> DataFrame:
    """The first node of the id, or no row."""
    return graph.nodes.filter(F.col("id") == node_id).orderBy("pos").limit(1)


def neighbors(graph: PropertyGraph, node_id: str, direction: str = "both", relationship: str | None = None) -> DataFrame:
    """(direction, node, rel, confidence) of the edges at a node, one step away; a loop comes in both directions."""
    if direction not in ("outgoing", "incoming", "both"):
        raise ValueError(f"direction must be outgoing, incoming or both, not {direction!r}")
    edges = graph.edges.filter(P.equal_if_given("rel", relationship))
    sides = {"outgoing": ("src", "dst"), "incoming": ("dst", "src")}
    parts = [edges.filter(F.col(near) == node_id).select(F.lit(name).alias("direction"), F.col(far).alias("node"), P.text("rel").alias("rel"), "confidence") for name, (near, far) in sides.items() if direction in (name, "both")]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def find_paths(graph: PropertyGraph, source: str, target: str, max_depth: int = 5, directed: bool = True, cap: int = 10) -> DataFrame:
    """(rank, nodes, rels): the first simple paths in breadth-first order."""
    return traverse.simple_paths(traverse.store_of(graph), source, target, max_depth, cap, directed)


def subgraph(graph: PropertyGraph, seeds: list[str], depth: int = 1) -> PropertyGraph:
    """The known nodes within `depth` undirected steps of the seeds, and the edges between visited ids, in file order of pos."""
    start = graph.nodes.sparkSession.createDataFrame([(s,) for s in seeds], "node string")
    found, rows = traverse.distances(traverse.Around(traverse.store_of(graph), "both"), start, depth)
    visited = traverse.sized(found.select("node"), rows)
    nodes = graph.nodes.join(visited, graph.nodes["id"] == visited["node"], "left_semi")
    edges = graph.edges.join(visited.withColumnRenamed("node", "src"), "src", "left_semi").join(visited.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return PropertyGraph(nodes, edges.select(*graph.edges.columns))


def counts(graph: PropertyGraph) -> DataFrame:
    """(kind, name, n): nodes by type and edges by relationship; what has none counts as Unknown."""
    nodes = graph.nodes.groupBy(F.coalesce("type", F.lit("Unknown")).alias("name")).count().select(F.lit("node").alias("kind"), "name", F.col("count").alias("n"))
    edges = graph.edges.groupBy(F.coalesce("rel", F.lit("Unknown")).alias("name")).count().select(F.lit("edge").alias("kind"), "name", F.col("count").alias("n"))
    return nodes.unionByName(edges)
