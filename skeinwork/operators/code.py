"""Operators over code graphs: symbols, dependencies, callers, impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.functions import predicates as P
from skeinwork.model import PropertyGraph
from skeinwork.operators import traverse


def resolve(graph: PropertyGraph, match: Column) -> DataFrame:
    """(node): the first node in file order that matches; no row where none does."""
    return graph.nodes.filter(match).orderBy("pos").limit(1).select(F.col("id").alias("node"))


def search_symbols(graph: PropertyGraph, query: str, symbol_type: str | None = None) -> DataFrame:
    """Nodes whose id or label holds the query, of exactly the type if one is given."""
    return graph.nodes_like(query).filter(P.holds(query, "id", "label") & P.equal_if_given("type", symbol_type))


def symbol_edges(graph: PropertyGraph, symbol: str) -> DataFrame:
    """(bucket, node, rel) of a symbol: callers, callees and imports; an edge is of the first bucket that takes it."""
    found = F.broadcast(resolve(graph, P.symbol_matches(symbol)))
    at_source, at_target, calls = F.col("src") == F.col("node"), F.col("dst") == F.col("node"), P.text("rel").contains("calls")
    bucket = F.when(at_target & calls, "callers").when(at_source & calls, "callees").when(F.col("rel") == "imports", "imports")
    far = F.when(F.col("bucket") == "callers", F.col("src")).when(F.col("bucket") == "callees", F.col("dst")).otherwise(F.when(at_source, F.col("dst")).otherwise(F.col("src")))
    return graph.edges.join(found, at_source | at_target).withColumn("bucket", bucket).filter("bucket IS NOT NULL").select("bucket", far.alias("node"), "rel")


#: Relationships that count as incoming whatever the direction of the edge.
INCOMING = ("depends-on", "imports", "uses")


def dependencies(graph: PropertyGraph, symbol: str, depth: int = 2) -> DataFrame:
    """(bucket, node, rel, depth, order_key): the edges around a symbol, each once; buckets follow the relationship."""
    rows = traverse.dependency_rows(traverse.store_of(graph), resolve(graph, P.symbol_in_id(symbol)), depth)
    return rows.select(F.when(F.col("rel").isin(*INCOMING), "incoming").otherwise("outgoing").alias("bucket"), F.col("other").alias("node"), P.text("rel").alias("rel"), "depth", "order_key")


def find_callers(graph: PropertyGraph, symbol: str, transitive: bool = False, max_depth: int = 5, cap: int | None = 100) -> DataFrame:
    """(caller, rel, depth): the edges that call a symbol and, transitive, its callers."""
    calls = traverse.Around(traverse.store_of(graph), "in", P.text("rel").contains("call"))
    return traverse.caller_rows(calls, resolve(graph, P.symbol_in_id(symbol)), transitive, max_depth, cap)


def impact(graph: PropertyGraph, symbol: str) -> DataFrame:
    """(bucket, node): direct callers, and what the symbol's own edges lead to by the kind of target."""
    found = F.broadcast(resolve(graph, P.symbol_in_id(symbol)))
    rel, target = P.text("rel"), F.lower(P.text("dst"))
    inbound = (F.col("dst") == F.col("node")) & rel.contains("call")
    bucket = (
        F.when(inbound, "direct_callers")
        .when(target.contains("test"), "tests")
        .when(rel.contains("interface") | target.contains("interface"), "interfaces")
        .when(rel.contains("entry") | target.contains("entry"), "entry_points")
        .otherwise("modules_affected")
    )
    edges = graph.edges.join(found, inbound | (F.col("src") == F.col("node")))
    return edges.select(bucket.alias("bucket"), F.when(inbound, F.col("src")).otherwise(F.col("dst")).alias("node"))
