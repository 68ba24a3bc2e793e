"""Operators over schema graphs: tables, columns, search, relationships, paths, routines."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.functions import predicates as P
from skeinwork.model import Catalog, PropertyGraph
from skeinwork.operators import traverse
from skeinwork.operators.adjacency import AdjacencyStore
from skeinwork.operators.catalog_build import build_targeted, generic
from skeinwork.storage import stored

DEPTHS = {"table": 1, "column": 1, "relationships": 1, "routine": 2}
DEPTH_VARIABLE = "SKEINWORK_SCHEMA_DEPTH"


def depth_of(kind: str) -> int:
    """The depth of targeted builds: the environment's, where it is a whole number of 0 or more, else the kind's own."""
    given = (os.environ.get(DEPTH_VARIABLE) or "").strip()
    try:
        return int(given) if int(given) >= 0 else DEPTHS[kind]
    except ValueError:
        return DEPTHS[kind]


def _bare(name: str) -> str:
    return name.split(":", 1)[1] if ":" in name else name


def _touching(graph: PropertyGraph, table: str) -> DataFrame:
    out = P.without_prefix("source") == table
    return graph.edges.filter(out | (P.without_prefix("target") == table)).select(F.when(out, "outgoing").otherwise("incoming").alias("direction"), F.when(out, P.without_prefix("target")).otherwise(P.without_prefix("source")).alias("node"), "relationship")


def table_lookup(catalog: Catalog, table: str) -> tuple[DataFrame, DataFrame]:
    """The Table node, and (direction, node, relationship) of the edges at it; no node where the table is unknown."""
    graph = build_targeted(catalog, table, "table", depth_of("table"))
    node = graph.nodes.filter((P.without_prefix("id") == table) & (F.col("node_type") == "Table")).limit(1)
    return node, _touching(graph, table)


def column_lookup(catalog: Catalog, table: str, column: str) -> DataFrame:
    """The Column node of a table's column, or no row."""
    graph = build_targeted(catalog, f"{table}.{column}", "column", depth_of("column"))
    return graph.nodes.filter((P.without_prefix("id") == f"{table}.{column}") & (F.col("node_type") == "Column")).limit(1)


def schema_search(graph: PropertyGraph, query: str, object_type: str | None = None) -> DataFrame:
    """(id, label, type) of nodes whose id or qualified name holds the query."""
    label = F.coalesce(F.nullif(P.text("qualified_name"), F.lit("")), F.nullif(P.text("name"), F.lit("")), F.lit(""))
    return graph.nodes.filter(P.holds(query, "id", "qualified_name") & P.equal_if_given("node_type", object_type)).select("id", label.alias("label"), F.col("node_type").alias("type"))


def table_relationships(catalog: Catalog, table: str) -> DataFrame:
    """(direction, node, relationship) at a table; foreign keys join columns, so they are in table_fk_pairs instead."""
    return _touching(build_targeted(catalog, table, "table", depth_of("relationships")), table)


def table_fk_pairs(catalog: Catalog, table: str) -> DataFrame:
    """An extension: (direction, foreign_key_name, column, other_table, other_column) of a table's foreign keys."""
    full = lambda side: F.concat_ws(".", f"{side}_schema", f"{side}_table")
    keys = catalog.foreign_keys
    out = keys.filter(full("parent") == table).select(F.lit("outgoing").alias("direction"), "foreign_key_name", F.col("parent_column").alias("column"), full("referenced").alias("other_table"), F.col("referenced_column").alias("other_column"))
    back = keys.filter(full("referenced") == table).select(F.lit("incoming").alias("direction"), "foreign_key_name", F.col("referenced_column").alias("column"), full("parent").alias("other_table"), F.col("parent_column").alias("other_column"))
    return out.unionByName(back)


def relationship_paths(graph: PropertyGraph, first: str, second: str, relationships: list[str] | None = None, cap: int = 5) -> DataFrame:
    """(rank, nodes, rels): the first paths of at most ten nodes between two tables, over edges of any kind either way."""
    wanted = F.col("rel").isin(*relationships) if relationships else None
    store = graph.adjacency
    if store is None:  # edges that are not wanted need not be built, and leave the order of the others as it is
        edges = generic(graph).edges.select("src", "dst", "rel", "pos")
        store = AdjacencyStore(stored(edges if wanted is None else edges.filter(wanted), "edges"))
        store.on_demand = True
    found = traverse.simple_paths(store, f"table:{_bare(first)}", f"table:{_bare(second)}", 9, cap, False, wanted)
    return found.withColumn("nodes", F.transform("nodes", lambda x: F.regexp_replace(x, "^[^:]*:", "")))


def routine_dependencies(catalog: Catalog, routine: str) -> DataFrame:
    """(bucket, node): the tables and columns that a routine depends on."""
    graph = build_targeted(catalog, routine, "procedure", depth_of("routine"))
    rows = graph.edges.filter((P.without_prefix("source") == routine) & (F.col("relationship") == "Creates"))
    return rows.select(F.when(F.col("target").startswith("column:"), "columns").otherwise("tables").alias("bucket"), P.without_prefix("target").alias("node"))
