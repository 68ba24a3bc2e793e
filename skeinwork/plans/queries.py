"""Query name -> plan over the star tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork import sinks
from skeinwork.functions import predicates as P
from skeinwork.model import PropertyGraph
from skeinwork.operators import board, catalog_build, code, freshness, graph, schema
from skeinwork.operators import cards as card_ops
from skeinwork.operators.ordinals import with_ordinals
from skeinwork.plans import workload
from skeinwork.sources.system_tables import SystemTables

#: Folders that the workload calls generated.
GENERATED = ("graph-out/", ".graphs/db/")
Query = Callable[[SparkSession, str], DataFrame]


def _joined(name: str):
    return F.array_join(name, ">").alias(name)


def _nodes(df: DataFrame) -> DataFrame:
    return df.select("id", "label", "type")


def _on_graph(plan: Callable[[PropertyGraph], DataFrame]) -> Query:
    return lambda spark, sf_dir: plan(workload.entity_graph(spark, sf_dir))


def _on_catalog(plan) -> Query:
    return lambda spark, sf_dir: plan(workload.catalog(spark, sf_dir))


def _on_cards(plan) -> Query:
    return lambda spark, sf_dir: plan(workload.cards(spark, sf_dir))


def _paths(df: DataFrame) -> DataFrame:
    return df.select(F.col("rank").cast("long").alias("rank"), _joined("nodes"), _joined("rels"))


def _built(c) -> PropertyGraph:
    return catalog_build.build_graph(c)


def _first(rows: DataFrame, order: str, name: tuple[str, ...]) -> str:
    """The dotted name in the first row; nothing's name where there is none."""
    row = rows.orderBy(order).select(F.concat_ws(".", *name)).first()
    return row[0] if row else "none.none"


def _table(c) -> str:
    return _first(c.tables.filter(F.col("object_id") == workload.TABLE_ID), "object_id", ("schema_name", "table_name"))


def _column(c) -> str:
    return _first(c.columns.filter(F.col("table_object_id") == workload.TABLE_ID), "column_id", ("column_name",))


def _referenced(c) -> str:
    """A table that the table refers to."""
    keys = c.foreign_keys.filter((F.col("parent_object_id") == workload.TABLE_ID) & (F.col("referenced_object_id") != workload.TABLE_ID))
    return _first(keys, "foreign_key_name", ("referenced_schema", "referenced_table"))


def _procedure(c) -> str:
    return _first(c.routines.filter(F.rtrim("object_type_code").isin(*catalog_build.PROCEDURES)), "object_id", ("schema_name", "object_name"))


def _catalog_nodes(g: PropertyGraph) -> DataFrame:
    return g.nodes.select(
        "id", "node_type", "name", "qualified_name", F.coalesce("object_id", "table_object_id").cast("long").alias("object_id"), F.coalesce("column_id", F.lit(0)).cast("long").alias("column_id"), "type_display",
        F.coalesce("is_primary_key", F.lit(False)).alias("is_primary_key"), F.coalesce("is_foreign_key", F.lit(False)).alias("is_foreign_key"), F.coalesce("is_referenced_key", F.lit(False)).alias("is_referenced_key"), "definition_sha256",
    )


def _catalog_edges(g: PropertyGraph) -> DataFrame:
    return g.edges.select("source", "target", "relationship", F.col("key").cast("long").alias("key"), F.coalesce("ordinal", F.lit(0)).cast("long").alias("ordinal"), "foreign_key_name", "target_kind")


def _ids(g: PropertyGraph) -> DataFrame:
    return g.nodes.select(F.lit("node").alias("kind"), F.col("id").alias("name")).unionByName(g.edges.select(F.lit("edge").alias("kind"), F.concat_ws(" ", "source", "relationship", "target").alias("name")))


def _card_columns(df: DataFrame) -> DataFrame:
    return df.select("card_id", "project", "title", "status", "priority", "created_at", "updated_at")


def _with_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = card_ops.card_with_comments(workload.cards(spark, sf_dir), workload.comments(spark, sf_dir), 0)
    return rows.select("card_id", "status", "comment_id", "author", "comment")


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return card_ops.current_state(workload.card_events(spark, sf_dir)).select("card_id", "status", "priority", "created_at", "updated_at")


def _fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = workload.table(spark, sf_dir, "events")
    return freshness.changed_fingerprints(events, "user_id", "event_id", "event_type", "props").select("event_id", "user_id", "fingerprint", "changed")


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return workload.table(spark, sf_dir, "pages").select("page_id", path.alias("path")).filter(P.is_relevant_source(F.col("path"), GENERATED)).select("page_id", "path")


def _project_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = workload.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("project")).unionByName(spark.createDataFrame([("ARCHIVE",)], "project string"))
    return board.project_order(workload.cards(spark, sf_dir), named).withColumn("place", F.col("place").cast("long"))


def _json_facts(x) -> DataFrame:
    """What the JSON lines of a built catalog tell, read back from them."""
    lines, get = sinks.json_lines(_built(x)), lambda key: F.get_json_object("line", f"$.{key}")
    return lines.select("kind", F.coalesce(get("id"), F.concat_ws(" ", get("source"), get("target"))).alias("name"), F.coalesce(get("node_type"), get("relationship")).alias("type"), get("qualified_name").alias("qualified_name"), F.coalesce(get("key").cast("long"), F.lit(-1)).alias("key"))


def _xml_facts(x) -> DataFrame:
    """What the GraphML lines of a built catalog tell, read back from them."""
    find = lambda pattern: F.nullif(F.regexp_extract("line", pattern, 1), F.lit(""))
    name = F.coalesce(find('<node id="([^"]*)"'), F.concat_ws(" ", find('source="([^"]*)"'), find('target="([^"]*)"')))
    kind = F.coalesce(find('key="n_node_type">([^<]*)<'), find('key="e_relationship">([^<]*)<'))
    return sinks.graphml_lines(_built(x)).select("kind", name.alias("name"), kind.alias("type"), find('key="n_qualified_name">([^<]*)<').alias("qualified_name"), F.coalesce(find('key="e_key">([^<]*)<').cast("long"), F.lit(-1)).alias("key"))


def _numbered_edges(x) -> DataFrame:
    """Edges with the number that documents give them."""
    rows = _built(x).edges.select("source", "target", "relationship", "key", F.col("pos.kind").alias("kind"), F.col("pos.name").alias("name"), F.col("pos.number").alias("number"))
    return with_ordinals(rows, "source", "kind", "name", "number", "target", "key").select(F.concat(F.lit("edge-"), F.col("ordinal").cast("string")).alias("edge_uid"), "source", "target", "relationship", F.col("key").cast("long").alias("key"))


def _card_page(x: DataFrame) -> DataFrame:
    return _card_columns(board.card_page(card_ops.list_cards(x, "In Progress")))


def _attributes(g: PropertyGraph) -> DataFrame:
    """Nodes by an attribute outside the fixed columns."""
    with_attrs = PropertyGraph(g.nodes.withColumn("attrs", F.to_json(F.struct("id", "label", F.length("label").alias("size")))), g.edges)
    size = F.get_json_object("attrs", "$.size").cast("long")
    return graph.search_nodes(with_attrs, "1", "customer", fuzzy=True, limit=1_000_000).select("id", size.alias("size"))


#: Columns of the extracted row sets that are not the same in every row.
EXTRACTED = {
    "tables": "schema_name table_name object_id temporal_type_desc",
    "columns": "schema_name table_name table_object_id column_id column_name data_type max_length is_nullable default_definition computed_definition",
    "primary_keys": "schema_name table_name column_name constraint_name key_ordinal",
    "foreign_keys": "foreign_key_name parent_schema parent_table parent_column referenced_schema referenced_table referenced_column parent_object_id referenced_object_id update_referential_action_desc",
    "routines": "schema_name object_name object_id object_type_code type_desc definition",
    "dependencies": "referencing_object_id referencing_schema referencing_name referencing_type_code referenced_id referenced_minor_id referenced_schema referenced_table referenced_column",
}


def _extract(name: str, ids: tuple[int, ...] | None = None) -> Query:
    def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = getattr(SystemTables(workload.system_tables(spark, sf_dir), ids), name)()
        return found.select(*((F.col(c).cast("long").alias(c) if t == "int" else c) for c, t in found.dtypes if c in EXTRACTED[name].split()))

    return plan


def queries() -> dict[str, Query]:
    c = _on_catalog
    extracts = {f"catalog_extract_{name}": _extract(name) for name in EXTRACTED} | {f"catalog_extract_{name}_of_ids": _extract(name, workload.EXTRACT_IDS) for name in EXTRACTED}
    return extracts | {
        "search_nodes_exact": _on_graph(lambda g: _nodes(graph.search_nodes(g, "nation:7"))),
        "search_nodes_fuzzy": _on_graph(lambda g: _nodes(graph.search_nodes(g, "SUPPLIER:1", fuzzy=True, limit=1_000_000))),
        "search_nodes_typed_limit": _on_graph(lambda g: _nodes(graph.search_nodes(g, "1", node_type="customer", fuzzy=True, limit=50))),
        "search_nodes_indexed": lambda spark, sf_dir: _nodes(graph.search_nodes(workload.entity_graph(spark, sf_dir, indexed=True), "SUPPLIER:1", fuzzy=True, limit=1_000_000)),
        "search_symbols_indexed": lambda spark, sf_dir: _nodes(code.search_symbols(workload.entity_graph(spark, sf_dir, indexed=True), "00077", "entity/customer")),
        "get_node": _on_graph(lambda g: _nodes(graph.get_node(g, "part:3"))),
        "neighbors_both": _on_graph(lambda g: graph.neighbors(g, "nation:7")),
        "neighbors_out_rel": _on_graph(lambda g: graph.neighbors(g, "order:5", "outgoing", "uses")),
        "find_paths_directed": _on_graph(lambda g: _paths(graph.find_paths(g, "order:5", "region:0"))),
        "find_paths_undirected": _on_graph(lambda g: _paths(graph.find_paths(g, "order:5", "region:0", max_depth=4, directed=False))),
        "subgraph_nodes": _on_graph(lambda g: _nodes(graph.subgraph(g, ["order:5", "unknown:1"], 2).nodes)),
        "subgraph_edges": _on_graph(lambda g: graph.subgraph(g, ["order:5", "unknown:1"], 2).edges.select("src", "dst", "rel")),
        "graph_counts": _on_graph(graph.counts),
        "get_symbol_edges": _on_graph(lambda g: code.symbol_edges(g, "nation:7")),
        "search_symbols": _on_graph(lambda g: _nodes(code.search_symbols(g, "Nation", "entity/nation"))),
        "dependencies": _on_graph(lambda g: code.dependencies(g, "order:5", 2).withColumns({"depth": F.col("depth").cast("long"), "order_key": F.array_join("order_key", ",")})),
        "callers_direct": _on_graph(lambda g: code.find_callers(g, "region:0").withColumn("depth", F.col("depth").cast("long"))),
        "callers_transitive": _on_graph(lambda g: code.find_callers(g, "region:0", True, 3, cap=None).withColumn("depth", F.col("depth").cast("long"))),
        "callers_capped": _on_graph(lambda g: code.find_callers(g, "region:0", True, 5).withColumn("depth", F.col("depth").cast("long"))),
        "impact_analysis": _on_graph(lambda g: code.impact(g, "customer:7")),
        "catalog_nodes": c(lambda x: _catalog_nodes(_built(x))),
        "catalog_edges": c(lambda x: _catalog_edges(_built(x))),
        "catalog_summary": c(lambda x: graph.counts(catalog_build.generic(_built(x), unified=True))),
        "table_lookup": c(lambda x: schema.table_lookup(x, _table(x))[1]),
        "column_lookup": c(lambda x: schema.column_lookup(x, _table(x), _column(x)).select("id", "data_type", "is_primary_key", "is_foreign_key", "is_referenced_key")),
        "schema_search": c(lambda x: schema.schema_search(_built(x), "C77", "Column")),
        "table_relationships": c(lambda x: schema.table_relationships(x, _table(x))),
        "table_fk_pairs": c(lambda x: schema.table_fk_pairs(x, _table(x))),
        "relationship_paths": c(lambda x: _paths(schema.relationship_paths(_built(x), _table(x), _referenced(x), ["Stores", "Links"]))),
        "routine_dependencies": c(lambda x: schema.routine_dependencies(x, _procedure(x))),
        "targeted_depth0": c(lambda x: _ids(catalog_build.build_targeted(x, _table(x), "table", 0))),
        "targeted_depth1": c(lambda x: _ids(catalog_build.build_targeted(x, _table(x), "table", 1))),
        "targeted_depth2": c(lambda x: _ids(catalog_build.build_targeted(x, _procedure(x), "procedure", 2))),
        "type_display": c(lambda x: x.columns.select("table_name", "column_name", P.type_display().alias("type_display"))),
        "cards_list": _on_cards(lambda x: _card_columns(card_ops.list_cards(x))),
        "cards_list_filtered": _on_cards(lambda x: _card_columns(card_ops.list_cards(x, "In Progress", "1-URGENT"))),
        "card_with_comments": _with_comments,
        "card_current_state": _current,
        "board_counts": _on_cards(board.column_counts),
        "board_top3": _on_cards(lambda x: board.newest(x).select("project", "bucket", F.col("place").cast("long").alias("place"), "card_id", "created_at")),
        "board_project_order": _project_order,
        "changed_fingerprint": _fingerprints,
        "relevant_sources": _sources,
        "graph_json_lines": c(_json_facts),
        "graph_graphml_lines": c(_xml_facts),
        "edge_ordinals": c(_numbered_edges),
        "graph_markdown_tables": c(lambda x: sinks.markdown_tables(_built(x))),
        "graph_markdown_links": c(lambda x: sinks.markdown_links(_built(x))),
        "graph_styles": c(lambda x: sinks.styled(_built(x)).nodes.select("id", "color", F.col("size").cast("long").alias("size"), "shape", "tooltip")),
        "card_page": _on_cards(_card_page),
        "node_attributes": _on_graph(_attributes),
    }


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capped transitive callers of a hub."""
    return queries()["callers_capped"](spark, sf_dir)
