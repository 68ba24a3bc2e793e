"""Graphs, a catalog and cards derived from the star tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.model import Catalog, PropertyGraph
from skeinwork.operators.adjacency import AdjacencyStore
from skeinwork.operators.substring_index import SubstringIndex
from skeinwork.sources.system_tables import SystemTables

#: The tables of which the entity graph has edges.
ENTITY_TABLES = ("orders", "customer", "nation", "supplier", "lineitem")
NODE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _id(prefix: str, column: str):
    return F.concat(F.lit(f"{prefix}:"), F.col(column).cast("string"))


def entity_graph(spark: SparkSession, sf_dir: str, indexed: bool = False) -> PropertyGraph:
    """Orders call customers call nations call regions; suppliers import nations; orders use parts; parts depend on suppliers."""
    t = lambda name: table(spark, sf_dir, name)
    edge = lambda frame, a, acol, b, bcol, rel: frame.select(_id(a, acol).alias("src"), _id(b, bcol).alias("dst"), F.lit(rel).alias("rel"))
    items = t("lineitem")
    parts = [
        edge(t("orders"), "order", "o_orderkey", "customer", "o_custkey", "calls"),
        edge(t("customer"), "customer", "c_custkey", "nation", "c_nationkey", "calls"),
        edge(t("nation"), "nation", "n_nationkey", "region", "n_regionkey", "calls"),
        edge(t("supplier"), "supplier", "s_suppkey", "nation", "s_nationkey", "imports"),
        edge(items.select("l_orderkey", "l_partkey").distinct(), "order", "l_orderkey", "part", "l_partkey", "uses"),
        edge(items.select("l_partkey", "l_suppkey").distinct(), "part", "l_partkey", "supplier", "l_suppkey", "depends-on"),
    ]
    edges = parts[0]
    for part in parts[1:]:
        edges = edges.unionByName(part)
    edges = edges.select("*", F.when(F.col("rel") == "calls", "EXTRACTED").otherwise("INFERRED").alias("confidence"), F.struct("src", "dst", "rel").alias("pos"))
    node = lambda name, kind, key, label: t(name).select(_id(kind, key).alias("id"), F.col(label).cast("string").alias("label"), F.lit(f"entity/{kind}").alias("type"))
    nodes = node("region", "region", "r_regionkey", "r_name")
    for name, kind, key, label in (("nation", "nation", "n_nationkey", "n_name"), ("customer", "customer", "c_custkey", "c_name"), ("supplier", "supplier", "s_suppkey", "s_name"), ("part", "part", "p_partkey", "p_name"), ("orders", "order", "o_orderkey", "o_orderpriority")):
        nodes = nodes.unionByName(node(name, kind, key, label))
    # the store is found again by later queries, as long as the tables stay as they are
    store = AdjacencyStore.of_files(edges, [os.path.join(sf_dir, f"{name}.parquet") for name in ENTITY_TABLES], "entities", on_demand=True)
    nodes = nodes.withColumn("pos", F.col("id"))
    files = [os.path.join(sf_dir, f"{name}.parquet") for name in NODE_TABLES]
    return PropertyGraph(nodes, edges, store, SubstringIndex(nodes, files=files, label="entities") if indexed else None)


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The catalog of the system tables below, as large as the star."""
    return SystemTables(system_tables(spark, sf_dir)).catalog()


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cards: (card_id, project, title, status, priority, created_at, updated_at), times as text, the last shipment as update."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    shipped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("shipped"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    status = F.when((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P"), "Blocked").when(F.col("o_orderstatus") == "O", "Created").when(F.col("o_orderstatus") == "P", "In Progress").otherwise("Complete")
    joined = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).join(shipped, "o_orderkey", "left")
    return joined.select(F.col("o_orderkey").alias("card_id"), F.col("c_mktsegment").alias("project"), F.col("c_name").alias("title"), status.alias("status"), F.col("o_orderpriority").alias("priority"), stamp("o_orderdate").alias("created_at"), stamp("shipped").alias("updated_at"))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").alias("card_id"), F.col("turn").alias("comment_id"), F.col("role").alias("author"), F.col("text").alias("comment"), F.lpad(F.col("turn").cast("string"), 6, "0").alias("created_at"))


def card_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as patches: the card is the user, the type sets the status, and clicks set the priority from props."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    return e.select(
        F.col("user_id").cast("string").alias("card_id"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("description"), F.col("event_type").alias("status"),
        F.when(F.col("event_type") == "click", k).alias("priority"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.struct("ts", "event_id").alias("seq"),
    )


#: Type codes given to parts as objects, and data types given to orders as columns.
OBJECT_TYPES = ("P ", "PC", "FN", "IF", "TF", "FS", "FT", "V ", "U ")
DATA_TYPES = ("int", "nvarchar", "nchar", "decimal", "varchar")
#: The table that lookups are about, and objects around which the catalog is extracted: tables, a shipped one, and routines.
TABLE_ID = 4
EXTRACT_IDS = (3, 4, 10, 77, 1_000_005, 1_000_012)


def system_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """System tables as large as the star: customers are tables, their orders columns, parts routines and other objects."""
    t = lambda name: table(spark, sf_dir, name)
    none = F.lit(None).cast("timestamp")
    order = t("orders")
    kind = F.element_at(F.array(*map(F.lit, OBJECT_TYPES)), (F.col("p_size") % len(OBJECT_TYPES) + 1).cast("int"))
    other = order.select(F.col("o_orderkey").alias("x"), F.col("o_custkey").alias("y"))
    linked = order.join(other.hint("merge"), F.col("x") == F.col("o_orderkey") - 1)  # as large as the star, whatever the files' sizes say
    text = lambda prefix, column: F.concat(F.lit(prefix), F.col(column).cast("string"))
    return {
        "schemas": t("nation").select(F.col("n_nationkey").alias("schema_id"), F.col("n_name").alias("name")),
        "tables": t("customer").select(F.col("c_custkey").alias("object_id"), F.col("c_nationkey").alias("schema_id"), F.col("c_name").alias("name"), none.alias("create_date"), none.alias("modify_date"), F.lit(0).alias("is_memory_optimized"), F.col("c_mktsegment").alias("temporal_type_desc"), (F.col("c_custkey") % 10 == 0).alias("is_ms_shipped")),
        "columns": order.select(
            F.col("o_custkey").alias("object_id"), F.col("o_orderkey").alias("column_id"), text("c", "o_orderkey").alias("name"), F.substring("o_orderpriority", 1, 1).cast("int").alias("user_type_id"), (F.col("o_orderkey") % 40 - 1).cast("int").alias("max_length"), F.lit(10).alias("precision"),
            F.lit(0).alias("scale"), (F.col("o_orderkey") % 2).cast("int").alias("is_nullable"), F.lit(0).alias("is_identity"), F.lit(0).alias("is_computed"), F.lit(None).cast("string").alias("collation_name"),
        ),
        "types": spark.createDataFrame(list(enumerate(DATA_TYPES, 1)), "user_type_id int, name string"),
        "default_constraints": order.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("parent_object_id"), F.col("o_orderkey").alias("parent_column_id"), text("default ", "o_orderkey").alias("definition")),
        "computed_columns": order.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("object_id"), F.col("o_orderkey").alias("column_id"), text("computed ", "o_orderkey").alias("definition")),
        "key_constraints": t("customer").select(F.col("c_custkey").alias("parent_object_id"), F.lit(1).alias("unique_index_id"), text("key ", "c_custkey").alias("name"), F.when(F.col("c_custkey") % 3 > 0, "PK").otherwise("UQ").alias("type")),
        "index_columns": order.select(F.col("o_custkey").alias("object_id"), F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(2).alias("index_id"), F.col("o_orderkey").alias("column_id"), (F.col("o_orderkey") % 4).cast("int").alias("key_ordinal")),
        "foreign_keys": order.select(F.col("o_orderkey").alias("object_id"), text("fk ", "o_orderkey").alias("name"), F.lit("NO_ACTION").alias("delete_referential_action_desc"), F.lit("CASCADE").alias("update_referential_action_desc"), F.lit(0).alias("is_disabled"), F.lit(1).alias("is_not_trusted")),
        "foreign_key_columns": linked.select(F.col("o_orderkey").alias("constraint_object_id"), F.lit(1).alias("constraint_column_id"), F.col("o_custkey").alias("parent_object_id"), F.col("o_orderkey").alias("parent_column_id"), F.col("y").alias("referenced_object_id"), F.col("x").alias("referenced_column_id")),
        "objects": t("part").select((F.col("p_partkey") + 1_000_000).alias("object_id"), (F.col("p_partkey") % 25).cast("int").alias("schema_id"), F.concat_ws(" ", "p_name", "p_partkey").alias("name"), kind.alias("type"), F.col("p_type").alias("type_desc"), none.alias("create_date"), none.alias("modify_date"), (F.col("p_partkey") % 7 == 0).alias("is_ms_shipped")),
        "sql_modules": t("part").filter("p_partkey % 3 <> 0").select((F.col("p_partkey") + 1_000_000).alias("object_id"), F.col("p_brand").alias("definition"), F.lit(0).alias("is_schema_bound"), F.lit(1).alias("uses_ansi_nulls"), F.lit(1).alias("uses_quoted_identifier")),
        "sql_expression_dependencies": t("lineitem").join(order.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).select(
            (F.col("l_partkey") + 1_000_000).alias("referencing_id"), F.when(F.col("l_linenumber") != 3, F.col("o_custkey")).alias("referenced_id"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_orderkey")).otherwise(0).alias("referenced_minor_id"),
            F.when(F.col("l_linenumber") == 2, F.lit("named")).alias("referenced_schema_name"), F.when(F.col("l_linenumber") == 2, text("entity ", "o_custkey")).alias("referenced_entity_name"), F.lit(0).alias("is_schema_bound_reference"), F.lit(0).alias("is_ambiguous"),
        ),
    }
