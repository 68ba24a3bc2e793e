"""Catalog rows to a typed property multigraph, whole or around one object."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinwork.functions.predicates import type_display
from skeinwork.model import Catalog, PropertyGraph
from skeinwork.storage import checkpointed, stored

#: Object type codes of routines.
PROCEDURES, FUNCTIONS = ("P", "PC"), ("FN", "IF", "TF", "FS", "FT")
ENTRY_TYPES = ("table", "column", "procedure", "function")
#: Ids of objects up to this number are conditions, which go below the joins of a catalog; more are joined with its rows.
FEW_IDS = 10_000


def _name(*parts: str):
    return F.concat_ws(".", *parts)


def _flag(name: str):
    return F.coalesce(F.col(name).cast("boolean"), F.lit(False))


def _time(name: str):
    return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss")


def build_graph(catalog: Catalog, include_definitions: bool = False) -> PropertyGraph:
    """nodes and edges of a catalog: Table -Stores-> Column, Column -Links-> Column, Procedure or Function -Creates-> Table or Column.

    Nodes have id, node_type, name, qualified_name and their attributes as columns; edges have source, target,
    relationship, key (their ordinal among the edges of the same ends) and theirs. An edge whose ends are not both
    built is left out, yet the flags of key columns come from all foreign keys given. Of several primary keys of a
    column the last by name and ordinal counts. Type codes may be padded.

    Columns and foreign keys, which nodes and edges read several times, are stored first: a plan that held their joins
    each time would be too large for the driver.
    """
    return _graph_of(replace(catalog, columns=stored(catalog.columns, "columns"), foreign_keys=stored(catalog.foreign_keys, "foreign-keys")), include_definitions)


def _graph_of(catalog: Catalog, include_definitions: bool) -> PropertyGraph:
    """build_graph of row sets that are cheap to read again. Sides as large as the columns are shuffled: files are far smaller
    than the rows they hold, so by their sizes Spark would send such sides through the driver's memory.
    """
    tables = catalog.tables.select(
        F.concat(F.lit("table:"), _name("schema_name", "table_name")).alias("id"), F.lit("Table").alias("node_type"), F.col("table_name").alias("name"), _name("schema_name", "table_name").alias("qualified_name"),
        F.col("schema_name").alias("schema"), "object_id", _time("create_date").alias("created_at"), _time("modify_date").alias("modified_at"), _flag("is_memory_optimized").alias("is_memory_optimized"), F.col("temporal_type_desc").alias("temporal_type"),
    )
    key = ["schema_name", "table_name", "column_name"]
    last = W.partitionBy(*key).orderBy(F.desc("constraint_name"), F.desc("key_ordinal"))
    primary = catalog.primary_keys.withColumn("n", F.row_number().over(last)).filter("n = 1").select(*key, "constraint_name", "key_ordinal")
    ends = lambda side: catalog.foreign_keys.select(*(F.col(f"{side}_{x}").alias(k) for x, k in zip(("schema", "table", "column"), key, strict=True))).distinct()
    marked = catalog.columns.join(primary, key, "left").join(ends("parent").withColumn("fk", F.lit(True)).hint("merge"), key, "left").join(ends("referenced").withColumn("ref", F.lit(True)).hint("merge"), key, "left")
    columns = marked.select(
        F.concat(F.lit("column:"), _name(*key)).alias("id"), F.lit("Column").alias("node_type"), F.col("column_name").alias("name"), _name(*key).alias("qualified_name"), F.col("schema_name").alias("schema"), F.col("table_name").alias("table"),
        "table_object_id", "column_id", "data_type", type_display().alias("type_display"), "max_length", "precision", "scale", _flag("is_nullable").alias("nullable"), _flag("is_identity").alias("identity"), _flag("is_computed").alias("computed"),
        "default_definition", "computed_definition", F.col("collation_name").alias("collation"), F.col("constraint_name").isNotNull().alias("is_primary_key"), F.col("constraint_name").alias("primary_key_name"), F.col("key_ordinal").alias("primary_key_ordinal"),
        F.col("fk").isNotNull().alias("is_foreign_key"), F.col("ref").isNotNull().alias("is_referenced_key"),
    )
    code = F.rtrim("object_type_code")
    kind = F.when(code.isin(*PROCEDURES), "Procedure").when(code.isin(*FUNCTIONS), "Function")
    text = F.coalesce("definition", F.lit(""))
    routines = catalog.routines.withColumn("node_type", kind).filter("node_type IS NOT NULL").select(
        F.concat(F.lower("node_type"), F.lit(":"), _name("schema_name", "object_name")).alias("id"), "node_type", F.col("object_name").alias("name"), _name("schema_name", "object_name").alias("qualified_name"), F.col("schema_name").alias("schema"), "object_id",
        code.alias("sql_object_type"), F.col("type_desc").alias("sql_object_type_desc"), _time("create_date").alias("created_at"), _time("modify_date").alias("modified_at"), *(_flag(n).alias(n) for n in ("is_schema_bound", "uses_ansi_nulls", "uses_quoted_identifier")),
        (text != "").alias("has_definition"), F.when(text != "", F.sha2(text, 256)).alias("definition_sha256"), *([text.alias("definition")] if include_definitions else []),
    )
    nodes = tables.unionByName(columns, allowMissingColumns=True).unionByName(routines, allowMissingColumns=True)
    # ids of edges' ends: a link ends in columns, a reference in tables or columns; the marks of columns are not needed here
    known_columns = catalog.columns.select(F.concat(F.lit("column:"), _name(*key)).alias("id")).distinct()
    known = known_columns.unionByName(tables.select("id").distinct())

    stores = catalog.columns.select(
        F.concat(F.lit("table:"), _name("schema_name", "table_name")).alias("source"), F.concat(F.lit("column:"), _name(*key)).alias("target"), F.lit("Stores").alias("relationship"), F.col("column_id").alias("ordinal"),
        F.struct(F.lit(0).alias("kind"), F.lit("").alias("name"), F.col("column_id").alias("number")).alias("pos"),
    )
    linked = catalog.foreign_keys.select(
        F.concat(F.lit("column:"), _name("parent_schema", "parent_table", "parent_column")).alias("source"), F.concat(F.lit("column:"), _name("referenced_schema", "referenced_table", "referenced_column")).alias("target"), F.lit("Links").alias("relationship"),
        "foreign_key_name", "constraint_column_id", F.col("delete_referential_action_desc").alias("delete_action"), F.col("update_referential_action_desc").alias("update_action"), _flag("is_disabled").alias("is_disabled"), _flag("is_not_trusted").alias("is_not_trusted"),
        F.struct(F.lit(1).alias("kind"), F.col("foreign_key_name").alias("name"), F.col("constraint_column_id").alias("number")).alias("pos"),
    )
    linked = linked.join(known_columns.withColumnRenamed("id", "source").hint("merge"), "source", "left_semi").join(known_columns.withColumnRenamed("id", "target").hint("merge"), "target", "left_semi")
    by_object = routines.select(F.col("object_id").alias("referencing_object_id"), F.col("id").alias("source"))
    whole = (F.coalesce("referenced_column", F.lit("")) == "")
    depends = catalog.dependencies.filter("coalesce(referenced_schema, '') <> '' AND coalesce(referenced_table, '') <> ''").distinct().join(by_object, "referencing_object_id").select(
        "source", F.when(whole, F.concat(F.lit("table:"), _name("referenced_schema", "referenced_table"))).otherwise(F.concat(F.lit("column:"), _name("referenced_schema", "referenced_table", "referenced_column"))).alias("target"), F.lit("Creates").alias("relationship"),
        F.when(whole, "Table").otherwise("Column").alias("target_kind"), F.lit("sys.sql_expression_dependencies").alias("dependency_source"), _flag("is_schema_bound_reference").alias("is_schema_bound_reference"), _flag("is_ambiguous").alias("is_ambiguous"),
        F.struct(F.lit(2).alias("kind"), F.concat_ws(".", "referenced_schema", "referenced_table", "referenced_column").alias("name"), F.col("referenced_minor_id").alias("number")).alias("pos"),
    ).join(known.withColumnRenamed("id", "target").hint("merge"), "target", "left_semi")
    # sources of the three kinds differ, so each kind is numbered by itself, where its rows lie by target already
    numbered = [rows.withColumn("key", F.row_number().over(W.partitionBy("source", "target").orderBy("pos")) - 1) for rows in (stores, linked, depends)]
    return PropertyGraph(nodes, numbered[0].unionByName(numbered[1], allowMissingColumns=True).unionByName(numbered[2], allowMissingColumns=True))


def generic(graph: PropertyGraph, unified: bool = False) -> PropertyGraph:
    """A built graph in the form of the graph operators.

    Built nodes have neither type nor label, so searches by these find nothing; with `unified` they are node_type and
    qualified_name.
    """
    none = F.lit(None).cast("string")
    nodes = graph.nodes.select("id", (F.col("qualified_name") if unified else none).alias("label"), (F.col("node_type") if unified else none).alias("type"), F.col("id").alias("pos"), F.to_json(F.struct(*graph.nodes.columns[1:])).alias("attrs"))
    pos = F.struct("source", "pos.kind", "pos.name", "pos.number", "target").alias("pos")
    edges = graph.edges.select(F.col("source").alias("src"), F.col("target").alias("dst"), F.col("relationship").alias("rel"), none.alias("confidence"), pos, F.to_json(F.struct(*(c for c in graph.edges.columns if c not in ("source", "target", "pos")))).alias("attrs"))
    return PropertyGraph(nodes, edges)


def split_entry(entry: str, entry_type: str) -> tuple[str, str]:
    """Schema and object of an entry point; a column's is its table."""
    if entry_type not in ENTRY_TYPES:
        raise ValueError(f"entry type must be one of {ENTRY_TYPES}, not {entry_type!r}")
    parts = (entry or "").split(".")
    if len(parts) != (3 if entry_type == "column" else 2) or not entry.strip():
        raise ValueError(f"a {entry_type} is named {'schema.table.column' if entry_type == 'column' else 'schema.object'}, not {entry!r}")
    return parts[0], parts[1]


def nearby_objects(catalog: Catalog, entry: str, entry_type: str, depth: int) -> DataFrame:
    """(object_id) within depth steps of the entry over foreign keys and dependencies, either way; none if it is unknown."""
    schema, name = split_entry(entry, entry_type)
    if entry_type in ("table", "column"):
        seed = catalog.tables.filter((F.col("schema_name") == schema) & (F.col("table_name") == name)).select("object_id")
    else:
        seed = catalog.routines.filter((F.col("schema_name") == schema) & (F.col("object_name") == name) & F.rtrim("object_type_code").isin(*PROCEDURES, *FUNCTIONS)).select("object_id")
    pairs = catalog.foreign_keys.select(F.col("parent_object_id").alias("a"), F.col("referenced_object_id").alias("b")).unionByName(catalog.dependencies.select(F.col("referencing_object_id").alias("a"), F.col("referenced_object_id").alias("b")))
    pairs = pairs.filter("a IS NOT NULL AND b IS NOT NULL")
    either = lambda rows: rows.unionByName(rows.select(F.col("b").alias("a"), F.col("a").alias("b")))
    frontier = seen = checkpointed(seed.limit(1))
    for _ in range(max(0, depth)):
        ids = _few_ids(frontier)
        around = either(pairs.filter(_among(ids, "a", "b"))) if ids is not None else either(pairs)
        reached = around.join(frontier, around["a"] == frontier["object_id"]).select(F.col("b").alias("object_id")).distinct()
        frontier = checkpointed(reached.join(seen, "object_id", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def _few_ids(objects: DataFrame) -> list[int] | None:
    """The ids of objects (object_id), or None where they are more than FEW_IDS."""
    ids = [r[0] for r in objects.filter("object_id IS NOT NULL").limit(FEW_IDS + 1).collect()]
    return ids if len(ids) <= FEW_IDS else None


def _among(ids: list[int], *names: str):
    """Whether one of the columns is among the ids; a scan or a join below takes the condition."""
    listed = ", ".join(str(int(i)) for i in ids)
    return F.expr(" OR ".join(f"`{n}` IN ({listed})" for n in names)) if ids else F.lit(False)


def build_targeted(catalog: Catalog, entry: str, entry_type: str, depth: int = 1, include_definitions: bool = False) -> PropertyGraph:
    """build_graph of the rows that touch the objects near an entry; foreign keys and dependencies need one end among them."""
    near = nearby_objects(catalog, entry, entry_type, depth)
    ids = _few_ids(near)

    def of(rows: DataFrame, *names: str) -> DataFrame:
        if ids is not None:
            return rows.filter(_among(ids, *names))
        found = None
        for name in names:
            rows = rows.join(near.select(F.col("object_id").alias(name), F.lit(True).alias(f"in_{name}")), name, "left")
            found = F.col(f"in_{name}").isNotNull() if found is None else found | F.col(f"in_{name}").isNotNull()
        return rows.filter(found).drop(*(f"in_{n}" for n in names))

    tables = of(catalog.tables, "object_id")
    keyed = catalog.primary_keys.join(tables.select("schema_name", "table_name"), ["schema_name", "table_name"], "left_semi")
    return _graph_of(
        Catalog(tables, of(catalog.columns, "table_object_id"), keyed, of(catalog.foreign_keys, "parent_object_id", "referenced_object_id"), of(catalog.routines, "object_id"), of(catalog.dependencies, "referencing_object_id", "referenced_object_id")),
        include_definitions,
    )
