"""Catalog row sets: from Spark schemas, from given rows, and from SQL Server by JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from skeinwork import model
from skeinwork.model import Catalog, PropertyGraph
from skeinwork.operators.catalog_build import build_graph, build_targeted, split_entry
from skeinwork.sources.system_tables import SystemTables, jdbc_tables

#: SQL type, length, precision and scale of each Spark type.
SQL_TYPES = {
    T.LongType: ("bigint", 8, 19, 0),
    T.IntegerType: ("int", 4, 10, 0),
    T.DoubleType: ("float", 8, 53, 0),
    T.StringType: ("varchar", -1, 0, 0),
    T.TimestampNTZType: ("datetime2", 8, 26, 6),
}


def from_rows(spark: SparkSession, tables=(), columns=(), primary_keys=(), foreign_keys=(), routines=(), dependencies=()) -> Catalog:
    """A catalog of dictionaries; what a row lacks is null."""
    given = {"TABLES": tables, "COLUMNS": columns, "PRIMARY_KEYS": primary_keys, "FOREIGN_KEYS": foreign_keys, "ROUTINES": routines, "DEPENDENCIES": dependencies}
    frames = []
    for name, rows in given.items():
        schema = getattr(model, name)
        frames.append(spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema))
    return Catalog(*frames)


def column_rows(schema_name: str, tables: dict[str, tuple[int, DataFrame]]) -> list[dict]:
    """Rows of the columns set, reflected from the schemas of {table: (object_id, frame)}."""
    rows = []
    for table, (object_id, frame) in tables.items():
        for number, field in enumerate(frame.schema, 1):
            kind, length, precision, scale = SQL_TYPES.get(type(field.dataType), (field.dataType.simpleString(), None, 0, 0))
            rows.append({"schema_name": schema_name, "table_name": table, "column_name": field.name, "data_type": kind, "table_object_id": object_id, "column_id": number, "max_length": length, "precision": precision, "scale": scale, "is_nullable": int(field.nullable), "is_identity": 0, "is_computed": 0})
    return rows


def from_jdbc(spark: SparkSession, url: str, object_ids: list[int] | None = None, prefix: str = "sys.", parts: int = 1, **options: str) -> Catalog:
    """A catalog read from a server's system tables, each in `parts` ranges of ids; needs the driver's jar.

    With object_ids the server prunes by them; an empty list reads nothing.
    """
    if object_ids is not None and not object_ids:
        return from_rows(spark)
    return SystemTables(jdbc_tables(spark, url, prefix, parts, **options), object_ids).catalog()


def around_object(spark: SparkSession, tables: dict[str, DataFrame], entry: str, entry_type: str, depth: int = 1, include_definitions: bool = False) -> PropertyGraph:
    """build_targeted over system tables, of which only the rows near the entry are read: its ids are found round by round
    and pushed into every scan. Neighbourhoods too wide for that are joins over the whole tables."""
    near = SystemTables(tables).near(*split_entry(entry, entry_type), entry_type, depth)
    if near is None:
        return build_targeted(SystemTables(tables).catalog(), entry, entry_type, depth, include_definitions)
    return build_graph(SystemTables(tables, near).catalog() if near else from_rows(spark), include_definitions)
