"""Data model: property graphs as two DataFrames, catalogs as six, and the response envelope."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class PropertyGraph:
    """nodes (id, label, type, pos, attrs) and edges (src, dst, rel, confidence, pos, attrs).

    pos orders rows as the source file does; it may be of any type that orders. attrs is the rest of the element as JSON.
    Edge ends need not be nodes, and parallel edges stay. adjacency is a prepared store of the edges (AdjacencyStore), for
    graphs that are traversed more than once; without one every traversal prepares its own. substrings is an index of the
    nodes' ids and labels (SubstringIndex), with which searches by substring read few nodes instead of all.
    """

    nodes: DataFrame
    edges: DataFrame
    adjacency: Any = None
    substrings: Any = None

    def nodes_like(self, needle: str) -> DataFrame:
        """The nodes among which all are whose id or label holds the needle without regard to case."""
        return self.nodes if self.substrings is None else self.substrings.candidates(needle)


@dataclass(frozen=True)
class Catalog:
    """The six catalog row sets, each with the columns of its schema below."""

    tables: DataFrame
    columns: DataFrame
    primary_keys: DataFrame
    foreign_keys: DataFrame
    routines: DataFrame
    dependencies: DataFrame


@dataclass
class QueryResult:
    """What a caller gets who wants rows rather than a DataFrame."""

    graph: str
    query: dict[str, Any]
    results: Any
    warnings: list[str] = field(default_factory=list)
    truncated: bool = False
    generated_at: str = field(default_factory=lambda: datetime.now(UTC).isoformat())


def _struct(strings: str = "", ints: str = "", times: str = "") -> T.StructType:
    kinds = [(n, T.StringType()) for n in strings.split()] + [(n, T.IntegerType()) for n in ints.split()] + [(n, T.TimestampNTZType()) for n in times.split()]
    return T.StructType([T.StructField(n, t) for n, t in kinds])


TABLES = _struct("schema_name table_name temporal_type_desc", "object_id is_memory_optimized", "create_date modify_date")
COLUMNS = _struct("schema_name table_name column_name data_type default_definition computed_definition collation_name", "table_object_id column_id max_length precision scale is_nullable is_identity is_computed")
PRIMARY_KEYS = _struct("schema_name table_name column_name constraint_name", "key_ordinal")
FOREIGN_KEYS = _struct(
    "foreign_key_name parent_schema parent_table parent_column referenced_schema referenced_table referenced_column delete_referential_action_desc update_referential_action_desc",
    "constraint_column_id is_disabled is_not_trusted parent_object_id referenced_object_id",
)
ROUTINES = _struct("schema_name object_name object_type_code type_desc definition", "object_id is_schema_bound uses_ansi_nulls uses_quoted_identifier", "create_date modify_date")
DEPENDENCIES = _struct(
    "referencing_schema referencing_name referencing_type_code referenced_schema referenced_table referenced_column",
    "referencing_object_id referenced_id referenced_minor_id referenced_object_id is_schema_bound_reference is_ambiguous",
)
CARDS = _struct("card_id title description status priority created_at updated_at")
COMMENTS = T.StructType([T.StructField("comment_id", T.LongType()), *_struct("card_id author comment created_at").fields])
EVENTS = T.StructType([*_struct("card_id title description status priority at").fields, T.StructField("seq", T.LongType())])

STATUSES = ("Created", "In Progress", "Complete")
