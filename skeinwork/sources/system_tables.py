"""Catalog row sets from the system tables of a database server, as joins over frames named like them.

The frames may come from a server by JDBC, from files or from rows; the plan is the same. Object ids, where given, are
filtered before any join, so that a server or a scan can prune by them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.model import Catalog

#: The columns that are read of each system table.
COLUMNS = {
    "schemas": "schema_id name",
    "tables": "object_id schema_id name create_date modify_date is_memory_optimized temporal_type_desc is_ms_shipped",
    "columns": "object_id column_id name user_type_id max_length precision scale is_nullable is_identity is_computed collation_name",
    "types": "user_type_id name",
    "default_constraints": "parent_object_id parent_column_id definition",
    "computed_columns": "object_id column_id definition",
    "key_constraints": "parent_object_id unique_index_id name type",
    "index_columns": "object_id index_id column_id key_ordinal",
    "foreign_keys": "object_id name delete_referential_action_desc update_referential_action_desc is_disabled is_not_trusted",
    "foreign_key_columns": "constraint_object_id constraint_column_id parent_object_id parent_column_id referenced_object_id referenced_column_id",
    "objects": "object_id schema_id name type type_desc create_date modify_date is_ms_shipped",
    "sql_modules": "object_id definition is_schema_bound uses_ansi_nulls uses_quoted_identifier",
    "sql_expression_dependencies": "referencing_id referenced_id referenced_minor_id referenced_schema_name referenced_entity_name is_schema_bound_reference is_ambiguous",
}
#: Type codes of procedures and functions, and the types whose lengths count two bytes for each character.
ROUTINE_TYPES = ("P", "PC", "FN", "IF", "TF", "FS", "FT")
TWO_BYTE_TYPES = ("nchar", "nvarchar")


#: The id by which a scan of a system table is dealt over tasks, and by which rows of single objects are looked up.
OBJECT_COLUMNS = {
    "tables": "object_id", "columns": "object_id", "default_constraints": "parent_object_id", "computed_columns": "object_id", "key_constraints": "parent_object_id", "index_columns": "object_id", "foreign_keys": "object_id",
    "foreign_key_columns": "parent_object_id", "objects": "object_id", "sql_modules": "object_id", "sql_expression_dependencies": "referencing_id",
}
#: A round of a search around an object pushes up to so many ids into the scans; wider ones are joins over the whole tables.
PUSHED_IDS = 1000


def jdbc_tables(spark: SparkSession, url: str, prefix: str = "sys.", parts: int = 1, **options: str) -> dict[str, DataFrame]:
    """The system tables of a server by JDBC; needs the driver's jar. Column pruning and filters by id reach the server.

    prefix stands before each table's name. With several parts the scan of a table is that many ranges of its object ids,
    between the least and the greatest one, which the server is asked for first; a table without ids is one part.
    """
    load = lambda **more: spark.read.format("jdbc").options(url=url, **options, **more).load()

    def scan(name: str, columns: str) -> DataFrame:
        bounds = {}
        if parts > 1 and (by := OBJECT_COLUMNS.get(name)):
            low, high = load(query=f"SELECT MIN({by}) AS low, MAX({by}) AS high FROM {prefix}{name}").first()
            if low is not None and low < high:
                bounds = {"partitionColumn": by, "lowerBound": str(low), "upperBound": str(high + 1), "numPartitions": str(parts)}
        return load(dbtable=f"{prefix}{name}", **bounds).select(*columns.split())

    return {name: scan(name, columns) for name, columns in COLUMNS.items()}


class SystemTables:
    """Row sets of a catalog from frames by name. With object_ids only those objects' rows come, and foreign keys and
    dependencies that touch one of them at either end. Shipped objects are left out. Orders are those of a reader.

    within are ids beyond which no row of any table is needed, for scans that can prune by them; it changes no result.
    Row sets of a catalog (catalog()) come without order, as what is built of them has its own.
    """

    def __init__(self, frames: Mapping[str, DataFrame], object_ids: Sequence[int] | None = None, within: Sequence[int] | None = None, ordered: bool = True):
        self.ordered = ordered
        self.frames, self.ids = frames, None if object_ids is None else [int(i) for i in object_ids]
        self.within = None if within is None else [int(i) for i in within]

    def _of(self, name: str, prefix: str = "") -> DataFrame:
        found = self.frames[name].select(*(F.col(c).alias(prefix + c) for c in COLUMNS[name].split()))
        if self.within is not None and name in ("tables", "columns", "objects"):
            found = found.filter(F.col(f"{prefix}{OBJECT_COLUMNS[name]}").isin(self.within))
        return found

    def _side(self, name: str, prefix: str) -> DataFrame:
        """A table as large as the catalog, as a side of a join: whole ones are shuffled, as files are far smaller than the rows
        they hold, so by their sizes Spark would send such tables through the driver's memory, many at a time.
        """
        found = self._of(name, prefix)
        return found.hint("merge") if self.ids is None else found

    def _sorted(self, found: DataFrame, *columns: str) -> DataFrame:
        return found.orderBy(*columns) if self.ordered else found

    def _listed(self, *columns: str):
        """Whether one of the columns holds a listed id; true where none were given."""
        if self.ids is None:
            return F.lit(True)
        return reduce(lambda a, b: a | b, (F.col(c).isin(self.ids) if self.ids else F.lit(False) for c in columns))

    def _tables(self, prefix: str) -> DataFrame:
        """Tables that are not shipped, with their schemas' names."""
        own = self._of("tables", prefix).filter(F.col(f"{prefix}is_ms_shipped").cast("int") == 0)
        return own.join(self._of("schemas", f"{prefix}s_"), F.col(f"{prefix}schema_id") == F.col(f"{prefix}s_schema_id"))

    def tables(self) -> DataFrame:
        found = self._tables("t_").filter(self._listed("t_object_id"))
        names = {"schema_name": "t_s_name", "table_name": "t_name"} | {c: f"t_{c}" for c in ("object_id", "create_date", "modify_date", "is_memory_optimized", "temporal_type_desc")}
        return self._sorted(found.select(*(F.col(c).alias(n) for n, c in names.items())), "schema_name", "table_name")

    def columns(self) -> DataFrame:
        key = lambda a, b: (F.col("c_object_id") == F.col(a)) & (F.col("c_column_id") == F.col(b))
        found = (
            self._tables("t_").filter(self._listed("t_object_id"))
            .join(self._side("columns", "c_"), F.col("c_object_id") == F.col("t_object_id"))
            .join(self._of("types", "ty_"), F.col("ty_user_type_id") == F.col("c_user_type_id"))
            .join(self._side("default_constraints", "d_"), key("d_parent_object_id", "d_parent_column_id"), "left")
            .join(self._side("computed_columns", "x_"), key("x_object_id", "x_column_id"), "left")
        )
        length = F.when(F.col("ty_name").isin(*TWO_BYTE_TYPES) & (F.col("c_max_length") > 0), F.floor(F.col("c_max_length") / 2)).otherwise(F.col("c_max_length"))
        plain = [F.col(f"c_{c}").alias(c) for c in ("precision", "scale", "is_nullable", "is_identity", "is_computed")]
        return self._sorted(found.select(
            F.col("t_s_name").alias("schema_name"), F.col("t_name").alias("table_name"), F.col("t_object_id").alias("table_object_id"), F.col("c_column_id").alias("column_id"), F.col("c_name").alias("column_name"),
            F.col("ty_name").alias("data_type"), length.cast("int").alias("max_length"), *plain, F.col("d_definition").alias("default_definition"), F.col("x_definition").alias("computed_definition"), F.col("c_collation_name").alias("collation_name"),
        ), "schema_name", "table_name", "column_id")

    def primary_keys(self) -> DataFrame:
        found = (
            self._side("key_constraints", "k_").filter(F.rtrim("k_type") == "PK")
            .join(self._tables("t_").filter(self._listed("t_object_id")), F.col("t_object_id") == F.col("k_parent_object_id"))
            .join(self._side("index_columns", "i_"), (F.col("i_object_id") == F.col("t_object_id")) & (F.col("i_index_id") == F.col("k_unique_index_id")))
            .join(self._side("columns", "c_"), (F.col("c_object_id") == F.col("i_object_id")) & (F.col("c_column_id") == F.col("i_column_id")))
        )
        names = {"schema_name": "t_s_name", "table_name": "t_name", "column_name": "c_name", "constraint_name": "k_name", "key_ordinal": "i_key_ordinal"}
        return self._sorted(found.select(*(F.col(c).alias(n) for n, c in names.items())), "schema_name", "table_name", "key_ordinal")

    def foreign_keys(self) -> DataFrame:
        end = lambda p: self._side("columns", f"{p}c_").join(self._tables(f"{p}t_"), F.col(f"{p}c_object_id") == F.col(f"{p}t_object_id"))
        meets = lambda side, p: (F.col(f"l_{side}_object_id") == F.col(f"{p}c_object_id")) & (F.col(f"l_{side}_column_id") == F.col(f"{p}c_column_id"))
        found = (
            self._of("foreign_key_columns", "l_").filter(self._listed("l_parent_object_id", "l_referenced_object_id"))
            .join(self._side("foreign_keys", "f_"), F.col("f_object_id") == F.col("l_constraint_object_id"))
            .join(end("p"), meets("parent", "p"))
            .join(end("r"), meets("referenced", "r"))
        )
        names = {
            "foreign_key_name": "f_name", "parent_schema": "pt_s_name", "parent_table": "pt_name", "parent_column": "pc_name", "referenced_schema": "rt_s_name", "referenced_table": "rt_name", "referenced_column": "rc_name",
            "constraint_column_id": "l_constraint_column_id", "delete_referential_action_desc": "f_delete_referential_action_desc", "update_referential_action_desc": "f_update_referential_action_desc",
            "is_disabled": "f_is_disabled", "is_not_trusted": "f_is_not_trusted", "parent_object_id": "l_parent_object_id", "referenced_object_id": "l_referenced_object_id",
        }
        return self._sorted(found.select(*(F.col(c).alias(n) for n, c in names.items())), "parent_schema", "parent_table", "foreign_key_name", "constraint_column_id")

    def _routines(self) -> DataFrame:
        own = self._of("objects", "o_").filter((F.col("o_is_ms_shipped").cast("int") == 0) & F.rtrim("o_type").isin(*ROUTINE_TYPES))
        return own.join(self._of("schemas", "os_"), F.col("o_schema_id") == F.col("os_schema_id"))

    def routines(self) -> DataFrame:
        found = self._routines().filter(self._listed("o_object_id")).join(self._side("sql_modules", "m_"), F.col("m_object_id") == F.col("o_object_id"), "left")
        names = {"schema_name": "os_name", "object_name": "o_name", "object_id": "o_object_id", "object_type_code": "o_type", "type_desc": "o_type_desc", "create_date": "o_create_date", "modify_date": "o_modify_date"}
        names |= {c: f"m_{c}" for c in ("definition", "is_schema_bound", "uses_ansi_nulls", "uses_quoted_identifier")}
        return self._sorted(found.select(*(F.col(c).alias(n) for n, c in names.items())), "schema_name", "object_name")

    def dependencies(self) -> DataFrame:
        """Distinct references of routines to tables, shipped or not, and to columns; names as referenced, else of the table.

        Both ends' ids are the reference's own columns, so that conditions on either go below the joins. References meet
        the short names first and routines last, so that rows are narrow while they shuffle, and lie by routine where they
        are dealt in order.
        """
        targets = self._of("tables", "t_").join(self._of("schemas", "ts_"), F.col("t_schema_id") == F.col("ts_schema_id"), "left")
        named = (
            self._of("sql_expression_dependencies", "e_").filter(self._listed("e_referencing_id", "e_referenced_id"))
            .join(self._side("columns", "c_"), (F.col("c_object_id") == F.col("e_referenced_id")) & (F.col("c_column_id") == F.col("e_referenced_minor_id")), "left")
            .join(targets, F.col("t_object_id") == F.col("e_referenced_id"))  # a reference that finds no table is no row
        ).select(
            "e_referencing_id", "e_referenced_id", "e_referenced_minor_id", F.coalesce("e_referenced_schema_name", "ts_name").alias("referenced_schema"), F.coalesce("e_referenced_entity_name", "t_name").alias("referenced_table"),
            F.col("c_name").alias("referenced_column"), "e_is_schema_bound_reference", "e_is_ambiguous",
        )
        found = named.join(self._routines(), F.col("o_object_id") == F.col("e_referencing_id"))
        distinct = found.select(
            F.col("e_referencing_id").alias("referencing_object_id"), F.col("os_name").alias("referencing_schema"), F.col("o_name").alias("referencing_name"), F.col("o_type").alias("referencing_type_code"),
            F.col("e_referenced_id").alias("referenced_id"), F.col("e_referenced_minor_id").alias("referenced_minor_id"), "referenced_schema", "referenced_table", "referenced_column",
            F.col("e_is_schema_bound_reference").alias("is_schema_bound_reference"), F.col("e_is_ambiguous").alias("is_ambiguous"),
        ).distinct()
        return self._sorted(distinct.withColumn("referenced_object_id", F.col("referenced_id")), "referencing_schema", "referencing_name", "referenced_schema", "referenced_table", "referenced_column")

    def entry(self, schema: str, name: str, kind: str) -> DataFrame:
        """(object_id) of a table (for a table or a column) or a routine by its name; the name is looked up first."""
        own, prefix = (self._tables("t_"), "t_") if kind in ("table", "column") else (self._routines(), "o")
        named, of = (f"{prefix}name", f"{prefix}s_name") if prefix == "t_" else ("o_name", "os_name")
        return own.filter((F.col(named) == name) & (F.col(of) == schema)).select(F.col("t_object_id" if prefix == "t_" else "o_object_id").alias("object_id"))

    def touching(self, ids: Sequence[int]) -> DataFrame:
        """(a, b) of the references and foreign-key columns at the ids, before anything else of their ends is known."""
        links = self.frames["foreign_key_columns"].select(F.col("parent_object_id").alias("a"), F.col("referenced_object_id").alias("b"))
        uses = self.frames["sql_expression_dependencies"].select(F.col("referencing_id").alias("a"), F.col("referenced_id").alias("b"))
        at = F.col("a").isin(list(ids)) | F.col("b").isin(list(ids))
        return links.filter(at).unionByName(uses.filter(at)).filter("a IS NOT NULL AND b IS NOT NULL")

    def near(self, schema: str, name: str, kind: str, depth: int, most: int = PUSHED_IDS) -> list[int] | None:
        """The ids within depth steps of an object over foreign keys and dependencies, either way; [] if it is unknown, None
        if there are more than `most`.

        Every round pushes its ids into the scans, of the links first and then of the objects at their ends. A round
        without ids asks for nothing.
        """
        frontier = [r[0] for r in self.entry(schema, name, kind).limit(1).collect()]
        seen = set(frontier)
        for _ in range(max(0, depth)):
            if not frontier:
                break
            ends = [r[0] for r in self.touching(frontier).select(F.explode(F.array("a", "b")).alias("id")).distinct().limit(most + 1).collect()]
            if len(ends) > most:
                return None
            around = SystemTables(self.frames, frontier, ends)
            sides = lambda df, a, b: df.select(F.explode(F.array(a, b)).alias("id"))
            reached = sides(around.foreign_keys(), "parent_object_id", "referenced_object_id").unionByName(sides(around.dependencies(), "referencing_object_id", "referenced_object_id"))
            frontier = sorted({r[0] for r in reached.distinct().collect()} - seen)  # no more than the ends
            seen.update(frontier)
            if len(seen) > most:
                return None
        return sorted(seen)

    def catalog(self) -> Catalog:
        plain = SystemTables(self.frames, self.ids, self.within, ordered=False)
        return Catalog(plain.tables(), plain.columns(), plain.primary_keys(), plain.foreign_keys(), plain.routines(), plain.dependencies())
