"""Built graphs as JSON, Markdown, GraphML and style columns.

Lines are made on the executors; write_lines stores them as text files, write_document as one ordered file. Only the
Markdown summary, for schemas that people read, is assembled on the driver.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Mapping
from typing import Any
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.model import PropertyGraph
from skeinwork.operators.ordinals import with_ordinals
from skeinwork.storage import discard, join_files


def _elements(frame: DataFrame, kind: str, order: list[str] | None = None) -> DataFrame:
    """Each row as a JSON object without its nulls; a graph that was read gives its elements as they came."""
    body = F.col("attrs") if "attrs" in frame.columns else F.to_json(F.struct(*(c for c in frame.columns if c != "pos")))
    at = F.struct(*order) if order else F.lit(0)
    return frame.select(F.lit(kind).alias("kind"), body.alias("line"), at.alias("pos"))


def json_lines(graph: PropertyGraph) -> DataFrame:
    """(kind, line): each node and edge as a JSON object without its nulls."""
    return _elements(graph.nodes, "node").drop("pos").unionByName(_elements(graph.edges, "edge").drop("pos"))


def _sections(spark: SparkSession, *sections: str | DataFrame) -> DataFrame:
    """(section, ordinal, text): texts and frames of (ordinal, text) one after another."""
    schema = "section int, ordinal long, text string"
    parts = [spark.createDataFrame([(i, 0, x)], schema) if isinstance(x, str) else x.select(F.lit(i).alias("section"), F.col("ordinal").cast("long").alias("ordinal"), "text") for i, x in enumerate(sections)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every


def json_document(graph: PropertyGraph, metadata: Mapping[str, Any] | None = None) -> DataFrame:
    """(section, ordinal, text): the lines of a node-link document in order, which read_graph reads back; see write_document."""
    place = lambda frame: ["pos"] if "attrs" in frame.columns else [c for c in ("id", "source", "pos", "target", "key") if c in frame.columns]

    def listed(frame: DataFrame, kind: str) -> DataFrame:
        rows = with_ordinals(_elements(frame, kind, place(frame)), "pos", "line")
        return rows.select("ordinal", F.concat(F.when(F.col("ordinal") > 0, ",").otherwise(""), "line").alias("text"))

    head = json.dumps({k: v for k, v in (metadata or {}).items() if v is not None}, ensure_ascii=False)
    start = f'{{"metadata": {head},\n"directed": true,\n"multigraph": true,\n"nodes": ['
    return _sections(graph.nodes.sparkSession, start, listed(graph.nodes, "node"), '],\n"edges": [', listed(graph.edges, "edge"), "]}")


def _xml(column):
    text = F.coalesce(column.cast("string"), F.lit(""))
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


#: Text attributes of each node type, which are empty in GraphML where they are null.
NODE_TEXTS = {
    "Table": ("name", "qualified_name", "schema", "created_at", "modified_at", "temporal_type"),
    "Column": ("name", "qualified_name", "schema", "table", "data_type", "type_display", "default_definition", "computed_definition", "collation", "primary_key_name"),
    "Procedure": ("name", "qualified_name", "schema", "sql_object_type", "sql_object_type_desc", "created_at", "modified_at", "definition_sha256"),
    "Function": ("name", "qualified_name", "schema", "sql_object_type", "sql_object_type_desc", "created_at", "modified_at", "definition_sha256"),
}
#: GraphML's names of Spark's types; others are written as text.
XML_TYPES = {"boolean": "boolean", "int": "int", "bigint": "long", "double": "double"}


def _attributes(frame: DataFrame, ends: tuple[str, ...]) -> list[tuple[str, str]]:
    return [(c, XML_TYPES.get(t, "string")) for c, t in frame.dtypes if c not in ("pos", *ends)]


def graphml_elements(graph: PropertyGraph) -> tuple[DataFrame, DataFrame]:
    """(ordinal, line) of the nodes, by id, and of the edges, by source, position, target and key: edge <n> is `edge-<n>`.

    An attribute of a node's own type that is null is an empty text (numbers and flags are left out, as no text is one);
    an edge has its attributes that are not null, its number and its key.
    """

    def data(prefix: str, c: str, empty=None):
        held = F.concat(F.lit(f'<data key="{prefix}_{c}">'), _xml(F.col(c)), F.lit("</data>"))
        told = F.when(F.col(c).isNotNull(), held)
        return (told if empty is None else told.when(empty, F.lit(f'<data key="{prefix}_{c}"></data>'))).otherwise("")

    kinds = dict(graph.nodes.dtypes)
    own = lambda c: F.col("node_type").isin([t for t, columns in NODE_TEXTS.items() if c in columns]) if kinds[c] == "string" and "node_type" in kinds else None
    nodes = with_ordinals(graph.nodes, *(c for c in ("id", "object_id") if c in kinds))
    nodes = nodes.select("ordinal", F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('">'), *(data("n", c, own(c)) for c, _ in _attributes(graph.nodes, ("id",))), F.lit("</node>")).alias("line"))
    edges = with_ordinals(graph.edges, *(c for c in ("source", "pos", "target", "key") if c in graph.edges.columns))
    uid = F.concat(F.lit("edge-"), F.col("ordinal").cast("string"))
    rest = [data("e", c) for c, _ in _attributes(graph.edges, ("source", "target"))]
    line = F.concat(F.lit('<edge id="'), uid, F.lit('" source="'), _xml(F.col("source")), F.lit('" target="'), _xml(F.col("target")), F.lit('">'), *rest, F.lit('<data key="e_edge_uid">'), uid, F.lit("</data></edge>"))
    return nodes, edges.select("ordinal", line.alias("line"))


def graphml_lines(graph: PropertyGraph) -> DataFrame:
    """(kind, line): each node and edge as a GraphML element."""
    nodes, edges = graphml_elements(graph)
    return nodes.select(F.lit("node").alias("kind"), "line").unionByName(edges.select(F.lit("edge").alias("kind"), "line"))


def graphml_frame(graph: PropertyGraph, metadata: Mapping[str, Any] | None = None) -> tuple[str, str]:
    """What stands before and after the lines of a GraphML document: its declarations, of every attribute, and its end."""
    facts = {k: str(v) for k, v in (metadata or {}).items() if v is not None}
    keys = [("n", "node", c, t) for c, t in _attributes(graph.nodes, ("id",))] + [("e", "edge", c, t) for c, t in [*_attributes(graph.edges, ("source", "target")), ("edge_uid", "string")]] + [("g", "graph", c, "string") for c in facts]
    declared = "".join(f'<key id={quoteattr(f"{p}_{c}")} for="{whole}" attr.name={quoteattr(c)} attr.type="{t}"/>\n' for p, whole, c, t in keys)
    told = "".join(f"<data key={quoteattr(f'g_{c}')}>{escape(v)}</data>\n" for c, v in facts.items())
    head = f'<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n{declared}<graph edgedefault="directed">\n{told}'
    return head, "</graph>\n</graphml>\n"


def graphml_document(graph: PropertyGraph, metadata: Mapping[str, Any] | None = None) -> DataFrame:
    """(section, ordinal, text): the lines of a GraphML document in order, nodes first; see write_document."""
    head, tail = (x.rstrip("\n") for x in graphml_frame(graph, metadata))
    listed = (rows.withColumnRenamed("line", "text") for rows in graphml_elements(graph))
    return _sections(graph.nodes.sparkSession, head, *listed, tail)


def markdown_tables(graph: PropertyGraph) -> DataFrame:
    """(qualified_name, body): the column table of each table, columns by number."""
    keys = F.concat_ws(", ", *(F.when(F.col(flag), F.lit(name)) for flag, name in (("is_primary_key", "PK"), ("is_foreign_key", "FK"), ("is_referenced_key", "Referenced key"), ("identity", "Identity"), ("computed", "Computed"))))
    row = F.format_string("| `%s` | `%s` | %s | %s |", "name", "type_display", F.when(F.col("nullable"), "Yes").otherwise("No"), keys)
    columns = graph.nodes.filter("node_type = 'Column'").select(F.concat_ws(".", "schema", "table").alias("qualified_name"), F.struct("column_id", row.alias("row")).alias("row"))
    rows = columns.groupBy("qualified_name").agg(F.array_join(F.transform(F.sort_array(F.collect_list("row")), lambda x: x["row"]), "\n").alias("rows"))
    head = "| Column | Type | Nullable | Key information |\n|---|---|---:|---|"
    tables = graph.nodes.filter("node_type = 'Table'").select("qualified_name")
    return tables.join(rows, "qualified_name", "left").select("qualified_name", F.concat_ws("\n", F.lit(head), "rows").alias("body"))


def markdown_links(graph: PropertyGraph) -> DataFrame:
    """(line): a line for each foreign-key column."""
    part = lambda side: graph.nodes.select(F.col("id").alias(side), F.concat_ws(".", "schema", "table").alias(f"{side}_table"), F.col("name").alias(f"{side}_name"))
    linked = graph.edges.filter("relationship = 'Links'").join(part("source"), "source").join(part("target"), "target")
    return linked.select(F.format_string("- `%s` via `%s` → `%s` via `%s` (`%s`)", "source_table", "source_name", "target_table", "target_name", F.coalesce("foreign_key_name", F.lit(""))).alias("line"))


def markdown_routines(graph: PropertyGraph) -> DataFrame:
    """(qualified_name, body): each routine with its distinct targets in order."""
    named = graph.nodes.select(F.col("id").alias("target"), F.coalesce("qualified_name", "id").alias("target_name"))
    targets = graph.edges.filter("relationship = 'Creates'").join(named, "target").groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.transform(F.sort_array(F.collect_set("target_name")), lambda x: F.format_string("  - `%s`", x)).alias("listed"))
    routines = graph.nodes.filter("node_type IN ('Procedure', 'Function')").join(targets, "id", "left")
    head = F.format_string("### %s: %s\n\n- SQL type: `%s`\n- Modified: `%s`\n- Referenced tables/columns: %d", "node_type", "qualified_name", F.coalesce("sql_object_type_desc", F.lit("")), F.coalesce("modified_at", F.lit("")), F.coalesce("n", F.lit(0)))
    return routines.select("qualified_name", F.concat_ws("\n", head, F.array_join("listed", "\n")).alias("body"))


def markdown(graph: PropertyGraph, generated_at: str = "") -> str:
    """The whole summary as one text, for schemas that people read; larger graphs write the parts above."""
    nodes = {r[0]: r[1] for r in graph.nodes.groupBy("node_type").count().collect()}
    edges = {r[0]: r[1] for r in graph.edges.groupBy("relationship").count().collect()}
    lines = ["# Database Structure Graph", "", f"Generated: `{generated_at}`", "", "## Summary", "", "| Item | Count |", "|---|---:|"]
    lines += [f"| {t} nodes | {nodes.get(t, 0)} |" for t in ("Table", "Column", "Function", "Procedure")]
    lines += [f"| {t} relationships | {edges.get(t, 0)} |" for t in ("Stores", "Links", "Creates")]
    links = [r[0] for r in markdown_links(graph).orderBy("line").collect()]
    lines += ["", "## Table Connections", "", *(links or ["No foreign keys found."]), "", "## Tables and Columns", ""]
    for r in markdown_tables(graph).orderBy(F.lower("qualified_name")).collect():
        lines += [f"### {r[0]}", "", r[1], ""]
    routines = [r[1] for r in markdown_routines(graph).orderBy(F.lower("qualified_name")).collect()]
    lines += ["## Procedures and Functions", ""]
    for body in routines or ["No procedures or functions found."]:
        lines += [body, ""] if routines else [body]
    return "\n".join(lines)


#: Colour, size and shape of each node type; colour and width of each relationship.
NODE_STYLES = {"Table": ("#2f6db5", 28, "box"), "Column": ("#8fb7a6", 12, "dot"), "Procedure": ("#c2703d", 20, "diamond"), "Function": ("#8c5fb0", 20, "triangle")}
EDGE_STYLES = {"Stores": ("#b9c0c7", 1), "Links": ("#2f6db5", 3), "Creates": ("#c2703d", 2)}


def styled(graph: PropertyGraph) -> PropertyGraph:
    """The graph with columns that a renderer needs: colour, size, shape and tooltip; colour and width."""

    def pick(styles, name, i, kind):
        return F.element_at(F.create_map(*(x for k, v in styles.items() for x in (F.lit(k), F.lit(v[i]).cast(kind)))), F.col(name))

    tip = F.concat_ws("\n", "node_type", "qualified_name", "type_display")
    nodes = graph.nodes.withColumns({"color": pick(NODE_STYLES, "node_type", 0, "string"), "size": pick(NODE_STYLES, "node_type", 1, "int"), "shape": pick(NODE_STYLES, "node_type", 2, "string"), "tooltip": tip})
    edges = graph.edges.withColumns({"color": pick(EDGE_STYLES, "relationship", 0, "string"), "width": pick(EDGE_STYLES, "relationship", 1, "int")})
    return PropertyGraph(nodes, edges)


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines as text files, a folder for each kind."""
    lines.write.partitionBy("kind").text(path)


def write_document(document: DataFrame, path: str) -> None:
    """A document of (section, ordinal, text) as one file, whole or not at all.

    Executors write its lines as ordered parts beside it, which the file system then joins in order; no element passes
    through the driver's memory, which only asks for copies of bounded buffers.
    """
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    ordered = document.repartitionByRange("section", "ordinal").sortWithinPartitions("section", "ordinal").select("text")
    try:
        ordered.write.text(parts)
        join_files(document.sparkSession, parts, path)
    finally:
        discard(document.sparkSession, parts)


def write_documents(graph: PropertyGraph, folder: str, metadata: Mapping[str, Any] | None = None) -> None:
    """graph.json, graph.graphml and graph.md of a built graph, each whole or not at all; the summary is for schemas that people read."""
    write_document(json_document(graph, metadata), os.path.join(folder, "graph.json"))
    write_document(graphml_document(graph, metadata), os.path.join(folder, "graph.graphml"))
    replace_file(os.path.join(folder, "graph.md"), markdown(graph, str((metadata or {}).get("generated_at", ""))))


def replace_file(path: str, text: str) -> None:
    """Writes a file whole or not at all."""
    handle, name = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(handle, "w", encoding="utf-8") as out:
        out.write(text)
    os.replace(name, path)
