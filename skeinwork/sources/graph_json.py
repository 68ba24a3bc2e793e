"""Node-link JSON documents as property graphs."""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.model import PropertyGraph


def _present(raw: str, key: str):
    return F.array_contains(F.json_object_keys(raw), key)


def _aliased(raw: str, key: str, alias: str):
    """The value of key or, only where the key is absent (a null is present), of its alias."""
    return F.when(_present(raw, key), F.get_json_object(raw, f"$.{key}")).otherwise(F.get_json_object(raw, f"$.{alias}"))


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path).schema  # noqa: B018 - the reader looks for the path
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def read_lines(spark: SparkSession, path: str) -> PropertyGraph:
    """The graph of a folder of JSON lines, as write_lines makes it from json_lines; pos orders elements by their text."""
    given = spark.read.text(path)
    nodes, edges = (given.filter(F.col("kind") == kind).select(F.col("value").alias("raw")) for kind in ("node", "edge"))
    return graph_of(nodes.withColumn("pos", F.col("raw")), edges.withColumn("pos", F.col("raw")))


def graph_of(nodes: DataFrame, edges: DataFrame) -> PropertyGraph:
    """The graph of elements (raw, pos)."""
    get = lambda key: F.get_json_object("raw", f"$.{key}")
    return PropertyGraph(
        nodes.select(get("id").alias("id"), get("label").alias("label"), _aliased("raw", "type", "file_type").alias("type"), "pos", F.col("raw").alias("attrs")),
        edges.select(get("source").alias("src"), get("target").alias("dst"), _aliased("raw", "relationship", "relation").alias("rel"), get("confidence").alias("confidence"), "pos", F.col("raw").alias("attrs")),
    )


def no_graph(spark: SparkSession) -> PropertyGraph:
    return PropertyGraph(spark.createDataFrame([], "id string, label string, type string, pos int, attrs string"), spark.createDataFrame([], "src string, dst string, rel string, confidence string, pos int, attrs string"))


def read_graph(spark: SparkSession, path: str) -> PropertyGraph:
    """The graph of a JSON document {nodes, edges or links}; relation and file_type stand in for relationship and type.

    Positions are those of the file. A missing file is an empty graph, with a warning, and so is a broken document; a file
    that can't be read is an error. The document is one task's; read_large_graph deals it out in ranges.
    """
    if not _exists(spark, path):
        warnings.warn(f"no graph at {path}", stacklevel=2)
        return no_graph(spark)
    document = spark.read.text(path, wholetext=True)
    parsed = document.select(F.from_json("value", "nodes array<string>, links array<string>, edges array<string>").alias("g"), _present("value", "edges").alias("own"))
    nodes = parsed.select(F.posexplode("g.nodes").alias("pos", "raw"))
    edges = parsed.select(F.posexplode(F.when(F.col("own"), F.col("g.edges")).otherwise(F.col("g.links"))).alias("pos", "raw"))
    return graph_of(nodes, edges)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(slug, root) of a JSON object of strings; other values are left out."""
    raw = spark.read.text(path, wholetext=True)
    rows = raw.select(F.explode(F.from_json("value", "map<string,variant>")).alias("slug", "root"))
    return rows.filter(F.schema_of_variant("root") == "STRING").select("slug", F.col("root").cast("string").alias("root"))
