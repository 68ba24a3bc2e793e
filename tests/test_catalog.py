"""The catalog builder and the schema operators on a chain of tables with a routine."""

import json
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from skeinwork import sinks
from skeinwork.operators import catalog_build, graph, schema
from skeinwork.operators.ordinals import with_ordinals
from skeinwork.sources.catalog import from_rows
from skeinwork.sources.graph_json import read_graph, read_lines
from skeinwork.sources.system_tables import SystemTables


def rows(**common):
    ids = {"A": 10, "B": 20, "C": 30}
    columns = [("A", "Id"), ("A", "BId"), ("B", "Id"), ("B", "CId"), ("C", "Id")]
    key = lambda a, x, b: {"foreign_key_name": f"FK_{a}_{b}", "parent_schema": "dbo", "parent_table": a, "parent_column": x, "referenced_schema": "dbo", "referenced_table": b, "referenced_column": "Id", "constraint_column_id": 1, "parent_object_id": ids[a], "referenced_object_id": ids[b], "is_disabled": 0, "is_not_trusted": 0}
    return {
        "tables": [{"schema_name": "dbo", "table_name": n, "object_id": i, "is_memory_optimized": 0, "temporal_type_desc": "NONE"} for n, i in ids.items()],
        "columns": [{"schema_name": "dbo", "table_name": t, "column_name": c, "table_object_id": ids[t], "column_id": n, "data_type": "nvarchar", "max_length": -1, "precision": 0, "scale": 0} for n, (t, c) in enumerate(columns)],
        "primary_keys": [{"schema_name": "dbo", "table_name": n, "column_name": "Id", "constraint_name": f"PK_{n}", "key_ordinal": 1} for n in ids],
        "foreign_keys": [key("A", "BId", "B"), key("B", "CId", "C")],
        "routines": [{"schema_name": "dbo", "object_name": "R", "object_id": 40, "object_type_code": "P ", "type_desc": "PROC", "definition": ""}],
        "dependencies": [{"referencing_object_id": 40, "referenced_schema": "dbo", "referenced_table": t, "referenced_object_id": ids.get(t)} for t in ("A", "A", "Gone")],
    }


@pytest.fixture(scope="module")
def catalog(spark):
    return from_rows(spark, **rows())


def tables(g):
    return {r["name"] for r in g.nodes.filter("node_type <> 'Column'").collect()}


def test_build(spark, catalog):
    g = catalog_build.build_graph(catalog)
    counts = {(r["kind"], r["name"]): r["n"] for r in graph.counts(catalog_build.generic(g, unified=True)).collect()}
    assert counts == {("node", "Table"): 3, ("node", "Column"): 5, ("node", "Procedure"): 1, ("edge", "Stores"): 5, ("edge", "Links"): 2, ("edge", "Creates"): 1}
    found = {r["id"]: r for r in g.nodes.collect()}
    assert found["column:dbo.A.BId"]["is_foreign_key"] and not found["column:dbo.A.BId"]["is_primary_key"]
    assert found["column:dbo.B.Id"]["is_referenced_key"] and found["column:dbo.B.Id"]["type_display"] == "nvarchar(max)"
    assert found["procedure:dbo.R"]["definition_sha256"] is None and not found["procedure:dbo.R"]["has_definition"]
    assert graph.search_nodes(catalog_build.generic(g), "x", node_type="Table", fuzzy=True).count() == 0


@pytest.mark.parametrize(("depth", "names", "links"), [(-1, {"A"}, 0), (0, {"A"}, 0), (1, {"A", "B", "R"}, 1), (2, {"A", "B", "C", "R"}, 2)])
def test_targeted(catalog, depth, names, links):
    g = catalog_build.build_targeted(catalog, "dbo.A", "table", depth)
    assert tables(g) == names
    assert g.edges.filter("relationship = 'Links'").count() == links
    if depth == 0:  # the boundary's foreign key is dropped, yet its column is marked
        assert {r["name"] for r in g.nodes.filter("is_foreign_key").collect()} == {"BId"}


def test_targeted_entries(catalog):
    assert catalog_build.build_targeted(catalog, "dbo.None", "table", 1).nodes.count() == 0
    assert tables(catalog_build.build_targeted(catalog, "dbo.R", "function", 1)) == {"R", "A"}
    for entry, kind in (("dbo.A", "view"), ("A", "table"), ("", "table"), ("dbo.A", "column")):
        with pytest.raises(ValueError):
            catalog_build.split_entry(entry, kind)


def test_schema_operators(catalog, monkeypatch):
    node, edges = schema.table_lookup(catalog, "dbo.A")
    assert node.count() == 1 and {(r["direction"], r["node"]) for r in edges.collect()} == {("outgoing", "dbo.A.Id"), ("outgoing", "dbo.A.BId"), ("incoming", "dbo.R")}
    assert schema.column_lookup(catalog, "dbo.A", "BId").count() == 1 and schema.column_lookup(catalog, "dbo.A", "None").count() == 0
    assert {(r["bucket"], r["node"]) for r in schema.routine_dependencies(catalog, "dbo.R").collect()} == {("tables", "dbo.A")}
    path = schema.relationship_paths(catalog_build.build_graph(catalog), "dbo.A", "dbo.B").collect()
    assert [r["nodes"] for r in path] == [["dbo.A", "dbo.A.BId", "dbo.B.Id", "dbo.B"]]
    assert {r["other_table"] for r in schema.table_fk_pairs(catalog, "dbo.B").collect()} == {"dbo.A", "dbo.C"}
    for given, depth in (("3", 3), ("", 2), ("abc", 2), ("-1", 2), ("0", 0)):
        monkeypatch.setenv(schema.DEPTH_VARIABLE, given)
        assert schema.depth_of("routine") == depth


def test_sinks(spark, catalog, tmp_path):
    g = catalog_build.build_graph(catalog)
    lines = [json.loads(r["line"]) for r in sinks.json_lines(g).collect()]
    assert len(lines) == 17 and all(v is not None for x in lines for v in x.values())
    text = sinks.markdown(g)
    assert "| Table nodes | 3 |" in text and "- `dbo.A` via `BId` → `dbo.B` via `Id` (`FK_A_B`)" in text and "  - `dbo.A`" in text
    assert all(r["line"].startswith(("<node", "<edge")) for r in sinks.graphml_lines(g).collect())
    styled = sinks.styled(g)
    assert styled.nodes.filter("color IS NULL").count() == 0 and styled.edges.filter("width IS NULL").count() == 0
    sinks.write_documents(g, str(tmp_path / "out"), {"database": "db <1>", "generated_at": "now", "server": None})
    back = read_graph(spark, str(tmp_path / "out" / "graph.json"))
    plain = lambda found: sorted(json.dumps(json.loads(x), sort_keys=True) for x in found)
    assert plain(r["attrs"] for r in back.nodes.unionByName(back.edges, allowMissingColumns=True).collect()) == plain(r["line"] for r in sinks.json_lines(g).collect())
    whole = json.loads((tmp_path / "out" / "graph.json").read_text())
    assert whole["metadata"] == {"database": "db <1>", "generated_at": "now"} and whole["directed"] and whole["multigraph"]
    sinks.write_document(sinks.json_document(back), str(tmp_path / "again.json"))  # a graph that was read is written as it came
    again = json.loads((tmp_path / "again.json").read_text())
    assert (again["nodes"], again["edges"]) == (whole["nodes"], whole["edges"])
    sinks.write_lines(sinks.json_lines(g), str(tmp_path / "lines"))
    lined = read_lines(spark, str(tmp_path / "lines"))
    assert lined.nodes.count() == back.nodes.count() and {r["src"] for r in lined.edges.collect()} == {r["src"] for r in back.edges.collect()}
    space = "{http://graphml.graphdrawing.org/xmlns}"
    root = ElementTree.parse(tmp_path / "out" / "graph.graphml").getroot()
    declared = {k.get("id"): k for k in root.iter(f"{space}key")}
    used = {d.get("key") for d in root.iter(f"{space}data")}
    assert used <= set(declared) and {declared[k].get("attr.type") for k in declared} <= {"string", "boolean", "int", "long", "double"}
    assert {n.get("id") for n in root.iter(f"{space}node")} == {r["id"] for r in g.nodes.collect()}
    assert len({e.get("id") for e in root.iter(f"{space}edge")}) == g.edges.count() and root.find(f"{space}graph").get("edgedefault") == "directed"
    assert next(d.text for d in root.iter(f"{space}data") if d.get("key") == "g_database") == "db <1>"
    sinks.replace_file(str(tmp_path / "x.md"), text)
    assert (tmp_path / "x.md").read_text() == text


def test_documents_are_ordered(spark, catalog, tmp_path):
    """Edges are numbered from 0 in order, null texts of a node's own type are there and empty, elements stand by id and number."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_documents(catalog_build.build_graph(catalog), str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["graph.graphml", "graph.json", "graph.md"]
    space = "{http://graphml.graphdrawing.org/xmlns}"
    root = ElementTree.parse(tmp_path / "graph.graphml").getroot()
    edges = list(root.iter(f"{space}edge"))
    assert [e.get("id") for e in edges] == [f"edge-{i}" for i in range(len(edges))] and len(edges) == 8
    assert [e.get("source") for e in edges] == sorted(e.get("source") for e in edges)
    data = lambda e: {d.get("key"): d.text for d in e}
    assert all(data(e)["e_edge_uid"] == e.get("id") and "e_key" in data(e) for e in edges)
    nodes = {n.get("id"): data(n) for n in root.iter(f"{space}node")}
    assert list(nodes) == sorted(nodes) and nodes["table:dbo.A"]["n_created_at"] is None and "n_data_type" not in nodes["table:dbo.A"]
    whole = json.loads((tmp_path / "graph.json").read_text())
    assert [n["id"] for n in whole["nodes"]] == sorted(nodes) and [e["source"] for e in whole["edges"]] == [e.get("source") for e in edges]
    empty = catalog_build.build_graph(from_rows(spark))
    sinks.write_document(sinks.json_document(empty), str(tmp_path / "empty.json"))
    assert json.loads((tmp_path / "empty.json").read_text())["edges"] == []


def test_ordinals(spark):
    """Places in the order of all rows, over several partitions, without an exchange to one of them."""
    rows = [((i * 7919) % 501, f"x{i}") for i in range(501)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "k long, ordinal string").repartition(7)
        found = with_ordinals(df, "k")
        assert sorted((r["k"], r["ordinal"]) for r in found.collect()) == [(k, k) for k in range(501)]
        plans = found._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plans and "Window" not in plans
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert with_ordinals(df.limit(0), "k", name="n").columns == ["k", "ordinal", "n"]


def test_targeted_ids_reach_the_scans(spark, monkeypatch):
    """Few ids around an entry are conditions below the joins; as joined rows they give the same graph."""
    import os

    from skeinwork.operators import catalog_build
    from skeinwork.plans import workload

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("needs the test tables")
    catalog = workload.catalog(spark, d)
    table = catalog.tables.filter(F.col("object_id") == workload.TABLE_ID).select(F.concat_ws(".", "schema_name", "table_name")).first()[0]

    def built(depth):
        g = catalog_build.build_targeted(catalog, table, "table", depth)
        return g, sorted(map(tuple, g.edges.select("source", "target", "relationship", "key").collect()))

    alone, _ = built(0)
    assert f"EqualTo(c_custkey,{workload.TABLE_ID})" in alone.nodes._jdf.queryExecution().executedPlan().toString()
    _, by_ids = built(1)
    monkeypatch.setattr(catalog_build, "FEW_IDS", -1)
    assert built(1)[1] == by_ids and by_ids


def test_names_of_routines_shuffle_once(spark):
    """Only the last join and the order move the names of routines, and references that tell the same come once."""
    n = 600
    name = F.concat(*(F.sha2(F.concat_ws(" ", F.lit(i), "id"), 512) for i in range(3)))
    column = lambda value, kind, alias: F.lit(value).cast(kind).alias(alias)
    table_id = (F.col("id") % 40).alias("object_id")
    frames = {
        "schemas": spark.createDataFrame([(1, "dbo")], "schema_id int, name string"),
        "tables": spark.range(40).select(F.col("id").alias("object_id"), column(1, "int", "schema_id"), F.concat(F.lit("T"), "id").alias("name"), *(column(None, "string", c) for c in "create_date modify_date is_memory_optimized temporal_type_desc".split()), column(0, "int", "is_ms_shipped")),
        "columns": spark.range(40).select(F.col("id").alias("object_id"), column(1, "long", "column_id"), F.lit("Id").alias("name"), *(column(None, "int", c) for c in "user_type_id max_length precision scale is_nullable is_identity is_computed collation_name".split())),
        "objects": spark.range(n).select((F.col("id") + 1000).alias("object_id"), column(1, "int", "schema_id"), name.alias("name"), F.lit("P ").alias("type"), *(column(None, "string", c) for c in "type_desc create_date modify_date".split()), column(0, "int", "is_ms_shipped")),
        # four references of each routine, the last like the first: its schema is named, as the table's is
        "sql_expression_dependencies": spark.range(4 * n).select(
            (F.floor(F.col("id") / 4) + 1000).alias("referencing_id"), F.when(F.col("id") % 4 == 3, F.col("id") - 3).otherwise(F.col("id")).alias("id"), F.when(F.col("id") % 4 == 3, "dbo").alias("referenced_schema_name")
        ).select("referencing_id", table_id.alias("referenced_id"), (F.col("id") % 4).alias("referenced_minor_id"), "referenced_schema_name", column(None, "string", "referenced_entity_name"), column(0, "int", "is_schema_bound_reference"), column(0, "int", "is_ambiguous")),
    }
    stored = {k: v.localCheckpoint() for k, v in frames.items()}
    sc = spark.sparkContext
    store = sc._jsc.sc().statusStore()

    def shuffled():
        stages = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled()
        found = SystemTables(stored).dependencies().collect()
        moved = shuffled() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert len(found) == 3 * n and all(r["referenced_schema"] == "dbo" and r["referenced_table"] == f"T{r['referenced_id']}" for r in found)
    assert {(r["referenced_minor_id"], r["referenced_column"]) for r in found} == {(0, None), (1, "Id"), (2, None)}
    assert [r["referencing_name"] for r in found] == sorted(r["referencing_name"] for r in found)
    assert moved < 6 * n * 384  # once with the routines and once with each of three references in order; 2.2 MB where joins move them too


def test_large_sides_stay_off_the_driver(spark):
    """Whatever the files' sizes say, no table as large as the star is broadcast, and a built graph reads few of them again."""
    import os

    from skeinwork.plans import workload

    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("needs the test tables")

    def below(plan):
        children = plan.children()
        return [plan, *(x for i in range(children.size()) for x in below(children.apply(i)))]

    def read(plan):
        return [x.relation().location().rootPaths().mkString().split("/")[-1] for x in below(plan) if x.nodeName().startswith("Scan parquet")]

    systems = SystemTables(workload.system_tables(spark, d), ordered=False)
    lines = sinks.json_lines(catalog_build.build_graph(systems.catalog()))
    for found in (lines, systems.tables(), systems.columns(), systems.primary_keys(), systems.foreign_keys(), systems.routines(), systems.dependencies()):
        for x in below(found._jdf.queryExecution().sparkPlan()):
            if x.nodeName().startswith("Broadcast"):
                assert set(read(x.left() if x.buildSide().toString() == "BuildLeft" else x.right())) <= {"nation.parquet"}
    again = read(lines._jdf.queryExecution().sparkPlan())
    assert again.count("orders.parquet") <= 4 and len(again) <= 30  # 28 and 68 where columns and foreign keys are joined each time
