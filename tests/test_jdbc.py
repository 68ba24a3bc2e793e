"""The catalog by JDBC, from system tables in an embedded Derby database."""

import random

import pytest

from skeinwork.operators import catalog_build
from skeinwork.sources import catalog as source
from skeinwork.sources.system_tables import COLUMNS, SystemTables, jdbc_tables

URL = "jdbc:derby:memory:skeinwork_catalog"
DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def kind_of(column):
    if column.endswith("_date"):
        return "TIMESTAMP"
    return "INTEGER" if column.endswith(("_id", "_ordinal", "max_length")) or column in ("precision", "scale") or column.startswith(("is_", "uses_")) else "VARCHAR(200)"


def system_rows(tables=40, seed=1):
    """Rows of every system table: a forest of foreign keys, routines that depend on tables, some shipped objects."""
    rng = random.Random(seed)
    ids = [100 + 7 * i for i in range(tables)]
    routines = [5000 + i for i in range(10)]
    links = [(9000 + i, ids[i], ids[rng.randrange(i)]) for i in range(1, tables)]
    return {
        "schemas": [(1, "dbo"), (2, "app")],
        "tables": [(i, 1 + i % 2, f"t{i}", None, None, 0, "NONE", int(i == ids[-1])) for i in ids],
        "columns": [(i, n, f"c{n}", 1 + n % 2, 20, 10, 0, n % 2, 0, 0, None) for i in ids for n in (1, 2)],
        "types": [(1, "int"), (2, "nvarchar")],
        "default_constraints": [(ids[0], 2, "(0)")],
        "computed_columns": [(ids[1], 2, "c1 + 1")],
        "key_constraints": [(i, 1, f"PK_{i}", "PK") for i in ids],
        "index_columns": [(i, 1, 1, 1) for i in ids],
        "foreign_keys": [(f, f"FK_{f}", "NO_ACTION", "CASCADE", 0, 0) for f, *_ in links],
        "foreign_key_columns": [(f, 1, a, 2, b, 1) for f, a, b in links],
        "objects": [(r, 1, f"p{r}", "P " if r % 2 else "FN", "ROUTINE", None, None, 0) for r in routines],
        "sql_modules": [(r, f"select {r}", 0, 1, 1) for r in routines],
        "sql_expression_dependencies": [(r, rng.choice(ids), rng.choice([0, 1]), None, None, 0, 0) for r in routines for _ in range(2)],
    }


@pytest.fixture(scope="module")
def server(spark):
    jvm = spark._jvm
    jvm.java.lang.Class.forName(DRIVER)
    connection = jvm.java.sql.DriverManager.getConnection(f"{URL};create=true")
    run = connection.createStatement()
    for name, rows in system_rows().items():
        columns = COLUMNS[name].split()
        run.executeUpdate(f"CREATE TABLE cat.{name} (" + ", ".join(f"{c.upper()!r} {kind_of(c)}".replace("'", '"') for c in columns) + ")")
        for row in rows:
            run.executeUpdate(f"INSERT INTO cat.{name} VALUES (" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")")
    connection.close()
    return {"url": URL, "driver": DRIVER}


def frames_of(spark):
    kinds = {"TIMESTAMP": "timestamp", "INTEGER": "int", "VARCHAR(200)": "string"}
    return {name: spark.createDataFrame(rows, ", ".join(f"{c} {kinds[kind_of(c)]}" for c in COLUMNS[name].split())) for name, rows in system_rows().items()}


def facts(graph):
    nodes = sorted((r["id"], r["node_type"], r["type_display"], r["is_primary_key"], r["is_foreign_key"], r["definition_sha256"]) for r in graph.nodes.collect())
    return nodes, sorted((r["source"], r["relationship"], r["target"], r["key"]) for r in graph.edges.collect())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_whole_catalog(spark, server):
    """The server's tables, in three ranges of ids each, build the graph that frames of the same rows build."""
    read = source.from_jdbc(spark, server["url"], prefix="cat.", parts=3, driver=server["driver"])
    assert facts(catalog_build.build_graph(read)) == facts(catalog_build.build_graph(SystemTables(frames_of(spark)).catalog()))
    tables = jdbc_tables(spark, server["url"], "cat.", 3, driver=server["driver"])
    assert tables["columns"].rdd.getNumPartitions() == 3 and tables["types"].rdd.getNumPartitions() == 1
    assert tables["columns"].count() == 80 and len({r[0] for r in tables["columns"].select("object_id").collect()}) == 40
    with_none = jdbc_tables(spark, server["url"], "cat.", 1, driver=server["driver"])
    assert with_none["columns"].rdd.getNumPartitions() == 1


def test_ids_are_pushed(spark, server):
    read = source.from_jdbc(spark, server["url"], [107, 114], "cat.", 3, driver=server["driver"])
    plan = plan_of(read.tables)
    assert "PushedFilters" in plan and "In(OBJECT_ID, [107,114])" in plan
    assert "Or(In(PARENT_OBJECT_ID, [107,114]),In(REFERENCED_OBJECT_ID, [107,114]))" in plan_of(read.foreign_keys).replace(", In(REF", ",In(REF")
    assert {r["object_id"] for r in read.tables.collect()} == {107, 114}
    assert source.from_jdbc(spark, "jdbc:none", []).tables.count() == 0  # no ids, no round trip


@pytest.mark.parametrize(("entry", "kind", "depth"), [("dbo.t100", "table", 0), ("dbo.t100", "table", 1), ("app.t107.c1", "column", 2), ("dbo.p5001", "procedure", 2), ("dbo.p5002", "function", 1), ("dbo.none", "table", 2)])
def test_rounds_around_an_object(spark, server, monkeypatch, entry, kind, depth):
    """Round by round with pushed ids, and beyond the bound by joins: the graph of build_targeted over frames."""
    tables = jdbc_tables(spark, server["url"], "cat.", 2, driver=server["driver"])
    want = facts(catalog_build.build_targeted(SystemTables(frames_of(spark)).catalog(), entry, kind, depth))
    asked, touching = [], SystemTables.touching
    monkeypatch.setattr(SystemTables, "touching", lambda self, ids: asked.append(list(ids)) or touching(self, ids))
    assert facts(source.around_object(spark, tables, entry, kind, depth)) == want
    assert len(asked) <= depth and all(asked) and (entry != "dbo.none" or not asked)
    if depth == 2 and kind == "column":
        monkeypatch.setattr(SystemTables.near, "__defaults__", (3,))
        assert SystemTables(tables).near("app", "t107", kind, depth) is None
        assert facts(source.around_object(spark, tables, entry, kind, depth)) == want
        scan = plan_of(SystemTables(tables, [107], [100, 107]).foreign_keys())
        assert "In(OBJECT_ID, [100,107])" in scan
