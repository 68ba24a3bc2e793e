import os

from skeinwork.operators.cards import CardStore
from skeinwork.sources.catalog import from_rows
from skeinwork.tools import Tools
from test_catalog import rows
from test_traverse import as_frames


def test_tools(spark, tmp_path):
    code = as_frames(spark, ["lib.helper", "app.run", "tests.t"], [("app.run", "lib.helper", "calls"), ("tests.t", "lib.helper", "calls"), ("app.run", "tests.t", "imports")])
    catalog = from_rows(spark, **rows())
    tools = Tools(lambda: code, lambda: catalog, CardStore(spark, str(tmp_path)))
    found = tools.graph_search_nodes("lib", fuzzy=True, limit=1)
    assert found.results[0]["id"] == "lib.helper" and found.truncated and not found.warnings
    assert tools.graph_get_node("nothing").warnings == ["Node nothing not found"]
    assert tools.graph_get_node("table:dbo.A", graph="database").results["label"] is None
    assert "graph must be" in tools.graph_get_node("x", graph="other").warnings[0]
    assert [r["node"] for r in tools.graph_get_neighbors("lib.helper").results["outgoing"]] == []
    assert tools.graph_status().results["edge_count"] == 3 and not tools.graph_status().results["exists"]
    assert tools.graph_status(graph="database").results["path"] is None
    assert {r["caller"] for r in tools.code_find_callers("helper").results["callers"]} == {"app.run", "tests.t"}
    assert tools.code_find_callers("nothing").warnings == ["Symbol nothing not found"]
    assert tools.code_get_symbol("app.run").results["callees"][0]["node"] == "lib.helper"
    assert tools.db_get_table("dbo.A").results["table"]["name"] == "A"
    assert tools.db_get_table("dbo.Z").warnings == ["Table dbo.Z not found"] and "named" in tools.db_get_table("Z").warnings[0]
    assert tools.db_get_routine_dependencies("dbo.R").results["dependencies"]["tables"] == [{"node": "dbo.A"}]
    assert {r["id"] for r in tools.db_search_schema("bid").results} == {"column:dbo.A.BId"}
    card = tools.create_card("title").results["card_id"]
    assert tools.update_card(card, status="Complete").results["status"] == "Complete"
    assert tools.update_card(card).warnings == ["no fields to update"] and "not found" in tools.get_card("nothing").warnings[0]
    tools.add_comment(card, "me", "text")
    assert tools.get_card(card).results["comments"][0]["comment"] == "text" and tools.list_cards().results["total"] == 1


def test_shared_database_and_board(spark, tmp_path):
    """Two sets of tools share one built database; the board has every registered project."""
    catalog, loads = from_rows(spark, **rows()), []

    def load():
        loads.append(1)
        return catalog

    registry = spark.createDataFrame([("none", str(tmp_path / "none"))], "slug string, root string")
    one, two = (Tools(lambda: None, load, CardStore(spark, str(tmp_path / name)), ttl=1e6, shared=str(tmp_path / "graph"), load_registry=lambda: registry) for name in ("a", "b"))
    for tools in (one, two):
        assert tools.db_search_schema("dbo.A", "Table").results[0]["id"] == "table:dbo.A"
        assert len(tools.db_find_relationship_path("dbo.A", "dbo.B").results["paths"]) == 1
    assert len(loads) == 1
    one_status, two_status = (t.graph_status(graph="database").results for t in (one, two))
    assert one_status == two_status and one_status["exists"] and one_status["node_count"] > 0 and one_status["modified"]
    files = [os.path.join(d, f) for d, _, names in os.walk(one_status["path"]) for f in names if not f.startswith((".", "_"))]
    assert one_status["path"].startswith(str(tmp_path / "graph")) and one_status["size"] >= sum(map(os.path.getsize, files)) > 0
    board = one.board_of_projects()
    assert [(p["project"], p["total"], p["columns"]) for p in board.results["projects"]] == [("none", 0, {})] and not board.warnings
