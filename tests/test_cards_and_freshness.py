import json
import os

import pytest
from pyspark.sql import functions as F

from skeinwork.functions import predicates as P
from skeinwork.operators import board, cards, freshness
from skeinwork.sources.cards import read_store
from skeinwork.sources.graph_json import read_graph, read_registry


def test_card_store(spark, tmp_path):
    store = cards.CardStore(spark, str(tmp_path))
    assert store.cards().count() == 0
    card = store.create_card("title", priority="high")
    store.update_card(card, status="In Progress", description="more")
    with pytest.raises(ValueError):
        store.update_card(card)
    with pytest.raises(ValueError):
        store.update_card(card, status="Done")
    with pytest.raises(KeyError):
        store.update_card("nothing", title="x")
    store.add_comment(card, "me", "one")
    before = store.cards().first()["updated_at"]
    store.add_comment(card, "me", "two")
    assert store.cards().first()["updated_at"] == before
    store.complete_card(card, "done")
    row = store.cards().first()
    assert (row["title"], row["status"], row["priority"], row["description"]) == ("title", "Complete", "high", "more")
    said = cards.card_with_comments(store.cards(), store.comments(), card).collect()
    assert [r["comment"] for r in said] == ["one", "two", "Completion: done"]
    assert cards.list_cards(store.cards(), "", None).count() == 1 and cards.list_cards(store.cards(), "Created").count() == 0
    assert cards.last_comment(store.comments(), card).first()[0] == said[-1]["comment_id"]


def test_two_writers(spark, tmp_path):
    one, two = cards.CardStore(spark, str(tmp_path)), cards.CardStore(spark, str(tmp_path))
    card = one.create_card("title")
    for i in range(3):
        one.update_card(card, title=f"one {i}")
        two.update_card(card, title=f"two {i}")
    ids = [store.add_comment(card, "me", "x") for store in (one, two, one, two)]
    assert len(set(ids)) == 4 and ids == sorted(ids)
    assert one.cards().first()["title"] == "two 2"
    numbers = [r[0] for r in spark.read.parquet(one.events_path).select("seq").collect()]
    assert len(set(numbers)) == 7


def test_cached_graph_outlives_its_source(spark, tmp_path):
    now, path = [0.0], tmp_path / "graph.json"
    write = lambda n: path.write_text(json.dumps({"nodes": [{"id": f"n{i}"} for i in range(n)], "edges": []}))

    def build():
        graph = read_graph(spark, str(path))
        if graph.nodes.isEmpty():
            raise FileNotFoundError(str(path))
        return freshness.materialised(graph)

    write(2)
    cache = freshness.GraphCache(build, 30, lambda: now[0])
    assert cache.get()[0].nodes.count() == 2
    write(5)
    assert cache.get()[0].nodes.count() == 2  # within its time, whatever the source says
    path.unlink()
    assert cache.get()[0].nodes.count() == 2
    now[0] = 40.0
    with pytest.warns(UserWarning):
        last, told = cache.get()
    assert last.nodes.count() == 2 and "40 s old" in told[0]
    write(5)
    assert cache.get()[0].nodes.count() == 5


def test_missing_graph_and_dirty_mark(spark, tmp_path):
    with pytest.warns(UserWarning, match="no graph"):
        graph = read_graph(spark, str(tmp_path / "none.json"))
    assert graph.nodes.count() == graph.edges.count() == 0
    mark = freshness.DirtyMark(str(tmp_path / "state" / "dirty"), ("made/",))
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    assert not mark.set_for(paths("made/a.py", "notes.txt", None)) and not mark.is_set()
    assert mark.set_for(paths("notes.txt", "src/a.py")) and mark.is_set()
    mark.clear()
    assert not mark.is_set() and freshness.should_refresh(mark.is_set(), report_exists=False)


def test_board(spark):
    rows = [("p", f"c{i}", "Created", f"2024-01-0{i}", None if i < 5 else "2024-02-01") for i in range(1, 6)] + [("q", "x", "Odd", "2024-01-01", "2024-03-01")]
    df = spark.createDataFrame(rows, "project string, card_id string, status string, created_at string, updated_at string")
    named = spark.createDataFrame([("p",), ("q",), ("idle",)], "project string")
    counts = {r["project"]: r for r in board.column_counts(df, named).collect()}
    assert counts["p"]["created"] == 5 and counts["p"]["collapsed"] and counts["p"]["total"] == 5
    assert counts["q"]["other"] == 1 and counts["q"]["total"] == 0 and counts["idle"]["total"] == 0
    assert [r["card_id"] for r in board.newest(df).filter("project = 'p'").orderBy("place").collect()] == ["c5", "c4", "c3"]
    assert board.newest(df, None).count() == 6
    assert [r["project"] for r in board.project_order(df, named).orderBy("place").collect()] == ["q", "p", "idle"]


def test_read_store(spark, tmp_path):
    assert read_store(spark, str(tmp_path / "none.db"))[2] is None
    (tmp_path / "bad.db").write_text("not a database")
    found, _, error = read_store(spark, str(tmp_path / "bad.db"))
    assert found.count() == 0 and error


def test_json_sources(spark, tmp_path):
    doc = {"nodes": [{"id": "a", "file_type": "code"}, {"id": "b", "type": None, "file_type": "code"}], "links": [{"source": "a", "target": "b", "relation": "calls"}]}
    (tmp_path / "g.json").write_text(json.dumps(doc, indent=1))
    g = read_graph(spark, str(tmp_path / "g.json"))
    assert [(r["id"], r["type"]) for r in g.nodes.orderBy("pos").collect()] == [("a", "code"), ("b", None)]
    assert [(r["src"], r["dst"], r["rel"]) for r in g.edges.collect()] == [("a", "b", "calls")]
    (tmp_path / "r.json").write_text('{"one": "/x/one", "bad": 3}')
    assert [tuple(r) for r in read_registry(spark, str(tmp_path / "r.json")).collect()] == [("one", "/x/one")]


def test_cache_and_lock(tmp_path):
    now, built = [0.0], []

    def build():
        if len(built) == 1:
            built.append("failed")
            raise RuntimeError("down")
        built.append("ok")
        return len(built)

    cache = freshness.GraphCache(build, 30, lambda: now[0])
    assert cache.get() == (1, []) and cache.get() == (1, [])
    now[0] = 60
    value, warnings = cache.get()
    assert value == 1 and "down" in warnings[0]
    assert cache.get() == (3, [])
    assert [freshness.parse_ttl(x) for x in (None, "", "bad", "0", "5.5")] == [30, 30, 30, 0, 5.5]
    path = str(tmp_path / "lock")
    lock = freshness.RefreshLock(path, 160)
    assert lock.acquire() and not freshness.RefreshLock(path, 160).acquire()
    os.utime(path, (0, 0))
    assert freshness.RefreshLock(path, 160).acquire()
    assert not freshness.state_changed(None, "a") and freshness.state_changed("a", "b") and not freshness.state_changed("a", "a")
    assert freshness.should_refresh(False, False) and not freshness.should_refresh(False, True) and freshness.should_refresh(True, True) and not freshness.should_refresh(False, False, if_dirty=True)


def test_predicates(spark):
    df = spark.createDataFrame([("src/a.py",), ("build/a.py",), ("a.PY",), ("graph-out/x.py",), ("graph-out",), ("a.txt",), (".py",)], "path string")
    assert {r["path"] for r in df.filter(P.is_relevant_source(F.col("path"), ("graph-out/",))).collect()} == {"src/a.py", "a.PY"}
    kinds = spark.createDataFrame([("nvarchar", -1, 0, 0), ("char", 5, 0, 0), ("decimal", 9, 10, 2), ("time", 5, 0, 3), ("int", 4, 10, 0), ("varchar", None, 0, 0)], "data_type string, max_length int, precision int, scale int")
    assert [r[0] for r in kinds.select(P.type_display()).collect()] == ["nvarchar(max)", "char(5)", "decimal(10,2)", "time(3)", "int", "varchar"]
    roots = spark.createDataFrame([("/a/x",), ("/b/x/",), ("/c/y",)], "root string")
    assert {r["slug"] for r in freshness.registered(roots).collect()} == {"a-x", "b-x", "y"}
