"""Logs that compact, snapshots that processes share, and the boards of many stores."""

import json
import os
import random
import sqlite3
import subprocess
import sys
import threading
import time

import pytest

from skeinwork.model import PropertyGraph
from skeinwork.operators import cards
from skeinwork.operators.snapshots import SharedGraph
from skeinwork.sources import card_stores


def files_of(path):
    return [f for f in os.listdir(path) if f.endswith(".parquet")]


# ---- the card log


@pytest.mark.parametrize("seed", [1, 2])
def test_any_interleaving_folds_alike(spark, tmp_path, seed):
    """Two writers, foldings at any time, and appends in the middle of a folding: the states of all events."""
    rng = random.Random(seed)
    stores = [cards.CardStore(spark, str(tmp_path), buckets=4, most_files=5, grace=1e9) for _ in range(2)]
    ids = [f"card{i}" for i in range(5)]
    for step in range(16):
        store = rng.choice(stores)
        store.append_events([(rng.choice(ids), {f: rng.choice([None, f"{f} {step}"]) for f in cards.FIELDS}) for _ in range(rng.randrange(1, 4))])
        if rng.random() < 0.2:
            store.event_log.fold()
    every = spark.read.parquet(stores[0].events_path)  # with this grace no file is gone
    want = sorted(map(str, cards.current_state(every).select("card_id", *cards.FIELDS, "created_at", "updated_at").collect()))
    assert sorted(map(str, stores[0].cards().collect())) == want and stores[0].event_log.pointer()["buckets"]
    merge = stores[1].event_log.merge

    def late(rows):  # an append while the folding is under way
        stores[1].event_log.merge = merge
        stores[0].append_events([("card0", {"title": "late"})])
        return merge(rows)

    stores[1].append_events([("card1", {"title": "before"})])
    stores[1].event_log.merge = late
    stores[1].event_log._folded_schema()
    stores[1].event_log.merge = late
    assert stores[1].event_log.fold()
    titles = {r["card_id"]: r["title"] for r in stores[0].cards().collect()}
    assert titles["card0"] == "late" and titles["card1"] == "before"


def test_files_stay_few(spark, tmp_path):
    store = cards.CardStore(spark, str(tmp_path), buckets=2, most_files=3, grace=-1)
    card = store.create_card("title")
    for i in range(9):
        store.update_card(card, title=f"title {i}")
        store.add_comment(card, "me", str(i))
        assert len(files_of(store.events_path)) <= 8 and len(files_of(store.comments_path)) <= 8
    assert store.cards().first()["title"] == "title 8"
    said = cards.card_with_comments(store.cards(), store.comments(), card).collect()
    assert [r["comment"] for r in said] == [str(i) for i in range(9)]
    folders = [d for d in os.listdir(tmp_path / "states") if d.startswith("v-") and any("bucket=" in x for x in os.listdir(tmp_path / "states" / d))]
    assert len(folders) <= 3


def test_existence_reads_one_bucket(spark, tmp_path):
    store = cards.CardStore(spark, str(tmp_path), buckets=8)
    store.append_events([(f"card{i}", {"title": "x"}) for i in range(60)])
    store.event_log.fold()
    plan = store.event_log.read("card7")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(card_id,card7)" in plan and "[1 paths]" in plan or "InMemoryFileIndex(1 paths)" in plan
    assert store._exists("card7") and not store._exists("card77")


# ---- shared snapshots

BUILDER = """
import sys, time
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from skeinwork.model import PropertyGraph
from skeinwork.operators.snapshots import SharedGraph
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {dir!r}).getOrCreate()
def build():
    open({log!r}, "a").write("built ")
    nodes = spark.createDataFrame([("other", "o", "t", 1)], "id string, label string, type string, pos long")
    return PropertyGraph(nodes, spark.createDataFrame([], "src string, dst string, rel string, confidence string, pos long"))
graph, warnings = SharedGraph(spark, {path!r}, build, ttl=1e6).get()
print("GOT", [r["id"] for r in graph.nodes.collect()], warnings)
"""


def graph_of(spark, name):
    nodes = spark.createDataFrame([(name, name, "t", 1)], "id string, label string, type string, pos long")
    return PropertyGraph(nodes, spark.createDataFrame([(name, name, "r", None, 1)], "src string, dst string, rel string, confidence string, pos long"))


def test_two_processes_build_once(spark, tmp_path):
    path, log = str(tmp_path / "shared"), tmp_path / "log"
    code = BUILDER.format(root=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), dir=f"file://{tmp_path}/c", log=str(log), path=path)
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=True)
    assert "GOT ['other'] []" in done.stdout and log.read_text() == "built "
    mine = SharedGraph(spark, path, lambda: pytest.fail("built again"), ttl=1e6)
    graph, warnings = mine.get()
    assert [r["id"] for r in graph.nodes.collect()] == ["other"] and not warnings


def test_last_good_version(spark, tmp_path):
    now, names = [1000.0], ["first", None, "second", "third"]

    def build():
        name = names.pop(0)
        if name is None:
            raise RuntimeError("no source")
        return graph_of(spark, name)

    shared = SharedGraph(spark, str(tmp_path / "g"), build, ttl=30, grace=50, clock=lambda: now[0])
    seen = lambda: [r["id"] for r in shared.get()[0].nodes.collect()]
    assert seen() == ["first"] == seen()
    first = shared.current()["version"]
    now[0] += 40
    graph, warnings = shared.get()
    assert graph.nodes.first()["id"] == "first" and "40 s old: no source" in warnings[0]
    assert seen() == ["second"]
    assert os.path.isdir(tmp_path / "g" / first)  # readers may still have it
    now[0] += 60
    assert seen() == ["third"] and not os.path.isdir(tmp_path / "g" / first)
    assert len([d for d in os.listdir(tmp_path / "g") if d.startswith("v-")]) == 2
    fails = SharedGraph(spark, str(tmp_path / "h"), lambda: 1 / 0, ttl=30)
    with pytest.raises(ZeroDivisionError):
        fails.get()
    assert not os.path.exists(tmp_path / "h" / "building")


def test_while_another_builds(spark, tmp_path):
    """The last good version serves at once; the first one is waited for; a dead builder's claim runs out."""
    path, slow = str(tmp_path / "g"), threading.Event()

    def build():
        slow.wait(60)
        return graph_of(spark, "slow")

    first = threading.Thread(target=lambda: SharedGraph(spark, path, build, ttl=1e6).get())
    first.start()
    while not os.path.exists(f"{path}/building"):
        time.sleep(0.05)
    threading.Timer(0.5, slow.set).start()
    graph, warnings = SharedGraph(spark, path, lambda: pytest.fail("built twice"), ttl=1e6, pause=0.1).get()
    first.join()
    assert graph.nodes.first()["id"] == "slow" and not warnings
    with open(f"{path}/building", "w") as claim:
        claim.write(str(time.time()))
    if os.path.exists(f"{path}/.building.crc"):
        os.remove(f"{path}/.building.crc")
    graph, warnings = SharedGraph(spark, path, lambda: pytest.fail("claimed"), ttl=0).get()
    assert graph.nodes.first()["id"] == "slow" and "being rebuilt" in warnings[0]
    graph, warnings = SharedGraph(spark, path, lambda: graph_of(spark, "next"), ttl=0, clock=lambda: time.time() + 10_000).get()
    assert graph.nodes.first()["id"] == "next" and not warnings


# ---- many card stores


def make_store(root, rows):
    os.makedirs(root, exist_ok=True)
    with sqlite3.connect(os.path.join(root, card_stores.STORE_FILE)) as db:
        db.execute("CREATE TABLE cards (card_id TEXT, title TEXT, description TEXT, status TEXT, priority TEXT, created_at TEXT, updated_at TEXT)")
        db.executemany("INSERT INTO cards VALUES (?, ?, NULL, ?, ?, ?, ?)", rows)


def test_board_of_all(spark, tmp_path):
    """Good, missing, broken and half-made stores: every project has its row, errors stay with theirs."""
    roots = {name: str(tmp_path / name) for name in ("busy", "calm", "missing", "broken", "bare", "alike")}
    make_store(roots["busy"], [(f"c{i}", f"t{i}", ["Created", "In Progress", "Complete", "Odd"][i % 4], "high", f"2024-01-{i + 1:02}", f"2024-02-{i + 1:02}") for i in range(18)])
    make_store(roots["calm"], [("x", "only", "Created", None, "2024-01-01", "2024-01-05"), ("y", None, None, None, "2024-01-02", "")])
    make_store(roots["alike"], [("x", "only", "Complete", None, "2024-01-01", "2024-01-05")])
    os.makedirs(roots["broken"])
    with open(os.path.join(roots["broken"], card_stores.STORE_FILE), "wb") as f:
        f.write(b"no database at all" * 400)
    os.makedirs(roots["bare"])
    sqlite3.connect(os.path.join(roots["bare"], card_stores.STORE_FILE)).execute("CREATE TABLE other (x)").connection.commit()
    registry = spark.createDataFrame(list(roots.items()), "slug string, root string")
    rows = card_stores.read_stores(spark, registry)
    assert rows.rdd.getNumPartitions() == len(roots)
    counts, newest = card_stores.board_of_all(spark, registry)
    got = {r["project"]: r for r in counts.collect()}
    assert [p for p, _ in sorted(((p, r["place"]) for p, r in got.items()), key=lambda x: x[1])] == ["busy", "alike", "calm", "bare", "broken", "missing"]
    assert (got["busy"]["created"], got["busy"]["in_progress"], got["busy"]["complete"], got["busy"]["other"]) == (5, 5, 4, 4)
    assert (got["calm"]["created"], got["calm"]["other"], got["calm"]["last_activity"]) == (1, 1, "2024-01-05")
    assert {p: r["error"] for p, r in got.items() if r["error"]} == {"broken": card_stores.UNREADABLE, "bare": card_stores.UNREADABLE}
    assert got["missing"]["total"] == 0 and got["missing"]["error"] is None
    assert newest.filter("project = 'busy'").count() == 12
    assert card_stores.read_stores(spark, registry.limit(0)).count() == 0
    assert json.dumps(sorted(rows.columns)) == json.dumps(sorted(["slug", *card_stores._FIELDS, "error"]))
