import hashlib
import os
import random
from collections import Counter, defaultdict

import pytest

from skeinwork.llm import line_dedup


def brute(rows, least):
    lines = [(t or "").split("\n") for _, t in rows]
    key = lambda x: x.encode().strip(b" \t\n\x0b\f\r").lower()
    documents = defaultdict(set)  # rows of one doc_id are one document, rows without are one each
    for i, ((doc, _), parts) in enumerate(zip(rows, lines, strict=True)):
        documents[("row", i) if doc is None else doc].update(map(key, parts))
    held = Counter(k for keys in documents.values() for k in keys)
    out = []
    for (doc, _), parts in zip(rows, lines, strict=True):
        kept = [x for x in parts if not key(x) or held[key(x)] < least]
        out.append((doc, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


ROWS = [(i, f"own {i}\n Common LINE\t\n\nhalf {i % 2}\nÉtage") for i in range(9)] + [(20, None), (21, ""), (3, "common line\ncommon line"), (None, "étage\nCOMMON line"), (22, "\n\n"), (23, "x" * 200_000 + "\ncommon line")]
ROWS += [(30, "in one document of many rows")] * 7 + [(None, "without id")] * 5


@pytest.mark.parametrize("bound", [10, 0])
def test_brute_force(spark, bound):
    df = spark.createDataFrame([(*r, "other", 7) for r in ROWS], "doc_id long, text string, n_lines string, h1 int").repartition(3)
    out = line_dedup.dedup_lines(df, min_docs=5, batches=3, broadcast_keys=bound)
    assert out.columns == ["doc_id", "text", "h1", "n_lines", "n_dropped"]
    got = sorted([(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect()], key=str)
    assert got == brute(ROWS, 5)


def test_runs_compact(spark):
    batch = spark.createDataFrame([(1, 1, None, 1), (2, 2, None, 2), (3, 3, None, 0), (4, 4, 9, 1), (4, 4, 9, 1)], "h1 long, h2 long, again long, n long")
    runs = line_dedup.LineRuns(spark, min_docs=4, fanout=2)
    for _ in range(5):
        runs.add(batch)
    assert max(runs.levels) >= 1 and any(runs.settled(run).count() for run in runs.live())
    assert sorted(r["h1"] for r in runs.finish().collect()) == [1, 2, 4]
    names = list(runs.tables)
    runs.drop()
    assert names and not any(spark.catalog.tableExists(name) for name in names)
    assert line_dedup.LineRuns(spark, 1).finish().count() == 0


@pytest.mark.parametrize("fanout", [2, 3, 7])
def test_merges_add_counts_up(spark, fanout):
    """Keys spread thinly over all batches: every sum is that of a plain counter, whichever runs have been merged."""
    rng = random.Random(fanout)
    held, runs = Counter(), line_dedup.LineRuns(spark, min_docs=10**9, fanout=fanout)
    for _ in range(6):
        rows = Counter(rng.randrange(-60, 60) for _ in range(90))
        held.update(rows)
        runs.add(spark.createDataFrame([(k, k * 7, None, n) for k, n in rows.items()], "h1 long, h2 long, again long, n long"))
    assert {r["h1"]: r["n"] for r in runs.merged(runs.live()).collect()} == held
    runs.drop()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_batches_are_merge_anti_joined(spark, monkeypatch):
    """With the defaults of the query most batches meet settled keys, no run is shuffled again, and thin keys are found."""
    plans, fresh, merged = [], line_dedup.LineRuns.fresh, line_dedup.LineRuns.merged

    def watch(how, kind):
        def call(self, given):
            found = how(self, given)
            plans.append((kind, any(self.settled(run).count() for run in self.live()), plan_of(found)))
            return found

        return call

    monkeypatch.setattr(line_dedup.LineRuns, "fresh", watch(fresh, "fresh"))
    monkeypatch.setattr(line_dedup.LineRuns, "merged", watch(merged, "merged"))
    # each thin line is in two documents of every batch of twenty, twelve in all; each rare one in nine
    docs = spark.createDataFrame([(i, f"common\nown {i}\npart {i % 7}\nthin {i % 10}" + (f"\nrare {i % 13}" if i < 117 else "")) for i in range(120)], "doc_id long, text string")
    found = line_dedup.frequent_lines(docs, line_dedup.MIN_DOCS)
    assert found.count() == 18 == found.distinct().count()
    batches = [p for p in plans if p[0] == "fresh"]
    assert len(batches) == line_dedup.BATCHES and sum(bool(settled) for _, settled, _ in batches) >= line_dedup.BATCHES - line_dedup.FANOUT
    assert all("SortMergeJoin" in plan and "LeftAnti" in plan and plan.count("Exchange") == 1 for _, settled, plan in batches if settled)
    merges = [plan for kind, _, plan in plans if kind == "merged"]
    assert len(merges) >= 3 and all("FullOuter" in plan for plan in merges) and not any("Exchange" in plan for plan in merges)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("skeinwork_lines_")]


@pytest.mark.parametrize("bound", [line_dedup.BROADCAST_KEYS, 0])
def test_random_documents(spark, bound):
    """Production defaults against brute force; line frequencies lie around the threshold, spread over all batches."""
    rng = random.Random(5)
    lines = [f"Line {i}" for i in range(60)]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randrange(1, 9))) if i % 17 else None) for i in range(150)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), broadcast_keys=bound).collect()
    assert sorted([(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got], key=str) == brute(rows, line_dedup.MIN_DOCS)


def test_empty_table(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_digests():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0") and line_dedup.line_key(" A ".encode()) == " a".encode()


@pytest.mark.parametrize("sf_dir", [d for d in ("/root/testdata/sf0.001", "/root/testdata/sf0.01") if os.path.isdir(d)])
def test_against_sql(spark, sf_dir):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(map(tuple, db.execute(line_dedup.ORACLE_SQL).fetchall()))
    assert sorted(tuple(r[c] for c in ("doc_id", "n_lines", "n_dropped", "kept_sha256")) for r in line_dedup.query(spark, sf_dir).collect()) == want
