"""Searches through the index of substrings against scans."""

import random

import pytest
from pyspark.sql import functions as F

from skeinwork.functions import predicates as P
from skeinwork.model import PropertyGraph
from skeinwork.operators import code, graph, substring_index

LETTERS = "abAB%_\\.éÉßİ日 "


@pytest.fixture(scope="module")
def nodes(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choices(LETTERS, k=rng.randrange(12))), None if i % 9 == 0 else "".join(rng.choices(LETTERS, k=rng.randrange(9))), "code", i) for i in range(600)]
    rows += [("same.id", "Same Label", "code", i) for i in range(600, 620)]
    return spark.createDataFrame(rows, "id string, label string, type string, pos long").repartition(3).cache()


def test_equal_to_scan(spark, nodes, monkeypatch):
    monkeypatch.setattr(substring_index, "BLOCK", 64)
    indexed = PropertyGraph(nodes, nodes, None, substring_index.SubstringIndex(nodes))
    rng = random.Random(2)
    whole = [r["id"] for r in nodes.collect()] + [r["label"] or "" for r in nodes.collect()]
    needles = ["%_\\", "SAME", "e.i", "ab", "", "nothing at all", "éé", "ß", "日 "] + ["".join(rng.choices(LETTERS, k=3)) for _ in range(4)]
    needles += [w[(a := rng.randrange(max(1, len(w) - 3))) : a + rng.randrange(3, 7)] for w in rng.sample(whole, 8)]
    for n, needle in enumerate(needles):
        monkeypatch.setattr(substring_index, "PUSHED_ROWS", 1000 if n % 2 else 0)
        monkeypatch.setattr(substring_index, "BROADCAST_ROWS", 1000 if n % 3 else 0)
        want = sorted(r["pos"] for r in nodes.filter(P.holds(needle, "id", "label")).collect())
        assert sorted(r["pos"] for r in code.search_symbols(indexed, needle).collect()) == want, needle
        assert [r["pos"] for r in graph.search_nodes(indexed, needle, fuzzy=True, limit=5).collect()] == want[:5], needle


def test_few_rows_are_compared(spark):
    """Of many rows only those that hold the rarest trigrams are fetched, however common the others are."""
    rows = spark.range(20_000).select(F.concat(F.lit("common.prefix."), F.lpad(F.col("id").cast("string"), 6, "0")).alias("id"), F.lit("Common label").alias("label"), F.col("id").alias("pos"))
    index = substring_index.SubstringIndex(rows)
    assert index.candidates("prefix.012345").count() <= 20
    assert index.candidates("x.0123450").count() == 0 and index.candidates("zzz").count() == 0
    assert index.candidates("00").count() == 20_000 == index.candidates("COMMON.").count()
    plan = index._tables()[1].filter(F.col("gram").isin(substring_index.grams_of("012345")))._jdf.queryExecution().executedPlan().toString()
    assert "In(gram" in plan


def test_index_is_found_again(spark, tmp_path, monkeypatch):
    made, prepare = [], substring_index.SubstringIndex._prepare
    monkeypatch.setattr(substring_index.SubstringIndex, "_prepare", lambda self, folder: made.append(folder) or prepare(self, folder))
    path = str(tmp_path / "nodes")
    for text, times in (("first", 1), ("second", 2)):
        spark.createDataFrame([(text, text, 1)], "id string, label string, pos long").write.mode("overwrite").parquet(path)
        for _ in range(2):
            index = substring_index.SubstringIndex(spark.read.parquet(path), files=[path])
            assert [r["id"] for r in index.candidates(text[:4]).collect()] == [text]
        assert len(made) == times


def _shuffled_rows(spark):
    """Rows that the session's stages have written to shuffles so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_only_posting_lists_are_shuffled(spark):
    """The build shuffles a row for each trigram of a run, neither the rows nor what they post."""
    rows = spark.range(20_000).select(F.concat(F.lit("node:"), F.col("id").cast("string")).alias("id"), F.lit("Common label").alias("label"), F.col("id").alias("pos"))
    before, index = _shuffled_rows(spark), substring_index.SubstringIndex(rows)
    postings = index._tables()[1]
    assert _shuffled_rows(spark) - before <= 6_000 < 20_000
    assert postings.agg(F.sum("count")).first()[0] > 200_000


def test_runs_of_few_characters(spark, tmp_path, monkeypatch):
    """Runs end at rows, at characters and at files; texts that are empty, short, long or repeat a trigram are found all the same."""
    monkeypatch.setattr(substring_index, "BLOCK", 40)
    monkeypatch.setattr(substring_index, "BLOCK_CHARS", 60)
    rng = random.Random(3)
    texts = ["", None, "a", "ab", "aaaaaaa", "日本語日本語", "\U0001f600\U0001f601\U0001f602x", "long " * 50 + "end"] + ["".join(rng.choices("abc", k=rng.randrange(20))) for _ in range(300)]
    spark.createDataFrame([(t, None, i) for i, t in enumerate(texts)], "id string, label string, pos long").repartition(5).write.parquet(str(tmp_path / "nodes"))
    spark.createDataFrame([("", None, -1)], "id string, label string, pos long").write.mode("append").parquet(str(tmp_path / "nodes"))
    nodes = spark.read.parquet(str(tmp_path / "nodes"))
    index = substring_index.SubstringIndex(nodes)
    assert index._tables()[1].agg(F.max(F.size("offsets"))).first()[0] <= 40
    for needle in ("aaa", "abcab", "本語日", "\U0001f601\U0001f602X", "g end", "cba", "zzz"):
        want = sorted(r["pos"] for r in nodes.filter(P.holds(needle, "id", "label")).collect())
        assert sorted(r["pos"] for r in index.candidates(needle).filter(P.holds(needle, "id", "label")).collect()) == want, needle
