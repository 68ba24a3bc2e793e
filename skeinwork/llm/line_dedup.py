"""Operator 1: line dedup over levelled sorted runs of line hashes.

Documents come in batches (of a table: ranges of its ids). A batch's line keys, counted by document, are merge-anti-joined
with the settled keys of every live run (those it has already counted often enough) and added as a sorted run of level 0;
when a level holds `fanout` runs they are merged into one run of the next level, their counts added by full sort-merge
joins. All runs are tables bucketed and sorted by key, so neither the anti-joins nor the merges shuffle a run again.
"""

from __future__ import annotations

import os
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm.common import BLANKS, discard, released, scratch, shared_dir, stored, widened

#: Settled keys up to this number are broadcast (16 bytes each); more are joined.
BROADCAST_KEYS = 500_000
MIN_DOCS = 10
SALTS = 16
#: Batches of a table, runs of a level that are merged, and line keys of a bucket of a run.
BATCHES, FANOUT, BUCKET_KEYS = 6, 2, 1_000_000
_BLANK_BYTES = BLANKS.encode()


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at both ends, A-Z in lower case."""
    return line.strip(_BLANK_BYTES).lower()


def _digests(keys) -> np.ndarray:
    """Two signed 64-bit numbers for each key."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(k) for k in keys]), dtype="<i8").reshape(-1, 2)


def in_batches(docs: DataFrame, batches: int, text_col: str = "text") -> DataFrame:
    """(batch, again, text): rows by ranges of doc_id (null ids in the first); again is the doc_id where several rows have it."""
    ids = docs.select(F.col("doc_id").cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    cuts = sorted(set(ids.approxQuantile("id", [i / batches for i in range(1, batches)], 0.01)))
    batch = sum((F.coalesce(F.col("id") > cut, F.lit(False)).cast("int") for cut in cuts), F.lit(0))
    repeated = stored(ids.filter("id IS NOT NULL").groupBy("id").count().filter("count > 1").select("id", F.col("id").alias("again")), "line-ids")
    if repeated.isEmpty():
        return ids.select(batch.alias("batch"), F.lit(None).cast("long").alias("again"), "text")
    return ids.join(repeated, "id", "left").select(batch.alias("batch"), "again", "text")


def count_lines(batched: DataFrame) -> DataFrame:
    """(batch, h1, h2, again, n): each key that is not empty with its number of documents, summed within each Arrow batch;
    documents of several rows come by themselves."""

    def task(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in arrow:
            seen: Counter = Counter()
            for batch, again, raw in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                seen.update({(batch, again, k) for k in map(line_key, (raw or b"").split(b"\n")) if k})
            if seen:
                batch, again, keys = zip(*seen, strict=True)
                h = _digests(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(batch, pa.int32()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(again, pa.int64()), pa.array(seen.values(), pa.int64())],
                    names=["batch", "h1", "h2", "again", "n"],
                )

    return batched.mapInArrow(released(task), "batch int, h1 long, h2 long, again long, n long")


class LineRuns:
    """The runs: level -> runs of (h1, h2, n), n being the documents of a key that the run has counted.

    Every run is a table of its own in the shared folder, in `buckets` buckets by key and sorted within them. Keys that have
    reached the threshold in a run are settled: later batches leave them out, and merges carry them on.
    """

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = FANOUT, buckets: int = 8):
        self.spark, self.min_docs, self.fanout, self.buckets = spark, min_docs, fanout, buckets
        self.levels: dict[int, list[DataFrame]] = defaultdict(list)
        self.tables: list[str] = []

    def _run(self, keys: DataFrame) -> DataFrame:
        name = f"skeinwork_lines_{uuid.uuid4().hex}"
        self.tables.append(name)
        # one task for each bucket already, unless a configuration has dealt the keys to more
        keys.coalesce(self.buckets).write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{shared_dir(self.spark)}/{name}").saveAsTable(name)
        return self.spark.table(name)

    def live(self) -> list[DataFrame]:
        """The runs that no merge has taken yet, by level."""
        return [run for _, runs in sorted(self.levels.items()) for run in runs]

    def settled(self, run: DataFrame) -> DataFrame:
        return run.filter(F.col("n") >= self.min_docs).select("h1", "h2")

    def fresh(self, batch: DataFrame) -> DataFrame:
        """The keys of a batch of (h1, h2, again, n) with their documents, less those that a run has settled; one shuffle, of the batch."""
        dealt = batch.repartition(self.buckets, "h1", "h2")
        by_document = dealt.groupBy("h1", "h2", "again").agg(F.when(F.col("again").isNull(), F.sum("n")).otherwise(1).alias("n"))
        counted = by_document.groupBy("h1", "h2").agg(F.sum("n").alias("n"))
        for run in self.live():
            counted = counted.join(self.settled(run).hint("merge"), ["h1", "h2"], "left_anti")
        return counted

    def add(self, batch: DataFrame) -> None:
        """Adds a batch as a run of level 0; a level of `fanout` runs becomes a run of the next one."""
        self.levels[0].append(self._run(self.fresh(batch)))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self.levels[level + 1].append(self._run(self.merged(self.levels.pop(level))))
            level += 1

    def merged(self, runs: list[DataFrame]) -> DataFrame:
        """The keys of runs with the sums of their counts: sort-merge joins of two runs at a time, which shuffle neither.

        (A union of bucketed tables must not be grouped instead: Spark takes it for bucketed, though its scans are only strung together.)
        """
        every = runs[0]
        for i, run in enumerate(runs[1:]):
            if i:  # a full join has no known partitioning, so more than two runs go by a table between
                every = self._run(every)
            a, b = every.withColumnRenamed("n", "n_a"), run.withColumnRenamed("n", "n_b").hint("merge")
            zero = F.lit(0).cast("long")
            every = a.join(b, ["h1", "h2"], "full_outer").select("h1", "h2", (F.coalesce("n_a", zero) + F.coalesce("n_b", zero)).alias("n"))
        return every

    def finish(self) -> DataFrame:
        """The keys that at least min_docs documents hold, each once."""
        left = self.live()
        return self.settled(self.merged(left)) if left else self.spark.createDataFrame([], "h1 long, h2 long")

    def drop(self) -> None:
        """Drops the tables of all runs, files included; what finish() gave can't be read any more."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            discard(self.spark, f"{shared_dir(self.spark)}/{name}")
        self.tables, self.levels = [], defaultdict(list)


def frequent_lines(docs: DataFrame, min_docs: int, batches: int = BATCHES, fanout: int = FANOUT, text_col: str = "text") -> DataFrame:
    """(h1, h2) of the line keys found in at least min_docs documents, each once, through the levelled runs."""
    with scratch(docs.sparkSession):
        counted = stored(count_lines(in_batches(docs, batches, text_col)), "line-counts", ["batch"])
        runs = LineRuns(docs.sparkSession, min_docs, fanout, max(8, counted.count() // BUCKET_KEYS))
        try:
            for batch in range(batches):
                runs.add(counted.filter(F.col("batch") == batch).drop("batch"))
            return stored(runs.finish(), "line-keys", keep=True)
        finally:
            runs.drop()


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES, text_col: str = "text", broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """docs with their text less the frequent lines, and n_lines and n_dropped (input columns so named are replaced).

    Rows of one doc_id are one document where keys are counted; rows without doc_id are one each. Every row comes out. A null or empty text is one empty line, and its text
    comes out empty. Empty keys are never dropped. An empty table gives an empty result. Up to `broadcast_keys` frequent
    keys are broadcast; beyond it lines are exploded and joined with salted keys, so a frequent line has no single task.
    """
    docs = docs.drop("n_lines", "n_dropped")
    keys = frequent_lines(docs, min_docs, batches, text_col=text_col)
    found = keys.limit(broadcast_keys + 1).collect()
    if len(found) <= broadcast_keys:
        return _drop_broadcast(docs, {np.array(tuple(r), dtype="<i8").tobytes() for r in found}, text_col)
    return _drop_joined(docs, keys, text_col)


def _drop_broadcast(docs: DataFrame, frequent: set[bytes], text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    at = docs.columns.index(text_col)

    def task(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop = shared.value
        for batch in arrow:
            texts, lines_of, dropped = [], [], []
            for raw in batch.column(at).cast(pa.binary()).to_pylist():
                lines = (raw or b"").split(b"\n")
                keys = [line_key(x) for x in lines]
                kept = [x for x, k in zip(lines, keys, strict=True) if not k or xxhash.xxh3_128_digest(k) not in drop]
                texts.append(b"\n".join(kept))
                lines_of.append(len(lines))
                dropped.append(len(lines) - len(kept))
            columns = [c if i != at else pa.array(texts, type=pa.binary()).cast(pa.string()) for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines_of, pa.int64()), pa.array(dropped, pa.int64())], names=[*batch.schema.names, "n_lines", "n_dropped"])

    return docs.mapInArrow(released(task), widened(docs, n_lines="long", n_dropped="long"))


def _drop_joined(docs: DataFrame, keys: DataFrame, text_col: str) -> DataFrame:
    names = [c for c in docs.columns if c != text_col]
    others = F.struct(*names) if names else F.struct(F.lit(0).alias("none"))
    numbered = docs.withColumn("row of text", F.monotonically_increasing_id())  # before the lines are made, so that they share it
    lines = numbered.select(F.col("row of text").alias("row"), others.alias("others"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("pos", "line"))
    lines = lines.select("row", F.when(F.col("pos") == 0, F.col("others")).alias("others"), "pos", "line")

    def task(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            found = [line_key(x) for x in batch.column(3).cast(pa.binary()).to_pylist()]
            h = _digests(found)
            first = pa.array([x if k else None for x, k in zip(h[:, 0].tolist(), found, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, first, pa.array(h[:, 1].copy())], names=[*batch.schema.names, "h1", "h2"])

    keyed = lines.mapInArrow(released(task), widened(lines, h1="long", h2="long")).withColumn("salt", F.pmod("row", F.lit(SALTS)))
    salted = keys.select("h1", "h2", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"), F.lit(True).alias("hit"))
    kept = keyed.join(salted, ["h1", "h2", "salt"], "left").groupBy("row").agg(
        F.first("others", ignorenulls=True).alias("others"),
        F.count(F.lit(1)).alias("n_lines"),
        F.count("hit").alias("n_dropped"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("hit").isNull(), F.struct("pos", "line")))), lambda x: x["line"]), "\n").alias("kept"),
    )
    return kept.select(*(F.col("kept" if c == text_col else f"others.`{c}`").alias(c) for c in docs.columns), "n_lines", "n_dropped")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet")).select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), frequent AS (
  SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(f.k)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN frequent f ON lines.k = f.k
GROUP BY doc_id
"""
