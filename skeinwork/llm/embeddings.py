"""Operator 9: embedding near-dedup by collision-counting projections.

Vectors are dealt into cells by the signs of some projections, in several tables whose number follows from the wanted
recall. Inside a cell every vector is projected on many lines; each line is sorted, a window centred on the query picks
the neighbours that collide with it, and collisions are counted per pair. Pairs with enough collisions are verified by
their cosine in double precision. The least count is the one that pairs at the threshold reach with the wanted recall.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from math import acos, ceil, comb, erf, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm.common import released, stored
from skeinwork.llm.components import connected_components
from skeinwork.llm.simhash import _labels

THRESHOLD = 0.9
#: Recall wanted of the tables and of the counts, for pairs just at the threshold (closer pairs do better).
TABLE_RECALL, COUNT_RECALL = 0.98, 0.99
LINES, WINDOW = 32, 1.5
#: Vectors of a cell were they spread evenly, and the most that one task compares; larger cells are dealt by pairs of chunks.
CELL_MEAN, CELL_MOST = 1024, 4096
SEED = 11


@dataclass(frozen=True)
class Projections:
    """Signs per table, tables, the half width of windows and the least count of collisions."""

    signs: int
    tables: int
    half_width: float
    least: int

    @classmethod
    def calibrated(cls, count: int, threshold: float) -> Projections:
        signs = max(1, ceil(log2(max(2.0, count / CELL_MEAN))))
        together = (1 - acos(threshold) / pi) ** signs
        tables = ceil(log(1 - TABLE_RECALL) / log(1 - together))
        half_width = WINDOW * sqrt(2 - 2 * threshold)
        hit = erf(WINDOW / sqrt(2))
        least, missed = 0, 0.0
        while missed + (p := comb(LINES, least) * hit**least * (1 - hit) ** (LINES - least)) <= 1 - COUNT_RECALL:
            missed, least = missed + p, least + 1
        return cls(signs, tables, half_width, least)

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """The cell of each vector in each table; equal for equal vectors on every machine."""
        planes = np.random.default_rng(SEED).standard_normal((unit.shape[1], self.tables * self.signs))
        bits = (unit @ planes > 0).reshape(len(unit), self.tables, self.signs)
        return bits @ (1 << np.arange(self.signs, dtype=np.int64))

    def lines(self, unit: np.ndarray) -> np.ndarray:
        return (unit @ np.random.default_rng(SEED + 1).standard_normal((unit.shape[1], LINES))).T.astype(np.float32)


def sorted_lines(others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each line of projections in order, and the rank of each vector on it."""
    order = np.argsort(others, axis=1, kind="stable")
    rank = np.empty(others.shape, dtype=np.uint16 if others.shape[1] < 1 << 16 else np.uint32)
    np.put_along_axis(rank, order, np.arange(others.shape[1], dtype=rank.dtype)[None, :], axis=1)
    return np.take_along_axis(others, order, axis=1), rank


def collision_candidates(queries: np.ndarray, lines: tuple[np.ndarray, np.ndarray], half_width: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, other) that share a window on at least `least` lines; queries are given by line.

    A query's window is a range of ranks on each sorted line, and all vectors are counted for it at once.
    """
    counts = np.zeros((queries.shape[1], lines[0].shape[1]), dtype=np.int8)
    for mine, line, rank in zip(queries, *lines, strict=True):
        first = np.searchsorted(line, mine - half_width, "left").astype(rank.dtype)
        width = np.searchsorted(line, mine + half_width, "right").astype(rank.dtype) - first
        counts += rank[None, :] - first[:, None] < width[:, None]  # ranks before the window wrap round
    return np.nonzero(counts >= least)


def cell_links(unit: np.ndarray, codes: np.ndarray, table: int, chunk: np.ndarray, pair: tuple[int, int], plan: Projections, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j), i < j, of a cell; of a cell dealt by chunks those between the pair's chunks. A link belongs to the first table that holds it."""
    lines = plan.lines(unit)
    left = np.nonzero(chunk == pair[0])[0]
    right = left if pair[0] == pair[1] else np.nonzero(chunk == pair[1])[0]
    found_a, found_b, ordered = [], [], sorted_lines(lines[:, right])
    for at in range(0, len(left), 256):
        block = left[at : at + 256]
        q, o = collision_candidates(lines[:, block], ordered, plan.half_width, plan.least)
        a, b = block[q], right[o]
        ahead = a < b if pair[0] == pair[1] else np.ones(len(a), dtype=bool)
        a, b = a[ahead], b[ahead]
        for cut in range(0, len(a), 100_000):
            x, y = a[cut : cut + 100_000], b[cut : cut + 100_000]
            good = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
            good[good] &= ~(codes[x[good], :table] == codes[y[good], :table]).any(axis=1)
            found_a.append(x[good])
            found_b.append(y[good])
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (np.empty(0, dtype=np.int64),) * 2


def _unit(values: np.ndarray) -> np.ndarray:
    values = values.astype(np.float64)
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt(np.einsum("ij,ij->i", values, values))[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def links_of_classes(classes: DataFrame, threshold: float, cell_most: int = CELL_MOST) -> DataFrame:
    """(a, b, n): n copies linked with class a in some cell (b null), and links (a, b) that connect a cell's classes (n 0).

    classes holds (id, n, dim, embedding), each vector once and of the same length within dim. Vectors travel as they are
    stored, and become doubles in the task that compares them.
    """
    kind = classes.schema["embedding"].dataType.simpleString()
    plan = Projections.calibrated(classes.count(), threshold)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            dims = whole.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                batch = whole.filter(pa.array(dims == dim))
                codes = plan.codes(_unit(_matrix(batch.column(3))))
                for t in range(plan.tables):
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(codes), t, dtype=np.int32)), pa.array(codes[:, t])], names=["id", "n", "dim", "embedding", "t", "code"])

    dealt = classes.select("id", "n", "dim", "embedding").mapInArrow(deal, f"id long, n long, dim int, embedding {kind}, t int, code long")
    wide = dealt.groupBy("dim", "t", "code").agg(F.ceil(F.count(F.lit(1)) / F.lit(cell_most)).cast("int").alias("chunks")).filter("chunks > 1")
    chunk = F.pmod(F.xxhash64("id"), F.coalesce("chunks", F.lit(1))).cast("int")
    rows = dealt.join(stored(wide, "wide-cells"), ["dim", "t", "code"], "left").withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
    rows = rows.select("id", "n", "dim", "embedding", "t", "chunk", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), F.xxhash64("dim", "t", "code", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("cell"))
    parted = rows.repartition("cell").sortWithinPartitions("cell", "id")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            ids, copies = cell.column("id").to_numpy(), cell.column("n").to_numpy()
            unit = _unit(_matrix(cell.column("embedding").combine_chunks()))
            a, b = cell_links(unit, plan.codes(unit), cell.column("t")[0].as_py(), cell.column("chunk").to_numpy(), (cell.column("lo")[0].as_py(), cell.column("hi")[0].as_py()), plan, threshold)
            if not len(a):
                continue
            degree = np.bincount(a, weights=copies[b], minlength=len(ids)) + np.bincount(b, weights=copies[a], minlength=len(ids))
            linked = np.nonzero(degree)[0]
            label = _labels(len(ids), a, b)
            hung = np.nonzero(label != np.arange(len(ids)))[0]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([ids[linked], ids[hung]])),
                    pa.array([None] * len(linked) + ids[label[hung]].tolist(), pa.int64()),
                    pa.array(np.concatenate([degree[linked].astype(np.int64), np.zeros(len(hung), dtype=np.int64)])),
                ],
                names=["a", "b", "n"],
            )

    return parted.mapInArrow(released(task), "a long, b long, n long")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one cell after another; rows come sorted by cell."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        cells = batch.column("cell").to_numpy()
        cuts = [0, *(np.nonzero(cells[1:] != cells[:-1])[0] + 1).tolist(), len(cells)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(a, b - a)
            if held and held[0].column("cell")[0] != part.column("cell")[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, cell_most: int = CELL_MOST) -> DataFrame:
    """Per row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors of cosine >= threshold link; none below it do. Null and zero vectors and those with null or non-finite parts
    link with nothing, and neither do vectors of different lengths. Every row is a vector, so repeated rows and rows of one
    vec_id link with each other like any others. A null vec_id is linked like any other, but names a component only if it
    holds no other (component_id is null then, and kept true). Equal vectors are compared once, as a class. An empty table
    gives no rows; other columns are not read.
    """
    parts = F.col("embedding")
    finite = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.coalesce(parts.isNotNull() & finite & F.exists(parts, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", valid.alias("valid"))
    rows = rows.select("vec_id", "valid", "embedding", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))
    classes = rows.filter("valid").groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "least", "n", "embedding", F.size("embedding").alias("dim")), "vector-classes")
    found = stored(links_of_classes(classes, threshold, cell_most), "vector-links")
    degrees = found.filter("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("linked"))
    joined = connected_components(found.filter("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "id")
    known = classes.select("h1", "h2", "id", "least", "n").join(degrees, "id", "left").join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    names = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(names, "component").select("h1", "h2", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id", F.lit(True).alias("valid"))
    out = rows.drop("embedding").join(known, ["h1", "h2", "valid"], "left")
    component = F.when(F.col("valid"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(os.path.join(sf_dir, "embeddings.parquet")).select("vec_id", "embedding"))


#: Every pair by cosine; the query finds them by counting, with the recall that it is calibrated for.
ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CASE WHEN embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN embedding::DOUBLE[] END AS e
  FROM embeddings
), pairs AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.9
), reach AS (SELECT x, y FROM pairs UNION SELECT reach.x, pairs.y FROM reach JOIN pairs ON reach.y = pairs.x),
least AS (SELECT x, least(x, min(y)) AS c FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS n FROM pairs GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id)::BIGINT AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM v LEFT JOIN degree ON degree.x = vec_id LEFT JOIN least ON least.x = vec_id
"""
