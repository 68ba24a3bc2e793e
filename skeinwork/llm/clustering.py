"""Operator 12: centroid clustering with block-norm screening.

Vectors become integers and are stored once, compressed, beside the norms of their segments. Against the norms of a
centroid's segments these give a lower bound of the squared distance (Cauchy-Schwarz, segment by segment: a difference is
at least as long as the lengths differ). Only centroids whose bound does not exceed the best distance found so far get
an exact one, in integers. A round sends no more to the driver than a sum for each centroid and component.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork.llm.common import released, stored

CENTROIDS, ROUNDS, DIM, SCALE, SEED = 8, 10, 64, 1024, 3
#: Segments of a vector whose norms are kept.
SEGMENTS = 8
#: Integers beyond this size leave too little room: a squared distance over 64 of them would not be sure to fit a long.
LARGEST = 1 << 27
#: Share of the norms by which a bound is lowered, as norms are rounded to doubles.
SLACK = 1e-12


def _segment_norms(whole: np.ndarray, segments: int) -> np.ndarray:
    parts = np.array_split(whole.astype(np.float64), segments, axis=1)
    return np.stack([np.sqrt(np.einsum("ij,ij->i", p, p)) for p in parts], axis=1)


def quantised(vectors: DataFrame, dim: int = DIM, scale: int = SCALE, segments: int = SEGMENTS, column: str = "embedding") -> DataFrame:
    """vectors that can be clustered, their other columns beside `whole` (floor(scale * x) of each component) and `norms`.

    Vectors that are null, of another length, with null or non-finite components, or with integers beyond LARGEST are left
    out (distances between those need not fit a long). Input columns named whole or norms are replaced.
    """
    vectors = vectors.drop("whole", "norms")
    x = F.col(column)
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < LARGEST / scale)
    kept = vectors.filter(x.isNotNull() & (F.size(x) == dim)).filter(F.forall(x, fine))
    at, names = kept.columns.index(column), [c for c in kept.columns if c != column]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            whole = np.floor(values * scale).astype(np.int64)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(a.ravel()), a.shape[1]).cast(pa.list_(pa.from_numpy_dtype(a.dtype))) for a in (whole.astype(np.int32), _segment_norms(whole, segments))]
            yield pa.RecordBatch.from_arrays([c for i, c in enumerate(batch.columns) if i != at] + lists, names=[*names, "whole", "norms"])

    schema = T.StructType([*kept.drop(column).schema.fields, T.StructField("whole", T.ArrayType(T.IntegerType())), T.StructField("norms", T.ArrayType(T.DoubleType()))])
    return kept.mapInArrow(released(task), schema)


@dataclass(frozen=True)
class Centroids:
    """Integer centroids, one in a row, and the norms of their segments."""

    whole: np.ndarray
    norms: np.ndarray

    @classmethod
    def of(cls, rows: list[list[int]], segments: int = SEGMENTS) -> Centroids:
        whole = np.array(rows, dtype=np.int64)
        return cls(whole, _segment_norms(whole, segments))

    def nearest(self, whole: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest centroid of each vector (of equal ones the smaller number), its squared distance, and how many
        exact distances were computed."""
        gaps = norms[:, None, :] - self.norms[None, :, :]
        room = SLACK * ((norms * norms).sum(axis=1)[:, None] + (self.norms * self.norms).sum(axis=1)[None, :]) + 1
        bounds = np.einsum("ijk,ijk->ij", gaps, gaps) - room
        # the centroid of the least bound first, then the others by number
        order = np.argsort(bounds, axis=1, kind="stable")
        cluster, best, computed = order[:, 0].copy(), np.full(len(whole), np.iinfo(np.int64).max), 0
        rows = np.arange(len(whole))
        for step in range(len(self.whole)):
            at = order[rows, step]
            live = np.nonzero(bounds[rows, at] <= best)[0] if step else rows
            if not len(live):
                break  # bounds only grow from here on
            numbers = at[live]
            apart = whole[live] - self.whole[numbers]
            distance = np.einsum("ij,ij->i", apart, apart)
            computed += len(live)
            better = (distance < best[live]) | ((distance == best[live]) & (numbers < cluster[live]))
            best[live[better]], cluster[live[better]] = distance[better], numbers[better]
        return cluster, best, computed


def _arrays(batch: pa.RecordBatch, whole_at: int, norms_at: int) -> tuple[np.ndarray, np.ndarray]:
    lists = [batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1) for i in (whole_at, norms_at)]
    return lists[0].astype(np.int64), lists[1]


def first_centroids(rows: DataFrame, k: int = CENTROIDS, seed: int = SEED, key: str = "vec_id") -> list[list[int]]:
    """The k vectors of smallest hex sha256 of `seed:key` (a null key: nothing after the colon); ties go by components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return [r["whole"] for r in rows.select(digest.alias("digest"), "whole").orderBy("digest", "whole").limit(k).collect()]


def sums(rows: DataFrame, centroids: Centroids) -> dict[int, tuple[int, list[int]]]:
    """centroid -> count and componentwise sums of the vectors nearest to it; k times dim sums reach the driver."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(centroids.whole), dtype=np.int64)
        total = np.zeros(centroids.whole.shape, dtype=np.int64)
        for batch in batches:
            whole, norms = _arrays(batch, 0, 1)
            cluster, _, _ = centroids.nearest(whole, norms)
            count += np.bincount(cluster, minlength=len(count))
            for c in np.unique(cluster):
                total[c] += whole[cluster == c].sum(axis=0)
        held = np.nonzero(count)[0]
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(count[held]), pa.array(total[held].tolist(), pa.list_(pa.int64()))], names=["c", "n", "total"])

    by_task = rows.select("whole", "norms").mapInArrow(released(task), "c long, n long, total array<long>")
    each = by_task.select("c", "n", F.posexplode("total").alias("i", "s")).groupBy("c", "i").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found: dict[int, tuple[int, list[int]]] = {}
    for r in each.orderBy("c", "i").collect():
        found.setdefault(r["c"], (int(r["n"]), []))[1].append(int(r["s"]))
    return found


def fit(rows: DataFrame, first: list[list[int]], rounds: int = ROUNDS) -> list[list[int]]:
    """The centroids after `rounds` rounds; empty ones stay. A round that moves none ends the loop, as no later one would."""
    now = first
    for _ in range(rounds if now else 0):
        found = sums(rows, Centroids.of(now))
        moved = [[s // found[c][0] for s in found[c][1]] if c in found else old for c, old in enumerate(now)]
        if moved == now:
            break
        now = moved
    return now


def cluster_vectors(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid): every vector that `quantised` keeps, clustered.

    Rows of equal or null keys are vectors of their own. Fewer than k vectors give as many centroids; none, no row.
    centroid is the final one of the vector's cluster. Other columns of the input don't matter.
    """
    spark = vectors.sparkSession
    rows = stored(quantised(vectors.select(F.col(key), F.col(column)), dim, scale, column=column), "vectors")
    final = fit(rows, first_centroids(rows, k, seed, key), rounds)
    kind = rows.schema[key].dataType.simpleString()
    if not final:
        return spark.createDataFrame([], f"`{key}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    centroids = Centroids.of(final)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance, _ = centroids.nearest(*_arrays(batch, 1, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=[key, "cluster", "distance"])

    assigned = stored(rows.select(key, "whole", "norms").mapInArrow(released(task), f"`{key}` {kind}, cluster int, distance long"), "assigned")
    inertia = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    facts = spark.createDataFrame([(c, inertia.get(c, 0), sum(inertia.values()), values) for c, values in enumerate(final)], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return assigned.join(F.broadcast(facts), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(os.path.join(sf_dir, "embeddings.parquet"))
    digest = F.sha2(F.concat_ws(",", F.transform("centroid", lambda x: x.cast("string"))), 256)
    return cluster_vectors(vectors).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def centroid_digest(values: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, values)).encode()).hexdigest()


def _round_sql(i: int) -> str:
    return f"""
, a{i} AS MATERIALIZED (
  SELECT v.row, any_value(v.q) AS q, min({{'d': list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(v.q, c.q)])::BIGINT, 'k': c.k}}) AS best
  FROM v, c{i} c GROUP BY v.row
), s{i} AS (
  SELECT k, i, sum(x)::BIGINT AS s, count(*) AS n
  FROM (SELECT best.k AS k, generate_subscripts(q, 1) AS i, unnest(q) AS x FROM a{i}) GROUP BY k, i
), c{i + 1} AS MATERIALIZED (
  SELECT c.k, coalesce(m.q, c.q) AS q
  FROM c{i} c LEFT JOIN (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM s{i} GROUP BY k) m USING (k)
)"""


ORACLE_SQL = (
    f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT for x in embedding] AS q
  FROM (SELECT * FROM embeddings WHERE len(embedding) = {DIM} AND len([x for x in embedding if x IS NOT NULL AND isfinite(x::DOUBLE)]) = {DIM})
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS k, q
  FROM (SELECT sha256('{SEED}:' || vec_id) AS h, q FROM v ORDER BY h LIMIT {CENTROIDS})
)"""
    + "".join(map(_round_sql, range(ROUNDS)))
    + f"""
, final AS (
  SELECT v.vec_id, v.row, min({{'d': list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(v.q, c.q)])::BIGINT, 'k': c.k}}) AS best
  FROM v, c{ROUNDS} c GROUP BY v.vec_id, v.row
)
SELECT vec_id, best.k::INTEGER AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.k)::BIGINT AS cluster_inertia,
       sum(best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM final JOIN c{ROUNDS} c ON c.k = best.k
"""
)
