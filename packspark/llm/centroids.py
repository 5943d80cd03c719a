"""Centroid clustering of embeddings over integers, with scalar lookup tables.

Each component x becomes floor(scale * x).  The first centroids are the vectors with the smallest hashes of
their ids.  In every round a task tabulates, for each dimension, the squared differences between the
integer values that occur there and the centroids; distances are then gathers from these tables and
sums.  Tasks hand on sums and counts per (centroid, dimension) only; they are added up by Spark, and
rounds end with exact floors of the means.  All arithmetic is on integers, so results don't depend on the
partitioning.

Defined results: vectors of another size, and those that are null or hold a null, NaN or infinity are left
out; components beyond +-2^27 after scaling count as that bound (distances stay exact in 64 bits); with
fewer vectors than centroids there are as many centroids as vectors; rows without an id sort last for the
first centroids, and equal hashes go by the vector; repeated rows are clustered each; a sum over a cluster
that 64 bits can't hold is null; an empty table gives an empty result; columns named like a result are replaced,
others kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packspark.llm.common import materialise

LIMIT = 1 << 27
ADDED = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
_Q = "_cc_q"


def integers(df: DataFrame, vector: str, dims: int, scale: int) -> DataFrame:
    """Rows whose vector is whole, with its integer components in ``_cc_q`` in place of the vector."""
    v = F.col(f"`{vector}`")
    whole = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = F.transform(v, lambda x: F.floor(F.least(F.greatest(scale * x.cast("double"), F.lit(-float(LIMIT))),
                                                    F.lit(float(LIMIT)))).cast("int"))
    keep = [F.col(f"`{c}`") for c in df.columns if c not in (*ADDED, vector, _Q)]
    return df.where(whole).select(*keep, held.alias(_Q))


def first_centroids(rows: DataFrame, vec_id: str, clusters: int, seed: int) -> np.ndarray:
    """The vectors with the ``clusters`` smallest hashes of ``seed:id``, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(f"`{vec_id}`").cast("string")), 256)
    top = rows.select(key.alias("h"), _Q).orderBy(F.col("h").asc_nulls_last(), _Q).limit(clusters).collect()
    return np.array([r[_Q] for r in top], np.int64)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances (row, centroid): a table a dimension, gathered and summed."""
    out = np.zeros((len(x), len(centroids)), np.int64)
    for d in range(x.shape[1]):
        values, at = np.unique(x[:, d], return_inverse=True)
        table = (values.astype(np.int64)[:, None] - centroids[None, :, d]) ** 2
        out += table[at]
    return out


def _sums(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Component sums (exact) and, in the last column, counts of the nearest centroid's vectors."""
    k, dims = centroids.shape
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            x = matrix(batch.column(0), dims)
            nearest = distances(x, shared.value).argmin(axis=1)      # ties: the smaller number
            for c in np.unique(nearest):
                own = x[nearest == c]
                total[c, :dims] += own.sum(axis=0, dtype=np.int64)
                total[c, dims] += len(own)
        at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()),
                                          pa.array(total[at], pa.int64())], ["c", "d", "s"])

    out = np.zeros((k, dims + 1), object)
    for r in rows.select(_Q).mapInArrow(run, "c int, d int, s bigint").groupBy("c", "d") \
            .agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():      # k * (dims + 1) rows at most
        out[r["c"], r["d"]] = int(r["s"])
    return out


def fit_centroids(rows: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """Each round moves every centroid that has vectors to the floor of their mean."""
    for _ in range(rounds if len(centroids) else 0):
        sums = _sums(rows, centroids)
        centroids = np.array([[s // own[-1] for s in own[:-1]] if own[-1] else list(old)
                              for own, old in zip(sums, centroids)], np.int64)
    return centroids


def assign(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds ``cluster`` and ``distance``; the integer vector goes."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)
    keep = [c for c in rows.columns if c != _Q]
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("cluster", T.IntegerType()),
                           T.StructField("distance", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = distances(matrix(batch.column(_Q), shared.value.shape[1]), shared.value)
            nearest = far.argmin(axis=1)
            least = far[np.arange(len(far)), nearest]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(nearest, pa.int32()),
                                              pa.array(least, pa.int64())], [*keep, "cluster", "distance"])

    return rows.mapInArrow(run, schema)


def centroid_text(centroid: np.ndarray) -> str:
    return ",".join(str(int(v)) for v in centroid)


def cluster(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = 64,
            clusters: int = 16, rounds: int = 3, seed: int = 1) -> DataFrame:
    """One row per whole vector with ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid_sha256``.

    Only centroids and sums of k * dims numbers reach the driver.  The integer vectors and the last assignment
    are written once, as every round and the totals read them."""
    rows = materialise(integers(df, vector, dims, scale), "integer-vectors")
    centroids = fit_centroids(rows, first_centroids(rows, vec_id, clusters, seed).reshape(-1, dims), rounds)
    if not len(centroids):
        empty = ("int", "bigint", "bigint", "bigint", "string")
        return rows.drop(_Q).select("*", *[F.lit(None).cast(t).alias(c) for c, t in zip(ADDED, empty)])
    done = materialise(assign(rows, centroids), "assigned-vectors")
    sums = {r["cluster"]: int(r["s"]) for r in done.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}

    def fits(s: int) -> Column:
        return F.lit(s if s < 1 << 63 else None).cast("bigint")

    digest = [hashlib.sha256(centroid_text(c).encode()).hexdigest() for c in centroids]
    per_cluster = F.create_map(*[x for c, s in sums.items() for x in (F.lit(c), fits(s))]) if sums else F.lit(None)
    digests = F.create_map(*[x for c, d in enumerate(digest) for x in (F.lit(c), F.lit(d))])
    return done.select("*", F.element_at(per_cluster, F.col("cluster")).alias("cluster_inertia"),
                       fits(sum(sums.values())).alias("inertia"),
                       F.element_at(digests, F.col("cluster")).alias("centroid_sha256"))


def clustering_sql(dims: int = 64, scale: int = 64, clusters: int = 16, rounds: int = 3, seed: int = 1) -> str:
    """The same over ``embeddings`` in DuckDB: components as rows, one step a round."""
    steps = [f"""kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), x AS MATERIALIZED (
  SELECT vec_id, d, CAST(q[d] AS BIGINT) AS v FROM kept, range(1, {dims + 1}) AS r(d)
), first AS (
  SELECT q, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c FROM kept
  QUALIFY row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) <= {clusters}
), c0 AS MATERIALIZED (
  SELECT c, d, CAST(q[d] AS BIGINT) AS m FROM first, range(1, {dims + 1}) AS r(d)
)"""]
    for k in range(rounds + 1):
        steps.append(f"""far{k} AS (
  SELECT vec_id, c, sum((v - m) * (v - m)) AS distance FROM x JOIN c{k} USING (d) GROUP BY vec_id, c
), near{k} AS MATERIALIZED (
  SELECT vec_id, c, distance FROM far{k} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, c) = 1
)""")
        if k < rounds:
            steps.append(f"""mean{k} AS (
  SELECT c, d, sum(v) AS s, count(*) AS n FROM near{k} JOIN x USING (vec_id) GROUP BY c, d
), c{k + 1} AS MATERIALIZED (
  SELECT c, d, coalesce((s - ((s % n) + n) % n) // n, m) AS m FROM c{k} LEFT JOIN mean{k} USING (c, d)
)""")
    return f"""WITH {', '.join(steps)}, names AS (
  SELECT c, sha256(string_agg(CAST(CAST(m AS BIGINT) AS VARCHAR), ',' ORDER BY d)) AS h FROM c{rounds} GROUP BY c
)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
  CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM near{rounds} JOIN names USING (c)"""
