"""Centroid clustering of integer vectors by Exponion search: bounds for each vector, balls around its centroid."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import bounded_batches, cut, fresh_folder, remove_folder, session, table

#: Components, centroids, rounds, the salt of the first centroids, and what a component is multiplied by.
DIM, CENTROIDS, ROUNDS, SALT, SCALE = 64, 40, 5, "2", 256
#: Components of this size or more have no exact distance in 64 bits; such vectors are left out.
LARGEST = 1 << 27
#: Above this, products of matrices are taken in integers, as they may not be exact in doubles.
EXACT = 1 << 22
#: Bounds are widened by this share, so that rounding never passes over a centroid.
SLACK = 1e-9
#: Vectors whose distances are worked out together.
RUN = 8192

_STATE = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int32())), ("cluster", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64())])
_STATE_DDL = "vec_id long, v array<int>, cluster int, upper double, lower double"


@dataclass(frozen=True)
class Centres:
    """Centroids with what the search needs: for each, the others by distance."""

    at: np.ndarray  # k x dim integers
    order: np.ndarray  # k x k: centroids by distance from each, itself first
    near: np.ndarray  # k x k: these distances, rising
    moved: np.ndarray  # how far each has moved since the last round

    @classmethod
    def of(cls, at: np.ndarray, before: np.ndarray | None = None) -> Centres:
        far = np.sqrt(_distances(at, at).astype(np.float64))
        np.fill_diagonal(far, -1.0)  # itself first, also beside equal ones
        order = np.argsort(far, axis=1, kind="stable")
        near = np.maximum(np.take_along_axis(far, order, 1), 0.0)
        gone = np.zeros(len(at)) if before is None else np.sqrt(((at - before) ** 2).sum(axis=1).astype(np.float64))
        return cls(at, order, near, gone)

    @property
    def apart(self) -> np.ndarray:
        """Distance of each to its nearest other."""
        return self.near[:, 1] if self.near.shape[1] > 1 else np.full(len(self.at), np.inf)


def _distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors, as 64-bit integers."""
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) < EXACT:
        f, g = v.astype(np.float64), c.astype(np.float64)
        return ((f * f).sum(axis=1)[:, None] - 2 * (f @ g.T) + (g * g).sum(axis=1)).astype(np.int64)
    return np.stack([((v - x) ** 2).sum(axis=1) for x in c], axis=1)


def _own(v: np.ndarray, c: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    return ((v - c[cluster]) ** 2).sum(axis=1)


def _two_nearest(v: np.ndarray, names: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest of the named centroids (ties: the smallest number), its squared distance and the next one's."""
    names = np.sort(names)
    d = _distances(v, c[names])
    best = d.argmin(axis=1)  # the first of equal ones
    rows = np.arange(len(v))
    least = d[rows, best]
    if len(names) == 1:
        return names[best], least, np.full(len(v), np.iinfo(np.int64).max)
    d[rows, best] = np.iinfo(np.int64).max
    return names[best], least, d.min(axis=1)


def assign(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centres) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """New clusters and bounds, and the number of distances worked out.

    cluster is -1 before the first round. upper bounds the distance to a vector's own centroid, lower that to any other.
    A vector stays, without a look, if upper < max(lower, half its centroid's distance to the nearest other): strictly,
    so that a tie is never passed over. Else upper is made exact; if that doesn't do, the nearest two centroids lie
    within 2 * upper + apart of its own one, this radius included, and only these are looked at.
    """
    cluster, upper, lower = cluster.astype(np.int64), upper.copy(), lower.copy()
    root = lambda x: np.sqrt(x.astype(np.float64))
    if (new := cluster < 0).any():
        name, least, after = _two_nearest(v[new], np.arange(len(c.at)), c.at)
        cluster[new], upper[new], lower[new] = name, root(least) * (1 + SLACK), root(after) * (1 - SLACK)
        return cluster, upper, lower, int(new.sum()) * len(c.at)
    most = np.sort(c.moved)[::-1]
    others = np.where((c.moved == most[0]) & ((c.moved == most[0]).sum() == 1), most[min(1, len(most) - 1)], most[0])
    upper += c.moved[cluster] * (1 + SLACK)
    lower = np.maximum(0.0, lower - others[cluster] * (1 + SLACK))
    safe = np.maximum(lower, c.apart[cluster] * (0.5 * (1 - SLACK)))
    open_ = np.flatnonzero(~(upper < safe))
    upper[open_] = root(_own(v[open_], c.at, cluster[open_])) * (1 + SLACK)
    seen = len(open_)
    open_ = open_[~(upper[open_] < safe[open_])]
    if len(c.at) == 1:
        return cluster, upper, lower, seen
    radius = (2 * upper[open_] + c.apart[cluster[open_]]) * (1 + SLACK)
    # Vectors of one centroid with balls of about as many members go together: up to 2, 4, 8 ... of the sorted list.
    own = cluster[open_]
    within = np.empty(len(open_), np.int64)
    for a in np.unique(own):
        at = own == a
        within[at] = np.searchsorted(c.near[a], radius[at], side="right")
    ring = np.ceil(np.log2(np.maximum(within, 2))).astype(np.int64)
    for key in np.unique(own * 64 + ring):
        a, r = divmod(int(key), 64)
        at = open_[(own == a) & (ring == r)]
        names = c.order[a, : min(1 << r, len(c.at))]
        for k in range(0, len(at), RUN):
            part = at[k : k + RUN]
            name, least, after = _two_nearest(v[part], names, c.at)
            cluster[part], upper[part], lower[part] = name, root(least) * (1 + SLACK), root(after) * (1 - SLACK)
            seen += len(part) * len(names)
    return cluster, upper, lower, seen


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id, v: vectors of dim components, none null or non-finite, as integers floor(scale * x).

    Left out besides: vectors with a component of LARGEST / scale or more in size.
    """
    x = lambda: F.col(vector_col).cast("array<double>")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c * scale) >= LARGEST)
    v = F.transform(x(), lambda c: F.floor(c * scale).cast("int"))
    kept = rows.where(F.col(vector_col).isNotNull() & (F.size(F.col(vector_col)) == dim)).where(~F.exists(x(), bad))
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, salt: str = SALT) -> np.ndarray:
    """The k vectors with the smallest sha256 of salt:vec_id, in order of it (rows that repeat an id: by components)."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64).reshape(len(rows), len(rows[0]["v"]) if rows else 0)


def _step(shared):
    def run(batches):
        c = shared.value
        for b in batches:
            if not len(b):
                continue
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(b), -1)
            old = (b.column(k).to_numpy(zero_copy_only=False) for k in ("cluster", "upper", "lower"))
            cluster, upper, lower, _ = assign(v, *old, c)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower)], schema=_STATE)

    return run


def _sums(state: DataFrame, k: int) -> tuple[np.ndarray, list[list[int]]]:
    """Members and exact component sums of each centroid: sums of a task first, then over tasks; k * dim numbers come back."""
    schema = pa.schema([("cluster", pa.int32()), ("j", pa.int32()), ("s", pa.int64())])

    def run(batches):
        total = None
        for b in batches:
            if not len(b):
                continue
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(b), -1)
            if total is None:
                total = np.zeros((k, v.shape[1] + 1), np.int64)
            cluster = b.column("cluster").to_numpy(zero_copy_only=False)
            for a in np.unique(cluster):
                total[a, 1:] += v[cluster == a].sum(axis=0)
            total[:, 0] += np.bincount(cluster, minlength=k)
        if total is not None:
            a, j = np.nonzero(total)
            yield table({"cluster": a, "j": j, "s": total[a, j]}, schema)

    parts = state.mapInArrow(run, "cluster int, j int, s long").groupBy("cluster", "j").agg(F.sum(F.col("s").cast("decimal(28,0)")).alias("s"))
    rows = parts.collect()
    dim = max((r["j"] for r in rows), default=0)
    count, sums = np.zeros(k, np.int64), [[0] * dim for _ in range(k)]
    for r in rows:
        if r["j"]:
            sums[r["cluster"]][r["j"] - 1] = int(r["s"])
        else:
            count[r["cluster"]] = int(r["s"])
    return count, sums


def cluster_vectors(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, salt: str = SALT) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v, cluster, upper, lower) of the last assignment, and the centroids it is to. vectors: vec_id, v.

    Each round writes the vectors with their clusters and bounds to the shared folder, where the next one reads them;
    the folder before is deleted then. The driver has the centroids, k * dim numbers, and nothing that grows with rows.
    A component that no vector of a cluster has a sum for is zero; an empty centroid stays where it is.
    """
    spark = session(vectors)
    bounded_batches(spark, 4096)
    state = vectors.select("vec_id", "v", F.lit(-1).alias("cluster"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"))
    folder = fresh_folder(spark, "vectors")
    state.write.parquet(folder)
    state = spark.read.schema(_STATE_DDL).parquet(folder)
    at = first_centroids(state, k, salt)
    before = None
    if not len(at):
        return state, at
    for step in range(rounds + 1):
        shared = spark.sparkContext.broadcast(Centres.of(at, before))
        after = fresh_folder(spark, "vectors")
        state.mapInArrow(_step(shared), _STATE_DDL).write.parquet(after)
        remove_folder(spark, folder)
        state, folder = spark.read.schema(_STATE_DDL).parquet(after), after
        if step < rounds:
            count, sums = _sums(state, len(at))
            before, at = at, np.array([[s // int(n) for s in row] if n else old.tolist() for n, row, old in zip(count, sums, at, strict=True)], dtype=np.int64)
    return state, at


def _distance(v: Column, c: Column) -> Column:
    return F.aggregate(F.zip_with(v, c, lambda a, b: (a.cast("long") - b) * (a.cast("long") - b)), F.lit(0).cast("long"), lambda s, x: s + x)


def cluster_report(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, salt: str = SALT, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, of another length, with null or non-finite components, or with components of LARGEST / scale
    or more, are left out. A null id is kept, and repeated ids are vectors of their own. With fewer vectors than
    centroids, each is a centroid; an empty table gives no rows. Ties go to the smaller number.
    """
    spark = session(rows)
    state, at = cluster_vectors(whole_vectors(rows, id_col, vector_col, dim, scale), k, rounds, salt)
    named = [(i, c.tolist(), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(at)]
    centres = spark.createDataFrame(named, "cluster int, c array<long>, centroid_sha256 string")
    # k rows, whatever the size of the table.
    each = cut(state.join(F.broadcast(centres), "cluster").select("vec_id", "cluster", _distance(F.col("v"), F.col("c")).alias("distance"), "centroid_sha256"))
    per = each.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = each.agg(F.coalesce(F.sum("distance"), F.lit(0).cast("long"))).first()[0]
    out = each.join(F.broadcast(per), "cluster")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid_sha256")


def cluster_sql(k: int = CENTROIDS, rounds: int = ROUNDS, salt: str = SALT, dim: int = DIM, scale: int = SCALE) -> str:
    """The same rows in SQL, over embeddings: every distance, in every round."""

    def nearest(c: str) -> str:
        return f"""SELECT rid, num, d FROM (SELECT rid, num, sum((v.x - {c}.x) * (v.x - {c}.x)) AS d FROM v JOIN {c} USING (j) GROUP BY rid, num) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, num) = 1"""

    steps = []
    for r in range(rounds):
        steps += [
            f"a{r} AS MATERIALIZED ({nearest(f'c{r}')})",
            f"m{r} AS (SELECT num, j, floor_div(sum(x)::HUGEINT, count(*)) AS x FROM v JOIN a{r} USING (rid) GROUP BY num, j)".replace("floor_div(sum(x)::HUGEINT, count(*))", "((sum(x)::HUGEINT - ((sum(x)::HUGEINT % count(*)) + count(*)) % count(*)) // count(*))::BIGINT"),
            f"c{r + 1} AS MATERIALIZED (SELECT num, j, coalesce(m{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN m{r} USING (num, j))",
        ]
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, embedding AS e FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x : x IS NOT NULL AND isfinite(x) AND abs({scale} * CAST(x AS DOUBLE)) < {LARGEST})) = {dim}),
    v AS MATERIALIZED (SELECT rid, unnest(range(1, {dim + 1})) AS j, floor({scale} * CAST(unnest(e) AS DOUBLE))::BIGINT AS x FROM kept),
    s AS (SELECT rid, row_number() OVER (ORDER BY sha256('{salt}:' || coalesce(vec_id::VARCHAR, ''))) - 1 AS num FROM kept QUALIFY num < {k}),
    c0 AS MATERIALIZED (SELECT num, j, x FROM s JOIN v USING (rid)), {", ".join(steps)},
    z AS (SELECT rid, num, d FROM ({nearest(f"c{rounds}")})),
    h AS (SELECT num, sha256(string_agg(x::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY num)
    SELECT vec_id, num::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY num))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM z JOIN kept USING (rid) JOIN h USING (num)"""
