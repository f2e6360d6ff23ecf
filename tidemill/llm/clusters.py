"""Centroid clustering of vectors in whole numbers, by delta Lloyd rounds.

The vectors are written once, bucketed by a row key; assignments (key, cluster, distance) are written anew each round, bucketed
alike, so that joining the two moves no vector. The sums and sizes of all clusters are kept from round to round. A round compares a
vector whose own centroid stayed with the centroids that changed only, since all others are where they lost before; a vector whose
own centroid changed is compared with all. Each task adds up signed transfers, what each cluster gained and lost, which are written
beside its assignments and summed by Spark: at most a row for each cluster and block of components reaches the driver. When a round changes no
centroid, later ones would change nothing and are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import product
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.runtime import cut, lean, ship, tasks
from tidemill.session import dropped, shared_folder

K, ROUNDS, DIMS, SEED, UNIT = 8, 10, 64, 3, 1024
BUCKET_ROWS = 250_000
NARROW = 1 << 27  # below this, squared distances of 64 components fit 64 bits
LIMB = 40
MOST = (1 << 63) - 1
BLOCK = 64
STATE = "key long, cluster int, distance long, n long, limb int, block int, sums array<long>"


def whole(x: np.ndarray) -> np.ndarray:
    """floor(UNIT * x) of each component: as 64-bit numbers where all are small, else as Python's."""
    y = np.floor(x * UNIT) if not len(x) or np.abs(x).max() < NARROW / UNIT else None
    if y is not None:
        return y.astype(np.int64)
    out = np.empty(x.shape, object)
    out.flat = [math.floor(v * UNIT) if abs(v) < 2.0**60 else int(v) * UNIT for v in x.reshape(-1).tolist()]
    return out


def squared(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    diff = x - centroid
    return (diff * diff).sum(axis=1)


def assigned(x: np.ndarray, cluster: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroids (the first of equals) and squared distances. cluster, distance: those of before (cluster -1: none)."""
    cluster, distance = cluster.copy(), distance.astype(x.dtype)
    anew = (cluster < 0) | changed[cluster] | (distance == MOST)
    cluster[anew], distance[anew] = 0, squared(x[anew], centroids[0])
    for c, centroid in enumerate(centroids):
        rows = np.arange(len(x)) if changed[c] else np.flatnonzero(anew)
        d = squared(x[rows], centroid)
        nearer = np.asarray((d < distance[rows]) | ((d == distance[rows]) & (c < cluster[rows])), bool)
        cluster[rows[nearer]], distance[rows[nearer]] = c, d[nearer]
    return cluster, distance


def limbs(value: int) -> list[int]:
    """A whole number as signed digits of LIMB bits, the lowest first."""
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    while value or not out:
        out.append(sign * (value & ((1 << LIMB) - 1)))
        value >>= LIMB
    return out


def round_of(joined: DataFrame, centroids: list[list[int]], changed: list[bool]) -> DataFrame:
    """STATE rows: assignments (n null) of the rows of joined (key, vector, cluster, distance), and transfers (n, limb, block, sums)."""
    spark = joined.sparkSession
    sent = spark.sparkContext.broadcast((centroids, changed))
    schema = T.StructType.fromDDL(STATE)
    names = schema.fieldNames()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, which = sent.value[0], np.array(sent.value[1])
        wide = np.array(held, object)
        narrow = wide.astype(np.int64) if max(abs(v) for c in held for v in c) < NARROW else None
        sums, counts, key = np.zeros(wide.shape, object), [0] * len(held), None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = whole(batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1))
            c = narrow
            if x.dtype == object or narrow is None:
                x, c = x.astype(object), wide
            before = batch.column("cluster").to_numpy().astype(np.int64)
            now, distance = assigned(x, before, batch.column("distance").to_numpy(), c, which)
            moved = now != before
            for j in np.unique(np.concatenate([now[moved], before[moved]])):
                if j >= 0:
                    plus, minus = moved & (now == j), moved & (before == j)
                    sums[j] += x[plus].sum(axis=0).astype(object) - x[minus].sum(axis=0).astype(object)
                    counts[j] += int(plus.sum()) - int(minus.sum())
            key, n = batch.column("key")[0].as_py(), len(batch)
            distance = np.minimum(distance, MOST).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(now, pa.int32()), pa.array(distance), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64()))], names=names)
        rows = []
        for j in range(len(held)):
            digits = [limbs(int(v)) for v in sums[j]]
            if counts[j] or any(v for d in digits for v in d):
                for limb, block in product(range(max(map(len, digits))), range(0, len(digits), BLOCK)):
                    own = [d[limb] if limb < len(d) else 0 for d in digits[block : block + BLOCK]]
                    rows.append((key, j, None, 0 if limb or block else counts[j], limb, block, own))
        if rows:  # under a key of this task, so in its own bucket
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*rows), kinds)], names=names)

    return joined.select("key", "vector", "cluster", "distance").mapInArrow(lean(work), schema)


class Tables:
    """Bucketed tables in the shared folder, which go when they are replaced."""

    def __init__(self, df: DataFrame, buckets: int):
        self.spark, self.buckets, self.run = df.sparkSession, buckets, uuid4().hex
        self.folder, self.made = f"{shared_folder(self.spark)}/lloyd-{self.run}", {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        table = f"tidemill_{name}_{self.run}"
        df.write.bucketBy(self.buckets, "key").sortBy("key").format("parquet").option("path", f"{self.folder}/{name}").saveAsTable(table)
        self.made[name] = table
        return self.spark.table(table)

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {self.made.pop(name)}")
        dropped(self.spark, f"{self.folder}/{name}")

    def close(self) -> None:
        for name in list(self.made):
            self.drop(name)
        dropped(self.spark, self.folder)


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: a row for each vector of `dims` components, none null or non-finite.

    Vectors are taken as whole numbers floor(1024 * x). Centroids start as the k vectors with the smallest sha256 of "seed:vec_id"
    (fewer vectors: as many centroids); repeated rows are vectors each; those without vec_id are clustered, but no centroid starts from
    them, and if none has an id there are no rows; vectors of any size are compared exactly, and distances and inertias beyond a long
    are given as the greatest long; other vectors have no row; an empty table gives no rows; other columns are ignored. It makes
    tables of its own in the session's catalog, with files in the shared folder, and drops them."""
    spark = vectors.sparkSession
    ship(spark)
    kind = "float" if vectors.schema["embedding"].dataType.elementType.typeName() in ("float", "byte", "short") else "double"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = v.where(F.coalesce((F.size("vector") == dims) & sound, F.lit(False)))
    start = kept.where("vec_id IS NOT NULL").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)).orderBy("h", "vector").limit(k).collect()
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not start:
        return spark.createDataFrame([], out)
    centroids = [[int(x) for x in row] for row in whole(np.array([r["vector"] for r in start], np.float64))]
    buckets = max(1, min(tasks(vectors), 4096), math.ceil(kept.count() / BUCKET_ROWS))
    tables = Tables(vectors, buckets)
    held = tables.write(kept.withColumn("key", F.monotonically_increasing_id()).repartition(buckets, "key"), "vectors")
    state, sums, sizes, changed = None, [[0] * dims for _ in centroids], [0] * len(centroids), [True] * len(centroids)
    for r in range(rounds + 1):
        if state is None:
            joined = held.withColumn("cluster", F.lit(-1)).withColumn("distance", F.lit(0).cast("long"))
        else:
            joined = held.join(state.where("n IS NULL").select("key", "cluster", "distance").hint("merge"), "key")
        state = tables.write(round_of(joined, centroids, changed), f"round{r}")
        if r:
            tables.drop(f"round{r - 1}")
        if r == rounds:
            break
        parts = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"x{i}") for i in range(min(BLOCK, dims))]
        for m in state.where("n IS NOT NULL").groupBy("cluster", "limb", "block").agg(F.sum("n").alias("n"), *parts).collect():  # a row for each cluster and block of components
            sizes[m["cluster"]] += m["n"]
            for i in range(min(BLOCK, dims - m["block"])):
                sums[m["cluster"]][m["block"] + i] += int(m[f"x{i}"]) << (LIMB * m["limb"])
        new = [[s // n for s in own] if n else old for own, n, old in zip(sums, sizes, centroids)]
        changed = [a != b for a, b in zip(centroids, new)]
        centroids = new
        if not any(changed):
            break
    named = state.where("n IS NULL").select("key", "cluster", "distance")
    totals = named.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()  # k rows
    most = lambda x: min(int(x), MOST)
    inertia = most(sum(t["d"] for t in totals))
    rows = [(t["cluster"], most(t["d"]), inertia, hashlib.sha256(",".join(map(str, centroids[t["cluster"]])).encode()).hexdigest()) for t in totals]
    info = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    found = held.select("key", "vec_id").join(named.hint("merge"), "key").join(F.broadcast(info), "cluster")
    result = cut(found.select(*T.StructType.fromDDL(out).fieldNames()))
    tables.close()
    return result


def oracle(k: int = K, rounds: int = ROUNDS, dims: int = DIMS, seed: int = SEED) -> str:
    """Lloyd's rounds in full, one after the other."""
    sql = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda y: CAST(floor(1024 * CAST(y AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = {dims})",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) AS INTEGER) - 1 AS cluster, x AS c FROM v QUALIFY cluster < {k})",
    ]
    for r in range(rounds + 1):
        sql.append(f"d{r} AS (SELECT vec_id, x, cluster, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS distance FROM v, c{r})")
        sql.append(f"a{r} AS MATERIALIZED (SELECT * FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)")
        if r < rounds:
            sql.append(f"s{r} AS (SELECT cluster, list(m ORDER BY i) AS c FROM (SELECT cluster, i, CAST(sum(x[i]) AS HUGEINT) AS s, count(*) AS n, CAST(CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END AS BIGINT) AS m FROM a{r}, range(1, {dims} + 1) t(i) GROUP BY cluster, i) GROUP BY cluster)")
            sql.append(f"c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(s{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN s{r} USING (cluster))")
    last = f"SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (cluster)"
    return "WITH " + ",\n".join(sql) + "\n" + last
