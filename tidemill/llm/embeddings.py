"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors of cosine c are at squared distance 2 - 2c, and a rotation keeps that. Cut into B blocks of coordinates, a pair within
squared distance e has a block in which it is within e / B. So each block is range-joined under that budget: its first GRID coordinates
are cut into cells of twice the budget's radius, a vector stands in its own cell as a host and, of the neighbouring cells it comes near
to, in those before its own as a guest, so that a pair meets in one cell. There sets of vectors are halved along their widest coordinate, all of the block's
in turn, and of two sets go on only the vectors within budget of the other's bounding box; what is left is compared, first in the block, then
exactly, in double precision. A pair counts in the first of its blocks that is within budget, so the union needs no pairs sent anywhere: a cell gives
for each vector the number of its links and a parent in a forest of them. The rotation is a Walsh-Hadamard transform after random
signs: it works element by element, so that every cell sees the same coordinates of a vector.

Equal vectors are one, with a multiplicity. A cell of more than CELL vectors is dealt out as a square of tasks. For isotropic
vectors of many dimensions the budget's radius is near the coordinates' spread, so that one cut leaves out little; only many cuts one after another do, as
many as there are vectors for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.components import components
from tidemill.llm.runtime import cut
from tidemill.llm.simhash import _forest

THRESHOLD, WIDTH, GRID, CELL = 0.95, 16, 2, 200_000
LEAF, STRIP = 1 << 22, 1024  # pairs of two sets that are compared without further cuts, and rows compared at once
ROWS, PAIRS = 8192, 50_000  # rows rotated, and pairs checked exactly, at once
ROUNDING = 1e-6


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows by a power of two each, which is exact, so that their squares stay in range."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])


def rotated(x: np.ndarray, seed: int = 3) -> np.ndarray:
    """Rows (as `scaled` gives them) of unit length, zero-filled to a power of two of coordinates, after random signs and a Walsh-Hadamard transform."""
    n, d = x.shape
    size = 1 << max(0, (d - 1).bit_length())
    y = np.zeros((n, size))
    y[:, :d] = x / np.sqrt(np.add.accumulate(x * x, axis=1)[:, -1:])
    y *= np.where(np.random.default_rng(seed).random(size) < 0.5, -1.0, 1.0)
    h = 1
    while h < size:
        v = y.reshape(n, size // (2 * h), 2, h)
        y = np.stack([v[:, :, 0] + v[:, :, 1], v[:, :, 0] - v[:, :, 1]], axis=2).reshape(n, size)
        h *= 2
    return y / math.sqrt(size)


def blocks(size: int) -> list[slice]:
    return [slice(i, min(i + WIDTH, size)) for i in range(0, size, WIDTH)]


def cells(y: np.ndarray, block: slice, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Rows of y, the cells they stand in, and whether as hosts; guests come to cells before their own only. A cell is a number of two signed 31-bit coordinates."""
    g = y[:, block][:, :GRID] / (2 * radius)
    own, near = np.floor(g).astype(np.int64), g - np.floor(g)
    for shift in product((-1, 0, 1), repeat=g.shape[1]):
        if shift > (0,) * len(shift):
            break
        far = np.zeros(len(y))
        for k, s in enumerate(shift):
            if s:
                far += (near[:, k] if s < 0 else 1 - near[:, k]) ** 2
        at = far <= (0.5 + ROUNDING) ** 2
        rows = np.flatnonzero(at)
        cell = np.zeros(len(rows), np.int64)
        for k, s in enumerate(shift):
            cell = cell * (1 << 20) + own[rows, k] + s + (1 << 19)
        yield rows, cell, not any(shift)


def beside(x: np.ndarray, y: np.ndarray, budget: float) -> np.ndarray:
    """Columns of x within budget of the box around y's."""
    d = np.maximum(y.min(axis=1, keepdims=True) - x, x - y.max(axis=1, keepdims=True))
    np.maximum(d, 0, out=d)
    d *= d
    return np.flatnonzero(d.sum(axis=0) <= budget)


def near(u: np.ndarray, v: np.ndarray | None, budget: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of columns of u and v (None: of u twice, the lesser place first) whose squared distance is within budget, each pair once."""
    todo = [(u, np.arange(u.shape[1]), v, None if v is None else np.arange(v.shape[1]))]
    while todo:
        x, i, y, j = todo.pop()
        if y is not None:
            if not len(i) or not len(j):
                continue
            if len(at := beside(x, y, budget)) < len(i):
                x, i = x[:, at], i[at]
            if not len(i):
                continue
            if len(at := beside(y, x, budget)) < len(j):
                y, j = y[:, at], j[at]
        if len(i) * len(i if y is None else j) > LEAF:
            larger = y is not None and len(j) > len(i)  # of two sets the larger is cut
            z, k = (y, j) if larger else (x, i)
            wide = z.max(axis=1) - z.min(axis=1)
            c = z[wide.argmax()]
            middle = np.partition(c, len(c) // 2)[len(c) // 2]
            low = c < middle if c.min() < middle else c <= middle
            if wide.max() ** 2 > budget and not low.all():  # a cut in a narrower set would leave nothing out
                a, b = ((z[:, at], k[at]) for at in (np.flatnonzero(low), np.flatnonzero(~low)))
                if y is None:
                    todo += [(*a, None, None), (*b, None, None), (*a, *b)]
                elif larger:
                    todo += [(x, i, *a), (x, i, *b)]
                else:
                    todo += [(*a, y, j), (*b, y, j)]
                continue
        same = y is None
        y, j = (x, i) if same else (y, j)
        rows, xx, yy = np.ascontiguousarray(x.T), ((x * x).sum(axis=0) - budget) / 2, (y * y).sum(axis=0) / 2
        for s in range(0, len(i), STRIP):
            for t in range(s if same else 0, len(j), STRIP):
                g = rows[s : s + STRIP] @ y[:, t : t + STRIP]
                g -= yy[t : t + STRIP]
                p, q = np.divmod(np.flatnonzero(g >= xx[s : s + STRIP, None]), g.shape[1])
                p, q = i[p + s], j[q + t]
                if same:
                    p, q = p[p < q], q[p < q]
                if len(p):
                    yield p, q


def gathered(pairs: Iterator[tuple[np.ndarray, np.ndarray]], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs, `most` at a time."""
    left, right, n = [], [], 0
    for i, j in pairs:
        for at in range(0, len(i), most):
            left.append(i[at : at + most]), right.append(j[at : at + most])
            n += len(left[-1])
            if n >= most:
                yield np.concatenate(left), np.concatenate(right)
                left, right, n = [], [], 0
    if n:
        yield np.concatenate(left), np.concatenate(right)


def linked(x: np.ndarray, hosts: int, own: bool, block: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked rows of x, each pair once: the first `hosts` with the rows after them and, if `own`, with one another, for pairs whose
    first block within budget is `block`. Beside x only the block is held, in single precision; rows of pairs that are near there are taken in doubles."""
    parts = blocks(1 << max(0, (x.shape[1] - 1).bit_length()))
    budget = (2 - 2 * least + ROUNDING) / len(parts)
    u = np.empty((parts[block].stop - parts[block].start, len(x)), np.float32)
    for at in range(0, len(x), ROWS):
        u[:, at : at + ROWS] = rotated(scaled(x[at : at + ROWS].astype(np.float64)))[:, parts[block]].T
    within = budget + 10 * ROUNDING
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in gathered(chain(near(u[:, :hosts], None, within) if own else (), ((i, j + hosts) for i, j in near(u[:, :hosts], u[:, hosts:], within))), PAIRS):
        rows, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        v = scaled(x[rows].astype(np.float64))
        a, p, q = rotated(v), at[: len(i)], at[len(i) :]
        square = (a[p] - a[q]) ** 2
        dist = np.stack([np.add.accumulate(square[:, k], axis=1)[:, -1] for k in parts], axis=1)
        good = (dist[:, block] <= budget) & ((dist <= budget).argmax(1) == block)
        i, j, p, q = i[good], j[good], v[p[good]], v[q[good]]
        cosine = (p * q).sum(1) / np.sqrt((p * p).sum(1) * (q * q).sum(1))
        left.append(i[cosine >= least])
        right.append(j[cosine >= least])
    return np.concatenate(left), np.concatenate(right)


def vector_links(classes: DataFrame, least: float = THRESHOLD) -> DataFrame:
    """id, links, root: partial counts of vectors linked to id, and a tie of id to root (long), each to be gathered over rows. classes: id, m (how many it stands for), vector, all finite and none zero."""

    kind = np.float32 if classes.schema["vector"].dataType.elementType.typeName() == "float" else np.float64  # what the vectors are

    def places(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool, np.ndarray]]:
        col = batch.column("vector")
        dims = np.asarray(col.value_lengths())
        for d in np.unique(dims):
            rows = np.flatnonzero(dims == d)
            x = np.array(col.take(pa.array(rows)).flatten(), np.float64).reshape(len(rows), d)
            y = rotated(scaled(x))
            parts = blocks(y.shape[1])
            radius = math.sqrt((2 - 2 * least + ROUNDING) / len(parts))
            for b, block in enumerate(parts):
                for at, cell, host in cells(y, block, radius):
                    yield int(d), b, rows[at], cell, host, x[at]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, b, _, cell, _, _ in places(batch) if batch.num_rows else ():
                c, n = np.unique(cell, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(c), pa.int64()), pa.array([b] * len(c), pa.int64()), pa.array(c), pa.array(n)], names=["d", "b", "cell", "n"])

    large = classes.select("id", "m", "vector").mapInArrow(count, "d long, b long, cell long, n long").groupBy("d", "b", "cell").agg(F.sum("n").alias("n")).where(F.col("n") > CELL).collect()
    sides = {(r["d"], r["b"], r["cell"]): math.ceil(r["n"] / CELL) for r in large}  # at most one for CELL placed vectors

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, m = batch.column("id").to_numpy(), batch.column("m").to_numpy()
            out: dict[str, list] = {k: [] for k in ("d", "b", "cell", "side", "host", "ids", "ms", "vectors")}
            for d, b, rows, cell, host, x in places(batch):
                order = np.argsort(cell, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
                    if not len(part):
                        continue
                    k = int(cell[part[0]])
                    side = sides.get((d, b, k), 1)
                    spot = (ids[rows[part]] % side).astype(np.int64)
                    for s in range(side):
                        own = part[spot == s]
                        # hosts of strip s meet those of later strips, and all guests: (s, 0..side-1); as others they stand in (0..s-1, s), guests in (0..side-1, s)
                        for t in range(side) if len(own) else ():
                            for role, where in ((1, s * side + t), *([(0, t * side + s)] if t < s else [])) if host else ((0, t * side + s),):
                                out["d"].append(d), out["b"].append(b), out["cell"].append(k), out["side"].append(where), out["host"].append(role)
                                out["ids"].append(ids[rows[own]].tobytes()), out["ms"].append(m[rows[own]].tobytes()), out["vectors"].append(x[own].astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([*(pa.array(out[k], pa.int64()) for k in ("d", "b", "cell", "side", "host")), *(pa.array(out[k], pa.binary()) for k in ("ids", "ms", "vectors"))], names=list(out))

    def meet(key: tuple, held: pa.Table) -> pa.Table:
        d, b, cell, where = (k.as_py() for k in key)
        strips = sides.get((d, b, cell), 1)
        role = held.column("host").to_numpy()
        order = np.argsort(1 - role, kind="stable")  # hosts first

        def column(name: str, of: type) -> np.ndarray:
            pieces = held.column(name).to_pylist()
            return np.frombuffer(b"".join(pieces[k] for k in order), of)

        ids, m, x = column("ids", np.int64), column("ms", np.int64), column("vectors", kind).reshape(-1, d)
        hosts = pc.sum(pc.binary_length(held.column("ids").filter(pc.equal(held.column("host"), 1)))).as_py() or 0
        left, right = linked(x, hosts // 8, where // strips == where % strips, b, least)
        node, at = np.unique(np.concatenate([ids[left], ids[right]]), return_inverse=True)
        one, other = at[: len(left)], at[len(left) :]
        links = np.bincount(one, m[right], len(node)) + np.bincount(other, m[left], len(node))
        return pa.table({"id": node, "links": links.astype(np.int64), "root": node[_forest(len(node), one, other)]})

    sent = classes.select("id", "m", "vector").mapInArrow(spread, "d long, b long, cell long, side long, host long, ids binary, ms binary, vectors binary")
    return sent.groupBy("d", "b", "cell", "side").applyInArrow(meet, "id long, links long, root long")


def near_vectors(vectors: DataFrame, least: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row per vector.

    Null and zero vectors, and those with null or non-finite components, link with nothing, and so do those without vec_id; vectors link
    only with those of as many components; equal vectors, and repeated rows, are compared once and count each; different vectors that
    share a vec_id are vectors of their own, and one links with the other; vectors are compared in the precision they have, cosines
    worked out in doubles; an empty table gives no rows; other columns are ignored."""
    fine = vectors.schema["embedding"].dataType.elementType.typeName() not in ("float", "byte", "short")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>" if fine else "array<float>").alias("vector"))
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.coalesce(F.forall("vector", sound) & F.exists("vector", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    good = v.where(usable)
    same = good.groupBy("vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("m"))
    classes = cut(same.withColumn("id", F.monotonically_increasing_id()))
    found = cut(vector_links(classes, least))
    tied = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "own")
    named = classes.join(counts, F.col("id") == F.col("own"), "left").join(tied, F.col("id") == F.col("node"), "left")
    named = cut(named.select("vector", "least", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "id").alias("root")))
    first = named.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "top")
    # a key of its own, so that adaptive execution can split a component with very many vectors
    labels = named.join(first, F.shiftleft("root", 0) == F.col("top")).select(F.col("vector").alias("same"), "n_links", "component_id")
    out = good.join(labels, F.col("vector") == F.col("same")).select("vec_id", "n_links", "component_id")
    rest = v.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
