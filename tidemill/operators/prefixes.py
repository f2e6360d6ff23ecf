"""Prefixes that token sequences share, as a forest, from sorted neighbours.

In sorted order a sequence shares its longest prefix with a neighbour, and prefixes at which sequences part are exactly the common prefixes
of neighbours. So sequences are dealt into ranges, sorted and compared with the one before, the first of a range with the last of the
range before. The common prefixes found, put among the sequences and sorted again, find their parents in the same way: what one has in
common with the row before it is the longest prefix that stands above it. No group and no range of equal beginnings has to meet in one
task, since a range ends anywhere between two sequences.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.session import cut, sized_batches

FIRST, LAST = 1, 2


def common(a: Column, b: Column) -> Column:
    """How many leading elements of two arrays are equal."""
    differs = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))
    at = F.array_position(differs, True)
    # beyond the shorter one, nulls stand for what is missing
    return F.least(F.when(at > 0, at - 1).otherwise(F.size(differs)), F.size(a), F.size(b)).cast("long")


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, tokens, ...) with `shared` and `edge`, each a row late, since only the last of all is the last."""
    held: pa.RecordBatch | None = None  # the row before, not sent yet
    shared_held, first = 0, FIRST

    def sent(rows: pa.RecordBatch, shared: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(shared, pa.int64()), pa.array(edge, pa.int32())], names=[*rows.schema.names, "shared", "edge"])

    for batch in batches:
        if not batch.num_rows:
            continue
        whole = batch if held is None else pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]) for a, b in zip(held.columns, batch.columns)], schema=batch.schema)
        col = whole.column("tokens")
        n = np.asarray(col.value_lengths())
        starts = np.concatenate([[0], np.cumsum(n)])
        codes = col.flatten().dictionary_encode(null_encoding="encode").indices.to_numpy()
        group = whole.column("g").dictionary_encode(null_encoding="encode").indices.to_numpy()
        shared = np.zeros(len(whole), np.int64)
        shared[0] = shared_held
        for i in range(1, len(whole)):
            if group[i] == group[i - 1]:
                m = min(n[i - 1], n[i])
                apart = codes[starts[i - 1] : starts[i - 1] + m] != codes[starts[i] : starts[i] + m]
                at = int(apart.argmax()) if m else 0
                shared[i] = at if m and apart[at] else m
        edge = np.zeros(len(whole), np.int32)
        edge[0], first = first, (first if len(whole) == 1 else 0)
        if len(whole) > 1:
            yield sent(whole.slice(0, len(whole) - 1), shared[:-1], edge[:-1])
        held, shared_held = whole.slice(len(whole) - 1), shared[-1]
    if held is not None:
        yield sent(held, np.array([shared_held]), np.array([first | LAST], np.int32))


def neighbours(rows: DataFrame, *order: str) -> DataFrame:
    """rows (g, tokens and more) with `shared`: the leading tokens in common with the row before it in order of g, tokens and `order`, if of one g."""
    by = ("g", "tokens", *order)
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__p", F.spark_partition_id())
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    with sized_batches(rows.sparkSession):
        found = cut(dealt.mapInArrow(_neighbours, f"{kinds}, shared long, edge int"))
    # the rows at the ends of ranges: two for each task
    ends = found.where("edge > 0")
    before = Window.orderBy("__p", F.col("edge").bitwiseAND(F.lit(LAST)), *by)
    ends = ends.withColumns({"__g": F.lag("g").over(before), "__t": F.lag("tokens").over(before)}).where(F.col("edge").bitwiseAND(F.lit(FIRST)) > 0)
    over = F.when(F.col("g").eqNullSafe(F.col("__g")) & F.col("__t").isNotNull(), common(F.col("tokens"), F.col("__t"))).otherwise(F.lit(0).cast("long"))
    heads = ends.withColumn("shared", over)
    rest = found.where(F.col("edge").bitwiseAND(F.lit(FIRST)) == 0)
    names = [*rows.columns, "shared"]
    return rest.select(*names).unionByName(heads.select(*names))


def prefix_forest(rows: DataFrame, tokens: str, by: Sequence[str] = ()) -> DataFrame:
    """kind, by, tokens, n, length, parent_length: a row for each different sequence (kind `sequence`, n: how often) and for each prefix (kind `prefix`) at
    which two or more rows of one group part, end, or are equal. The parent is the longest such prefix of a row other than itself, of
    parent_length tokens, 0 for none; a repeated sequence is a prefix too, and the parent of its own row.

    So length - parent_length tokens are a row's own, and keeping each row's own tokens once keeps all sequences. Null sequences are
    empty ones; empty ones share nothing; null tokens equal one another; groups of nulls are groups; an empty table gives no rows; other
    columns are ignored."""
    group = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")
    kind = rows.schema[tokens].dataType
    read = rows.select(group.alias("g"), *(F.col(c).alias(f"__by{i}") for i, c in enumerate(by)), F.coalesce(F.col(tokens), F.array().cast(kind)).alias("tokens"))
    named = [f"__by{i}" for i in range(len(by))]
    different = cut(read.groupBy("g", *named, "tokens").agg(F.count("*").alias("n")))
    parts = neighbours(different).where("shared > 0").select("g", *named, F.slice("tokens", F.lit(1), F.col("shared").cast("int")).alias("tokens"))
    repeated = different.where((F.col("n") > 1) & (F.size("tokens") > 0)).select("g", *named, "tokens")
    prefixes = parts.unionByName(repeated).distinct().withColumns({"n": F.lit(0).cast("long"), "kind": F.lit("prefix")})
    placed = neighbours(prefixes.unionByName(different.withColumn("kind", F.lit("sequence"))), "kind")
    back = [F.col(f"__by{i}").alias(c) for i, c in enumerate(by)]
    return placed.select("kind", *back, "tokens", "n", F.size("tokens").cast("long").alias("length"), F.col("shared").alias("parent_length"))


def prefix_savings(forest: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, n, tokens, kept, saved: of each group's sequences the tokens that there are, those kept when each shared prefix is kept once, and the difference."""
    total = F.sum(F.col("n") * F.col("length"))
    kept = F.sum(F.col("length") - F.col("parent_length"))
    return forest.groupBy(*by).agg(F.sum("n").alias("n"), total.alias("tokens"), kept.alias("kept"), (total - kept).alias("saved"))
