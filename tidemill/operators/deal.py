"""Dealing the rows of steps of any size to parts of about even load, as largest differencing in a tree.

A step's rows, sorted by load, are cut into buckets of bounded size; each bucket becomes a state of k sets by largest differencing; states
are then joined, some at a time, until one is left, and the joins of all levels together say which part a row's set has become. Only
sums of sets go up the tree, rows are placed by one join.

The spread of a state is the difference of its heaviest and lightest set. Joining two states, the heaviest set of one with the lightest
of the other and so on, gives sums a_i + b_(k+1-i), of which any two differ by no more than the larger spread of the two: the
a-part and the b-part of the difference have opposite signs. So no join makes a spread worse, and parts differ by at most the
largest load of a row; with as many rows in each part, by at most the largest difference within k neighbours in order of load.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.balance import differencing, joined, micro_batches, state, workload
from tidemill.operators.batch import ROW, numbered
from tidemill.session import cut

BUCKET, FAN, RUN = 4096, 64, 65536


def _with_steps(order: DataFrame, by: str, steps: DataFrame, run: int = RUN) -> DataFrame:
    """Numbered rows, in order of `by`, with the columns of their step (steps: __step, __from, __n and others): joined by step and run of rows, of
    which a step has as many rows as it touches runs, so no task sees a whole step."""
    runs = F.sequence(F.floor(F.col("__from") / run), F.floor((F.col("__from") + F.col("__n") - 1) / run))
    own = steps.withColumn("__run", F.explode(runs))
    return order.withColumn("__in", F.floor(F.col(ROW) / run)).join(own, F.col(by).eqNullSafe(F.col("__step")) & (F.col("__in") == F.col("__run"))).drop("__in", "__run")


def _sorted_buckets(items: DataFrame, k: int, equal_size: bool, bucket: int) -> DataFrame:
    """items (step, key, load) with bucket: runs of at most `bucket` items (a multiple of k, or k) of a step in order of load."""
    size = max(1, bucket // k) * k
    order = numbered(items, "step", "load", "key")
    # a row for each step: joined, not broadcast, since there may be many
    steps = order.groupBy(F.col("step").alias("__step")).agg(F.min(ROW).alias("__from"), F.count("*").alias("__n"))
    wrong = F.col("__n") % k != 0 if equal_size else F.col("__n") < k
    if bad := steps.where(wrong).first():
        raise ValueError(f"{bad['__n']} items of step {bad['__step']!r} do not make {k} {'equal' if equal_size else 'filled'} parts")
    return _with_steps(order, "step", steps).select("step", "key", "load", F.floor((F.col(ROW) - F.col("__from")) / size).alias("bucket"))


def dealt(rows: DataFrame, by: str, k: int, load: Column | None = None, key: str = "row_idx", equal_size: bool = False, bucket: int = BUCKET, fan: int = FAN) -> DataFrame:
    """by, key, load, part: the rows of each step dealt to k parts, part 0 the heaviest; `load` (else the workload of seqlen) is a whole number or a double, not
    null or negative. equal_size: as many rows in each part.

    Steps of up to `bucket` rows are dealt as `balance.assigned` does, larger ones in a tree of tasks of at most bucket rows or fan states;
    parts differ by at most the largest load. Keys must differ within a step; a step with fewer rows than parts (equal_size: not a
    multiple) is a ValueError; null steps are one; an empty table gives no rows."""
    items = rows.select(F.col(by).alias("step"), F.col(key).alias("key"), (load if load is not None else workload(F.col("seqlen"))).alias("load"))
    kinds = dict(items.dtypes)
    total = kinds["load"] if kinds["load"] == "double" else "double" if kinds["load"] == "float" else "decimal(38,0)" if kinds["load"].startswith("decimal") else "bigint"

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key").reset_index(drop=True)
        loads = pdf["load"].tolist()
        sets = differencing(loads, k, equal_size)
        out = pdf.iloc[[i for s in sets for i in s]]
        return out.assign(part=[p for p, s in enumerate(sets) for _ in s])

    schema = f"step {kinds['step']}, key {kinds['key']}, load {kinds['load']}, bucket long"
    placed = cut(_sorted_buckets(items, k, equal_size, bucket).groupBy("step", "bucket").applyInPandas(first, f"{schema}, part long"))
    sums = cut(placed.groupBy("step", "bucket", "part").agg(F.sum("load").cast(total).alias("load"), F.count("*").alias("n")))

    def up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bucket", "part"]).reset_index(drop=True)
        loads, counts = pdf["load"].tolist(), pdf["n"].tolist()
        states = [state([(loads[i], counts[i], (-i,)) for i in at], k) for at in pdf.groupby("bucket").indices.values()]
        sets = joined(states)
        into = {-i: p for p, s in enumerate(sets) for i in s[2]}  # of equal sets the first stays first
        return pdf.assign(to=pdf["bucket"] // fan, into=[into[i] for i in range(len(pdf))])[["step", "bucket", "part", "to", "into", "load", "n"]]

    # into what each set of the lowest level has gone so far
    where = sums.select(F.col("step").alias("w"), F.col("bucket").alias("b0"), F.col("part").alias("p0"), F.col("bucket").alias("b"), F.col("part").alias("p"))
    while (sums.agg(F.max("bucket")).first()[0] or 0) > 0:
        level = cut(sums.groupBy("step", F.floor(F.col("bucket") / fan)).applyInPandas(up, f"step {kinds['step']}, bucket long, part long, to long, into long, load {total}, n long"))
        where = where.join(level, F.col("w").eqNullSafe(F.col("step")) & (F.col("b") == F.col("bucket")) & (F.col("p") == F.col("part"))).select("w", "b0", "p0", F.col("to").alias("b"), F.col("into").alias("p"))
        where = cut(where)
        sums = cut(level.groupBy("step", F.col("to").alias("bucket"), F.col("into").alias("part")).agg(F.sum("load").cast(total).alias("load"), F.sum("n").alias("n")))
    same = F.col("step").eqNullSafe(F.col("w")) & (F.col("bucket") == F.col("b0")) & (F.col("part") == F.col("p0"))
    return placed.join(where, same).select(F.col("step").alias(by), F.col("key").alias(key), "load", F.col("p").alias("part"))


def micro_dealt(rows: DataFrame, by: str, most_tokens: int, length: str = "seqlen", key: str = "row_idx", group: str | None = None, bucket: int = BUCKET) -> DataFrame:
    """by, key, shard, micro_batch: the rows of steps of any size in micro-batches of about even work and, as far as that allows, at most so many
    tokens; rows of a `group` stay together, and must fit a bucket.

    A step's groups, sorted by work, are dealt back and forth to shards of about `bucket` rows, which makes their work differ by at most
    that of the heaviest group; each shard is then split by `balance.micro_batches` in a task of its own. Steps of up to `bucket` rows are one
    shard. A sequence of more than most_tokens is a ValueError."""
    kinds = dict(rows.dtypes)
    own = F.struct(group) if group else F.struct(key)
    items = cut(rows.select(by, key, length, own.alias("__g")))
    if items.where(F.col(length) > most_tokens).limit(1).count():
        raise ValueError("a sequence is longer than a micro-batch may be")
    groups = items.groupBy(by, "__g").agg(F.sum(workload(F.col(length))).alias("__load"), F.count("*").alias("__rows"))
    order = numbered(groups.withColumn("__down", -F.col("__load")), by, "__down", "__g")
    steps = order.groupBy(F.col(by).alias("__step")).agg(F.min(ROW).alias("__from"), F.count("*").alias("__n"), F.ceil(F.sum("__rows") / bucket).alias("__shards"))
    at = F.col(ROW) - F.col("__from")
    turn, place = F.floor(at / F.col("__shards")), at % F.col("__shards")
    shard = F.when(turn % 2 == 0, place).otherwise(F.col("__shards") - 1 - place)
    sent = _with_steps(order, by, steps).select(F.col(by).alias("__s"), F.col("__g").alias("__h"), shard.cast("long").alias("shard"))
    placed = items.join(sent, F.col(by).eqNullSafe(F.col("__s")) & F.col("__g").eqNullSafe(F.col("__h"))).select(by, key, length, F.to_json("__g", {"ignoreNullFields": "false"}).alias("__g"), "shard")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key).reset_index(drop=True)
        sets = micro_batches(pdf[length].tolist(), most_tokens, pdf["__g"].tolist())
        at = [i for s in sets for i in s]
        return pd.DataFrame({by: pdf[by].iloc[at].to_numpy(), key: pdf[key].iloc[at].to_numpy(), "shard": pdf["shard"].iloc[at].to_numpy(), "micro_batch": [m for m, s in enumerate(sets) for _ in s]})

    return placed.groupBy(by, "shard").applyInPandas(one, f"{by} {kinds[by]}, {key} {kinds[key]}, shard long, micro_batch long")
