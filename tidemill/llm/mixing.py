"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share all words by weight; none gets over CAP
times its own, what is over being shared again by weight. That is water filling: target = least(CAP * size, level * weight).

Rates: of all rates r with sum(size * r) = target in a source and 0 <= r <= CAP, those nearest to 1 in relative entropy are
r = least(CAP, exp(tilt * size / mean size)). The dual is convex in the tilt of each source; Newton steps on its stationarity,
kept in a bracket, find all tilts at once from a table of (source, size) counts, so that a step's cost does not depend on
the number of documents.

Copies: the documents of a (source, size) are dealt by a hash into cells of about CELL, and of a cell all get floor(r) copies, and some
one more: as many as make the running sum over the source's cells, in order, whole (systematic rounding). Which ones, a hash of the row
decides. Then one document of each source takes some words more or fewer (`extra`), so that the source meets its target unless that
document is too short.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.runtime import WORD, cut
from tidemill.operators.batch import ROW, numbered

WEIGHTS, CAP = (5.0, 2.0, 1.0), 3
CLOSE, HALVE = 1e-9, 6
CELL = 1000
HALF = 0.5


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """key, source_size, target: a row per source. sizes: key, source, source_size.

    The level rises until no further source meets its cap; only sums reach the driver, and no task sees all sources."""
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col(ROW) % len(WEIGHTS) + 1).cast("int"))
    ranked = numbered(sizes, F.col("source").asc_nulls_last(), "key")
    held = cut(ranked.select("key", "source_size", weight.alias("weight"), (CAP * F.col("source_size")).cast("double").alias("cap")))
    total, level = float(held.agg(F.sum("source_size")).first()[0] or 0), -1.0
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        spent, free = held.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not free or (higher := (total - spent) / free) <= level:
            break
        level = higher
    return held.select("key", "source_size", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def tilts(cells: DataFrame, goals: DataFrame) -> DataFrame:
    """key, tilt, mean: the dual's solution. cells: key, size, n; goals: key, source_size, target.

    Steps go on until each source's gap is closed, or its bracket is no wider than a double can tell; every HALVE-th step halves
    the bracket, so that they end."""
    worked = cells.where("size > 0")
    low = worked.groupBy("key").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min("size").alias("least"))
    ratio = F.log(F.col("target") / F.col("source_size"))
    x_least = F.col("least") / F.col("mean")
    state = goals.where("source_size > 0 and target > 0").join(low, "key").select(
        "key", "target", "mean", F.least(ratio / x_least, F.lit(0.0)).alias("lo"), (math.log(CAP) / x_least).alias("hi"), F.lit(0.0).alias("tilt"), F.lit(1.0).alias("gap"))
    state = cut(state)
    x, rate = F.col("size") / F.col("mean"), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(math.log(CAP))))
    words = F.col("n") * F.col("size")
    is_open = (F.col("gap") > CLOSE) & (F.col("hi") - F.col("lo") > 4e-16 * F.greatest(F.abs("lo"), F.abs("hi")))
    steps = 0
    while not state.where(is_open).isEmpty():
        steps += 1
        at = worked.join(state.select("key", "tilt", "mean"), "key").groupBy("key").agg(
            F.sum(words * rate).alias("f"), F.sum(F.when(rate < CAP, words * rate * x).otherwise(0.0)).alias("slope"))
        lo = F.when(F.col("f") <= F.col("target"), F.col("tilt")).otherwise(F.col("lo"))
        hi = F.when(F.col("f") >= F.col("target"), F.col("tilt")).otherwise(F.col("hi"))
        newton = F.when((F.col("slope") > 0) & F.lit(bool(steps % HALVE)), F.col("tilt") + F.log(F.col("target") / F.col("f")) * F.col("f") / F.col("slope"))
        step = F.when((F.col("newton") > F.col("lo")) & (F.col("newton") < F.col("hi")), F.col("newton")).otherwise((F.col("lo") + F.col("hi")) / 2)
        gap = F.abs(F.col("f") / F.col("target") - 1)
        moved = state.join(at, "key").select("key", "target", "mean", lo.alias("lo"), hi.alias("hi"), newton.alias("newton"), gap.alias("gap"), "tilt")
        state = cut(moved.select("key", "target", "mean", "lo", "hi", F.when(F.col("gap") > CLOSE, step).otherwise(F.col("tilt")).alias("tilt"), "gap"))
    return state.select("key", "tilt", "mean")


def mix(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (0 to CAP), extra (words beside whole copies), taken, and the columns named
    in carry: a row per document.

    Null and empty texts have size 0 and are taken 0 times; a null source is a source, the last one; repeated rows are documents
    of their own, and a null doc_id is a value like others; very long texts count whole; an empty table gives no rows; other
    columns are ignored. The same rows give the same answer."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    own = [F.col(c).alias(f"__carry{k}") for k, c in enumerate(carry)]
    rows = cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("h"), *own).withColumn("key", key))
    cells = cut(rows.groupBy("key", "size").agg(F.count("*").alias("n"), F.min("source").alias("source")))
    goals = cut(targets(cells.groupBy("key").agg(F.min("source").alias("source"), F.sum(F.col("size") * F.col("n")).alias("source_size"))))
    tilt = tilts(cells, goals)
    rate = F.when(F.col("size") == 0, 0.0).otherwise(F.coalesce(F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(math.log(CAP)))), F.lit(0.0)))
    rate = F.when(rate > CAP - 1e-9, float(CAP)).otherwise(rate)
    plan = cells.drop("source").join(goals, "key").join(tilt, "key", "left").withColumn("rate", rate).withColumn("whole", F.floor("rate"))
    plan = cut(plan.select(F.col("key").alias("k"), F.col("size").alias("z"), F.ceil(F.col("n") / CELL).alias("salts"), "source_size", "target", "whole", (F.col("rate") - F.col("whole")).alias("part")))
    held = rows.join(plan, (F.col("key") == F.col("k")) & (F.col("size") == F.col("z"))).drop("k", "z")
    held = held.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size", "h"), F.col("salts")))
    held = cut(held.withColumn("cell", F.concat_ws("/", "key", "size", "salt")))
    counts = held.groupBy(F.col("cell").alias("c")).agg(F.min("key").alias("k"), F.min("size").alias("z"), F.min("salt").alias("s"), (F.count("*") * F.min("part")).alias("share"))
    by_size = Window.partitionBy("k").orderBy("z", "s")
    up_to = counts.withColumn("up_to", F.floor(F.sum("share").over(by_size.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + HALF))
    quota = up_to.select("c", (F.col("up_to") - F.coalesce(F.lag("up_to").over(by_size), F.lit(0))).alias("quota"))
    order = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(9))
    place = F.row_number().over(Window.partitionBy("cell").orderBy(order, "doc_id", "h", *(c for c in held.columns if c.startswith("__carry"))))
    held = held.withColumn("place", place).join(quota, F.col("cell") == F.col("c"))
    held = cut(held.withColumn("copies", F.least(F.col("whole") + F.when(F.col("place") <= F.col("quota"), 1).otherwise(0), F.lit(CAP)).cast("long")))
    spot = F.struct("size", "salt", "place")
    able = lambda c: F.max(F.when(c & (F.col("size") > 0), spot))
    got = held.groupBy("key").agg(F.sum(F.col("copies") * F.col("size")).alias("got"), F.max("target").alias("goal"), able(F.col("copies") < CAP).alias("up"), able(F.col("copies") > 0).alias("down"))
    short = F.round(F.col("goal")).cast("long") - F.col("got")
    fix = got.select(F.col("key").alias("fk"), short.alias("short"), F.when(short > 0, F.col("up")).when(short < 0, F.col("down")).alias("at")).where("at is not null")
    fix = fix.select("fk", "short", F.col("at.size").alias("fz"), F.col("at.salt").alias("fs"), F.col("at.place").alias("fp"))
    same = (F.col("key") == F.col("fk")) & (F.col("size") == F.col("fz")) & (F.col("salt") == F.col("fs")) & (F.col("place") == F.col("fp"))
    within = F.greatest(F.least("short", (CAP - F.col("copies")) * F.col("size")), -F.col("copies") * F.col("size"))
    extra = F.when(F.col("short").isNull(), 0).otherwise(within).cast("long")
    out = held.join(fix, same, "left").withColumn("extra", extra)
    taken = F.col("copies") * F.col("size") + F.col("extra")
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", "extra", taken.alias("taken"), *(F.col(f"__carry{k}").alias(c) for k, c in enumerate(carry)))
