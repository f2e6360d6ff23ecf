"""How a table goes to workers and comes back: named modes, each a way to run a function on partitions."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.registry import Registry

MODES = Registry("dispatch mode")


@MODES.register("one_to_all")
def one_to_all(rows: DataFrame, work: Callable[[Iterator[pd.DataFrame], Any], Iterator[pd.DataFrame]], schema: str, shared: Any = None, most: int = 64_000_000) -> DataFrame:
    """Every task gets the same value beside its rows; one of more than `most` bytes must come as a table and a join."""
    if (size := len(pickle.dumps(shared))) > most:
        raise ValueError(f"a value of {size} bytes is more than goes to every task ({most})")
    held = rows.sparkSession.sparkContext.broadcast(shared)
    return rows.mapInPandas(lambda batches: work(batches, held.value), schema)


@MODES.register("all_to_all")
def all_to_all(rows: DataFrame) -> DataFrame:
    return rows


@MODES.register("dp_compute_proto")
def by_rows(rows: DataFrame, work: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, workers: int | None = None, key: str | None = None) -> DataFrame:
    """Rows dealt to tasks (by a key, which then stays together), results one table."""
    dealt = rows.repartition(workers, key) if workers and key else rows.repartition(workers) if workers else rows.repartition(key) if key else rows
    return dealt.mapInPandas(work, schema)


MODES.register("dp_compute_proto_with_func")(by_rows)


@MODES.register("dp_compute")
def prearranged(rows: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str, rank: str = "rank") -> DataFrame:
    """One call for the rows of each rank."""
    return rows.groupBy(rank).applyInPandas(work, schema)


@MODES.register("dp_compute_metric")
def metrics(rows: DataFrame, aggregates: dict[str, Any], rank: str = "rank") -> list[dict[str, Any]]:
    """A few numbers of each rank, in order of ranks."""
    got = rows.groupBy(rank).agg(*(c.alias(k) for k, c in aggregates.items())).orderBy(rank).collect()
    return [r.asDict() for r in got]


@MODES.register("nd_compute")
def by_group(rows: DataFrame, work: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, groups: int, key: str = "row_idx") -> DataFrame:
    """Rows in `groups` ranges of a key; the members of a group see the same rows, so the work is done once."""
    return rows.repartitionByRange(groups, F.col(key)).mapInPandas(work, schema)


def collected(rows: DataFrame, ranks: list[int], rank: str = "rank") -> DataFrame:
    """Of results that several ranks made alike, those of the ranks that are asked to give them."""
    return rows.where(F.col(rank).isin(*ranks))


def run(mode: str, *args: Any, **options: Any) -> Any:
    return MODES[mode](*args, **options)
