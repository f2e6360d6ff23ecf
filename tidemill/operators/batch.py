"""A table of rows in order: row numbers are a column, so that order survives shuffles, and table-wide values stay on the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.draws import word
from tidemill.session import cut

ROW = "row_idx"


def numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    """df with row_idx from 0 in the order given (which must be total). Rows are numbered within ranges of the order, and ranges' sizes
    are summed up, so no task sees all rows."""
    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    # kept as it is: ranges drawn anew, or put together otherwise, would not fit the sums
    local = cut(ranged.withColumn("__k", F.row_number().over(Window.partitionBy("__part").orderBy(*order))))
    sizes = local.groupBy("__part").agg(F.max("__k").alias("__n"))
    before = sizes.select(F.col("__part").alias("__p"), (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__b"))
    return local.join(F.broadcast(before), F.col("__part") == F.col("__p")).withColumn(ROW, (F.col("__b") + F.col("__k") - 1).cast("long")).drop("__part", "__p", "__k", "__b")


@dataclass
class Batch:
    """rows: a DataFrame with row_idx 0, 1, ...; meta: values of the whole table."""

    rows: DataFrame
    meta: dict[str, Any] = field(default_factory=dict)

    def _with(self, rows: DataFrame, meta: dict | None = None) -> Batch:
        return Batch(rows, dict(self.meta if meta is None else meta))

    def __len__(self) -> int:
        return self.rows.count()

    @property
    def columns(self) -> list[str]:
        return [c for c in self.rows.columns if c != ROW]

    # columns
    def select(self, columns: Sequence[str] | None = None, meta: Sequence[str] | None = None) -> Batch:
        if columns is not None and (missing := [c for c in columns if c not in self.columns]):
            raise KeyError(f"no columns {missing}")
        return self._with(self.rows.select(ROW, *(self.columns if columns is None else columns)), {k: v for k, v in self.meta.items() if meta is None or k in meta})

    def pop(self, columns: Sequence[str], meta: Sequence[str] = ()) -> tuple[Batch, Batch]:
        """The columns taken out, and what stays."""
        taken = self.select(columns, meta)
        return taken, self._with(self.rows.drop(*columns), {k: v for k, v in self.meta.items() if k not in meta})

    def rename(self, old: str | Sequence[str], new: str | Sequence[str]) -> Batch:
        old, new = ([x] if isinstance(x, str) else list(x) for x in (old, new))
        if len(old) != len(new):
            raise ValueError("as many new names as old ones are needed")
        return self._with(self.rows.withColumnsRenamed(dict(zip(old, new, strict=True))))

    def union(self, other: Batch) -> Batch:
        """Columns of both, row by row. Shared columns must be equal (nulls and NaN equal themselves), shared meta too."""
        shared = [c for c in other.columns if c in self.columns]
        renamed = other.rows.withColumnsRenamed({c: f"__{c}" for c in shared})
        rows = self.rows.withColumn("__l", F.lit(1)).join(renamed.withColumn("__r", F.lit(1)), ROW, "full")
        same = F.col("__l").isNotNull() & F.col("__r").isNotNull()
        for c in shared:
            same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
        checked = F.when(same, F.col(ROW)).otherwise(F.raise_error(F.lit("tables differ in length or in shared columns")).cast("long"))
        return self._with(rows.withColumn(ROW, checked).drop("__l", "__r", *(f"__{c}" for c in shared)), merged(self.meta, other.meta))

    # rows
    def take(self, which: Sequence[int] | Sequence[bool]) -> Batch:
        """Rows by number, in that order, as often as they are named; or by flags."""
        which = list(which)
        if which and all(isinstance(x, bool) for x in which):
            which = [i for i, x in enumerate(which) if x]
        pairs = self.rows.sparkSession.createDataFrame(list(enumerate(which)), "new long, old long")
        return self._with(self.rows.join(pairs, F.col(ROW) == F.col("old")).withColumn(ROW, F.col("new")).drop("new", "old"))

    def reorder(self, table: DataFrame, old: str, new: str) -> Batch:
        """Rows by a table of old and new numbers."""
        pairs = table.select(F.col(old).alias("__old"), F.col(new).alias("__new"))
        return self._with(self.rows.join(pairs, F.col(ROW) == F.col("__old")).withColumn(ROW, F.col("__new").cast("long")).drop("__old", "__new"))

    def slice(self, start: int | None = None, stop: int | None = None, step: int | None = None) -> Batch:
        """As of a Python list."""
        s = range(*slice(start, stop, step).indices(len(self)))
        i = F.col(ROW)
        if not len(s):
            return self._with(self.rows.limit(0))
        inside = i.between(min(s[0], s[-1]), max(s[0], s[-1])) & (F.pmod(i - s[0], F.lit(abs(s.step))) == 0)
        return self._with(self.rows.where(inside).withColumn(ROW, ((i - s[0]) / s.step).cast("long")))

    def __getitem__(self, key: int | slice | Sequence) -> Any:
        if isinstance(key, bool) or not isinstance(key, int | slice | list | tuple):
            raise TypeError(f"rows are picked by number, slice or list, not {type(key).__name__}")
        if isinstance(key, int):
            n = key if key >= 0 else len(self) + key
            row = self.rows.where(F.col(ROW) == n).first()
            if row is None:
                raise IndexError(key)
            return row
        return self.slice(key.start, key.stop, key.step) if isinstance(key, slice) else self.take(key)

    def chunk_ids(self, parts: int, even: bool = True) -> DataFrame:
        """rows with chunk: `parts` runs of equal length, which must come out even unless told otherwise."""
        n = len(self)
        if even and n % parts:
            raise ValueError(f"{n} rows do not make {parts} equal parts")
        return self.rows.withColumn("chunk", F.floor(F.col(ROW) * parts / n).cast("int"))

    def chunks(self, parts: int) -> list[Batch]:
        ids, size = self.chunk_ids(parts), len(self) // parts
        return [self._with(ids.where(F.col("chunk") == k).drop("chunk").withColumn(ROW, F.col(ROW) - k * size)) for k in range(parts)]

    def split_ids(self, size: int) -> DataFrame:
        """rows with piece: runs of `size` rows, the last one may be short."""
        return self.rows.withColumn("piece", F.floor(F.col(ROW) / size).cast("int"))

    def repeat(self, times: int, interleave: bool = True) -> Batch:
        """a a b b, or a b a b."""
        k, n = F.explode(F.sequence(F.lit(0), F.lit(times - 1))), None if interleave else len(self)
        new = F.col(ROW) * times + F.col("__k") if interleave else F.col("__k") * n + F.col(ROW)
        return self._with(self.rows.withColumn("__k", k).withColumn(ROW, new.cast("long")).drop("__k"))

    def repeat_each(self, times: str) -> Batch:
        """Each row as often as its column says."""
        ends = running(self.rows, times)
        many = F.when(F.col(times) > 0, F.sequence(F.lit(0), F.col(times).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
        out = ends.withColumn("__k", F.explode(many))
        return self._with(out.withColumn(ROW, (F.col("__end") - F.col(times) + F.col("__k")).cast("long")).drop("__k", "__end"))

    def unfold(self, parts: int, columns: Sequence[str] | None = None) -> Batch:
        """Arrays of the named columns cut into `parts` rows; other columns repeated."""
        cols = columns or []
        out = self.rows.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        for c in cols:
            w = (F.size(c) / parts).cast("int")
            out = out.withColumn(c, F.slice(c, F.col("__k") * w + 1, w))
        return self._with(out.withColumn(ROW, F.col(ROW) * parts + F.col("__k")).drop("__k"))

    def fold(self, size: int) -> Batch:
        """Runs of `size` rows as one row of arrays."""
        if len(self) % size:
            raise ValueError(f"rows do not make runs of {size}")
        item = F.array_sort(F.collect_list(F.struct(ROW, *self.columns)))
        out = self.rows.groupBy(F.floor(F.col(ROW) / size).alias("__r")).agg(item.alias("x"))
        return self._with(out.select(F.col("__r").alias(ROW), *(F.col(f"x.{c}").alias(c) for c in self.columns)))

    def unfold_rows(self) -> Batch:
        """The inverse of fold."""
        zipped = F.arrays_zip(*self.columns)
        width = F.size(self.columns[0])
        out = self.rows.select(F.col(ROW), width.alias("__w"), F.posexplode(zipped).alias("__k", "x"))
        return self._with(out.select((F.col(ROW) * F.col("__w") + F.col("__k")).alias(ROW), *(F.col(f"x.{c}").alias(c) for c in self.columns)))

    def pad_to(self, divisor: int) -> tuple[Batch, int]:
        """Rows from the start again, as many as make the length a multiple; and how many. An empty table stays."""
        n = len(self)
        extra = -n % divisor if n else 0
        if not extra:
            return self, 0
        again = self.rows.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(extra // n)))).withColumn(ROW, F.col(ROW) + (F.col("__k") + 1) * n).where(F.col(ROW) < n + extra).drop("__k")
        return self._with(self.rows.unionByName(again)), extra

    def unpad(self, extra: int) -> Batch:
        return self._with(self.rows.where(F.col(ROW) < len(self) - extra)) if extra else self

    def padding(self, size: int, first: bool = False) -> Batch:
        """`size` more rows like the last one (or the first)."""
        n = len(self)
        more = self.rows.where(F.col(ROW) == (0 if first else n - 1)).withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn(ROW, F.col("__k").cast("long") + n).drop("__k")
        return self._with(self.rows.unionByName(more))

    def with_padding_rows(self, multiple: int, blank: Mapping[str, Column]) -> Batch:
        """Rows that count for nothing, flagged is_padding, up to a multiple; blank: their values, null for other columns."""
        n = len(self)
        extra = -n % multiple
        base = self.rows.withColumn("is_padding", F.lit(False))
        if not extra:
            return self._with(base)
        kinds = dict(base.dtypes)
        made = self.rows.sparkSession.range(n, n + extra).select(F.col("id").alias(ROW), *(blank.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in self.columns), F.lit(True).alias("is_padding"))
        return self._with(base.unionByName(made))

    def mini_batches(self, size: int, epochs: int = 1, seed: int | None = None) -> DataFrame:
        """rows with epoch and mini_batch; shuffled anew in each epoch if there is a seed."""
        n = len(self)
        if n % size:
            raise ValueError(f"{n} rows do not make mini-batches of {size}")
        rows = self.rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
        if seed is None:
            return rows.withColumn("mini_batch", F.floor(F.col(ROW) / size).cast("int"))
        order = word("__old", "epoch", seed)
        mixed = numbered(rows.withColumnRenamed(ROW, "__old").withColumn("__h", order), "epoch", "__h", "__old")
        return mixed.withColumn("mini_batch", F.floor((F.col(ROW) - F.col("epoch") * n) / size).cast("int")).drop(ROW, "__h").withColumnRenamed("__old", ROW)

    def save(self, path: str) -> None:
        """rows as Parquet, meta as one row of JSON beside."""
        import json

        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        self.rows.sparkSession.createDataFrame([(json.dumps(self.meta, default=str),)], "meta string").write.mode("overwrite").json(f"{path}/meta")

    @classmethod
    def load(cls, spark, path: str) -> Batch:
        import json

        meta = spark.read.json(f"{path}/meta").first()
        return cls(spark.read.parquet(f"{path}/rows"), json.loads(meta[0]) if meta else {})


def before_runs(totals: DataFrame, run: int) -> DataFrame:
    """__run, __b: of each run of rows (its sum in __s) the sum of all runs before it. Runs are summed up in runs of `run` again, so the one task that sees sums of all
    has a row for run * run rows."""
    t = totals.withColumn("__big", F.floor(F.col("__run") / run))
    bigs = t.groupBy("__big").agg(F.sum("__s").alias("__t"))
    first = bigs.select("__big", (F.sum("__t").over(Window.orderBy("__big")) - F.col("__t")).alias("__f"))
    inside = F.sum("__s").over(Window.partitionBy("__big").orderBy("__run")) - F.col("__s")
    return t.withColumn("__i", inside).join(first, "__big").select("__run", (F.col("__f") + F.col("__i")).alias("__b"))


def running(rows: DataFrame, value: str, run: int = 4096) -> DataFrame:
    """rows with __end: the sum of value up to this row. Sums of runs of rows first, then within runs, so that no task sees all rows."""
    r = rows.withColumn("__run", F.floor(F.col(ROW) / run))
    before = before_runs(r.groupBy("__run").agg(F.sum(value).alias("__s")), run)
    out = r.join(before, "__run").withColumn("__end", F.col("__b") + F.sum(value).over(Window.partitionBy("__run").orderBy(ROW)))
    return out.drop("__run", "__b")


def merged(a: Mapping[str, Any], b: Mapping[str, Any]) -> dict[str, Any]:
    if clash := [k for k in a if k in b and a[k] != b[k]]:
        raise ValueError(f"tables differ in {clash}")
    return {**a, **b}


def concat(batches: Sequence[Batch]) -> Batch:
    """Rows of all, one after another. Metrics are gathered into lists by name; other meta must be equal."""
    rows, at, meta, metrics = None, 0, {}, []
    for k, b in enumerate(batches):
        moved = b.rows.withColumn(ROW, F.col(ROW) + at)
        rows = moved if rows is None else rows.unionByName(moved)
        at += len(b) if k + 1 < len(batches) else 0
        own = dict(b.meta)
        found = own.pop("metrics", None)
        metrics += found if isinstance(found, list) else [found] if found else []
        meta = merged(meta, own)
    if metrics:
        meta["metrics"] = {k: [m[k] for m in metrics if k in m] for k in dict.fromkeys(k for m in metrics for k in m)}
    return Batch(rows, meta)


def from_rows(spark, records: Sequence[Mapping[str, Any]], schema: str | None = None, meta: Mapping[str, Any] | None = None) -> Batch:
    """A table of a list of records, in their order."""
    rows = [{**r, ROW: i} for i, r in enumerate(records)]
    return Batch(spark.createDataFrame(rows, f"{schema}, {ROW} long" if schema else None), dict(meta or {}))


def generation_view(b: Batch, keep: Sequence[str] = ("data_source", "reward_model", "extra_info", "uid")) -> tuple[Batch, Batch]:
    """What goes to generation (all columns), and what the table keeps of its own for the reward."""
    kept = [c for c in keep if c in b.columns]
    return b, b.select(kept)


def prefixed(metrics: Mapping[str, Any], prefix: str) -> dict[str, Any]:
    return {f"{prefix}{k}": v for k, v in metrics.items()}


def appended(lists: Mapping[str, list], values: Mapping[str, Any], prefix: str = "") -> dict[str, list]:
    """lists with each value at the end of its name's list."""
    out = {k: list(v) for k, v in lists.items()}
    for k, v in values.items():
        out.setdefault(f"{prefix}{k}", []).append(v)
    return out


def for_generation(sample: Batch, n: int, agent: str | None = None) -> Batch:
    """A sample's rows n times each, one after another; `agent` names who answers, in rows that do not say."""
    rows = sample.rows
    if agent is not None:
        rows = rows.withColumn("agent_name", F.coalesce(F.col("agent_name"), F.lit(agent)) if "agent_name" in rows.columns else F.lit(agent))
    return Batch(rows, sample.meta).repeat(n)


def varied_groups(rows: DataFrame, group: str = "uid", metric: str = "score") -> DataFrame:
    """Rows of groups whose metric is not the same throughout; one row alone stays."""
    stats = rows.groupBy(F.col(group).alias("__g")).agg(F.min(metric).alias("__lo"), F.max(metric).alias("__hi"), F.count("*").alias("__n")).where("__lo <> __hi or __n = 1")
    return rows.join(stats.select("__g"), F.col(group).eqNullSafe(F.col("__g")), "left_semi")
