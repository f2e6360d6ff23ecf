"""Datasets of users' own as Spark data sources, and one for prompt and rollout files, at rest or as they come.

`rows` reads Parquet files and JSON lines in parts of about `splitBytes` bytes: of Parquet the row groups that begin in a part, of JSON
lines the lines that do, so files are neither read nor measured on the driver, which only lists them. A task reads one part, or
several small ones of a file, one after another, up to TASK_BYTES, if there are more than TASKS. Filters go down to the row
groups; of a schema that is given, only its columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

from tidemill.functions.registry import Registry
from tidemill.session import ship

DATASETS = Registry("dataset")
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
SPLIT_BYTES, TASK_BYTES, TASKS, BATCH_ROWS = 32 << 20, 4 << 20, 64, 8192
KINDS = {"parquet": "parquet", "json": "jsonl", "jsonl": "jsonl"}


def _store(path: str) -> tuple[Any, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def files(paths: str) -> list[tuple[str, int]]:
    """Path and size of the files that paths (one or several, separated by commas) name or hold, by name; hidden ones, and those of no bytes, aside."""
    from pyarrow import fs

    out = []
    for path in filter(None, (p.strip() for p in paths.split(","))):
        store, inside = _store(path)
        info = store.get_file_info(inside)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inside, recursive=True))
        prefix = path[: len(path) - len(inside)] if path.endswith(inside) else ""
        base = 0 if info.type == fs.FileType.File else len(inside)
        out += [(prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and f.size and not any(p[:1] in "._" for p in f.path[base:].strip("/").split("/"))]
    return sorted(out)


@dataclass
class Part(D.InputPartition):
    """Of a file what begins from byte `start` on and before `end`."""

    path: str
    kind: str
    start: int
    end: int


def expression(f: D.Filter) -> pc.Expression | None:
    """The filter for Arrow, where it means the same there: not for fractions, whose NaN Arrow orders otherwise, and not within structs."""
    if isinstance(f, D.Not):
        inner = expression(f.child)
        if inner is not None and isinstance(f.child, D.In):  # Arrow has it that null is in no list
            return ~inner & pc.field(f.child.attribute[0]).is_valid()
        return None if inner is None else ~inner
    if len(f.attribute) != 1:
        return None
    field, value = pc.field(f.attribute[0]), getattr(f, "value", None)
    if isinstance(f, D.IsNull):
        return field.is_null()
    if isinstance(f, D.IsNotNull):
        return field.is_valid()
    plain = lambda v: isinstance(v, (bool, int, str))
    if isinstance(f, D.In):
        return field.isin(list(value)) if all(map(plain, value)) else None
    if not plain(value):
        return None
    if isinstance(f, D.StringStartsWith):
        return pc.starts_with(field, value)
    for kind, compare in ((D.EqualTo, field.__eq__), (D.GreaterThan, field.__gt__), (D.GreaterThanOrEqual, field.__ge__), (D.LessThan, field.__lt__), (D.LessThanOrEqual, field.__le__)):
        if type(f) is kind:
            return compare(value)
    return None


class RowReader(D.DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.paths, self.kind = options["path"], options.get("kind")
        self.split, self.schema = int(options.get("splitBytes", SPLIT_BYTES)), schema
        self.filters: list[D.Filter] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            if expression(f) is None:
                yield f
            else:
                self.filters.append(f)

    def parts(self, found: Sequence[tuple[str, int]]) -> list[Part]:
        width = self.split * max(1, min(TASK_BYTES, sum(size for _, size in found) // TASKS) // self.split)
        return [Part(path, _kind(path, self.kind), at, min(at + width, size)) for path, size in found for at in range(0, size, width)]

    def partitions(self) -> Sequence[D.InputPartition]:
        return self.parts(files(self.paths)) or [Part("", "none", 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if part.kind == "none":
            return
        target = to_arrow_schema(self.schema)
        keep = None
        for f in self.filters:
            e = expression(f)
            keep = e if keep is None else keep & e
        if part.kind == "parquet":
            found = _parquet(part, target, keep)
        else:
            ends = ((at, min(at + self.split, part.end)) for at in range(part.start, part.end, self.split))
            found = _together(b for a, z in ends for b in _lines(Part(part.path, part.kind, a, z), target, keep))
        for batch in found:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, target)], schema=target)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about BATCH_ROWS."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BATCH_ROWS:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _kind(path: str, given: str | None) -> str:
    kind = KINDS.get((given or path.rsplit(".", 1)[-1]).lower())
    if kind is None:
        raise ValueError(f"{path!r}: neither Parquet nor JSON lines; say which by the option `kind`")
    return kind


def _parquet(part: Part, target: pa.Schema, keep: pc.Expression | None) -> Iterator[pa.RecordBatch]:
    import pyarrow.dataset as ds
    import pyarrow.parquet as pq

    store, inside = _store(part.path)
    meta = pq.read_metadata(inside, filesystem=store)

    def begins(g: int) -> int:
        first = meta.row_group(g).column(0)
        return min(first.data_page_offset, first.dictionary_page_offset or first.data_page_offset)

    # a row group belongs to the part in which it begins
    groups = [g for g in range(meta.num_row_groups) if part.start <= begins(g) < part.end]
    if groups:
        fragment = ds.ParquetFileFormat().make_fragment(inside, filesystem=store, row_groups=groups)
        if keep is not None:
            fragment = fragment.subset(keep, schema=target)
        yield from fragment.to_batches(schema=target, columns=target.names, filter=keep, batch_size=BATCH_ROWS)


def _lines(part: Part, target: pa.Schema, keep: pc.Expression | None) -> Iterator[pa.RecordBatch]:
    from pyarrow import json

    store, inside = _store(part.path)
    with store.open_input_file(inside) as f:
        f.seek(max(0, part.start - 1))
        body = f.read(part.end - max(0, part.start - 1))
        if part.start:
            cut = body.find(b"\n")
            body = body[cut + 1 :] if cut >= 0 else b""  # the first line of the part, if any, begins after this
        if body and not body.endswith(b"\n"):  # the last line that begins here may end in the next part
            more = [body]
            while chunk := f.read(1 << 16):
                cut = chunk.find(b"\n")
                more.append(chunk if cut < 0 else chunk[:cut])
                if cut >= 0:
                    break
            body = b"".join(more)
    if not body.strip():
        return
    options = json.ParseOptions(explicit_schema=target, unexpected_field_behavior="ignore")
    table = json.read_json(pa.BufferReader(body), json.ReadOptions(block_size=max(1 << 20, len(body) + 1), use_threads=False), options).select(target.names)
    yield from (table.filter(keep) if keep is not None else table).to_batches(max_chunksize=BATCH_ROWS)


class RowStream(D.DataSourceStreamReader):
    """The offset is the greatest name read so far, so new files must come by ascending names, as those of numbered steps do; each is read once, restarts included."""

    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.reader = RowReader(options, schema)

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        found = files(self.reader.paths)
        return {"after": found[-1][0] if found else ""}

    def partitions(self, start: dict, end: dict) -> Sequence[D.InputPartition]:
        return self.reader.parts([f for f in files(self.reader.paths) if start["after"] < f[0] <= end["after"]])

    def read(self, partition: D.InputPartition) -> Iterator[pa.RecordBatch]:
        return self.reader.read(partition)


@DATASETS.register("rows")
class Rows(D.DataSource):
    """Prompt and rollout files. Options: path, kind (parquet or jsonl; else by extension), splitBytes. Without a schema, the first file's."""

    @classmethod
    def name(cls) -> str:
        return "tidemill_rows"

    def schema(self) -> T.StructType:
        import pyarrow.parquet as pq
        from pyarrow import json
        from pyspark.sql.pandas.types import from_arrow_schema

        found = files(self.options["path"])
        if not found:
            raise ValueError(f"no files in {self.options['path']!r}, so a schema is needed")
        store, inside = _store(found[0][0])
        if _kind(found[0][0], self.options.get("kind")) == "parquet":
            return from_arrow_schema(pq.read_schema(inside, filesystem=store))
        with store.open_input_file(inside) as f:
            head = f.read(1 << 20)
        return from_arrow_schema(json.read_json(pa.BufferReader(head[: head.rfind(b"\n") + 1] or head)).schema)

    def reader(self, schema: T.StructType) -> D.DataSourceReader:
        return RowReader(self.options, schema)

    def streamReader(self, schema: T.StructType) -> D.DataSourceStreamReader:
        return RowStream(self.options, schema)


def dataset_class(source: str | type, file: str | None = None) -> type:
    """A registered dataset by its name, a class, or a class of a Python file; a TypeError if it is no DataSource."""
    from tidemill.functions.extensions import load_function

    cls = load_function(file, source) if file else DATASETS[source] if isinstance(source, str) else source
    if not (isinstance(cls, type) and issubclass(cls, D.DataSource)):
        raise TypeError(f"{source!r} must be a subclass of pyspark.sql.datasource.DataSource")
    return cls


def read_dataset(spark: SparkSession, source: str | type = "rows", schema: T.StructType | str | None = None, stream: bool = False, file: str | None = None, **options: Any) -> DataFrame:
    """The rows of a dataset (see dataset_class), its options as given. Columns of the schema that files don't have are null."""
    ship(spark)
    cls = dataset_class(source, file)
    spark.dataSource.register(cls)
    if spark.conf.get(PUSHDOWN, None) != "true":
        spark.conf.set(PUSHDOWN, "true")
    reader = (spark.readStream if stream else spark.read).format(cls.name()).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load()
