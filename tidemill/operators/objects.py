"""Object columns: values of several types in one column, as VARIANT, and back to a type of their own where all agree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators.batch import ROW

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def variant(c: Column | str, kind: T.DataType) -> Column:
    """A column of a type as objects."""
    c = F.col(c) if isinstance(c, str) else c
    if isinstance(kind, T.VariantType):
        return c
    return F.to_variant_object(c) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else c.cast("variant")


def _agree(kinds: Sequence[T.DataType]) -> bool:
    plain = [k.simpleString() for k in kinds]
    return len(set(plain)) == 1 or all(isinstance(k, WHOLE) for k in kinds)


def alike(*tables: DataFrame) -> list[DataFrame]:
    """The tables, with columns as objects whose types differ among them (whole numbers of any width do not differ); a table that lacks a column agrees with any."""
    kinds: dict[str, list[T.DataType]] = {}
    for t in tables:
        for f in t.schema.fields:
            kinds.setdefault(f.name, []).append(f.dataType)
    mixed = {c for c, k in kinds.items() if not _agree([x for x in k if not isinstance(x, T.NullType)] or k)}
    return [t.withColumns({f.name: variant(f.name, f.dataType) for f in t.schema.fields if f.name in mixed}) if mixed & set(t.columns) else t for t in tables]


def united(*tables: DataFrame) -> DataFrame:
    """All rows, columns by name; missing ones are null, and those of several types are objects."""
    out = None
    for t in alike(*tables):
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def kind_of(c: Column | str) -> Column:
    """The type of an object, as SQL has it; null for none."""
    return F.schema_of_variant(c)


def identity(c: Column | str) -> Column:
    """Text that equal objects share, and others don't: keys in order, NaN equal to NaN, and numbers equal by value among whole and decimal ones, or among doubles."""
    number = F.regexp_replace(kind_of(c), r"^(BIGINT|DECIMAL\(\d+,\d+\))$", "NUMBER")
    top = F.when(kind_of(c).rlike("^(OBJECT|ARRAY)"), F.lit("")).otherwise(number)
    return F.when(c.isNotNull() if isinstance(c, Column) else F.col(c).isNotNull(), F.concat_ws(":", top, F.to_json(c)))


def same(a: Column, b: Column) -> Column:
    """Whether two objects are equal; nulls are."""
    return identity(a).eqNullSafe(identity(b))


def narrowed(rows: DataFrame, *columns: str) -> DataFrame:
    """rows with those object columns as their own types of which all values agree (found in one aggregate); other columns, and columns of nulls only, stay objects."""
    names = columns or [f.name for f in rows.schema.fields if isinstance(f.dataType, T.VariantType)]
    if not names:
        return rows
    found = rows.agg(*(F.schema_of_variant_agg(F.col(f"`{c}`")).alias(c) for c in names)).first()
    one = {c: found[c].replace("OBJECT<", "STRUCT<") for c in names if found[c] and "VARIANT" not in found[c] and "VOID" not in found[c]}
    return rows.withColumns({c: F.variant_get(F.col(f"`{c}`"), "$", kind) for c, kind in one.items()}) if one else rows


def to_records(rows: DataFrame) -> DataFrame:
    """row_idx, record: each row as JSON, nulls included; objects as what they are."""
    own = [c for c in rows.columns if c != ROW]
    return rows.select(ROW, F.to_json(F.struct(*(f"`{c}`" for c in own)), {"ignoreNullFields": "false"}).alias("record"))


def from_records(records: DataFrame, columns: Sequence[str], record: str = "record") -> DataFrame:
    """The other columns, and those named from JSON records: of the type that all records agree in, else objects. A field that is missing is null; a record that
    can't be read is an error."""
    rest = [c for c in records.columns if c != record]
    parsed = records.withColumn("__v", F.parse_json(record))
    path = lambda c: f'$["{c}"]' if "'" in c else f"$['{c}']"
    fields = [F.variant_get("__v", path(c), "variant").alias(c) for c in columns]
    read = parsed.select(*rest, *fields)
    own = lambda c: F.col(f"`{c}`")
    return narrowed(read.withColumns({c: F.when(~F.is_variant_null(own(c)), own(c)) for c in columns}), *columns)


def collated(rows: DataFrame, size: int, order: str = ROW) -> DataFrame:
    """batch_id and, for each column, an array of its values in order: a row for each `size` rows by row number (the last may have fewer). A batch meets in one task."""
    own = [c for c in rows.columns if c != order]
    turn = lambda a, b: F.when(a[order] < b[order], -1).when(a[order] > b[order], 1).otherwise(0)
    got = rows.withColumn("batch_id", F.floor(F.col(order) / size)).groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct(order, *own)), turn).alias("__x"))
    return got.select("batch_id", *(F.col(f"__x.{c}").alias(c) for c in [order, *own]))
