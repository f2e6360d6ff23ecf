"""Draws that depend on keys and a seed only, alike in any engine that has md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word(*parts: Column | str | int) -> Column:
    """60 bits of the md5 of the parts as text, joined by colons: a number from 0 to 2^60 - 1. Parts: column names, columns, whole numbers; nulls are passed over."""
    cols = [F.lit(str(p)) if isinstance(p, int) else (F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 15), 16, 10).cast("long")


def word_sql(*parts: str | int) -> str:
    """The same in DuckDB SQL."""
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(str(p) for p in parts)})), 1, 15) AS BIGINT)"
