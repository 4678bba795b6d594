"""Content-addressed ids over canonical JSON (keys in order, no spaces, nulls left out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType


def canonical(**fields: Column) -> Column:
    """Canonical JSON of an object. Values are strings, whole numbers, or arrays and structs of those."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def stable_id(prefix: str, **fields: Column) -> Column:
    """prefix_ and the first 32 hex digits of the SHA-256 of the fields' canonical JSON."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(canonical(**fields), 256), 1, 32))


def ordered(column: Column, kind: DataType) -> Column:
    """column with the fields of all its structs in the order of their names, as canonical JSON has them."""
    if isinstance(kind, StructType):
        fields = [ordered(column[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(column.isNotNull(), F.struct(*fields))
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, (StructType, ArrayType)):
        return F.transform(column, lambda x: ordered(x, kind.elementType))
    return column


def content_hash(raw_text: Column | None = None, raw_value: Column | None = None, content_ref: Column | None = None) -> Column:
    """SHA-256 of the one payload a content has: text before value before reference."""
    out = None
    for name, value in (("content_ref", content_ref), ("raw_value", raw_value), ("raw_text", raw_text)):
        if value is not None:
            this = F.when(value.isNotNull(), F.sha2(canonical(**{name: value}), 256))
            out = this if out is None else F.coalesce(this, out)
    return out
