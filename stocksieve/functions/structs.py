"""Schema-level helpers: struct flattening, column-name normalisation and
conforming a DataFrame to a target schema (additive evolution).

These only inspect the schema on the driver; the data work stays a
single projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs -> top-level columns named by their dotted path
    (``a.b.c``), like a JSON normaliser.  Arrays and maps stay as they are."""
    cols = []

    def walk(dtype: T.DataType, path: list[str]):
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                walk(f.dataType, [*path, f.name])
        else:
            ref = F.col(path[0])
            for p in path[1:]:
                ref = ref.getField(p)
            cols.append(ref.alias(sep.join(path)))

    for field in df.schema.fields:
        walk(field.dataType, [field.name])
    return df.select(*cols)


def normalised_name(name: str, max_len: int | None = 59) -> str:
    out = name.lower().replace(" ", "_")
    return out[:max_len] if max_len else out


def normalise_columns(df: DataFrame, max_len: int | None = 59) -> DataFrame:
    """Lower-case, spaces to ``_``, cut to ``max_len``; refuses names that
    collide after normalisation instead of silently merging them."""
    new = [normalised_name(c, max_len) for c in df.columns]
    seen: dict[str, str] = {}
    for old, n in zip(df.columns, new):
        if n in seen:
            raise ValueError(f"columns {seen[n]!r} and {old!r} both normalise to {n!r}")
        seen[n] = old
    return df.toDF(*new)


def conform(df: DataFrame, schema: T.StructType, keep_extra: bool = False) -> DataFrame:
    """Project ``df`` onto ``schema``: missing columns become typed nulls,
    present ones are cast, names are matched case-insensitively."""
    by_lower = {c.lower(): c for c in df.columns}
    cols = []
    for f in schema.fields:
        src = by_lower.get(f.name.lower())
        ref = F.col(f"`{src}`") if src else None
        cols.append((ref.cast(f.dataType) if src else F.lit(None).cast(f.dataType)).alias(f.name))
    if keep_extra:
        wanted = {f.name.lower() for f in schema.fields}
        cols += [F.col(f"`{c}`") for c in df.columns if c.lower() not in wanted]
    return df.select(*cols)


def union_evolving(frames: list[DataFrame]) -> DataFrame:
    """Row-concatenate frames whose columns differ (by name, missing ->
    null), e.g. per-source pieces of one target table."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
