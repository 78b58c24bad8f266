"""Nested records as flat parent and child tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


def flatten(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Structs as columns outer__inner, at any depth, in order. Columns in keep stay as they are; two columns of one name are an error."""

    def leaves(column: Column, name: str, kind: object) -> list[tuple[str, Column]]:
        if not isinstance(kind, StructType) or name in keep:
            return [(name, column)]
        return [leaf for f in kind.fields for leaf in leaves(column.getField(f.name), f"{name}__{f.name}", f.dataType)]

    found = [leaf for f in df.schema.fields for leaf in leaves(F.col(f"`{f.name}`"), f.name, f.dataType)]
    names = [name.lower() for name, _ in found]
    if len(set(names)) < len(names):
        raise ValueError(f"columns of one name: {sorted({n for n in names if names.count(n) > 1})}")
    return df.select(*(column.alias(name) for name, column in found))


def normalize_nested(df: DataFrame, key: list[str], name: str = "rows") -> dict[str, DataFrame]:
    """Tables by name: the parent, and a child name__list for each list, at any depth.

    A child has its parent's key as _key_<column>, its place in each list on the
    way (_pos, _pos2, ...; from 0), and its element: a struct's fields, or value.
    Null and empty lists have no children, a null element has one row of nulls.
    Keys must be columns without lists; maps stay whole. Each table is a
    projection of df: none shuffles.
    """
    return _tables(flatten(df, key), key, name, 1)


def _tables(flat: DataFrame, key: list[str], name: str, depth: int) -> dict[str, DataFrame]:
    lists = [f.name for f in flat.schema.fields if isinstance(f.dataType, ArrayType) and f.name not in key]
    out = {name: flat.drop(*(f"{c}" for c in lists))}
    pos = "_pos" if depth == 1 else f"_pos{depth}"
    keys = [k if k.startswith(("_key_", "_pos")) else f"_key_{k}" for k in key]
    for c in lists:
        rows = flat.select(*(F.col(f"`{k}`").alias(new) for k, new in zip(key, keys, strict=True)), F.posexplode(f"`{c}`").alias(pos, "value"))
        kind = rows.schema["value"].dataType
        fields = [F.col("value").getField(f.name).alias(f.name) for f in kind.fields] if isinstance(kind, StructType) else [F.col("value")]
        child = rows.select(*(f"`{k}`" for k in (*keys, pos)), *fields)
        out |= _tables(flatten(child, [*keys, pos]), [*keys, pos], f"{name}__{c}", depth + 1)
    return out


def replace_children(stored: DataFrame, changed: DataFrame, parents: DataFrame, key: list[str]) -> DataFrame:
    """stored children, with those of the changed parents replaced by the new ones in changed: a parent that lost all of its children has none. key: the parent's columns in parents; _key_<column> in children. Null keys are equal."""
    gone = parents.select(*(F.col(k).alias(f"__{k}") for k in key)).distinct()
    same = [F.col(f"_key_{k}").eqNullSafe(F.col(f"__{k}")) for k in key]
    return stored.join(gone, same, "left_anti").unionByName(changed)
