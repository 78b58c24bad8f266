"""Records inside columns: JSON arrays, maps, parallel arrays, framed bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_payload(df: DataFrame, col: str, schema: str) -> DataFrame:
    """A row for each record of a JSON array, its fields as columns beside the others. Payloads that don't parse or are empty give no rows."""
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, F.explode(F.from_json(col, f"array<struct<{schema}>>")).alias("_r")).select(*rest, "_r.*")


def map_get(col: str | Column, key: str, kind: str) -> Column:
    """A typed value of a string map; null where the key is missing or the value doesn't fit."""
    return F.try_element_at(F.col(col) if isinstance(col, str) else col, F.lit(key)).try_cast(kind)


def rank_pairs(names: Column, scores: Column) -> Column:
    """(name, score) pairs of two arrays, highest score first, ties by name."""
    pairs = F.zip_with(names, scores, lambda n, s: F.struct((-s).alias("down"), n.alias("name"), s.alias("score")))
    return F.transform(F.array_sort(pairs), lambda x: F.struct(x["name"].alias("name"), x["score"].alias("score")))


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    """Some of a wide table's columns; the scan reads no others."""
    return df.select(*(F.col("`" + c.replace("`", "``") + "`") for c in columns))


def unframe(df: DataFrame, col: str, schema: str, magic: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows with schema_id and the JSON body's fields, rejected rows with a reason) of binary frames: a magic byte, four bytes of schema id, the body."""
    head = F.hex(F.substring(col, 1, 1))
    body = F.from_json(F.expr(f"try_to_binary(hex(substring(`{col}`, 6)), 'hex')").cast("string"), schema)
    reason = F.when(F.col(col).isNull() | (F.length(col) < 5), "too short").when(head != f"{magic:02X}", F.concat(F.lit("unknown magic "), head)).when(body.isNull(), "bad body")
    marked = df.withColumns({"_reason": reason, "_body": body, "schema_id": F.conv(F.hex(F.substring(col, 2, 4)), 16, 10).cast("long")})
    good = marked.where("_reason is null").select(*(c for c in df.columns if c != col), "schema_id", "_body.*")
    bad = marked.where("_reason is not null").select(*df.columns, F.col("_reason").alias("reason"))
    return good, bad
