"""User functions over Arrow batches, and image features."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def apply_struct(df: DataFrame, cols: list[str], fn: Callable[..., pd.DataFrame], schema: str) -> DataFrame:
    """df with the fields of a struct that fn makes of batches of cols, as columns."""

    def call(*series: pd.Series) -> pd.DataFrame:
        return fn(*series)

    call.__annotations__ = {"return": pd.DataFrame} | {}
    made = F.pandas_udf(call, f"struct<{schema}>", F.PandasUDFType.SCALAR)
    return df.withColumn("_s", made(*cols)).select(*df.columns, "_s.*")


def apply_batch(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """fn over each Arrow batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield fn(pdf)

    return df.mapInPandas(run, schema)


def apply_rows(df: DataFrame, fn: Callable[[tuple], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows that fn yields for each row (a named tuple of df's columns); some, one or none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.strip().split(" ")[0].strip(":") for x in schema.split(",")]
        for pdf in batches:
            yield pd.DataFrame([out for row in pdf.itertuples(index=False) for out in fn(row)], columns=names)

    return df.mapInPandas(run, schema)


class Runs:
    """Table function: the runs of equal values in each partition of its table argument, in that argument's order.

    Arguments: the table, the value's column, the least length of a run. Gives
    the partition's first column, value, n and the place of the run's first row
    in its partition; the type of the first column is the table's.
    Not by Arrow, which would make a pandas frame of each row's result.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, value: AnalyzeArgument, least: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable or value.value not in table.dataType.names:
            raise ValueError("runs_of takes a table and the name of one of its columns")
        first = table.dataType.fields[0]
        return AnalyzeResult(StructType([StructField(first.name, first.dataType), StructField("value", StringType()), StructField("n", LongType()), StructField("at", LongType())]))

    def __init__(self) -> None:
        self.key = self.value = None
        self.n = self.seen = 0
        self.least = 1
        self.found: list[tuple] = []  # given out together: each row's result is a message of its own

    def eval(self, row: Row, value: str, least: int) -> list[tuple] | None:
        now, out = row[value], None
        if self.n and now == self.value:
            self.n += 1
        else:
            if self.n >= max(least, 1):
                self.found.append((self.key, self.value, self.n, self.seen - self.n))
                if len(self.found) == 1000:
                    out, self.found = self.found, []
            self.n, self.value = 1, now
            self.key, self.least = row[0], least
        self.seen += 1
        return out

    def terminate(self) -> list[tuple]:
        last = [(self.key, self.value, self.n, self.seen - self.n)] if self.n >= max(self.least, 1) else []
        return self.found + last


def runs_of(df: DataFrame, key: str, order: str, value: str, least: int = 1) -> DataFrame:
    """key, value, n, at: the runs of equal values of at least that length in each key's rows, in order."""
    function = F.udtf(Runs, useArrow=False)
    table = df.select(key, order, F.col(value).cast("string").alias(value)).asTable()
    return function(table.partitionBy(key).orderBy(order), F.lit(value), F.lit(least))


def register_runs(spark: SparkSession) -> None:
    """runs_of(TABLE(...) PARTITION BY ... ORDER BY ..., 'value', least) for SQL."""
    spark.udtf.register("runs_of", F.udtf(Runs, useArrow=False))


#: Palette that a pixel's colour is named by.
COLOURS = {"red": (220, 40, 40), "green": (40, 180, 60), "blue": (50, 80, 210), "yellow": (235, 215, 60), "white": (245, 245, 245), "black": (15, 15, 15), "grey": (128, 128, 128)}


def image_features(df: DataFrame, pixels: str) -> DataFrame:
    """df with colour (the palette's nearest to most pixels), brightness and saturation (means, 0 to 1) of pixel arrays of r, g, b bytes; null without pixels."""
    names, palette = list(COLOURS), np.array(list(COLOURS.values()), float)

    def measure(column: pd.Series) -> pd.DataFrame:
        out: list[tuple] = [(None, None, None)] * len(column)
        flats = list(column)
        sizes = np.array([0 if x is None else len(x) // 3 for x in flats], int)
        for n in np.unique(sizes[sizes > 0]):  # pictures of one size together, of 100,000 pixels or one picture at a time
            places = np.flatnonzero(sizes == n)
            step = max(1, 100_000 // int(n))
            for part in (places[s : s + step] for s in range(0, len(places), step)):
                rgb = np.stack([np.asarray(flats[i], float)[: n * 3] for i in part]).reshape(len(part), n, 3)
                near = ((rgb[:, :, None] - palette) ** 2).sum(axis=3).argmin(axis=2)
                colour = np.stack([(near == c).sum(axis=1) for c in range(len(names))]).argmax(axis=0)
                high, low = rgb.max(axis=2), rgb.min(axis=2)
                bright, grey = high.mean(axis=1) / 255, np.where(high > 0, (high - low) / np.maximum(high, 1), 0).mean(axis=1)
                for i, c, x, y in zip(part, colour, bright, grey, strict=True):
                    out[i] = (names[c], round(float(x), 6), round(float(y), 6))
        return pd.DataFrame(out, columns=["colour", "brightness", "saturation"])

    return apply_struct(df, [pixels], measure, "colour string, brightness double, saturation double")
