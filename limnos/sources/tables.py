"""Reading and writing tables."""

from __future__ import annotations

import csv
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from limnos.functions.columns import fold_nan


#: Names that are words of the statistics language, which get a dot behind them.
RESERVED = {"if", "else", "repeat", "while", "function", "for", "next", "break", "TRUE", "FALSE", "NULL", "Inf", "NaN", "NA",
            "NA_integer_", "NA_real_", "NA_character_", "in"}


def dotted_names(names: Sequence[str]) -> list[str]:
    """Column names as a data frame of the statistics language has them: "Sechi Depth (M)" is Sechi.Depth..M., a second DOC is DOC.1.

    Every character other than letters, digits, dot and underscore becomes a dot; a name that does not start with a letter, or with a dot
    and no digit behind it, gets an X in front; reserved words get a dot behind; repeated names are numbered from the second on.
    """
    out: list[str] = []
    plain = []
    for name in names:
        name = "".join(c if c.isalnum() or c in "._" else "." for c in name)
        if not re.match(r"[^\W\d_]|\.(?!\d)", name):
            name = "X" + name
        plain.append(name + "." if name in RESERVED else name)
    taken, number = set(plain), dict.fromkeys(plain, 0)
    for i, name in enumerate(plain):
        if name in plain[:i]:
            while f"{name}.{number[name] + 1}" in taken:
                number[name] += 1
            number[name] += 1
            name = f"{name}.{number[name]}"
            taken.add(name)
        out.append(name)
    return out


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header; NA and empty text are missing, NaN too; names are those of `dotted_names`.

    `schema` gives the columns in the file's order, by their written or their dotted names; a header with others is an error. Without it
    all columns are text. Numeric columns that hold other text are best declared string and read with `to_number`.
    """
    first = spark.read.text(path).first()
    header = next(csv.reader([first[0].removeprefix("\ufeff")])) if first else schema.names if schema else []
    names = dotted_names(header)
    kinds = [T.StringType()] * len(names) if schema is None else [f.dataType for f in schema.fields]
    if schema is not None and dotted_names(schema.names) != names:
        raise ValueError(f"the header of {path} is {header}, the schema has {schema.names}")
    places = T.StructType([T.StructField(f"c{i}", kind) for i, kind in enumerate(kinds)])
    rows = spark.read.schema(places).option("header", True).option("nullValue", "NA").option("emptyValue", None).option("enforceSchema", True).csv(path)
    return fold_nan(rows).toDF(*names)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Saved frame (parquet), NaN folded to NULL."""
    return fold_nan(spark.read.parquet(path))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, one file per partition; missing is written as NA."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "NA").csv(path)


def write_stage(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Save a slow intermediate result and go on from the written table."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


def rewrite(df: DataFrame, root: str) -> DataFrame:
    """Write a frame, which may come from an older folder under `root`, to a new folder there and read it back.

    What was read before stays as it is; the caller goes on from the returned frame.
    """
    return write_stage(df, f"{root.rstrip('/')}/v-{uuid.uuid4().hex}")


def literal_rows(df: DataFrame, rows: list[tuple]) -> DataFrame:
    """Append rows typed by the schema of `df`."""
    return df.unionByName(df.sparkSession.createDataFrame(rows, df.schema))
