"""Bulk-load text of relational databases: a line a row, columns parted by tabs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The null mark of the format, and what it writes for the characters that part columns and lines.
NULL = "\\N"
ESCAPES = (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"))


def _field(name: str, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        text = F.when(F.col(name), "t").otherwise("f")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(name)
    else:
        text = F.col(name).cast("string")
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return F.when(F.col(name).isNull(), NULL).otherwise(text)


def copy_lines(df: DataFrame) -> DataFrame:
    """One column ``line``: the row's values as bulk-load text, nulls as \\N. Nested values are written as JSON."""
    return df.select(F.concat_ws("\t", *[_field(f.name, f.dataType) for f in df.schema]).alias("line"))


def write_copy(df: DataFrame, path: str) -> None:
    """Lines of df as text files under path, a file a partition, to be loaded side by side."""
    copy_lines(df).write.mode("overwrite").text(path)


def read_copy(df_like: DataFrame, path: str) -> DataFrame:
    """What write_copy wrote, with the columns of df_like; nested columns come back as JSON text."""
    parts = F.split("value", "\t")
    out = []
    for i, f in enumerate(df_like.schema):
        text = parts[i]
        # Backslashes first become a mark that no line holds, so that \\\\t is a backslash and a t.
        for plain, written in ESCAPES:
            text = F.replace(text, F.lit(written), F.lit("\u0001" if plain == "\\" else plain))
        text = F.when(parts[i] == NULL, None).otherwise(F.replace(text, F.lit("\u0001"), F.lit("\\")))
        nested = isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        out.append((text if nested else text == "t" if isinstance(f.dataType, T.BooleanType) else text.cast(f.dataType)).alias(f.name))
    return df_like.sparkSession.read.text(path).select(*out)
