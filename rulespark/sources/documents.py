"""Reading documents and rules, writing results."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.cursor import RuleError
from ..functions.jsonvalue import parse
from ..operators.validator import strip_comments


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One document per line (gzip by file name), in column json."""
    return spark.read.text(path).select(F.col("value").alias("json"))


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """One document per file, in column json."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("json"))


def checked_json(json: Column) -> Column:
    """(json, error): error for a text that isn't JSON."""
    bad = F.try_parse_json(json).isNull()
    return F.struct(F.when(~bad, json).alias("json"), F.when(bad, F.concat(F.lit("Invalid JSON string "), F.coalesce(json, F.lit("null")))).alias("error"))


@F.pandas_udf(StringType())
def gunzip(data: pd.Series) -> pd.Series:
    """The text of gzipped bytes; null if they aren't."""

    def one(b):
        try:
            return None if b is None else zlib.decompress(b, wbits=31).decode("utf-8")
        except (zlib.error, UnicodeDecodeError):
            return None

    return data.map(one)


def load_rule(spark: SparkSession, path: str) -> str:
    """A rule text of any store, its ### comments cut off; bad JSON is a RuleError."""
    text = strip_comments("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    try:
        parse(text)
    except ValueError as e:
        raise RuleError(f"invalid rule JSON: {e}") from None
    return text


def pretty(json: Column) -> Column:
    """A struct or map as indented JSON, nulls kept; a VARIANT stays on one line."""
    return F.to_json(json, {"pretty": "true", "ignoreNullFields": "false"})
