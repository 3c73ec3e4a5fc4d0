"""Sources and sinks: delimited text with a declared schema, Parquet, and streams of either."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import Table

SEPARATOR, COMMENT = "|", "#"
_TRUE, _FALSE = ("1", "t", "T", "TRUE", "true", "True"), ("0", "f", "F", "FALSE", "false", "False")


def _fail(name: str, kind: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"field {name}: not a {kind}: "), F.coalesce(F.col(f"`{name}`"), F.lit("(nothing)"))))


def _parsed(df: DataFrame, table: Table) -> DataFrame:
    """Text columns -> typed columns. A value that doesn't parse is an error; a time keeps its text and gets a column beside it.

    Rows get __seq, the arrival order within a file; order across files isn't defined."""
    columns = []
    for f in table.fields:
        c = F.col(f"`{f.name}`")
        meta = {"usage": f.usage, "description": f.description, "type": f.type}
        if f.type == "boolean":
            x = F.when(c.isin(*_TRUE), True).when(c.isin(*_FALSE), False).otherwise(_fail(f.name, "boolean").cast("boolean"))
        elif f.type in ("float64", "integer64"):
            x = F.coalesce(F.expr(f"try_cast(`{f.name}` AS {'double' if f.type == 'float64' else 'bigint'})"), _fail(f.name, f.type).cast("double" if f.type == "float64" else "long"))
        else:
            x = F.coalesce(c, F.lit(""))
        if f.usage == "time":
            columns.append(F.coalesce(F.try_to_timestamp(c), _fail(f.name, "time").cast("timestamp")).alias(f"{f.name}__time"))
            meta["time_column"] = f"{f.name}__time"
        columns.append(x.alias(f.name, metadata=meta))
    if not df.isStreaming:
        columns.append(F.monotonically_increasing_id().alias("__seq", metadata={"usage": "sequence"}))
    return df.select(*columns)


def _text_schema(table: Table) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in table.fields])


def read_delimited(spark: SparkSession, path: str, table: Table, separator: str = SEPARATOR) -> DataFrame:
    """Delimited text without a header; # starts a comment, blank lines are skipped, a row of another width is an error."""
    return _parsed(spark.read.schema(_text_schema(table)).option("sep", separator).option("comment", COMMENT).option("mode", "FAILFAST").option("enforceSchema", True).csv(path), table)


def stream_delimited(spark: SparkSession, path: str, table: Table, separator: str = SEPARATOR, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(_text_schema(table)).option("sep", separator).option("comment", COMMENT).option("mode", "FAILFAST")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return _parsed(reader.csv(path), table)


def parse_lines(df: DataFrame, table: Table, separator: str = SEPARATOR) -> DataFrame:
    """Rows of one text column, value, as a socket or message source gives them."""
    kept = df.where((F.trim("value") != "") & ~F.col("value").startswith(COMMENT))
    parts = F.from_csv("value", ", ".join(f"`{f.name}` STRING" for f in table.fields), {"sep": separator, "mode": "FAILFAST"})
    return _parsed(kept.select(parts.alias("p")).select("p.*"), table)


def read_parquet(spark: SparkSession, path: str, time: str | None = None, sequence: str | None = None) -> DataFrame:
    """A Parquet table with usage marks; projection and filters reach the scan."""
    df = spark.read.parquet(path)
    for name, usage in ((time, "time"), (sequence, "sequence")):
        if name:
            df = df.withMetadata(name, {"usage": usage})
    return df


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the folder that spark.checkpoint.dir names; a session on one machine may do without that setting."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = f"file://{tempfile.gettempdir()}"
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def write_delimited(df: DataFrame, path: str, separator: str = SEPARATOR, mode: str = "error") -> None:
    if len(set(df.columns)) != len(df.columns):
        raise ValueError("a file can't have two columns of one name")
    df.write.mode(mode).option("sep", separator).option("header", False).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).parquet(path)
