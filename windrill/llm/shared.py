"""Work folders and written tables that every executor can reach.

Lineage is cut with tables written under ``spark.checkpoint.dir``; where that is unset, a session on one machine (tests) gets a
local folder, and a cluster's session is refused. Files that Python workers write go through pyarrow's file systems, so file:, hdfs: and s3: folders all work. A task
writes under a name of its own and reports it in its rows; only reported files are read, so a lost or repeated attempt
leaves nothing but an unread file.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a local[...] session gets a folder of this machine; on a
    cluster no such folder is shared, so that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = f"file://{tempfile.gettempdir()}/windrill-shared-{os.getuid()}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared folder; nothing else uses it."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again."""
    where = work_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def file_system(uri: str):
    """(file system, path) of a folder or file name; a name without a scheme is local."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else os.path.abspath(uri))


def write_file(folder: str, name: str, data: bytes) -> str:
    """Writes one file under a name that no other attempt uses; returns its full name."""
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    own = f"{name}-{uuid.uuid4().hex[:10]}"
    with fs.open_output_stream(f"{path}/{own}") as out:
        out.write(data)
    return f"{folder}/{own}"


def read_file(uri: str) -> bytes:
    fs, path = file_system(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


def drop_folder(uri: str) -> None:
    fs, path = file_system(uri)
    fs.delete_dir(path)


def small(batches, rows: int = 1000):
    """Slices of Arrow batches of at most so many rows, so that what Python holds of them stays small."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one Parquet table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
