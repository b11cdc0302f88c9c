"""Tables that are built once in a session and read by many queries: memories, their index and their vectors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_PATHS: dict[tuple[str, str, str] | str, str] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder; a local master may go without, a cluster must name one."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", "") or conf.get("spark.checkpoint.dir", "")
    if found:
        return found.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "local" not in _PATHS:
        _PATHS["local"] = f"file://{tempfile.mkdtemp(prefix='remora-')}"
    return _PATHS["local"]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of its own, where more than one branch of a plan reads it."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """build() as a Parquet table: a snapshot of `source` as it was when this session first asked for it."""
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _PATHS:
        path = f"{folder(spark)}/{key[0]}/{name}-{uuid.uuid4().hex}"
        build().write.parquet(path)
        _PATHS[key] = path
    return spark.read.parquet(_PATHS[key])


def forget(spark: SparkSession, source: str) -> None:
    """The next query builds the tables of `source` anew."""
    for key in [k for k in _PATHS if k[:2] == (spark.sparkContext.applicationId, source)]:
        del _PATHS[key]
