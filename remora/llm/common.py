"""What the operators share: row keys, Arrow maps, and tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local master may go without; a cluster must name one."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", "") or conf.get("spark.checkpoint.dir", "")
    if not found:
        master = conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = getattr(spark.sparkContext, "_own_shared_dir", "") or f"file://{tempfile.mkdtemp(prefix='remora-')}"
        spark.sparkContext._own_shared_dir = found
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, which cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Removes a table of written() that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for name in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(name).getParent()
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of finished queries, which stay until the driver's JVM collects its garbage."""
    spark.sparkContext._jvm.System.gc()


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches of bounded bytes as well as rows."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return df.mapInArrow(f, schema)


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """The columns of names, where docs has them, and _whole: the whole row in one, so that no other name can clash."""
    kept = [c for c in names if c in docs.columns]
    return docs.select(*kept, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole"))


def keyed(docs: DataFrame, *more: str) -> tuple[DataFrame, bool]:
    """doc_id, text and the columns of more, with _k: unique longs in the order of doc_id (nulls last); whether _k is doc_id itself.

    It is doc_id itself where that is unique and free of nulls. Otherwise rows that share a doc_id
    are ordered by the hash of their text, and whole repeats stay rows of their own.
    """
    docs = docs.select("doc_id", "text", *more)
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("doc_id IS NULL OR n > 1").limit(1).count()
    if not odd:
        return docs.withColumn("_k", F.col("doc_id").cast("long")), True
    ordered = docs.withColumn("_h", F.sha2(F.coalesce("text", F.lit("")), 256))
    ordered = ordered.repartitionByRange(F.col("doc_id").asc_nulls_last(), F.col("_h")).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "_h")
    return written(ordered.withColumn("_k", F.monotonically_increasing_id()).drop("_h"), "keyed"), False


def with_ids(out: DataFrame, docs: DataFrame, unique: bool, key: str = "k") -> DataFrame:
    """out with doc_id in place of the key that keyed() gave."""
    if unique:
        return out.withColumnRenamed(key, "doc_id")
    ids = docs.select(F.col("_k").alias(key), F.col("doc_id").cast("long").alias("doc_id"))
    return out.join(ids, key).select("doc_id", *[c for c in out.columns if c != key])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(ddl))
