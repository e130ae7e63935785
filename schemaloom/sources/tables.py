"""Written tables: lineage cuts, appends without repeats, outputs that appear only when whole."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where none is set and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set; it has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="schemaloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: computed once, and what follows doesn't depend on lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Something is written at the path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def append_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose keys, null ones compared as equal, aren't in the Parquet table yet."""
    if exists(df.sparkSession, path):
        have = df.sparkSession.read.parquet(path).select(*keys).distinct()
        have = have.toDF(*[f"_have_{k}" for k in keys])
        same = [df[k].eqNullSafe(have[f"_have_{k}"]) for k in keys]
        df = df.join(have, same, "left_anti")
    df.write.mode("append").parquet(path)
