"""The cluster's shared folder, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A fresh path below `spark.checkpoint.dir`; where that is unset, a local session gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        base = _LOCAL.setdefault(app, "") or tempfile.mkdtemp(prefix="maskloom-llm-")
        _LOCAL[app] = base
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read again.

    A lost executor then costs no recomputation. Aggregated keys that a skewed table is joined with are
    written too: adaptive execution splits hot keys of a join only if both of its sides come from a plain shuffle.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_path = path
    return table


def removed(*tables: DataFrame) -> None:
    """Delete tables that `written` returned, once nothing will read them again."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def mounted(path: str) -> str:
    """The path as the operating system sees it, for files that are memory-mapped."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a mounted folder, not {path}")
    return url.path
