"""Readers and writers. Every writer takes its path from the caller."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DOCUMENT_SCHEMA = (
    "document STRING, full_text STRING, tokens ARRAY<STRING>, "
    "trailing_whitespace ARRAY<BOOLEAN>, labels ARRAY<STRING>"
)


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder under `spark.checkpoint.dir`, the shared folder of the cluster.

    Only a session without executors of its own may do without one; it gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="maskloom-")


def written(df: DataFrame) -> DataFrame:
    """`df` written once below `scratch_dir` and read again, where several steps read it."""
    path = f"{scratch_dir(df.sparkSession)}/rows"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_path = path
    return table


def removed(table: DataFrame) -> None:
    """Delete a table that `written` returned, once nothing will read it again."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.written_path)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def read_documents_json(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Documents as JSON lines (splittable), or as one array of objects per file."""
    raw = spark.read.schema(DOCUMENT_SCHEMA).json(path, multiLine=array)
    toks = F.transform(
        F.arrays_zip("tokens", "trailing_whitespace", "labels"),
        lambda t: F.struct(
            t["tokens"].alias("text"), t["trailing_whitespace"].alias("ws"), t["labels"].alias("label")
        ),
    )
    return raw.select("document", F.col("full_text").alias("text"), toks.alias("toks"))


def write_documents_json(docs: DataFrame, path: str) -> None:
    """Inverse of `read_documents_json`, JSON lines."""
    docs.select(
        "document",
        F.col("text").alias("full_text"),
        F.col("toks.text").alias("tokens"),
        F.col("toks.ws").alias("trailing_whitespace"),
        F.col("toks.label").alias("labels"),
    ).write.json(path)


def read_parquet_set(spark: SparkSession, *globs: str) -> DataFrame:
    return spark.read.parquet(*globs)


#: A field of a CSV record with the comma before it: quoted (quotes inside are doubled) or plain.
CSV_FIELD = r'(?:^|,)(?:"[^"]*+(?:""[^"]*+)*+"|[^,]*+)'


def csv_records(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """(file, record, fields): the records of all CSV files below `path`, numbered from 0 in each file.

    Files are read by lines, so large ones split. A record ends at a line break outside quotes: a line
    starts inside quotes if an odd number of them precedes it in its file. Counts are taken per block of a file
    and a running sum over a file's blocks joins them, so no task sees a whole file. Blank lines between
    records are passed over.
    """
    lines = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .text(path)
        .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
        .withColumn("at", F.monotonically_increasing_id())
        .withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    )
    before = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("odd", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    # a line opens a record if all quotes before it are closed, which depends on the parity the block starts with
    opens = {f"open{p}": (F.col("odd") == p) & (F.col("value") != "") for p in (0, 1)}
    per_block = lines.groupBy("file", "block").agg((F.sum("quotes") % 2).alias("q"), *(F.count_if(c).alias(k) for k, c in opens.items()))
    blocks = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_block.withColumn("parity", F.coalesce(F.sum("q").over(blocks), F.lit(0)) % 2)
    own = F.when(F.col("parity") == 0, F.col("open0")).otherwise(F.col("open1"))
    starts = starts.select("file", "block", "parity", F.coalesce(F.sum(own).over(blocks), F.lit(0)).alias("base"))
    met = lines.join(starts, ["file", "block"])
    first = (F.col("odd") == F.col("parity")) & (F.col("value") != "")
    numbered = met.withColumn("record", F.col("base") + F.count_if(first).over(within) - 1)
    kept = numbered.filter(first | (F.col("odd") != F.col("parity")))
    whole = kept.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["value"]), "\n")
    raw = F.regexp_extract_all(text, F.lit(CSV_FIELD), F.lit(0))

    def field(x: Column, i: Column) -> Column:
        bare = F.when(i > 0, F.substring(x, F.lit(2), F.length(x))).otherwise(x)
        quoted = F.replace(F.substring(bare, F.lit(2), F.length(bare) - 2), F.lit('""'), F.lit('"'))
        return F.when(bare.startswith('"'), quoted).when(bare != "", bare)

    return whole.select("file", "record", F.transform(raw, field).alias("fields"))


def read_runs_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, needed: str = "cm") -> DataFrame:
    """The named columns (if not given: all that occur), as strings, of all CSV files below `path` that have the column `needed`, and their `run` file.

    Headers are rows like any other: the first record of a file tells where its columns stand, and its other
    records meet that by file. A column that a file lacks is null there; empty fields are null, and `""` is
    an empty text. Files and headers stay in tables; only where no columns are named, the distinct column
    names come to the driver, since a DataFrame needs them.
    """
    records = csv_records(spark, path)
    headers = records.filter("record = 0").filter(F.array_contains("fields", needed)).select("file", F.col("fields").alias("header"))
    rows = records.filter("record > 0").join(headers, "file")
    if columns is None:
        named_once = headers.select(F.explode("header").alias("c")).filter("c IS NOT NULL").distinct().orderBy("c")
        columns = [r.c for r in named_once.collect()]
        if not columns:
            raise ValueError(f"no CSV below {path} has a column {needed}")

    def named(c: str) -> Column:
        return F.when(F.array_contains("header", c), F.get("fields", (F.array_position("header", c) - 1).cast("int"))).alias(c)

    return rows.select(*map(named, columns), F.col("file").alias("run"))


def read_dictionary(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(kind, value): one value per line."""
    return (
        spark.read.text(path)
        .filter(F.length("value") > 0)
        .select(F.lit(kind).alias("kind"), "value")
    )


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_submission(predictions: DataFrame, path: str, text: bool = False) -> None:
    """`row_id, document, token, label[, token_text]` as CSV with header."""
    columns = ["row_id", "document", "token", "label"] + (["token_text"] if text else [])
    predictions.select(*columns).write.csv(path, header=True, quote='"', escape='"')


def write_folds(docs: DataFrame, path: str) -> None:
    """JSON, one folder per fold."""
    docs.write.partitionBy("fold").json(path)


def append_scored(pairs: DataFrame, path: str, run_id: str) -> None:
    """Add the scored pairs of one run under its id."""
    pairs.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)
