"""Token ids of documents as flat binary files with 64-bit offsets, and their memory-mapped reader.

A store is a mounted folder with, for shard k, `k.ids` (unsigned little-endian ids of its documents one
after another, 16 bits wide if the vocabulary has at most 65,536 ids, else 32), `k.docs` (signed 64-bit document ids; null is the smallest value) and
`k.offsets` (unsigned 64-bit: where each document starts in the whole store, and the shard's end).
Shards follow the order of document ids. Each shard is written by one task under a temporary name and
renamed, so a repeated task leaves the same file; shard bases are the prefix sums of shard sizes.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.llm.blocks import blocks
from maskloom.llm.encode import encoder, with_end
from maskloom.llm.shared import mounted

NO_ID = -(2**63)


def id_type(tokenizer: str) -> str:
    return "<u2" if len(encoder(tokenizer).width) <= 1 << 16 else "<u4"


def _replace(path: str, attempt: int, *parts) -> None:
    with open(f"{path}.{attempt}", "wb") as f:
        for p in parts:
            f.write(p)
    os.replace(f"{path}.{attempt}", path)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write `docs` (doc_id, text, other columns are ignored) to the store `folder`; returns its shards.

    Null text is an empty document (only the end id); a null doc_id comes first; equal doc_ids stay
    separate documents, ordered by a hash of the text; without rows the store has no shard. The shards
    (shard, base, n_docs, n_tokens) are one row per task, which is what the prefix sum runs over.
    """
    spark, place, width = docs.sparkSession, mounted(folder), id_type(tokenizer)
    os.makedirs(place, exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard, attempt = context.partitionId(), context.taskAttemptId()
        enc, n_docs, n_tokens = encoder(tokenizer), 0, 0
        name = f"{place}/{shard:06d}"
        ids_file = open(f"{name}.ids.{attempt}", "wb")
        keys, sizes = [], []
        with ids_file:
            for batch in batches:
                keys.append(batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8"))
                for block in blocks(batch.column("text")):
                    ids, counts = with_end(*enc.encode(block), end_id)
                    ids_file.write(ids.astype(width))
                    sizes.append(counts)
                    n_docs += len(counts)
                    n_tokens += len(ids)
        if not n_docs:
            os.remove(f"{name}.ids.{attempt}")
            return
        os.replace(f"{name}.ids.{attempt}", f"{name}.ids")
        _replace(f"{name}.docs", attempt, *keys)
        _replace(f"{name}.sizes", attempt, *(s.astype("<u8") for s in sizes))
        yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    shards = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_tie"))
        .repartitionByRange("doc_id", "_tie")
        .sortWithinPartitions("doc_id", "_tie")
        .select("doc_id", "text")
        .mapInArrow(write, "shard long, n_docs long, n_tokens long")
        .collect()  # one row per task
    )
    rows, base = [], 0
    for r in sorted(shards):
        rows.append((r.shard, base, r.n_docs, r.n_tokens))
        base += r.n_tokens
    table = spark.createDataFrame(rows, "shard long, base long, n_docs long, n_tokens long")

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for r in batch.to_pylist():
                name = f"{place}/{r['shard']:06d}"
                until = np.cumsum(np.fromfile(f"{name}.sizes", dtype="<u8"), dtype=np.uint64)
                out = np.concatenate([np.zeros(1, np.uint64), until]) + np.uint64(r["base"])
                _replace(f"{name}.offsets", attempt, out.astype("<u8"))
            yield batch

    spread(table, len(rows)).mapInArrow(offsets, table.schema).collect()
    return table


def spread(shards: DataFrame, n: int) -> DataFrame:
    return shards.repartition(max(1, min(n, 4 * shards.sparkSession.sparkContext.defaultParallelism)), "shard")


def read_token_files(spark: SparkSession, folder: str, shards: DataFrame, n: int, width: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files through memory maps."""
    place = mounted(folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column("shard").to_pylist():
                name = f"{place}/{shard:06d}"
                ids = np.memmap(f"{name}.ids", dtype=width, mode="r")
                starts = np.memmap(f"{name}.offsets", dtype="<u8", mode="r").astype(np.int64)
                keys = np.memmap(f"{name}.docs", dtype="<i8", mode="r")
                at = starts - starts[0]
                for low in range(0, len(keys), 10_000):
                    high = min(low + 10_000, len(keys))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.array(keys[low:high]), mask=np.array(keys[low:high]) == NO_ID),
                            pa.array(starts[low:high]),
                            pa.array(np.diff(starts[low : high + 1])),
                            pa.array([zlib.crc32(ids[at[i] : at[i + 1]].astype("<u4")) for i in range(low, high)], pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return spread(shards, n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the store and return what a reader finds in it."""
    shards = write_token_files(docs, folder, tokenizer, end_id)
    return read_token_files(docs.sparkSession, folder, shards, shards.count(), id_type(tokenizer))
