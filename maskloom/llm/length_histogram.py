"""Exact histogram of encoded lengths; suffix sums over it answer totals, quantiles and truncated totals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm.blocks import blocks
from maskloom.llm.encode import encoder

#: Lengths per group of the two-level suffix sum.
WIDTH = 1024


def length_counts(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """(length, n_docs): documents by encoded length. Null or empty text has length 0; no rows give no rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            lengths = [enc.encode(b)[1] for b in blocks(batch.column(0))]
            if lengths:
                value, n = np.unique(np.concatenate(lengths), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n)], ["length", "n_docs"])

    found = docs.select(F.col(text)).mapInArrow(count, "length long, n_docs long")
    return found.groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def with_suffix_sums(counts: DataFrame) -> DataFrame:
    """Add, for each occurring length L: tokens, documents and tokens at L or above, and totals when cut at L.

    Suffix sums take two levels: lengths of one group of `WIDTH` in a window, then one row per group.
    `truncated_tokens` is what remains if every document keeps at most L tokens; `share_below` is the
    part of documents shorter than L.
    """
    g = counts.withColumn("_group", F.floor(F.col("length") / WIDTH)).withColumn("n_tokens", F.col("length") * F.col("n_docs"))
    tail = Window.orderBy(F.desc("_group")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    groups = (
        g.groupBy("_group")
        .agg(F.sum("n_docs").alias("_docs"), F.sum("n_tokens").alias("_tokens"))
        .select(
            "_group",
            F.coalesce(F.sum("_docs").over(tail), F.lit(0)).alias("_docs_after"),
            F.coalesce(F.sum("_tokens").over(tail), F.lit(0)).alias("_tokens_after"),
            F.sum("_docs").over(every).alias("_all_docs"),
            F.sum("_tokens").over(every).alias("_all_tokens"),
        )
    )
    inside = Window.partitionBy("_group").orderBy(F.desc("length"))
    out = g.join(groups, "_group").select(
        "length",
        "n_docs",
        "n_tokens",
        (F.sum("n_docs").over(inside) + F.col("_docs_after")).alias("docs_from"),
        (F.sum("n_tokens").over(inside) + F.col("_tokens_after")).alias("tokens_from"),
        "_all_docs",
        "_all_tokens",
    )
    return out.select(
        "length",
        "n_docs",
        "n_tokens",
        "docs_from",
        "tokens_from",
        (F.col("_all_tokens") - F.col("tokens_from") + F.col("length") * F.col("docs_from")).alias("truncated_tokens"),
        ((F.col("_all_docs") - F.col("docs_from")) / F.col("_all_docs")).alias("share_below"),
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the smallest length that at least `share` of the documents do not exceed."""
    up_to = (F.col("share_below") + F.col("n_docs") / (F.col("docs_from") / (1 - F.col("share_below")))).alias("_up_to")
    at = sums.select("length", up_to)
    wanted = [F.min(F.when(F.col("_up_to") >= F.lit(q) - 1e-12, F.col("length"))).alias(str(i)) for i, q in enumerate(shares)]
    pairs = F.explode(F.array(*[F.struct(F.lit(q).alias("share"), F.col(str(i)).alias("length")) for i, q in enumerate(shares)]))
    return at.agg(*wanted).select(pairs.alias("p")).select("p.*")


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, tokens, docs_cut) for any context limits: tokens kept at most, documents longer than the limit."""
    row = [
        F.struct(
            F.lit(c).alias("limit"),
            F.coalesce(F.sum(F.least(F.col("length"), F.lit(c)) * F.col("n_docs")), F.lit(0)).alias("tokens"),
            F.coalesce(F.sum(F.when(F.col("length") > c, F.col("n_docs"))), F.lit(0)).alias("docs_cut"),
        )
        for c in limits
    ]
    return sums.agg(F.array(*row).alias("a")).select(F.explode("a").alias("r")).select("r.*")
