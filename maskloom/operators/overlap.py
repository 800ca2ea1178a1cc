"""Interval joins inside a document.

Both sides are cut into fixed character buckets and joined by equality on
(document, bucket). The work per key stays local even when one document is huge, and
every overlapping pair is reported once: in the bucket where the overlap begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    left_span: tuple[str, str] = ("start", "end"),
    right_span: tuple[str, str] = ("start", "end"),
    how: str = "inner",
    width: int = 64,
) -> DataFrame:
    """Pairs of rows of the same document whose half-open spans overlap.

    Columns of the two sides must differ except for `document`. `how` is "inner"; "left", which adds left
    rows without any pair once, with nulls; or "padded", which costs no second join and gives a row of
    nulls for every bucket of a left span without a pair: enough where an aggregate per left row follows.
    """
    ls, le = left_span
    rs, re_ = right_span
    a = left.withColumn("_bucket", _buckets(F.col(ls), F.col(le), width))
    b = right.withColumn("_bucket", _buckets(F.col(rs), F.col(re_), width)).withColumnRenamed(
        "document", "_document"
    ).withColumnRenamed("_bucket", "_bucket_r")
    begins = F.floor(F.greatest(F.col(ls), F.col(rs)) / width)
    cond = (
        (F.col("document") == F.col("_document"))
        & (F.col("_bucket") == F.col("_bucket_r"))
        & (F.col(ls) < F.col(re_))
        & (F.col(rs) < F.col(le))
        & (begins == F.col("_bucket"))
    )
    pairs = a.join(b, cond, "left" if how == "padded" else "inner").drop("_document", "_bucket", "_bucket_r")
    if how != "left":
        return pairs
    key = ["document", ls, le]
    alone = left.join(pairs.select(*key).distinct(), key, "left_anti")
    return pairs.unionByName(alone, allowMissingColumns=True)


def touched(
    left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], flag: str = "hit"
) -> DataFrame:
    """The left rows, each once, with whether any right span of its document overlaps it.

    One sort per document instead of a join: a span is met if, of the right spans that begin before its end,
    the one that reaches farthest passes its begin. Rows without a document meet nothing.
    """
    (ls, le), (rs, re_) = left_span, right_span
    a = left.withColumns({"_at": (F.col(le) - 1).cast("long"), "_left": F.lit(1), "_reach": F.lit(None).cast("long")})
    b = right.filter("document IS NOT NULL").select(
        "document", F.col(rs).cast("long").alias("_at"), F.lit(0).alias("_left"), F.col(re_).cast("long").alias("_reach")
    )
    w = Window.partitionBy("document").orderBy("_at", "_left").rowsBetween(Window.unboundedPreceding, 0)
    swept = a.unionByName(b, allowMissingColumns=True).withColumn("_reach", F.max("_reach").over(w))
    met = F.coalesce(F.col("_reach") > F.col(ls), F.lit(False))
    return swept.filter("_left = 1").withColumn(flag, met).drop("_at", "_left", "_reach")


def _buckets(start: Column, end: Column, width: int) -> Column:
    first = F.floor(start / width)
    last = F.greatest(F.floor((end - 1) / width), first)
    return F.explode(F.sequence(first, last))
