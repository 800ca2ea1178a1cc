"""Mixing sources to target weights with DataFrame functions only.

Documents get hash-random keys, are sorted by key within their source through key ranges, and the
running sum of their sizes in that order is cut at the source's budget. A budget above the source's size
takes whole epochs first and cuts the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm.shared import written

#: Words: runs of characters that are neither space nor 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(seed: str, *columns: str) -> Column:
    """Hex digits that depend on the seed and the columns only (null counts as its own value)."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]
    return F.md5(F.concat_ws("|", F.lit(seed), *parts))


def targets(sizes: DataFrame, share: float = SHARE, most: int = MOST_EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Add `target` to (source, source_size, ...): one row per source.

    Sources by code point, null last, weigh `weights` in turn. Together they get `share` of all sizes by
    weight; a source stops at `most` times its size and what is left goes to the others by weight. So all
    sources below their limit get one amount per weight: with sources by rising limit per weight, the
    first amount that does not exceed the limit of the next source.
    """
    every = Window.partitionBy()
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    i = (F.row_number().over(order) - 1) % len(weights)
    rows = sizes.withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (i + 1).cast("int")))
    rows = rows.withColumn("_limit", F.col("source_size") * F.lit(float(most)))
    rising = Window.orderBy(F.col("_limit") / F.col("_weight"), F.col("source").isNull(), F.col("source"))
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum(F.col("source_size").cast("double")).over(every) * share - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))
    weight = F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    rows = rows.withColumn("_amount", left / weight)
    fits = F.when(F.col("_amount") * F.col("_weight") <= F.col("_limit"), F.col("_amount"))
    level = F.first(fits, ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (
        rows.withColumn("_level", level)
        .withColumn("target", F.coalesce(F.least(F.col("_limit"), F.col("_level") * F.col("_weight")), F.col("_limit")))
        .drop("_weight", "_limit", "_amount", "_level")
    )


def _in_order(docs: DataFrame, seed: str) -> DataFrame:
    """(doc_id, source, size, source_size, target, key, start, budget, epochs, rest) of every row."""
    rows = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), random_key(seed, "doc_id").alias("key")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    # key ranges: as many per source as the root of its rows, so neither a range nor the list of ranges is long
    budgets = targets(sizes).withColumn("_parts", F.ceil(F.sqrt("_n"))).withColumnRenamed("source", "_of")
    share_of_key = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    dealt = rows.join(budgets, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    dealt = dealt.withColumn("_part", F.floor(share_of_key * F.col("_parts")))
    ranges = dealt.groupBy("source", "_part").agg(F.sum("size").alias("_size"))
    earlier = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranges.select(
        F.col("source").alias("_of"), F.col("_part").alias("_p"), F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_base")
    )
    inside = Window.partitionBy("source", "_part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_base") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    return (
        dealt.join(bases, F.col("source").eqNullSafe(F.col("_of")) & (F.col("_part") == F.col("_p")))
        .withColumns({"start": start, "epochs": epochs, "rest": budget - epochs * F.col("source_size")})
        .select("doc_id", "source", "size", "source_size", "target", "key", "start", "epochs", "rest")
    )


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, source_size, target, start, taken) of every row of `docs`.

    Size is the number of words, 0 for a null text. `start` is the sum of sizes before the document in its
    source's random order, ties by doc_id and size; `taken` is what the mix takes of it, repeats counted:
    the size for each whole epoch, plus what lies below the rest of the budget. So the sum of `taken`
    is the target rounded to words. Rows with equal keys and sizes are interchangeable. No rows, no result.
    """
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start")))
    taken = F.col("epochs") * F.col("size") + part
    return _in_order(docs, seed).select("doc_id", "source", "size", "source_size", "target", "start", taken.alias("taken"))


def mixed_rows(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it; whole texts.

    A source's budget cuts its random order at one key, so rows are chosen by key and no text moves. The
    document at the cut is taken if at least half of it lies within; rows with its key go with it.
    """
    taken = F.max(F.when(2 * F.col("start") + F.col("size") <= 2 * F.col("rest"), F.col("key")))
    cuts = _in_order(docs, seed).groupBy("source").agg(F.first("epochs").alias("epochs"), taken.alias("last"))
    cuts = written(cuts.select(F.struct("source", "epochs", "last").alias("_cut")))  # of known size when texts are joined
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("source").alias("_source"), random_key(seed, "doc_id").alias("_key"))
    copies = F.col("_cut.epochs") + F.coalesce((F.col("_key") <= F.col("_cut.last")).cast("long"), F.lit(0))
    return (
        rows.join(cuts, F.col("_source").eqNullSafe(F.col("_cut.source")))
        .select("_row", F.explode(F.array_repeat(F.lit(1), copies.cast("int"))))
        .select("_row.*")
    )
