"""Cross-site boilerplate lines by distinct-site spread, with DataFrame functions only.

Every line hash gets a HyperLogLog sketch of the sites that hold it; sketches merge in the aggregation.
Lines whose estimate lies near the threshold get an exact distinct count. Lines on enough sites go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.llm.shared import removed, written

#: A line on this many distinct sites is boilerplate.
MIN_SITES = 5
#: Logarithm of the number of sketch registers, and the relative distance from the threshold that is counted exactly.
LOG_K = 8
NEAR = 0.5
#: What a line needs to be looked at: a word.
WORD = r"[^\x20\x09-\x0D]"


def lines_of(text: Column) -> Column:
    """Lines of a text, empty ones included; null has none."""
    return F.coalesce(F.split(text, "\n"), F.array().cast("array<string>"))


def line_key(line: Column) -> Column:
    """Lines are equal when they match but for white space at the ends and upper case."""
    return F.xxhash64(F.lower(F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")))


def text_key(text: Column) -> Column:
    """What lines are removed depends on the text only, so equal texts share their result."""
    return F.struct(F.xxhash64(text).alias("h"), F.length(text).alias("n"))


def site_lines(docs: DataFrame, site: str, text: str = "text") -> DataFrame:
    """(text_key, site, at, key): lines with a word. Rows without a site count as one site."""
    line = F.posexplode(lines_of(F.col(text))).alias("at", "line")
    return (
        docs.select(text_key(F.col(text)).alias("text_key"), F.coalesce(F.col(site), F.lit("")).alias("site"), line)
        .filter(F.col("line").rlike(WORD))
        .select("text_key", "site", "at", line_key(F.col("line")).alias("key"))
    )


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(key): hashes of lines on at least `min_sites` distinct sites."""
    spread = written(
        lines.groupBy("key")
        .agg(F.hll_sketch_agg("site", LOG_K).alias("_sites"), F.count("*").alias("_n"))
        .filter(F.col("_n") >= min_sites)
        .select("key", F.hll_sketch_estimate("_sites").alias("_estimate"))
        .filter(F.col("_estimate") >= min_sites * (1 - NEAR))
    )
    clear = spread.filter(F.col("_estimate") > min_sites * (1 + NEAR)).select("key")
    near = spread.filter(F.col("_estimate") <= min_sites * (1 + NEAR)).select("key")
    # a line meets the near ones once for each of its sites, however often it occurs
    exact = (
        lines.select("key", "site")
        .distinct()
        .join(near, "key", "left_semi")
        .groupBy("key")
        .agg(F.count("*").alias("_n"))
        .filter(F.col("_n") >= min_sites)
        .select("key")
    )
    return clear.unionByName(exact)


def without_boilerplate(docs: DataFrame, site: str = "source", text: str = "text", min_sites: int = MIN_SITES) -> DataFrame:
    """All rows and columns of `docs` (one named `_lines` is replaced), and struct `_lines` (n_lines, n_found, n_removed, kept).

    `n_found` counts lines on at least `min_sites` sites, `kept` is the text without them. A document of which
    every line with a word is found is a copy, not a page with boilerplate: it stays whole, for near-duplicate
    removal to judge. Null text: 0 lines, `kept` null. Repeated rows and null ids are rows of their own.
    Documents meet their lines by text, so copies cost one entry; the hot ones are split by the adaptive
    join. Texts move once, by the same plan at every size.
    """
    lines = written(site_lines(docs, site, text))
    wide = written(boilerplate(lines, min_sites))
    found = written(
        lines.select("text_key", "at", "key")
        .distinct()
        .join(wide, "key", "left_semi")
        .groupBy("text_key")
        .agg(F.sort_array(F.collect_set("at")).alias("_at"))
    )
    removed(lines, wide)
    others = [c for c in docs.columns if c not in (text, "_lines")]
    row = F.struct(*(f"`{c}`" for c in others)) if others else F.lit(None)
    rows = docs.select(row.alias("_row"), F.col(text).alias("_text"), text_key(F.col(text)).alias("text_key"))
    rows = rows.join(found.hint("merge"), "text_key", "left")
    at = F.coalesce(F.col("_at"), F.array().cast("array<int>"))
    rows = rows.withColumn("_all", lines_of(F.col("_text"))).withColumn("_at", at)
    positions = F.array_except(F.sequence(F.lit(0), F.size("_all") - 1), F.col("_at"))
    rest = F.array_join(F.transform(positions, lambda i: F.get(F.col("_all"), i)), "\n")
    rows = rows.withColumn("_rest", F.when(F.size("_at") > 0, rest))
    drop = F.coalesce(F.col("_rest").rlike(WORD), F.lit(False))
    result = F.struct(
        F.size("_all").cast("long").alias("n_lines"),
        F.size("_at").cast("long").alias("n_found"),
        F.when(drop, F.size("_at")).otherwise(0).cast("long").alias("n_removed"),
        F.when(drop, F.col("_rest")).otherwise(F.col("_text")).alias("kept"),
    )
    columns = [F.col("_text").alias(c) if c == text else F.col(f"_row.`{c}`") for c in docs.columns if c != "_lines"]
    return rows.select(*columns, result.alias("_lines"))
