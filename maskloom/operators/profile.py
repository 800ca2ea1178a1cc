"""Profiling of labelled token sets. Results are long-form rows, never one collected set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.functions import text as tx
from maskloom.sources.io import written

NAME_B, NAME_I = "B-NAME_STUDENT", "I-NAME_STUDENT"


def label_counts(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("label").agg(F.count("*").alias("n"))


def label_counts_by_fold(tokens: DataFrame, fold: Column) -> DataFrame:
    """Per fold and label, with totals (null label) and the grand total (both null)."""
    counted = tokens.groupBy(fold.alias("fold"), "label").agg(F.count("*").alias("k"))
    return counted.rollup("fold", "label").agg(
        F.sum("k").alias("n"), F.coalesce(F.sum(F.when(F.col("label") != "O", F.col("k"))), F.lit(0)).alias("n_entity")
    )


def type_shares(tokens: DataFrame) -> DataFrame:
    """Share of every type among all entity labels."""
    counted = (
        tokens.filter("label <> 'O'")
        .groupBy(F.element_at(F.split("label", "-"), -1).alias("type"))
        .agg(F.count("*").alias("n"))
    )
    # One row per type: the window over all of them is tiny.
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def name_summary(tokens: DataFrame) -> DataFrame:
    size = F.length("token_text")
    return (
        tokens.filter(F.col("label").isin(NAME_B, NAME_I))
        .groupBy("label", "token_text")
        .agg(F.count("*").alias("k"))
        .groupBy("label")
        .agg(F.sum("k").alias("n"), F.count("*").alias("n_distinct"), F.min(size).alias("shortest"), F.max(size).alias("longest"))
    )


def odd_names(tokens: DataFrame) -> DataFrame:
    """Distinct names with a sign that is no letter, and names of two letters."""
    t = F.col("token_text")
    return (
        tokens.filter(F.col("label").isin(NAME_B, NAME_I) & (t.rlike("[^a-zA-Z]") | (F.length(t) == 2)))
        .select("label", "token_text")
        .distinct()
    )


def transitions(tokens: DataFrame, distances=(1, 2)) -> DataFrame:
    """How often BB, IB and II occur at each distance."""
    w = Window.partitionBy("document").orderBy("token")
    kind = F.when(F.col("label") == NAME_B, "B").when(F.col("label") == NAME_I, "I")
    rows = tokens.select("document", "token", kind.alias("k"))
    ahead = rows.select("k", *[F.lead("k", d).over(w).alias(f"k{d}") for d in distances])
    pairs = F.array(*[F.struct(F.lit(d).alias("distance"), F.concat("k", f"k{d}").alias("pair")) for d in distances])
    return (
        ahead.select(F.inline(pairs)).filter(F.col("pair").isin("BB", "IB", "II")).groupBy("distance", "pair").agg(F.count("*").alias("n"))
    )


def inside_run_lengths(tokens: DataFrame) -> DataFrame:
    """Lengths above one of runs of I-names, every suffix of a run counted."""
    rows = tokens.filter(F.col("label") == NAME_I).select("document", "token")
    w = Window.partitionBy("document").orderBy("token")
    runs = rows.withColumn("_run", F.col("token") - F.row_number().over(w))
    sizes = runs.groupBy("document", "_run").agg(F.count("*").alias("size"))
    return (
        sizes.filter("size > 1")
        .groupBy("size").agg(F.count("*").alias("k"))
        .select("k", F.explode(F.sequence(F.lit(2), F.col("size").cast("int"))).alias("length"))
        .groupBy("length").agg(F.sum("k").alias("n"))
    )


def site(url: Column) -> Column:
    return (
        F.when(url.contains("youtube.com") | url.contains("youtu.be"), "youtube")
        .when(url.contains("linkedin.com"), "linkedin")
        .when(url.contains("facebook") | url.contains("fb.com"), "facebook")
        .otherwise(F.lit("other"))
    )


def domain_ending(url: Column) -> Column:
    """What follows the first dot of the host."""
    after_www = F.substring_index(F.regexp_replace(url, r"^.*?www\.", ""), "/", 1)
    after_scheme = F.substring_index(F.regexp_replace(url, "^.*?://", ""), "/", 1)
    host = F.when(url.contains("www."), after_www).when(url.contains("://"), after_scheme).otherwise(F.substring_index(url, "/", 1))
    return F.when(url.contains("www.") | url.contains("://"), F.regexp_replace(host, r"^[^.]*\.", "")).otherwise(host)


def path_terms(url: Column) -> Column:
    """Path parts without their file ending."""
    parts = F.slice(F.split(F.regexp_replace(url, "^.*?//", ""), "/"), F.lit(2), F.length(url) + 1)
    named = F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.substring_index(p, ".", 1))
    return F.filter(named, lambda p: p != "")


def file_ending(url: Column) -> Column:
    return F.substring_index(url, ".", -1)


def id_shape(t: Column) -> Column:
    colon = F.substring(t, 1, 2).rlike(r"^\p{L}{1,2}$") & F.substring(t, 1, 5).contains(":")
    return F.when(tx.isdigit(t), "digits").when(colon, "letters_colon").otherwise(F.lit("other"))


def length_histogram(rows: DataFrame, value: str, bins: int = 100) -> DataFrame:
    """Equal bins between the smallest and the largest value; the maximum goes into the last bin.

    The counts of the values are written, since both the ends and the bins read them.
    """
    counted = written(rows.groupBy(value).agg(F.count("*").alias("k")))
    ends = counted.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    at = F.least(F.floor((F.col(value) - lo) * bins / F.greatest(hi - lo, F.lit(1))), F.lit(bins - 1))
    return counted.groupBy(at.alias("bin")).agg(F.sum("k").alias("n"))


def percentiles(rows: DataFrame, value: str, shares=(0.25, 0.5, 0.75, 0.9, 0.95, 1.0)) -> DataFrame:
    """Exact percentiles from value counts, which shrink the data before it is gathered."""
    counted = rows.groupBy(value).agg(F.count("*").alias("k"))
    arr = F.percentile(value, F.array(*[F.lit(s) for s in shares]), F.col("k"))
    return counted.agg(arr.alias("v")).select(
        F.inline(F.arrays_zip(F.array(*[F.lit(s) for s in shares]).alias("share"), F.col("v").alias("value")))
    )


def in_both(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct values with the side they occur on."""
    a = left.select(key).distinct().withColumn("_a", F.lit(True))
    b = right.select(key).distinct().withColumn("_b", F.lit(True))
    side = F.when(F.col("_b").isNull(), "left").when(F.col("_a").isNull(), "right").otherwise(F.lit("both"))
    return a.join(b, key, "full").select(key, side.alias("side"))


def title_candidates(tokens: DataFrame) -> DataFrame:
    """Title-cased texts longer than two, distinct per document."""
    return tokens.filter(tx.istitle(F.col("token_text")) & (F.length("token_text") > 2)).select("document", "token_text").distinct()


def title_share(tokens: DataFrame) -> DataFrame:
    """(n, n_distinct, n_tokens): title candidates of all documents, their distinct texts, and all tokens, from one pass."""
    each = tokens.groupBy("document", "token_text").agg(F.count("*").alias("k"))
    by_text = each.groupBy("token_text").agg(F.count("*").alias("n_documents"), F.sum("k").alias("k"))
    titled = tx.istitle(F.col("token_text")) & (F.length("token_text") > 2)
    marked = by_text.withColumn("titled", titled)
    return marked.agg(
        F.coalesce(F.sum(F.when(F.col("titled"), F.col("n_documents"))), F.lit(0)).alias("n"),
        F.count_if("titled").alias("n_distinct"),
        F.coalesce(F.sum("k"), F.lit(0)).alias("n_tokens"),
    )


def bank_coverage(names: DataFrame, banks: dict[str, Sequence[str]]) -> DataFrame:
    """(bank, n_labelled, n_missing): distinct names, and how many of them each bank lacks; one pass over the names."""
    spark = names.sparkSession
    rows = spark.createDataFrame([(b, n) for b, values in banks.items() for n in values], "bank STRING, token_text STRING")
    held = rows.groupBy("token_text").agg(F.collect_set("bank").alias("_banks"))
    met = names.select("token_text").distinct().join(held, "token_text", "left")
    lacks = lambda b: F.count_if(~F.coalesce(F.array_contains("_banks", b), F.lit(False)))
    wide = met.agg(F.count("*").alias("n_labelled"), *(lacks(b).alias(f"_{b}") for b in banks))
    return wide.select(F.inline(F.array(*[F.struct(F.lit(b).alias("bank"), "n_labelled", F.col(f"_{b}").alias("n_missing")) for b in banks])))


def bank_candidates(tokens: DataFrame, bank: DataFrame) -> DataFrame:
    """Title-cased tokens whose text is in a bank `(value)`; the planner picks the join by size."""
    titled = tokens.filter(tx.istitle(F.col("token_text")))
    return titled.join(bank.select(F.col("value").alias("token_text")).distinct(), "token_text", "left_semi")


def character_vocabulary(tokens: DataFrame) -> DataFrame:
    """(label, char, n); counted per text first, so frequent texts are split once."""
    texts = tokens.groupBy("label", "token_text").agg(F.count("*").alias("k"))
    chars = texts.select("label", "k", F.explode(F.regexp_extract_all("token_text", F.lit(r"(?s)."), F.lit(0))).alias("char"))
    return chars.groupBy("label", "char").agg(F.sum("k").alias("n"))
