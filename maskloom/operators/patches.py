"""Corrections to gold labels, version diffs and label remaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["document", "token"]


def patch_labels(tokens: DataFrame, patches: DataFrame) -> DataFrame:
    """Apply `(document, nr, match_kind, pattern, only_label, new_label)`; the last match wins, for all rows of a token.

    The patches of a document meet its tokens in a window, as one row, and every token tests those of its document.
    Rows that are dealt by document stay where they are: no token is shuffled. Both windows share one sort.
    """
    patch = F.struct("nr", "match_kind", "pattern", "only_label", "new_label")
    wanted = patches.filter("document IS NOT NULL AND nr IS NOT NULL").groupBy("document").agg(F.collect_list(patch).alias("_patches"))
    whole = Window.partitionBy("document").orderBy("token").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = tokens.withColumn("_row", F.lit(True)).unionByName(wanted, allowMissingColumns=True)
    met = rows.withColumn("_patches", F.first("_patches", True).over(whole)).filter("_row")
    text = F.col("token_text")

    def hit(p: Column) -> Column:
        fits = F.when(p["match_kind"] == "equal", text == p["pattern"]).when(p["match_kind"] == "contains", text.contains(p["pattern"]))
        return fits & (p["only_label"].isNull() | (p["only_label"] == F.col("label")))

    found = F.transform(F.filter("_patches", hit), lambda p: F.struct(p["nr"].alias("nr"), p["new_label"].alias("new")))
    own = F.when(F.col("_patches").isNotNull() & F.col("token").isNotNull(), F.array_max(found))
    last = F.max("_own").over(Window.partitionBy(*KEY))["new"]
    patched = met.withColumn("_own", own).withColumn("label", F.coalesce(last, F.col("label")))
    return patched.select(*tokens.columns)


def merge_tokens(tokens: DataFrame, heads: DataFrame) -> DataFrame:
    """Join each head token with its successor and renumber; text, space and label stay together."""
    w = Window.partitionBy("document").orderBy("token")
    flagged = tokens.join(heads.select(*KEY, F.lit(True).alias("_head")), KEY, "left")
    marked = (
        flagged.withColumn("_head", F.coalesce("_head", F.lit(False)))
        .withColumn("_tail", F.coalesce(F.lag("_head").over(w), F.lit(False)))
        .withColumn("_next", F.lead(F.struct("token_text", "ws")).over(w))
    )
    joined = F.col("_head") & ~F.col("_tail") & F.col("_next").isNotNull()
    gap = F.when(F.col("ws"), F.lit(" ")).otherwise(F.lit(""))
    merged = (
        marked.withColumn("_join", joined)
        .withColumn("_drop", F.coalesce(F.lag("_join").over(w), F.lit(False)))
        .withColumn("token_text", F.when(F.col("_join"), F.concat("token_text", gap, F.col("_next.token_text"))).otherwise(F.col("token_text")))
        .withColumn("ws", F.when(F.col("_join"), F.col("_next.ws")).otherwise(F.col("ws")))
        .filter(~F.col("_drop"))
    )
    return merged.withColumn("token", F.row_number().over(w) - 1).drop("_head", "_tail", "_next", "_join", "_drop")


def label_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Tokens whose label changed between two versions.

    Both versions meet in a window, which takes rows where they are if both are dealt by document. Tokens with one label leave first.
    """
    a = old.select(*KEY, "token_text", F.col("label").alias("old_label"), F.lit(None).cast("string").alias("new_label"), F.lit(True).alias("_old"))
    b = new.select(*KEY, F.lit(None).cast("string").alias("token_text"), F.lit(None).cast("string").alias("old_label"), F.col("label").alias("new_label"), F.lit(False).alias("_old"))
    same, label = Window.partitionBy(*KEY), F.coalesce("old_label", "new_label")
    met = a.unionByName(b).dropna(subset=KEY).withColumns({"_least": F.min(label).over(same), "_most": F.max(label).over(same)})
    changed = met.filter("_least <> _most").withColumn("_new", F.collect_list("new_label").over(same))
    pairs = changed.filter("_old").select(*KEY, "token_text", "old_label", F.explode("_new").alias("new_label"))
    return pairs.filter("old_label <> new_label")


def keep_labels(label: Column, kept) -> Column:
    """All other labels become `O`."""
    return F.when(label.isin(*kept), label).otherwise(F.lit("O"))


def remap_tags(tag: Column, mapping: dict[int, str]) -> Column:
    """Numeric tags to names, unknown ones to `O`."""
    out = F.lit("O")
    for number, name in mapping.items():
        out = F.when(tag == number, F.lit(name)).otherwise(out)
    return out


def documents_with(tokens: DataFrame, wanted: Column) -> DataFrame:
    """All tokens of the documents that have a wanted token."""
    return tokens.join(tokens.filter(wanted).select("document").distinct(), "document", "left_semi")
