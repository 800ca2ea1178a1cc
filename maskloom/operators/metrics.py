"""Confusion marks, F-beta and entity-level scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions.labels import strip_bio
from maskloom.operators.scores import as_columns

KEY = ["document", "token"]


def gold_rows(tokens: DataFrame) -> DataFrame:
    """Labelled tokens only."""
    return tokens.filter(F.col("label") != "O").select("document", "token", "token_text", "label")


def confusion_mark(predicted: Column, gold: Column) -> Column:
    return (
        F.when(gold.isNull(), F.lit("FP"))
        .when(predicted.isNull(), F.lit("FN"))
        .when(predicted == gold, F.lit("TP"))
        .otherwise(F.lit("FNFP"))
    )


def score_pairs(predicted: DataFrame, gold: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Full outer join of predictions and gold on (document, token) with `cm`.

    With `by` (a run or threshold column of both sides) every value is scored on its own.
    """
    keys = [*by, *KEY]
    p = predicted.select(*keys, F.col("label").alias("label_pred"), F.col("token_text").alias("text_pred"))
    g = gold.select(*keys, F.col("label").alias("label_gt"), F.col("token_text").alias("text_gt"))
    return p.join(g, keys, "full").withColumn(
        "cm", confusion_mark(F.col("label_pred"), F.col("label_gt"))
    )


def counts(cm: Column) -> list[Column]:
    """TP, FP, FN; a wrong label is both a false positive and a false negative."""
    return [
        F.count_if(cm == "TP").alias("tp"),
        F.count_if(cm.isin("FP", "FNFP")).alias("fp"),
        F.count_if(cm.isin("FN", "FNFP")).alias("fn"),
    ]


def fbeta(tp: Column, fp: Column, fn: Column, beta: float = 5.0) -> Column:
    """Micro F-beta from counts; null when there is nothing to score."""
    b2 = beta * beta
    return F.try_divide((1 + b2) * tp, (1 + b2) * tp + b2 * fn + fp)


def fbeta_score(pairs: DataFrame, by: tuple[str, ...] = (), beta: float = 5.0) -> DataFrame:
    cm = F.col("cm")
    return pairs.groupBy(*by).agg(*counts(cm)).withColumn(
        "fbeta", fbeta(F.col("tp"), F.col("fp"), F.col("fn"), beta)
    )


def lenient_fbeta(pairs: DataFrame, beta: float = 5.0) -> DataFrame:
    """Second-stage variant: a wrong entity label counts neither as FP nor as FN."""
    cm = F.col("cm")
    return pairs.agg(
        F.count_if(cm == "TP").alias("tp"),
        F.count_if(cm == "FP").alias("fp"),
        F.count_if(cm == "FN").alias("fn"),
    ).withColumn("fbeta", fbeta(F.col("tp"), F.col("fp"), F.col("fn"), beta))


def confusion_by_label(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("label_gt", "cm").agg(F.count("*").alias("n"))


def without_bio(rows: DataFrame) -> DataFrame:
    return rows.withColumn("label", strip_bio(F.col("label")))


def fbeta_of_rates(precision: Column, recall: Column, beta: float = 5.0) -> Column:
    b2 = beta * beta
    return F.try_divide((1 + b2) * precision * recall, b2 * precision + recall)


def fbeta_grid(totals: DataFrame, cells: int = 100, low: float = 0.5, by: tuple[str, ...] = (), beta: float = 5.0) -> DataFrame:
    """(*by, i, j, precision, recall, tp, fp, fn, fbeta): the surface over a grid of precisions and recalls.

    `totals` has `n_gold` gold labels per row of `by`. Cell (i, j) lies at precision low + i * (1 - low) / (cells - 1)
    and recall likewise with j; its counts are those that so many gold labels need to get there.
    """
    at = lambda k: F.lit(low) + F.col(k) * ((1 - low) / (cells - 1))
    grid = totals.select(*by, "n_gold", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("i"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("j"))
    rated = grid.withColumns({"precision": at("i"), "recall": at("j")})
    tp = F.col("recall") * F.col("n_gold")
    counted = rated.withColumn("tp", tp).withColumn("fp", F.col("tp") * (1 / F.col("precision") - 1)).withColumn("fn", F.col("n_gold") - F.col("tp"))
    return counted.select(*by, "i", "j", "precision", "recall", "tp", "fp", "fn", fbeta(F.col("tp"), F.col("fp"), F.col("fn"), beta).alias("fbeta"))


def sweep_counts(scored: DataFrame, score: str, positive: Column, thresholds, total: str | None = None) -> DataFrame:
    """TP/FP/FN per threshold in one pass; `total` names a column for all rows.

    Rows are counted by how many thresholds their score exceeds, which tells for each threshold whether it does.
    """
    cuts = sorted(thresholds)
    above = F.when(F.col(score) > cuts[-1], len(cuts))
    for i, t in reversed(list(enumerate(cuts[:-1], 1))):
        above = above.when(F.col(score) > t, i)
    rows = as_columns(scored, [], [positive.alias("_positive"), above.otherwise(0).alias("_above")])
    counted = rows.groupBy("_positive", "_above").agg(F.count("*").alias("_k"))
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("_k"))), F.lit(0))
    yes = F.col("_positive")
    wide = counted.agg(
        *[
            F.struct(
                F.lit(t).alias("threshold"),
                n((F.col("_above") > cuts.index(t)) & yes).alias("tp"),
                n((F.col("_above") > cuts.index(t)) & ~yes).alias("fp"),
                n((F.col("_above") <= cuts.index(t)) & yes).alias("fn"),
                *([n(F.lit(True)).alias(total)] if total else []),
            ).alias(f"t{i}")
            for i, t in enumerate(thresholds)
        ]
    )
    return wide.select(F.inline(F.array(*[f"t{i}" for i in range(len(cuts))])))


def binary_report(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """Precision, recall, F1 and accuracy of a yes/no decision."""
    base = rows.agg(
        F.count_if(predicted & actual).alias("tp"),
        F.count_if(predicted & ~actual).alias("fp"),
        F.count_if(~predicted & actual).alias("fn"),
        F.count("*").alias("n"),
        F.avg((predicted == actual).cast("double")).alias("accuracy"),
    )
    p = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return base.withColumn("precision", p).withColumn("recall", r).withColumn(
        "f1", F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    )


def run_bits(labelled: DataFrame, runs: list[str]) -> DataFrame:
    """One row per (document, token) that any run or gold labels, with a bit per run instead of a row per run.

    `labelled` has run, document, token, token_text, label; the rows of gold have a null run.
    Columns: document, token, text_pred, text_gt, label_gt, `votes` (which runs give which label, as
    `array<struct<label, bits>>`, at most one entry per run), and as bit sets `tp`, `fp` (a label of its own
    where gold has none or another) and `fn` (gold alone). A wrong label is in `fp` and not in `fn`; together
    with gold it counts as missed as well. `runs` names at most 63 runs; bit i belongs to the i-th.
    """
    if len(runs) > 63:
        raise ValueError("at most 63 runs fit one bit set")
    named = F.create_map(*[x for i, r in enumerate(runs) for x in (F.lit(r), F.lit(1 << i).cast("long"))])[F.col("run")]
    bit = F.when(F.col("run").isNull(), F.lit(0).cast("long")).otherwise(named)
    rows = labelled.select(*KEY, "token_text", "label", bit.alias("bit")).filter("bit IS NOT NULL")
    of_gold = F.col("bit") == 0
    each = rows.groupBy(*KEY, "label", of_gold.alias("of_gold")).agg(F.bit_or("bit").alias("bits"), F.min("token_text").alias("text"))
    found = each.groupBy(*KEY).agg(
        F.min(F.when(~F.col("of_gold"), F.col("text"))).alias("text_pred"),
        F.min(F.when(F.col("of_gold"), F.col("text"))).alias("text_gt"),
        F.min(F.when(F.col("of_gold"), F.col("label"))).alias("label_gt"),
        F.collect_list(F.when(~F.col("of_gold"), F.struct("label", "bits"))).alias("votes"),
        F.coalesce(F.bit_or("bits"), F.lit(0)).alias("_any"),
    )
    hits = F.aggregate(
        "votes", F.lit(0).cast("long"), lambda n, v: F.when(v["label"] == F.col("label_gt"), n.bitwiseOR(v["bits"])).otherwise(n)
    )
    missed = F.when(F.col("label_gt").isNull(), F.lit(0)).otherwise(F.lit((1 << len(runs)) - 1).bitwiseAND(F.bitwise_not("_any")))
    return found.withColumn("tp", hits).select(
        *KEY, "text_pred", "text_gt", "label_gt", "votes", "tp",
        F.col("_any").bitwiseAND(F.bitwise_not("tp")).alias("fp"),
        missed.cast("long").alias("fn"),
    )


def run_counts(bits: DataFrame, runs: list[str], beta: float = 5.0) -> DataFrame:
    """(run, tp, fp, fn, fbeta): what the bits of each run add up to, in one aggregate."""
    def n(c: Column, i: int) -> Column:
        return F.count_if(c.bitwiseAND(F.lit(1 << i)) != 0)

    wrong = F.when(F.col("label_gt").isNotNull(), F.col("fp")).otherwise(F.lit(0))
    wide = bits.agg(
        *[
            F.struct(
                F.lit(r).alias("run"),
                n(F.col("tp"), i).alias("tp"),
                n(F.col("fp"), i).alias("fp"),
                n(F.col("fn").bitwiseOR(wrong), i).alias("fn"),
            ).alias(f"r{i}")
            for i, r in enumerate(runs)
        ]
    )
    rows = wide.select(F.inline(F.array(*[f"r{i}" for i in range(len(runs))])))
    return rows.withColumn("fbeta", fbeta(F.col("tp"), F.col("fp"), F.col("fn"), beta))


def good_runs(counted: DataFrame, runs: list[str], bar: float, strict: bool = True) -> int:
    """Bit set of the runs whose F-beta is above the bar; reads one row per run (at most 63)."""
    good = {r.run for r in counted.collect() if r.fbeta is not None and (r.fbeta > bar if strict else r.fbeta >= bar)}
    return sum(1 << i for i, r in enumerate(runs) if r in good)


def keep_runs(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Semi-join on the run name; the planner broadcasts few runs, and a hot run is split by the adaptive join."""
    return rows.join(runs, "run", "left_semi")


def error_frequency(bits: DataFrame, errors: str, good: int) -> DataFrame:
    """How many of the good runs make the error (`fp` or `fn`) at each (document, token).

    Where a false positive carries several labels, the least counts.
    """
    mine = F.col(errors).bitwiseAND(F.lit(good))
    wrong = F.filter("votes", lambda v: v["bits"].bitwiseAND(F.col(errors)).bitwiseAND(F.lit(good)) != 0)
    label = F.array_min(F.transform(wrong, lambda v: v["label"])) if errors == "fp" else F.col("label_gt")
    text = F.col("text_pred" if errors == "fp" else "text_gt")
    return bits.filter(mine != 0).select(*KEY, F.bit_count(mine).cast("long").alias("n_runs"), label.alias("label"), text.alias("token_text"))


def span_scores(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Entity-level counts per type: a span counts when its type and both ends agree."""
    keys = ["document", "type", "start_token", "end_token"]
    p = predicted.select(*keys, F.lit(1).alias("p"))
    g = gold.select(*keys, F.lit(1).alias("g"))
    return (
        p.join(g, keys, "full")
        .groupBy("type")
        .agg(
            F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("tp"),
            F.count_if(F.col("g").isNull()).alias("fp"),
            F.count_if(F.col("p").isNull()).alias("fn"),
        )
        .withColumn("precision", F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")))
        .withColumn("recall", F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")))
        .withColumn("f1", F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
    )
