"""Rule post-processing of predictions.

Narrow predictions are unique on (*by, document, token); `by` names further key columns,
such as a threshold, so one job can correct several decodings at once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.functions import text as tx
from maskloom.functions.labels import ENTITY_LABELS, LABELS
from maskloom.operators.scores import as_columns, best_entity, total

NAME_B, NAME_I = "B-NAME_STUDENT", "I-NAME_STUDENT"
# Titles, labels that never occur, thresholds per type.
TITLES = ("mr", "mrs", "dr", "ms", "miss")
DECODE_TITLES = ("Mr", "Mrs", "Dr", "Ms", "Miss", "Prof")
NEVER = ("I-USERNAME", "I-EMAIL", "I-URL_PERSONAL")
TYPE_THRESHOLDS = {
    "NAME_STUDENT": 0.15,
    "USERNAME": 0.5,
    "EMAIL": 0.7,
    "URL_PERSONAL": 0.7,
    "PHONE_NUM": 0.5,
    "STREET_ADDRESS": 0.5,
    "ID_NUM": 0.5,
}
RUN_TYPES = ("NAME_STUDENT", "STREET_ADDRESS", "PHONE_NUM", "ID_NUM")


def _order(by: Sequence[str]):
    return Window.partitionBy(*by, "document").orderBy("token")


def drop_miscased_names(preds: DataFrame) -> DataFrame:
    """Names must be title-cased."""
    return preds.filter(~F.col("label").contains("NAME_STUDENT") | tx.istitle(F.col("token_text")))


def remove_titles(preds: DataFrame, by: Sequence[str] = (), titles=TITLES) -> DataFrame:
    """Drop name tokens that are titles; an adjacent I-name after one becomes B."""
    w = _order(by)
    is_title = F.col("label").isin(NAME_B, NAME_I) & F.rtrim(
        F.lower("token_text"), F.lit(".")
    ).isin(*titles)
    marked = preds.withColumn("_gone", is_title)
    after = F.coalesce(F.lag("_gone").over(w) & (F.lag("token").over(w) == F.col("token") - 1), F.lit(False))
    return (
        marked.withColumn("_after", after)
        .filter(~F.col("_gone"))
        .withColumn("label", F.when(F.col("_after") & (F.col("label") == NAME_I), NAME_B).otherwise(F.col("label")))
        .drop("_gone", "_after")
    )


def repair_names(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """B after an adjacent (repaired) B becomes I; I without an adjacent row becomes B.

    In a run of adjacent raw B rows the repaired labels alternate, so the result depends
    only on the place in the run and on whether the row before it was turned into B.
    """
    w = _order(by)
    adj = F.coalesce(F.lag("token").over(w) == F.col("token") - 1, F.lit(False))
    step1 = preds.withColumn("_adj", adj).withColumn("_prev", F.lag("label").over(w))
    step2 = step1.withColumn("_prev_adj", F.coalesce(F.lag("_adj").over(w), F.lit(False)))
    is_b = F.col("label") == NAME_B
    starts = is_b & ~(F.col("_adj") & (F.coalesce("_prev", F.lit("")) == NAME_B))
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    step3 = step2.withColumn("_run", F.count_if(starts).over(running)).withColumn("_b", is_b)
    inner = Window.partitionBy(*by, "document", "_run", "_b").orderBy("token")
    turned = (F.col("_prev") == NAME_I) & F.col("_adj") & ~F.col("_prev_adj")
    place = (F.row_number().over(inner) - 1) + F.first(F.coalesce(turned, F.lit(False)).cast("int")).over(inner)
    label = (
        F.when((F.col("label") == NAME_I) & ~F.col("_adj"), NAME_B)
        .when(F.col("_b") & (F.col("_place") % 2 == 1), NAME_I)
        .otherwise(F.col("label"))
    )
    return step3.withColumn("_place", place).withColumn("label", label).drop(
        "_adj", "_prev", "_prev_adj", "_run", "_b", "_place"
    )


def add_repeated_names(preds: DataFrame, tokens: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Give every other title-cased occurrence of a predicted name in the document its label.

    Names and tokens meet in a window, which takes rows where they are if both are dealt by document
    (`tokens.colocate`); a join on document and text would shuffle all tokens by both.
    """
    titled = (F.length("token_text") > 1) & tx.istitle(F.col("token_text"))
    names = (
        preds.filter(F.col("label").contains("NAME_STUDENT") & titled & F.col("document").isNotNull())
        .groupBy(*by, "document", "token_text")
        .agg(F.max_by("label", "token").alias("label"))
        .groupBy("document", "token_text")
        .agg(F.collect_list(F.struct(*by, "label")).alias("_names"))
    )
    rows = tokens.select("document", "token", "token_text").filter(titled).withColumn("_token", F.lit(True))
    w = Window.partitionBy("document", "token_text")
    met = rows.unionByName(names, allowMissingColumns=True).withColumn("_names", F.first("_names", True).over(w))
    found = met.filter("_token AND _names IS NOT NULL").select("document", "token", "token_text", F.inline("_names"))
    keys = [*by, "document", "token"]
    new = found.join(preds.select(*keys), keys, "left_anti")
    return preds.unionByName(new.select(*preds.columns))


def add_emails_and_urls(
    preds: DataFrame, tokens: DataFrame, by: Sequence[str] = (), values: Sequence = ()
) -> DataFrame:
    """Add tokens that look like e-mails or like profile links; no (document, token, label) twice.

    With one `by` column, `values` are the values it can take.
    """
    t = F.col("token_text")
    linked = (
        (t.startswith("http") | t.startswith("www."))
        & (t.contains("http") | t.contains("://"))
        & (t.contains("facebook.com") | t.contains("linkedin"))
        & (F.length(t) < 50)
    )
    label = F.when(t.rlike(tx.EMAIL), F.lit("B-EMAIL")).when(linked, F.lit("B-URL_PERSONAL"))
    new = tokens.select("document", "token", "token_text", label.alias("label")).filter("label IS NOT NULL")
    keys = [*by, "document", "token", "label"]
    if by:
        new = new.withColumn(by[0], F.explode(F.array(*[F.lit(v) for v in values])))
    fresh = new.join(preds.select(*keys), keys, "left_anti")
    return preds.unionByName(fresh.select(*preds.columns))


def drop_bad_urls(preds: DataFrame) -> DataFrame:
    """Public sites and address-less texts are no personal URLs; I-URLs never are."""
    t = F.col("token_text")
    bad = (
        t.contains("coursera.org")
        | t.contains("wikipedia.org")
        | t.contains(".gov")
        | t.contains(".edu")
        | ~tx.is_url_token(t)
    )
    label = F.col("label")
    return preds.filter((label != "I-URL_PERSONAL") & ~((label == "B-URL_PERSONAL") & bad))


def drop_never_labels(preds: DataFrame) -> DataFrame:
    return preds.filter(~F.col("label").isin(*NEVER))


def phones_to_ids(preds: DataFrame) -> DataFrame:
    """A phone number longer than four characters without phone signs is an ID."""
    plain = (F.length("token_text") > 4) & ~F.col("token_text").rlike(r"[().x+-]")
    return preds.withColumn(
        "label",
        F.when((F.col("label") == "B-PHONE_NUM") & plain, "B-ID_NUM").otherwise(F.col("label")),
    )


def collapse_bio(wide: DataFrame) -> DataFrame:
    """One score column per entity type: the sum of its B and I scores."""
    keep = [c for c in wide.columns if c not in ENTITY_LABELS]
    cols = []
    for t in TYPE_THRESHOLDS:
        own = [F.col(c) for c in ENTITY_LABELS if c[2:] == t]
        cols.append((own[0] + own[1] if len(own) == 2 else own[0]).alias(t))
    return as_columns(wide, keep, cols)


def shape_tests(t: Column) -> dict[str, Column]:
    """The text tests that several types share."""
    return {
        "_url": t.rlike(tx.URL_LIKE),
        "_line": t.isin("\n", "\n\n"),
        "_blank": tx.isspace(t),
        "_title": tx.istitle(t),
        "_lower": tx.islower(t),
        "_odd": t.rlike(r"[^a-zA-Z\.]"),
    }


def impossible(t: Column, name_length: int, tests: dict[str, Column] | None = None) -> dict[str, Column]:
    """Per type: when a token cannot be of that type. `tests` may name columns that hold `shape_tests`."""
    size = F.length(t)
    url, line, blank, title, lower, odd = (tests or shape_tests(t)).values()
    short = size <= name_length
    return {
        "NAME_STUDENT": ~title | odd | url | line | (size <= 1),
        "USERNAME": ~lower | blank | url | line | (size <= 1) | short,
        "ID_NUM": blank | url | line,
        "EMAIL": url | line | (size <= 1) | short | ~t.contains("@"),
        "PHONE_NUM": url | line,
        "STREET_ADDRESS": url,
        "URL_PERSONAL": line | (size <= 1) | short,
    }


def zero_impossible_types(wide: DataFrame, length_limit: int = 4) -> DataFrame:
    """Zero the scores that the text of a token rules out (types without BIO)."""
    tests = impossible(F.col("token_text"), length_limit)
    keep = [c for c in wide.columns if c not in tests]
    return wide.select(*keep, *[F.when(bad, 0.0).otherwise(F.col(c)).alias(c) for c, bad in tests.items()])


def zero_impossible_labels(wide: DataFrame, length_limit: int = 3) -> DataFrame:
    """The same for the twelve BIO labels; an I-ID may be white space."""
    t = F.col("token_text")
    # each test once per token; inside a generator the tests of twelve labels would be repeated
    shapes = shape_tests(t)
    tested = as_columns(wide, wide.columns, [test.alias(name) for name, test in shapes.items()])
    known = {name: F.col(name) for name in shapes}
    tests = impossible(t, length_limit, known)
    inside_id = known["_url"] | known["_line"]
    keep = [c for c in wide.columns if c not in ENTITY_LABELS]
    cols = [
        F.when(inside_id if c == "I-ID_NUM" else tests[c[2:]], 0.0).otherwise(F.col(c)).alias(c)
        for c in ENTITY_LABELS
    ]
    return as_columns(tested, keep, cols)


def decode_types(scores: DataFrame, thresholds=None) -> DataFrame:
    """Long form of the types above their threshold, with B/I by adjacency per type.

    A token may get several types; the result is unique on (document, token, type).
    """
    cuts = thresholds or TYPE_THRESHOLDS
    t = F.col("token_text")
    extra = {
        "NAME_STUDENT": ~F.rtrim(t, F.lit(".")).isin(*DECODE_TITLES),
        "URL_PERSONAL": F.length(t) > 5,
        "EMAIL": ~tx.isspace(t),
    }
    hits = [
        F.when((F.col(k) > cut) & extra.get(k, F.lit(True)), F.lit(k)) for k, cut in cuts.items()
    ]
    rows = scores.select(
        "document", "token", "token_text", F.explode(F.array_compact(F.array(*hits))).alias("type")
    )
    before = F.lag("token").over(Window.partitionBy("document", "type").orderBy("token"))
    inside = F.col("type").isin(*RUN_TYPES) & F.coalesce(before == F.col("token") - 1, F.lit(False))
    return rows.withColumn(
        "label", F.concat(F.when(inside, F.lit("I-")).otherwise(F.lit("B-")), F.col("type"))
    )


def decode_argmax(wide: DataFrame) -> DataFrame:
    """Label by arg-max, leaning away from `O`; the first column wins a tie."""

    def first(cols, top: str) -> Column:
        found = F.when(F.col(cols[0]) == F.col(top), F.lit(cols[0]))
        for c in cols[1:]:
            found = found.when(F.col(c) == F.col(top), F.lit(c))
        return found.otherwise(F.lit(cols[0]))

    rows = as_columns(
        wide,
        wide.columns,
        [F.greatest(*[F.col(c) for c in LABELS]).alias("_top"), best_entity().alias("_max"), total(ENTITY_LABELS).alias("_sum")],
    )
    label = (
        F.when(F.col("_sum") < 1e-3, "O")
        .when((F.col("B-URL_PERSONAL") > 0.15) & F.col("token_text").rlike(tx.URL_LIKE), "B-URL_PERSONAL")
        .when((F.col("_max") > 0.15) & (F.col("O") < 0.9), first(ENTITY_LABELS, "_max"))
        .otherwise(first(LABELS, "_top"))
    )
    return rows.withColumn("label", label).drop("_top", "_max", "_sum")


def correction_steps(
    tokens: DataFrame, by: Sequence[str] = (), values: Sequence = ()
) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """The correction steps in their order."""
    return {
        "name_casing": drop_miscased_names,
        "repeated_names": lambda p: add_repeated_names(p, tokens, by),
        "emails_urls": lambda p: add_emails_and_urls(p, tokens, by, values),
        "name_titles": lambda p: remove_titles(p, by),
        "repair_names": lambda p: repair_names(p, by),
        "never_labels": drop_never_labels,
        "phone_numbers": phones_to_ids,
    }


def correct(
    preds: DataFrame, tokens: DataFrame, by: Sequence[str] = (), values: Sequence = (), steps=None
) -> DataFrame:
    """Apply the named steps (all by default)."""
    table = correction_steps(tokens, by, values)
    for name in steps or table:
        preds = table[name](preds)
    return preds
