"""Spans in text and in BIO labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.functions.labels import strip_bio


def regex_spans(docs: DataFrame, pattern: str | Column, text: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """All matches as (document, *by, span_start, span_end)."""
    pat = F.lit(pattern) if isinstance(pattern, str) else pattern
    return _placed(docs.select("document", *by, _sizes(F.col(text), pat).alias("_z")), ("document", *by))


def spans_of_all(docs: DataFrame, patterns: dict[str, str], text: str = "text") -> DataFrame:
    """All matches of several patterns as (document, key, span_start, span_end), from one pass over the documents.

    Matches of one pattern do not hide those of another.
    """
    each = F.array(
        *[
            F.struct(F.lit(k).alias("key"), F.when(F.col(text).rlike(p), _sizes(F.col(text), F.lit(p))).alias("_z"))
            for k, p in patterns.items()
        ]
    )
    found = docs.select("document", F.inline(each)).filter("_z IS NOT NULL")
    return _placed(found, ("document", "key"))


def _sizes(text: Column, pattern: Column) -> Column:
    """Lengths of what lies before each match, and of the match (null for the rest of the text)."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    hits = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    return F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))


def _placed(sized: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(*keys, span_start, span_end) of matches with a length from `_z`, by a running sum; no text is needed."""
    rows = sized.select(*keys, F.posexplode_outer("_z").alias("k", "z")).select(
        *keys, "k", F.col("z.gap").alias("gap"), F.col("z.hit").alias("hit")
    )
    w = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("gap") + F.coalesce("hit", F.lit(0))).over(w), F.lit(0))
    return (
        rows.withColumn("span_start", (before + F.col("gap")).cast("int"))
        .filter("hit > 0")
        .withColumn("span_end", F.col("span_start") + F.col("hit"))
        .select(*keys, "span_start", "span_end")
    )


def literal_pattern(value: Column, word: Column | bool = False) -> Column:
    """Regular expression that finds `value` as it stands, at word borders when `word`.

    The literal comes first and the border before it is looked for from behind, so that the search skips
    ahead by the literal instead of asking for a border at every character.
    """
    quoted = F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    bounded = F.concat(F.lit("(?U)"), quoted, F.lit("\\b(?<=\\b"), quoted, F.lit(")"))
    flag = F.lit(word) if isinstance(word, bool) else word
    return F.when(flag, bounded).otherwise(quoted)


#: The order in which `span_cover` leaves the tokens of a document.
COVERED = ("_at", "_o")


def span_cover(tokens: DataFrame, spans: DataFrame, keys: list[str], ordered: bool = False) -> DataFrame:
    """Mark every token whose first character lies in a span, per span key.

    Adds `key`, the last of `keys` (in list order) that covers the token, or null. One sort
    per document: a running maximum of the span ends per key tells whether the key is
    still open at the token. Columns are sorted as plain ones, so those that nobody reads are left out. With
    `ordered` the columns `COVERED` stay, by which a later window finds its rows in order.
    """
    cols = [c for c in tokens.columns if c != "document"]
    none = [F.lit(None).cast(tokens.schema[c].dataType).alias(c) for c in cols]
    t = tokens.select("document", F.col("start").alias("_at"), F.lit(1).alias("_o"), *cols,
                      F.lit(None).cast("string").alias("_key"), F.lit(None).cast("int").alias("_end"))
    s = spans.select("document", F.col("span_start").alias("_at"), F.lit(0).alias("_o"), *none,
                     F.col("key").alias("_key"), F.col("span_end").alias("_end"))
    w = Window.partitionBy("document").orderBy(*COVERED).rowsBetween(Window.unboundedPreceding, 0)
    union = t.unionByName(s)
    opened = union.select(
        "document", *COVERED, *cols, *[F.max(F.when(F.col("_key") == k, F.col("_end"))).over(w).alias(f"_e{i}") for i, k in enumerate(keys)]
    ).filter("_o = 1")
    last = F.coalesce(*[F.when(F.col(f"_e{i}") > F.col("_at"), F.lit(keys[i])) for i in reversed(range(len(keys)))])
    return opened.select("document", *(COVERED if ordered else ()), *cols, last.alias("key"))


def bio_from_types(tokens: DataFrame, kind: str = "type", order: tuple[str, ...] = ("token",)) -> DataFrame:
    """`label` from a nullable type: B after nothing or another type, I otherwise."""
    w = Window.partitionBy("document").orderBy(*order)
    before = F.lag(kind).over(w)
    label = (
        F.when(F.col(kind).isNull(), F.lit("O"))
        .when(before == F.col(kind), F.concat(F.lit("I-"), F.col(kind)))
        .otherwise(F.concat(F.lit("B-"), F.col(kind)))
    )
    return tokens.withColumn("label", label)


def label_values(
    tokens: DataFrame, docs: DataFrame, key_types: dict[str, str], text: str = "text"
) -> DataFrame:
    """BIO labels for tokens (with `start`) from the known values of a document.

    `docs` holds `document`, the text and one string column per key; `names` may hold
    several values split by `|`. Later keys overwrite earlier ones.
    """
    keys = list(key_types)

    def values(key: str) -> Column:
        many = F.coalesce(F.split(F.col(key), r"\|"), F.array(F.lit(""))) if key == "names" else F.array(key)
        return F.transform(many, lambda v: F.struct(F.lit(key).alias("key"), v.alias("value"), F.lit("name" in key).alias("word")))

    wanted = F.array_distinct(F.filter(F.flatten(F.array(*map(values, keys))), lambda x: x["value"] != ""))
    # the text stays in its one row, which gives the lengths around the matches of every value
    sized = F.transform(
        wanted,
        lambda x: F.struct(
            x["key"].alias("key"),
            x["value"].alias("value"),
            F.transform(F.split(F.col(text), literal_pattern(x["value"], x["word"]), -1), F.length).alias("gaps"),
        ),
    )
    found = docs.select("document", F.inline(sized)).filter("size(gaps) > 1")
    size = F.length("value")
    last = F.size("gaps") - 1
    zipped = F.transform("gaps", lambda g, i: F.struct(g.alias("gap"), F.when(i < last, size).alias("hit")))
    hits = _placed(found.select("document", "key", "value", zipped.alias("_z")), ("document", "key", "value"))
    covered = span_cover(tokens, hits, keys, ordered=True)
    kind = F.create_map(*[F.lit(x) for pair in key_types.items() for x in pair])
    return bio_from_types(covered.withColumn("type", kind[F.col("key")]), order=COVERED).drop("key", "type", *COVERED)


def bio_spans(tokens: DataFrame, labels: tuple[str, ...] = ("label",)) -> DataFrame:
    """(document, type, start_token, end_token, text): a B opens, any I continues.

    A leading I outside a span is ignored; an I of another type still continues the span.
    `tokens` must hold all tokens, `O` included. With several label columns the spans of all come from
    one sort, and `by` names the column that a span is from.
    """
    w = Window.partitionBy("document").orderBy("token")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    states = []
    for c in labels:
        opens = F.col(c).startswith("B-")
        last = F.max(F.when(opens | (F.col(c) == "O"), F.struct("token", opens.alias("b")))).over(run)["b"]
        states.append(F.struct(F.lit(c).alias("by"), F.col(c).alias("label"), F.count_if(opens).over(run).alias("_span"), last.alias("_open")))
    found = tokens.select("document", "token", "token_text", "ws", F.array(*states).alias("_s"))
    inside = F.exists("_s", lambda s: (s["label"] != "O") & s["_open"])
    marked = found.filter(inside).select("document", "token", "token_text", "ws", F.inline("_s"))
    keys = ["by"] if len(states) > 1 else []
    return (
        marked.filter((F.col("label") != "O") & F.col("_open"))
        .groupBy("document", *keys, "_span")
        .agg(
            strip_bio(F.min_by("label", "token")).alias("type"),
            F.min("token").alias("start_token"),
            (F.max("token") + 1).alias("end_token"),
            F.array_sort(F.collect_list(F.struct("token", "token_text", "ws"))).alias("_p"),
        )
        .select(
            "document",
            *keys,
            "type",
            "start_token",
            "end_token",
            F.array_join(F.transform("_p", _spaced_text), "").alias("_text"),
            F.element_at("_p", -1)["ws"].alias("_ws"),
        )
        .withColumn(
            "text", F.when(F.col("_ws"), F.expr("left(_text, length(_text) - 1)")).otherwise(F.col("_text"))
        )
        .drop("_text", "_ws")
    )


def _spaced_text(p: Column) -> Column:
    return F.concat(p["token_text"], F.when(p["ws"], F.lit(" ")).otherwise(F.lit("")))


def name_occurrences(spans: DataFrame) -> DataFrame:
    """Full names of a document with the positions where they start."""
    names = spans.filter((F.col("type") == "NAME_STUDENT") & F.length("text").between(2, 20))
    return names.groupBy("document", F.col("text").alias("name")).agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list("start_token")).alias("starts")
    )


def conflicting_types(rows: DataFrame) -> DataFrame:
    """Texts that carry more than one type within a document."""
    typed = rows.withColumn("type", strip_bio(F.col("label")))
    return (
        typed.groupBy("document", "token_text")
        .agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"), F.count("*").alias("n"))
        .filter(F.col("types").contains(","))
    )
