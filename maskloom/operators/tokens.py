"""Tokens, offsets and the token table.

A document is one row, so everything grouped by `document` is bounded by what a single
row can hold. Neighbour look-ups are array accesses done before the explode, which keeps
them free of shuffles; only running offsets need a window.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# One match = one token plus at most one following space, so the matches tile the text.
# Alternatives: URL, www-address, e-mail, newlines, other white space, word, single sign.
TOKEN_PATTERN = (
    r"(?:https?://[^\s<>\"]+|www\.[^\s<>\"]+"
    r"|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
    r"|\n+|[^\S\n]+|[\p{L}\p{N}]+(?:['’.-][\p{L}\p{N}]+)*+|\S) ?"
)


def token_array(text: Column) -> Column:
    """ARRAY<STRUCT<text, ws>> that rebuilds the text exactly."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0)),
        lambda m: F.struct(
            F.when(_spaced(m), F.substring(m, F.lit(1), F.length(m) - 1))
            .otherwise(m)
            .alias("text"),
            _spaced(m).alias("ws"),
        ),
    )


def _spaced(m: Column) -> Column:
    return m.endswith(" ") & (F.length(m) > 1)


def tokenize(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add `toks` to one-row-per-document data."""
    return docs.withColumn("toks", token_array(F.col(text)))


def token_rows(docs: DataFrame, neighbours: int = 0) -> DataFrame:
    """Flatten `toks` to (document, token, token_text, ws, n_tokens, ...), one row per token.

    With `neighbours=k` also `prev_1..prev_k` and `next_1..next_k`, null outside the
    document. All other columns of the input are kept.
    """
    keep = [c for c in docs.columns if c != "toks"]

    fields = [f.name for f in docs.schema["toks"].dataType.elementType.fields if f.name != "text"]
    text = F.col("toks.text")
    sides = [(f"{side}_{k}", sign * k) for k in range(1, neighbours + 1) for side, sign in (("prev", -1), ("next", 1))]
    zipped = F.arrays_zip(F.col("toks").alias("t"), *[shifted(text, k).alias(name) for name, k in sides])
    # Outer + filter: for a plain explode the optimizer adds "array is not empty" filters, which
    # repeat the whole tokenisation below the exchange.
    return docs.select(
        *keep, F.size("toks").alias("n_tokens"), F.posexplode_outer(zipped).alias("token", "_t")
    ).filter("token IS NOT NULL").select(
        *keep,
        "n_tokens",
        "token",
        F.col("_t.t.text").alias("token_text"),
        *[F.col(f"_t.t.{f}").alias(f) for f in fields],
        *[F.col(f"_t.{name}").alias(name) for name, _ in sides],
    )


def bare(m: Column) -> Column:
    """A match without its trailing space."""
    return F.when(_spaced(m), F.substring(m, F.lit(1), F.length(m) - 1)).otherwise(m)


def match_rows(docs: DataFrame, neighbours: int = 0, text: str = "text") -> DataFrame:
    """(document, ..., n_tokens, token, token_text, ws) of `text`, with `prev_k` and `next_k` like `token_rows`, without
    building an array of structs first. All other columns of the input but the text are kept. `prev_1` is cut to the
    token's text; the other neighbours are matches, which `bare` cuts where they are read."""
    keep = [c for c in docs.columns if c != text]
    sides = [(f"{side}_{k}", sign * k) for k in range(1, neighbours + 1) for side, sign in (("prev", -1), ("next", 1))]
    found = docs.select(*keep, F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0)).alias("_m"))
    zipped = F.arrays_zip(F.col("_m").alias("m"), *[shifted(F.col("_m"), k).alias(name) for name, k in sides])
    each = found.select(*keep, F.size("_m").alias("n_tokens"), F.posexplode_outer(zipped).alias("token", "_t")).filter("token IS NOT NULL")
    ws = _spaced(F.col("_t.m"))
    near = [(bare(F.col(f"_t.{name}")) if name == "prev_1" else F.col(f"_t.{name}")).alias(name) for name, _ in sides]
    fields = [bare(F.col("_t.m")).alias("token_text"), ws.alias("ws"), *near]
    # texts leave a generator as plain columns, so what reads them often does not cut them again
    return each.select(*keep, "n_tokens", "token", F.inline(F.array(F.struct(*fields))))


def shifted(arr: Column, by: int) -> Column:
    """The array whose element i is element i+by of `arr`, null outside; same length.

    Neighbours are taken this way rather than by index inside a lambda: an index look-up
    would evaluate the array once per element if the optimizer inlined it.
    """
    n = F.size(arr)
    k = abs(by)
    pad = F.array_repeat(F.get(F.slice(arr, 1, 0), F.lit(0)), F.least(F.lit(k), n))
    if by < 0:
        return F.concat(pad, F.slice(arr, F.lit(1), F.greatest(n - k, F.lit(0))))
    return F.concat(F.slice(arr, F.lit(k + 1), F.greatest(n - k, F.lit(0))), pad)


#: Bytes of text in a partition of documents. Token rows are some fifty times as large, and are sorted and grouped there.
PARTITION_TEXT = 2 << 20


def colocate(docs: DataFrame, text: str = "text", like: DataFrame | None = None) -> DataFrame:
    """Hash-partition documents once, while they are still one compact row each.

    `posexplode` keeps the partitioning, so later windows on `document` add no exchange. There are as many
    partitions as the texts need (a look at their sizes tells), so that what a task sorts and groups by
    token stays in its memory however large the table is. Small tables keep the session's number.
    Other rows with a `document` are dealt alike by giving the documents as `like`: they then meet
    the tokens of those documents where these are, and token rows are not shuffled for it.
    """
    sized = docs if like is None else like
    size = sized.agg(F.sum(F.octet_length(text)).alias("size")).first().size if text in sized.columns else 0
    parts = ceil((size or 0) / PARTITION_TEXT)
    return docs.repartition(parts, "document") if parts > 1 else docs.repartition("document")


def token_spans(tokens: DataFrame) -> DataFrame:
    """Add `start`, `end`: the character interval of every token (gaps belong to nobody)."""
    w = (
        Window.partitionBy("document")
        .orderBy("token")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    size = F.length("token_text") + F.col("ws").cast("int")
    return (
        tokens.withColumn("start", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("int"))
        .withColumn("end", F.col("start") + F.length("token_text"))
    )


def rebuild_text(toks: str | Column = "toks") -> Column:
    """Text of a token array."""
    return F.array_join(F.transform(toks, piece), "")


def piece(t: Column) -> Column:
    return F.concat(t["text"], F.when(t["ws"], F.lit(" ")).otherwise(F.lit("")))


def nest_tokens(tokens: DataFrame, fields=("token_text", "ws", "label")) -> DataFrame:
    """Token table back to one row per document, tokens in order."""
    packed = F.array_sort(F.collect_list(F.struct("token", *fields)))
    return tokens.groupBy("document").agg(
        F.transform(packed, lambda t: F.struct(*[t[f].alias(f) for f in fields])).alias("toks")
    )


def subtokens(spans: DataFrame, width: int = 4) -> DataFrame:
    """Split tokens into pieces of at most `width` characters (stand-in for word pieces)."""
    n = F.greatest(F.ceil(F.length("token_text") / width).cast("int"), F.lit(1))
    parts = spans.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    begin = F.col("start") + F.col("piece") * width
    return parts.withColumn("piece_start", begin).withColumn(
        "piece_end", F.least(begin + width, F.col("end"))
    )
