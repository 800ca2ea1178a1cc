"""Text around tokens.

Every builder works on rows that carry the tokens around them (`toks`, the first of which is token `_base` of
the document) and a position (`token`). Positions leave the array by an explode and are filtered before a
slice is taken, so only chosen tokens pay for their context.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions.hashing import hash01, hash_int
from maskloom.operators.scores import as_columns
from maskloom.operators.tokens import rebuild_text


#: Tokens of a stretch, and how many tokens a context (a drawn neighbour and its own context together) may lie away.
STRETCH, REACH = 128, 128


def stretches(docs: DataFrame) -> DataFrame:
    """Documents cut into stretches: `toks` holds STRETCH tokens from `_start` on and REACH to both sides, from `_base` on.

    A row that carries its surroundings then costs the same however long its document is.
    """
    cols = [c for c in docs.columns if c != "toks"]
    last = F.greatest(F.ceil(F.size("toks") / STRETCH).cast("int") - 1, F.lit(0))
    start = F.col("_k") * STRETCH
    base = F.greatest(start - REACH, F.lit(0))
    each = docs.select("*", F.explode(F.sequence(F.lit(0), last)).alias("_k"), last.alias("_last"))
    near = F.slice("toks", base + 1, start - base + STRETCH + REACH)
    # leaving a generator, the cut stays below all that reads it: no row with the whole array is built
    return as_columns(each, [*cols, "_k", "_last"], [start.alias("_start"), base.alias("_base"), near.alias("toks")])


def candidates(docs: DataFrame, wanted) -> DataFrame:
    """One row per wanted token, with `toks` around it, `token`, `token_text` (and `label`, if there)."""
    fields = [f.name for f in docs.schema["toks"].dataType.elementType.fields if f.name != "text"]
    parts = stretches(docs)
    rows = parts.select("*", F.posexplode_outer("toks").alias("_i", "_t")).filter("_i IS NOT NULL")
    token = F.col("_base") + F.col("_i")
    rows = rows.filter((token >= F.col("_start")) & (token < F.col("_start") + STRETCH)).select(
        *docs.columns, "_base", token.alias("token"), F.col("_t.text").alias("token_text"), *[F.col(f"_t.{f}").alias(f) for f in fields]
    )
    # leaving a generator: a later filter on contexts would otherwise move below and see every token with its surroundings
    return as_columns(rows.filter(wanted), [], rows.columns)


def attach(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Bring token rows of another table to their documents; the array is joined once per document."""
    extra = [c for c in rows.columns if c != "document"]
    grouped = rows.groupBy("document").agg(F.collect_list(F.struct(*extra)).alias("_rows"))
    parts = stretches(docs.join(grouped, "document"))
    # rows behind the last token stay with the last stretch
    mine = F.filter("_rows", lambda r: F.least(F.floor(r["token"] / STRETCH), F.col("_last")) == F.col("_k"))
    return parts.withColumn("_rows", mine).select(*docs.columns, "_base", F.inline("_rows"))


def _at() -> Column:
    """Place of the token in `toks`."""
    return F.col("token") - F.col("_base")


def _within(n: int) -> int:
    if n > REACH:
        raise ValueError(f"a context reaches {REACH} tokens at most, not {n}")
    return n


def _before(n: int) -> Column:
    first = F.greatest(_at() - _within(n), F.lit(0))
    return rebuild_text(F.slice("toks", first + 1, _at() - first))


def _after(n: int) -> Column:
    """Tokens i+1 .. i+n-1."""
    return rebuild_text(F.slice("toks", _at() + 2, F.lit(_within(n) - 1)))


def own_token() -> Column:
    return F.get("toks", _at())


def snippet(before: int, after: int, start: str = "", end: str = "") -> Column:
    """`before` tokens, the marked token, `after - 1` tokens."""
    t = own_token()
    space = F.when(t["ws"], F.lit(" ")).otherwise(F.lit(""))
    return F.concat(_before(before), F.lit(start), t["text"], F.lit(end), space, _after(after))


def url_excerpt(before: int = 100, after: int = 100, start: str = "[URL_START]", end: str = "[URL_END]") -> Column:
    """Parts joined by single spaces; no text follows a last token."""
    return F.concat_ws(" ", _before(before), F.lit(start), own_token()["text"], F.lit(end), _after(after))


def assertion_context(before: int, after: int, start: str = "[START]", end: str = "[END]") -> Column:
    """Context with a marked token, set off by a space unless white space precedes it."""
    head = _before(before)
    gap = F.when((head != "") & ~F.right(head, F.lit(1)).isin(" ", "\n"), F.lit(" ")).otherwise(F.lit(""))
    return F.concat(head, gap, F.lit(f"{start} "), own_token()["text"], F.lit(f" {end} "), _after(after))


def plain_context(around: int = 10) -> Column:
    """Tokens [i - around, i + around) with their spaces."""
    first = F.greatest(_at() - _within(around), F.lit(0))
    return rebuild_text(F.slice("toks", first + 1, _at() + around - first))


def nearby_negative(before: int, after: int, seed: str, allowed=None) -> Column:
    """Position of an `O` token in [i - before, i + after), chosen by hash; null if there is none."""
    first = F.greatest(_at() - _within(before), F.lit(0))
    near = F.slice("toks", first + 1, _at() + _within(after) - first)

    def draw(t: Column, j: Column) -> Column:
        at = (F.col("_base") + first + j).cast("int")
        ok = (t["label"] == "O") if allowed is None else (t["label"] == "O") & allowed(t["text"])
        return F.when(ok, F.struct(hash_int(seed, "document", "token", at).alias("h"), at.alias("at")))

    return F.array_min(F.transform(near, draw))["at"]


def with_negatives(positives: DataFrame, before: int, after: int, share: float, seed: str) -> DataFrame:
    """Positives plus, for a share of them, one nearby negative of the same document."""
    cols = [c for c in positives.columns if c not in ("token_text", "label", "ws")]
    sampled = positives.filter(hash01(seed, "document", "token") < share)
    negative = sampled.withColumn("_at", nearby_negative(before, after, seed + "-near")).filter("_at IS NOT NULL")
    moved = negative.drop("token").withColumnRenamed("_at", "token")
    own = own_token()
    negatives = moved.withColumn("token_text", own["text"]).withColumn("ws", own["ws"]).withColumn("label", F.lit("O"))
    names = [*cols, "token_text", "ws", "label"]
    return positives.select(*names).unionByName(negatives.select(*names))


def first_per_text(rows: DataFrame) -> DataFrame:
    """The first token of every distinct text of a document."""
    return rows.groupBy("document", "token_text").agg(
        F.min_by(F.struct("token", "label"), "token").alias("_f")
    ).select("document", "token_text", "_f.token", "_f.label")


def question(text: Column, name: Column, template: str = "{text}\n\nIs {name} a person's name?") -> Column:
    """Fill `{text}` and `{name}`."""
    head, tail = template.split("{text}", 1)
    parts = tail.split("{name}")
    out = [F.lit(head), text, F.lit(parts[0])]
    for p in parts[1:]:
        out += [name, F.lit(p)]
    return F.concat(*out)


