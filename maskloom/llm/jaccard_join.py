"""Jaccard join of word n-gram sets by vertical partitioning, to classes and connected components.

The global order of n-grams (their hashes) is cut into fragments. One fragment alone shows how many of a
text's n-grams occur in no other text; with more than the threshold allows it has no partner. The sets
that remain are ordered rarest first, and partners share an n-gram of their prefixes. For candidate pairs
each fragment counts its partial overlap, and the sum per pair is held against the threshold.

Equal sets are one class. In a list of classes with a common n-gram, all are first paired with one centre;
classes that the links of the first round join need no pair of their own, so a group of near copies costs
its size. Pairs across what is still apart follow, under the bounds that their places in the order set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.llm.blocks import BLOCK, Block, blocks, joined_hashes, mixed, words
from maskloom.llm.components import components
from maskloom.llm.shared import removed, written

#: By how much the first fragment's part of the order exceeds what a text may have of its own under the
#: threshold: a text of unshared n-grams then shows more than that. And the fragments that overlaps are counted in.
FIRST_OVER = 0.1
FRAGMENTS = 4


def gram_sets(block: Block, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of all texts of a block, ascending in each: (hash, document, sizes).

    Words are lower-cased in A to Z. A text of fewer words has its whole sequence as its one n-gram.
    """
    w = words(block, lower=True)
    h = joined_hashes(w.hash, n)
    inside = w.doc[: len(h)] == w.doc[n - 1 :] if len(h) else np.zeros(0, bool)
    h, doc = h[inside], w.doc[: len(inside)][inside]
    first = np.cumsum(w.counts) - w.counts
    short, rows = [], []
    for k in range(1, n):
        at = np.flatnonzero(w.counts == k)
        if len(at):
            rows.append(at)
            short.append(joined_hashes_at(w.hash, first[at], k))
    h, doc = np.concatenate([h, *short]), np.concatenate([doc, *rows]).astype(np.int64)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, doc, np.bincount(doc, minlength=len(block))


def joined_hashes_at(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n neighbours from the given places."""
    out = h[at]
    with np.errstate(over="ignore"):
        for k in range(1, n):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15 | 1) + h[at + k])
    return mixed(out + np.uint64(n)) if n else out


def class_of(h: np.ndarray, doc: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hash of each set."""
    with np.errstate(over="ignore"):
        x = mixed(h + np.uint64(0x632BE59BD9B4E019))
        until = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
        end = np.cumsum(sizes)
        total = until[end] - until[end - sizes]
        y = mixed(x * np.uint64(0xD6E8FEB86659FD93))
        until = np.concatenate([np.zeros(1, np.uint64), np.cumsum(y, dtype=np.uint64)])
        total = mixed(total + np.uint64(1)) + (until[end] - until[end - sizes]) * np.uint64(0xA0761D6478BD642F)
    return mixed(total + sizes.astype(np.uint64)).view(np.int64)


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def classes(texts: DataFrame, n: int) -> DataFrame:
    """Columns of `texts` but the text, and `size` and `cls`: size and hash of the text's set."""
    kept = [c for c in texts.columns if c != "text"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                h, doc, sizes = gram_sets(block, n)
                rows = [batch.column(c).slice(block.first, len(block)) for c in kept]
                yield pa.RecordBatch.from_arrays(
                    [*rows, pa.array(sizes, pa.int64()), _signed(class_of(h, doc, sizes))], [*kept, "size", "cls"]
                )

    kinds = dict(texts.dtypes)
    return texts.mapInArrow(find, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "size long", "cls long"]))


def first_fragment(texts: DataFrame, n: int, part: float) -> DataFrame:
    """(gram, cls): the n-grams of each text that lie in the first `part` of the order."""
    limit = np.uint64(int(part * 2**64))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                h, doc, sizes = gram_sets(block, n)
                cls = class_of(h, doc, sizes)
                low = h < limit
                yield pa.RecordBatch.from_arrays([_signed(h[low]), pa.array(cls[doc[low]])], ["gram", "cls"])

    return texts.mapInArrow(find, "gram long, cls long")


def compressed(texts: DataFrame) -> DataFrame:
    """(th, tn, packed): texts as Zstandard frames, about half of what a shuffle makes of them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            parts = []
            for block in blocks(batch.column("text")):
                parts += [codec.compress(block.text(i)) for i in range(len(block))]
            yield pa.RecordBatch.from_arrays([batch.column("th"), batch.column("tn"), pa.array(parts, pa.binary())], ["th", "tn", "packed"])

    return texts.mapInArrow(pack, "th long, tn int, packed binary")


def sets(texts: DataFrame, n: int) -> DataFrame:
    """(cls, size, grams): the set of each text of `compressed`, ascending as unsigned hashes."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
        """Texts again, in parts of about the size of a block."""
        codec, part, size = zstandard.ZstdDecompressor(), [], 0
        for batch in batches:
            for x in batch.column("packed"):
                part.append(codec.decompress(x.as_py()))
                size += len(part[-1])
                if size >= BLOCK:
                    yield pa.array(part, pa.binary())
                    part, size = [], 0
        if part:
            yield pa.array(part, pa.binary())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in unpacked(batches):
            for block in blocks(texts):
                h, doc, sizes = gram_sets(block, n)
                offsets = np.concatenate([np.zeros(1, np.int32), np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(class_of(h, doc, sizes)), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), _signed(h))],
                    ["cls", "size", "grams"],
                )

    return texts.mapInArrow(find, "cls long, size long, grams array<long>")


def _in_fragment(k: int):
    return lambda gram: F.pmod(F.shiftrightunsigned(gram, 40), F.lit(FRAGMENTS)) == k


def _may_link(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def overlaps(pairs: DataFrame, fragments: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) at or above the threshold: partial overlaps per fragment, summed per pair."""
    a = fragments.select(F.col("cls").alias("a"), "fragment", F.col("part").alias("_x"), F.col("size").alias("_na"))
    b = fragments.select(F.col("cls").alias("b"), "fragment", F.col("part").alias("_y"), F.col("size").alias("_nb"))
    common = F.sum("_common")
    return (
        pairs.join(a, "a")
        .join(b, ["b", "fragment"])
        .select("a", "b", "_na", "_nb", F.size(F.array_intersect("_x", "_y")).alias("_common"))
        .groupBy("a", "b", "_na", "_nb")
        .agg(common.alias("_common"))
        .filter(100 * F.col("_common") >= percent * (F.col("_na") + F.col("_nb") - F.col("_common")))
        .select("a", "b")
    )


def links(texts: DataFrame, known: DataFrame, n: int, percent: int) -> DataFrame:
    """Labels (node, label) of classes with a partner; `known` (th, tn, size, cls) are the classes of `texts`."""
    grams = first_fragment(texts, n, 1 - percent / 100 + FIRST_OVER).groupBy("gram").agg(F.min("cls").alias("_a"), F.max("cls").alias("_b"))
    alone = grams.filter("_a = _b").groupBy(F.col("_a").alias("cls")).agg(F.count("*").alias("_alone"))
    each = known.filter("size > 0").groupBy("cls", "size").agg(F.min(F.struct("th", "tn")).alias("_text"))
    left = each.join(alone, "cls", "left").filter(100 * F.coalesce("_alone", F.lit(0)) <= (100 - percent) * F.col("size"))
    one = compressed(texts).groupBy("th", "tn").agg(F.first("packed").alias("packed"))
    s = written(sets(one.join(left.select("_text.th", "_text.tn"), ["th", "tn"]).select("packed"), n))

    # rarest first: an n-gram of one class comes before all others and has no partner
    places = s.select("cls", F.explode("grams").alias("gram"))
    shared = written(places.groupBy("gram").agg(F.count("*").alias("_n")).filter("_n > 1"))
    kept = places.join(shared, "gram").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("_n", "gram"))).alias("_order"))
    kept = kept.join(s.select("cls", "size"), "cls")
    prefix = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1
    alone = F.col("size") - F.size("_order")
    lists = written(
        kept.withColumn("_alone", alone)
        .filter(prefix > F.col("_alone"))
        .select("cls", "size", "_alone", F.posexplode(F.slice("_order", F.lit(1), (prefix - F.col("_alone")).cast("int"))).alias("_i", "_o"))
        .select("cls", "size", "_alone", F.col("_o.gram").alias("gram"), (F.col("_i") + F.col("_alone")).alias("at"))
    )
    cut = [F.filter("grams", _in_fragment(k)) for k in range(FRAGMENTS)]
    fragments = written(
        s.join(lists.select("cls").distinct(), "cls", "left_semi")
        .select("cls", "size", F.posexplode(F.array(*cut)).alias("fragment", "part"))
        .filter(F.size("part") > 0)
    )

    removed(s, shared)

    centre = written(lists.groupBy("gram").agg(F.min(F.struct("_alone", "cls", "size")).alias("_c")))
    near = (
        lists.join(centre, "gram")
        .filter((F.col("cls") != F.col("_c.cls")) & _may_link(F.col("size"), F.col("_c.size"), percent))
        .select(F.least("cls", "_c.cls").alias("a"), F.greatest("cls", "_c.cls").alias("b"))
        .distinct()
    )
    near = written(near)
    first = written(overlaps(near, fragments, percent))
    label = components(first)

    named = lists.join(label.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    named = written(named)
    main = named.join(centre.select("gram", F.col("_c.cls").alias("cls")), ["gram", "cls"], "left_semi").select("gram", F.col("label").alias("_main"))
    main = written(main)
    apart = written(named.join(main, "gram").filter("label <> _main"))
    x = apart.select("gram", *(F.col(c).alias(f"x_{c}") for c in ("cls", "size", "at", "label")))
    y = named.select("gram", *(F.col(c).alias(f"y_{c}") for c in ("cls", "size", "at", "label")))
    room = F.least(F.col("x_size") - F.col("x_at"), F.col("y_size") - F.col("y_at"))
    rest = (
        x.join(y, "gram")
        .filter(
            (F.col("x_label") != F.col("y_label"))
            & _may_link(F.col("x_size"), F.col("y_size"), percent)
            & ((100 + percent) * room >= percent * (F.col("x_size") + F.col("y_size")))
        )
        .select(F.least("x_cls", "y_cls").alias("a"), F.greatest("x_cls", "y_cls").alias("b"))
        .distinct()
        .join(near, ["a", "b"], "left_anti")
    )
    rest = written(rest)
    found = components(first.unionByName(overlaps(rest, fragments, percent)))
    removed(lists, fragments, centre, near, first, named, main, apart, rest)
    return found


def _labelled(docs: DataFrame, n: int, percent: int, text: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """Rows (_row, id, th, tn) of `docs`, and their (id, th, tn, size, cls, label); label: the component as a class."""
    own = F.coalesce(F.col(text), F.lit(""))
    keys = [F.xxhash64(own).alias("th"), F.octet_length(own).alias("tn")]
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(doc_id).alias("id"), *keys)
    slim = written(classes(docs.select(F.col(doc_id).alias("id"), *keys, own.alias("text")), n))
    label = links(docs.select(*keys, own.alias("text")), slim, n, percent)
    label = slim.join(label.withColumnRenamed("node", "cls"), "cls", "left")
    return rows, label.withColumn("label", F.when(F.col("size") > 0, F.coalesce("label", "cls")))


def near_duplicates(docs: DataFrame, n: int = 3, percent: int = 90, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All rows and columns of `docs` (one named `_j` is replaced) and struct `_j` (n_shingles, cls, component_id).

    Two texts link when 100 * intersection >= `percent` * union of their sets; `component_id` is the least
    doc_id that links reach (null ids are passed over; only null ids: null). A text without words has an
    empty set, links with nothing and is its own component. Rows with equal sets share a class.
    """
    rows, label = _labelled(docs, n, percent, text, doc_id)
    least = label.filter("size > 0").groupBy("label").agg(F.min("id").alias("least"))
    per_text = label.groupBy("th", "tn").agg(*(F.first(c).alias(c) for c in ("size", "cls", "label"))).join(least, "label", "left")
    found = F.struct(
        F.col("size").alias("n_shingles"), "cls", F.when(F.col("size") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id")
    )
    return rows.join(per_text, ["th", "tn"]).select(*(f"_row.`{c}`" for c in docs.columns if c != "_j"), found.alias("_j"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each component of near duplicates: the one of least id (null last), then of least text hash.

    Of rows that repeat id and text one stays. All texts without words stay.
    """
    rows, label = _labelled(docs, n, percent, text, doc_id)
    each = label.filter("size > 0").groupBy("label", "id", "th", "tn").agg(F.count("*").alias("n"))
    kept = each.groupBy("label").agg(F.min(F.struct(F.col("id").isNull(), "id", "th", "tn", "n")).alias("s"))
    kept = kept.select(*(F.col(f"s.{c}").alias(f"_{c}") for c in ("id", "th", "tn", "n")))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")) & (F.col("tn") == F.col("_tn"))
    # one plan at every size: texts meet the rows that stay once, and only repeated rows are compared further
    met = rows.join(kept.hint("merge"), same)
    first = met.filter("_n > 1").dropDuplicates(["_id", "_th", "_tn"]).unionByName(met.filter("_n = 1")).select("_row.*")
    return first.unionByName(docs.filter(~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")))
