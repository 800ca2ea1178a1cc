"""Benchmark passages in documents: one Aho-Corasick automaton over all windows of all items.

Items and documents are normalised alike: A to Z lower-cased, words joined by single spaces. A window is
`WINDOW` consecutive words of an item, or the whole item where it has fewer. Each text is scanned once;
ends of matches are looked up in the word ends, which lead back to offsets in the original text.

The windows are grouped and measured by Spark first. A worker holds one automaton of at most about `SHARD`
bytes of windows; more of them than that (tens of thousands of items) are dealt over several automata,
which the same rows pass one after the other, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.llm.blocks import LOWER, SIGNS, Block, Words, blocks, words

#: Words of a window.
WINDOW = 10
#: Bytes of windows, with 16 for each of their items, that one automaton holds.
SHARD = 1 << 25
#: Characters that separate words.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_FOUND = "struct<n_words: long, n_hit: long, items: array<string>, spans: array<struct<start: int, end: int>>>"
_RAW = "struct<n_words: long, hits: array<struct<first: int, last: int, start: int, end: int>>, items: array<string>>"


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(window, item): distinct windows of `size` words with the ids, as strings, of the items that hold them.

    An item of fewer words is one window, one without words or text has none. A null id reads as an empty string.
    """
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    listed = F.filter(F.split(lowered, BREAKS), lambda w: w != "")
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), listed.alias("w")).filter("size(w) > 0")
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))).alias("i")
    return rows.select("item", "w", starts).select(F.array_join(F.slice("w", F.col("i"), size), " ").alias("window"), "item").distinct()


def shards(spark: SparkSession, found: DataFrame, most: int = SHARD) -> list[Broadcast]:
    """The windows dealt by hash into parts of about `most` bytes, each as ({item: place}, windows, their places)."""
    size = found.agg(F.sum(F.octet_length("window") + 16).alias("n")).first().n or 0
    n = max(1, -(-size // most))
    place = F.pmod(F.xxhash64("window", "item"), F.lit(n))
    out = []
    for k in range(n):
        names: dict[str, int] = {}
        held: dict[str, list[int]] = {}
        for r in found.filter(place == k).toLocalIterator():
            held.setdefault(r.window, []).append(names.setdefault(r.item, len(names)))
        out.append(spark.sparkContext.broadcast((list(names), list(held), list(held.values()))))
    return out


def automaton(found: list[str]) -> ahocorasick.Automaton:
    """Finds each window between two spaces; texts are bytes read one by one, so a character may be several."""
    out = ahocorasick.Automaton()
    for k, window in enumerate(found):
        out.add_word(f" {window} ".encode().decode("latin-1"), (k, window.count(" ") + 1))
    if found:
        out.make_automaton()
    return out


def normalised(block: Block, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> tuple[str, np.ndarray]:
    """All words of a block with one space between them and two between texts, and where each word ends in it."""
    sizes = ends - starts
    at = 1 + np.cumsum(sizes + 1) - sizes - 1 + doc
    until = at + sizes
    out = np.full(int(until[-1]) + 1 if len(until) else 1, 0x20, np.uint8)
    source = np.repeat(starts - at, sizes)
    if len(source):
        target = np.arange(len(source)) + np.repeat(at - (np.cumsum(sizes) - sizes), sizes)
        out[target] = LOWER[block.data[target + source]]
    return out.tobytes().decode("latin-1"), until


def matched(machine: ahocorasick.Automaton, block: Block) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a block, and of every match its window, its first and its last word (counted in the block)."""
    w = words(block, hashes=False, breaks=SIGNS)
    text, until = normalised(block, w.starts, w.ends, w.doc)
    found = [(end, *x) for end, x in machine.iter(text)] if len(machine) else []
    end, window, size = np.array(found, np.int64).reshape(-1, 3).T
    last = np.searchsorted(until, end)
    return w, window, last - size + 1, last


def scan(held: Broadcast, names: list[str]):
    """A `mapInArrow` function: adds the words that occurrences of the held windows cover, as runs, and the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, found, of = held.value
        machine = automaton(found)
        for batch in batches:
            counts, hits, seen = [], [], []
            for block in blocks(batch.column("_text")):
                w, window, first, last = matched(machine, block)
                counts.extend(w.counts.tolist())
                own = [([], set()) for _ in range(len(block))]
                if len(window):
                    n = len(w.doc) + 1
                    edge = np.bincount(first, minlength=n) - np.bincount(last + 1, minlength=n)
                    covered = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
                    same = np.concatenate([[False], w.doc[1:] == w.doc[:-1], [False]])
                    opens = np.flatnonzero(covered[1:-1] & ~(covered[:-2] & same[:-1]))
                    closes = np.flatnonzero(covered[1:-1] & ~(covered[2:] & same[1:]))
                    letters = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
                    base = np.cumsum(w.counts) - w.counts
                    for a, b in zip(opens.tolist(), closes.tolist()):
                        d = w.doc[a]
                        zero = letters[block.starts[d]]
                        own[d][0].append({"first": a - base[d], "last": b - base[d], "start": letters[w.starts[a]] - zero, "end": letters[w.ends[b]] - zero})
                    for d, k in np.unique(np.stack([w.doc[last], window]), axis=1).T.tolist():
                        own[d][1].update(of[k])
                hits.extend(x for x, _ in own)
                seen.extend(sorted(items[i] for i in x) for _, x in own)
            arrays = [pa.array(counts, pa.int64()), pa.array(hits, HITS), pa.array(seen, pa.list_(pa.string()))]
            if len(batch):
                more = pa.StructArray.from_arrays(arrays, ["n_words", "hits", "items"])
                yield pa.RecordBatch.from_arrays([*batch.columns, more], [*names, "_new"])

    return run


HITS = pa.list_(pa.struct([(c, pa.int32()) for c in ("first", "last", "start", "end")]))


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW,
    most: int = SHARD,
    keep: list[str] | None = None,
) -> DataFrame:
    """Columns `keep` of `docs` (all, if not given; one named `_b` is replaced) and struct `_b`, a row for every row.

    `_b` holds n_words, n_hit (words inside occurrences of windows), items (distinct ids as strings, sorted
    by code point) and spans (maximal runs of hit words as character offsets in the original text, end
    exclusive, in order). Null and empty texts have no words. Repeated documents and null ids are rows of
    their own; items that share an id count as one. Without items nothing is hit.
    """
    spark = docs.sparkSession
    columns = [c for c in (docs.columns if keep is None else keep) if c != "_b"]
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)), F.col(f"`{text}`").alias("_text"))
    kept, parts = rows.columns[:-1], []
    for k, held in enumerate(shards(spark, windows(items, item_id, item_text, size), most)):
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), f"_new {_RAW}"])
        rows = rows.mapInArrow(scan(held, rows.columns), schema).withColumnRenamed("_new", f"_p{k}")
        parts.append(F.col(f"_p{k}"))
    found = [F.array_sort(F.flatten(F.array(*[p[c] for p in parts]))) for c in ("hits", "items")]
    # runs of several automata may touch or overlap: those of one text are merged in order
    merged = F.aggregate(
        found[0],
        F.array().cast(HITS_SQL),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["last"] + 1 >= x["first"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(_joined(F.element_at(done, -1), x))),
        ).otherwise(F.concat(done, F.array(x))),
    ) if len(parts) > 1 else found[0]
    rows = rows.select(*kept, parts[0]["n_words"].alias("n"), merged.alias("h"), F.array_distinct(found[1]).alias("i"))
    n_hit = F.aggregate("h", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)
    spans = F.transform("h", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    all_of = F.struct(F.col("n").alias("n_words"), n_hit.alias("n_hit"), F.col("i").alias("items"), spans.alias("spans"))
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)), all_of.cast(_FOUND).alias("_b"))


HITS_SQL = "array<struct<first: int, last: int, start: int, end: int>>"


def _joined(a, b):
    far = a["last"] >= b["last"]
    return F.struct(
        a["first"].alias("first"),
        F.greatest(a["last"], b["last"]).alias("last"),
        a["start"].alias("start"),
        F.when(far, a["end"]).otherwise(b["end"]).alias("end"),
    )
