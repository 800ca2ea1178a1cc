"""Ranked lexical search with Block-Max MaxScore over index shards.

A shard holds the posting lists of up to `SHARD` bytes of texts: per term (a 64-bit hash) blocks of `BLOCK`
postings, each with its last document, the highest impact in it and packed gaps and counts. Shards are rows
of a written table. A query sorts a shard's lists by their global bounds (weight times highest impact).
Those whose bounds together stay below the score to beat are not essential: only the others bring up
candidates, and the block maxima of the rest reject candidates before any of their blocks is unpacked. The
score to beat comes from the query's best documents so far, over all shards that a task reads. The best
documents of all tasks are merged in two steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm.blocks import SIGNS, blocks, words
from maskloom.llm.shared import written

#: Bytes of text, and documents, after which a shard is full.
SHARD, SHARD_ROWS = 1 << 23, 1 << 16
#: Postings of a block; documents that are scored before the score to beat is read again.
BLOCK, RANGE = 64, 4096
#: Terms of all queries, with repeats, that are searched for in one pass over the index.
QUERY_TERMS = 1 << 20
#: Groups of tasks in the first step of the merge.
GROUPS = 256

_PARTS = ("ids", "known", "m", "terms", "df", "first", "last", "top", "at", "widths", "blob")
_TYPES = {"ids": "<i8", "known": "?", "m": "<i8", "terms": "<u8", "df": "<i4", "first": "<i4", "last": "<i4", "top": "<i4", "at": "<i8", "widths": "u1", "blob": "u1"}
_BYTES = np.array([1, 2, 4])


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def sizes(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, terms with repeats) of the column `_text`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [words(b, hashes=False, breaks=SIGNS).counts for b in blocks(batch.column("_text"))]
            n = np.concatenate([np.zeros(1, np.int64), *n])
            yield pa.RecordBatch.from_arrays([pa.array([np.count_nonzero(n)]), pa.array([n.sum()])], ["d", "t"])

    r = docs.select("_text").mapInArrow(count, "d long, t long").agg(F.sum("d").alias("d"), F.sum("t").alias("t")).first()
    return r.d or 0, r.t or 0


def _packed(values: np.ndarray, width: np.ndarray, at: np.ndarray, blob: np.ndarray) -> None:
    """Write every value at its place with the bytes its block takes."""
    for w in range(3):
        if (here := np.flatnonzero(width == w)).size:
            n = int(_BYTES[w])
            blob[at[here][:, None] + np.arange(n)] = values[here].astype(f"<u{n}").view(np.uint8).reshape(-1, n)


def shard_of(postings: list[tuple[np.ndarray, np.ndarray, np.ndarray]], ids: np.ndarray, known: np.ndarray, m: np.ndarray) -> dict:
    """The arrays of a shard from (terms, documents, counts) of its texts, documents ascending."""
    term, doc, tf = (np.concatenate(x) for x in zip(*postings))
    postings.clear()
    order = np.argsort(term, kind="stable")
    term, doc, tf = term[order], doc[order], tf[order]
    del order
    start = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
    df = np.diff(np.append(start, len(term)))
    place = np.arange(len(term)) - np.repeat(start, df)
    head = np.flatnonzero(place % BLOCK == 0)
    block = np.cumsum(place % BLOCK == 0) - 1
    n = np.diff(np.append(head, len(term)))
    before = np.empty_like(doc)
    before[1:] = doc[:-1]
    before[start] = -1
    gap = doc - before
    widths = [np.searchsorted([256, 65536], np.maximum.reduceat(x, head) if len(head) else x, side="right") for x in (gap, tf)]
    each = _BYTES[widths[0]] + _BYTES[widths[1]]
    at = np.concatenate([[0], np.cumsum(n * each)])
    blob = np.empty(int(at[-1]), np.uint8)
    row = place % BLOCK
    _packed(gap, widths[0][block], at[block] + row * _BYTES[widths[0][block]], blob)
    _packed(tf, widths[1][block], at[block] + (n * _BYTES[widths[0]])[block] + row * _BYTES[widths[1][block]], blob)
    found = impact(tf.astype(np.int64), m[doc])
    per_term = -(-df // BLOCK)
    return {
        "ids": ids,
        "known": known,
        "m": m,
        "terms": term[start],
        "df": df,
        "first": np.concatenate([[0], np.cumsum(per_term)]),
        "last": doc[np.append(head, len(term))[1:] - 1] if len(head) else doc,
        "top": np.maximum.reduceat(found, head) if len(head) else found,
        "at": at,
        "widths": widths[0] * 3 + widths[1],
        "blob": blob,
    }


def index(docs: DataFrame, n_docs: int, n_terms: int, shard: int = SHARD) -> DataFrame:
    """A row per shard from (`_id`, `_text`), for a collection of `n_docs` documents with `n_terms` terms."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        postings, ids, counts, size = [], [], [], 0

        def full() -> pa.RecordBatch:
            n = np.concatenate(counts)
            m = 50 + (50 * n * n_docs) // max(n_terms, 1)
            key = pa.concat_arrays(ids)
            found = shard_of(postings, key.fill_null(0).to_numpy(), key.is_valid().to_numpy(zero_copy_only=False), m)
            return pa.RecordBatch.from_arrays([pa.array([found[c].astype(_TYPES[c]).tobytes()], pa.binary()) for c in _PARTS], list(_PARTS))

        for batch in batches:
            for b in blocks(batch.column("_text")):
                if size and (size + len(b.data) > shard or sum(map(len, ids)) + len(b) > SHARD_ROWS):
                    yield full()
                    postings, ids, counts, size = [], [], [], 0
                w = words(b, lower=True, breaks=SIGNS)
                code, seen = pd.factorize(w.hash)
                pair, tf = np.unique(code.astype(np.int64) * len(b) + w.doc, return_counts=True)
                postings.append((np.asarray(seen)[pair // len(b)], (pair % len(b) + sum(map(len, ids))).astype(np.int32), tf.astype(np.int32)))
                ids.append(batch.column("_id").slice(b.first, len(b)))
                counts.append(w.counts)
                size += len(b.data) or 1
        if ids:
            yield full()

    return docs.select("_id", "_text").mapInArrow(build, ", ".join(f"{c} binary" for c in _PARTS))


@dataclass
class Postings:
    """One list of a shard: its blocks, unpacked on demand."""

    shard: Shard
    low: int
    high: int
    df: int
    weight: int

    def __post_init__(self) -> None:
        self.last = self.shard.last[self.low : self.high]
        self.top = self.shard.top[self.low : self.high].astype(np.int64) * self.weight
        self.bound = int(self.top.max())

    def unpack(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents, and weight times impact, of the chosen blocks (ascending places in the list)."""
        s, docs, tfs = self.shard, [], []
        n_last = self.df - BLOCK * (self.high - self.low - 1)
        whole = chosen[chosen < self.high - self.low - 1] if n_last < BLOCK else chosen
        for some, n in ((whole, BLOCK), (chosen[len(whole) :], n_last)):
            if not len(some):
                continue
            width = s.widths[self.low + some]
            for kind in np.unique(width) if len(some) > 1 else width:
                mine = some[width == kind] if len(some) > 1 else some
                a, b = int(_BYTES[kind // 3]), int(_BYTES[kind % 3])
                raw = s.blob[s.at[self.low + mine][:, None] + np.arange(n * (a + b))]
                gap = raw[:, : n * a].copy().view(f"<u{a}").astype(np.int64)
                base = np.where(mine > 0, self.last[mine - 1], -1)
                docs.append((np.cumsum(gap, axis=1) + base[:, None]).ravel())
                tfs.append(raw[:, n * a :].copy().view(f"<u{b}").astype(np.int64).ravel())
        doc = np.concatenate(docs)
        return doc, self.weight * impact(np.concatenate(tfs), s.m[doc])


class Shard:
    def __init__(self, batch: pa.RecordBatch, row: int) -> None:
        for c in _PARTS:
            setattr(self, c, np.frombuffer(batch.column(c)[row].as_buffer(), _TYPES[c]))

    def lists(self, terms: np.ndarray, weights: np.ndarray) -> list[Postings]:
        """Lists of the terms that the shard holds, by ascending bound."""
        at = np.searchsorted(self.terms, terms)
        held = [(int(i), int(w)) for i, t, w in zip(at, terms, weights) if i < len(self.terms) and self.terms[i] == t]
        return sorted((Postings(self, int(self.first[i]), int(self.first[i + 1]), int(self.df[i]), w) for i, w in held), key=lambda x: x.bound)


class Best:
    """The k best (score, id) of a query; equal scores by ascending id, null ids last."""

    def __init__(self, k: int) -> None:
        self.k, self.least = k, 1
        self.score, self.id, self.known = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        score, ids, known = np.append(self.score, score), np.append(self.id, ids), np.append(self.known, known)
        if len(score) > self.k:
            order = np.lexsort((ids, ~known, -score))[: self.k]
            score, ids, known = score[order], ids[order], known[order]
            self.least = max(1, int(score[-1]))
        self.score, self.id, self.known = score, ids, known


def max_score(shard: Shard, lists: list[Postings], best: Best, step: int = RANGE) -> None:
    """Offer `best` all documents of the shard that may belong to it."""
    if not lists:
        return
    below = np.concatenate([[0], np.cumsum([x.bound for x in lists])])
    n = len(shard.m)
    for low in range(0, n, step):
        high = min(n, low + step)
        # lists before `split` cannot reach the score to beat together
        split = int(np.searchsorted(below, best.least, side="left")) - 1
        if split >= len(lists):
            return
        score = np.zeros(high - low, np.int64)
        for x in lists[split:]:
            chosen = np.arange(np.searchsorted(x.last, low), min(np.searchsorted(x.last, high - 1) + 1, len(x.last)))
            if len(chosen):
                doc, more = x.unpack(chosen)
                inside = (doc >= low) & (doc < high)
                score[doc[inside] - low] += more[inside]  # a document stands once in a list
        found = np.flatnonzero(score)
        score = score[found]
        found += low
        # block maxima of the other lists, before any of their blocks is unpacked
        places = [np.searchsorted(x.last, found) for x in lists[:split]]
        tops = [np.append(x.top, 0)[at] for x, at in zip(lists, places)]
        bound = score + sum(tops) if tops else score
        for k in range(split - 1, -1, -1):
            keep = bound >= best.least
            if not keep.all():
                found, score, bound = found[keep], score[keep], bound[keep]
                places, tops = [p[keep] for p in places[: k + 1]], [t[keep] for t in tops[: k + 1]]
            if not len(found):
                break
            x, at = lists[k], places[k]
            chosen = np.unique(at)
            chosen = chosen[chosen < len(x.last)]
            gain = np.zeros(len(found), np.int64)
            if len(chosen):
                doc, more = x.unpack(chosen)
                order = np.argsort(doc)
                doc, more = doc[order], more[order]
                there = np.minimum(np.searchsorted(doc, found), len(doc) - 1)
                gain = np.where(doc[there] == found, more[there], 0)
            score = score + gain
            bound = bound - tops[k] + gain
        keep = score >= best.least
        found = found[keep]
        best.add(score[keep], shard.ids[found], shard.known[found])


def _search(queries: Broadcast, k: int):
    """A `mapInArrow` function over shards: the best documents of the task for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = queries.value
        best = [Best(k) for _ in asked]
        for batch in batches:
            for row in range(len(batch)):
                shard = Shard(batch, row)
                for (terms, weights), found in zip(asked, best):
                    max_score(shard, shard.lists(terms, weights), found)
        rows = [len(b.id) for b in best]
        if sum(rows):
            ids = pa.array(np.concatenate([b.id for b in best]), mask=~np.concatenate([b.known for b in best]))
            score = pa.array(np.concatenate([b.score for b in best]))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(best)), rows)), ids, score], ["query", "doc_id", "score"])

    return run


def query_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, term): distinct terms, as hashes, of all texts of an item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column("_text")):
                w = words(b, lower=True, breaks=SIGNS)
                ids = batch.column("item_id").slice(b.first, len(b)).take(pa.array(w.doc))
                yield pa.RecordBatch.from_arrays([ids, pa.array(w.hash.view(np.int64))], ["item_id", "term"])

    rows = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("_text"))
    kind = rows.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"item_id {kind}, term long").distinct()


def document_counts(shards: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """How many documents hold each of the terms, from the shards' dictionaries."""
    asked = shards.sparkSession.sparkContext.broadcast(np.sort(terms.view(np.uint64)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held, df in zip(batch.column("terms"), batch.column("df")):
                held, df = np.frombuffer(held.as_buffer(), _TYPES["terms"]), np.frombuffer(df.as_buffer(), _TYPES["df"])
                hit = np.isin(held, asked.value)
                yield pa.RecordBatch.from_arrays([pa.array(held[hit].view(np.int64)), pa.array(df[hit].astype(np.int64))], ["term", "df"])

    found = shards.select("terms", "df").mapInArrow(look, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r.term: r.df for r in found.toLocalIterator()}


def ranked(
    docs: DataFrame,
    items: DataFrame,
    k: int = 50,
    text: str = "text",
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    item_text: str = "text",
    shard: int = SHARD,
    most: int = QUERY_TERMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents with a score above 0 for each item.

    A term is a maximal run of letters, digits and non-ASCII characters, A to Z lower-cased. Null and empty
    texts have none. Rows of `docs` are documents of their own even if they share an id or have none (null
    ids come last among equal scores); items that share an id (or have none) are one item with the terms of
    all of them. Other columns do not matter. Without documents or terms there are no rows. Items are
    searched in groups of about `most` terms, each by one pass over the written index.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("_id"), F.col(f"`{text}`").alias("_text"))
    n_docs, n_terms = sizes(slim)
    shards = written(index(slim, n_docs, n_terms, shard))
    asked = written(query_terms(items, item_id, item_text))
    groups = max(1, -(-asked.count() // most))
    group = F.pmod(F.xxhash64("item_id"), F.lit(groups))
    found = None
    for g in range(groups):
        table = asked.filter(group == g).toArrow()
        place = {x: i for i, x in enumerate(dict.fromkeys(table["item_id"].to_pylist()))}
        code = np.array([place[x] for x in table["item_id"].to_pylist()], np.int64)
        terms = table["term"].to_numpy()
        df = document_counts(shards, np.unique(terms))
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) if t in df else 0 for t in terms.tolist()], np.int64)
        order = np.argsort(code, kind="stable")
        order = order[weight[order] > 0]
        cuts = np.searchsorted(code[order], np.arange(1, len(place)))
        queries = list(zip(np.split(terms[order].view(np.uint64), cuts), np.split(weight[order], cuts))) if place else []
        best = shards.mapInArrow(_search(spark.sparkContext.broadcast(queries), k), "query long, doc_id long, score long")
        kind = items.schema[item_id].dataType.simpleString()
        named = spark.createDataFrame([(i, x) for x, i in place.items()], f"query long, item_id {kind}")
        best = best.withColumn("_g", F.spark_partition_id() % GROUPS).join(F.broadcast(named), "query")
        found = best if found is None else found.unionByName(best)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for keys in (["item_id", "_g"], ["item_id"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    return found.select("item_id", "rank", "doc_id", "score")
