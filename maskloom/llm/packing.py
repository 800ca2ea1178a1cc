"""Packing documents into training sequences: shortest pack first over the length histogram.

Documents are cut into pieces of at most `size` tokens. The histogram of piece lengths has at most
`size` entries, so the packing itself runs on the driver: lengths are placed longest first, each into
the shortest open packs that have room, as patterns with counts. Pieces then get ranks among those of
their length, and the rank says which slot of which pattern they fill.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm.blocks import blocks
from maskloom.llm.encode import encoder, with_end
from maskloom.llm.shared import written


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in order, how many packs) that hold every piece of `histogram` {length: pieces}.

    Lengths are placed longest first. Open packs are grouped by pattern; the group of the shortest pack
    takes one piece per pack until the pieces are placed, and new packs open when nothing has room.
    """
    closed: list[tuple[tuple[int, ...], int]] = []
    open_: list[tuple[int, int, tuple[int, ...], int]] = []  # used, order, pattern, packs
    order = count()
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        grown = []
        while left and open_ and open_[0][0] + length <= size:
            used, _, pattern, packs = heapq.heappop(open_)
            take = min(left, packs)
            left -= take
            grown.append((used + length, next(order), (*pattern, length), take))
            if take < packs:
                heapq.heappush(open_, (used, next(order), pattern, packs - take))
            if not left:
                break
            if not open_ or open_[0][0] + length > size:  # packs that took a piece may have room again
                for g in grown:
                    heapq.heappush(open_, g)
                grown = []
        for g in grown:
            heapq.heappush(open_, g)
        if left:
            each = size // length
            full, rest = divmod(left, each)
            for packs, pieces in ((full, each), (1, rest)):
                if packs and pieces:
                    heapq.heappush(open_, (pieces * length, next(order), (length,) * pieces, packs))
        while open_ and open_[0][0] == size:
            closed.append(heapq.heappop(open_)[2:])
    return closed + [g[2:] for g in sorted(open_)]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: ascending first ranks of its slots, with the first sequence and the offset of each."""
    out: dict[int, list[list[int]]] = {}
    base = 0
    for pattern, packs in patterns:
        offset = 0
        for length in pattern:
            ranks = out.setdefault(length, [[0], [], []])
            ranks[0].append(ranks[0][-1] + packs)
            ranks[1].append(base)
            ranks[2].append(offset)
            offset += length
        base += packs
    return {k: (np.array(r[0][:-1]), np.array(r[1]), np.array(r[2])) for k, r in out.items()}


def cut_into_pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int = 0) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): pieces of at most `size` ids, the end id included.

    Null text is empty (one piece, the end id). Null and repeated doc_ids keep their rows.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for block in blocks(batch.column("text")):
                ids, counts = with_end(*enc.encode(block), end_id)
                n = -(-counts // size)
                doc = np.repeat(np.arange(len(counts)), n)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * size
                length = np.minimum(size, counts[doc] - start)
                at = np.repeat(np.cumsum(counts) - counts, n) + start
                ids = ids.astype("<u4", copy=False)
                crc = [zlib.crc32(ids[a : a + k]) for a, k in zip(at, length)]
                key = batch.column("doc_id").slice(block.first, len(block)).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays(
                    [key, *(pa.array(x, pa.int64()) for x in (start, length, crc, counts[doc]))],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    )


def ranked(pieces: DataFrame, histogram: DataFrame) -> DataFrame:
    """Add `rank` from 0 among pieces of a length; no task sees more than about the square root of them.

    `histogram` (length, n) has at most `size` rows. Pieces of a length are dealt by hash into as many
    groups as the root of their number; ranks are the sizes of earlier groups plus the place in the own.
    """
    parts = histogram.select("length", F.ceil(F.sqrt("n")).alias("_parts"))
    dealt = pieces.join(F.broadcast(parts), "length").withColumn(
        "_part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("_parts"))
    )
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        dealt.groupBy("length", "_part")
        .agg(F.count("*").alias("_n"))
        .select("length", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    )
    inside = Window.partitionBy("length", "_part").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    return (
        dealt.join(bases, ["length", "_part"])
        .withColumn("rank", F.col("_base") + F.row_number().over(inside) - 1)
        .drop("_parts", "_part", "_base")
    )


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces of all documents with `sequence_id` and `offset` of their place; see `cut_into_pieces`."""
    pieces = written(cut_into_pieces(docs, tokenizer, size, end_id))
    histogram = pieces.groupBy("length").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in histogram.collect()}  # at most `size` rows
    place = slots(shortest_pack_first(counts, size))
    histogram = docs.sparkSession.createDataFrame(sorted(counts.items()), "length long, n long")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                first, base, inner = place[k]
                slot = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at] = base[slot] + rank[at] - first[slot]
                offset[at] = inner[slot]
            kept = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return ranked(pieces, histogram).mapInArrow(
        put,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
