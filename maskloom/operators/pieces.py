"""Sub-word pieces by longest match over a vocabulary, with character offsets.

The vocabulary is a trie held as flat arrays: sorted edges (node and character in one number) with the nodes
they lead to, and the piece that ends at each node. All distinct tokens of an Arrow batch walk it at
once, a character per step: a token takes the longest piece that fits, and starts again behind it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.functions.labels import LABELS
from maskloom.operators.windows import subtoken_labels

UNKNOWN = -1
#: Stands behind the last character of a token; pieces that may only end one hold it.
_END = 0x10FFFF
_SHIFT = 21


@dataclass(frozen=True)
class Trie:
    """Sorted edges `node << 21 | character`, the node each leads to, and the piece of each node (-1: none)."""

    edges: np.ndarray
    to: np.ndarray
    piece: np.ndarray


def flat_trie(vocabulary: dict[str, int], end: str = "") -> Trie:
    """Trie of the pieces; with `end`, pieces that close with this mark only match at the end of a token."""
    edges: dict[int, int] = {}
    pieces = [UNKNOWN]
    for text, number in vocabulary.items():
        closing = bool(end) and text.endswith(end)
        codes = [*map(ord, text[: -len(end)] if closing else text), *([_END] if closing else [])]
        node = 0
        for c in codes:
            key = node << _SHIFT | c
            if key not in edges:
                edges[key] = len(pieces)
                pieces.append(UNKNOWN)
            node = edges[key]
        if node:
            pieces[node] = number
    keys = np.array(sorted(edges), np.int64)
    return Trie(keys, np.array([edges[k] for k in keys.tolist()], np.int32), np.array(pieces, np.int32))


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(others)}


def byte_level_vocabulary(path: str, end: str = "</w>") -> dict[str, int]:
    """Pieces as text from a tokenizer file whose pieces are written in byte characters; parts of characters are left out."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)["model"]["vocab"]
    byte, out = byte_characters(), {}
    for piece, number in found.items():
        closing = end if end and piece.endswith(end) and piece != end else ""
        try:
            out[bytes(byte[c] for c in piece.removesuffix(closing)).decode() + closing] = number
        except (KeyError, UnicodeDecodeError):
            continue
    return out


def longest_matches(trie: Trie, words: list[str]) -> tuple[np.ndarray, ...]:
    """(word, start, end, piece) of all pieces, in order of word and place; a character that fits none is `UNKNOWN`.

    A character is one code point, compared in lower case where that is one code point too.
    """
    codes, sizes = [], []
    for w in words:
        low = w.lower()
        codes.append(low if len(low) == len(w) else "".join(x if len(x := c.lower()) == 1 else c for c in w))
        sizes.append(len(w))
    size = np.array(sizes, np.int64)
    text = np.full(int(size.sum()) + len(words), _END, np.int64)
    first = np.cumsum(size + 1) - size - 1
    own = np.ones(len(text), bool)
    own[first + size] = False
    text[own] = np.frombuffer("".join(codes).encode("utf-32-le", "surrogatepass"), "<u4")
    stop = first + size  # the place of the end mark
    start, at = first.copy(), first.copy()
    node = np.zeros(len(words), np.int64)
    best, best_end = np.full(len(words), UNKNOWN), first.copy()
    live = np.flatnonzero(size > 0)
    out: list[np.ndarray] = []
    while len(live):
        here = at[live]
        key = node[live] << _SHIFT | text[np.minimum(here, stop[live])]
        place = np.minimum(np.searchsorted(trie.edges, key), max(len(trie.edges) - 1, 0))
        fits = (here <= stop[live]) & ((trie.edges[place] == key) if len(trie.edges) else False)
        go, halt = live[fits], live[~fits]
        node[go] = trie.to[place[fits]]
        at[go] += 1
        ends = go[trie.piece[node[go]] != UNKNOWN]
        best[ends], best_end[ends] = trie.piece[node[ends]], at[ends]
        if len(halt):
            none = best[halt] == UNKNOWN
            until = np.where(none, start[halt] + 1, np.minimum(best_end[halt], stop[halt]))
            out.append(np.stack([halt, start[halt] - first[halt], until - first[halt], best[halt]]))
            start[halt] = at[halt] = until
            node[halt], best[halt] = 0, UNKNOWN
        live = live[start[live] < stop[live]]
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    found = np.concatenate(out, axis=1)
    return tuple(found[:, np.lexsort((found[1], found[0]))])


def with_pieces(tokens: DataFrame, trie: Trie) -> DataFrame:
    """Rows of `tokens` (with `token_text`, `start`) by piece: adds piece, piece_id, piece_start, piece_end.

    A token without text gets one empty, unknown piece.
    """
    held = tokens.sparkSession.sparkContext.broadcast(trie)
    kind = pa.list_(pa.struct([(c, pa.int32()) for c in ("begin", "end", "id")]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, words = pd.factorize(batch.column("token_text").to_pandas().fillna(""))
            word, begin, end, piece = longest_matches(held.value, list(words))
            offsets = np.searchsorted(word, np.arange(len(words) + 1))
            parts = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (begin, end, piece)], ["begin", "end", "id"])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists.take(pa.array(code)).cast(kind)], [*batch.schema.names, "_pieces"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields)
    cut_rows = tokens.mapInArrow(cut, f"{columns}, _pieces array<struct<begin: int, end: int, id: int>>")
    each = cut_rows.select(*tokens.columns, F.posexplode_outer("_pieces").alias("piece", "_p"))
    begin, end = F.coalesce("_p.begin", F.lit(0)), F.coalesce("_p.end", F.lit(0))
    return each.select(
        *tokens.columns,
        F.coalesce("piece", F.lit(0)).alias("piece"),
        F.coalesce("_p.id", F.lit(UNKNOWN)).alias("piece_id"),
        (F.col("start") + begin).alias("piece_start"),
        (F.col("start") + end).alias("piece_end"),
    )


def labelled_pieces(pieces: DataFrame, vocabulary=LABELS) -> DataFrame:
    """Adds `first_id` and `all_id`: a token's label on its first piece, and -100 or the I-form on the others."""
    one = subtoken_labels(pieces, vocabulary=vocabulary).withColumnRenamed("label_id", "first_id")
    return subtoken_labels(one, label_all=True, vocabulary=vocabulary).withColumnRenamed("label_id", "all_id")

