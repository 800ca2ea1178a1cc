"""Quality rules on tokeniser fertility, with the word, line and repetition counts they rest on.

A public sentence-piece vocabulary encodes each distinct word once per worker. A document's characters
per token, share of byte-fallback tokens and token entropy are held against bands of its language (or,
without one, its script), which come from the quartiles of all documents of that group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from maskloom.llm.blocks import SPACE, Block, Words, blocks, hash_runs, joined_hashes, mixed, words
from maskloom.llm.shared import written

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True

#: A document fails with fewer words, or with a larger percentage of repeated words.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Quartile distances beyond the quartiles that a document may lie, and the least width of a band on either side,
#: for groups in which most values are equal.
REACH = 2.0
LEAST_WIDTH = {"chars_per_token": 0.03, "byte_share": 0.05, "token_entropy": 0.1}

_WORDS = 800_000
_WORKER: dict[str, "WordPieces"] = {}


class WordPieces:
    """Ids of words by a sentence-piece model, remembered by word hash within a bound."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.bytes = np.array([self.model.is_byte(i) for i in range(self.size)])
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint16 if self.size <= 1 << 16 else np.uint32)

    def encode(self, block: Block, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words of the block in order, and the number of ids of each word."""
        if not len(w.hash):
            return self.ids[:0], np.zeros(0, np.int64)
        code, seen = pd.factorize(w.hash)
        if len(self.keys) + len(seen) > _WORDS:
            self.clear()
        at = np.searchsorted(self.keys, seen)
        known = np.zeros(len(seen), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == seen[inside]
        if not known.all():
            first = np.empty(len(seen), dtype=np.int64)
            first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
            first = first[~known]
            raw = block.data.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(w.starts[first], w.ends[first])]
            found = self.model.encode(texts, num_threads=1)
            count = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter((i for x in found for i in x), self.ids.dtype, int(count.sum()))
            new = seen[~known]
            order = np.argsort(new)
            where = np.searchsorted(self.keys, new[order])
            self.keys = np.insert(self.keys, where, new[order])
            self.place = np.insert(self.place, where, (len(self.ids) + np.cumsum(count) - count)[order])
            self.count = np.insert(self.count, where, count[order])
            self.ids = np.concatenate([self.ids, ids])
            at = np.searchsorted(self.keys, seen)
        count = self.count[at][code]
        until = np.cumsum(count)
        return self.ids[np.repeat(self.place[at][code] - (until - count), count) + np.arange(until[-1])], count


def pieces_of(path: str) -> WordPieces:
    if path not in _WORKER:
        _WORKER[path] = WordPieces(path)
    return _WORKER[path]


def sums(values: np.ndarray, block: Block) -> np.ndarray:
    """Per document: how many of its bytes are marked."""
    until = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return until[block.ends] - until[block.starts]


def repeated_words(w: Words, window: int = 5) -> np.ndarray:
    """Per document: words inside windows that its text holds twice or more."""
    n_docs = len(w.counts)
    h = joined_hashes(w.hash, window)
    inside = w.doc[: len(h)] == w.doc[window - 1 :] if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(n_docs, np.int64)
    with np.errstate(over="ignore"):
        key = mixed(h[at] + w.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(w.doc) + 1, np.int64)
    np.add.at(step, at[twice], 1)
    np.add.at(step, at[twice] + window, -1)
    return np.bincount(w.doc[np.cumsum(step[:-1]) > 0], minlength=n_docs)


def duplicate_lines(block: Block, w: Words) -> np.ndarray:
    """Per document: lines with a word that equal an earlier line."""
    if not len(block.data):
        return np.zeros(len(block), np.int64)
    cut = block.data == 0x0A
    starts = np.union1d(block.starts[block.starts < block.ends], np.flatnonzero(cut) + 1)
    starts = starts[starts < len(block.data)]
    ends = np.append(starts[1:], len(block.data))
    ends = ends - cut[ends - 1]
    doc = np.searchsorted(block.ends, starts, side="right")
    has = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends, doc = starts[has], ends[has], doc[has]
    h = hash_runs(block.data, starts, ends)
    frame = pd.DataFrame({"doc": doc, "h": h})
    return np.bincount(doc[frame.duplicated().to_numpy()], minlength=len(block))


def token_entropy(ids: np.ndarray, doc: np.ndarray, n_docs: int, size: int) -> np.ndarray:
    """Per document: entropy in bits of its token ids."""
    key, n = np.unique(doc * size + ids, return_counts=True)
    owner = key // size
    total = np.bincount(doc, minlength=n_docs)
    parts = np.bincount(owner, weights=n * np.log2(n), minlength=n_docs)
    return np.log2(np.maximum(total, 1)) - parts / np.maximum(total, 1)


#: Scripts by the first byte of a character in UTF-8, as byte ranges; digits and signs have none.
SCRIPTS = ["NONE", "LATIN", "GREEK", "CYRILLIC", "HEBREW", "ARABIC", "INDIC", "KANA", "HAN", "HANGUL", "OTHER"]
_LEADS = {
    "LATIN": [(0x41, 0x5A), (0x61, 0x7A), (0xC3, 0xCA)],
    "GREEK": [(0xCD, 0xCF)],
    "CYRILLIC": [(0xD0, 0xD3)],
    "HEBREW": [(0xD6, 0xD7)],
    "ARABIC": [(0xD8, 0xDB)],
    "INDIC": [(0xE0, 0xE0)],
    "KANA": [(0xE3, 0xE3)],
    "HAN": [(0xE4, 0xE9)],
    "HANGUL": [(0xEA, 0xED)],
    "OTHER": [(0xD4, 0xD5), (0xDC, 0xDF), (0xE1, 0xE1), (0xEF, 0xEF), (0xF0, 0xF4)],
}
SCRIPT = np.zeros(256, dtype=np.int64)
for _name, _ranges in _LEADS.items():
    for _a, _b in _ranges:
        SCRIPT[_a : _b + 1] = SCRIPTS.index(_name)


def scripts(block: Block) -> list[str]:
    """Per document: the script with the most characters, earlier in the list at a tie."""
    n = len(SCRIPTS)
    doc = np.repeat(np.arange(len(block)), block.ends - block.starts)
    seen = np.bincount(doc * n + SCRIPT[block.data], minlength=len(block) * n).reshape(len(block), n)
    seen[:, 0] = 0
    return [SCRIPTS[i] for i in seen.argmax(axis=1)]


MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_tokens long, n_byte_tokens long, token_entropy double, script string"
)


def measures(rows: DataFrame, text: str, keep: list[str], vocabulary: str) -> DataFrame:
    """Columns `keep` of `rows` and struct `m`, the counts of each text. No words: counts of 0, script NONE."""
    added = StructField("m", StructType.fromDDL(MEASURES))
    types = {"token_entropy": pa.float64(), "script": pa.string()}
    schema = pa.schema([pa.field(f.name, types.get(f.name, pa.int64())) for f in added.dataType])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces_of(vocabulary)
        for batch in batches:
            parts = []
            for block in blocks(batch.column(text)):
                w = words(block)
                n = len(block)
                space = SPACE[block.data]
                ids, per_word = model.encode(block, w)
                doc = np.repeat(w.doc, per_word)
                columns = [
                    w.counts,
                    sums(~space & ((block.data & 0xC0) != 0x80), block),
                    sums(SYMBOL[block.data], block),
                    duplicate_lines(block, w),
                    repeated_words(w),
                    np.bincount(doc, minlength=n),
                    np.bincount(doc[model.bytes[ids]], minlength=n),
                    token_entropy(ids, doc, n, model.size),
                    scripts(block),
                ]
                parts.append(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema))
            if parts:
                found = pa.Table.from_batches(parts).combine_chunks().to_struct_array().combine_chunks()
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), found], [*keep, "m"])

    return rows.mapInArrow(measure, StructType([*(rows.schema[c] for c in keep), added]))


def judged(docs: DataFrame, vocabulary: str, text: str = "text", lang: str | None = "lang", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of `docs` (all, if not given; one named `_q` is replaced) and struct `_q`.

    `_q` holds the counts of `MEASURES`, chars_per_token, byte_share, base_failed and kept. Null text has no
    words and fails. Bands: quartiles of all documents of a language (null language, or no such column: of
    a script) that pass the base rules, on values rounded to hundredths, widened by `REACH` quartile
    distances or the least width. Characters per token have a band on both sides, the byte share an upper
    and the entropy a lower one. A document with fewer tokens than the median of its group gets bands wider
    by the root of how many times fewer, and may lose one bit of entropy for each halving, since halves
    of a text have on average at least its entropy less one bit.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c != "_q"]
    columns = {c: f"c{i}" for i, c in enumerate(dict.fromkeys([*names, text, *([lang] if lang else [])]))}
    rows = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in columns.items()))
    carried = [columns[c] for c in dict.fromkeys([*names, *([lang] if lang else [])])]
    rows = written(measures(rows, columns[text], carried, vocabulary))

    m = F.col("m")
    base = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    tokens = F.greatest(m["n_tokens"], F.lit(1))
    rows = rows.withColumns(
        {
            "grp": F.coalesce(F.col(columns[lang]).cast("string"), m["script"]) if lang else m["script"],
            "base_failed": base,
            "chars_per_token": m["word_chars"] / tokens,
            "byte_share": m["n_byte_tokens"] / tokens,
            "token_entropy": m["token_entropy"],
            "token_bits": F.log2(tokens),
        }
    )
    value = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.round(k, 2).alias("v")) for k in (*LEAST_WIDTH, "token_bits")])).alias("x")
    quartiles = (
        rows.filter("NOT base_failed")
        .select("grp", value)
        .groupBy("grp", "x.name", "x.v")
        .agg(F.count("*").alias("n"))
        .groupBy("grp", "name")
        .agg(F.expr("percentile(v, array(0.25D, 0.5D, 0.75D), n)").alias("q"))
    )
    width = F.create_map(*[F.lit(x) for kv in LEAST_WIDTH.items() for x in kv])
    reach = F.coalesce(F.greatest(REACH * (F.col("q")[2] - F.col("q")[0]), width[F.col("name")]), F.lit(0.0))
    band = F.struct(F.col("q")[0].alias("low"), F.col("q")[1].alias("middle"), F.col("q")[2].alias("high"), reach.alias("reach"))
    bands = written(  # of known size when texts are joined
        quartiles.groupBy("grp").agg(F.map_from_entries(F.collect_list(F.struct("name", band))).alias("bands"))
    )
    chars, share, entropy = (F.col("bands")[k] for k in LEAST_WIDTH)
    halvings = F.greatest(F.lit(0.0), F.col("bands")["token_bits"]["middle"] - F.col("token_bits"))
    wider = F.pow(2.0, halvings / 2)
    inside = (
        F.col("chars_per_token").between(chars["low"] - chars["reach"] * wider, chars["high"] + chars["reach"] * wider)
        & (F.col("byte_share") <= share["high"] + share["reach"] * wider)
        & (F.col("token_entropy") >= entropy["low"] - entropy["reach"] * wider - halvings)
    )
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(False))
    verdict = F.struct("m.*", "chars_per_token", "byte_share", "base_failed", kept.alias("kept"))
    return rows.join(bands, "grp", "left").select(*(F.col(columns[c]).alias(c) for c in names), verdict.alias("_q"))
