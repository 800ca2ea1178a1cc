"""Cross-entropy difference of documents under a target and a background bigram model.

Both models count all texts of their side, share one vocabulary and one smoothing, and background counts
are scaled to the size of the target, so they differ only in what they counted. A document's score is the mean over its tokens of target loss minus background loss:
the lower, the more it reads like the target.

The vocabulary is every word of the input, and every bigram that occurs has a count of its own; words and bigrams are
hashes. Counts never become a table that texts have to meet key by key. Texts are cut into blocks. A block asks for
each of its distinct words and bigrams once, by range of keys (a bucket); a bucket adds up what all blocks hold of its
keys and answers each in the order of its question; a block and its answers give the scores of its documents.
A frequent word or bigram is one entry in a block's question, however often it occurs, so no key makes a hot group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.blocks import Block, blocks, words
from maskloom.llm.shared import written

#: What stands before the first word of a text.
START = np.uint64(0x53544152545F4F46)
#: Weight of the unigram distribution, in tokens.
PRIOR = 50.0
#: Bytes of text in a block (a longer text is a block of its own), and bytes of text per bucket of keys.
BLOCK_BYTES = 1 << 23
BUCKET_BYTES = 1 << 24
#: Target ids that are broadcast, at most (8 bytes each); more of them meet the documents by a merge join.
MOST_MARKS = 1 << 20
_TURN = 21
#: The last two bits of a key say what it counts: a word, what stands before a word, or a bigram.
_KIND = np.uint64(3)
_WORD, _BEFORE, _PAIR = (np.uint64(k) for k in range(3))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): how often each word (by hash, A to Z lower-cased) occurs in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words(b, lower=True).hash for b in blocks(batch.column(0))]
            if found:
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["word", "n"])

    return docs.select(text).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> int:
    """Number of ids: every word, and the start of a text."""
    return counts.count() + 1


def bigrams(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens of a block and of the tokens before them in their text, their document, and the tokens per text."""
    w = words(block, lower=True)
    before = np.empty(len(w.hash), np.uint64)
    before[1:] = w.hash[:-1]
    before[(np.cumsum(w.counts) - w.counts)[w.counts > 0]] = START
    return w.hash, before, w.doc, w.counts


def keys_of(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One 64-bit key of a bigram."""
    return (before << np.uint64(_TURN)) ^ (before >> np.uint64(64 - _TURN)) ^ word


def side_counts(docs: DataFrame) -> DataFrame:
    """(before, word, n, target) from (text, side): occurrences of each bigram in all texts, and in those of side 1."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = batch.column("side").to_numpy(zero_copy_only=False)
            for b in blocks(batch.column("text")):
                word, before, doc, _ = bigrams(b)
                if not len(word):
                    continue
                code, seen = pd.factorize(keys_of(before, word))
                first = np.empty(len(seen), np.int64)
                first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
                n = np.bincount(code, minlength=len(seen))
                target = np.bincount(code[side[b.first : b.first + len(b)][doc] == 1], minlength=len(seen))
                columns = [before[first].view(np.int64), word[first].view(np.int64), n.astype(np.int64), target.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["before", "word", "n", "target"])

    counted = docs.select("text", "side").mapInArrow(count, "before long, word long, n long, target long")
    return counted.groupBy("before", "word").agg(F.sum("n").alias("n"), F.sum("target").alias("target"))


def pair_counts(docs: DataFrame, known: int | None = None) -> DataFrame:
    """(side, before, word, n) from (text, side): `side_counts` by side; side 1 counts as target as well as background.

    `known` is not needed for the counts, since no word is left out.
    """
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("n")) for s, c in enumerate(("n", "target"))])).alias("x")
    return side_counts(docs).select("before", "word", each).filter("x.n > 0").select("x.side", "before", "word", "x.n")


def losses(counts: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """Bits of each id after each id, from a whole table of counts: a bigram model smoothed by its unigrams, as in `bits`."""
    one = counts.sum(axis=0) + 1.0
    one /= one.sum()
    p = (counts + prior * one) / (counts.sum(axis=1, keepdims=True) + prior)
    return -np.log2(p)


@dataclass
class Held:
    """What a block holds: its distinct keys, ascending, the place of each token's word, word before and bigram among them, and its documents."""

    keys: np.ndarray
    places: list[np.ndarray]
    doc: np.ndarray
    n_tokens: np.ndarray


def held(block: Block) -> Held:
    word, before, doc, n = bigrams(block)
    parts = [pd.factorize((h & ~_KIND) | kind) for h, kind in ((word, _WORD), (before, _BEFORE), (keys_of(before, word), _PAIR))]
    keys = np.concatenate([seen for _, seen in parts])
    order = np.argsort(keys)
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    first = np.cumsum([0, *(len(seen) for _, seen in parts)])
    return Held(keys[order], [place[code + f] for (code, _), f in zip(parts, first)], doc, n)


def frame(columns: np.ndarray) -> bytes:
    """64-bit columns of one length as a Zstandard frame, equal bytes of the numbers side by side."""
    k, n = columns.shape
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(columns).view(np.uint8).reshape(k, n, 8).transpose(0, 2, 1).tobytes())


def unframed(data: bytes, k: int) -> np.ndarray:
    """The `k` columns that `frame` was given, as unsigned numbers."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(k, 8, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.uint64)[..., 0]


def text_blocks(sided: DataFrame, most: int) -> DataFrame:
    """(block, n_bytes, doc_ids, sides, ends, texts) from (doc_id, text, side): blocks of texts, as Zstandard frames."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for b in blocks(batch.column("text"), most):
                some = batch.slice(b.first, len(b))
                ends = pa.array(b.ends, pa.int64()).to_pylist()
                row = [block, len(b.data), some.column("doc_id").to_pylist(), some.column("side").to_pylist(), ends]
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, [*row, zstandard.ZstdCompressor(level=3).compress(b.data.tobytes())]))], schema)
                block += 1

    longs = pa.list_(pa.int64())
    schema = pa.schema([("block", pa.int64()), ("n_bytes", pa.int64()), ("doc_ids", longs), ("sides", longs), ("ends", longs), ("texts", pa.binary())])
    ddl = "block long, n_bytes long, doc_ids array<long>, sides array<long>, ends array<long>, texts binary"
    return sided.select("doc_id", "text", F.col("side").cast("long")).mapInArrow(cut, ddl)


def opened(texts: bytes, ends: list[int]) -> Block:
    stops = np.array(ends, np.int64)
    return Block(0, np.frombuffer(zstandard.ZstdDecompressor().decompress(texts), np.uint8), np.concatenate([np.zeros(1, np.int64), stops[:-1]]), stops)


def questions(table: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, question): a block's distinct keys of each bucket, with what the block itself holds of them in all and in target texts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows = np.array([-(-(i << 32) // buckets) << 32 for i in range(buckets)], np.uint64)
        for batch in batches:
            for i, block in enumerate(batch.column("block").to_pylist()):
                h = held(opened(batch.column("texts")[i].as_py(), batch.column("ends")[i].as_py()))
                target = np.array(batch.column("sides")[i].as_py(), np.int64)[h.doc] == 1
                n = np.zeros((2, len(h.keys)), np.uint64)
                for place in h.places:
                    n[0] += np.bincount(place, minlength=len(h.keys)).astype(np.uint64)
                    n[1] += np.bincount(place[target], minlength=len(h.keys)).astype(np.uint64)
                until = np.append(np.searchsorted(h.keys, lows), len(h.keys))
                some = np.flatnonzero(np.diff(until))
                asked = []
                for j in some:
                    k = slice(until[j], until[j + 1])
                    asked.append(frame(np.stack([np.diff(h.keys[k], prepend=np.uint64(0)), n[0, k], n[1, k]])))
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([block] * len(some), pa.int64()), pa.array(asked, pa.binary())], ["bucket", "block", "question"])

    return table.select("block", "sides", "ends", "texts").mapInArrow(ask, "bucket int, block long, question binary")


def answers(asked: DataFrame) -> DataFrame:
    """(block, bucket, answer, ids, tokens, target): counts over all blocks, in the order of each question.

    `ids`, `tokens` and `target` stand on one row of a bucket: its distinct words, their occurrences in all and in target texts.
    """

    def count(group: pa.Table) -> pa.Table:
        parts = [unframed(x.as_py(), 3) for x in group.column("question")]
        code, seen = pd.factorize(np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]))
        n = np.zeros((2, len(seen)), np.uint64)
        for row, own in enumerate((1, 2)):
            np.add.at(n[row], code, np.concatenate([p[own] for p in parts]))
        cuts = np.cumsum([p.shape[1] for p in parts])[:-1]
        found = [frame(n[:, c]) for c in np.split(code, cuts)]
        word = (seen & _KIND) == _WORD
        totals = [int(word.sum()), *(int(x[word].sum()) for x in n)]
        once = [pa.array([t, *[0] * (len(parts) - 1)], pa.int64()) for t in totals]
        return pa.Table.from_arrays([group.column("block"), group.column("bucket"), pa.array(found, pa.binary()), *once], ["block", "bucket", "answer", "ids", "tokens", "target"])

    return asked.groupBy("bucket").applyInArrow(count, "block long, bucket int, answer binary, ids long, tokens long, target long")


def bits(count: np.ndarray, word: np.ndarray, before: np.ndarray, tokens: float, ids: int, prior: float = PRIOR) -> np.ndarray:
    """Loss of bigrams by their counts, those of their word and of what stands before, and the tokens of their side."""
    one = (word + 1.0) / (tokens + ids)
    return np.log2(before + prior) - np.log2(count + prior * one)


def score(
    docs: DataFrame, target_ids: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK_BYTES, bucket: int = BUCKET_BYTES, marks: int = MOST_MARKS
) -> DataFrame:
    """(doc_id, n_tokens, target_bits, background_bits, difference) of every row of `docs`.

    `target_ids` (doc_id) names the target documents; the background is all documents. A text without
    words has 0 tokens and null scores. Null ids are never target; repeated ids count as often as they
    occur. Without target documents both models are uniform. `block` and `bucket` are bytes of text per block and
    per range of keys, `marks` the most target ids to broadcast; none of them changes a score.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    named = written(target_ids.select(F.col(doc_id).cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct().withColumn("side", F.lit(1)))
    few = named.count() <= marks
    sided = slim.join(named.hint("broadcast" if few else "merge"), "doc_id", "left").withColumn("side", F.coalesce("side", F.lit(0)))
    table = written(text_blocks(sided, block))
    size = table.agg(F.sum("n_bytes")).first()[0] or 0
    found = written(answers(questions(table, max(1, -(-size // bucket)))))
    total = found.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("ids", "tokens", "target"))).first()
    ids, tokens, scale = total.ids + 1, float(total.target), total.target / max(1, total.tokens)

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        h = held(opened(left.column("texts")[0].as_py(), left.column("ends")[0].as_py()))
        parts = [unframed(x.as_py(), 2) for x in right.sort_by("bucket").column("answer")]
        n = np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), np.uint64)
        some = h.n_tokens > 0
        means = []
        for counts, by in ((n[1], 1.0), (n[0], scale)):
            word, before, pair = ((counts * by)[place] for place in h.places)
            sums = np.bincount(h.doc, weights=bits(pair, word, before, tokens, ids), minlength=len(some))
            means.append(pa.array(sums / np.maximum(h.n_tokens, 1), pa.float64(), mask=~some))
        return pa.Table.from_arrays([left.column("doc_ids")[0].values, pa.array(h.n_tokens, pa.int64()), *means], ["doc_id", "n_tokens", "target_bits", "background_bits"])

    texts, replies = table.select("block", "doc_ids", "ends", "texts").groupBy("block"), found.select("block", "bucket", "answer").groupBy("block")
    each = texts.cogroup(replies).applyInArrow(scored, "doc_id long, n_tokens long, target_bits double, background_bits double")
    return each.withColumn("difference", F.col("target_bits") - F.col("background_bits"))
