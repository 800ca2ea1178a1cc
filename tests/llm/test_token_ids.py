"""Encoding, token files, length histogram and packing against the tokenizer itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import documents, empty, long_text, mixed_texts
from tokenizers import Tokenizer

from maskloom.llm.blocks import blocks
from maskloom.llm.encode import Encoder
from maskloom.llm.length_histogram import length_counts, quantiles, truncated_totals, with_suffix_sums
from maskloom.llm.packing import pack, shortest_pack_first, slots
from maskloom.llm.shared import shared_folder
from maskloom.llm.token_files import token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


@pytest.mark.parametrize("added", [True, False])
def test_pieces_give_the_ids_of_whole_texts(added):
    tokenizer, rng = Tokenizer.from_file(PATH), random.Random(1)
    tokenizer.encode_special_tokens = not added  # the file as it is, or added tokens as ordinary text
    signs = [*"ab .'sé\n\t  　\x1c\x0b\r1,", "don't ", "<|endoftext|>", "​", "日", "🙂", "x.y "]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 50))) for _ in range(800)] + mixed_texts()
    enc = Encoder(PATH, added)
    for _ in range(2):  # learnt, then remembered
        for block in blocks(pa.array(texts), most=2000):
            ids, counts = enc.encode(block)
            for i, x in enumerate(np.split(ids, np.cumsum(counts)[:-1])):
                assert x.tolist() == tokenizer.encode(texts[block.first + i] or "", add_special_tokens=False).ids


def test_cache_stays_within_its_bound(plain, monkeypatch):
    monkeypatch.setattr("maskloom.llm.encode._PIECES", 50)
    enc = Encoder(PATH)
    for block in blocks(pa.array(mixed_texts()), most=500):
        enc.encode(block)
        assert len(enc.keys) <= 1000


def test_token_files(spark, plain):
    texts = mixed_texts() + [long_text()]
    rows = [(i * 3 % len(texts), t, 5) for i, t in enumerate(texts)] + [(None, "no id", 1), (4, "same id", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long").repartition(4)
    found = [tuple(r) for r in token_files(docs, shared_folder(spark), PATH).collect()]
    ids = {}
    for d, t, _ in rows:
        a = np.array(plain(t) + [0], dtype="<u4")
        ids.setdefault(d, []).append((len(a), zlib.crc32(a)))
    found.sort(key=lambda r: r[1])
    assert [r[0] for r in found] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    start = 0
    for d, s, n, crc in found:
        assert s == start and (n, crc) in ids[d]
        ids[d].remove((n, crc))
        start += n
    assert token_files(empty(spark), shared_folder(spark), PATH).collect() == []


def test_length_histogram(spark, plain):
    texts = mixed_texts() + [long_text()]
    lengths = np.array([len(plain(t)) for t in texts])
    sums = with_suffix_sums(length_counts(documents(spark, texts), PATH)).collect()
    assert sorted(r.length for r in sums) == sorted(set(lengths.tolist()))
    for r in sums:
        assert (r.n_docs, r.n_tokens) == ((lengths == r.length).sum(), lengths[lengths == r.length].sum())
        assert (r.docs_from, r.tokens_from) == ((lengths >= r.length).sum(), lengths[lengths >= r.length].sum())
        assert r.truncated_tokens == np.minimum(lengths, r.length).sum()
        assert r.share_below == pytest.approx((lengths < r.length).mean())
    df = with_suffix_sums(length_counts(documents(spark, texts), PATH))
    for limit, tokens, cut in truncated_totals(df, [1, 100, 10**6]).collect():
        assert (tokens, cut) == (np.minimum(lengths, limit).sum(), (lengths > limit).sum())
    for q, length in quantiles(df, [0.25, 0.5, 1.0]).collect():
        assert length == np.sort(lengths)[int(np.ceil(q * len(lengths))) - 1]
    assert with_suffix_sums(length_counts(empty(spark), PATH)).collect() == []


def test_pack_keeps_every_id_once(spark, plain):
    texts = mixed_texts() + [long_text()]
    found = pack(documents(spark, texts), PATH, size=64).collect()
    ids = [np.array(plain(t) + [0], dtype="<u4") for t in texts]
    by_doc, by_sequence = {}, {}
    for r in found:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in [*by_doc.values(), *by_sequence.values()]:
        end = 0
        for start, length in sorted(parts):
            assert start == end
            end += length
    assert all(sum(n for _, n in by_doc[i]) == len(a) for i, a in enumerate(ids))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    full = sum(map(len, ids))
    assert max(sum(n for _, n in v) for v in by_sequence.values()) <= 64
    assert full > 0.9 * 64 * len(by_sequence)
    assert pack(empty(spark), PATH).collect() == []


def test_pack_keeps_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "x y z", 0)] * 5 + [(None, None, 0)], "doc_id long, text string, rank long")
    found = pack(docs, PATH, size=16).collect()
    assert sorted(r.length for r in found) == [1] + [4] * 5
    assert len({(r.sequence_id, r.offset) for r in found}) == 6


def test_shortest_pack_first_places_long_before_short():
    assert shortest_pack_first({}, 10) == []
    assert sorted(shortest_pack_first({6: 2, 3: 1, 4: 1}, 10)) == [((6, 3), 1), ((6, 4), 1)]
    rng = random.Random(4)
    for _ in range(50):
        histogram = {rng.randint(1, 40): rng.randint(1, 30) for _ in range(12)}
        patterns = shortest_pack_first(histogram, 40)
        placed = {}
        for pattern, packs in patterns:
            assert sum(pattern) <= 40 and packs > 0
            for length in pattern:
                placed[length] = placed.get(length, 0) + packs
        assert placed == histogram
        assert all(list(first) == sorted(first) for first, _, _ in slots(patterns).values())
