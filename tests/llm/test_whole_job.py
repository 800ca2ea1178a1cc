"""Results that must not stop at a bound: whole vocabularies, ordinary fences, added tokens, small indexes."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import WORD, documents, mixed_texts, prose
from tokenizers import Tokenizer

from maskloom.llm.blocks import blocks
from maskloom.llm.cross_entropy import losses, score
from maskloom.llm.encode import encoder
from maskloom.llm.fertility import judged
from maskloom.llm.length_histogram import length_counts
from maskloom.llm.multi_index import search
from maskloom.llm.packing import pack
from maskloom.llm.shared import shared_folder
from maskloom.llm.token_files import token_files

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def bigram_scores(texts, target):
    """{doc_id: (tokens, target bits, background bits)} from dense tables over all words and the text start."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = {d: [x.translate(lower) for x in WORD.findall(t or "")] for d, t in texts.items()}
    at = {w: i for i, w in enumerate(sorted({w for x in tokens.values() for w in x}))}
    pairs = {d: list(zip([len(at), *(at[w] for w in x)], (at[w] for w in x))) for d, x in tokens.items()}
    table = np.zeros((2, len(at) + 1, len(at) + 1))
    for d, x in pairs.items():
        for b, w in x:
            table[0, b, w] += 1
            table[1, b, w] += d in target
    table[0] *= table[1].sum() / max(1.0, table[0].sum())
    bits = [losses(t) for t in table]
    return {d: (len(x), *(np.mean([bits[s][p] for p in x]) if x else None for s in (1, 0))) for d, x in pairs.items()}


@pytest.mark.parametrize("sizes", [{}, {"block": 1000, "bucket": 3000}, {"block": 20000, "bucket": 500, "marks": 0}])
def test_cross_entropy_keeps_every_word_and_bigram(spark, sizes):
    # 2,500 words that all end alike: a vocabulary of 2,048 ids puts rare ones of both kinds in one class
    rare = [f"{'ab'[i % 2]}{i}xyz" for i in range(2500)]
    texts = mixed_texts() + ["common words here " * 30 + " ".join(rare[i::50]) for i in range(50)]
    target = {i for i in range(len(texts)) if i % 3 == 1}
    docs = documents(spark, texts)
    found = score(docs, docs.filter("doc_id % 3 = 1").select("doc_id"), **sizes).collect()
    want = bigram_scores(dict(enumerate(texts)), target)
    assert len(found) == len(texts)
    for r in found:
        n, t, b = want[r.doc_id]
        assert r.n_tokens == n
        assert (r.target_bits, r.background_bits) == ((None, None) if t is None else pytest.approx((t, b)))


def test_fertility_fences_bind_on_both_sides_and_on_short_documents(spark):
    rng = random.Random(4)
    known = "the of and to in is that for was on with as his they at be this from have or by one had not but what all were".split()
    made = lambda n, odd, share: " ".join(odd() if rng.random() < share else rng.choice(known) for _ in range(n))
    junk, whole = (lambda: prose(rng, 1, "qxzjvk")), (lambda: rng.choice(["government", "international", "development"]))
    texts = [made(rng.randint(200, 600), junk, rng.uniform(0.18, 0.22)) for _ in range(80)]
    n = len(texts)
    texts += [made(400, junk, 0.4), made(400, whole, 0.5), made(30, junk, 1.0), made(30, junk, 0.2)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    found = {r.doc_id: r._q for r in judged(docs, PIECES, keep=["doc_id"]).collect()}
    assert not any(found[i].base_failed for i in range(len(texts)))
    assert sum(found[i].kept for i in range(n)) >= n - 2
    assert [found[n + i].kept for i in range(4)] == [False, False, False, True]


@pytest.fixture(scope="module")
def as_it_is():
    t = Tokenizer.from_file(BYTE_BPE)
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def test_added_tokens_get_the_ids_of_the_tokenizer_file(as_it_is):
    rng = random.Random(5)
    signs = [*"ab .'s\n\t 1,<|>", "<|endoftext|>", "<|endoftext|>", "<|endof", "text|>", "don't ", "é", "\u3000"]
    texts = ["one<|endoftext|>two", *("".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(800))]
    assert as_it_is(texts[0]) == [505, 50256, 11545]
    for _ in range(2):  # learnt, then remembered
        for block in blocks(pa.array(texts), most=2000):
            ids, counts = encoder(BYTE_BPE).encode(block)
            for i, x in enumerate(np.split(ids, np.cumsum(counts)[:-1])):
                assert x.tolist() == as_it_is(texts[block.first + i])


def test_added_tokens_in_files_histogram_and_packing(spark, as_it_is):
    texts = ["a b<|endoftext|>c d", "plain text", " <|endoftext|> <|endoftext|>", None, "last one"]
    docs = documents(spark, texts)
    ids = [np.array(as_it_is(t) + [0], dtype="<u4") for t in texts]
    starts = np.cumsum([0, *map(len, ids)])
    want = [(i, int(starts[i]), len(a), zlib.crc32(a)) for i, a in enumerate(ids)]
    assert sorted(map(tuple, token_files(docs, shared_folder(spark), BYTE_BPE).collect())) == want
    lengths = sorted(len(a) - 1 for a in ids)
    assert sorted(r.length for r in length_counts(docs, BYTE_BPE).collect()) == sorted(set(lengths))
    for r in pack(docs, BYTE_BPE, size=16).collect():
        assert r.doc_tokens == len(ids[r.doc_id]) and zlib.crc32(ids[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32


@pytest.mark.parametrize("n", [10, 25])
def test_small_indexes_give_all_candidates_or_k(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 6))
    rows = [(20 * i, v.tolist()) for i, v in enumerate(x)]
    found = search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    per = collections.Counter(r.query_id for r in found)
    assert per == {d: min(20, n - 1) for d, _ in rows}
