"""All rows of the queries without SQL on sf0.001 against plain Python: both models of op1, bands and verdict of op10."""

import collections
import math
import os
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import public_tokenizers
import pytest
from helpers import WORD
from test_quality import counts

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_cross_entropy_difference(spark, docs):
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    pairs = {}
    for d, r in docs.items():
        w = [x.translate(lower) for x in WORD.findall(r.text or "")]
        pairs[d] = list(zip([None, *w], w))
    sides = [[p for d in docs for p in pairs[d] if d in good or not s] for s in (0, 1)]
    scale = (len(sides[1]) / len(sides[0]), 1.0)
    both, one, before = zip(*((collections.Counter(x), collections.Counter(w for _, w in x), collections.Counter(b for b, _ in x)) for x in sides))
    ids = len(one[0]) + 1

    def bits(s, b, w):
        unigram = (one[s][w] * scale[s] + 1) / (len(sides[1]) + ids)
        return -math.log2((both[s][b, w] * scale[s] + 50 * unigram) / (before[s][b] * scale[s] + 50))

    rows = entry.queries()["op1_cross_entropy_difference"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        x = pairs[r.doc_id]
        assert r.n_tokens == len(x)
        if x:
            target, background = (sum(bits(s, *p) for p in x) / len(x) for s in (1, 0))
            assert (r.target_bits, r.background_bits) == pytest.approx((target, background))
            assert r.difference == pytest.approx(target - background, abs=1e-9)
        else:
            assert r.target_bits is r.background_bits is r.difference is None


def test_fertility_rules(spark, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    hundredths = lambda x: float(Decimal(repr(float(x))).quantize(Decimal("0.01"), ROUND_HALF_UP))
    found, groups = {}, collections.defaultdict(list)
    for d, r in docs.items():
        assert r.lang is not None
        n_words, chars, _, _, again = counts(r.text)
        ids = [i for w in WORD.findall(r.text or "") for i in model.encode(w)]
        n = max(1, len(ids))
        share = np.array(list(collections.Counter(ids).values())) / n
        entropy = float(-(share * np.log2(share)).sum())
        failed = n_words < 10 or 100 * again > 20 * n_words
        found[d] = (r.lang, failed, chars / n, sum(map(model.is_byte, ids)) / n, entropy, math.log2(n))
        if not failed:
            groups[r.lang].append(found[d][2:])
    bands = {g: [np.percentile([hundredths(v[k]) for v in x], [25, 50, 75]) for k in range(4)] for g, x in groups.items()}
    rows = entry.queries()["op10_fertility_rules"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        lang, failed, chars, share, entropy, size = found[r.doc_id]
        assert r.base_failed == failed
        assert (r.chars_per_token, r.byte_share, r.token_entropy) == pytest.approx((chars, share, entropy), abs=1e-9)
        kept = not failed
        if kept:
            halvings = max(0.0, bands[lang][3][1] - size)
            reach = [max(2.0 * (q[2] - q[0]), least) * 2 ** (halvings / 2) for q, least in zip(bands[lang], (0.03, 0.05, 0.1))]
            c, s, e, _ = bands[lang]
            kept = c[0] - reach[0] <= chars <= c[2] + reach[0] and share <= s[2] + reach[1] and entropy >= e[0] - reach[2] - halvings
        assert r.kept == kept
