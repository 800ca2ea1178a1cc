"""Ranked search against plain scoring of all documents: ties, repeated rows, several shards, groups of queries."""

import collections
import math
import random
import re

import pytest
from helpers import empty, long_text, mixed_texts, prose

from maskloom.llm.block_max import BLOCK, ranked

TERM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(AZ))


def plain(docs, items, k):
    counts = [(d, collections.Counter(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i].update(terms(t))
    out = {}
    for i, wanted in asked.items():
        scores = []
        for d, c in counts:
            m = 50 + (50 * sum(c.values()) * n_docs) // max(n_terms, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in wanted if c[t])
            if s:
                scores.append((-s, d is None, d or 0))
        out[i] = [(None if none else d, -s) for s, none, d in sorted(scores)[:k]]
    return {i: v for i, v in out.items() if v}


def found(df):
    out = collections.defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (str(r.item_id), r["rank"])):
        out[r.item_id].append((r.doc_id, r.score))
        assert r["rank"] == len(out[r.item_id])
    return dict(out)


def collection():
    rng = random.Random(11)
    words = [f"w{int(rng.paretovariate(0.7)) % 900}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 30, 120])))) for i in range(1500)]
    docs += [(5000 + i, docs[7][1]) for i in range(200)] + [(7, docs[7][1])] * 3 + [(None, docs[8][1])] * 2
    docs += [(9000 + i, t) for i, t in enumerate(mixed_texts())] + [(9999, long_text() + " w1 W2 w3")]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 8, 25])))) for i in range(25)]
    items += [(90, docs[7][1].upper()), (91, None), (92, " - "), (93, "nowhere to_be found"), (None, "w1 w2"), (3, "w5 w6"), (94, prose(rng, 5))]
    return docs, items


@pytest.mark.parametrize("k,shard,most", [(50, 1 << 23, 1 << 20), (3, 4000, 60), (1, 20_000, 1 << 20)])
def test_ranked_search(spark, k, shard, most):
    docs, items = collection()
    assert len(docs) > 10 * BLOCK
    rows = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, score string, m int").repartition(4)
    got = found(ranked(rows, spark.createDataFrame(items, "item_id long, text string"), k, shard=shard, most=most))
    assert got == plain(docs, items, k)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([("q", "a")], "item_id string, text string")
    assert [tuple(r) for r in ranked(docs, items).collect()] == [("q", 1, 1, plain([(1, "a b"), (2, None)], [("q", "a")], 5)["q"][0][1])]
    assert ranked(docs.limit(0), items).collect() == [] and ranked(docs, items.limit(0)).collect() == []
    assert ranked(empty(spark), items).collect() == []
