"""Jaccard join, components and repeated windows against brute force."""

import collections
import hashlib
import random

import pytest
from helpers import WORD, documents, empty, long_text, mixed_texts

from maskloom.llm.components import components
from maskloom.llm.jaccard_join import near_duplicates, one_of_each
from maskloom.llm.suffix_windows import without_repeats


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def sets_and_components(docs, n, percent):
    sets = {}
    for d, t in docs:
        w = WORD.findall(lower(t or ""))
        sets[d] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    least = {d: d for d in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                least[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def near_copies(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(8):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 12, 40, 90, 150]))]
        for _ in range(25):
            x = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                k, r = rng.randrange(len(x)), rng.random()
                if r < 0.5:
                    x[k] = rng.choice(vocabulary)
                elif r < 0.8:
                    x.insert(k, rng.choice(vocabulary))
                elif len(x) > 1:
                    x.pop(k)
            texts.append(" ".join(x).title() if rng.random() < 0.2 else " ".join(x))
    return texts + [None, "", "  \n", "A b", "a B", "one"]


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_near_duplicates(spark, n, percent):
    texts = near_copies() + mixed_texts()[-10:]
    docs = documents(spark, texts).selectExpr("doc_id + 7 AS doc_id", "text", "'x' AS th", "1 AS size")
    found = near_duplicates(docs, n, percent).collect()
    assert found[0].th == "x" and found[0].size == 1
    want = sets_and_components([(i + 7, t) for i, t in enumerate(texts)], n, percent)
    assert {r.doc_id: (r._j.n_shingles, r._j.component_id) for r in found} == want
    kept = one_of_each(docs, n, percent).collect()
    assert sorted(r.doc_id for r in kept) == sorted(d for d, (size, c) in want.items() if d == c)


def test_near_duplicates_of_repeated_rows_and_null_ids(spark):
    t = "a b c d e f g h i j k l"
    docs = spark.createDataFrame([(5, t), (5, t), (None, t), (None, "x y z q r s t"), (9, t + " m")], "doc_id long, text string")
    found = sorted(((r.doc_id or 0, r._j.component_id) for r in near_duplicates(docs).collect()), key=str)
    assert found == [(0, 5), (0, None), (5, 5), (5, 5), (9, 5)]
    assert sorted(str(r.doc_id) for r in one_of_each(docs, 3, 90).collect()) == ["5", "None"]
    assert near_duplicates(empty(spark)).collect() == [] and one_of_each(empty(spark)).collect() == []


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (300, 200)]
    found = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert found == {**{i: 1 for i in range(1, 61)}, 100: 100, 200: 100, 300: 100}


def repeats(texts, size):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[p : p + size] for b in data for p in range(len(b) - size + 1))
    out = {}
    for d, b in enumerate(data):
        gone = [False] * len(b)
        for p in range(len(b) - size + 1):
            if seen[b[p : p + size]] > 1:
                gone[p : p + size] = [True] * size
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("size", [192, 400])
def test_repeated_windows(spark, size):
    texts = mixed_texts(seed=size)
    docs = documents(spark, texts).selectExpr("*", "1 AS n_removed", "'k' AS sha")
    found = without_repeats(docs, size).collect()
    assert found[0].n_removed == 1 and found[0].sha == "k"
    assert {r.doc_id: tuple(r._r) for r in found} == repeats(texts, size)


@pytest.mark.parametrize("size", [1200, 2000])
def test_repeats_of_long_windows(spark, size):
    rng = random.Random(size)
    same = "".join(rng.choice("abcd ") for _ in range(3 * size))
    texts = ["x" * 50 + same, same[: size + 7] + "tail", "head" + same[size - 9 :], "a" * (size - 1), same[: size - 1], "b" * (size + 3)]
    found = {r.doc_id: tuple(r._r) for r in without_repeats(documents(spark, texts), size).collect()}
    assert found == repeats(texts, size)
    with pytest.raises(ValueError):
        without_repeats(documents(spark, texts), 1 << 20)


def test_repeats_in_a_long_text(spark):
    t = long_text(n=120_000)
    texts = [t, "x" + t[500_000:600_000] + "y", None]
    found = {r.doc_id: r._r for r in without_repeats(documents(spark, texts)).collect()}
    n = len(t[500_000:600_000].encode())
    assert (found[0].n_removed, found[0].n_spans, found[1].n_removed, found[1].n_bytes) == (n, 1, n, n + 2)
    assert without_repeats(empty(spark)).collect() == []
