"""Windows of items in texts against a plain scan, with spans in the original text."""

import random
import re

import pytest
from helpers import long_text, prose

from maskloom.llm.decontaminate import contaminated, windows

TERM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(texts, items, size=10):
    held = {}
    for item, text in items:
        w = TERM.findall((text or "").translate(AZ))
        for i in range(max(len(w) - size, 0) + 1 if w else 0):
            held.setdefault(tuple(w[i : i + size]), set()).add("" if item is None else str(item))
    out = []
    for text in texts:
        found = list(TERM.finditer((text or "").translate(AZ)))
        w = [m.group() for m in found]
        hit, named = [False] * len(w), set()
        for k in {len(x) for x in held}:
            for i in range(len(w) - k + 1):
                if (x := held.get(tuple(w[i : i + k]))) is not None:
                    hit[i : i + k] = [True] * k
                    named |= x
        spans, i = [], 0
        while i < len(w):
            if hit[i]:
                a = i
                while i + 1 < len(w) and hit[i + 1]:
                    i += 1
                spans.append((found[a].start(), found[i].end()))
            i += 1
        out.append((len(w), sum(hit), sorted(named), spans))
    return out


def cases():
    rng = random.Random(4)
    items = [(i, prose(rng, rng.randint(10, 30)).title() + "?") for i in range(12)]
    items += [(12, "Élan vital, 42!"), (13, ""), (14, None), (15, " -- "), (None, "no id here"), (3, prose(rng, 14)), (16, items[2][1]), (17, "one two one two one two one two one two one two")]
    texts = [None, "", " \n", "x", "ÉLAN élan VITAL 42", "the élan -- vital;42, NO ID here no id HERE", "one two " * 40, "𝒳𝒳 élan vital 42 𝒳"]
    for _ in range(60):
        t = prose(rng, rng.randint(0, 20))
        for _ in range(rng.randint(0, 3)):
            w = rng.choice(items)[1] or ""
            a = rng.randint(0, 60)
            t += rng.choice([" ", "\n", "... ", "é"]) + re.sub(" ", rng.choice([" ", "\t-", ", "]), w[a:])
        texts.append(t)
    return [*texts, texts[9], long_text() + items[0][1] + long_text(5, 2000)], items


@pytest.mark.parametrize("most", [1 << 25, 1500])
def test_windows_in_texts(spark, most):
    texts, items = cases()
    docs = spark.createDataFrame([(i, t, i, "k") for i, t in enumerate(texts)], "doc_id long, text string, _b int, c0 string").repartition(3)
    found = contaminated(docs, spark.createDataFrame(items, "item_id long, text string"), most=most)
    assert found.columns == ["doc_id", "text", "c0", "_b"]
    got = {r.doc_id: (r._b.n_words, r._b.n_hit, r._b["items"], [tuple(x) for x in r._b.spans]) for r in found.collect()}
    assert got == dict(enumerate(brute(texts, items)))
    assert sum(v[1] > 0 for v in got.values()) > 30


def test_empty_tables_and_repeated_rows(spark):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    docs = spark.createDataFrame([(None, "A-b c d"), (None, "A-b c d"), (1, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r._b.n_hit, r._b["items"]) for r in contaminated(docs, items).collect())
    assert got == [("1", 0, []), ("None", 3, ["1"]), ("None", 3, ["1"])]
    assert contaminated(docs.limit(0), items).count() == 0
    assert [r._b.n_hit for r in contaminated(docs, items.limit(0), keep=["doc_id"]).collect()] == [0, 0, 0]
    assert windows(items.limit(0)).count() == 0
