"""The window tagger: against a plain fit, on documents it did not see, and on odd input."""

import random

import numpy as np
from pyspark.sql import functions as F

from maskloom.operators import tagger as tg
from maskloom.operators import windows as wn

NAMES = ["B-ID_NUM", "B-NAME_STUDENT", "O"]
SCHEMA = "document string, tokens array<string>, labels array<string>"


def essays(seed=3, documents=60, shuffled=False):
    """Capitalised words after `Mr.` are names, long digit runs are numbers, all else is `O`."""
    rng, rows = random.Random(seed), []
    for d in range(documents):
        tokens, labels = [], []
        for _ in range(rng.randint(1, 30)):
            kind = rng.random()
            if kind < 0.2:
                tokens += ["Mr.", "".join(rng.choice("abcdefgh") for _ in range(5)).title()]
                labels += ["O", "B-NAME_STUDENT"]
            elif kind < 0.35:
                tokens.append(str(rng.randint(10**6, 10**9)))
                labels.append("B-ID_NUM")
            else:
                tokens.append(rng.choice(["Berlin", "the", "of", "12", "\n", "x" * 70]))
                labels.append("O")
        if shuffled:
            rng.shuffle(labels)
        rows.append((str(d), tokens, labels))
    return rows


def plain_fit(rows, fold, folds, buckets, passes, step):
    """One token at a time, one fold at a time."""
    out = []
    for f in range(folds):
        w, squares = np.zeros((buckets + 2, len(NAMES))), np.zeros((buckets + 2, len(NAMES)))
        mine = [(x, y) for d, tokens, labels in rows if fold[d] != f for x, y in zip(tg.window_features(tokens, buckets), labels)]
        for _ in range(passes):
            g = np.zeros_like(w)
            for x, y in mine:
                p = np.exp(sum(w[i] for i in x))
                p /= p.sum()
                p[NAMES.index(y)] -= 1
                for i in x:
                    g[i] += p / len(mine)
            squares += g * g
            w = w - step * g / np.sqrt(squares + 1e-12)
        out.append(w)
    return np.array(out)


def test_fit_equals_a_plain_fit(spark):
    rows = essays(documents=12)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    fold = {r.document: r.fold for r in df.select("document", tg.document_fold(2).alias("fold")).collect()}
    found = tg.fit(df, NAMES, 2, buckets=64, passes=3, step=0.5)
    assert np.allclose(found, plain_fit(rows, fold, 2, 64, 3, 0.5), atol=1e-7)


def accuracy(spark, rows):
    """Share of right labels, and of right ones among the tokens that are not `O`, by models of other documents."""
    weights = tg.fit(spark.createDataFrame(rows, SCHEMA).repartition(2), NAMES, buckets=1 << 10, step=0.3)
    windows = spark.createDataFrame(rows, SCHEMA).select("document", F.lit(0).alias("window"), F.lit(0).alias("first"), "tokens")
    scored = tg.cross_scored(windows, weights, NAMES).collect()
    want = {(d, i): y for d, _, labels in rows for i, y in enumerate(labels)}
    assert len(scored) == len(want)
    marks = [(want[r.document, r.token], max(NAMES, key=lambda n: r[n])) for r in scored]
    return np.mean([a == b for a, b in marks]), np.mean([a == b for a, b in marks if a != "O"])


def test_learns_what_holds_on_other_documents(spark):
    every, entities = accuracy(spark, essays(documents=160))
    assert every > 0.97 and entities > 0.92
    assert accuracy(spark, essays(shuffled=True))[1] < 0.5


def test_odd_windows(spark):
    rows = [("1", [], []), ("2", ["", "é" * 300, "\n"], ["O", None, "B-UNKNOWN"]), (None, ["a"], ["B-ID_NUM"])]
    weights = tg.fit(spark.createDataFrame(rows, SCHEMA), NAMES, buckets=32, passes=2)
    assert weights.shape == (2, 34, 3) and np.isfinite(weights).all()
    assert not tg.fit(spark.createDataFrame([], SCHEMA), NAMES, buckets=32).any()
    assert tg.model(weights[0])([]) == []
    assert tg.shape("Ana-12345") == "Aaa-00"
    # neighbours inside the window only
    x = tg.window_features(["a", "b", "c"], 32)
    assert x[0, 4] == x[2, 6] == 33 and x[1, 4] != 33 and (x[:, 8] == 32).all()


def test_labelled_windows_hold_every_token(spark):
    toks = "array<struct<text string, ws boolean, label string>>"
    docs = spark.createDataFrame([("1", [(f"t{i}", True, "O" if i % 3 else "B-ID_NUM") for i in range(20)]), ("2", [])], f"document string, toks {toks}")
    found = wn.labelled_windows(docs, 10, 3).filter("size(tokens) > 0").orderBy("window").collect()
    assert [r.tokens[0] for r in found] == ["t0", "t5", "t10", "t15"] or len({t for r in found for t in r.tokens}) == 20
    assert {t: y for r in found for t, y in zip(r.tokens, r.labels)} == {f"t{i}": "O" if i % 3 else "B-ID_NUM" for i in range(20)}
    assert tg.sample_documents(docs, 1).count() == 1
