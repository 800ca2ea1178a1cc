"""Operators that serve many thresholds, runs or patterns in one pass, against their one-by-one forms."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskloom.operators import masks as ms
from maskloom.operators import metrics as mt
from maskloom.operators import rules as ru
from maskloom.operators import scores as sc
from maskloom.operators import spans as sp

THRESHOLDS = (0.2, 0.5, 0.8)
TEXTS = ["Ana", "Ana", "Diaz", "Mr.", "mr", "JOHN", "a@b.org", "http://www.facebook.com/ana", "12345", "+1-22", " ", "\n", "Zoe", "x"]
NAMES = ["B-NAME_STUDENT", "I-NAME_STUDENT", "B-NAME_STUDENT", "I-NAME_STUDENT", "B-PHONE_NUM", "I-EMAIL", "B-EMAIL", "B-ID_NUM"]


def top_two(spark, seed=5, documents=40):
    """Tokens of which an `O` yields to the second label at some thresholds only."""
    rng, rows = random.Random(seed), []
    for d in range(documents):
        for t in range(rng.randint(0, 25)):
            top, other = rng.choice(["O", "O", *NAMES]), rng.choice(NAMES)
            rows.append((str(d), t, rng.choice(TEXTS), rng.choice(["O", *NAMES]), top, rng.random(), other, rng.choice([1.0, 1.0, 0.0])))
    columns = "document string, token int, token_text string, gold_label string, top string, top_score double, second string, score_sum double"
    return spark.createDataFrame(rows, columns).repartition(3, "document")


def one_by_one(top, t):
    return sc.drop_blank_tokens(sc.decode(top, t)).select("document", "token", "token_text", "label")


def test_threshold_masks_equal_one_threshold_at_a_time(spark):
    top = top_two(spark).cache()
    tokens = top.select("document", "token", "token_text")
    rows = ms.correct_masks(ms.decode_masks(top, THRESHOLDS), len(THRESHOLDS), keep_steps=True)
    steps = rows.select("document", "token", "token_text", F.inline("steps")).cache()
    for i, t in enumerate(THRESHOLDS):
        preds = one_by_one(top, t)
        for name, step in ru.correction_steps(tokens).items():
            preds = step(preds).select("document", "token", "token_text", "label")
            votes = steps.filter(F.col("step") == name).withColumnRenamed("votes", "_v")
            mine = votes.select("document", "token", F.inline("_v")).filter(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0)
            got = sorted((r.document, r.token, r.label) for r in mine.collect())
            assert got == sorted((r.document, r.token, r.label) for r in preds.collect()), (t, name)
    assert rows.select("document", "token").distinct().count() == top.count()


def test_scores_by_step(spark):
    top = top_two(spark, 6).cache()
    tokens = top.select("document", "token", "token_text")
    gold = top.select("document", "token", "token_text", F.col("gold_label").alias("label")).filter("label <> 'O'")
    rows = ms.correct_masks(ms.decode_masks(top, THRESHOLDS), len(THRESHOLDS), keep_steps=True)
    found = {(r.threshold, r.step): (r.tp, r.fp, r.fn) for r in ms.scores_by_step(rows, THRESHOLDS).collect()}
    assert len(found) == len(THRESHOLDS) * len(ms.STEPS)
    want = {(r.document, r.token): r.label for r in gold.collect()}
    for t in THRESHOLDS:
        preds = one_by_one(top, t)
        for name, step in ru.correction_steps(tokens).items():
            preds = step(preds).select("document", "token", "token_text", "label")
            marks = [((r.document, r.token), want.get((r.document, r.token)) == r.label) for r in preds.collect()]
            hit = {k for k, ok in marks if ok}
            assert found[t, name] == (sum(ok for _, ok in marks), sum(not ok for _, ok in marks), len(want) - len(hit))


def test_no_rows(spark):
    top = top_two(spark).limit(0)
    rows = ms.correct_masks(ms.decode_masks(top, THRESHOLDS), 3, keep_steps=True)
    assert ms.long_labels(rows, THRESHOLDS).count() == 0 and ms.scores_by_step(rows, THRESHOLDS).count() == 0


def test_run_bits_equal_scored_pairs(spark):
    rng, names = random.Random(2), ["a", "b", "c"]
    rows = []
    for run in (None, *names, "unknown"):
        for d in range(6):
            for t in range(8):
                if rng.random() < 0.5:
                    rows.append((run, str(d), t, f"t{t}", rng.choice(NAMES[:3])))
    df = spark.createDataFrame(rows, "run string, document string, token int, token_text string, label string").cache()
    gold = df.filter("run IS NULL").drop("run").withColumn("run", F.explode(F.array(*map(F.lit, names))))
    pairs = mt.score_pairs(df.filter(F.col("run").isin(names)), gold, ("run",)).cache()
    bits = mt.run_bits(df, names).cache()
    want = {r.run: (r.tp, r.fp, r.fn, r.fbeta) for r in mt.fbeta_score(pairs, ("run",)).collect()}
    counted = mt.run_counts(bits, names)
    assert {r.run: (r.tp, r.fp, r.fn, r.fbeta) for r in counted.collect()} == want
    bar = sorted(v[3] for v in want.values())[1]
    assert mt.good_runs(counted, names, bar) == sum(1 << i for i, n in enumerate(names) if want[n][3] > bar)
    good = mt.good_runs(counted, names, bar, strict=False)
    kept = [n for i, n in enumerate(names) if good >> i & 1]
    assert len(kept) == 2
    for errors, marks, label in (("fp", ("FP", "FNFP"), "label_pred"), ("fn", ("FN",), "label_gt")):
        mine = pairs.filter(F.col("cm").isin(*marks) & F.col("run").isin(kept)).groupBy("document", "token")
        mine = mine.agg(F.count_distinct("run").alias("n"), F.min(label).alias("label")).collect()
        got = mt.error_frequency(bits, errors, good).collect()
        assert sorted((r.document, r.token, r.n_runs, r.label) for r in got) == sorted((r.document, r.token, r.n, r.label) for r in mine)


def test_sweep_over_overlapping_spans():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(2, 80))
        cuts = np.sort(rng.choice(np.arange(n + 1), int(rng.integers(2, min(n + 1, 20) + 1)), replace=False))
        start, end = cuts[:-1], cuts[1:]
        low = rng.integers(0, n, int(rng.integers(0, 15)))
        high, scores = np.minimum(low + rng.integers(0, n, len(low)), n), rng.random((len(low), 3))
        chars = np.zeros((n + 1, 3))
        for a, b, s in zip(low, high, scores):
            chars[a:b] = np.maximum(chars[a:b], s)
        assert np.allclose(sc.swept(start, end, low, high, scores), [chars[a:b].max(axis=0) for a, b in zip(start, end)])
        assert np.allclose(sc.swept(start, end, low, high, scores, end - start), [chars[a:b].mean(axis=0) for a, b in zip(start, end)])


def test_window_merge_has_one_text_pass_and_no_bucket_join(spark):
    labels = ["p", "q"]
    tokens = spark.createDataFrame([("1", 0, "ab", 0, 2), ("1", 1, "c", 3, 4), ("2", 0, "zz", 0, 2)], "document string, token int, token_text string, start int, end int")
    spans = spark.createDataFrame([("1", 0, 1, 0.25, 0.5), ("1", 0, 4, 0.125, 0.75), ("9", 0, 1, 1.0, 1.0)], "document string, piece_start int, piece_end int, p double, q double")
    got = {(r.document, r.token): (r.p, r.q) for r in sc.merge_windows(spans, tokens, labels).collect()}
    assert got == {("1", 0): (0.25, 0.75), ("1", 1): (0.125, 0.75), ("2", 0): (0.0, 0.0)}
    mean = {(r.document, r.token): (r.p, r.q) for r in sc.merge_windows(spans, tokens, labels, "mean").collect()}
    assert mean[("1", 0)] == (0.1875, 0.75)
    with pytest.raises(ValueError):
        sc.merge_windows(spans, tokens, labels, "median")


def test_patterns_do_not_hide_each_other(spark):
    docs = spark.createDataFrame([("1", "ab12345cd 12 é12345"), ("2", None), ("3", "none")], "document string, text string")
    found = sp.spans_of_all(docs, {"n": r"\d{3,}", "w": r"[a-z]+\d+[a-z]+", "x": "never"})
    assert sorted((r.document, r.key, r.span_start, r.span_end) for r in found.collect()) == [("1", "n", 2, 7), ("1", "n", 14, 19), ("1", "w", 0, 9)]
