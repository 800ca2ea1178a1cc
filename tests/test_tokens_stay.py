"""Token rows stay where their documents were dealt, and per-token work is done once."""

import re

import numpy as np
from pyspark.sql import functions as F

from maskloom.functions import text as tx
from maskloom.operators import patches as pa
from maskloom.operators import scores as sc
from maskloom.operators import tokens as tk
from maskloom.operators import windows as wn
from maskloom.plans import frames as fr

SF = "/root/testdata/sf0.001"


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> int:
    return executed(df).count("Exchange hashpartitioning")


def test_replaced_scores_meet_their_tokens_without_a_shuffle(spark):
    fields = "document string, token int, text string, p double, q double"
    first = tk.colocate(spark.createDataFrame([("a", 0, "x", 0.1, 0.2), ("a", 0, "y", 0.3, 0.4), ("a", 1, "z", 0.5, 0.6), (None, 0, "n", 0.7, 0.8)], fields))
    second = tk.colocate(spark.createDataFrame([("a", 0, "", 1.0, None), ("a", 0, "", 2.0, 3.0), ("b", 0, "", 4.0, 4.0), (None, 0, "", 5.0, 5.0)], fields))
    found = sc.replace_scores(first, second.drop("text"), ["p", "q"])
    assert found.columns == first.columns
    assert exchanges(found) == 2  # one for each input, none for their meeting
    assert sorted(map(tuple, found.collect()), key=str) == sorted(
        [("a", 0, "x", 1.0, 0.2), ("a", 0, "x", 2.0, 3.0), ("a", 0, "y", 1.0, 0.4), ("a", 0, "y", 2.0, 3.0), ("a", 1, "z", 0.5, 0.6), (None, 0, "n", 0.7, 0.8)], key=str
    )


def test_softmax_of_any_scores(spark):
    rows = [(1.0, 2.0, 3.0), (-800.0, 900.0, 0.0), (0.0, 0.0, 0.0)]
    got = sc.softmax(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k int, a double, b double, c double"), ["a", "b", "c"]).orderBy("k")
    assert got.columns == ["k", "a", "b", "c"]
    power = np.exp(np.array(rows) - np.max(rows, axis=1, keepdims=True))
    assert np.allclose([r[1:] for r in got.collect()], power / power.sum(axis=1, keepdims=True), atol=1e-15)


def test_top_two_with_ties_and_missing_scores(spark):
    nan = float("nan")
    rows = [(0.2, 0.5, 0.3), (0.5, 0.5, 0.1), (0.1, 0.4, 0.4), (0.3, 0.3, 0.3), (None, 0.1, None), (None, None, None), (nan, 0.2, 0.9), (-0.0, 0.0, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k int, a double, b double, c double")
    got = {r.k: (r.top, r.second, r.score_sum) for r in sc.with_top_two(df, ["a", "b", "c"]).collect()}
    want = [("b", "c"), ("b", "a"), ("c", "b"), ("c", "b"), ("b", "c"), ("c", "b"), ("a", "c"), ("b", "a")]
    assert [got[i][:2] for i in range(len(rows))] == want
    assert got[0][2] == 1.0 and got[4][2] is None


def test_titles_begin_with_no_small_letter(spark):
    texts = ["Ana", "ana", "aNA", "{Ana", "`Ana", "1Ana", "Éa", "éa", "", "ǅa", "-Ana", "z", "O'Brien", "McDonald", None]
    got = {r.t: r.y for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.istitle(F.col("t")).alias("y")).collect()}
    assert got == {t: None if t is None else t.istitle() for t in texts}


def test_lost_mass_draws_once_per_token(spark):
    from maskloom.plans.q_scores import c15_lost_mass

    # two digests of scores (raw score, draw), and those of the rule labels, in the plan; a draw per label would be twelve
    plan = c15_lost_mass(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("mass") == 1


def test_window_scores_meet_without_a_shuffle(spark):
    docs = tk.colocate(spark.createDataFrame([("a", "one two three four five six"), ("a", "one two"), ("b", None), (None, "x")], "document string, text string"))
    windows = wn.window_tokens(tk.tokenize(docs).select("document", "toks"), 5, 1)
    scored = sc.score_windows(windows, [lambda t: [[0.0, len(t), 9.0]] * len(t), lambda t: np.array([[1.0, len(t)]] * len(t))], ["p", "q"], F.when(F.col("document") == "a", 0).otherwise(1))
    best = sc.best_over_windows(scored, ["p", "q"])
    assert exchanges(best) == 1  # the documents
    got = {(r.document, r.token): (r.p, r.q) for r in best.collect()}
    assert got == {**{("a", t): (0.0, 3.0) for t in range(5)}, ("a", 5): (0.0, 2.0), (None, 0): (1.0, 1.0)}


GOLD = [("a", 0, "Ana", "B-NAME_STUDENT"), ("a", 1, "real", "O"), ("a", 1, "real", "O"), ("a", 1, "sea", "B-USERNAME"), ("b", 0, "real", "O"), (None, 0, "real", "O"), ("a", None, "real", "O")]
PATCHES = [
    ("a", 1, "equal", "Ana", None, "O"), ("a", 2, "contains", "ea", "O", "B-USERNAME"), ("a", 3, "equal", "real", "B-NAME_STUDENT", "I-EMAIL"),
    ("a", 0, "contains", "n", None, "I-EMAIL"), (None, 9, "equal", "real", None, "X"), ("c", 1, "equal", "Ana", None, "O"), ("b", 1, "other", "real", None, "X"),
]


def patched(spark):
    gold = tk.colocate(spark.createDataFrame(GOLD, "document string, token int, token_text string, label string"))
    patches = tk.colocate(spark.createDataFrame(PATCHES, "document string, nr int, match_kind string, pattern string, only_label string, new_label string"))
    return gold, pa.patch_labels(gold, patches)


def test_patched_tokens_are_not_shuffled(spark):
    gold, rows = patched(spark)
    assert rows.columns == gold.columns
    assert exchanges(rows) == 2 and executed(rows).count("Sort [document") == 1
    new = {("a", 0): "O", ("a", 1): "B-USERNAME"}
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([(*r[:3], new.get(r[:2], r[3])) for r in GOLD], key=str)


def test_label_differences_are_found_without_a_shuffle(spark):
    gold, rows = patched(spark)
    found = pa.label_diff(gold, rows)
    assert exchanges(found) == 3  # the gold rows are dealt for either version, the patches once
    # every old row of a token meets every new one, as in a join
    want = [("a", 0, "Ana", "B-NAME_STUDENT", "O")] + [("a", 1, "real", "O", "B-USERNAME")] * 6
    assert found.columns == ["document", "token", "token_text", "old_label", "new_label"]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_patches_come_from_one_pass(spark):
    from maskloom.plans.q_spans import patch_table

    assert executed(patch_table(spark, SF)).count("regexp_extract_all") == 1


def test_snippets_of_names_shuffle_documents_only(spark):
    from maskloom.plans.q_spans import f8_name_snippets

    plan = executed(f8_name_snippets(spark, SF))
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert len(dealt) == 2 and all(re.fullmatch(r"document#\d+, \d+", d) for d in dealt)
    assert plan.count("regexp_extract_all") == 2 and "transform(zip_with" not in plan


def test_names_of_documents_are_those_of_their_labels(spark):
    rows = [("a", "Wolf Wolf, Bald Hand Wolf\nHand"), ("a", "Wolf Bald"), ("b", None), ("c", ""), (None, "Wolf")]
    words = [f"Wa{a}{b}" for a in "bdfgklmnpr" for b in "aeiou"]
    docs = spark.createDataFrame([*rows, ("d", " ".join(words * 2)), ("e", ".".join(words) + " x@y.org 123456")], "document string, text string")
    got = [(r.document, r.text, r.name) for r in fr.document_names(docs).collect()]
    labelled = fr.label_tokens(tk.tokenize(docs)).collect()
    want = [(r.document, r.text, n) for r in labelled for n in {t.text for t in r.toks or [] if "NAME_STUDENT" in t.label}]
    assert want and sorted(got, key=str) == sorted(want, key=str)
    plan = fr.document_names(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_windows_of_tokens_without_arrays_of_starts(spark):
    rows = spark.createDataFrame([(n, t) for n in (0, 1, 5, 10, 23, 40) for t in range(n)], "n_tokens int, token int")
    found = wn.assign_windows(rows, 8, 2)
    assert "sequence(0, greatest" not in found._jdf.queryExecution().optimizedPlan().toString()
    held = {(n, t): [w for w, first in enumerate(range(0, max(n - 2, 1), 4)) if first <= t < first + 6] for n in (1, 5, 10, 23, 40) for t in range(n)}
    assert sorted((r.n_tokens, r.token, r.window, r.pos) for r in found.collect()) == sorted((n, t, w, t - 4 * w) for (n, t), ws in held.items() for w in ws)


def test_merged_tokens_are_plain_matches(spark):
    from maskloom.plans.q_scores import _plain_tokens

    plan = _plain_tokens(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(regexp_extract_all" not in plan  # no array of structs is built first


def test_neighbours_are_cut_where_few_rows_are_left(spark):
    docs = spark.createDataFrame([("a", "Ana met  Bo , 12\nx"), ("b", ""), ("c", None)], "document string, text string")
    whole = fr.labelled_rows(docs, 3)
    late = fr.cut_neighbours(fr.labelled_rows(docs, 3, cut=False))
    assert late.columns == whole.columns
    assert sorted(map(tuple, late.collect())) == sorted(map(tuple, whole.collect()))
    from maskloom.plans.q_spans import training_rows

    plan = training_rows(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.rindex("Window [") :]
    assert below.count("EndsWith(next_1") == 0 and "ws#" not in re.search(r"Project \[(.*?)\]", below).group(1)


def test_pieces_of_names_need_no_labels(spark):
    from maskloom.plans.q_tokens import vocabulary_pieces

    plain, labelled = (vocabulary_pieces(spark, SF, labels) for labels in (False, True))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "STREET_ADDRESS" in plan(labelled) and "STREET_ADDRESS" not in plan(plain)
    assert [c for c in labelled.columns if c != "label"] == plain.columns
    assert plain.exceptAll(labelled.drop("label")).count() == 0 == labelled.drop("label").exceptAll(plain).count()


def test_steps_are_gathered_for_tokens_with_votes_only(spark):
    from maskloom.operators import masks as ms

    rows = spark.createDataFrame([("a", 0, "Ana", "O", []), ("a", 1, "Ana", "B-NAME_STUDENT", [("B-NAME_STUDENT", 1)]), ("a", 2, "x", "O", [("I-NAME_STUDENT", 3)])], f"document string, token int, token_text string, gold_label string, votes {ms.VOTES}")
    found = ms.scores_by_step(ms.correct_masks(tk.colocate(rows), 2, keep_steps=True), (0.1, 0.2))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "exists(" not in plan
    got = {(r.threshold, r.step): (r.tp, r.fp, r.fn) for r in found.collect()}
    assert got[0.1, "name_casing"] == (1, 0, 0) and got[0.2, "name_casing"] == (0, 0, 1)
    assert got[0.1, "repeated_names"] == (1, 1, 0)


def test_sampled_documents_leave_the_other_texts_where_they_are(spark):
    from maskloom.operators import tagger as tg

    rows = [(str(i % 40), f"text {i}") for i in range(60)] + [(None, "none")]
    docs = spark.createDataFrame(rows, "document string, text string").repartition(4)
    order = [r.document for r in docs.orderBy(F.xxhash64("document"), "document").collect()]
    for n in (0, 1, 7, 30, 61, 100):
        assert [r.document for r in tg.sample_documents(docs, n).orderBy(F.xxhash64("document"), "document").collect()] == order[:n]
    below = tg.sample_documents(docs, 7)._jdf.queryExecution().optimizedPlan().toString().split("LeftSemi")[1]
    assert re.search(r"Project \[document#\d+ AS _key#\d+\]", below)  # the keys alone are sorted
