import itertools
import random

import pytest
from pyspark.sql import functions as F

from maskloom.functions import text as tx
from maskloom.functions.labels import LABELS, build_vocabulary
from maskloom.operators import metrics as mt
from maskloom.operators import rules as ru
from maskloom.operators import scores as sc

SCHEMA = "document STRING, token INT, token_text STRING, label STRING"


def preds(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def keyed(df):
    return sorted((r.document, r.token, r.label) for r in df.collect())


def wide(spark, **scores):
    values = [float(scores.get(c.replace("-", "_"), 0.0)) for c in LABELS]
    schema = "document STRING, token INT, token_text STRING, " + ", ".join(f"`{c}` DOUBLE" for c in LABELS)
    return spark.createDataFrame([("1", 0, scores.get("text", "x"), *values)], schema)


def test_vocabulary():
    assert LABELS == [
        "B-EMAIL", "B-ID_NUM", "B-NAME_STUDENT", "B-PHONE_NUM", "B-STREET_ADDRESS", "B-URL_PERSONAL", "B-USERNAME",
        "I-ID_NUM", "I-NAME_STUDENT", "I-PHONE_NUM", "I-STREET_ADDRESS", "O"]
    assert build_vocabulary(remove=(), bio=False)[-1] == "USERNAME"


def test_string_tests_agree_with_python(spark):
    words = ["Ana", "ana", "ANA", "McDonald", "O'Brien", "A.", "Anne-Marie", "1St", "1st", "", " ", "Élan", "éLan", "X1a", "a1B", "ǅ", "東", "Ab C", "Ab c"]
    df = spark.createDataFrame([(w,) for w in words], "w STRING")
    rows = df.select("w", tx.istitle(F.col("w")).alias("t"), tx.isupper(F.col("w")).alias("u"), tx.islower(F.col("w")).alias("l"), tx.title(F.col("w")).alias("tt")).collect()
    for r in rows:
        assert (r.t, r.u, r.l) == (r.w.istitle(), r.w.isupper(), r.w.islower()), r.w
        if r.w.isascii():
            assert r.tt == r.w.title()


@pytest.mark.parametrize("scores,want", [
    ({"O": 0.95, "B_NAME_STUDENT": 0.05}, None),
    ({"O": 0.85, "B_NAME_STUDENT": 0.10, "B_ID_NUM": 0.05}, "B-NAME_STUDENT"),
    ({"O": 0.30, "B_ID_NUM": 0.60, "B_NAME_STUDENT": 0.10}, "B-ID_NUM"),
    ({}, None)])
def test_decode(spark, scores, want):
    got = [r.label for r in sc.decode(sc.with_top_two(wide(spark, **scores)), 0.9).collect()]
    assert got == ([want] if want else [])


def test_merge_windows_max_and_mean(spark):
    tokens = spark.createDataFrame([("1", 4, "abcd", 10, 14)], "document STRING, token INT, token_text STRING, start INT, end INT")
    schema = "document STRING, piece_start INT, piece_end INT, O DOUBLE"
    two = spark.createDataFrame([("1", 10, 14, 0.2), ("1", 9, 14, 0.7), ("1", 0, 0, 0.9)], schema)
    assert sc.merge_windows(two, tokens, ["O"]).first().O == 0.7
    part = spark.createDataFrame([("1", 10, 13, 0.8)], schema)
    assert sc.merge_windows(part, tokens, ["O"], "mean").first().O == pytest.approx(0.6)


def test_blank_tokens(spark):
    rows = preds(spark, [("1", 0, " ", "O"), ("1", 1, "\n", "O"), ("1", 2, " \n", "O")])
    assert [r.token for r in sc.drop_blank_tokens(rows).orderBy("token").collect()] == [1, 2]


def test_name_casing(spark):
    rows = preds(spark, [("1", i, t, "B-NAME_STUDENT") for i, t in enumerate(["McDonald", "O'Brien", "JOHN", "A."])])
    assert [r.token_text for r in ru.drop_miscased_names(rows).orderBy("token").collect()] == ["O'Brien", "A."]


def test_titles(spark):
    rows = preds(spark, [("1", 4, "Dr.", "B-NAME_STUDENT"), ("1", 5, "Ana", "I-NAME_STUDENT"), ("1", 8, "Ms", "B-NAME_STUDENT"), ("1", 10, "Eva", "I-NAME_STUDENT")])
    assert keyed(ru.remove_titles(rows)) == [("1", 5, "B-NAME_STUDENT"), ("1", 10, "I-NAME_STUDENT")]


def recurrence(rows):
    rows = [list(r) for r in rows]
    for i, (tok, lab) in enumerate(rows):
        adjacent = i > 0 and rows[i - 1][0] == tok - 1
        if lab == "B" and adjacent and rows[i - 1][1] == "B":
            rows[i][1] = "I"
        elif lab == "I" and not adjacent:
            rows[i][1] = "B"
    return [tuple(r) for r in rows]


def test_repair_names_equals_the_recurrence(spark):
    rng = random.Random(1)
    full = {"B": "B-NAME_STUDENT", "I": "I-NAME_STUDENT", "X": "B-ID_NUM"}
    cases = [list(zip(range(len(c)), c)) for n in range(1, 6) for c in itertools.product("BIX", repeat=n)]
    for _ in range(400):
        toks = sorted(rng.sample(range(20), rng.randint(1, 14)))
        cases.append([(t, rng.choice("BBIIX")) for t in toks])
    rows = [(str(d), t, "w", full[x]) for d, case in enumerate(cases) for t, x in case]
    want = sorted((str(d), t, full[x]) for d, case in enumerate(cases) for t, x in recurrence(case))
    fixed = ru.repair_names(preds(spark, rows))
    assert keyed(fixed) == want
    assert keyed(ru.repair_names(fixed)) == want


def test_repeated_names(spark):
    rows = preds(spark, [("1", 2, "Ana", "B-NAME_STUDENT"), ("1", 20, "Ana", "B-ID_NUM")])
    tokens = spark.createDataFrame([("1", 2, "Ana"), ("1", 9, "Ana"), ("1", 12, "ana"), ("1", 20, "Ana"), ("2", 1, "Ana")], "document STRING, token INT, token_text STRING")
    got = keyed(ru.add_repeated_names(rows, tokens))
    assert got == [("1", 2, "B-NAME_STUDENT"), ("1", 9, "B-NAME_STUDENT"), ("1", 20, "B-ID_NUM")]


def test_emails_and_urls(spark):
    tokens = spark.createDataFrame([("1", 0, "a@b.co"), ("1", 1, "https://www.linkedin.com/in/x"), ("1", 2, "https://x.org"), ("1", 3, "facebook.com/x")], "document STRING, token INT, token_text STRING")
    rows = preds(spark, [("1", 0, "a@b.co", "B-EMAIL")])
    assert keyed(ru.add_emails_and_urls(rows, tokens)) == [("1", 0, "B-EMAIL"), ("1", 1, "B-URL_PERSONAL")]


def test_bad_urls(spark):
    rows = [("B-URL_PERSONAL", "https://www.example.com", 1), ("I-URL_PERSONAL", "www.example.com/page", 0), ("B-URL_PERSONAL", "Some text", 0),
            ("B-URL_PERSONAL", "http://coursera.org", 0), ("B-NAME_PERSONAL", "Nicholas", 1), ("B-URL_PERSONAL", "https://wikipedia.org", 0),
            ("O", "Another text", 1), ("B-URL_PERSONAL", "https://example.gov", 0), ("B-URL_PERSONAL", "https://example.edu", 0)]
    df = preds(spark, [("1", i, t, lab) for i, (lab, t, _) in enumerate(rows)])
    assert [r.token for r in ru.drop_bad_urls(df).orderBy("token").collect()] == [i for i, r in enumerate(rows) if r[2]]


def test_phones(spark):
    rows = [("B-PHONE_NUM", "12893849239283", "B-ID_NUM"), ("I-PHONE_NUM", "12893849239283", "I-PHONE_NUM"), ("B-PHONE_NUM", "12893849.239283", "B-PHONE_NUM"),
            ("B-PHONE_NUM", "1289x3849239283", "B-PHONE_NUM"), ("B-PHONE_NUM", "1(289)3849239283", "B-PHONE_NUM"), ("B-PHONE_NUM", "1234", "B-PHONE_NUM")]
    df = preds(spark, [("1", i, t, lab) for i, (lab, t, _) in enumerate(rows)])
    assert [r.label for r in ru.phones_to_ids(df).orderBy("token").collect()] == [r[2] for r in rows]


@pytest.mark.parametrize("scores,want", [
    ({"B_ID_NUM": 0.2, "O": 0.7}, "B-ID_NUM"),
    ({"B_ID_NUM": 0.1, "O": 0.7}, "O"),
    ({"text": "http://x.me", "B_URL_PERSONAL": 0.16, "O": 0.84}, "B-URL_PERSONAL"),
    ({"B_ID_NUM": 0.0004, "O": 0.0}, "O")])
def test_decode_argmax(spark, scores, want):
    assert ru.decode_argmax(wide(spark, **scores)).first().label == want


def test_metrics_fixture(spark):
    gold = preds(spark, [("1", 0, "a", "B-NAME_STUDENT"), ("1", 1, "b", "I-NAME_STUDENT"), ("2", 5, "c", "B-EMAIL")])
    pred = preds(spark, [("1", 0, "a", "B-NAME_STUDENT"), ("1", 1, "b", "B-NAME_STUDENT"), ("3", 2, "d", "B-ID_NUM")])
    pairs = mt.score_pairs(pred, gold)
    assert {r.cm for r in pairs.collect()} == {"TP", "FNFP", "FN", "FP"}
    r = mt.fbeta_score(pairs).first()
    assert (r.tp, r.fp, r.fn, round(r.fbeta, 6)) == (1, 2, 2, 0.333333)
    assert mt.lenient_fbeta(pairs).first().fbeta == 0.5
    assert mt.fbeta_score(mt.score_pairs(gold, gold)).first().fbeta == 1.0
    assert mt.fbeta_score(mt.score_pairs(gold.limit(0), gold.limit(0))).first().fbeta is None


def test_keep_runs(spark):
    rows = spark.createDataFrame([("a", "1", 1), ("b", "1", 2)], "run STRING, document STRING, token INT")
    good = spark.createDataFrame([("a",)], "run STRING")
    assert mt.keep_runs(rows, good).count() == 1



def test_fbeta_of_rates(spark):
    df = spark.createDataFrame([(0.5, 0.5), (1.0, 1.0), (0.0, 0.0)], "p DOUBLE, r DOUBLE")
    got = [r[0] for r in df.select(mt.fbeta_of_rates(F.col("p"), F.col("r"))).collect()]
    assert got == [0.5, 1.0, None]
