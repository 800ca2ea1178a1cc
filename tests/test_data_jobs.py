import random
import re

import pytest
from pyspark.sql import functions as F

from maskloom.functions import text as tx
from maskloom.operators import clean as cl
from maskloom.operators import numbering, patches, profile
from maskloom.operators import sample as sa
from maskloom.operators import snippets as sn
from maskloom.operators import spans as sp
from maskloom.operators import synth as sy
from maskloom.operators import tokens as tk
from maskloom.plans import frames as fr

LABELLED = "document STRING, token INT, token_text STRING, ws BOOLEAN, label STRING"


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "x STRING").select(column(F.col("x"))).first()[0]


def test_values_to_bio(spark):
    docs = spark.createDataFrame([("1", "By Ana Diaz, Anadiazx", "Ana Diaz", "")], "document STRING, text STRING, name STRING, email STRING")
    tokens = tk.token_spans(tk.token_rows(tk.tokenize(docs).select("document", "toks")))
    got = sp.label_values(tokens, docs, {"name": "NAME_STUDENT", "email": "EMAIL"}).orderBy("token").collect()
    assert [(r.token_text, r.label) for r in got] == [("By", "O"), ("Ana", "B-NAME_STUDENT"), ("Diaz", "I-NAME_STUDENT"), (",", "O"), ("Anadiazx", "O")]


def test_values_to_bio_against_brute_force(spark):
    rng = random.Random(3)
    words = ["ab", "abc", "b.c", "a+b", "Zoë", "x", "12", "(q)"]
    rows = []
    for i in range(60):
        text = rng.choice(["", " "]).join(rng.choice(words) + rng.choice([" ", "", ", "]) for _ in range(25))
        rows.append((str(i), text, rng.choice(words), rng.choice(words + [""]), "|".join(rng.sample(["ab", "abc", "Zoë"], 2))))
    keys = {"name": "NAME_STUDENT", "email": "EMAIL", "names": "NAME_STUDENT"}
    docs = spark.createDataFrame(rows, "document STRING, text STRING, name STRING, email STRING, names STRING")
    tokens = tk.token_spans(tk.token_rows(tk.tokenize(docs).select("document", "toks")))
    got = {(r.document, r.token): r.label for r in sp.label_values(tokens, docs, keys).collect()}
    at = {}
    for r in tokens.collect():
        at.setdefault(r.document, []).append((r.token, r.start))
    for doc, text, *values in rows:
        chars = ["O"] * (len(text) + 1)
        for (key, kind), value in zip(keys.items(), values):
            for v in value.split("|") if key == "names" else [value]:
                if v:
                    pattern = re.escape(v)
                    for m in re.finditer(rf"\b{pattern}\b" if "name" in key else pattern, text):
                        chars[m.start():m.end()] = [kind] * (m.end() - m.start())
        before = "O"
        for token, start in sorted(at.get(doc, [])):
            want = chars[start] if chars[start] == "O" else ("I-" if before == chars[start] else "B-") + chars[start]
            before = chars[start]
            assert got[(doc, token)] == want, (text, token)


def test_bio_spans(spark):
    labels = ["B-NAME_STUDENT", "I-NAME_STUDENT", "O", "I-NAME_STUDENT", "B-ID_NUM", "I-PHONE_NUM"]
    rows = spark.createDataFrame([("1", i, f"t{i}", True, x) for i, x in enumerate(labels)], LABELLED)
    got = sorted(tuple(r) for r in sp.bio_spans(rows).collect())
    assert got == [("1", "ID_NUM", 4, 6, "t4 t5"), ("1", "NAME_STUDENT", 0, 2, "t0 t1")]


def test_snippets(spark):
    d = tk.tokenize(spark.createDataFrame([("1", "a b c d e")], "document STRING, text STRING"))
    row = sn.candidates(d, F.col("token_text") == "c").select(
        sn.snippet(2, 2, "<", ">"), sn.assertion_context(2, 2), sn.plain_context(1), sn.url_excerpt(1, 2, "[", "]")
    ).first()
    assert tuple(row) == ("a b <c> d ", "a b [START] c [END] d ", "b c ", "b  [ c ] d ")


def test_last_token_has_no_text_after(spark):
    d = tk.tokenize(spark.createDataFrame([("1", "a b")], "document STRING, text STRING"))
    assert sn.candidates(d, F.col("token_text") == "b").select(sn.url_excerpt(5, 5, "[", "]")).first()[0] == "a  [ b ] "


@pytest.mark.parametrize("text,want", [
    ("x" * 90 + "\nNote: a", "x" * 90),
    ("ab\nNote: " + "x" * 90 + "\nNote: b", "ab"),
    ("ab\nNote: " + "x" * 90, "ab\nNote: " + "x" * 90)])
def test_remove_note(spark, text, want):
    assert one(spark, cl.remove_note, text) == want


@pytest.mark.parametrize("text,want", [("Here is it:\n\nText", "Text"), ("Here only", "Here only"), ("Text\n\nx", "Text\n\nx")])
def test_remove_here_is(spark, text, want):
    assert one(spark, cl.remove_here_is, text) == want


def test_last_index(spark):
    for text, needle in [("abcabc", "bc"), ("aaa", "aa"), ("x", "y"), ("", "a"), ("\nNote:\nNote:", "\nNote:")]:
        assert one(spark, lambda c: tx.last_index(c, needle), text) == text.rfind(needle)


def test_first_of_each_text(spark):
    d = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b")], "nr LONG, text STRING")
    assert sorted(r.nr for r in cl.first_of_each_text(d, F.col("text")).collect()) == [1, 2]


@pytest.mark.parametrize("documents", [1, 7, 50])
def test_dense_row_id(spark, documents):
    rows = spark.createDataFrame([(f"d{i % documents}", i) for i in range(100)], "document STRING, token INT").repartition(5)
    got = [(r.document, r.token) for r in numbering.dense_row_id(rows).orderBy("row_id").collect()]
    ids = sorted(r.row_id for r in numbering.dense_row_id(rows).collect())
    assert got == sorted(got) and ids == list(range(100))


@pytest.mark.parametrize("buckets", [1, 16, 1024])
def test_stratified_split_is_exact(spark, buckets):
    rows = spark.createDataFrame([(str(i), int(i % 10 == 0)) for i in range(500)], "document STRING, label INT")
    base = sa.stratified_split(rows, "label", 0.2, buckets=1).filter("split = 'test'").select("document")
    split = sa.stratified_split(rows, "label", 0.2, buckets=buckets).filter("split = 'test'")
    assert {(r.label, r["count"]) for r in split.groupBy("label").count().collect()} == {(0, 90), (1, 10)}
    assert {r.document for r in split.collect()} == {r.document for r in base.collect()}


def test_swap_names(spark):
    given = [(1, "Ana", "B-NAME_STUDENT"), (2, "Diaz", "I-NAME_STUDENT"), (3, "x", "O"), (7, "Ana", "I-NAME_STUDENT")]
    rows = spark.createDataFrame([("1", t, w, True, x) for t, w, x in given], LABELLED)
    bank = lambda names: spark.createDataFrame(list(enumerate(names)), "idx LONG, value STRING")
    got = {r.token: r.new_text for r in sa.swap_names(rows, bank(["F1", "F2"]), bank(["L1", "L2"])).collect()}
    assert got[1] == got[7] and got[1][0] == "F" and got[2][0] == "L" and got[3] == "x"


def test_merge_tokens(spark):
    rows = spark.createDataFrame([("1", 0, "a", True, "O"), ("1", 1, "b", False, "O"), ("1", 2, "c", True, "O")], LABELLED)
    heads = spark.createDataFrame([("1", 0)], "document STRING, token INT")
    got = [(r.token, r.token_text, r.ws) for r in patches.merge_tokens(rows, heads).orderBy("token").collect()]
    assert got == [(0, "a b", False), (1, "c", True)]


def test_patches_last_match_wins(spark):
    rows = spark.createDataFrame([("1", 0, "abc", True, "O"), ("1", 1, "b", True, "B-EMAIL")], LABELLED)
    table = spark.createDataFrame([("1", 1, "contains", "b", None, "B-ID_NUM"), ("1", 2, "equal", "b", "O", "B-USERNAME"), ("1", 3, "equal", "abc", "O", "B-URL_PERSONAL")],
                                  "document STRING, nr INT, match_kind STRING, pattern STRING, only_label STRING, new_label STRING")
    got = {r.token: r.label for r in patches.patch_labels(rows, table).collect()}
    assert got == {0: "B-URL_PERSONAL", 1: "B-ID_NUM"}


def test_parse_urls_and_tags(spark):
    raw = "Sure\n<replacements>\n<public_url>http://a.org</public_url>\n\n<public_url1>http://b.org</public_url1>\n</replacements>"
    assert one(spark, sy.parse_urls, raw) == ["http://a.org", "http://b.org"]
    assert one(spark, sy.parse_urls, "nothing") == []
    assert one(spark, lambda c: sy.replace_in_turn(c, "<n>", lambda k: k.cast("string")), "<n> a <n><n>") == "0 a 12"


def test_generated_values_are_repeatable_and_shaped(spark):
    d = spark.createDataFrame([(str(i), "x " * 900) for i in range(50)], "document STRING, essay STRING")
    rows = sy.add_pii(d, fr.banks()).collect()
    again = {r.document: r.essay for r in sy.add_pii(d.repartition(3), fr.banks()).collect()}
    for r in rows:
        assert again[r.document] == r.essay
        assert r.name in r.essay and re.fullmatch(r"[a-z0-9._-]+@[a-z.]+", r.email)
        assert re.fullmatch(r"[a-zA-Z0-9]+", r.username) and r.social.startswith("https://www.")


def test_inside_runs_count_every_suffix(spark):
    rows = spark.createDataFrame([("1", i, "w", True, "I-NAME_STUDENT") for i in (1, 2, 3, 6)], LABELLED)
    assert sorted((r.length, r.n) for r in profile.inside_run_lengths(rows).collect()) == [(2, 1), (3, 1)]
