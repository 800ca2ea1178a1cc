"""What the sorts by token hold, and how often the tokens are made."""

import pytest
from pyspark.sql import functions as F

from maskloom.functions.labels import LABELS
from maskloom.operators import features as ft
from maskloom.operators import profile as pr
from maskloom.operators import spans as sp
from maskloom.operators import tokens as tk
from maskloom.plans import catalog  # noqa: F401  (registers the queries)
from maskloom.plans import frames as fr
from maskloom.plans import q_profile as qp
from maskloom.plans.registry import QUERIES


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def sorted_columns(df) -> list[int]:
    """How many columns the rows have that each window sorts."""
    found, todo = [], [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        below = [node.children().apply(i) for i in range(node.children().size())]
        todo += below
        if node.nodeName() == "Window":
            found.append(below[0].output().size())
    return found


def test_score_rows_are_sorted_with_their_scores_once(spark):
    fields = "document string, x int, token int, gold_label string, " + ", ".join(f"`{c}` double" for c in LABELS)
    score = lambda t: [None if (t, i) == (1, 3) else 10.0 * t + i for i in range(12)]
    wide = spark.createDataFrame([(d, 7, t, "O", *score(t)) for d in ("a", "b") for t in (2, 0, 1)], fields)
    rows = ft.score_vector(wide)
    assert rows.columns == [*wide.columns, "score_features"]
    assert sorted_columns(rows.select("document", "score_features")) == [3]
    got = {(r.document, r.token): r for r in rows.collect()}
    assert {k: list(r[4:16]) for k, r in got.items()} == {(d, t): score(t) for d in "ab" for t in range(3)}
    assert got["b", 1].score_features == [*score(1), *score(0), *[0.0] * 12, *score(2), *[0.0] * 12]


def test_covered_tokens_are_sorted_once_and_narrow(spark):
    docs = spark.createDataFrame([("a", "ab cd Ana Ana Roy x"), ("b", "no one"), ("c", None)], "document string, text string")
    docs = docs.withColumn("name", F.lit("Ana")).withColumn("full", F.lit("Ana Roy"))
    keys = {"name": "NAME_STUDENT", "full": "USERNAME"}
    dealt = tk.colocate(docs)
    rows = sp.label_values(tk.token_spans(tk.match_rows(dealt.select("document", "text"))), dealt, keys)
    # offsets, spans and cover sort once each; the labels take the order of the cover
    assert executed(rows).count("Sort [document") == 3
    assert rows.columns == ["document", "n_tokens", "token", "token_text", "ws", "start", "end", "label"]
    # columns of the tokens that nobody reads are not sorted
    cover = [max(sorted_columns(r)) for r in (rows.select("token_text", "label"), rows)]
    assert cover[1] - cover[0] >= 4
    got = {(r.document, r.token): (r.token_text, r.start, r.end, r.label) for r in rows.collect()}
    assert got["a", 2] == ("Ana", 6, 9, "B-NAME_STUDENT")
    assert [got["a", t][3] for t in range(6)] == ["O", "O", "B-NAME_STUDENT", "B-USERNAME", "I-USERNAME", "O"]
    assert sorted(k for k in got if k[0] != "a") == [("b", 0), ("b", 1)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    texts = [f"Dear {w} <<URL>> a@b.org see www.x{k}.com/p/q.html 12345{k}" + " word" * k for k, w in enumerate(["Ana", "Ivo", "", "Olga"] * 10)]
    rows = [(k, t, "en", "web") for k, t in enumerate([*texts, None, "", texts[3]])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{at}/documents.parquet")
    return at


def test_path_terms_take_one_pass(spark, sf):
    out = QUERIES["l10_path_terms"](spark, sf)
    assert executed(out).count("regexp_extract_all(") == 1
    urls, t = qp.personal_urls(spark, sf), F.col("token_text")
    terms = urls.select(F.lit("path").alias("part"), F.explode(pr.path_terms(t)).alias("term"))
    ends = urls.filter(~t.endswith(".com/")).select(F.lit("ending").alias("part"), pr.file_ending(t).alias("term"))
    plain = terms.unionByName(ends).groupBy("part", "term").agg(F.count("*").alias("n"))
    assert out.schema.simpleString() == plain.schema.simpleString()
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, plain.collect())) != []


@pytest.mark.parametrize("name", ["l11_url_differences", "l12_email_differences"])
def test_both_sides_come_from_one_pass(spark, sf, name):
    out = QUERIES[name](spark, sf)
    assert "regexp_extract_all(" not in executed(out)  # the texts are written by then
    rows, t = fr.synthetic_tokens(spark, sf), F.col("token_text")
    if name.startswith("l11"):
        sides = rows.filter("label = 'B-URL_PERSONAL'"), rows.filter(qp.tx.is_url_token(t))
    else:
        sides = rows.filter(t.contains("@") & t.contains(".")), rows.filter(F.col("label").contains("EMAIL"))
    plain = pr.in_both(*sides, "token_text")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, plain.collect())) != []
