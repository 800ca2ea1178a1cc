"""What keeps steps small on large tables: bounded rows, one pass over the input, partitions by size."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from maskloom.operators import metrics as mt
from maskloom.operators import numbering
from maskloom.operators import scores as sc
from maskloom.operators import snippets as sn
from maskloom.operators import tokens as tk
from maskloom.plans import frames as fr

TEXTS = [
    ("1", "Hello Ana  Maria\n\nme@x.org 1234567 7654321 555-1234 http://a.b wonderfully the cat"),
    ("1", "Another Text 999999 888888"),
    ("2", None),
    ("3", ""),
    ("4", " ".join(w for k in range(60) for w in ("Name" + chr(97 + k % 26) * 3, "ab", "abc", "lengthyword" + chr(97 + k % 26), str(10**5 + k)))),
]


def test_labelled_rows_are_those_of_the_array(spark):
    docs = spark.createDataFrame(TEXTS, "document string, text string").withColumn("lang", F.lit("x"))
    for near in (0, 1, 4):
        old = tk.token_rows(fr.label_tokens(tk.tokenize(docs)).drop("text"), near)
        new = fr.labelled_rows(docs, near)
        assert new.columns == old.columns
        assert sorted(map(repr, new.collect())) == sorted(map(repr, old.collect()))
    assert new.filter("label LIKE 'I-%'").count() > 0


def test_rows_with_contexts_do_not_grow_with_the_document(spark):
    n = 2000
    toks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.concat(F.lit("w"), i.cast("string")).alias("text"), F.lit(True).alias("ws"), F.lit("O").alias("label")))
    docs = spark.range(1).select(F.lit("d").alias("document"), toks.alias("toks"))
    wanted = F.col("token_text").rlike("^w(0|5|127|128|1000|1999)$")
    found = sn.candidates(docs, wanted)
    assert found.agg(F.max(F.size("toks"))).first()[0] <= sn.STRETCH + 2 * sn.REACH
    for rows in (found, sn.attach(docs, found.select("document", "token"))):
        got = {r.token: r.t for r in rows.select("token", sn.snippet(100, 100, "<", ">").alias("t")).collect()}
        assert sorted(got) == [0, 5, 127, 128, 1000, 1999]
        for k, text in got.items():
            want = "".join((f"<w{i}> " if i == k else f"w{i} ") for i in range(max(k - 100, 0), min(k + 100, n)))
            assert text == want
    near = found.withColumn("at", sn.nearby_negative(20, 20, "s")).collect()
    assert all(r.at is not None and r.token - 20 <= r.at < r.token + 20 for r in near)


def test_row_numbers_read_their_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = spark.createDataFrame([(f"d{k % 7}", k) for k in range(50)], "document string, token int").mapInArrow(counted, "document string, token int")
    out = numbering.dense_row_id(rows).orderBy("document", "token").collect()
    assert [r.row_id for r in out] == list(range(50))
    assert seen.value == 50


def test_widen_is_one_aggregate(spark):
    long = spark.createDataFrame([("a", 1, "x", 0.5), ("a", 1, "y", 0.25), ("a", 2, "y", 1.0), ("b", 1, "z", 1.0)], "document string, token int, label string, score double")
    wide = sc.widen(long, ("x", "y"))
    with redirect_stdout(io.StringIO()) as text:
        wide.explain()
    assert text.getvalue().count("Aggregate(") == 2
    assert sorted(map(tuple, wide.collect())) == [("a", 1, 0.5, 0.25), ("a", 2, None, 1.0), ("b", 1, None, None)]


def test_windows_are_scored_a_few_at_a_time(spark):
    windows = spark.range(200, numPartitions=1).select(F.lit("d").alias("document"), F.col("id").cast("int").alias("window"), F.lit(3).alias("first"), F.array(F.lit("a"), F.lit("b")).alias("tokens"))
    found = sc.score_windows(windows, lambda t: [[len(x), 0.5] for x in t], ("p", "q"))
    assert found.count() == 400
    assert found.filter("window = 199").orderBy("token").collect() == [("d", 199, 3, 1.0, 0.5), ("d", 199, 4, 1.0, 0.5)]
    assert sc.WINDOWS_AT_ONCE <= 64


def test_sweep_counts_and_their_total(spark):
    rows = spark.createDataFrame([(0.1, True), (0.4, False), (0.6, True), (None, True), (None, False), (float("nan"), False), (0.5, True)], "s double, y boolean")
    got = {r.threshold: (r.tp, r.fp, r.fn, r.n) for r in mt.sweep_counts(rows, "s", F.col("y"), (0.5, 0.1), total="n").collect()}
    assert got == {0.5: (1, 1, 3, 7), 0.1: (2, 2, 2, 7)}
    empty = mt.sweep_counts(rows.limit(0), "s", F.col("y"), (0.5,)).collect()
    assert [tuple(r) for r in empty] == [(0.5, 0, 0, 0)]


def test_partitions_follow_the_size_of_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(str(k), "x" * 100) for k in range(40)], "document string, text string")
    monkeypatch.setattr(tk, "PARTITION_TEXT", 200)
    assert tk.colocate(docs).rdd.getNumPartitions() == 20
    assert tk.colocate(docs.limit(0)).count() == 0


def test_windows_without_tokens_have_no_scores(spark):
    windows = spark.createDataFrame([("d", 0, 0, None), ("e", 0, 0, ["a"])], "document string, window int, first int, tokens array<string>")
    assert [r.document for r in sc.score_windows(windows, lambda t: [[1.0] for _ in t], ("p",)).collect()] == ["e"]
