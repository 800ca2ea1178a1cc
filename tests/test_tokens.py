import json

import pytest
from pyspark.sql import functions as F

from maskloom.operators import scores as sc
from maskloom.operators import tokens as tk
from maskloom.operators import windows as wn
from maskloom.operators.overlap import overlap_join
from maskloom.sources import io

TEXTS = [
    "Hello world this is Nicholas Broad. 2837",
    "  leading\n\nlines   and  runs ",
    "mail a.b+c@x-y.org or https://x.me/a?b=1 www.z.de!",
    "Ünïcode O'Brien Anne-Marie 1.234 \U0001f600 end",
    "",
    "a" * 3000 + "-" * 500 + "x.y" * 2000,
]


def docs(spark, texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "document STRING, text STRING")


def test_tokens_rebuild_the_text(spark):
    rows = tk.tokenize(docs(spark, TEXTS)).select("text", tk.rebuild_text().alias("again")).collect()
    assert all(r.text == r.again for r in rows)


def test_token_map(spark):
    given = [("Hello", True), ("world", True), ("this", True), ("is", True), ("Nicholas", True), ("Broad", False), (".", True), ("2837", True)]
    rows = spark.createDataFrame([("1", i, t, ws) for i, (t, ws) in enumerate(given)], "document STRING, token INT, token_text STRING, ws BOOLEAN")
    got = [(r.start, r.end) for r in tk.token_spans(rows).orderBy("token").collect()]
    assert got == [(0, 5), (6, 11), (12, 16), (17, 19), (20, 28), (29, 34), (34, 35), (36, 40)]


def test_offsets_point_into_the_text(spark):
    d = docs(spark, TEXTS)
    spans = tk.token_spans(tk.token_rows(tk.tokenize(d)))
    bad = spans.filter(F.substring("text", F.col("start") + 1, F.length("token_text")) != F.col("token_text"))
    assert bad.count() == 0


def test_neighbours_and_shift(spark):
    rows = tk.token_rows(tk.tokenize(docs(spark, ["a b c"])), neighbours=2).orderBy("token").collect()
    assert [(r.prev_2, r.prev_1, r.token_text, r.next_1, r.next_2) for r in rows] == [
        (None, None, "a", "b", "c"), (None, "a", "b", "c", None), ("a", "b", "c", None, None)]


def test_windows_without_exchange_after_colocation(spark):
    spans = tk.token_spans(tk.token_rows(tk.tokenize(tk.colocate(docs(spark, TEXTS)))))
    plan = spans._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("n,want", [(13, [(0, 8), (3, 8), (6, 7)]), (8, [(0, 8)]), (9, [(0, 8), (3, 6)]), (3, [(0, 3)])])
def test_strided_windows(spark, n, want):
    d = spark.createDataFrame([("1", n)], "document STRING, n_tokens INT")
    got = [(r.first, r.size) for r in wn.document_windows(d, 10, 5).orderBy("window").collect()]
    assert got == want


def test_assign_windows_agrees_with_windows(spark):
    d = spark.createDataFrame([(str(n), n, t) for n in (1, 8, 9, 13, 40) for t in range(n)], "document STRING, n_tokens INT, token INT")
    got = {(r.document, r.window, r.token) for r in wn.assign_windows(d, 10, 5).collect()}
    wins = wn.document_windows(d.select("document", "n_tokens").distinct(), 10, 5).collect()
    assert got == {(w.document, w.window, t) for w in wins for t in range(w.first, w.first + w.size)}


def test_chunks(spark):
    rows = [("1", "a b c d e f g"), ("2", "a b")]
    d = tk.tokenize(spark.createDataFrame(rows, "document STRING, text STRING"))
    got = sorted((r.document, r.chunk, [t.text for t in r.chunk_toks]) for r in wn.chunk_tokens(d, 3).collect())
    assert got == [("1", 0, ["a", "b", "c"]), ("1", 1, ["d", "e", "f"]), ("1", 2, ["e", "f", "g"]), ("2", 0, ["a", "b"])]


@pytest.mark.parametrize("width", [1, 2, 65536])
def test_pack_is_independent_of_the_range_width(spark, width):
    d = spark.createDataFrame([("s", 1, 2), ("s", 2, 3), ("s", 5, 3), ("t", 3, 2)], "source STRING, nr LONG, n INT")
    placed = wn.pack_positions(d, "source", "nr", "n", width)
    assert sorted((r.nr, r.offset, r.key_total) for r in placed.collect()) == [(1, 0, 8), (2, 2, 8), (3, 0, 2), (5, 5, 8)]
    toks = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("token"))
    blocks = wn.pack_blocks(toks, 3).groupBy("source", "block").count().collect()
    assert sorted((r.source, r.block, r["count"]) for r in blocks) == [("s", 0, 3), ("s", 1, 3)]


def test_overlap_join_reports_every_pair_once(spark):
    a = [("d", s, e) for s, e in [(0, 5), (3, 200), (64, 65), (63, 64), (130, 131)]]
    b = [("d", s, e) for s, e in [(0, 300), (4, 6), (60, 70), (128, 129)]]
    left = spark.createDataFrame(a, "document STRING, start INT, end INT")
    right = spark.createDataFrame(b, "document STRING, s INT, e INT")
    got = sorted((r.start, r.end, r.s, r.e) for r in overlap_join(left, right, right_span=("s", "e")).collect())
    assert got == sorted((s, e, x, y) for _, s, e in a for _, x, y in b if s < y and x < e)


def test_json_array_and_lines(spark, tmp_path):
    record = {"document": "7", "full_text": "A b", "tokens": ["A", "b"], "trailing_whitespace": [True, False], "labels": ["B-NAME_STUDENT", "O"]}
    (tmp_path / "array.json").write_text(json.dumps([record, record]))
    back = io.read_documents_json(spark, str(tmp_path / "array.json"), array=True)
    assert back.count() == 2
    io.write_documents_json(back, str(tmp_path / "lines"))
    again = io.read_documents_json(spark, str(tmp_path / "lines")).first()
    assert [(t.text, t.ws, t.label) for t in again.toks] == [("A", True, "B-NAME_STUDENT"), ("b", False, "O")]


def test_align_labels_skips_spaces(spark):
    tokens = spark.createDataFrame([("1", 0, 2, "O"), ("1", 3, 6, "B-NAME_STUDENT")], "document STRING, start INT, end INT, label STRING")
    pieces = spark.createDataFrame([("1", 0, 2, 0), ("1", 2, 6, 1), ("1", 2, 3, 1)], "document STRING, piece_start INT, piece_end INT, lead INT")
    got = [(r.piece_start, r.piece_end, r.label_id) for r in wn.align_labels(pieces, tokens).collect()]
    assert sorted(got) == [(0, 2, 11), (2, 3, 11), (2, 6, 2)]


def test_model_seam_sees_whole_windows(spark):
    """Scores that only come out right if every call gets one window with all its tokens."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(str(d), [(f"t{i}",) for i in range(n)]) for d, n in enumerate((0, 1, 5, 10, 23))]
        docs = spark.createDataFrame(rows, "document string, toks array<struct<text: string>>")
        windows = wn.window_tokens(docs, max_length=8, stride=2)

        def model(tokens):
            return [[len(tokens), int(tokens[0][1:])] for _ in tokens]

        scored = sc.score_windows(windows, model, ["a", "b"])
        got = sorted((int(r.document), r.window, r.token, r.a, r.b) for r in scored.collect())
        want = []
        for d, n in enumerate((0, 1, 5, 10, 23)):
            for w, first in enumerate(range(0, max(n - 2, 1), 4)):
                held = range(first, min(first + 6, n))
                want += [(d, w, t, float(len(held)), float(first)) for t in held]
        assert got == want
        best = {(int(r.document), r.token): r.b for r in sc.best_over_windows(scored, ["a", "b"]).collect()}
        assert best == {(d, t): max(f for e, _, u, _, f in want if (e, u) == (d, t)) for d, _, t, _, _ in want}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
