"""Steps that meet by one sort, or where tokens already are: same rows as brute force, and no join of token rows."""

import io
import random
import re
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from maskloom.functions.labels import LABELS
from maskloom.operators import rules as ru
from maskloom.operators import spans as sp
from maskloom.operators import tokens as tk
from maskloom.operators import windows as wn
from maskloom.operators.overlap import touched


def plan(df):
    with redirect_stdout(io.StringIO()) as out:
        df.explain("simple")
    return out.getvalue()


def test_touched_is_brute_force(spark):
    rng = random.Random(5)
    spans = lambda n: [(rng.choice(["a", "b", "c", None]), s, s + rng.randint(1, 12)) for s in (rng.randint(0, 300) for _ in range(n))]
    left, right = spans(200), spans(25) + [("a", 0, 90), ("a", 5, 6)]
    a = spark.createDataFrame(left, "document string, start int, end int").repartition(3, "document")
    b = spark.createDataFrame(right, "document string, s int, e int")
    found = touched(a, b, ("start", "end"), ("s", "e"))
    want = [(d, s, e, any(d is not None and d == x and s < z and y < e for x, y, z in right)) for d, s, e in left]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
    assert "Join" not in plan(found)


def test_aligned_labels_need_no_join(spark):
    tokens = spark.createDataFrame(
        [("d", 0, 3, "B-EMAIL"), ("d", 4, 6, "B-NO_SUCH"), ("d", 7, 8, None), ("e", 0, 2, "B-ID_NUM"), (None, 0, 5, "B-EMAIL")],
        "document string, start int, end int, label string",
    )
    pieces = spark.createDataFrame(
        [("d", 0, 2, 0), ("d", 2, 4, 1), ("d", 3, 5, 1), ("d", 4, 5, 0), ("d", 6, 8, 1), ("d", 9, 10, 0), ("e", 1, 2, 0), ("f", 0, 1, 0), (None, 0, 1, 0)],
        "document string, piece_start int, piece_end int, lead int",
    )
    found = wn.align_labels(pieces, tokens)
    o, email = LABELS.index("O"), LABELS.index("B-EMAIL")
    want = [("d", 0, email), ("d", 2, o), ("d", 3, None), ("d", 4, None), ("d", 6, o), ("d", 9, o), ("e", 1, LABELS.index("B-ID_NUM")), ("f", 0, o), (None, 0, o)]
    got = [(r.document, r.piece_start, r.label_id) for r in found.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert "Join" not in plan(found)


def test_names_are_found_at_word_borders_by_their_literal(spark):
    cases = [
        ("Ana, Ana-Ana-Ana xAna Anax Ana", "Ana", True),
        ("Ana-Ana-Ana Ana-Ana", "Ana-Ana", True),
        ("Léa Léaé éLéa ́Léa Léá _Léa", "Léa", True),
        ("a.b a+b a.b\\E", "a.b", True),
        ("x\\Ey \\E", "\\E", False),
        ("²Ana² Ana²", "²Ana", True),
        ("", "Ana", True),
    ]
    docs = spark.createDataFrame([(str(i), *c) for i, c in enumerate(cases)], "document string, text string, value string, word boolean")
    quoted = F.concat(F.lit("\\Q"), F.replace("value", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    plain = F.when(F.col("word"), F.concat(F.lit("(?U)\\b"), quoted, F.lit("\\b"))).otherwise(quoted)
    found = [sorted(map(tuple, sp.regex_spans(docs.withColumn("p", p), F.col("p")).collect())) for p in (plain, sp.literal_pattern(F.col("value"), F.col("word")))]
    assert found[0] == found[1]
    assert len([r for r in found[1] if r[0] == "0"]) == 5
    # the search starts with the literal, which lets it skip ahead
    assert docs.select(sp.literal_pattern(F.col("value"), True).alias("p")).first().p.startswith("(?U)\\QAna")


def test_spans_of_two_labels_come_from_one_sort(spark):
    rng = random.Random(7)
    kinds = ["O", "O", "B-EMAIL", "I-EMAIL", "B-ID_NUM", "I-ID_NUM"]
    rows = spark.createDataFrame(
        [(d, k, f"t{k}", k % 3 > 0, rng.choice(kinds), rng.choice(kinds)) for d in "abc" for k in range(80)],
        "document string, token int, token_text string, ws boolean, label string, predicted string",
    )
    both = sp.bio_spans(rows, ("label", "predicted"))
    assert plan(both).count("Window [") == plan(sp.bio_spans(rows)).count("Window [") == 1
    for c in ("label", "predicted"):
        alone = sp.bio_spans(rows.select("document", "token", "token_text", "ws", F.col(c).alias("label")))
        assert sorted(map(tuple, both.filter(F.col("by") == c).drop("by").collect())) == sorted(map(tuple, alone.collect())) != []


def test_argmax_ties_and_tests_once(spark):
    zero = dict.fromkeys(LABELS, 0.0)
    cases = [
        ("Ana", zero | {"O": 0.5, "B-NAME_STUDENT": 0.3, "I-NAME_STUDENT": 0.3}, "B-NAME_STUDENT"),
        ("Ana", zero | {"O": 0.95, "B-ID_NUM": 0.95}, "B-ID_NUM"),
        ("Ana", zero | {"O": 0.99, "B-ID_NUM": 0.01}, "O"),
        ("http://a", zero | {"O": 0.5, "B-URL_PERSONAL": 0.2, "B-EMAIL": 0.3}, "B-URL_PERSONAL"),
        ("Ana", zero | {"O": 0.95, "B-ID_NUM": None, "I-ID_NUM": 0.96}, "O"),
        ("Ana", dict.fromkeys(LABELS), "B-EMAIL"),
    ]
    rows = spark.createDataFrame([(i, t, *[s[c] for c in LABELS]) for i, (t, s, _) in enumerate(cases)], "i int, token_text string, " + ", ".join(f"`{c}` double" for c in LABELS))
    got = {r.i: r.label for r in ru.decode_argmax(rows).collect()}
    # a null score makes the sum null, so neither the floor nor the entity rule is judged by it
    want = [w for _, _, w in cases]
    want[4] = "I-ID_NUM"
    assert [got[i] for i in range(len(cases))] == want
    zeroed = ru.zero_impossible_labels(rows)
    assert zeroed.columns == [c for c in rows.columns if c not in LABELS or c == "O"] + [c for c in LABELS if c != "O"]
    assert plan(zeroed).count("http|www|://") == 1


def test_repeated_names_do_not_shuffle_tokens(spark):
    docs = spark.createDataFrame([(str(i), "Ana met Bo. Ana left") for i in range(40)], "document string, text string")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(kept, ("-1", "false")):
            spark.conf.set(k, v)
        tokens = tk.match_rows(tk.colocate(docs).select("document", "text")).select("document", "token", "token_text")
        preds = spark.createDataFrame([(str(i), 0, "Ana", "B-NAME_STUDENT") for i in range(40)], "document string, token int, token_text string, label string")
        found = ru.add_repeated_names(tk.colocate(preds, like=docs), tokens)
        assert found.count() == 80
        assert re.findall(r"hashpartitioning\(document#\d+, token_text", plan(found)) == []
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
