"""Fertility rules, lines, mixing, cross-entropy and neighbours against brute force."""

import collections
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from helpers import WORD, documents, empty, long_text, mixed_texts, prose

from maskloom.llm.cross_entropy import losses, pair_counts, score, vocabulary, word_counts
from maskloom.llm.fertility import judged
from maskloom.llm.line_spread import without_boilerplate
from maskloom.llm.mixing import mix, mixed_rows
from maskloom.llm.multi_index import search

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def counts(t):
    w = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    at = collections.defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    again = {k for v in at.values() if len(v) > 1 for i in v for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again)


def test_fertility_counts(spark):
    rng = random.Random(2)
    texts = mixed_texts() + [long_text(n=20_000), "# a|b\n# a|b\n x \n x\n\n\n", "p q r s t " * 4, "日本 語 & é"]
    texts += [" ".join(rng.choice("ab") for _ in range(30)) for _ in range(10)]
    docs = documents(spark, texts).selectExpr("*", "1 AS m", "2 AS grp", "3 AS _q")
    found = judged(docs, PIECES).collect()
    assert len(found) == len(texts) and found[0].m == 1 and found[0].grp == 2
    for r in found:
        n, chars, symbols, lines, again = counts(texts[r.doc_id])
        q = r._q
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == (n, chars, symbols, lines, again)
        assert q.base_failed == (n < 10 or 100 * again > 20 * n)
        assert not (q.kept and q.base_failed)
    assert judged(empty(spark), PIECES).collect() == []


def test_fertility_measures_and_bands(spark):
    import sentencepiece

    rng = random.Random(8)
    clean = [prose(rng, 120, "etaoinshrdlu") for _ in range(60)]
    odd = "".join(chr(0x12000 + rng.randint(0, 300)) + (" " if rng.random() < 0.2 else "") for _ in range(300))
    texts = [*clean, odd, "word " * 3 + " ".join("z" * 12 + str(i) for i in range(120))]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    found = {r.doc_id: r._q for r in judged(docs, PIECES, keep=["doc_id"]).collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for i in (0, 60):
        ids = [x for w in WORD.findall(texts[i]) for x in model.encode(w)]
        share = np.unique(ids, return_counts=True)[1] / len(ids)
        assert found[i].n_tokens == len(ids) and found[i].n_byte_tokens == sum(map(model.is_byte, ids))
        assert found[i].token_entropy == pytest.approx(-(share * np.log2(share)).sum())
    assert all(found[i].kept for i in range(60)) and not found[60].kept


def without_wide_lines(rows):
    """{doc_id: (lines, lines on 5 sites or more, removed lines, text that stays)} of (doc_id, text, site)."""
    spread, out = collections.defaultdict(set), {}
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            if WORD.search(x):
                spread[x.strip().lower()].add(s)
    for d, t, _ in rows:
        lines = t.split("\n") if t is not None else []
        wide = [len(spread.get(x.strip().lower(), ())) >= 5 for x in lines]
        rest = "\n".join(x for x, w in zip(lines, wide) if not w)
        drop = any(wide) and WORD.search(rest) is not None
        kept = rest if drop else t
        out[d] = (len(lines), sum(wide), sum(wide) if drop else 0, kept)
    return out


def test_lines_on_many_sites(spark):
    rng = random.Random(1)
    common = ["Terms and conditions apply", "  all rights RESERVED here ", "two words"]
    rows = []
    for i in range(40):
        lines = [prose(rng, 8) for _ in range(6)] + [common[0]] + ([common[1].strip().lower() if i % 2 else common[1]] if i % 8 < 4 else [])
        rows.append((i, "\n".join(lines + [common[2], ""]), f"s{i % 8}" if i % 9 else None, 7))
    copy = "\n".join([prose(rng, 9), prose(rng, 9)])
    rows += [(100 + i, copy, f"s{i}", 7) for i in range(8)] + [(200, None, "s1", 7), (201, "", None, 7), (202, rows[1][1], "s1", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, key long").repartition(3)
    found = {r.doc_id: r for r in without_boilerplate(docs).collect()}
    for d, want in without_wide_lines([r[:3] for r in rows]).items():
        assert found[d].key == 7 and tuple(found[d]._lines) == want
    rows_of = {r[0]: r[1] for r in rows}
    assert found[1]._lines.n_removed and found[100]._lines.n_found == 2 and found[100]._lines.n_removed == 0
    assert "two words" in rows_of[1] and "two words" not in found[1]._lines.kept
    assert without_boilerplate(empty(spark)).collect() == []


def level_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Share the budget by weight, cut what exceeds a limit, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            open_.remove(s)
        left = share * sum(sizes.values()) - sum(out.values())
    return out


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(0, 40), "abc"), rng.choice(["a", "a", "a", "b", "c", "D", None, "é"]), 1) for i in range(400)]
    rows += [(500, None, "a", 1), (501, "x y", "only", 1), (501, "x y", "only", 1), (None, "p q r", "b", 1), (502, "", "none", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long").repartition(5)
    found = mix(docs).collect()
    assert len(found) == len(rows)
    sizes = collections.Counter()
    for _, t, s, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want, taken = level_targets(sizes), collections.Counter()
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in want)
    again = mix(docs.repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    copies = collections.Counter(r.doc_id for r in mixed_rows(docs).collect())
    words = collections.Counter()
    for d, t, s, _ in rows:
        assert copies[d] <= 4
        if d != 501:
            words[s] += copies[d] * len(WORD.findall(t or ""))
    assert all(abs(words[s] - want[s]) <= 40 for s in want if s != "only")
    assert mix(empty(spark)).collect() == [] and mixed_rows(empty(spark)).collect() == []


def test_cross_entropy_tables(spark):
    texts = ["The cat sat", "the dog sat the cat", None, "", "x", "THE end"]
    docs = documents(spark, texts)
    known = vocabulary(word_counts(docs))
    marked = docs.selectExpr("text", "cast(doc_id = 1 AS int) AS side")
    found = collections.Counter()
    for r in pair_counts(marked, known).collect():
        found[r.side] += r.n
    assert found == {0: 11, 1: 5}
    table = np.zeros((4, 4))
    table[3, 0], table[0, 1] = 2, 1
    bits = losses(table, prior=2.0)
    one = (table.sum(axis=0) + 1) / (table.sum() + 4)
    assert bits[3, 0] == pytest.approx(-math.log2((2 + 2 * one[0]) / (2 + 2)))
    assert (2.0**-bits).sum(axis=1) == pytest.approx(np.ones(4))
    rows = {r.doc_id: r for r in score(docs, docs.filter("doc_id = 1").select("doc_id")).collect()}
    assert rows[2].n_tokens == 0 and rows[2].difference is None and rows[3].difference is None
    assert rows[1].difference < rows[4].difference
    assert rows[0].difference == pytest.approx(rows[0].target_bits - rows[0].background_bits)
    assert score(empty(spark), empty(spark).select("doc_id")).collect() == []


def test_cross_entropy_on_held_out_documents(spark):
    rng = random.Random(3)
    both = [prose(rng, 300, "etaoin").split(), prose(rng, 300, "shrdlu").split()]
    rows = [(i, " ".join(rng.choice(both[i % 2 == 0]) for _ in range(60))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = score(docs, docs.filter("doc_id % 4 = 1").select("doc_id")).collect()
    like = np.array([r.difference for r in found if r.doc_id % 4 == 3])
    unlike = np.array([r.difference for r in found if r.doc_id % 2 == 0])
    assert (like[:, None] < unlike[None, :]).mean() >= 0.95


def nearest(rows, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        out[ids[i]] = [(ids[j], s[j]) for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
    return out


def ranked(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_neighbours_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(x) for x in rng.integers(-1, 2, 6)]) for i in range(200)]
    good = [r for r in good if any(r[1])] + [(i, [1.0, 1.0, 0.0, 0.0, 1.0, 1.0]) for i in range(1000, 1100)]
    odd = [(400, None), (420, [0.0] * 6), (440, [float("nan")] * 6), (460, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (480, [1.0]), (500, [float("inf")] * 6), (520, [])]
    rows = [(i, v, 0) for i, v in [*good, *odd, good[0], (None, [1.0] * 6)]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell int").repartition(3)
    assert ranked(search(df, share=1.0)) == nearest(good, 20)
    assert search(df.limit(0)).collect() == []
    few = spark.createDataFrame([(20, [1.0, 2.0]), (21, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert ranked(search(few)) == {20: [(21, 1.0)]}


def test_recall_of_the_index(spark):
    import maskloom.llm.queries as q

    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, found = nearest(rows, 20), ranked(q.op3_inverted_multi_index(spark, sf))
    assert set(want) == set(found)
    assert np.mean([len({a for a, _ in found[i]} & {a for a, _ in want[i]}) / 20 for i in want]) >= 0.9
