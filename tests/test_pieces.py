"""Pieces over a vocabulary against a plain greedy matcher, on a small fixture and on whole tables."""

import collections
import os
import random

import public_tokenizers
import pytest

from maskloom.functions.labels import LABELS
from maskloom.operators.pieces import UNKNOWN, byte_level_vocabulary, flat_trie, longest_matches, with_pieces
from maskloom.plans import catalog, frames
from maskloom.operators import tokens as tk

SF = "/root/testdata/sf0.001"


def greedy(vocabulary, word, end=""):
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in word)
    out, i = [], 0
    while i < len(low):
        for j in range(len(low), i, -1):
            found = vocabulary.get(low[i:j] + end) if end and j == len(low) else None
            found = vocabulary.get(low[i:j]) if found is None else found
            if found is not None:
                break
        out.append((i, j if found is not None else i + 1, UNKNOWN if found is None else found))
        i = out[-1][1]
    return out


def test_longest_matches():
    rng = random.Random(1)
    for end in ("", "</w>"):
        for _ in range(30):
            texts = {"".join(rng.choice("abcé𝒳") for _ in range(rng.randint(1, 5))) + rng.choice(["", end]) for _ in range(40)}
            vocabulary = {t: i for i, t in enumerate(sorted(texts))}
            words = ["", "a", *("".join(rng.choice("abcdABÉ𝒳İ") for _ in range(rng.randint(0, 30))) for _ in range(50))]
            found = collections.defaultdict(list)
            for w, a, b, p in zip(*map(list, longest_matches(flat_trie(vocabulary, end), words))):
                found[w].append((a, b, p))
            assert [found[i] for i in range(len(words))] == [greedy(vocabulary, w, end) for w in words]
    assert len(longest_matches(flat_trie({}), ["ab"])[0]) == 2 and not len(longest_matches(flat_trie({"a": 1}), [])[0])


def test_rows_and_offsets(spark):
    rows = [("1", 0, "abca", 3, "B-X"), ("1", 1, "", 8, "O"), ("2", 0, None, 0, "O")]
    tokens = spark.createDataFrame(rows, "document string, token int, token_text string, start int, label string")
    found = with_pieces(tokens, flat_trie({"ab": 5, "a": 6}))
    assert found.columns == [*tokens.columns, "piece", "piece_id", "piece_start", "piece_end"]
    got = sorted((r.document, r.token, r.piece, r.piece_id, r.piece_start, r.piece_end) for r in found.collect())
    assert got == [("1", 0, 0, 5, 3, 5), ("1", 0, 1, UNKNOWN, 5, 6), ("1", 0, 2, 6, 6, 7), ("1", 1, 0, UNKNOWN, 8, 8), ("2", 0, 0, UNKNOWN, 0, 0)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_queries_on_whole_tables(spark):
    vocabulary = byte_level_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    tokens = tk.token_spans(frames.gold(spark, SF)).select("document", "token", "token_text", "start", "label").collect()
    known, want, modes = {}, collections.defaultdict(lambda: [0, 0, 0, 0]), collections.Counter()
    for r in tokens:
        if r.token_text not in known:
            known[r.token_text] = greedy(vocabulary, r.token_text, "</w>")
        inside = LABELS.index("I" + r.label[1:]) if "I" + r.label[1:] in LABELS else LABELS.index(r.label)
        for k, (a, b, p) in enumerate(known[r.token_text]):
            w = want[r.document, LABELS.index(r.label)]
            for i, x in enumerate((1, (r.start + a) * 7 + r.start + b, p, p == UNKNOWN)):
                w[i] += x
            modes["first", LABELS.index(r.label) if not k else -100] += 1
            modes["all", LABELS.index(r.label) if not k else inside] += 1
    found = catalog.QUERIES["b6_vocabulary_pieces"](spark, SF).collect()
    assert {(r.document, r.label_id): [r.n, r.offsets, r.ids, r.n_unknown] for r in found} == want
    assert {(r["mode"], r.label_id): r.n for r in catalog.QUERIES["b10_vocabulary_labels"](spark, SF).collect()} == modes
    named = catalog.QUERIES["b9_vocabulary_names"](spark, SF).collect()
    per = collections.Counter()
    for (d, _), w in want.items():
        per[d] += w[0]
    assert {r.document: r.n_pieces for r in named} == per and sum(r.n_named for r in named) > 0
