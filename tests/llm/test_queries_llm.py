"""Registered queries of the subpackage: SQL, brute force over whole tables, and the pipeline's stages."""

import collections
import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_pairs import repeats, sets_and_components
from test_quality import counts, level_targets, without_wide_lines
from tokenizers import Tokenizer

import __spark_entry__ as entry
from maskloom.llm.queries import ORACLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.fixture(scope="module")
def texts(spark):
    return dict(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()))


@pytest.fixture(scope="module")
def ids(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {d: np.array(t.encode(x or "", add_special_tokens=False).ids + [0], dtype="<u4") for d, x in texts.items()}


def run(spark, name):
    return entry.queries()[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    rows = run(spark, name)
    assert sorted(names) == sorted(rows[0].asDict())
    text = lambda v: f"{v:.5f}" if isinstance(v, float) else str(v)
    assert sorted(tuple(text(r[n]) for n in names) for r in rows) == sorted(tuple(map(text, r)) for r in cur.fetchall())


def test_token_files(spark, ids):
    start, want = 0, []
    for d in sorted(ids):
        want.append((d, start, len(ids[d]), zlib.crc32(ids[d])))
        start += len(ids[d])
    assert sorted(map(tuple, run(spark, "op2_token_files"))) == want


def test_length_histogram(spark, ids):
    lengths = np.array([len(x) - 1 for x in ids.values()])
    for r in run(spark, "op4_length_histogram"):
        assert r.n_docs == (lengths == r.length).sum() and r.truncated_tokens == np.minimum(lengths, r.length).sum()


def test_packing(spark, ids):
    rows = run(spark, "op7_shortest_pack_first")
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    assert all(zlib.crc32(ids[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32 for r in rows)


def test_jaccard_join(spark, texts):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, "op8_jaccard_join")}
    assert found == sets_and_components(texts.items(), 3, 90)


def test_repeated_windows(spark, texts):
    order = sorted(texts)
    want = repeats([texts[d] for d in order], 400)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, "op9_repeated_windows")}
    assert found == {d: want[i] for i, d in enumerate(order)}


def test_fertility_rules(spark, texts):
    for r in run(spark, "op10_fertility_rules"):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(texts[r.doc_id])


def test_cross_entropy_difference(spark, texts):
    rows = run(spark, "op1_cross_entropy_difference")
    assert {r.doc_id for r in rows} == set(texts)


def test_pipeline_stages(spark, texts):
    import corpus_pipeline as c
    from maskloom.llm.shared import written

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, None
    for name, stage in c.STAGES:
        before, docs = docs, written(stage(spark, docs, SF))
        if name == "quality rules":
            assert set(docs.columns) == set(columns)
            kept = {r.doc_id for r in docs.collect()}
            assert kept <= {d for d, t in texts.items() if counts(t)[0] >= 10}
            verdict = {r.doc_id: r.kept for r in run(spark, "op10_fertility_rules")}
            assert kept == {d for d, k in verdict.items() if k}
        if name == "line dedup":
            want = without_wide_lines([(r.doc_id, r.text, r.source) for r in before.collect()])
            assert {r.doc_id: r.text for r in docs.collect()} == {d: v[3] for d, v in want.items()}
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        if name.startswith("mixing"):
            rows, copies = before.collect(), collections.Counter(r.doc_id for r in docs.collect())
            sizes, taken = collections.Counter(), collections.Counter()
            for r in rows:
                sizes[r.source] += counts(r.text)[0]
                taken[r.source] += counts(r.text)[0] * copies[r.doc_id]
                assert copies[r.doc_id] <= 2
            longest = max(counts(r.text)[0] for r in rows)
            assert all(abs(taken[s] - t) <= longest for s, t in level_targets(sizes).items())
            assert set(copies) <= {r.doc_id for r in rows}
        if name == "n-gram Jaccard join":
            rows = {r.doc_id: r.text for r in before.collect()}
            want = sets_and_components(rows.items(), 5, 80)
            assert sorted(r.doc_id for r in docs.collect()) == sorted(d for d, (_, least) in want.items() if d == least)
        if stage is not c.STAGES[-1][1]:
            assert docs.columns == columns and docs.count() > 0
    assert docs.select("sequence_id", "offset").distinct().count() == docs.count()
    assert sorted(map(str, c.run(spark, SF).collect())) == sorted(map(str, docs.collect()))
