"""The pipeline's stages on null texts and ids, repeated rows, extra columns of clashing names, and an empty table."""

import random

import corpus_pipeline as c
import pytest

from maskloom.llm.shared import written

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _q string, _lines int, _row double"


def rows_of(rng):
    known = "the of and to in is that for was on with as his they at be this from have or by one had not but what all were".split()
    prose = lambda n: " ".join(rng.choice(known) for _ in range(n))
    texts = [". ".join(prose(9) for _ in range(rng.randint(8, 20))) for _ in range(40)]
    out = []
    for i, t in enumerate([*texts, texts[0], texts[0], None, "", "short", "\n \n", *texts[3:6]]):
        out.append((None if i % 11 == 5 else i, t, ("en", None)[i % 5 == 4], ("a", "a", "a", "b", None)[i % 5], None if t is None else len(t), "q", i, 0.5))
    return out + out[:2]


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, empty):
    rows = rows_of(random.Random(2))
    docs = spark.createDataFrame([] if empty else rows, COLUMNS).repartition(3)
    columns = docs.columns
    for name, stage in c.STAGES[:-1]:
        docs = written(stage(spark, docs, ""))
        assert docs.columns == columns, name
        found = docs.collect()
        assert empty or found
        if name == "n-gram Jaccard join":
            assert len({r.text for r in found}) == len(found)
        assert all(r._q == "q" and r._row == 0.5 for r in found)
        assert {(r.doc_id, r.source) for r in found} <= {(r[0], r[3]) for r in rows}
    packed = c.STAGES[-1][1](spark, docs, "").collect()
    assert bool(packed) != empty
    used = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert all(n <= 1024 for n in used.values())
