"""Operators whose results must not depend on a limit: brute force on small and on large cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from maskloom.functions.text import isspace
from maskloom.operators import clean, profile, sample, synth
from maskloom.operators.overlap import overlap_join
from maskloom.plans import frames
from maskloom.sources import io


def first_placeholders(x):
    """Drop the first placeholder that begins 1 to 9 characters after an earlier one, until none does."""
    while True:
        starts = []
        for m in re.finditer(".?URL.?", x):
            if any(0 < m.start() - s < 10 for s in starts):
                x = x[: m.start()] + x[m.end() :]
                break
            starts.append(m.start())
        else:
            return x


def test_normalize_links_leaves_no_near_placeholder(spark):
    rng = random.Random(2)
    words = ["URL", "URL", "[URL]", "(URL).", "a", "see", "bcdefghij"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "\n", ", ", "   "]) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    texts += ["[URL]" * 200, "URL", "", "no link", "x" * 5000 + " (URL) <URL> [URL] end"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = dict(map(tuple, rows.select("i", clean.first_placeholders(F.col("t"))).collect()))
    assert [got[i] for i in range(len(texts))] == [first_placeholders(t) for t in texts]
    assert got[600].count("URL") == 1


def test_numbered_tags_have_no_limit(spark):
    essay = "".join(f" <public_url{i}>" for i in range(1, 13)) + " <public_url14> <public_url2>here</public_url2>"
    urls = "<replacements>\n" + "\n".join(f"http://s{i}.example.org" for i in range(12)) + "\n</replacements>"
    rows = spark.createDataFrame([("1", essay, urls)], "document string, essay string, generated_urls string")
    out = synth.fill_tags(rows, frames.banks()).first().essay
    assert "<public_url14>" in out and not re.search(r"public_url([1-9]|1[0-3])>", out)
    assert all(f"http://s{i}.example.org" in out for i in range(12)) and "here" in out


@pytest.mark.parametrize("rate", [0.2, 12.0, 22.0])
def test_with_replacement_draws_all_copies(spark, rate):
    rows = spark.range(4000).select(F.col("id").cast("string").alias("document"))
    n = sample.with_replacement(rows, rate).count()
    assert abs(n - 4000 * rate) < 6 * (4000 * rate) ** 0.5
    with pytest.raises(ValueError):
        sample.with_replacement(rows, 23.0)


def test_small_shares_are_small(spark):
    rows = spark.range(200_000).select(F.col("id").cast("string").alias("document"))
    n = rows.filter(sample.split_column(0.0002) == "test").count()
    assert 10 < n < 90


def test_path_terms_of_a_long_address(spark):
    url = "http://a.org/" + "/".join(f"p{i}" for i in range(1500))
    rows = spark.createDataFrame([(url,)], "u string")
    assert len(rows.select(profile.path_terms(F.col("u"))).first()[0]) == 1500


def test_left_overlap_join(spark):
    rng = random.Random(7)
    span = lambda: (rng.choice("ab"), (s := rng.randint(0, 400)), s + rng.randint(1, 150))
    left, right = sorted({span() for _ in range(60)}), sorted({span() for _ in range(12)})
    want = []
    for d, s, e in left:
        hits = [(d, s, e, x, y) for o, x, y in right if o == d and s < y and x < e]
        want += hits or [(d, s, e, None, None)]
    a = spark.createDataFrame(left, "document string, start int, end int")
    b = spark.createDataFrame(right, "document string, s int, e int")
    got = overlap_join(a, b, right_span=("s", "e"), how="left").select("document", "start", "end", "s", "e").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    # a span across a border that meets another in its first bucket only
    a, b = spark.createDataFrame([("a", 60, 70)], a.schema), spark.createDataFrame([("a", 60, 62)], b.schema)
    assert overlap_join(a, b, right_span=("s", "e"), how="left").count() == 1


def test_white_space_beyond_ascii(spark):
    signs = ["　", " ", " ", "\x1c", "\u0085", " \n", "x", "​", ""]
    rows = spark.createDataFrame(list(enumerate(signs)), "i int, t string")
    got = dict(map(tuple, rows.select("i", isspace(F.col("t"))).collect()))
    assert [got[i] for i in range(len(signs))] == [s.isspace() for s in signs]


def test_run_files_with_quoted_headers(spark, tmp_path):
    for run, header in (("a", 'document,"token, text",cm'), ("b", "cm,document"), ("c", "document")):
        (tmp_path / run).mkdir()
        (tmp_path / run / "part.csv").write_text(header + "\n" + {"a": '1,"x\ny",TP', "b": "FP,2", "c": "3"}[run] + "\n")
    got = io.read_runs_csv(spark, str(tmp_path)).collect()
    assert sorted((r.document, r.cm, r["token, text"]) for r in got) == [("1", "TP", "x\ny"), ("2", "FP", None)]
