"""Links near placeholders against a plain scan; shares of the drawn locale shapes."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from maskloom.operators import clean as cl
from maskloom.operators import synth as sy
from maskloom.plans import frames as fr


def plain(text):
    found = list(re.finditer(f"{cl.PLACEHOLDER}|{cl.HYPERLINK}", text))
    stands = [m.group() in ("<URL>", "[URL]") for m in found]
    gone = set()
    for i, m in enumerate(found):
        if stands[i]:
            continue
        if i and stands[i - 1] and 1 <= m.start() - found[i - 1].end() <= 4:
            gone.add(m.group())
        if i + 1 < len(found) and stands[i + 1] and 1 <= found[i + 1].start() - m.end() <= 4:
            gone.add(m.group())
    if "URL" not in text:
        return text
    return re.sub(f"{cl.PLACEHOLDER}|{cl.HYPERLINK}", lambda m: " <URL> " if m.group() in gone else m.group(), text)


def test_links_near_placeholders(spark):
    rng = random.Random(7)
    parts = ["<URL>", "[URL]", "http://a.org/x", "https://www.b.com", "www.c.net", " ", "  ", " and ", "----", "-----", "text", "\n", "URL", "é", "<", "]"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(400)] + ["", "http://a.org no placeholder"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9999, None)], "i int, t string")
    found = {r.i: r.x for r in df.select("i", cl.fold_links(F.col("t")).alias("x")).collect()}
    assert found.pop(9999) is None
    assert found == {i: plain(t) for i, t in enumerate(texts)}
    assert sum(found[i] != t for i, t in enumerate(texts)) > 50


def test_links_and_placeholders_become_one(spark):
    df = spark.createDataFrame([("a <URL> http://x.org/1 [URL] b http://x.org/1",)], "t string")
    assert df.select(cl.normalize_near_links(F.col("t"))).first()[0].count("URL") == 2


@pytest.mark.parametrize("weights", [(1,), (1, 1), (3, 1), (3, 3, 2, 1), (5, 1, 1, 1, 90)])
def test_alias_rows_give_the_weights(weights):
    rows = sy.alias_rows([(str(i), w) for i, w in enumerate(weights)])
    share = collections.Counter()
    per = sy._DRAWS / len(rows)
    for option, cut, other in rows:
        share[option] += min(cut, per) / sy._DRAWS
        share[other] += max(0.0, per - cut) / sy._DRAWS
    for i, w in enumerate(weights):
        assert share[str(i)] == pytest.approx(w / sum(weights), abs=1e-8)


def test_shares_of_shapes_and_locales(spark):
    n = 40_000
    rows = spark.range(n).select(F.col("id").cast("string").alias("document")).withColumn("locale", sy.locale_of("t"))
    for part in ("address", "phone"):
        counted = rows.groupBy("locale", sy.locale_shape(part, "t", F.col("locale")).alias("shape")).count().collect()
        size = collections.Counter()
        for r in counted:
            size[r.locale] += r["count"]
        assert set(size) == set(sy.LOCALE_SHAPES) and len(size) == 16
        assert all(abs(c - n / 16) < 5 * math.sqrt(n / 16) for c in size.values())
        got = {(r.locale, r.shape): r["count"] for r in counted}
        for name, parts in sy.LOCALE_SHAPES.items():
            total = sum(w for _, w in parts[part])
            for shape, w in parts[part]:
                want = size[name] * w / total
                assert abs(got.pop((name, shape)) - want) < 5 * math.sqrt(want)
        assert not got


def test_locale_values_have_no_slots_left(spark):
    docs = spark.range(500).select(F.col("id").cast("string").alias("document"))
    for r in sy.with_locale_values(docs, fr.banks(), "t").collect():
        assert not re.search(r"[#{}]", r.address + r.phone_number) and re.search(r"\d", r.address)
    assert sy.with_locale_values(docs.limit(0), fr.banks(), "t").count() == 0
