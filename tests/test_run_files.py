"""Run files: many small ones, one of several splits, line breaks inside quotes, other headers."""

import csv
import random

from maskloom.sources import io

TEXTS = ["plain", "a,b", 'say "hi"', "two\nlines", "", 'x"\n"y', "\n", "é", "ends\n"]


def write(path, header, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, quoting=csv.QUOTE_NONNUMERIC, lineterminator="\n")
        w.writerow(header)
        w.writerows(rows)


def test_many_small_files(spark, tmp_path):
    want = []
    for i in range(1000):
        text = TEXTS[i % len(TEXTS)]
        if i % 10 == 3:
            write(tmp_path / f"d{i % 7}" / f"r{i}.csv", ["document", "other"], [(str(i), text)])
        elif i % 2:
            write(tmp_path / f"d{i % 7}" / f"r{i}.csv", ["cm", "token_text", "document"], [("TP", text, str(i))])
            want.append((str(i), text, "TP", None))
        else:
            write(tmp_path / f"d{i % 7}" / f"r{i}.csv", ["document", "token_text", "cm", "label"], [(str(i), text, "FP", "L")] * 2)
            want += [(str(i), text, "FP", "L")] * 2
    found = io.read_runs_csv(spark, str(tmp_path), ["document", "token_text", "cm", "label"])
    rows = found.collect()
    assert sorted(map(str, (tuple(r)[:4] for r in rows))) == sorted(map(str, want))
    assert all(r.run.endswith(f"/r{r.document}.csv") for r in rows)


def test_one_file_of_several_splits(spark, tmp_path):
    rng = random.Random(1)
    rows = [(str(i), rng.choice(TEXTS) * rng.randint(1, 4), rng.choice(["TP", "FN"])) for i in range(6000)]
    write(tmp_path / "big.csv", ["document", "token_text", "cm"], rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        found = io.read_runs_csv(spark, str(tmp_path), ["document", "token_text", "cm"])
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        assert sorted(tuple(r)[:3] for r in found.collect()) == sorted(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_no_file_with_the_column(spark, tmp_path):
    write(tmp_path / "a.csv", ["x"], [("1",)])
    assert io.read_runs_csv(spark, str(tmp_path), ["x"]).count() == 0
