"""Sources and sinks (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskloom.operators import metrics as mt
from maskloom.operators import numbering
from maskloom.operators import tokens as tk
from maskloom.plans import frames as fr
from maskloom.plans.registry import query
from maskloom.plans.sqlparts import h, with_parts
from maskloom.sources import io

_DOC_COUNTS = "SELECT document, count(*) AS n_tokens, count(*) FILTER (label<>'O') AS n_labelled FROM gold GROUP BY 1"


def _doc_counts(docs):
    return docs.select(
        "document",
        F.size("toks").cast("long").alias("n_tokens"),
        F.size(F.filter("toks", lambda t: t["label"] != "O")).cast("long").alias("n_labelled"),
    )


@query("a1_read_json", with_parts(_DOC_COUNTS, "gold"))
def a1_read_json(spark, sf):
    path = io.scratch_dir(spark) + "/documents"
    io.write_documents_json(fr.gold_documents(spark, sf), path)
    return _doc_counts(io.read_documents_json(spark, path)).filter("n_tokens > 0")


@query(
    "a2_read_parquet_glob",
    """SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1""",
)
def a2_read_parquet_glob(spark, sf):
    docs = io.read_parquet_set(spark, f"{sf}/documents*.parquet")
    return docs.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(
    "a3_read_run_csv",
    with_parts(
        """SELECT run, cm, count(*) AS n FROM (
             SELECT r.run, CASE WHEN g.label IS NULL OR g.label='O' THEN 'FP' WHEN g.label=r.label THEN 'TP' ELSE 'FNFP' END AS cm
             FROM runs r LEFT JOIN gold g USING (document, token)) GROUP BY 1,2""",
        "runs",
    ),
)
def a3_read_run_csv(spark, sf):
    base = io.scratch_dir(spark)
    gold = fr.gold(spark, sf).filter("label <> 'O'").select("document", "token", F.col("label").alias("label_gt"))
    scored = fr.runs(spark, sf).join(gold, ["document", "token"], "left").withColumn(
        "cm", mt.confusion_mark(F.col("label"), F.col("label_gt"))
    )
    scored.select("run", "document", "token", "label", "label_gt", "cm").write.partitionBy("run").csv(
        f"{base}/scored", header=True, quote='"', escape='"'
    )
    gold.write.csv(f"{base}/other", header=True)
    back = io.read_runs_csv(spark, base, ("document", "token", "label", "label_gt", "cm"))
    return back.withColumn("run", F.regexp_extract("run", r"run=([^/]+)/", 1)).groupBy("run", "cm").agg(
        F.count("*").alias("n")
    )


@query(
    "a4_read_dictionary",
    with_parts(
        f"SELECT 'word' AS kind, length(token_text) AS len, count(DISTINCT token_text) AS n FROM tok WHERE regexp_matches(token_text,'^\\p{{L}}+$') GROUP BY 1,2",
        "tok",
    ),
)
def a4_read_dictionary(spark, sf):
    path = io.scratch_dir(spark) + "/words"
    rows = tk.token_rows(tk.tokenize(fr.documents(spark, sf)).select("document", "toks"))
    rows.filter(F.col("token_text").rlike(r"^\p{L}+$")).select(F.col("token_text").alias("value")).distinct().write.text(path)
    words = io.read_dictionary(spark, path, "word")
    return words.groupBy("kind", F.length("value").alias("len")).agg(F.count("*").alias("n"))


@query("a5_write_parquet", with_parts("SELECT label, count(*) AS n FROM pred GROUP BY 1", "pred"))
def a5_write_parquet(spark, sf):
    path = io.scratch_dir(spark) + "/predictions"
    io.write_parquet(fr.predictions(spark, sf), path)
    return spark.read.parquet(path).groupBy("label").agg(F.count("*").alias("n"))


_ROW_ID = "SELECT document, token, label, row_number() OVER (ORDER BY document, token)-1 AS row_id FROM pred"


@query("a6_submission", with_parts(_ROW_ID, "pred"))
def a6_submission(spark, sf):
    path = io.scratch_dir(spark) + "/submission"
    io.write_submission(numbering.dense_row_id(fr.predictions(spark, sf)), path)
    return spark.read.schema("row_id LONG, document STRING, token INT, label STRING").csv(path, header=True)


@query("c7_dense_row_id", with_parts(_ROW_ID, "pred"))
def c7_dense_row_id(spark, sf):
    return numbering.dense_row_id(fr.predictions(spark, sf)).select("document", "token", "label", "row_id")


@query(
    "a7_write_folds",
    "SELECT (doc_id%4)::INT AS fold, lang, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1,2",
)
def a7_write_folds(spark, sf):
    path = io.scratch_dir(spark) + "/folds"
    docs = fr.documents(spark, sf).withColumn("fold", F.pmod(F.col("document").cast("long"), F.lit(4)))
    io.write_folds(docs, path)
    back = spark.read.schema("document STRING, text STRING, lang STRING, source STRING, fold INT").json(path)
    return back.groupBy("fold", "lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(
    "a8_append_scored",
    with_parts(
        """SELECT run_id, cm, count(*) AS n FROM (
            SELECT run_id, CASE WHEN g.label IS NULL THEN 'FP' WHEN p.label IS NULL THEN 'FN' WHEN g.label=p.label THEN 'TP' ELSE 'FNFP' END AS cm
            FROM pred p FULL JOIN (SELECT * FROM gold WHERE label<>'O') g USING (document, token), (VALUES ('first'),('second')) v(run_id))
           GROUP BY 1,2""",
        "pred",
    ),
)
def a8_append_scored(spark, sf):
    path = io.scratch_dir(spark) + "/scored"
    preds, gold = fr.scored_rows(spark, sf)
    pairs = io.written(mt.score_pairs(preds, mt.gold_rows(gold)))
    for run in ("first", "second"):
        io.append_scored(pairs, path, run)
    return spark.read.parquet(path).groupBy("run_id", "cm").agg(F.count("*").alias("n"))


_TOKEN_SUMS = """SELECT document, count(*) AS n_tokens, sum(length(token_text))::BIGINT AS chars,
    sum(token*length(token_text)::BIGINT)::BIGINT AS checksum, count(*) FILTER (label<>'O') AS n_labelled FROM gold GROUP BY 1"""


def token_sums(rows):
    return rows.groupBy("document").agg(
        F.count("*").alias("n_tokens"),
        F.sum(F.length("token_text")).alias("chars"),
        F.sum(F.col("token").cast("long") * F.length("token_text")).alias("checksum"),
        F.count_if(F.col("label") != "O").alias("n_labelled"),
    )


@query("a9_flatten_tokens", with_parts(_TOKEN_SUMS, "gold"))
def a9_flatten_tokens(spark, sf):
    docs = fr.gold_documents(spark, sf).drop("text")
    rows = docs.select("document", F.posexplode_outer("toks").alias("token", "t")).filter("token IS NOT NULL").select(
        "document", "token", F.col("t.text").alias("token_text"), F.col("t.ws").alias("ws"), F.col("t.label").alias("label")
    )
    return token_sums(rows)


@query(
    "a10_nest_tokens",
    with_parts(
        "SELECT document, count(*)::INT AS n, md5(string_agg(token_text || CASE WHEN ws THEN ' ' ELSE '' END, '' ORDER BY token)) AS text_md5, string_agg(label, ' ' ORDER BY token) FILTER (label<>'O') AS labels FROM gold GROUP BY 1",
        "gold",
    ),
)
def a10_nest_tokens(spark, sf):
    nested = tk.nest_tokens(fr.gold(spark, sf))
    toks = F.transform("toks", lambda t: F.struct(t["token_text"].alias("text"), t["ws"].alias("ws")))
    labels = F.filter(F.col("toks.label"), lambda x: x != "O")
    return nested.select(
        "document",
        F.size("toks").alias("n"),
        F.md5(tk.rebuild_text(toks).cast("binary")).alias("text_md5"),
        F.when(F.size(labels) > 0, F.array_join(labels, " ")).alias("labels"),
    )
