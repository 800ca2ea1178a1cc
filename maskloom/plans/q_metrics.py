"""Metrics and evaluation (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskloom.functions.hashing import hash_int
from maskloom.functions.labels import ENTITY_LABELS, LABELS
from maskloom.operators import metrics as mt
from maskloom.operators import scores as sc
from maskloom.operators import spans as sp
from maskloom.plans import frames as fr
from maskloom.plans.q_scores import _UMODEL, url_model_mean
from maskloom.plans.q_spans import _LABELLED, _RUN_F5, _RUN_PAIRS, _SPAN_TEXT, RUN_NAMES, labelled, run_bits
from maskloom.plans.registry import query
from maskloom.plans.sqlparts import h, lit, with_parts
from maskloom.sources import io

_PAIRS = """SELECT document, token, p.label AS label_pred, g.label AS label_gt,
   CASE WHEN g.label IS NULL THEN 'FP' WHEN p.label IS NULL THEN 'FN' WHEN g.label=p.label THEN 'TP' ELSE 'FNFP' END AS cm
   FROM pred p FULL JOIN (SELECT document, token, label FROM gold WHERE label<>'O') g USING (document, token)"""
_COUNTS = "count(*) FILTER (cm='TP') AS tp, count(*) FILTER (cm IN ('FP','FNFP')) AS fp, count(*) FILTER (cm IN ('FN','FNFP')) AS fn"


def pairs(spark, sf):
    return mt.score_pairs(fr.predictions(spark, sf), mt.gold_rows(fr.gold(spark, sf)))


@query("h1_gold_rows", with_parts("SELECT document, token, token_text, label FROM gold WHERE label<>'O'", "gold"))
def h1_gold_rows(spark, sf):
    return mt.gold_rows(fr.gold(spark, sf))


@query("h2_confusion", with_parts("SELECT * FROM pairs", "pred", pairs=_PAIRS))
def h2_confusion(spark, sf):
    return pairs(spark, sf).select("document", "token", "label_pred", "label_gt", "cm")


@query("h3_fbeta", with_parts(f"SELECT tp, fp, fn, round(26.0*tp/(26.0*tp+25.0*fn+fp),6) AS fbeta FROM (SELECT {_COUNTS} FROM pairs)", "pred", pairs=_PAIRS))
def h3_fbeta(spark, sf):
    return mt.fbeta_score(pairs(spark, sf)).withColumn("fbeta", F.round("fbeta", 6))


@query(
    "h4_lenient_fbeta",
    with_parts("SELECT tp, fp, fn, round(26.0*tp/(26.0*tp+25.0*fn+fp),6) AS fbeta FROM (SELECT count(*) FILTER (cm='TP') AS tp, count(*) FILTER (cm='FP') AS fp, count(*) FILTER (cm='FN') AS fn FROM pairs)", "pred", pairs=_PAIRS),
)
def h4_lenient_fbeta(spark, sf):
    return mt.lenient_fbeta(pairs(spark, sf)).withColumn("fbeta", F.round("fbeta", 6))


@query("h5_confusion_by_label", with_parts("SELECT label_gt, cm, count(*) AS n FROM pairs GROUP BY 1,2", "pred", pairs=_PAIRS))
def h5_confusion_by_label(spark, sf):
    return mt.confusion_by_label(pairs(spark, sf))


URL_CUTS = (0.1, 0.3, 0.5, 0.6, 0.8)


@query(
    "h7_url_sweep",
    with_parts(
        f"""SELECT threshold, tp, fp, fn, round(tp/(tp+fp+1e-7),6) AS precision, round(tp/(tp+fn+1e-7),6) AS recall FROM (
          SELECT threshold, count(*) FILTER (score>threshold AND pii) AS tp, count(*) FILTER (score>threshold AND NOT pii) AS fp, count(*) FILTER (NOT score>threshold AND pii) AS fn
          FROM (SELECT *, {h('urlpii', 'document', 'token')}%3=0 AS pii FROM model), (VALUES (0.1::DOUBLE),(0.3),(0.5),(0.6),(0.8)) v(threshold) GROUP BY 1)""",
        "utok",
        model=_UMODEL,
    ),
)
def h7_url_sweep(spark, sf):
    pii = hash_int("urlpii", "document", "token") % 3 == 0
    out = mt.sweep_counts(url_model_mean(spark, sf), "score", pii, URL_CUTS)
    p = F.round(F.col("tp") / (F.col("tp") + F.col("fp") + 1e-7), 6)
    r = F.round(F.col("tp") / (F.col("tp") + F.col("fn") + 1e-7), 6)
    return out.withColumn("precision", p).withColumn("recall", r)


@query(
    "h8_accuracy_sweep",
    with_parts(
        """SELECT t/100.0::DOUBLE AS threshold, round(avg(((CASE WHEN p2>t/100.0::DOUBLE THEN 'B-NAME_STUDENT' ELSE 'O' END)=label)::INT),6) AS accuracy
           FROM prob, (SELECT unnest(range(0,100,5)) AS t) WHERE label IN ('O','B-NAME_STUDENT') GROUP BY 1""",
        "prob",
    ),
)
def h8_accuracy_sweep(spark, sf):
    rows = fr.wide_scores(spark, sf).filter(F.col("gold_label").isin("O", "B-NAME_STUDENT"))
    cuts = [i / 100 for i in range(0, 100, 5)]
    positive = F.col("gold_label") == "B-NAME_STUDENT"
    out = mt.sweep_counts(rows.select("gold_label", "B-NAME_STUDENT"), "B-NAME_STUDENT", positive, cuts, total="n")
    return out.select("threshold", F.round((F.col("n") - F.col("fp") - F.col("fn")) / F.col("n"), 6).alias("accuracy"))


_ARG = "CASE " + " ".join(f"WHEN p{i}=greatest({','.join(f'p{j}' for j in range(12))}) THEN {lit(n)}" for i, n in enumerate(LABELS)) + " END"


def _argmax(spark, sf):
    wide = fr.wide_scores(spark, sf)
    top = F.array_max(F.array(*[F.struct(F.col(c).alias("s"), F.lit(-i).alias("i"), F.lit(c).alias("label")) for i, c in enumerate(LABELS)]))
    return wide.withColumn("label", top["label"])


@query("h9_argmax_accuracy", with_parts(f"SELECT count(*) AS n, round(avg(({_ARG}=label)::INT),6) AS accuracy FROM prob", "prob"))
def h9_argmax_accuracy(spark, sf):
    ok = (F.col("label") == F.col("gold_label")).cast("int")
    return _argmax(spark, sf).agg(F.count("*").alias("n"), F.round(F.avg(ok), 6).alias("accuracy"))


@query("h10_accuracy_per_class", with_parts(f"SELECT label AS gold_label, count(*) AS n, round(avg(({_ARG}=label)::INT),6) AS accuracy FROM prob GROUP BY 1", "prob"))
def h10_accuracy_per_class(spark, sf):
    ok = (F.col("label") == F.col("gold_label")).cast("int")
    return _argmax(spark, sf).groupBy("gold_label").agg(F.count("*").alias("n"), F.round(F.avg(ok), 6).alias("accuracy"))


_OWN = "CASE label " + " ".join(f"WHEN {lit(n)} THEN p{i}" for i, n in enumerate(LABELS)) + " END"


@query(
    "h11_label_profile",
    with_parts(
        f"SELECT label, count(*) AS n, round(avg((a=label)::INT),6) AS argmax_accuracy, round(avg(own),6) AS mean_score, round(max(own),6) AS max_score, round(min(own),6) AS min_score FROM (SELECT label, {_ARG} AS a, {_OWN} AS own FROM prob WHERE label<>'O') GROUP BY 1",
        "prob",
    ),
)
def h11_label_profile(spark, sf):
    own = F.coalesce(*[F.when(F.col("gold_label") == c, F.col(c)) for c in ENTITY_LABELS])
    rows = _argmax(spark, sf).filter("gold_label <> 'O'").withColumn("own", own)
    return rows.groupBy(F.col("gold_label").alias("label")).agg(
        F.count("*").alias("n"),
        F.round(F.avg((F.col("label") == F.col("gold_label")).cast("int")), 6).alias("argmax_accuracy"),
        F.round(F.avg("own"), 6).alias("mean_score"),
        F.round(F.max("own"), 6).alias("max_score"),
        F.round(F.min("own"), 6).alias("min_score"),
    )


@query(
    "h12_entity_scores",
    with_parts(
        """SELECT type, tp, fp, fn, round(tp/nullif(tp+fp,0)::DOUBLE,6) AS precision, round(tp/nullif(tp+fn,0)::DOUBLE,6) AS recall, round(2.0*tp/(2*tp+fp+fn),6) AS f1 FROM (
           SELECT type, count(*) FILTER (p.x AND g.x) AS tp, count(*) FILTER (g.x IS NULL) AS fp, count(*) FILTER (p.x IS NULL) AS fn
           FROM (SELECT *, true AS x FROM spans) p FULL JOIN (SELECT *, true AS x FROM gspans) g USING (document, type, start_token, end_token) GROUP BY 1)""",
        "gold",
        lab=_LABELLED,
        spans=_SPAN_TEXT.replace("@src", "lab"),
        gspans=_SPAN_TEXT.replace("@src", "gold"),
    ),
)
def h12_entity_scores(spark, sf):
    rows = fr.gold(spark, sf).select("document", "token", "token_text", "ws", "label")
    both = sc.as_columns(rows, rows.columns, [F.coalesce(fr.noisy_label(F.col("label")), F.lit("O")).alias("predicted")])
    # spans are few: written, so that the two sides come from one pass over the tokens
    spans = io.written(sp.bio_spans(both, ("predicted", "label")).select("document", "by", "type", "start_token", "end_token"))
    out = mt.span_scores(spans.filter("by = 'predicted'"), spans.filter("by = 'label'"))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(
    "h13_binary_report",
    """SELECT tp, fp, fn, n, round(acc,6) AS accuracy, round(tp/(tp+fp)::DOUBLE,6) AS precision, round(tp/(tp+fn)::DOUBLE,6) AS recall, round(2.0*tp/(2*tp+fp+fn),6) AS f1 FROM (
       SELECT count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn, count(*) AS n, avg((p=a)::INT) AS acc
       FROM (SELECT length(text)>400 AS p, quality=1 AS a FROM documents JOIN labels USING (doc_id)))""",
)
def h13_binary_report(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.length("text").alias("size"))
    marks = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    out = mt.binary_report(docs.join(marks, "doc_id"), F.col("size") > 400, F.col("quality") == 1)
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "f1")})


@query(
    "h14_error_frequency",
    with_parts(
        """SELECT 'FP' AS kind, document, token, count(DISTINCT run) AS n_runs, min(label_pred) AS label FROM pairs WHERE cm IN ('FP','FNFP') AND run IN (SELECT run FROM f5 WHERE f>0.85) GROUP BY 2,3
           UNION ALL SELECT 'FN', document, token, count(DISTINCT run), min(label_gt) FROM pairs WHERE cm='FN' AND run IN (SELECT run FROM f5 WHERE f>0.9) GROUP BY 2,3""",
        "runs",
        pairs=_RUN_PAIRS,
        f5=_RUN_F5,
    ),
)
def h14_error_frequency(spark, sf):
    bits, names = run_bits(spark, sf), list(RUN_NAMES)
    scored = io.written(mt.run_counts(bits, names))
    cols = [F.lit("x").alias("kind"), "document", "token", "n_runs", "label"]
    parts = []
    for kind, errors, bar in (("FP", "fp", 0.85), ("FN", "fn", 0.9)):
        cols[0] = F.lit(kind).alias("kind")
        parts.append(mt.error_frequency(bits, errors, mt.good_runs(scored, names, bar)).select(*cols))
    return parts[0].unionByName(parts[1])


@query(
    "h15_documents_with_errors",
    with_parts("SELECT DISTINCT document FROM pairs WHERE cm IN ('FP','FNFP') AND run IN (SELECT run FROM f5 WHERE f>0.9)", "runs", pairs=_RUN_PAIRS, f5=_RUN_F5),
)
def h15_documents_with_errors(spark, sf):
    bits, names = run_bits(spark, sf), list(RUN_NAMES)
    good = mt.good_runs(mt.run_counts(bits, names), names, 0.9)
    return mt.error_frequency(bits, "fp", good).select("document").distinct()


SHIFTS = ((0, 0), (-10, 0), (-1, 0), (-2, 0), (0, -50), (0, -150), (1, 20), (40, 800))


@query(
    "h16_what_if",
    with_parts(
        f"""SELECT d_tp, d_fp, round(26.0*p*r/(25.0*p+r),6) AS fbeta, round(p,6) AS precision, round(r,6) AS recall FROM (
            SELECT d_tp, d_fp, (tp+d_tp)/(tp+d_tp+greatest(fp+d_fp,0))::DOUBLE AS p, (tp+d_tp)/(tp+fn)::DOUBLE AS r FROM (SELECT {_COUNTS} FROM pairs), (VALUES {','.join(str(s) for s in SHIFTS)}) v(d_tp,d_fp))""",
        "pred",
        pairs=_PAIRS,
    ),
)
def h16_what_if(spark, sf):
    """F-beta after moving some tokens between TP and FN or removing FP."""
    shifts = F.array(*[F.struct(F.lit(a).alias("d_tp"), F.lit(b).alias("d_fp")) for a, b in SHIFTS])
    rows = mt.fbeta_score(pairs(spark, sf)).select("tp", "fp", "fn", F.inline(shifts))
    tp = F.col("tp") + F.col("d_tp")
    p = tp / (tp + F.greatest(F.col("fp") + F.col("d_fp"), F.lit(0)))
    r = tp / (F.col("tp") + F.col("fn"))
    return rows.select("d_tp", "d_fp", F.round(mt.fbeta_of_rates(p, r), 6).alias("fbeta"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"))


@query(
    "h16_surface",
    with_parts(
        f"""SELECT source, i, j, round(26.0*pp*rr/(25.0*pp+rr),6) AS fbeta FROM (
             SELECT source, pp, rr, CASE WHEN pp>=0.5 THEN floor((pp-0.5)*198)::BIGINT END AS i, CASE WHEN rr>=0.5 THEN floor((rr-0.5)*198)::BIGINT END AS j FROM (
               SELECT source, tp/(tp+fp)::DOUBLE AS pp, tp/(tp+fn)::DOUBLE AS rr
               FROM (SELECT source, {_COUNTS} FROM pairs JOIN (SELECT doc_id::VARCHAR AS document, source FROM documents) USING (document) GROUP BY 1)))""",
        "pred",
        pairs=_PAIRS,
    ),
)
def h16_surface(spark, sf):
    """F-beta of every source at its precision and recall, and its cell of the surface (100 x 100 over [0.5, 1])."""
    sources = fr.documents(spark, sf).select("document", "source")
    by = mt.fbeta_score(pairs(spark, sf).join(sources, "document"), ("source",))
    cell = lambda x: F.when(x >= 0.5, F.floor((x - 0.5) * 198))
    p, r = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / (F.col("tp") + F.col("fn"))
    return by.select("source", cell(p).alias("i"), cell(r).alias("j"), F.round(mt.fbeta_of_rates(p, r), 6).alias("fbeta"))


@query(
    "h16_grid",
    with_parts(
        """SELECT source, i, j, round(tp,4) AS tp, round(tp*(1/p-1),4) AS fp, round(n_gold-tp,4) AS fn, round(26*tp/(26*tp+25*(n_gold-tp)+tp*(1/p-1)),6) AS fbeta FROM (
             SELECT source, n_gold, i, j, 0.5::DOUBLE+i*(0.5::DOUBLE/99) AS p, (0.5::DOUBLE+j*(0.5::DOUBLE/99))*n_gold AS tp FROM (
               SELECT source, n_gold, i::INT AS i, unnest(range(100))::INT AS j FROM (SELECT source, n_gold, unnest(range(100)) AS i FROM (
                 SELECT source, count(*) AS n_gold FROM gold WHERE label<>'O' GROUP BY 1))))""",
        "gold",
    ),
)
def h16_grid(spark, sf):
    """The whole surface (100 x 100 over [0.5, 1]) with the counts each source's gold labels need for it."""
    totals = fr.gold(spark, sf).filter("label <> 'O'").groupBy("source").agg(F.count("*").alias("n_gold"))
    grid = mt.fbeta_grid(totals, by=("source",))
    return grid.select("source", "i", "j", *(F.round(c, 4).alias(c) for c in ("tp", "fp", "fn")), F.round("fbeta", 6).alias("fbeta"))


@query(
    "h17_fbeta_without_bio",
    with_parts(
        f"SELECT tp, fp, fn, round(26.0*tp/(26.0*tp+25.0*fn+fp),6) AS fbeta FROM (SELECT {_COUNTS} FROM (SELECT CASE WHEN label_gt IS NULL THEN 'FP' WHEN label_pred IS NULL THEN 'FN' WHEN substr(label_gt,3)=substr(label_pred,3) THEN 'TP' ELSE 'FNFP' END AS cm FROM pairs))",
        "pred",
        pairs=_PAIRS,
    ),
)
def h17_fbeta_without_bio(spark, sf):
    p = mt.score_pairs(mt.without_bio(fr.predictions(spark, sf)), mt.without_bio(mt.gold_rows(fr.gold(spark, sf))))
    return mt.fbeta_score(p).withColumn("fbeta", F.round("fbeta", 6))
