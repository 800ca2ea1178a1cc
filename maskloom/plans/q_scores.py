"""Scores to labels (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskloom.functions import text as tx
from maskloom.functions.hashing import hash_int
from maskloom.functions.labels import LABELS
from maskloom.operators import scores as sc
from maskloom.operators import tagger as tg
from maskloom.operators import tokens as tk
from maskloom.operators import windows as wn
from maskloom.plans import detect
from maskloom.plans import frames as fr
from maskloom.plans.registry import query
from maskloom.plans.sqlparts import _ESUM, _XMAX, h, isspace, lit, with_parts
from maskloom.sources import io

_P = [f"p{i}" for i in range(12)]
_ENT = [f"p{i}" for i in range(11)]
_TOP = """list_reverse_sort([""" + ",".join(
    "{'s':p%d,'i':%d,'l':%s}" % (i, i, lit(n)) for i, n in enumerate(LABELS)
) + "])"


@query(
    "c1_softmax",
    with_parts(
        "SELECT label AS gold_label, count(*) AS n, "
        + ", ".join(f"round(avg(p{i}),6) AS s{i}" for i in range(12))
        + " FROM prob GROUP BY 1",
        "prob",
    ),
)
def c1_softmax(spark, sf):
    return fr.wide_scores(spark, sf).groupBy("gold_label").agg(
        F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(f"s{i}") for i, c in enumerate(LABELS)]
    )


_PIECE_SCORES = (
    "SELECT document, token, piece, plen, tlen, "
    + ", ".join(f"e{i}/({_ESUM}) AS p{i}" for i in range(12))
    + " FROM (SELECT *, "
    + ", ".join(f"exp(x{i}-{_XMAX}) AS e{i}" for i in range(12))
    + " FROM (SELECT *, "
    + ", ".join(
        f"('0x'||substr(dg,{2 * i + 1},2))::INT/64.0::DOUBLE + CASE WHEN label={lit(n)} THEN {8.0 if n == 'O' else 6.0} ELSE 0.0 END AS x{i}"
        for i, n in enumerate(LABELS)
    )
    + """ FROM (SELECT *, least(4, tlen-piece*4) AS plen, md5(concat_ws(':','wscore',document,token,piece,w)) AS dg FROM (
            SELECT *, unnest(range(greatest(ceil(length(token_text)/4.0),1)::BIGINT))::INT AS piece, length(token_text) AS tlen FROM (
              SELECT *, unnest(range(greatest((token-510)//382+1, 0), least(token//382, greatest(n_tokens-129,0)//382)+1)) AS w FROM gold)))))"""
).replace("(token-510)//382+1", "floor((token-510)/382.0)::BIGINT+1")


def _plain_tokens(spark, sf):
    """Tokens with their spans, without labels, which merging does not need."""
    return tk.token_spans(tk.match_rows(fr.documents(spark, sf).select("document", "text")))


@query(
    "c2_merge_windows",
    with_parts(
        "SELECT document, count(*) AS n, " + ", ".join(f"round(sum(m{i}),4) AS s{i}" for i in range(12)) + " FROM (SELECT document, token, " + ", ".join(f"max(p{i}) AS m{i}" for i in range(12)) + " FROM pieces GROUP BY 1,2) GROUP BY 1",
        "gold",
        pieces=_PIECE_SCORES,
    ),
)
def c2_merge_windows(spark, sf):
    tokens = _plain_tokens(spark, sf)
    merged = sc.merge_windows(fr.piece_scores(spark, sf), tokens)
    return _sums(merged)


def _sums(merged):
    return merged.groupBy("document").agg(
        F.count("*").alias("n"), *[F.round(F.sum(c), 4).alias(f"s{i}") for i, c in enumerate(LABELS)]
    )


@query(
    "c3_pool_mean",
    with_parts(
        "SELECT document, count(*) AS n, " + ", ".join(f"round(sum(m{i}),4) AS s{i}" for i in range(12)) + " FROM (SELECT document, token, "
        + ", ".join(f"sum(m{i}*plen)/max(tlen) AS m{i}" for i in range(12)) + " FROM (SELECT document, token, piece, plen, tlen, "
        + ", ".join(f"max(p{i}) AS m{i}" for i in range(12)) + " FROM pieces GROUP BY document, token, piece, plen, tlen) GROUP BY 1,2) GROUP BY 1",
        "gold",
        pieces=_PIECE_SCORES,
    ),
)
def c3_pool_mean(spark, sf):
    tokens = _plain_tokens(spark, sf)
    return _sums(sc.merge_windows(fr.piece_scores(spark, sf), tokens, pooling="mean"))


def decode_sql(t: str, source: str = "prob", extra: str = "") -> str:
    return f"""SELECT * FROM (SELECT document, token, token_text, {extra} label AS gold_label, CASE WHEN top[1].l<>'O' THEN top[1].l WHEN top[1].s<{t} THEN top[2].l END AS label
        FROM (SELECT *, {_TOP} AS top FROM {source}) WHERE {'+'.join(_P)}>=1e-4) WHERE label IS NOT NULL"""


@query(
    "c4_decode",
    with_parts("SELECT document, token, label FROM dec", "prob", dec=decode_sql("0.9")),
)
def c4_decode(spark, sf):
    return sc.decode(sc.with_top_two(fr.wide_scores(spark, sf)), 0.9).select("document", "token", "label")


@query(
    "c5_wide_scores",
    with_parts(
        "SELECT document, count(*) AS n, " + ", ".join(f"round(sum(p{i}),4) AS s{i}" for i in range(12)) + " FROM prob GROUP BY 1",
        "prob",
    ),
)
def c5_wide_scores(spark, sf):
    wide = fr.wide_scores(spark, sf)
    pairs = F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("score")) for c in LABELS])
    long = wide.select("document", "token", F.inline(pairs))
    return sc.widen(long).groupBy("document").agg(
        F.count("*").alias("n"), *[F.round(F.sum(c), 4).alias(f"s{i}") for i, c in enumerate(LABELS)]
    )


@query(
    "c6_drop_blank_tokens",
    with_parts(
        f"SELECT document, count(*) AS n, sum(token)::BIGINT AS checksum FROM tok WHERE NOT ({isspace('token_text')} AND NOT contains(token_text, chr(10))) GROUP BY 1",
        "tok",
    ),
)
def c6_drop_blank_tokens(spark, sf):
    rows = tk.token_rows(tk.tokenize(fr.documents(spark, sf)).select("document", "toks"))
    return sc.drop_blank_tokens(rows).groupBy("document").agg(
        F.count("*").alias("n"), F.sum("token").alias("checksum")
    )


_UMODEL = (
    "SELECT document, token, avg("
    + f"({h('model', 'm', 'document', 'token')}%1000)/1000.0::DOUBLE"
    + ") AS score FROM utok, (VALUES ('m1'),('m2'),('m3')) v(m) WHERE contains(token_text,'http') OR contains(token_text,'://') OR contains(token_text,'www.') GROUP BY 1,2"
)


@query("c8_ensemble", with_parts(f"SELECT document, token, round(score,6) AS score FROM ({_UMODEL})", "utok"))
def c8_ensemble(spark, sf):
    return url_model_mean(spark, sf).withColumn("score", F.round("score", 6))


def url_model_mean(spark, sf):
    """Mean of three stand-in URL models."""
    urls = tk.token_rows(tk.tokenize(fr.url_documents(spark, sf)).select("document", "toks")).filter(
        tx.is_url_token(F.col("token_text"))
    )
    models = [
        urls.withColumn("score", hash_int("model", F.lit(m), "document", "token") % 1000 / 1000.0)
        for m in ("m1", "m2", "m3")
    ]
    return sc.ensemble(models, ["document", "token"], ["score"])


@query(
    "c9_union_folds",
    with_parts(
        "SELECT 'fold'||(document::BIGINT%4) AS run, label, count(*) AS n, count(DISTINCT document) AS n_documents FROM pred GROUP BY 1,2",
        "pred",
    ),
)
def c9_union_folds(spark, sf):
    preds = io.written(fr.predictions(spark, sf))  # the files of a run, read by fold
    fold = F.col("document").cast("long") % 4
    rows = sc.union_folds({f"fold{k}": preds.filter(fold == k) for k in range(4)})
    single = sc.documents_of_one_run(rows)
    return single.groupBy("run", "label").agg(
        F.count("*").alias("n"), F.count_distinct("document").alias("n_documents")
    )


@query(
    "c10_second_look",
    with_parts(
        f"SELECT document, count(*) AS n, sum(token)::BIGINT AS checksum FROM prob WHERE (greatest({','.join(_ENT)})>0.05 OR p11<0.92) AND {'+'.join(_P)}>1e-4 GROUP BY 1",
        "prob",
    ),
)
def c10_second_look(spark, sf):
    rows = sc.second_look(fr.wide_scores(spark, sf), 0.05, 0.92)
    return rows.groupBy("document").agg(F.count("*").alias("n"), F.sum("token").alias("checksum"))


@query(
    "c11_training_candidates",
    with_parts(
        f"SELECT label AS gold_label, count(*) AS n, sum(token)::BIGINT AS checksum FROM prob WHERE {'+'.join(_ENT)}>0.05 OR p11<0.99 OR label<>'O' GROUP BY 1",
        "prob",
    ),
)
def c11_training_candidates(spark, sf):
    rows = sc.training_candidates(fr.wide_scores(spark, sf))
    return rows.groupBy("gold_label").agg(F.count("*").alias("n"), F.sum("token").alias("checksum"))


@query(
    "c12_candidate_indexes",
    with_parts(
        f"SELECT document, count(*) AS n, md5(string_agg(token::VARCHAR, ' ' ORDER BY token)) AS idxs_md5 FROM prob WHERE greatest({','.join(_ENT)})>0.02 GROUP BY 1",
        "prob",
    ),
)
def c12_candidate_indexes(spark, sf):
    rows = fr.wide_scores(spark, sf).filter(sc.has_entity_score(0.02))
    idxs = F.array_join(F.array_sort(F.collect_list("token")), " ")
    return rows.groupBy("document").agg(F.count("*").alias("n"), F.md5(idxs.cast("binary")).alias("idxs_md5"))


_PROB2 = (
    "SELECT document, token, " + ", ".join(f"e{i}/({_ESUM}) AS r{i}" for i in range(12)) + " FROM (SELECT *, "
    + ", ".join(f"exp(x{i}-{_XMAX}) AS e{i}" for i in range(12)) + " FROM (SELECT *, "
    + ", ".join(
        f"('0x'||substr(dg,{2 * i + 1},2))::INT/64.0::DOUBLE + CASE WHEN label={lit(n)} THEN {8.0 if n == 'O' else 6.0} ELSE 0.0 END AS x{i}"
        for i, n in enumerate(LABELS)
    )
    + f" FROM (SELECT *, md5(concat_ws(':','second',document,token)) AS dg FROM prob WHERE (greatest({','.join(_ENT)})>0.05 OR p11<0.92))))"
)


@query(
    "c13_replace_scores",
    with_parts(
        "SELECT document, count(*) AS n, " + ", ".join(f"round(sum(coalesce(r{i},p{i})),4) AS s{i}" for i in range(12))
        + " FROM prob LEFT JOIN prob2 USING (document, token) GROUP BY 1",
        "prob",
        prob2=_PROB2,
    ),
)
def c13_replace_scores(spark, sf):
    first = fr.wide_scores(spark, sf)
    picked = sc.second_look(first, 0.05, 0.92).select("document", "token", F.col("gold_label").alias("label"))
    second = sc.softmax(fr.raw_scores(picked, "second", "document", "token"))
    final = sc.replace_scores(first, second)
    return final.groupBy("document").agg(
        F.count("*").alias("n"), *[F.round(F.sum(c), 4).alias(f"s{i}") for i, c in enumerate(LABELS)]
    )


@query("c14_rule_scorer", detect.FLAGSHIP_SQL)
def c14_rule_scorer(spark, sf):
    return detect.flagship(spark, sf)


@query(
    "c14_model_hook",
    with_parts("SELECT 'B-ID_NUM' AS label, count(*) AS n FROM tok WHERE length(token_text)>7 AND regexp_matches(token_text,'[0-9]') HAVING count(*)>0", "tok"),
)
def c14_model_hook(spark, sf):
    windows = wn.window_tokens(tk.tokenize(fr.documents(spark, sf)).select("document", "toks"), 512, 128)
    best = sc.best_over_windows(sc.score_windows(windows, detect.length_model)).withColumn("token_text", F.lit(""))
    return sc.decode(sc.with_top_two(best), 0.9).groupBy("label").agg(F.count("*").alias("n"))


#: Documents that the tagger learns from.
LEARNT = 1000


@query("c14_fitted_model")
def c14_fitted_model(spark, sf):
    docs = fr.documents(spark, sf)
    some = fr.label_tokens(tk.tokenize(tk.colocate(tg.sample_documents(fr.stored(spark, sf), LEARNT))))
    weights = tg.fit(wn.labelled_windows(some, 512, 128))
    windows = wn.window_tokens(tk.tokenize(docs).select("document", "toks"), 512, 128)
    best = sc.best_over_windows(tg.cross_scored(windows, weights)).withColumn("token_text", F.lit(""))
    found = sc.decode(sc.with_top_two(best), 0.5).select("document", "token", "label", F.lit(1).alias("p"), F.lit(0).alias("g"))
    gold = fr.gold(spark, sf).filter("label <> 'O'").select("document", "token", "label", F.lit(0).alias("p"), F.lit(1).alias("g"))
    pairs = found.unionByName(gold).groupBy("document", "token", "label").agg(F.max("p").alias("p"), F.max("g").alias("g"))
    return pairs.groupBy("label").agg(
        F.count_if(F.expr("p = 1 AND g = 1")).alias("tp"), F.count_if(F.expr("p = 1 AND g = 0")).alias("fp"), F.count_if(F.expr("p = 0 AND g = 1")).alias("fn")
    )


@query(
    "c15_lost_mass",
    with_parts(
        f"SELECT document, count(*) AS n, sum(token)::BIGINT AS checksum FROM prob WHERE ({'+'.join(_P)})*({h('mass', 'document', 'token')}%1000+0.5)<800 GROUP BY 1",
        "prob",
    ),
)
def c15_lost_mass(spark, sf):
    kept = (hash_int("mass", "document", "token") % 1000 + 0.5) / 1000.0
    wide = fr.wide_scores(spark, sf)
    other = [c for c in wide.columns if c not in LABELS]
    drawn = sc.as_columns(wide, wide.columns, [kept.alias("_kept")])  # one digest per token, not one per label
    lossy = sc.as_columns(drawn, other, [(F.col(c) * F.col("_kept")).alias(c) for c in LABELS])
    return sc.lost_mass(lossy).groupBy("document").agg(F.count("*").alias("n"), F.sum("token").alias("checksum"))
