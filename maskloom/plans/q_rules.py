"""Rule post-processing (D)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.functions import text as tx
from maskloom.functions.hashing import hash_int
from maskloom.functions.labels import ENTITY_LABELS, LABELS
from maskloom.operators import masks as ms
from maskloom.operators import rules as ru
from maskloom.operators import scores as sc
from maskloom.operators import tokens as tk
from maskloom.plans import frames as fr
from maskloom.plans.q_scores import _TOP
from maskloom.plans.registry import query
from maskloom.plans.sqlparts import h, islower, isspace, istitle, lit, qid, with_parts
from maskloom.sources import io

KEYS = ("document", "token", "token_text", "label")
# The synthetic prose has no titles, so frequent capitalised words play their part.
STAND_IN_TITLES = (*ru.TITLES, "erst", "eres", "dans", "eaea", "reed", "onnd")

PRED = "SELECT document, token, token_text, label FROM pred"


def titles_sql(src: str, by: str = "") -> str:
    names = ",".join(lit(t) for t in STAND_IN_TITLES)
    return f"""SELECT {by} document, token, token_text, CASE WHEN label='I-NAME_STUDENT' AND coalesce(pg AND pt=token-1,false) THEN 'B-NAME_STUDENT' ELSE label END AS label
      FROM (SELECT *, lag(gone) OVER w AS pg, lag(token) OVER w AS pt FROM (
        SELECT *, label IN ('B-NAME_STUDENT','I-NAME_STUDENT') AND rtrim(lower(token_text),'.') IN ({names}) AS gone FROM {src})
        WINDOW w AS (PARTITION BY {by} document ORDER BY token)) WHERE NOT gone"""


def repair_sql(src: str, by: str = "") -> str:
    return f"""SELECT {by} document, token, token_text,
       CASE WHEN label='I-NAME_STUDENT' AND NOT adj THEN 'B-NAME_STUDENT'
            WHEN label='B-NAME_STUDENT' AND (row_number() OVER (PARTITION BY {by} document, run, label ORDER BY token)-1
                 + first_value((coalesce(pl='I-NAME_STUDENT',false) AND adj AND NOT padj)::INT) OVER (PARTITION BY {by} document, run, label ORDER BY token))%2=1 THEN 'I-NAME_STUDENT'
            ELSE label END AS label
     FROM (SELECT *, sum((label='B-NAME_STUDENT' AND NOT (adj AND coalesce(pl,'')='B-NAME_STUDENT'))::INT) OVER (PARTITION BY {by} document ORDER BY token) AS run FROM (
       SELECT *, coalesce(lag(adj) OVER (PARTITION BY {by} document ORDER BY token),false) AS padj FROM (
         SELECT *, coalesce(lag(token) OVER w = token-1,false) AS adj, lag(label) OVER w AS pl FROM {src} WINDOW w AS (PARTITION BY {by} document ORDER BY token))))"""


def repeated_sql(src: str, by: str = "") -> str:
    on = " AND ".join([f"p.{c}=n.{c}" for c in ("document", "token")] + ([f"p.{by.strip(' ,')}=n.{by.strip(' ,')}"] if by else []))
    return f"""SELECT {by} document, token, token_text, label FROM {src} UNION ALL
      SELECT {by} document, token, token_text, label FROM (
        SELECT {('n.' + by) if by else ''} t.document, t.token, t.token_text, n.label FROM tok t JOIN
          (SELECT {by} document, token_text, arg_max(label, token) AS label FROM {src} WHERE label LIKE '%NAME_STUDENT%' AND length(token_text)>1 AND {istitle('token_text')} GROUP BY ALL) n
          ON t.document=n.document AND t.token_text=n.token_text) n
      WHERE NOT EXISTS (SELECT 1 FROM {src} p WHERE {on})"""


_LIKE_URL = "(starts_with(token_text,'http') OR starts_with(token_text,'www.')) AND (contains(token_text,'http') OR contains(token_text,'://')) AND (contains(token_text,'facebook.com') OR contains(token_text,'linkedin')) AND length(token_text)<50"


def emails_sql(src: str, by: str = "") -> str:
    on = " AND ".join([f"p.{c}=n.{c}" for c in ("document", "token", "label")] + ([f"p.{by.strip(' ,')}=n.{by.strip(' ,')}"] if by else []))
    values = f", (SELECT DISTINCT {by.strip(' ,')} FROM {src})" if by else ""
    return f"""SELECT {by} document, token, token_text, label FROM {src} UNION ALL
      SELECT {by} document, token, token_text, label FROM (SELECT {by} document, token, token_text, CASE WHEN regexp_matches(token_text,{lit(tx.EMAIL)}) THEN 'B-EMAIL' WHEN {_LIKE_URL} THEN 'B-URL_PERSONAL' END AS label FROM tok{values}) n
      WHERE label IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {src} p WHERE {on})"""


_CASING = f"SELECT * FROM @src WHERE NOT (label LIKE '%NAME_STUDENT%' AND NOT {istitle('token_text')})"
_NEVER = "SELECT * FROM @src WHERE label NOT IN ('I-USERNAME','I-EMAIL','I-URL_PERSONAL')"
_PHONES = r"SELECT * REPLACE (CASE WHEN label='B-PHONE_NUM' AND length(token_text)>4 AND NOT regexp_matches(token_text,'[().x+-]') THEN 'B-ID_NUM' ELSE label END AS label) FROM @src"


@query("d1_name_casing", with_parts("SELECT document, token, token_text, label FROM pred WHERE NOT (label LIKE '%NAME_STUDENT%' AND NOT " + istitle("token_text") + ")", "pred"))
def d1_name_casing(spark, sf):
    return ru.drop_miscased_names(fr.predictions(spark, sf)).select(*KEYS)


@query("d2_name_titles", with_parts(titles_sql("pred"), "pred"))
def d2_name_titles(spark, sf):
    return ru.remove_titles(fr.predictions(spark, sf), titles=STAND_IN_TITLES).select(*KEYS)


_DENSE = f"""SELECT document, token, token_text, CASE {h('dense', 'document', 'token')}%3 WHEN 0 THEN 'B-NAME_STUDENT' WHEN 1 THEN 'I-NAME_STUDENT' ELSE 'B-ID_NUM' END AS label
   FROM tok WHERE {h('keep', 'document', 'token')}%10<3"""


def dense_names(spark, sf):
    """Three tenths of all tokens with random name labels: many adjacent runs."""
    rows = tk.token_rows(tk.tokenize(fr.documents(spark, sf)).select("document", "toks"))
    pick3 = F.element_at(F.array(F.lit(ru.NAME_B), F.lit(ru.NAME_I), F.lit("B-ID_NUM")), (hash_int("dense", "document", "token") % 3 + 1).cast("int"))
    return rows.filter(hash_int("keep", "document", "token") % 10 < 3).select("document", "token", "token_text", pick3.alias("label"))


@query(
    "d3_repair_names",
    with_parts(
        "SELECT document, label, count(*) AS n, sum(token)::BIGINT AS checksum FROM fixed GROUP BY 1,2",
        "tok",
        dense=_DENSE,
        fixed=repair_sql("dense"),
    ),
)
def d3_repair_names(spark, sf):
    return ru.repair_names(dense_names(spark, sf)).groupBy("document", "label").agg(
        F.count("*").alias("n"), F.sum("token").alias("checksum")
    )


@query("d4_repeated_names", with_parts(repeated_sql("pred"), "pred"))
def d4_repeated_names(spark, sf):
    preds = fr.beside_documents(spark, sf, io.written(fr.predictions(spark, sf)))
    return ru.add_repeated_names(preds, fr.token_texts(spark, sf)).select(*KEYS)


@query("d5_emails_urls", with_parts(emails_sql("pred"), "pred"))
def d5_emails_urls(spark, sf):
    return ru.add_emails_and_urls(io.written(fr.predictions(spark, sf)), fr.token_texts(spark, sf)).select(*KEYS)


_UPRED = f"""SELECT * FROM (SELECT document, token, token_text, CASE WHEN (contains(token_text,'http') OR contains(token_text,'://') OR contains(token_text,'www.')) THEN CASE WHEN {h('u', 'document', 'token')}%5=0 THEN 'I-URL_PERSONAL' ELSE 'B-URL_PERSONAL' END
   WHEN {h('u', 'document', 'token')}%97=0 THEN 'B-URL_PERSONAL' WHEN {h('u', 'document', 'token')}%101=0 THEN 'B-NAME_STUDENT' END AS label FROM utok) WHERE label IS NOT NULL"""


def url_predictions(spark, sf):
    rows = tk.token_rows(tk.tokenize(fr.url_documents(spark, sf)).select("document", "toks"))
    draw = hash_int("u", "document", "token")
    label = (
        F.when(tx.is_url_token(F.col("token_text")), F.when(draw % 5 == 0, "I-URL_PERSONAL").otherwise(F.lit("B-URL_PERSONAL")))
        .when(draw % 97 == 0, "B-URL_PERSONAL")
        .when(draw % 101 == 0, "B-NAME_STUDENT")
    )
    return rows.select("document", "token", "token_text", label.alias("label")).filter("label IS NOT NULL")


@query(
    "d6_bad_urls",
    with_parts(
        """SELECT document, token, token_text, label FROM upred WHERE label<>'I-URL_PERSONAL' AND NOT (label='B-URL_PERSONAL' AND
           (contains(token_text,'coursera.org') OR contains(token_text,'wikipedia.org') OR contains(token_text,'.gov') OR contains(token_text,'.edu')
            OR NOT (contains(token_text,'http') OR contains(token_text,'://') OR contains(token_text,'www.'))))""",
        "utok",
        upred=_UPRED,
    ),
)
def d6_bad_urls(spark, sf):
    return ru.drop_bad_urls(url_predictions(spark, sf)).select(*KEYS)


@query("d7_never_labels", with_parts(_NEVER.replace("@src", "(" + PRED + ")"), "pred"))
def d7_never_labels(spark, sf):
    return ru.drop_never_labels(fr.predictions(spark, sf)).select(*KEYS)


@query("d8_phones_to_ids", with_parts(_PHONES.replace("@src", "(" + PRED + ")"), "pred"))
def d8_phones_to_ids(spark, sf):
    return ru.phones_to_ids(fr.predictions(spark, sf)).select(*KEYS)


_T = "token_text"
_URLQ = f"regexp_matches({_T},'http|www|://')"
_LINE = f"{_T} IN (chr(10), chr(10)||chr(10))"


def impossible_sql(n: int) -> dict[str, str]:
    size = f"length({_T})"
    return {
        "NAME_STUDENT": f"(NOT {istitle(_T)} OR regexp_matches({_T},'[^a-zA-Z.]') OR {_URLQ} OR {_LINE} OR {size}<=1)",
        "USERNAME": f"(NOT {islower(_T)} OR {isspace(_T)} OR {_URLQ} OR {_LINE} OR {size}<={n})",
        "ID_NUM": f"({isspace(_T)} OR {_URLQ} OR {_LINE})",
        "EMAIL": f"({_URLQ} OR {_LINE} OR {size}<={n} OR NOT contains({_T},'@'))",
        "PHONE_NUM": f"({_URLQ} OR {_LINE})",
        "STREET_ADDRESS": f"({_URLQ})",
        "URL_PERSONAL": f"({_LINE} OR {size}<={n})",
    }


def _type_sum(t: str) -> str:
    return "+".join(qid(c) for c in ENTITY_LABELS if c[2:] == t)


_TYPES = list(ru.TYPE_THRESHOLDS)
_ZEROED = "SELECT document, token, token_text, " + ", ".join(
    f"CASE WHEN {bad} THEN 0.0 ELSE {_type_sum(t)} END AS {t}" for t, bad in impossible_sql(4).items()
) + " FROM wide"


@query(
    "d9_zero_types",
    with_parts("SELECT document, " + ", ".join(f"round(sum({t}),4) AS {t.lower()}" for t in _TYPES) + " FROM z GROUP BY 1", "wide", z=_ZEROED),
)
def d9_zero_types(spark, sf):
    z = ru.zero_impossible_types(ru.collapse_bio(fr.wide_scores(spark, sf)))
    return z.groupBy("document").agg(*[F.round(F.sum(t), 4).alias(t.lower()) for t in _TYPES])


_EXTRA = {
    "NAME_STUDENT": f"rtrim({_T},'.') NOT IN ('Mr','Mrs','Dr','Ms','Miss','Prof')",
    "URL_PERSONAL": f"length({_T})>5",
    "EMAIL": f"NOT {isspace(_T)}",
}
_HITS10 = " UNION ALL ".join(
    f"SELECT document, token, token_text, '{t}' AS type FROM z WHERE {t}>{cut} AND {_EXTRA.get(t, 'true')}" for t, cut in ru.TYPE_THRESHOLDS.items()
)


@query(
    "d10_decode_types",
    with_parts(
        f"""SELECT document, token, token_text, type, CASE WHEN type IN ({','.join(lit(t) for t in ru.RUN_TYPES)}) AND coalesce(lag(token) OVER (PARTITION BY document, type ORDER BY token)=token-1,false) THEN 'I-' ELSE 'B-' END||type AS label FROM hits""",
        "wide",
        z=_ZEROED,
        hits=_HITS10,
    ),
)
def d10_decode_types(spark, sf):
    z = ru.zero_impossible_types(ru.collapse_bio(fr.wide_scores(spark, sf)))
    return ru.decode_types(z).select("document", "token", "token_text", "type", "label")


def _zero_label(c: str) -> str:
    bad = f"({_URLQ} OR {_LINE})" if c == "I-ID_NUM" else impossible_sql(3)[c[2:]]
    return f"CASE WHEN {bad} THEN 0.0 ELSE {qid(c)} END AS {qid(c)}"


_ZERO12 = "SELECT document, token, token_text, gold_label, \"O\", " + ", ".join(_zero_label(c) for c in ENTITY_LABELS) + " FROM wide"


@query(
    "d11_zero_labels",
    with_parts("SELECT document, " + ", ".join(f"round(sum({qid(c)}),4) AS s{i}" for i, c in enumerate(ENTITY_LABELS)) + " FROM z GROUP BY 1", "wide", z=_ZERO12),
)
def d11_zero_labels(spark, sf):
    z = ru.zero_impossible_labels(fr.wide_scores(spark, sf))
    return z.groupBy("document").agg(*[F.round(F.sum(c), 4).alias(f"s{i}") for i, c in enumerate(ENTITY_LABELS)])


def _argmax(cols) -> str:
    top = "greatest(" + ",".join(qid(c) for c in cols) + ")"
    return "CASE " + " ".join(f"WHEN {qid(c)}={top} THEN {lit(c)}" for c in cols) + " END"


_ENT = ",".join(qid(c) for c in ENTITY_LABELS)


@query(
    "d12_decode_argmax",
    with_parts(
        f"""SELECT label, gold_label, count(*) AS n, sum(token)::BIGINT AS checksum FROM (SELECT *, CASE WHEN {'+'.join(qid(c) for c in ENTITY_LABELS)}<1e-3 THEN 'O'
            WHEN {_URLQ} AND "B-URL_PERSONAL">0.15 THEN 'B-URL_PERSONAL'
            WHEN greatest({_ENT})>0.15 AND "O"<0.9 THEN {_argmax(ENTITY_LABELS)} ELSE {_argmax(LABELS)} END AS label FROM z) GROUP BY 1,2""",
        "wide",
        z=_ZERO12,
    ),
)
def d12_decode_argmax(spark, sf):
    z = ru.zero_impossible_labels(fr.wide_scores(spark, sf))
    return ru.decode_argmax(z).groupBy("label", "gold_label").agg(
        F.count("*").alias("n"), F.sum("token").alias("checksum")
    )


THRESHOLDS = (0.85, 0.9, 0.95)


def decoded_masks(spark, sf, thresholds=THRESHOLDS) -> DataFrame:
    """Every token of `documents` with its gold label and its labels at each threshold."""
    top = sc.with_top_two(fr.wide_scores(spark, sf)).select(
        "document", "token", "token_text", "gold_label", "top", "top_score", "second", "score_sum"
    )
    return ms.decode_masks(top, thresholds)


def step_scores(spark, sf, thresholds=THRESHOLDS) -> DataFrame:
    """F-beta after every correction step, for several thresholds in one job that writes nothing."""
    rows = ms.correct_masks(decoded_masks(spark, sf, thresholds), len(thresholds), keep_steps=True)
    return ms.scores_by_step(rows, thresholds).withColumn("fbeta", F.round("fbeta", 6))


_BY = "threshold, "


def _chain_ctes() -> dict[str, str]:
    dec = f"""SELECT * FROM (SELECT threshold, document, token, token_text, CASE WHEN top[1].l<>'O' THEN top[1].l WHEN top[1].s<threshold THEN top[2].l END AS label
        FROM (SELECT *, {_TOP} AS top FROM prob), (VALUES (0.85::DOUBLE),(0.9),(0.95)) t(threshold)
        WHERE NOT ({isspace(_T)} AND NOT contains({_T},chr(10)))) WHERE label IS NOT NULL"""
    strict = ",".join(lit(t) for t in ru.TITLES)
    return {
        "dec": dec,
        "s1": _CASING.replace("@src", "dec"),
        "s2": repeated_sql("s1", _BY),
        "s3": emails_sql("s2", _BY),
        "s4": titles_sql("s3", _BY).replace(",".join(lit(t) for t in STAND_IN_TITLES), strict),
        "s5": repair_sql("s4", _BY),
        "s6": _NEVER.replace("@src", "s5"),
        "s7": _PHONES.replace("@src", "s6"),
    }


_CHAIN_NAMES = ("name_casing", "repeated_names", "emails_urls", "name_titles", "repair_names", "never_labels", "phone_numbers")
_ALL_STEPS = " UNION ALL ".join(
    f"SELECT threshold, '{n}' AS step, document, token, label FROM s{i + 1}" for i, n in enumerate(_CHAIN_NAMES)
)
SWEEP_SQL = with_parts(
    """SELECT threshold, step, tp, fp, n_gold-found AS fn, round(26.0*tp/(26.0*tp+25.0*(n_gold-found)+fp),6) AS fbeta FROM (
         SELECT threshold, step, count(*) FILTER (g.label=a.label) AS tp, count(*) FILTER (g.label IS NULL OR g.label<>a.label) AS fp,
           count(DISTINCT (a.document, a.token)) FILTER (g.label=a.label) AS found, (SELECT count(*) FROM gold WHERE label<>'O') AS n_gold
         FROM alls a LEFT JOIN (SELECT document, token, label FROM gold WHERE label<>'O') g ON a.document=g.document AND a.token=g.token GROUP BY 1,2)""",
    "prob",
    **_chain_ctes(),
    alls=_ALL_STEPS,
)


@query(
    "d13_correction_chain",
    with_parts("SELECT threshold, label, count(*) AS n FROM s7 GROUP BY 1,2", "prob", **_chain_ctes()),
)
def d13_correction_chain(spark, sf):
    rows = ms.correct_masks(decoded_masks(spark, sf), len(THRESHOLDS))
    return ms.long_labels(rows, THRESHOLDS).groupBy("threshold", "label").agg(F.count("*").alias("n"))


@query("h6_threshold_sweep", SWEEP_SQL)
def h6_threshold_sweep(spark, sf):
    return step_scores(spark, sf)
